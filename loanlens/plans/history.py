"""History queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.numbers import rounded as R
from ..operators import history as H
from ..operators.marks import with_price
from ..sources.staging import staged
from ..sources.tables import HOLDINGS_SQL, holdings
from .marks import marks

YEARS = tuple(range(1995, 2002))
NOW, THEN = 2000, 1998


def priced(spark, sf):
    return with_price(holdings(spark, sf))


def series(spark, sf):
    return H.issuer_series(staged(marks(spark, sf).select("issuer", "yr", "fund", "mark"), "marks"))


def a05_issuer_series(spark, sf):
    return series(spark, sf).select("issuer", "yr", R("mark").alias("mark"), "funds")


def a07_trend(spark, sf):
    points = [R(c, 4).alias(c) for c in ("first", "last", "peak", "trough", "range", "net")]
    return H.trend(series(spark, sf)).select("issuer", "dates", "first_obs", "last_obs", "funds_at_first", "funds_at_last", *points)


def p14_decliners(spark, sf):
    """Ranked series that fell, at most 150: smallest net change first."""
    t = a07_trend(spark, sf).filter("range > 0 and net < 0")
    return t.orderBy("net", "issuer").limit(150).withColumn("rank", F.row_number().over(Window.orderBy("net", "issuer"))).select("rank", "issuer", "net", "range")


def a08_owner_positions(spark, sf):
    return H.owner_positions(priced(spark, sf)).select("issuer", "fund", "yr", R("fv", 4).alias("fv"), R("mark").alias("mark"), "lots", "seniorities", R("of_issuer").alias("of_issuer"), R("of_fund").alias("of_fund"), "funds")


def a09_tenure(spark, sf):
    return H.tenure(priced(spark, sf))


def j16_stable_holders(spark, sf):
    return H.stable_holder_change(priced(spark, sf)).select("issuer", "stayed", "came", "left", R("change", 4).alias("change"))


def a11_holder_rollup(spark, sf):
    rolled = H.holder_rollup(a08_owner_positions(spark, sf).filter(f"yr = {NOW}"))
    return rolled.select("issuer", "holders", R("exposure", 4).alias("exposure"), R("apart", 4).alias("apart"))


def j04_owners(spark, sf):
    found = H.owners(a08_owner_positions(spark, sf), p14_decliners(spark, sf), a09_tenure(spark, sf), j16_stable_holders(spark, sf), NOW, THEN)
    sums = [R(c, 4).alias(c) for c in ("exposure", "exposure_then")]
    return found.select("rank", "issuer", "fund", "net", "fv", "mark", "since", "until", "holders", R("apart", 4).alias("apart"), "mark_then", *sums, "stayed", "came", "left", "change")


def o09_wide_history(spark, sf):
    wide = H.wide_history(priced(spark, sf), YEARS)
    return wide.select("issuer", "fund", *[R(f"{y}_{c}", 4).alias(f"{c}_{y}") for y in YEARS for c in ("mark", "fv")])


def w05_first_last_mark(spark, sf):
    """First and last observed mark and the position of the last, skipping gaps."""
    own = priced(spark, sf).filter("price is not null").groupBy("issuer", "fund", "yr").agg(F.median("price").alias("mark"))
    prev = F.lag("yr").over(Window.partitionBy("issuer", "fund").orderBy("yr"))
    return own.withColumn("prev", prev).groupBy("issuer", "fund").agg(
        R(F.min_by("mark", "yr")).alias("first"), R(F.max_by("mark", "yr")).alias("last"), F.max("yr").alias("last_yr"), F.max(F.col("yr") - F.col("prev")).alias("longest_gap")
    )


QUERIES = {f.__name__: f for f in (a05_issuer_series, a07_trend, p14_decliners, a08_owner_positions, a09_tenure, j16_stable_holders, a11_holder_rollup, j04_owners, o09_wide_history, w05_first_last_mark)}

_W = "WITH " + HOLDINGS_SQL + """, s AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY issuer) AS n FROM (SELECT issuer, yr, median(mark) AS mark, count(DISTINCT fund) AS funds FROM fm GROUP BY ALL HAVING count(DISTINCT fund) >= 3)) WHERE n >= 3),
t AS (SELECT issuer, count(*) AS dates, min(yr) AS first_obs, max(yr) AS last_obs, arg_min(funds, yr) AS funds_at_first, arg_max(funds, yr) AS funds_at_last, arg_min(mark, yr) * 100 AS first, arg_max(mark, yr) * 100 AS last, max(mark) * 100 AS peak, min(mark) * 100 AS trough FROM s GROUP BY issuer),
t4 AS (SELECT issuer, dates, first_obs, last_obs, funds_at_first, funds_at_last, round(first, 4) AS first, round(last, 4) AS last, round(peak, 4) AS peak, round(trough, 4) AS trough, round(peak - trough, 4) AS range, round(last - first, 4) AS net FROM t),
o AS (SELECT issuer, fund, yr, median(price) AS mark FROM p WHERE price IS NOT NULL GROUP BY ALL)"""
SQL = {
    "a05_issuer_series": _W + " SELECT issuer, yr, round(mark, 6) AS mark, funds FROM s",
    "a07_trend": _W + " SELECT * FROM t4",
    "p14_decliners": _W + " SELECT CAST(row_number() OVER (ORDER BY net, issuer) AS INTEGER) AS rank, issuer, net, range FROM t4 WHERE range > 0 AND net < 0 ORDER BY net, issuer LIMIT 150",
    "a08_owner_positions": _W + """ SELECT issuer, fund, yr, round(fv, 4) AS fv, round(mark, 6) AS mark, lots, seniorities, round(fv / sum(fv) OVER (PARTITION BY issuer, yr), 6) AS of_issuer,
 round(fv / sum(fv) OVER (PARTITION BY fund, yr), 6) AS of_fund, count(*) OVER (PARTITION BY issuer, yr) AS funds
 FROM (SELECT issuer, fund, yr, sum(fv) AS fv, median(price) AS mark, count(*) AS lots, string_agg(DISTINCT sen, '; ' ORDER BY sen) AS seniorities FROM p GROUP BY ALL)""",
    "a09_tenure": _W + " SELECT issuer, fund, min(yr) AS since, max(yr) AS until, count(DISTINCT yr) AS dates FROM p GROUP BY ALL",
    "j16_stable_holders": _W + """, d AS (SELECT *, dense_rank() OVER (PARTITION BY issuer ORDER BY yr DESC) AS place FROM o),
 two AS (SELECT issuer, fund, max(mark) FILTER (place = 1) AS now, max(mark) FILTER (place = 2) AS prior FROM d WHERE place <= 2 GROUP BY ALL)
 SELECT issuer, count(*) FILTER (now IS NOT NULL AND prior IS NOT NULL) AS stayed, count(*) FILTER (prior IS NULL) AS came, count(*) FILTER (now IS NULL) AS left, round(median((now - prior) * 100), 4) AS change FROM two GROUP BY issuer""",
    "o09_wide_history": _W + " SELECT issuer, fund, " + ", ".join(f"round(median(price) FILTER (yr = {y}), 4) AS mark_{y}, round(sum(fv) FILTER (yr = {y}), 4) AS fv_{y}" for y in YEARS) + " FROM p GROUP BY ALL",
    "w05_first_last_mark": _W + """ SELECT issuer, fund, round(arg_min(mark, yr), 6) AS first, round(arg_max(mark, yr), 6) AS last, max(yr) AS last_yr, max(yr - prev) AS longest_gap
 FROM (SELECT *, lag(yr) OVER (PARTITION BY issuer, fund ORDER BY yr) AS prev FROM o) GROUP BY ALL""",
}
_R = f"SELECT issuer, count(DISTINCT fund) AS holders, sum(fv) AS exposure, CASE WHEN count(mark) >= 2 THEN (max(mark) - min(mark)) * 100 END AS apart FROM ({SQL['a08_owner_positions']}) WHERE yr = {NOW} GROUP BY issuer"
SQL["a11_holder_rollup"] = f"SELECT issuer, holders, round(exposure, 4) AS exposure, round(apart, 4) AS apart FROM ({_R})"
SQL["j04_owners"] = f"""WITH a AS ({SQL['a08_owner_positions']}), x AS (SELECT issuer, fund, mark AS mark_then, sum(fv) OVER (PARTITION BY issuer) AS exposure_then FROM a WHERE yr = {THEN})
SELECT rank, issuer, fund, net, fv, mark, since, until, holders, round(apart, 4) AS apart, mark_then, round(exposure, 4) AS exposure, round(exposure_then, 4) AS exposure_then, stayed, came, "left", change
FROM a JOIN ({SQL['p14_decliners']}) USING (issuer) LEFT JOIN ({SQL['a09_tenure']}) USING (issuer, fund) LEFT JOIN ({_R}) USING (issuer) LEFT JOIN x USING (issuer, fund) LEFT JOIN ({SQL['j16_stable_holders']}) USING (issuer) WHERE yr = {NOW}"""

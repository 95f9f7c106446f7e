"""Mark queries on the surrogate holdings, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import rounded as R
from ..operators import marks as M
from ..sources.staging import staged
from ..sources.tables import HOLDINGS_SQL, holdings



def matched(spark: SparkSession, sf: str) -> DataFrame:
    """Written once: every table of marks reads it, some more than once."""
    return staged(M.with_issue(M.with_price(holdings(spark, sf))), "matched")


def marks(spark: SparkSession, sf: str) -> DataFrame:
    return M.fund_marks(matched(spark, sf))


def stats(spark: SparkSession, sf: str) -> DataFrame:
    return M.issue_stats(matched(spark, sf))


def p02_price_cascade(spark, sf):
    return M.with_price(holdings(spark, sf)).groupBy("basis", "yr").agg(F.count(F.lit(1)).alias("n"), R(F.avg("price")).alias("mean_price"), R(F.min("price")).alias("lo"), R(F.max("price")).alias("hi"))


def a01_fund_marks(spark, sf):
    return marks(spark, sf).select(*M.ISSUE, "fund", "lots", R("mark").alias("mark"))


def p03_issue_rows(spark, sf):
    """Every lot's class, comparison price, maturity year and issue."""
    m = matched(spark, sf)
    key = F.when(F.col("hold_class") == "debt", M.issue_id(F.col("issuer"), F.col("sen"), F.col("ibps"), F.col("yr")))
    return m.groupBy("hold_class", "mat_year", key.alias("issue_id")).agg(F.count(F.lit(1)).alias("lots"), F.count("cmp_price").alias("priced"), R(F.sum("cmp_price"), 4).alias("price_sum"))


def a02_issue_dispersion(spark, sf):
    """Issues of usable confidence with at least three holders and three clean marks, by range."""
    wide = stats(spark, sf).filter(F.col("tier").isin("High", "Medium") & (F.col("holders") >= 3) & (F.col("n_clean") >= 3))
    return wide.select(
        *M.ISSUE, "holders", "n_prices", "n_clean", (F.col("n_prices") - F.col("n_clean")).alias("outliers"), "tier", "mat_conflict", "years", R("med").alias("med"),
        R(F.col("hi") - F.col("lo")).alias("range"), R("sd").alias("stdev"), R("raw_lo").alias("raw_lo"), R("raw_hi").alias("raw_hi"),
    ).orderBy(F.desc_nulls_last("range"), *M.ISSUE)


def a04_confidence(spark, sf):
    """How many issues of each date have which confidence."""
    return stats(spark, sf).groupBy("yr", "tier").agg(
        F.count(F.lit(1)).alias("issues"), F.max("holders").alias("most_holders"), F.count_if("mat_conflict").alias("conflicts"), F.count_if(F.col("ibps").isNull()).alias("without_spread")
    )


def a12_issuer_summary(spark, sf):
    """Issuers by date with at least two holders of an issue, over priced issues."""
    width = F.when(F.col("n_clean") >= 2, F.col("hi") - F.col("lo")) * 100
    out = stats(spark, sf).filter("med is not null").groupBy("issuer", "yr").agg(
        F.max("holders").alias("max_holders"), F.count(F.lit(1)).alias("tranches"), R(F.median("med")).alias("median_mark"), R(F.max(width), 4).alias("widest")
    )
    return out.filter("max_holders >= 2").withColumn("dispersed", F.coalesce(F.col("widest") >= 5, F.lit(False)))


def a13_coverage(spark, sf):
    """Match rate of priced debt, issues by holders, and the bands of the range of comparable issues of three holders."""
    m = matched(spark, sf)
    s, r = staged(M.issue_stats(m), "issues"), F.round((F.col("hi") - F.col("lo")) * 100, 6)
    good = F.col("tier").isin("High", "Medium")
    ranged = good & (F.col("holders") >= 3) & (F.col("n_clean") >= 2)
    bands = {"tight": r < 2, "moderate": (r >= 2) & (r < 5), "wide": (r >= 5) & (r < 10), "very_wide": (r >= 10) & (r < 25), "extreme": r >= 25}
    counts = s.agg(
        F.count(F.lit(1)).alias("issues"), F.count_if(good & (F.col("holders") >= 2)).alias("comparable"),
        *[F.count_if(good & (F.col("holders") >= n)).alias(f"holders_{n}") for n in (3, 5, 10)], *[F.count_if(ranged & test).alias(name) for name, test in bands.items()],
    )
    ids = s.filter(good & (F.col("holders") >= 2)).select(*[F.col(c).alias(f"_{c}") for c in M.ISSUE])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in M.ISSUE]
    lots = m.filter("cmp_price is not null").join(ids, same, "left").agg(F.count(F.lit(1)).alias("priced_debt"), F.count("_issuer").alias("matched"))
    both = counts.crossJoin(lots)  # one row each
    return both.withColumn("match_rate", R(100 * F.col("matched") / F.col("priced_debt"), 1))


def j05_stance(spark, sf):
    """Each fund's mark against the issue's median, in points of par."""
    m = matched(spark, sf)
    joined = M.fund_marks(m).alias("f").join(M.issue_stats(m).alias("i"), [F.col(f"f.{c}").eqNullSafe(F.col(f"i.{c}")) for c in M.ISSUE])
    points = F.round((F.col("f.mark") - F.col("i.med")) * 100, 6)
    return joined.filter("i.holders >= 2").withColumn("stance", M.stance(points)).groupBy("f.manager", "stance").agg(F.count(F.lit(1)).alias("n"), R(F.sum(points), 3).alias("points"))


def o05_review_sample(spark, sf):
    """At most six issues of each stratum, picked by a hash so that every run draws the same ones."""
    width = F.when(F.col("n_clean") >= 2, F.round((F.col("hi") - F.col("lo")) * 100, 6))
    band = M.bucket(width, [-1.0, 2.0, 10.0, 9999.0], ["tight", "moderate", "wide"])
    key = F.concat_ws("|", "issuer", F.col("yr").cast("string"), F.coalesce("sen", F.lit("")), F.coalesce(F.col("ibps").cast("string"), F.lit("")))
    s = stats(spark, sf).filter("holders >= 2").withColumn("band", band).filter("band is not null").withColumn("h", F.md5(key.cast("binary")))
    rank = F.row_number().over(Window.partitionBy("tier", "band").orderBy("h"))
    return s.withColumn("pick", rank).filter("pick <= 6").select("tier", "band", "pick", *M.ISSUE, "holders")


def w10_marks_text(spark, sf):
    """The first ten marks of an issue, lowest first, as fund:points."""
    ten = F.slice(F.array_sort(F.collect_list(F.struct(R("mark", 6).alias("mark"), F.col("fund").alias("fund")))), 1, 10)
    label = lambda x: F.concat_ws(":", x["fund"].cast("string"), F.bround(x["mark"] * 100).cast("int").cast("string"))
    return marks(spark, sf).groupBy(*M.ISSUE).agg(F.array_join(F.transform(ten, label), "  ").alias("marks"), F.count(F.lit(1)).alias("holders")).filter("holders >= 3")


QUERIES = {f.__name__: f for f in (p02_price_cascade, p03_issue_rows, a01_fund_marks, a02_issue_dispersion, a04_confidence, a12_issuer_summary, a13_coverage, j05_stance, o05_review_sample, w10_marks_text)}

_W = "WITH " + HOLDINGS_SQL
SQL = {
    "p02_price_cascade": _W + " SELECT basis, yr, count(*) AS n, round(avg(price), 6) AS mean_price, round(min(price), 6) AS lo, round(max(price), 6) AS hi FROM p GROUP BY basis, yr",
    "a01_fund_marks": _W + " SELECT issuer, yr, sen, ibps, fund, lots, round(mark, 6) AS mark FROM fm",
    "p03_issue_rows": _W + """ SELECT cls AS hold_class, CAST(mat AS INTEGER) AS mat_year, CASE WHEN cls = 'debt' THEN concat_ws('|', issuer, coalesce(sen, 'None'), coalesce(CAST(ibps AS VARCHAR), 'nospread'), CAST(yr AS VARCHAR)) END AS issue_id,
 count(*) AS lots, count(cmp) AS priced, round(sum(cmp), 4) AS price_sum FROM (SELECT * FROM m UNION ALL BY NAME SELECT *, NULL AS ibps FROM cl WHERE cls <> 'debt') GROUP BY ALL""",
    "a02_issue_dispersion": _W + """ SELECT issuer, yr, sen, ibps, holders, n_prices, n_clean, n_prices - n_clean AS outliers, tier, conflict AS mat_conflict, years, round(med, 6) AS med,
 round(hi - lo, 6) AS range, round(sd, 6) AS stdev, round(raw_lo, 6) AS raw_lo, round(raw_hi, 6) AS raw_hi FROM iss WHERE tier IN ('High', 'Medium') AND holders >= 3 AND n_clean >= 3""",
    "a04_confidence": _W + " SELECT yr, tier, count(*) AS issues, max(holders) AS most_holders, count(*) FILTER (conflict) AS conflicts, count(*) FILTER (ibps IS NULL) AS without_spread FROM iss GROUP BY ALL",
    "a12_issuer_summary": _W + """ SELECT *, coalesce(widest >= 5, false) AS dispersed FROM (SELECT issuer, yr, max(holders) AS max_holders, count(*) AS tranches, round(median(med), 6) AS median_mark, round(max(CASE WHEN n_clean >= 2 THEN hi - lo END * 100), 4) AS widest
 FROM iss WHERE med IS NOT NULL GROUP BY issuer, yr) WHERE max_holders >= 2""",
    "a13_coverage": _W + """, g AS (SELECT *, round((hi - lo) * 100, 6) AS r, tier IN ('High', 'Medium') AS good FROM iss),
 c AS (SELECT count(*) AS issues, count(*) FILTER (good AND holders >= 2) AS comparable, count(*) FILTER (good AND holders >= 3) AS holders_3, count(*) FILTER (good AND holders >= 5) AS holders_5, count(*) FILTER (good AND holders >= 10) AS holders_10,
 count(*) FILTER (good AND holders >= 3 AND n_clean >= 2 AND r < 2) AS tight, count(*) FILTER (good AND holders >= 3 AND n_clean >= 2 AND r >= 2 AND r < 5) AS moderate, count(*) FILTER (good AND holders >= 3 AND n_clean >= 2 AND r >= 5 AND r < 10) AS wide,
 count(*) FILTER (good AND holders >= 3 AND n_clean >= 2 AND r >= 10 AND r < 25) AS very_wide, count(*) FILTER (good AND holders >= 3 AND n_clean >= 2 AND r >= 25) AS extreme FROM g),
 l AS (SELECT count(*) AS priced_debt, count(g.issuer) AS matched FROM (SELECT * FROM m WHERE cmp IS NOT NULL) x LEFT JOIN (SELECT * FROM g WHERE good AND holders >= 2) g ON x.issuer = g.issuer AND x.yr = g.yr AND x.sen IS NOT DISTINCT FROM g.sen AND x.ibps IS NOT DISTINCT FROM g.ibps)
 SELECT c.*, l.*, round(100 * matched / priced_debt, 1) AS match_rate FROM c, l""",
    "j05_stance": _W + """ SELECT manager, CASE WHEN pts <= -1 THEN 'Cheap' WHEN pts <= 1 THEN 'In line' ELSE 'Rich' END AS stance, count(*) AS n, round(sum(pts), 3) AS points
 FROM (SELECT manager, mark, round((mark - med) * 100, 6) AS pts, count(*) OVER (PARTITION BY issuer, yr, sen, ibps) AS holders FROM im) WHERE holders >= 2 AND mark IS NOT NULL GROUP BY ALL""",
    "o05_review_sample": _W + """ SELECT tier, band, pick, issuer, yr, sen, ibps, holders FROM (SELECT *, CAST(row_number() OVER (PARTITION BY tier, band ORDER BY md5(concat_ws('|', issuer, CAST(yr AS VARCHAR), coalesce(sen, ''), coalesce(CAST(ibps AS VARCHAR), '')))) AS INTEGER) AS pick
 FROM (SELECT *, CASE WHEN r <= 2 THEN 'tight' WHEN r <= 10 THEN 'moderate' WHEN r <= 9999 THEN 'wide' END AS band FROM (SELECT *, CASE WHEN n_clean >= 2 THEN round((hi - lo) * 100, 6) END AS r FROM iss WHERE holders >= 2)) WHERE band IS NOT NULL) WHERE pick <= 6""",
    "w10_marks_text": _W + """ SELECT issuer, yr, sen, ibps, array_to_string(list_slice(list(fund || ':' || CAST(CAST(round_even(mark * 100, 0) AS INTEGER) AS VARCHAR) ORDER BY mark, fund), 1, 10), '  ') AS marks, count(*) AS holders
 FROM (SELECT issuer, yr, sen, ibps, fund, round(mark, 6) AS mark FROM fm) GROUP BY ALL HAVING count(*) >= 3""",
}

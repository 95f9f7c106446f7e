"""Return chains, samples and tables for review, scalars on numbers and names, each with its SQL.

Surrogates: a fund's mean price a year as its year-to-date figure; a customer's nation as its family; pages as located reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as X
from ..functions.numbers import rounded as R
from ..operators import bias as B
from ..operators import facts as T
from ..operators import reports, returns
from ..operators import survival as S
from ..operators import universe as U
from ..operators.marks import ISSUE, with_price
from ..sources.tables import HOLDINGS_SQL, holdings, table
from .studies import _C, _W, deviations, entities

YEARS = tuple(range(1995, 2002))


def a25_window_returns(spark, sf):
    """Funds report every year but each seventh; each second year is a fiscal year end."""
    by = with_price(holdings(spark, sf)).groupBy("fund", F.col("yr").alias("date")).agg((R(F.avg("price"), 6) - 0.9).alias("ytd")).filter("(fund + date) % 7 <> 0")
    form = F.when((F.col("fund") + F.col("date")) % 2 == 0, "10-K").otherwise("10-Q")
    return returns.window_returns(by.withColumn("form_type", form), 1996, 2000).select("fund", R("window_return").alias("window_return"), "reason")


def a33_by_date(spark, sf):
    return B.by_date(deviations(spark, sf), list(YEARS)).select("manager", *[R(F.col(f"`{y}`"), 4).alias(f"y{y}") for y in YEARS])


def o06_issue_sample(spark, sf):
    return B.issue_sample(deviations(spark, sf)).select(*ISSUE, R("consensus", 4).alias("consensus"), "marks")


def a36_lifespan(spark, sf):
    return S.lifespan(entities(spark, sf)).select("n", *[R(c, 4).alias(c) for c in ("median", "mean", "shortest", "longest")])


def a38_family_table(spark, sf):
    nation = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("family"))
    kind = F.when((F.col("status") == "dead") & (F.col("key") % 3 == 0), "merger")
    return S.family_table(entities(spark, sf).join(nation, "key").withColumn("mechanism", kind))


def a46_manager_audit(spark, sf):
    """Suppliers' nations as managers; each thirteenth supplier is not on the map."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("cik"), F.concat(F.lit("M"), F.col("s_nationkey").cast("string")).alias("manager"))
    return U.manager_audit(U.with_manager(s.select("cik"), s.filter("cik % 13 <> 0")))


def e17_calculated(spark, sf):
    """Orders as records: levels by return flag, the lines as holdings."""
    li, price = table(spark, sf, "lineitem"), F.col("l_extendedprice")
    at = lambda flag: F.sum(F.when(F.col("l_returnflag") == flag, price))
    levels = li.groupBy("l_orderkey").agg(at("A").alias("level_1"), at("N").alias("level_2"), at("R").alias("level_3"), F.sum(price).alias("fv_total"), F.max("l_tax").alias("yield"), F.min("l_discount").alias("weighted_avg_interest_rate"))
    record = levels.join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_totalprice").alias("investments_at_fair_value")), "l_orderkey")
    out = T.calculated(record, li.select("l_orderkey", price.alias("fair_value")), ["l_orderkey"], ("level_1", "level_2", "level_3"))
    return out.select("l_orderkey", *[R(c).alias(c) for c in ("level_1_pct", "level_2_pct", "level_3_pct", "net_spread", "holdings_over_tagged")])


def m12_cost(spark, sf):
    pages = table(spark, sf, "pages")
    located = pages.select(F.col("page_id").alias("period"), F.ceil(F.length("html") / 4).alias("tokens"), (F.col("html").isNotNull() & (F.length("html") >= 100)).alias("located"))
    return reports.cost(located, 1.0, 5.0, 1500, 3000).select("periods", R("tokens_in", 4).alias("tokens_in"), R("cost").alias("cost"))


def f02_names_and_dates(spark, sf):
    s = table(spark, sf, "supplier")
    day, name, k = F.date_add(F.lit("2024-01-31").cast("date"), F.col("s_suppkey").cast("int")), F.col("s_name"), F.col("s_suppkey") % 4
    other = F.when(k == 0, F.concat(F.lit("The "), name, F.lit(", Inc."))).when(k == 1, F.lit("another")).when(k == 2, F.lit("-")).otherwise(F.upper(name))
    return s.select(
        "s_suppkey", X.period_start(day, (F.col("s_suppkey") % 14).cast("int")).alias("start"), R(X.years_between(F.lit("2020-02-29").cast("date"), day), 4).alias("years"), X.known_text(other).alias("known"),
        X.names_agree(name, other).alias("agree"), X.filing_url(X.key10(F.col("s_suppkey").cast("string")), F.lit("0001-24-000007"), "https://example.org").alias("url"),
    )


def f03_numbers(spark, sf):
    li = table(spark, sf, "lineitem")
    price, tax, discount, line = (F.col(c) for c in ("l_extendedprice", "l_tax", "l_discount", "l_linenumber"))
    split = N.larger_split(F.when(line != 3, discount), F.when(line != 4, tax), F.when(line % 2 == 0, tax))
    return li.select(
        "l_orderkey", "l_linenumber", R(split, 4).alias("total"), N.close(price, price * (1 + tax / 5)).alias("near"), N.plausible_rate(tax).alias("rate"), N.spread_label(F.when(line != 2, line * 25)).alias("label"),
        N.flags({"low_tax": tax < 0.02, "wide": discount > 0.08, "first": line == 1}).alias("flags"), N.looks_rounded(line * 500.0).alias("thousands"),
    )


QUERIES = {
    f.__name__: f
    for f in (a25_window_returns, a33_by_date, o06_issue_sample, a36_lifespan, a38_family_table, a46_manager_audit, e17_calculated, m12_cost, f02_names_and_dates, f03_numbers)
}

SQL = {
    "a25_window_returns": "WITH " + HOLDINGS_SQL + """, y AS (SELECT fund, yr AS d, round(avg(price), 6) - 0.9 AS ytd, (fund + yr) % 2 = 0 AS fye FROM p WHERE (fund + yr) % 7 <> 0 GROUP BY fund, yr),
 a AS (SELECT fund, max(ytd) FILTER (d = 1996) AS s, coalesce(bool_or(fye) FILTER (d = 1996), false) AS opens, max(ytd) FILTER (d = 2000) AS e, coalesce(product(1 + ytd) FILTER (fye AND d > 1996 AND d < 2000), 1) AS chain,
 min(d) FILTER (fye AND d > 1996 AND d < 2000 AND ytd IS NULL) AS gap FROM y GROUP BY fund),
 r AS (SELECT *, CASE WHEN s IS NULL THEN 'no YTD at window start' WHEN e IS NULL THEN 'no YTD at window end' WHEN gap IS NOT NULL THEN 'no YTD at fiscal year end ' || gap ELSE '' END AS reason FROM a)
 SELECT fund, round(CASE WHEN reason = '' THEN chain / (1 + CASE WHEN opens THEN 0 ELSE s END) * (1 + e) - 1 END, 6) AS window_return, reason FROM r""",
    "a33_by_date": _W + " SELECT manager, " + ", ".join(f"round(median(dev) FILTER (yr = {y}), 4) AS y{y}" for y in YEARS) + " FROM dv GROUP BY manager",
    "o06_issue_sample": _W + """, big AS (SELECT *, md5(concat_ws('|', issuer, CAST(yr AS VARCHAR), coalesce(sen, ''), coalesce(CAST(ibps AS VARCHAR), ''))) AS pick FROM dv WHERE k >= 4)
 SELECT issuer, yr, sen, ibps, round(median(mark) * 100, 4) AS consensus, string_agg(manager || ':' || CAST(round_even(mark * 100, 0) AS BIGINT), '  ' ORDER BY mark, manager) AS marks
 FROM big WHERE pick IN (SELECT DISTINCT pick FROM big ORDER BY pick LIMIT 40) GROUP BY ALL""",
    "a36_lifespan": _C + " SELECT count(*) AS n, round(median(years), 4) AS median, round(avg(years), 4) AS mean, round(min(years), 4) AS shortest, round(max(years), 4) AS longest FROM c WHERE status = 'dead' AND born IS NOT NULL",
    "a38_family_table": _C + """ SELECT c_nationkey AS family, count(*) AS launched, count(*) FILTER (status = 'active') AS alive, count(*) FILTER (status = 'dead') AS dead, count(*) FILTER (status = 'dead' AND key % 3 = 0) AS mergers,
 round(count(*) FILTER (status = 'active') / count(*), 3) AS survival FROM c JOIN customer ON c_custkey = key GROUP BY 1""",
    "a46_manager_audit": """SELECT manager, count(*) AS funds, count(*) >= 2 AS several, manager = 'UNMAPPED' AS unmapped FROM (SELECT DISTINCT s_suppkey, CASE WHEN s_suppkey % 13 = 0 THEN 'UNMAPPED' ELSE 'M' || s_nationkey END AS manager FROM supplier) GROUP BY 1""",
    "e17_calculated": """WITH l AS (SELECT l_orderkey, sum(l_extendedprice) FILTER (l_returnflag = 'A') AS l1, sum(l_extendedprice) FILTER (l_returnflag = 'N') AS l2, sum(l_extendedprice) FILTER (l_returnflag = 'R') AS l3, sum(l_extendedprice) AS t, max(l_tax) AS y, min(l_discount) AS d FROM lineitem GROUP BY 1)
 SELECT l_orderkey, round(l1 / t, 6) AS level_1_pct, round(l2 / t, 6) AS level_2_pct, round(l3 / t, 6) AS level_3_pct, round(y - d, 6) AS net_spread, round(t / o_totalprice, 6) AS holdings_over_tagged FROM l JOIN orders ON o_orderkey = l_orderkey""",
    "m12_cost": """SELECT count(*) AS periods, round(coalesce(avg(tokens), 0) + 1500, 4) AS tokens_in, round(count(*) * ((coalesce(avg(tokens), 0) + 1500) / 1e6 * 1.0 + 3000 / 1e6 * 5.0), 6) AS cost
 FROM (SELECT page_id, max(ceil(length(html) / 4)) AS tokens FROM pages WHERE length(html) >= 100 GROUP BY page_id)""",
    "f02_names_and_dates": """WITH s AS (SELECT *, DATE '2024-01-31' + CAST(s_suppkey AS INTEGER) AS day, CAST(s_suppkey % 14 AS INTEGER) AS months, CASE s_suppkey % 4 WHEN 0 THEN 'The ' || s_name || ', Inc.' WHEN 1 THEN 'another' WHEN 2 THEN '-' ELSE upper(s_name) END AS other FROM supplier),
 k AS (SELECT *, regexp_replace(lower(s_name), '[^a-z0-9]', '', 'g') AS x, regexp_replace(lower(other), '[^a-z0-9]', '', 'g') AS y FROM s)
 SELECT s_suppkey, CAST(CASE WHEN months <> 0 THEN date_trunc('month', day) - to_months(months - 1) END AS DATE) AS start, round(date_diff('day', DATE '2020-02-29', day) / 365.25, 4) AS years, CASE WHEN other = '-' THEN '' ELSE trim(other) END AS known,
 CASE WHEN x <> '' AND y <> '' THEN contains(x, y) OR contains(y, x) END AS agree, CASE WHEN s_suppkey = 0 THEN '' ELSE 'https://example.org/' || s_suppkey || '/000124000007/0001-24-000007-index.htm' END AS url FROM k""",
    "f03_numbers": """WITH l AS (SELECT *, CASE WHEN l_linenumber <> 3 THEN l_discount END AS total0, CASE WHEN l_linenumber <> 4 THEN l_tax END AS c, CASE WHEN l_linenumber % 2 = 0 THEN l_tax END AS d, l_extendedprice * (1 + l_tax / 5) AS other FROM lineitem)
 SELECT l_orderkey, l_linenumber, round(CASE WHEN (c IS NOT NULL OR d IS NOT NULL) AND (total0 IS NULL OR coalesce(c, 0) + coalesce(d, 0) > total0) THEN coalesce(c, 0) + coalesce(d, 0) ELSE total0 END, 4) AS total,
 CASE WHEN greatest(l_extendedprice, other) = 0 THEN true ELSE abs(l_extendedprice - other) / greatest(l_extendedprice, other) <= 0.01 END AS near, CASE WHEN l_tax > 0 AND l_tax < 1 THEN l_tax END AS rate,
 CASE WHEN l_linenumber = 2 THEN '—' ELSE 'S+' || CAST(l_linenumber * 25 AS INTEGER) END AS label, concat_ws('; ', CASE WHEN l_tax < 0.02 THEN 'low_tax' END, CASE WHEN l_discount > 0.08 THEN 'wide' END, CASE WHEN l_linenumber = 1 THEN 'first' END) AS flags,
 l_linenumber * 500 >= 1000 AND l_linenumber % 2 = 0 AS thousands FROM l""",
}

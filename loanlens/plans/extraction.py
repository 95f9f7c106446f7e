"""Queries over issuer strings, tagged facts, the universe and incremental runs, each with its SQL.

Surrogates: a part's name inside the shapes of issuer strings; line items as holdings tagged on an order's filing; orders as
filings of a customer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import rounded as R
from ..functions import text as X
from ..operators import bias as B
from ..operators import facts as T
from ..operators import graph, issuers
from ..operators import universe as U
from ..sources.tables import table
from .studies import _C, _W, deviations, entities



def issuer_strings(spark, sf):
    name, k = F.col("p_name"), F.col("p_partkey") % 6
    return table(spark, sf, "part").select(
        "p_partkey",
        F.when(k == 0, F.concat(name, F.lit(", LLC, Retail, First Lien Term Loan"))).when(k == 1, F.concat(F.lit("Debt Investments 12.5% United States "), name, F.lit(" Investment Type Second Lien Maturity Date 2027")))
        .when(k == 2, F.concat(name, F.lit(" — Revolver 2"))).when(k == 3, F.concat(F.lit("Health Care Equipment & Services "), name, F.lit(", Inc. - Delayed Draw Loan")))
        .when(k == 4, F.concat(F.lit("Total "), name)).otherwise(F.concat(name, F.lit(" (d/b/a x)"))).alias("issuer"),
    )


def x06_parse_issuer(spark, sf):
    return issuers.parse(issuer_strings(spark, sf)).select("p_partkey", "issuer_name", "instrument_text", "parse_ok", "issuer_norm", "seniority", "instrument_type")


def x08_core_pairs(spark, sf):
    """Similar part names; the score is Python, so tests hold it against brute force."""
    cores = issuers.parse(issuer_strings(spark, sf)).filter("parse_ok").select(issuers.core(F.col("issuer_norm")).alias("core")).distinct()
    return issuers.core_pairs(cores, 75.0).select("a", "b", R("score", 4).alias("score"))


def x09_components(spark, sf):
    """Chains of customers: ten apart, broken at every seventh."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("a"))
    return graph.components(c.filter("a % 7 <> 0").select("a", (F.col("a") + 10).alias("b")))


def x10_clusters(spark, sf):
    names = issuers.parse(issuer_strings(spark, sf)).filter("parse_ok").groupBy(F.col("issuer_norm").alias("norm")).agg(F.count(F.lit(1)).alias("rows"))
    return issuers.clusters(names, 75.0)


def tagged(spark, sf):
    """Each line as two facts of a holding: fair value and spread. Line numbers repeat within an order, so rows of equal number
    are told apart by their tax."""
    li = table(spark, sf, "lineitem")
    scale = F.when(F.col("l_linenumber") == 5, 1000).otherwise(1)
    member = F.concat(F.lit("Issuer "), (F.col("l_partkey") % 50).cast("string"), F.when(F.col("l_returnflag") == "R", F.lit(" | Affiliated Issuer")).otherwise(F.lit(" | Non-Affiliated Issuer")))
    no = lambda t: F.lit(None).cast(t)
    pair = F.explode(F.array(F.struct(F.lit(T.LEVEL_CONCEPTS[0]).alias("concept"), (F.col("l_extendedprice") * scale).alias("numeric_value")), F.struct(F.lit("us-gaap:InvestmentBasisSpreadVariableRate").alias("concept"), F.col("l_tax").alias("numeric_value"))))
    rows = li.select(F.col("l_orderkey").cast("string").alias("accession_no"), (F.col("l_linenumber") * 100 + F.round(F.col("l_tax") * 100)).cast("int").alias("row_no"), member.alias("m"), F.when(F.col("l_linenumber") == 5, "-3").otherwise("0").alias("decimals"), pair.alias("f"))
    return rows.select(
        "accession_no", "row_no", "f.concept", F.lit("L").alias("label"), F.lit("instant").alias("period_type"), F.lit("2000-01-01").cast("date").alias("period_instant"), no("date").alias("period_start"),
        no("date").alias("period_end"), "f.numeric_value", no("string").alias("value"), "decimals", F.create_map(F.lit(T.HOLDING_AXIS), F.col("m")).alias("dims"),
    )


def tagged_filings(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("accession_no"), F.lit("2000-01-01").cast("date").alias("reporting_date"), F.lit(12).alias("target_months"))


def tagged_totals(spark, sf):
    """An order's total of its clean lines, every third one off by a fifth."""
    li = table(spark, sf, "lineitem").filter("l_linenumber <> 5").groupBy(F.col("l_orderkey").cast("string").alias("accession_no")).agg(F.sum("l_extendedprice").alias("s"), F.any_value("l_orderkey").alias("k"))
    return li.select("accession_no", (F.col("s") * F.when(F.col("k") % 3 == 0, 1.2).otherwise(1.0)).alias("total"))


def e10_schedule(spark, sf):
    rows = T.schedule(tagged(spark, sf), tagged_filings(spark, sf))
    return rows.select("accession_no", "issuer", "affiliation", R("fair_value", 2).alias("fair_value"), "spread", "decimals")


def one_scale(spark, sf):
    return T.one_scale(T.schedule(tagged(spark, sf), tagged_filings(spark, sf)), tagged_totals(spark, sf))


def e11_one_scale(spark, sf):
    return one_scale(spark, sf).groupBy("accession_no").agg(F.count(F.lit(1)).alias("holdings"), R(F.sum("fair_value"), 2).alias("held"))


def a43_schedule_summary(spark, sf):
    out = T.summary(one_scale(spark, sf), tagged_totals(spark, sf))
    return out.select("accession_no", "num_holdings", *[R(c).alias(c) for c in ("top_10", "pct_affiliated", "mean_spread")])


def m02_sign_counts(spark, sf):
    return B.sign_counts(deviations(spark, sf).withColumn("dev", R("dev")))


def m05_significance(spark, sf):
    """Interval, corrected p and the robust flag; the tests hold it against direct computation."""
    return B.significant(deviations(spark, sf))


def filings(spark, sf):
    form = F.when(F.col("o_orderpriority").startswith("1"), "10-K").when(F.col("o_orderpriority").startswith("2"), "10-Q").otherwise("N-CSR")
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("cik"), form.alias("form"), F.col("o_orderdate").cast("date").alias("filing_date"), (F.col("o_orderkey") % 3 == 0).alias("inline"), (F.col("o_orderkey") % 2 == 0).alias("tagged"), "o_orderkey")


def a41_footprint(spark, sf):
    return U.footprint(filings(spark, sf))


def o10_latest_filing(spark, sf):
    """The date of each customer's latest 10-K, else of its latest filing."""
    return U.latest_filing(filings(spark, sf), "10-K").select("cik", "form", "filing_date")


def a40_sizing(spark, sf):
    c = entities(spark, sf)
    return U.sizing(c.filter("born is not null"), c.filter("died is not null"))


def a39_five_years(spark, sf):
    return U.five_years(entities(spark, sf).filter("born is not null"), "born")


def a37_cross_tab(spark, sf):
    return U.cross_tab(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


def f01_scalars(spark, sf):
    """Keys, names, printed numbers and dates on supplier rows."""
    s = table(spark, sf, "supplier")
    return s.select(
        "s_suppkey", X.key10(F.concat(F.col("s_suppkey").cast("string"), F.lit(".0"))).alias("cik"), X.name_norm(F.concat("s_name", F.lit(", L.L.C. (old)"))).alias("norm"),
        R(X.printed_number(F.concat(F.lit("($"), F.format_number(F.col("s_suppkey") * 1234, 0), F.lit(")")), 3), 2).alias("amount"), X.printed_date(F.lit("Sept 30, 2025")).alias("day"),
    )


QUERIES = {
    f.__name__: f
    for f in (x06_parse_issuer, x08_core_pairs, x09_components, x10_clusters, e10_schedule, e11_one_scale, a43_schedule_summary, m02_sign_counts, m05_significance, a41_footprint, o10_latest_filing, a40_sizing, a39_five_years, a37_cross_tab, f01_scalars)
}

_H = """WITH h AS (SELECT CAST(l_orderkey AS VARCHAR) AS accession_no, 'Issuer ' || (l_partkey % 50) AS issuer, CASE WHEN l_returnflag = 'R' THEN 'Affiliated Issuer' ELSE 'Non-Affiliated Issuer' END AS affiliation,
 sum(l_extendedprice * CASE WHEN l_linenumber = 5 THEN 1000 ELSE 1 END) AS fair_value, arg_min(l_tax, l_linenumber * 100 + round(l_tax * 100)) AS spread, arg_min(CASE WHEN l_linenumber = 5 THEN '-3' ELSE '0' END, l_linenumber) AS decimals FROM lineitem GROUP BY 1, 2, 3),
t AS (SELECT CAST(l_orderkey AS VARCHAR) AS accession_no, sum(l_extendedprice) * CASE WHEN l_orderkey % 3 = 0 THEN 1.2 ELSE 1.0 END AS total FROM lineitem WHERE l_linenumber <> 5 GROUP BY l_orderkey),
g AS (SELECT accession_no, decimals, sum(fair_value) AS fv, count(*) AS n FROM h GROUP BY ALL),
w AS (SELECT g.*, total, sum(fv) OVER p AS afv, sum(n) OVER p AS an, count(*) OVER p AS k FROM g JOIN t USING (accession_no) WHERE total > 0 WINDOW p AS (PARTITION BY accession_no)),
d AS (SELECT accession_no, min(decimals) AS dropped FROM w WHERE afv > 0 AND abs(afv / total - 1) > 0.05 AND k >= 2 AND n < an - n AND abs((afv - fv) / total - 1) <= 0.05 GROUP BY 1),
o AS (SELECT h.* FROM h LEFT JOIN d USING (accession_no) WHERE dropped IS NULL OR decimals <> dropped)"""
_F = """WITH f AS (SELECT o_custkey AS cik, CASE WHEN o_orderpriority LIKE '1%' THEN '10-K' WHEN o_orderpriority LIKE '2%' THEN '10-Q' ELSE 'N-CSR' END AS form, CAST(o_orderdate AS DATE) AS filing_date, o_orderkey % 3 = 0 AS inl, o_orderkey % 2 = 0 AS tagged FROM orders)"""
SQL = {
    # the parts of a composed string are known, so this says what a parser must find
    "x06_parse_issuer": """SELECT p_partkey, CASE k WHEN 0 THEN p_name || ', LLC' WHEN 3 THEN p_name || ', Inc.' WHEN 4 THEN NULL WHEN 5 THEN p_name || ' (d/b/a x)' ELSE p_name END AS issuer_name,
 CASE k WHEN 0 THEN 'Retail, First Lien Term Loan' WHEN 1 THEN 'Investment Type Second Lien Maturity Date 2027' WHEN 2 THEN 'Revolver' WHEN 3 THEN 'Delayed Draw Loan' END AS instrument_text, k <> 4 AS parse_ok, CASE WHEN k <> 4 THEN p_name END AS issuer_norm,
 CASE k WHEN 0 THEN 'First Lien' WHEN 1 THEN 'Second Lien' END AS seniority, CASE k WHEN 0 THEN 'Term Loan' WHEN 2 THEN 'Revolver' WHEN 3 THEN 'Delayed Draw Term Loan' END AS instrument_type FROM (SELECT *, p_partkey % 6 AS k FROM part)""",
    "x09_components": """WITH RECURSIVE e AS (SELECT c_custkey AS a, c_custkey + 10 AS b FROM customer WHERE c_custkey % 7 <> 0), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
 r AS (SELECT a AS node, a AS seen FROM u UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.seen) SELECT node, min(seen) AS component FROM r GROUP BY node""",
    "e10_schedule": _H + " SELECT accession_no, issuer, affiliation, round(fair_value, 2) AS fair_value, spread, decimals FROM h",
    "e11_one_scale": _H + " SELECT accession_no, count(*) AS holdings, round(sum(fair_value), 2) AS held FROM o GROUP BY 1",
    "a43_schedule_summary": _H + """, r AS (SELECT *, row_number() OVER (PARTITION BY accession_no ORDER BY fair_value DESC, issuer || ' | ' || affiliation) AS rn FROM o),
 s AS (SELECT accession_no, sum(fair_value) AS held, CAST(count(*) AS DOUBLE) AS n, sum(fair_value) FILTER (rn <= 10) AS top, coalesce(sum(fair_value) FILTER (affiliation = 'Affiliated Issuer'), 0) AS aff,
  sum(fair_value * spread) FILTER (spread > 0 AND spread < 1) AS fs, sum(fair_value) FILTER (spread > 0 AND spread < 1) AS f FROM r GROUP BY 1), q AS (SELECT s.*, held / total AS c FROM s LEFT JOIN t USING (accession_no))
 SELECT accession_no, CASE WHEN ok THEN n END AS num_holdings, CASE WHEN ok THEN round(top / held, 6) END AS top_10, CASE WHEN ok THEN round(aff / held, 6) END AS pct_affiliated, CASE WHEN ok THEN round(fs / f, 6) END AS mean_spread
 FROM (SELECT *, NOT coalesce(c >= 1.25 OR c < 0.7, false) AS ok FROM q)""",
    "m02_sign_counts": _W + " SELECT manager, count(*) FILTER (round(dev, 6) > 0.01) AS above, count(*) FILTER (round(dev, 6) < -0.01) AS below FROM dv GROUP BY 1",
    "a41_footprint": _F + """ SELECT cik, count(*) FILTER (form = '10-K') AS n_10k, count(*) FILTER (form = '10-Q') AS n_10q, count(*) AS n_total, count(*) FILTER (inl) AS n_inline, count(*) FILTER (tagged) AS n_tagged,
 CAST(min(year(filing_date)) FILTER (inl) AS INTEGER) AS first_inline_year, max(filing_date) AS last_date, bool_or(inl) AS extractable, coalesce(string_agg(DISTINCT form, ',' ORDER BY form) FILTER (inl), '') AS inline_forms FROM f GROUP BY 1""",
    "o10_latest_filing": _F + " SELECT cik, form, filing_date FROM (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY (form = '10-K') DESC, filing_date DESC, form) AS rn FROM f) WHERE rn = 1",
    "a40_sizing": _C + """ SELECT count(born) AS born, count(died) AS ended, count(*) FILTER (born IS NOT NULL AND died IS NOT NULL) AS "both", count(*) FILTER (died IS NULL) AS born_only, count(*) FILTER (born IS NULL) AS ended_only FROM c""",
    "a39_five_years": _C + " SELECT CAST(floor(year(born) / 5) * 5 AS INTEGER) AS bin, count(*) AS n FROM c WHERE born IS NOT NULL GROUP BY 1",
    "a37_cross_tab": """SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'O') AS "O", count(*) FILTER (o_orderstatus = 'P') AS "P", count(*) AS total FROM orders GROUP BY 1""",
    "f01_scalars": """SELECT s_suppkey, lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS cik, trim(regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g')) AS norm, CAST(-s_suppkey * 1234000 AS DOUBLE) AS amount, DATE '2025-09-30' AS day FROM supplier""",
}

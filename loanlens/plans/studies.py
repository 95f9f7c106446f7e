"""Bias, survival, validation, facts, text and incremental queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.numbers import rounded as R
from ..functions import text as X
from ..operators import bias as B
from ..operators import rules as V
from ..operators import survival as S
from ..operators.marks import ISSUE
from ..sources.tables import HOLDINGS_SQL, table
from .marks import marks

TODAY = "2001-06-30"
DISTRESSED = 0.9455


def deviations(spark, sf):
    return B.deviations(marks(spark, sf))


def w02_leave_one_out(spark, sf):
    return deviations(spark, sf).select(*ISSUE, "manager", "k", R("dev").alias("dev"))


def a32_manager_stats(spark, sf):
    """The surrogate marks span 0.9 to 1, so distress begins higher."""
    stats = B.manager_stats(deviations(spark, sf), distressed=DISTRESSED)
    return stats.select("manager", "n", "dates", *[R(c, 5).alias(c) for c in ("median", "mean", "rich", "in_line", "cheap", "median_sound")])


def m04_clustered_ols(spark, sf):
    return B.clustered_ols(deviations(spark, sf)).select("manager", "n", R("coef").alias("coef"), R("se").alias("se"))


def entities(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderdate").cast("date").alias("date"), F.col("o_orderpriority").alias("name"))
    born, ended = o.filter("key % 11 <> 0"), o.groupBy("key").agg(F.max("date").alias("date"), F.lit("last").alias("name")).filter("date < date'2001-01-01'")
    return S.census(born.groupBy("key").agg(F.min("date").alias("date"), F.lit("first").alias("name")), ended, TODAY)


def j10_census(spark, sf):
    return entities(spark, sf).select("key", "name", "born", "died", "status", R("years", 4).alias("years"), "left_censored")


def a34_yearly(spark, sf):
    return S.yearly(entities(spark, sf), 1995, 2001).withColumn("churn", R("churn", 4))


def a35_hazard(spark, sf):
    return S.hazard(entities(spark, sf)).select("deaths", R("entity_years", 3).alias("entity_years"), R("hazard").alias("hazard"))


def m03_kaplan_meier(spark, sf):
    return S.kaplan_meier(entities(spark, sf)).select("t", "deaths", "at_risk", R("survival").alias("survival"))


def v01_order_rules(spark, sf):
    """Order totals against the sum of their lines."""
    li = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("lines"), F.sum("l_quantity").alias("quantity"))
    o = table(spark, sf, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    total, lines = F.col("o_totalprice"), F.col("lines")
    checks = [V.check("C1", F.abs(total - lines) <= V.tolerance(total, 0.05), [total, lines]), V.check("A1", total > 0, [total]), V.check("I2", F.col("quantity") <= 150, [F.col("quantity")])]
    return V.validated(o, checks).select("o_orderkey", "status", F.array_join(F.transform("checks", lambda c: F.concat_ws(":", c["rule"], c["status"])), " ").alias("checks"))


def e01_latest_instant(spark, sf):
    """Per entity: the latest value of the first concept present, in the order purchase, click, view."""
    e = table(spark, sf, "events")
    best = F.min_by(F.struct("event_type", "value"), F.struct("priority", -F.unix_micros(F.col("ts").cast("timestamp")), F.col("event_id")))
    rank = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "click", 2).when(F.col("event_type") == "view", 3)
    return e.withColumn("priority", rank).filter("priority is not null").groupBy("user_id").agg(best.alias("b")).select("user_id", F.col("b.event_type").alias("concept"), R("b.value", 4).alias("value"))


def x07_core_merge(spark, sf):
    """Part names merged by core key; the canonical name has the fewest words, then the most rows, then comes first."""
    names = table(spark, sf, "part").groupBy(X.name_norm(F.col("p_name")).alias("norm")).agg(F.count(F.lit(1)).alias("rows")).withColumn("core", X.core_key(F.col("norm")))
    key = F.struct(F.size(F.split("norm", " ")), -F.col("rows"), F.col("norm"))
    return names.groupBy("core").agg(F.min_by("norm", key).alias("canonical"), F.count(F.lit(1)).alias("names"), F.sum("rows").alias("rows"))


def t01_new_rows(spark, sf):
    """What an additive run would still do: orders of the last year whose customer was not handled before."""
    o = table(spark, sf, "orders")
    done = o.filter("year(o_orderdate) < 2000").select("o_custkey").distinct()
    return o.filter("year(o_orderdate) >= 2000").join(done, "o_custkey", "left_anti").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"))


def t02_since(spark, sf):
    """Orders on or after each customer's last check (every third has one; the others start at a default)."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("d"))
    state = o.filter("o_custkey % 3 = 0").groupBy("o_custkey").agg(F.max("d").alias("last_checked"))
    return o.join(state, "o_custkey", "left").filter(F.col("d") >= F.coalesce("last_checked", F.lit("2000-01-01").cast("date"))).select("o_orderkey", "o_custkey", "d")


def w08_running_share(spark, sf):
    own = table(spark, sf, "orders").groupBy("o_orderpriority", F.year("o_orderdate").alias("yr")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("o_orderpriority").orderBy("yr")
    return own.withColumn("running", F.sum("n").over(w)).withColumn("before", F.lag("n").over(w))


QUERIES = {f.__name__: f for f in (w02_leave_one_out, a32_manager_stats, m04_clustered_ols, j10_census, a34_yearly, a35_hazard, m03_kaplan_meier, v01_order_rules, e01_latest_instant, x07_core_merge, t01_new_rows, t02_since, w08_running_share)}

_W = "WITH " + HOLDINGS_SQL + """, mm AS (SELECT issuer, yr, sen, ibps, manager, median(mark) AS mark FROM fm GROUP BY ALL),
ml AS (SELECT *, count(*) OVER w AS k, row_number() OVER (PARTITION BY issuer, yr, sen, ibps ORDER BY mark, manager) AS rn, list(mark) OVER w AS marks FROM mm WINDOW w AS (PARTITION BY issuer, yr, sen, ibps)),
dv AS (SELECT issuer, yr, sen, ibps, manager, k, mark, list_median(marks) AS consensus, (mark - list_median(list_concat(list_slice(list_sort(marks), 1, rn - 1), list_slice(list_sort(marks), rn + 1, k)))) * 100 AS dev FROM ml WHERE k >= 3)"""
_C = """WITH o AS (SELECT o_custkey AS key, CAST(o_orderdate AS DATE) AS d FROM orders),
c AS (SELECT coalesce(b.key, e.key) AS key, CASE WHEN born IS NOT NULL THEN 'first' ELSE 'last' END AS name, born, died, CASE WHEN died IS NULL THEN 'active' ELSE 'dead' END AS status, date_diff('day', born, coalesce(died, DATE '2001-06-30')) / 365.25 AS years, born IS NULL AS left_censored
 FROM (SELECT key, min(d) AS born FROM o WHERE key % 11 <> 0 GROUP BY key) b FULL JOIN (SELECT key, max(d) AS died FROM o GROUP BY key HAVING max(d) < DATE '2001-01-01') e ON b.key = e.key)"""
SQL = {
    "w02_leave_one_out": _W + " SELECT issuer, yr, sen, ibps, manager, k, round(dev, 6) AS dev FROM dv",
    "a32_manager_stats": _W + """ SELECT manager, count(*) AS n, count(DISTINCT yr) AS dates, round(median(dev), 5) AS median, round(avg(dev), 5) AS mean, round(avg(CAST(round(dev, 6) > 1 AS INT)), 5) AS rich,
 round(avg(CAST(abs(round(dev, 6)) <= 1 AS INT)), 5) AS in_line, round(avg(CAST(round(dev, 6) < -1 AS INT)), 5) AS cheap, round(median(dev) FILTER (round(consensus, 9) >= 0.9455), 5) AS median_sound FROM dv GROUP BY manager""",
    "m04_clustered_ols": _W + """, e AS (SELECT *, dev - avg(dev) OVER (PARTITION BY manager) AS r FROM dv), z AS (SELECT count(DISTINCT (issuer, yr, sen, ibps)) AS g, count(*) AS n, count(DISTINCT manager) AS k FROM dv)
 SELECT manager, count(*) AS n, round(avg(dev), 6) AS coef, round(sqrt(any_value(z.g / (z.g - 1) * (z.n - 1) / (z.n - z.k)) * sum(r * r)) / count(*), 6) AS se FROM e, z GROUP BY manager""",
    "j10_census": _C + " SELECT key, name, born, died, status, round(years, 4) AS years, left_censored FROM c",
    "a34_yearly": _C + """, y AS (SELECT CAST(y AS INTEGER) AS year, (SELECT count(*) FROM c WHERE year(born) = y) AS births, (SELECT count(*) FROM c WHERE year(died) = y) AS deaths FROM range(1995, 2002) t(y)),
 a AS (SELECT *, births - deaths AS net, CAST((SELECT count(*) FROM c WHERE born IS NULL) + sum(births - deaths) OVER (ORDER BY year) AS BIGINT) AS active FROM y)
 SELECT *, CASE WHEN active - net <> 0 THEN round(deaths / (active - net), 4) ELSE 0.0 END AS churn FROM a""",
    "a35_hazard": _C + " SELECT count(*) FILTER (status = 'dead') AS deaths, round(sum(greatest(years, 0)), 3) AS entity_years, round(count(*) FILTER (status = 'dead') / sum(greatest(years, 0)), 6) AS hazard FROM c WHERE born IS NOT NULL",
    "m03_kaplan_meier": _C + """, k AS (SELECT CAST(floor(years) AS INTEGER) AS t, count(*) FILTER (status = 'dead') AS deaths, count(*) AS n FROM c WHERE born IS NOT NULL GROUP BY 1), r AS (SELECT *, CAST(sum(n) OVER (ORDER BY t DESC) AS BIGINT) AS at_risk FROM k)
 SELECT t, deaths, at_risk, round(CASE WHEN max(CAST(deaths = at_risk AS INT)) OVER (ORDER BY t) = 1 THEN 0 ELSE exp(sum(ln(CASE WHEN deaths < at_risk THEN 1 - deaths / at_risk ELSE 1 END)) OVER (ORDER BY t)) END, 6) AS survival FROM r""",
    "v01_order_rules": """WITH l AS (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS lines, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1),
 s AS (SELECT o_orderkey, CASE WHEN lines IS NULL THEN 'skipped' WHEN abs(o_totalprice - lines) <= greatest(abs(o_totalprice) * 0.05, 1000) THEN 'pass' ELSE 'fail' END AS c1, CASE WHEN o_totalprice > 0 THEN 'pass' ELSE 'fail' END AS a1,
 CASE WHEN quantity IS NULL THEN 'skipped' WHEN quantity <= 150 THEN 'pass' ELSE 'fail' END AS i2 FROM orders LEFT JOIN l ON l_orderkey = o_orderkey)
 SELECT o_orderkey, CASE WHEN 'fail' IN (c1, a1, i2) THEN 'review' ELSE 'pass' END AS status, 'C1:' || c1 || ' A1:' || a1 || ' I2:' || i2 AS checks FROM s""",
    "e01_latest_instant": """SELECT user_id, event_type AS concept, round(value, 4) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 ELSE 3 END, ts DESC, event_id) AS rn
 FROM events WHERE event_type IN ('purchase', 'click', 'view')) WHERE rn = 1""",
    "x07_core_merge": """WITH n AS (SELECT trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(p_name), '\\(.*?\\)', ' ', 'g'), '\\b(incorporated|inc|llc|l\\.l\\.c|lp|l\\.p|ltd|limited|corp|corporation|company|co)\\b\\.?', ' ', 'g'), '[^a-z0-9]', ' ', 'g'), ' +', ' ', 'g')) AS norm, count(*) AS rows FROM part GROUP BY 1),
 k AS (SELECT *, array_to_string(list_sort(list_distinct(list_filter(string_split(norm, ' '), lambda w: length(w) >= 2 AND NOT list_contains([""" + ", ".join(f"'{w}'" for w in X.GENERIC) + """], w) AND NOT regexp_full_match(w, '[0-9]+')))), ' ') AS core FROM n)
 SELECT core, arg_min(norm, (len(string_split(norm, ' ')), -rows, norm)) AS canonical, count(*) AS names, CAST(sum(rows) AS BIGINT) AS rows FROM k GROUP BY core""",
    "t01_new_rows": "SELECT o_custkey, count(*) AS orders FROM orders WHERE year(o_orderdate) >= 2000 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE year(o_orderdate) < 2000) GROUP BY 1",
    "t02_since": "WITH o AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS d FROM orders), s AS (SELECT o_custkey, max(d) AS m FROM o WHERE o_custkey % 3 = 0 GROUP BY 1) SELECT o_orderkey, o.o_custkey, d FROM o LEFT JOIN s ON s.o_custkey = o.o_custkey WHERE d >= coalesce(m, DATE '2000-01-01')",
    "w08_running_share": "SELECT o_orderpriority, CAST(yr AS INTEGER) AS yr, n, CAST(sum(n) OVER w AS BIGINT) AS running, lag(n) OVER w AS before FROM (SELECT o_orderpriority, year(o_orderdate) AS yr, count(*) AS n FROM orders GROUP BY ALL) WINDOW w AS (PARTITION BY o_orderpriority ORDER BY yr)",
}

"""Migration queries; the surrogate marks span 90 to 100 points, so edges and thresholds are narrower."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import rounded as R
from ..operators import migration as M
from ..operators.marks import with_price
from ..sources.tables import HOLDINGS_SQL, holdings

EDGES = (0, 92, 94, 95, 96, 98, 100, 110, 1e9)
LABELS = ("<92", "92-94", "94-95", "95-96", "96-98", "98-100", "100-110", ">110")
W = M.Window2(1996, 2000, EDGES, LABELS, 95.0, 94.5)
GRID = ((95, 94), (95, 94.5), (95.5, 94.5), (96, 95))


def panel(spark, sf):
    return with_price(holdings(spark, sf))


def pairs(spark, sf):
    return M.pairs(panel(spark, sf), W)


def totals(spark, sf):
    """A tagged total per fund and year that every third fund exceeds."""
    t = panel(spark, sf).groupBy("fund", "yr").agg(F.sum("fv").alias("t"))
    return t.filter("fund % 10 <> 9").select("fund", "yr", (F.col("t") * F.when(F.col("fund") % 3 == 0, 0.9).otherwise(1.0)).alias("total"))


def a14_pairs(spark, sf):
    return pairs(spark, sf).select("fund", "issuer", "status", R("start_mark", 5).alias("start_mark"), R("end_mark", 5).alias("end_mark"), "start_bucket", "end_bucket", "start_lots", "end_lots", R("start_fv", 4).alias("start_fv"), R("end_par", 4).alias("end_par"))


def a15_reconciliation(spark, sf):
    return M.reconciliation(panel(spark, sf), totals(spark, sf)).select("fund", "yr", R("ratio").alias("ratio"), "reconciles", "reason")


def a16_usable_funds(spark, sf):
    return M.usable(M.reconciliation(panel(spark, sf), totals(spark, sf)), W)


def a17_matrix(spark, sf):
    m = M.matrix(pairs(spark, sf), W)
    return m.select("start_bucket", *[R(c, 4).alias(f"to_{i}") for i, c in enumerate(m.columns[1:])])


def a17_counts(spark, sf):
    m = M.matrix(pairs(spark, sf), W, counts=True)
    return m.select("start_bucket", *[F.col(f"`{c}`").alias(f"to_{i}") for i, c in enumerate(m.columns[1:])])


def checked(spark, sf):
    return M.reconciliation(panel(spark, sf), totals(spark, sf))


def fund_migration(spark, sf):
    return M.fund_migration(pairs(spark, sf), checked(spark, sf), W)


def a18_fund_migration(spark, sf):
    shares = [f"{end}_{k}" for end in ("start", "end") for k in range(len(LABELS))]
    return fund_migration(spark, sf).select(
        "fund", "usable", *[R(c, 4).alias(c) for c in ("start_fv", "migrated_fv", "exited_fv", "migrated_pct", "start_coverage", "end_coverage", *shares)],
        "migrated_n", "exited_n", "entered_n", "both_n",
    )


def a19_issuer_impact(spark, sf):
    impact = M.issuer_impact(pairs(spark, sf), M.usable(checked(spark, sf), W))
    points = ("change", "par_change", "mark_at_start", "mark_at_end", "universe_share", "contribution")
    return impact.select("issuer", "funds", *[R(c, 5).alias(c) for c in points], *[R(c, 4).alias(c) for c in ("fv_at_start", "fv_at_end", "par_at_start")])


def a19_cohort(spark, sf):
    c = M.cohort(pairs(spark, sf), M.usable(checked(spark, sf), W))
    return c.select("issuers", "pairs", *[R(x, 4).alias(x) for x in ("all_at_start", "all_at_end", "at_start", "at_end")], *[R(x, 5).alias(x) for x in ("share", "change")])


def a20_fund_drag(spark, sf):
    return M.fund_drag(M.attribution(pairs(spark, sf))).select("fund", R("drag").alias("drag"), R("migrated_drag").alias("migrated_drag"), R("migrated_share", 5).alias("migrated_share"))


def a21_benchmark(spark, sf):
    """Each fund's drag against the asset-weighted drag of all."""
    d = M.fund_drag(M.attribution(pairs(spark, sf)))
    bench = d.agg((F.sum(F.col("drag") * F.col("fv")) / F.sum("fv")).alias("benchmark"))
    return d.crossJoin(F.broadcast(bench)).select("fund", R("benchmark").alias("benchmark"), R(F.col("drag") - F.col("benchmark")).alias("excess"))  # one row


def a22_concentration(spark, sf):
    return M.concentration(M.attribution(pairs(spark, sf)))


def a23_manager_rollup(spark, sf):
    managers = panel(spark, sf).select("fund", "manager").distinct()
    out = M.manager_rollup(M.fund_drag(M.attribution(pairs(spark, sf))), fund_migration(spark, sf), managers)
    return out.select("manager", "funds", "migrated_n", R("drag").alias("drag"), *[R(c, 4).alias(c) for c in ("start_fv", "migrated_fv", "exited_fv")])


def a24_sensitivity(spark, sf):
    return M.sensitivity(pairs(spark, sf), GRID).select("healthy", "distressed", "n", R("share").alias("share"))


QUERIES = {f.__name__: f for f in (a14_pairs, a15_reconciliation, a16_usable_funds, a17_matrix, a17_counts, a18_fund_migration, a19_issuer_impact, a19_cohort, a20_fund_drag, a21_benchmark, a22_concentration, a23_manager_rollup, a24_sensitivity)}


def _bucket(c: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} > {lo} AND {c} <= {hi} THEN '{x}'" for lo, hi, x in zip(EDGES, EDGES[1:], LABELS)) + " END"


_W = "WITH " + HOLDINGS_SQL + f""", q AS (SELECT fund, issuer, round(100 * (sum(price * fv) FILTER (yr = 1996)) / (sum(fv) FILTER (yr = 1996)), 6) AS start_mark, round(100 * (sum(price * fv) FILTER (yr = 2000)) / (sum(fv) FILTER (yr = 2000)), 6) AS end_mark,
 sum(fv) FILTER (yr = 1996) AS start_fv, sum(par) FILTER (yr = 1996) AS start_par, sum(par) FILTER (yr = 2000) AS end_par, sum(fv) FILTER (yr = 2000) AS end_fv, nullif(count(*) FILTER (yr = 1996), 0) AS start_lots, nullif(count(*) FILTER (yr = 2000), 0) AS end_lots
 FROM p WHERE yr IN (1996, 2000) AND price IS NOT NULL AND par IS NOT NULL GROUP BY fund, issuer),
r AS (SELECT *, CASE WHEN start_lots IS NOT NULL AND end_lots IS NOT NULL THEN 'both' WHEN start_lots IS NOT NULL THEN 'exited' ELSE 'entered' END AS status, {_bucket('start_mark')} AS start_bucket, {_bucket('end_mark')} AS end_bucket FROM q),
pr AS (SELECT *, status = 'both' AND start_mark >= 95 AND end_mark < 94.5 AS migrated FROM r),
att AS (SELECT *, start_fv / sum(start_fv) OVER (PARTITION BY fund) * (end_mark - start_mark) AS drag FROM pr WHERE status = 'both'),
fd AS (SELECT fund, sum(drag) AS drag, sum(CASE WHEN migrated THEN drag ELSE 0 END) AS migrated_drag, sum(start_fv) AS fv FROM att GROUP BY fund),
tot AS (SELECT fund, yr, sum(fv) * CASE WHEN fund % 3 = 0 THEN 0.9 ELSE 1.0 END AS total FROM p WHERE fund % 10 <> 9 GROUP BY fund, yr),
rec AS (SELECT o.fund, o.yr, o.fv / total AS ratio, coalesce(o.fv / total <= 1.05, false) AS reconciles, CASE WHEN total IS NULL THEN 'no tagged total' WHEN o.fv / total > 1.05 THEN 'holdings exceed total' ELSE 'ok' END AS reason
 FROM (SELECT fund, yr, sum(fv) AS fv FROM p GROUP BY fund, yr) o LEFT JOIN tot ON tot.fund = o.fund AND tot.yr = o.yr),
us AS (SELECT fund FROM rec WHERE yr IN (1996, 2000) GROUP BY fund HAVING count(*) FILTER (reconciles) = 2),
kept AS (SELECT *, end_mark - start_mark AS moved FROM pr WHERE status = 'both' AND fund IN (FROM us)),
fmig AS (SELECT fund, sum(start_fv) AS start_fv, sum(start_fv) FILTER (migrated) AS migrated_fv, sum(start_fv) FILTER (status = 'exited') AS exited_fv, count(*) FILTER (migrated) AS migrated_n,
 count(*) FILTER (status = 'exited') AS exited_n, count(*) FILTER (status = 'entered') AS entered_n, count(*) FILTER (status = 'both') AS both_n,
 {", ".join(f"coalesce(sum({end}_fv) FILTER ({end}_bucket = '{x}'), 0) AS {end}_{i}" for end in ("start", "end") for i, x in enumerate(LABELS))} FROM pr GROUP BY fund)"""
SQL = {
    "a14_pairs": _W + " SELECT fund, issuer, status, round(start_mark, 5) AS start_mark, round(end_mark, 5) AS end_mark, start_bucket, end_bucket, start_lots, end_lots, round(start_fv, 4) AS start_fv, round(end_par, 4) AS end_par FROM pr",
    "a15_reconciliation": _W + " SELECT fund, yr, round(ratio, 6) AS ratio, reconciles, reason FROM rec",
    "a16_usable_funds": _W + " SELECT fund FROM rec WHERE yr IN (1996, 2000) GROUP BY fund HAVING count(*) FILTER (reconciles) = 2",
    "a17_matrix": _W + " SELECT start_bucket, " + ", ".join(
        f"round(coalesce(sum(start_fv) FILTER ({'end_bucket = ' + repr(x) if x != 'EXITED' else 'status = ' + repr('exited')}), 0), 4) AS to_{i}" for i, x in enumerate((*LABELS, "EXITED"))
    ) + " FROM pr WHERE status <> 'entered' AND start_bucket IS NOT NULL GROUP BY start_bucket",
    "a17_counts": _W + " SELECT start_bucket, " + ", ".join(
        f"count(*) FILTER ({'end_bucket = ' + repr(x) if x != 'EXITED' else 'status = ' + repr('exited')}) AS to_{i}" for i, x in enumerate((*LABELS, "EXITED"))
    ) + " FROM pr WHERE status <> 'entered' AND start_bucket IS NOT NULL GROUP BY start_bucket",
    "a18_fund_migration": _W + ", b AS (SELECT fund, ratio, (SELECT total FROM tot WHERE tot.fund = rec.fund AND tot.yr = 1996) AS t0, (SELECT total FROM tot WHERE tot.fund = rec.fund AND tot.yr = 2000) AS t1, yr FROM rec),"
    " e AS (SELECT fund, any_value(t0) AS t0, any_value(t1) AS t1, max(ratio) FILTER (yr = 1996) AS c0, max(ratio) FILTER (yr = 2000) AS c1 FROM b GROUP BY fund)"
    " SELECT fund, fund IN (FROM us) AS usable, round(start_fv, 4) AS start_fv, round(migrated_fv, 4) AS migrated_fv, round(exited_fv, 4) AS exited_fv, round(100 * migrated_fv / t0, 4) AS migrated_pct,"
    " round(c0, 4) AS start_coverage, round(c1, 4) AS end_coverage, migrated_n, exited_n, entered_n, both_n, "
    + ", ".join(f"round(100 * {end}_{i} / {t}, 4) AS {end}_{i}" for end, t in (("start", "t0"), ("end", "t1")) for i in range(len(LABELS))) + " FROM fmig LEFT JOIN e USING (fund)",
    "a19_issuer_impact": _W + """ SELECT issuer, count(*) AS funds, round(sum(moved * start_fv) / sum(start_fv), 5) AS change, round(sum(moved * start_par) / sum(start_par), 5) AS par_change, round(sum(start_mark * start_fv) / sum(start_fv), 5) AS mark_at_start,
 round(sum(end_mark * start_fv) / sum(start_fv), 5) AS mark_at_end, round(sum(start_fv) / (SELECT sum(start_fv) FROM kept), 5) AS universe_share, round(sum(moved * start_fv) / (SELECT sum(start_fv) FROM kept), 5) AS contribution,
 round(sum(start_fv), 4) AS fv_at_start, round(sum(end_fv), 4) AS fv_at_end, round(sum(start_par), 4) AS par_at_start FROM kept GROUP BY issuer""",
    "a19_cohort": _W + """ SELECT count(DISTINCT issuer) FILTER (migrated) AS issuers, count(*) FILTER (migrated) AS pairs, round(sum(start_fv), 4) AS all_at_start, round(sum(end_fv), 4) AS all_at_end, round(sum(start_fv) FILTER (migrated), 4) AS at_start,
 round(sum(end_fv) FILTER (migrated), 4) AS at_end, round(sum(start_fv) FILTER (migrated) / sum(start_fv), 5) AS share, round(sum(moved * start_fv) FILTER (migrated) / sum(start_fv) FILTER (migrated), 5) AS change FROM kept""",
    "a20_fund_drag": _W + " SELECT fund, round(drag, 6) AS drag, round(migrated_drag, 6) AS migrated_drag, round(CASE WHEN abs(drag) > 1e-9 THEN migrated_drag / drag END, 5) AS migrated_share FROM fd",
    "a21_benchmark": _W + " SELECT fund, round(b, 6) AS benchmark, round(drag - b, 6) AS excess FROM fd, (SELECT sum(drag * fv) / sum(fv) AS b FROM fd)",
    "a22_concentration": _W + """, l AS (SELECT fund, issuer, round(sum(-drag) OVER (w ROWS UNBOUNDED PRECEDING) / sum(-drag) OVER (PARTITION BY fund), 9) AS csum, row_number() OVER w AS rank FROM att WHERE drag < 0 WINDOW w AS (PARTITION BY fund ORDER BY round(-drag, 9) DESC, issuer))
 SELECT fund, count(*) FILTER (csum < 0.8) + 1 AS names, string_agg(issuer, '; ' ORDER BY rank) FILTER (rank <= 3) AS top FROM l GROUP BY fund""",
    "a23_manager_rollup": _W + """ SELECT manager, count(DISTINCT fund) AS funds, CAST(sum(migrated_n) AS BIGINT) AS migrated_n, round(sum(drag * fv) / sum(fv), 6) AS drag, round(sum(fv), 4) AS start_fv, round(coalesce(sum(migrated_fv), 0), 4) AS migrated_fv,
 round(coalesce(sum(exited_fv), 0), 4) AS exited_fv FROM fd JOIN fmig USING (fund) JOIN (SELECT DISTINCT fund, manager FROM h) USING (fund) WHERE fund IN (FROM us) GROUP BY manager""",
    "a24_sensitivity": _W + " SELECT CAST(healthy AS DOUBLE) AS healthy, CAST(distressed AS DOUBLE) AS distressed, count(*) FILTER (start_mark >= healthy AND end_mark < distressed) AS n, round(coalesce(sum(start_fv) FILTER (start_mark >= healthy AND end_mark < distressed), 0) / sum(start_fv), 6) AS share FROM pr, (VALUES " + ", ".join(f"({h}, {d})" for h, d in GRID) + ") g(healthy, distressed) WHERE status = 'both' GROUP BY ALL",
}

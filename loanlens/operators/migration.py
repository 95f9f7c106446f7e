"""Credit migration of (fund, issuer) pairs between two dates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .marks import bucket


@dataclass(frozen=True)
class Window2:
    """The dates compared and, in points of par, the bucket edges and the thresholds: healthy at or above, distressed below."""

    start: int
    end: int
    edges: tuple[float, ...] = (0, 85, 90, 95, 98, 100, 110, 1e9)
    labels: tuple[str, ...] = ("<85", "85-90", "90-95", "95-98", "98-100", "100-110", ">110 (suspect)")
    healthy: float = 95.0
    distressed: float = 90.0


def pairs(panel: DataFrame, w: Window2) -> DataFrame:
    """panel (fund, issuer, yr, price, par, fv) -> a row per pair: fair-value-weighted marks, sums, status, buckets."""
    priced = panel.filter(F.col("yr").isin(w.start, w.end) & F.col("price").isNotNull() & F.col("par").isNotNull())
    at = lambda d, c: F.sum(F.when(F.col("yr") == d, c))
    one = priced.groupBy("fund", "issuer").agg(
        *[x for d, n in ((w.start, "start"), (w.end, "end")) for x in (
            at(d, F.col("price") * F.col("fv")).alias(f"{n}_wm"), at(d, F.col("fv")).alias(f"{n}_fv"), at(d, F.col("par")).alias(f"{n}_par"), at(d, F.lit(1)).alias(f"{n}_lots"))]
    )
    for n in ("start", "end"):
        one = one.withColumn(f"{n}_mark", F.round(100 * F.col(f"{n}_wm") / F.nullif(f"{n}_fv", F.lit(0.0)), 6)).withColumn(f"{n}_bucket", bucket(F.col(f"{n}_mark"), w.edges, w.labels))
    status = F.when(F.col("start_lots").isNotNull() & F.col("end_lots").isNotNull(), "both").when(F.col("start_lots").isNotNull(), "exited").otherwise("entered")
    return one.withColumn("status", status).withColumn("migrated", (F.col("status") == "both") & (F.col("start_mark") >= w.healthy) & (F.col("end_mark") < w.distressed)).drop("start_wm", "end_wm")


def reconciliation(panel: DataFrame, totals: DataFrame, ceiling: float = 1.05) -> DataFrame:
    """Sum of fair values against the tagged total per (fund, yr): usable up to the ceiling, with the reason if not."""
    own = panel.groupBy("fund", "yr").agg(F.sum("fv").alias("fv"))
    ratio = F.col("fv") / F.nullif("total", F.lit(0.0))
    return own.join(totals, ["fund", "yr"], "left").withColumn("ratio", ratio).withColumn("reconciles", F.coalesce(ratio <= ceiling, F.lit(False))).withColumn(
        "reason", F.when(F.col("total").isNull(), "no tagged total").when(~F.coalesce(ratio <= ceiling, F.lit(False)), "holdings exceed total").otherwise("ok"))


def usable(checked: DataFrame, w: Window2) -> DataFrame:
    """Funds that reconcile on both dates."""
    return checked.filter(F.col("yr").isin(w.start, w.end)).groupBy("fund").agg(F.count_if("reconciles").alias("n")).filter("n = 2").select("fund")


def matrix(p: DataFrame, w: Window2, counts: bool = False) -> DataFrame:
    """Start bucket x end bucket (and EXITED): $ at start, or the pairs counted; missing cells are 0."""
    end = F.when(F.col("status") == "exited", "EXITED").otherwise(F.col("end_bucket"))
    rows = p.filter("status != 'entered' and start_bucket is not null").withColumn("to", end)
    return rows.groupBy("start_bucket").pivot("to", [*w.labels, "EXITED"]).agg(F.count(F.lit(1)) if counts else F.sum("start_fv")).na.fill(0)


def fund_migration(p: DataFrame, checked: DataFrame, w: Window2) -> DataFrame:
    """A row per fund: what migrated, exited, entered and stayed; start_0, start_1, ... and end_0, ...: the percentage in each
    bucket, in the order of w.labels. Percentages are of the fund's tagged total at that date (null without one), never of its
    own sum, so they need not add up to 100; coverage tells how much was priced. checked: as from reconciliation."""
    s = F.col("status")
    held = {f"{end}_{k}": F.sum(F.when(F.col(f"{end}_bucket") == label, F.col(f"{end}_fv"))) for end in ("start", "end") for k, label in enumerate(w.labels)}
    own = p.groupBy("fund").agg(
        F.sum("start_fv").alias("start_fv"), F.sum(F.when(F.col("migrated"), F.col("start_fv"))).alias("migrated_fv"), F.count_if("migrated").alias("migrated_n"),
        F.sum(F.when(s == "exited", F.col("start_fv"))).alias("exited_fv"), F.count_if(s == "exited").alias("exited_n"), F.count_if(s == "entered").alias("entered_n"),
        F.count_if(s == "both").alias("both_n"), *[F.coalesce(x, F.lit(0.0)).alias(c) for c, x in held.items()],
    )
    at = lambda d, c: F.max(F.when(F.col("yr") == d, F.col(c)))
    ends = checked.filter(F.col("yr").isin(w.start, w.end)).groupBy("fund").agg(
        *[at(d, c).alias(f"{end}_{n}") for d, end in ((w.start, "start"), (w.end, "end")) for c, n in (("total", "total"), ("ratio", "coverage"))],
        (F.count_if("reconciles") == 2).alias("usable"),
    )
    of = lambda x, end: 100 * F.col(x) / F.nullif(f"{end}_total", F.lit(0.0))
    out = own.join(ends, "fund", "left").withColumns({c: of(c, c.split("_")[0]) for c in held})
    return out.withColumn("migrated_pct", of("migrated_fv", "start")).withColumn("usable", F.coalesce("usable", F.lit(False)))


def issuer_impact(p: DataFrame, funds: DataFrame) -> DataFrame:
    """Per issuer, over the pairs kept by the given (usable) funds: change of the mark weighted by start value and by start
    par, sums, weighted marks, the share of all start value and the points by which the issuer moved the whole."""
    kept = p.filter("status = 'both'").join(funds, "fund", "left_semi")
    total = kept.agg(F.sum("start_fv").alias("universe"))  # one row
    change = F.col("end_mark") - F.col("start_mark")
    mean = lambda x, c: F.sum(x * F.col(c)) / F.sum(c)
    rows = kept.groupBy("issuer").agg(
        F.count(F.lit(1)).alias("funds"), mean(change, "start_fv").alias("change"), F.when(F.sum("start_par") > 0, mean(change, "start_par")).alias("par_change"),
        mean(F.col("start_mark"), "start_fv").alias("mark_at_start"), mean(F.col("end_mark"), "start_fv").alias("mark_at_end"),
        F.sum("start_fv").alias("fv_at_start"), F.sum("end_fv").alias("fv_at_end"), F.sum("start_par").alias("par_at_start"),
    ).filter("fv_at_start > 0")
    shared = rows.crossJoin(F.broadcast(total)).withColumn("universe_share", F.col("fv_at_start") / F.col("universe"))
    return shared.withColumn("contribution", F.col("universe_share") * F.col("change")).drop("universe")


def cohort(p: DataFrame, funds: DataFrame) -> DataFrame:
    """One row: the migrated pairs of the given funds against all that they kept."""
    kept, hit = p.filter("status = 'both'").join(funds, "fund", "left_semi"), F.col("migrated")
    sums = kept.agg(
        F.sum("start_fv").alias("all_at_start"), F.sum("end_fv").alias("all_at_end"), F.count_distinct(F.when(hit, F.col("issuer"))).alias("issuers"), F.count_if(hit).alias("pairs"),
        F.sum(F.when(hit, F.col("start_fv"))).alias("at_start"), F.sum(F.when(hit, F.col("end_fv"))).alias("at_end"),
        F.sum(F.when(hit, (F.col("end_mark") - F.col("start_mark")) * F.col("start_fv"))).alias("moved"),
    )
    return sums.withColumn("share", F.col("at_start") / F.nullif("all_at_start", F.lit(0.0))).withColumn("change", F.col("moved") / F.nullif("at_start", F.lit(0.0))).drop("moved")


def attribution(p: DataFrame) -> DataFrame:
    """Each kept pair's drag on its fund: start weight x change of mark, in points."""
    kept = p.filter("status = 'both'")
    total = F.sum("start_fv").over(Window.partitionBy("fund"))
    return kept.withColumn("weight", F.col("start_fv") / F.nullif(total, F.lit(0.0))).withColumn("drag", F.col("weight") * (F.col("end_mark") - F.col("start_mark")))


def fund_drag(a: DataFrame) -> DataFrame:
    """Fund drag, that of migrated names and its share (null if the drag is nil)."""
    return a.groupBy("fund").agg(F.sum("drag").alias("drag"), F.sum(F.when(F.col("migrated"), F.col("drag")).otherwise(0.0)).alias("migrated_drag"), F.sum("start_fv").alias("fv")).withColumn(
        "migrated_share", F.when(F.abs("drag") > 1e-9, F.col("migrated_drag") / F.col("drag")))


def manager_rollup(drags: DataFrame, migrated: DataFrame, managers: DataFrame) -> DataFrame:
    """drags (fund_drag) of usable funds beside what migrated in them (fund_migration), by managers (fund, manager): funds,
    start value, weighted drag, migrated and exited."""
    own = migrated.filter("usable").select("fund", "migrated_fv", "migrated_n", "exited_fv")
    used = drags.join(migrated.filter("usable").select("fund"), "fund", "left_semi").join(own, "fund", "left").join(managers, "fund")
    return used.groupBy("manager").agg(
        F.count_distinct("fund").alias("funds"), F.sum("fv").alias("start_fv"), (F.sum(F.col("drag") * F.col("fv")) / F.nullif(F.sum("fv"), F.lit(0.0))).alias("drag"),
        F.coalesce(F.sum("migrated_fv"), F.lit(0.0)).alias("migrated_fv"), F.coalesce(F.sum("migrated_n"), F.lit(0)).alias("migrated_n"), F.coalesce(F.sum("exited_fv"), F.lit(0.0)).alias("exited_fv"),
    )


def concentration(a: DataFrame, share: float = 0.8) -> DataFrame:
    """How few names make up `share` of a fund's losses, and the three largest."""
    loss = a.filter("drag < 0").withColumn("loss", -F.col("drag"))
    order = Window.partitionBy("fund").orderBy(F.desc(F.round("loss", 9)), "issuer")
    run = F.sum("loss").over(order.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("loss").over(Window.partitionBy("fund"))
    ranked = loss.withColumn("csum", F.round(run, 9)).withColumn("rank", F.row_number().over(order))
    return ranked.groupBy("fund").agg(
        (F.count_if(F.col("csum") < share) + 1).alias("names"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= 3, F.struct("rank", "issuer")))), lambda x: x["issuer"]), "; ").alias("top")
    )


def sensitivity(p: DataFrame, grid: Sequence[tuple[float, float]]) -> DataFrame:
    """Migrated share of the start value at each (healthy, distressed) pair of thresholds."""
    rows = F.explode(F.array(*[F.struct(F.lit(float(h)).alias("healthy"), F.lit(float(d)).alias("distressed")) for h, d in grid])).alias("g")
    hit = (F.col("start_mark") >= F.col("g.healthy")) & (F.col("end_mark") < F.col("g.distressed"))
    return p.filter("status = 'both'").select("*", rows).groupBy("g.healthy", "g.distressed").agg(F.count_if(hit).alias("n"), (F.sum(F.when(hit, F.col("start_fv")).otherwise(0.0)) / F.sum("start_fv")).alias("share"))


def chained_return(start_ytd: Column, year_ends: Column, end_ytd: Column) -> Column:
    """Return over a window from year-to-date returns: year_ends holds those of the fiscal year ends inside, in any order."""
    product = F.aggregate(year_ends, F.lit(1.0), lambda a, y: a * (1 + y))
    return product / F.nullif(1 + start_ytd, F.lit(0.0)) * (1 + end_ytd) - 1

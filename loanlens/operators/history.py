"""Series of marks over dates: trend, ownership, stable holders, wide history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged


def medians(rows: DataFrame, keys: Sequence[str], value: str, width: float = 0.001) -> DataFrame:
    """rows, staged -> (*keys, value): the exact median. Counts in cells of `width` tell in which cell of a key its middle
    values lie; only the rows of these cells are ranked. So a key with any number of rows is never sorted in one place."""
    celled = rows.select(*keys, F.col(value).alias("v"), F.floor(F.col(value) / width).alias("cell"))
    counts = celled.groupBy(*keys, "cell").agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy(*keys)  # a row per cell
    middle = counts.withColumn("upto", F.sum("n").over(by.orderBy("cell"))).withColumn("total", F.sum("n").over(by))
    low, high = F.floor((F.col("total") + 1) / 2), F.floor(F.col("total") / 2) + 1
    cells = middle.withColumn("low", low).withColumn("high", high).filter("upto >= low and upto - n < high")
    cells = cells.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("cell").alias("__cell"), (F.col("upto") - F.col("n")).alias("before"), "low", "high")
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys] + [F.col("cell") == F.col("__cell")]
    rank = F.col("before") + F.row_number().over(Window.partitionBy(*keys, "cell").orderBy("v"))
    ranked = celled.join(cells, same).withColumn("rank", rank).filter("rank = low or rank = high")
    return ranked.groupBy(*keys).agg(((F.min("v") + F.max("v")) / 2).alias(value))


def issuer_series(marks: DataFrame, least_funds: int = 3, least_dates: int = 3) -> DataFrame:
    """marks (issuer, yr, fund, mark), staged -> (issuer, yr, mark, funds): the median mark where enough funds report, of
    issuers seen on enough dates."""
    known = marks.filter("mark is not null")
    funds = known.groupBy("issuer", "yr").agg(F.count_distinct("fund").alias("funds")).filter(F.col("funds") >= least_funds)
    series = medians(known, ["issuer", "yr"], "mark").join(funds, ["issuer", "yr"])
    return series.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("issuer"))).filter(F.col("n") >= least_dates).drop("n")


def trend(series: DataFrame) -> DataFrame:
    """Of each series: the first and last date observed, marks and funds at both, peak, trough, range and net change, in points
    of par."""
    ends = {f"{c}_{end}": f(c, "yr") for c in ("mark", "funds") for end, f in (("first", F.min_by), ("last", F.max_by))}
    out = series.groupBy("issuer").agg(
        F.count(F.lit(1)).alias("dates"), F.min("yr").alias("first_obs"), F.max("yr").alias("last_obs"), (ends["mark_first"] * 100).alias("first"), (ends["mark_last"] * 100).alias("last"),
        (F.max("mark") * 100).alias("peak"), (F.min("mark") * 100).alias("trough"), ends["funds_first"].alias("funds_at_first"), ends["funds_last"].alias("funds_at_last"),
    )
    return out.withColumn("range", F.col("peak") - F.col("trough")).withColumn("net", F.col("last") - F.col("first"))


def owner_positions(priced: DataFrame) -> DataFrame:
    """(issuer, fund, yr): fair value, mark, share of the issuer's and of the fund's total, seniorities held. Totals are
    aggregated and joined back, so no issuer or fund is gathered in one place."""
    own = priced.groupBy("issuer", "fund", "yr").agg(
        F.sum("fv").alias("fv"), F.median("price").alias("mark"), F.count(F.lit(1)).alias("lots"), F.nullif(F.array_join(F.array_sort(F.collect_set("sen")), "; "), F.lit("")).alias("seniorities")
    )
    own = staged(own, "positions")
    issuers = own.groupBy("issuer", "yr").agg(F.sum("fv").alias("issuer_fv"), F.count(F.lit(1)).alias("funds"))
    funds = own.groupBy("fund", "yr").agg(F.sum("fv").alias("fund_fv"))
    share = lambda total: F.col("fv") / F.nullif(total, F.lit(0.0))
    joined = own.join(issuers, ["issuer", "yr"]).join(funds, ["fund", "yr"])
    return joined.withColumn("of_issuer", share("issuer_fv")).withColumn("of_fund", share("fund_fv")).drop("issuer_fv", "fund_fv")


def tenure(priced: DataFrame) -> DataFrame:
    return priced.groupBy("issuer", "fund").agg(F.min("yr").alias("since"), F.max("yr").alias("until"), F.count_distinct("yr").alias("dates"))


def holder_rollup(positions: DataFrame) -> DataFrame:
    """positions of one date -> per issuer: holders, their total value and how far apart their marks are, in points (null with
    fewer than two marks)."""
    apart = F.when(F.count("mark") >= 2, (F.max("mark") - F.min("mark")) * 100)
    return positions.groupBy("issuer").agg(F.count_distinct("fund").alias("holders"), F.sum("fv").alias("exposure"), apart.alias("apart"))


def owners(positions: DataFrame, ranked: DataFrame, tenures: DataFrame, change: DataFrame, now: int, then: int) -> DataFrame:
    """The holders at date `now` of the ranked issuers, beside their tenure, the issuer's roll-up, the holder's mark and the
    issuer's value at `then` and the last change of the holders that stayed. positions: as from owner_positions; ranked and
    change hold a row per issuer."""
    at = lambda d: positions.filter(F.col("yr") == d)
    past = at(then).select("issuer", "fund", F.col("mark").alias("mark_then"))
    exposure = at(then).groupBy("issuer").agg(F.sum("fv").alias("exposure_then"))
    own = at(now).join(ranked, "issuer").join(tenures, ["issuer", "fund"], "left").join(holder_rollup(at(now)), "issuer", "left")
    # the value at `then` stands only beside a holder of that date
    past = past.join(exposure, "issuer")
    return own.join(past, ["issuer", "fund"], "left").join(change, "issuer", "left")


def stable_holder_change(priced: DataFrame) -> DataFrame:
    """Between an issuer's last two dates: holders kept, new and gone, and the change of the mark by those that stayed."""
    own = priced.filter("price is not null").groupBy("issuer", "fund", "yr").agg(F.median("price").alias("mark"))
    place = F.dense_rank().over(Window.partitionBy("issuer").orderBy(F.desc("yr")))
    two = own.withColumn("place", place).filter("place <= 2").groupBy("issuer", "fund").agg(
        F.max(F.when(F.col("place") == 1, F.col("mark"))).alias("now"), F.max(F.when(F.col("place") == 2, F.col("mark"))).alias("then")
    )
    both = F.col("now").isNotNull() & F.col("then").isNotNull()
    return two.groupBy("issuer").agg(
        F.count_if(both).alias("stayed"), F.count_if(F.col("then").isNull()).alias("came"), F.count_if(F.col("now").isNull()).alias("left"),
        F.median(F.when(both, (F.col("now") - F.col("then")) * 100)).alias("change"),
    )


def wide_history(priced: DataFrame, dates: Sequence[int]) -> DataFrame:
    """One row per (issuer, fund), a mark and a fair value column per date; dates never seen stay as null columns."""
    return priced.groupBy("issuer", "fund").pivot("yr", list(dates)).agg(F.median("price").alias("mark"), F.sum("fv").alias("fv"))

"""Marking bias of managers against the leave-one-out median of an issue."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .marks import ISSUE


def deviations(marks: DataFrame, least: int = 3) -> DataFrame:
    """marks (issue, manager, mark) -> one mark per manager and issue, in points its distance from the median of the other
    managers, and the median of all; only issues with at least `least` managers."""
    own = marks.groupBy(*ISSUE, "manager").agg(F.median("mark").alias("mark"))
    issue = Window.partitionBy(*ISSUE)
    ranked = own.withColumn("k", F.count(F.lit(1)).over(issue)).filter(F.col("k") >= least).withColumn("rn", F.row_number().over(issue.orderBy("mark", "manager")))
    # without the mark of rank rn the j-th smallest is the one of rank j, or of j + 1 from rn on: three ranks around the
    # middle hold every median of the others
    low = F.floor(F.col("k") / 2)
    at = lambda rank: F.max(F.when(F.col("rn") == rank, F.col("mark"))).over(issue)
    held = ranked.withColumns({"m0": at(low), "m1": at(low + 1), "m2": at(low + 2), "low": low})
    nth = lambda j, here, after: F.when(F.col("rn") > j, F.col(here)).otherwise(F.col(after))
    one, two = nth(F.col("low"), "m0", "m1"), nth(F.col("low") + 1, "m1", "m2")
    middle = F.when(F.col("k") % 2 == 0, one).otherwise((one + two) / 2)
    consensus = F.when(F.col("k") % 2 == 1, F.col("m1")).otherwise((F.col("m0") + F.col("m1")) / 2)
    return held.select(*ISSUE, "manager", "mark", "k", ((F.col("mark") - middle) * 100).alias("dev"), consensus.alias("consensus"))


def manager_stats(dev: DataFrame, band: float = 1.0, distressed: float = 0.9) -> DataFrame:
    """Per manager: issues, dates, median and mean deviation, the shares above, within and below the band, and the median
    without issues whose consensus is below `distressed` (null if none is left)."""
    d = F.round("dev", 6)
    sound = F.round("consensus", 9) >= distressed
    return dev.groupBy("manager").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("yr").alias("dates"), F.median("dev").alias("median"), F.avg("dev").alias("mean"), F.avg((d > band).cast("int")).alias("rich"),
        F.avg((F.abs(d) <= band).cast("int")).alias("in_line"), F.avg((d < -band).cast("int")).alias("cheap"), F.median(F.when(sound, F.col("dev"))).alias("median_sound"),
    )


def clustered_ols(dev: DataFrame) -> DataFrame:
    """OLS on manager dummies without intercept: the coefficient is the mean; the variance is clustered by issue. An issue
    holds one row a manager, so the meat of a manager is the sum of its squared residuals."""
    mean = F.avg("dev").over(Window.partitionBy("manager"))
    sums = dev.withColumn("e", F.col("dev") - mean).groupBy("manager").agg(F.avg("dev").alias("coef"), F.sum(F.col("e") * F.col("e")).alias("meat"), F.count(F.lit(1)).alias("n"))
    sizes = dev.agg(F.count_distinct(F.struct(*ISSUE)).alias("g"), F.count(F.lit(1)).alias("rows"), F.count_distinct("manager").alias("k"))
    factor = F.col("g") / F.nullif(F.col("g") - 1, F.lit(0)) * (F.col("rows") - 1) / F.nullif(F.col("rows") - F.col("k"), F.lit(0))
    return sums.crossJoin(F.broadcast(sizes)).select("manager", "n", "coef", F.sqrt(factor * F.col("meat")) / F.col("n")).toDF("manager", "n", "coef", "se")  # sizes is one row


def sign_counts(dev: DataFrame, dead: float = 0.01) -> DataFrame:
    """Deviations above and below the dead zone, per manager."""
    return dev.groupBy("manager").agg(F.count_if(F.col("dev") > dead).alias("above"), F.count_if(F.col("dev") < -dead).alias("below"))


def upper_tail(n: int, least: int, p: float = 0.5) -> float:
    """P(X >= least) of a binomial. The tail that leaves the mode out is summed away from it until terms vanish, so some
    multiple of sqrt(n) terms suffice at any n."""
    if least <= 0 or p >= 1:
        return 1.0
    if p <= 0 or least > n:
        return 0.0
    odds = math.log(p) - math.log1p(-p)
    up = least > (n + 1) * p
    k, step = (least, 1) if up else (least - 1, -1)
    term = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    first, terms = term, []
    while 0 <= k <= n and term > first - 45:
        terms.append(math.exp(term))
        term += math.log(n - k) - math.log(k + 1) + odds if up and k < n else math.log(k) - math.log(n - k + 1) - odds if not up and k else 0.0
        k += step
    tail = min(1.0, math.fsum(terms))
    return tail if up else 1.0 - tail


def median_ranks(n: int, level: float = 0.95) -> tuple[int, int]:
    """Ranks (from 1) of the order statistics that bound the bootstrap distribution of a median of n values. A resample's
    lower median is at most the k-th value with P(Binomial(n, k/n) >= (n+1)//2), so no draws are needed."""

    def rank(middle: int, share: float) -> int:
        low, high = 1, n
        while low < high:
            k = (low + high) // 2
            low, high = (low, k) if upper_tail(n, middle, k / n) >= share else (k + 1, high)
        return low

    return rank((n + 1) // 2, (1 - level) / 2), rank(n // 2 + 1, (1 + level) / 2)


def sign_test(dev: DataFrame, dead: float = 0.01) -> DataFrame:
    """(manager, above, below, p): exact two-sided sign test; without a deviation p is 1."""

    @F.pandas_udf("double")
    def p_value(above: pd.Series, below: pd.Series) -> pd.Series:
        return pd.Series([min(1.0, 2 * upper_tail(int(a + b), int(max(a, b)))) if a + b else 1.0 for a, b in zip(above, below, strict=True)], dtype="float64")

    return sign_counts(dev, dead).withColumn("p", p_value("above", "below"))


def median_interval(dev: DataFrame, least: int = 3) -> DataFrame:
    """(manager, lo, hi): percentile-bootstrap interval of the median, from its exact distribution: deterministic, and no
    manager's rows are gathered in one place except for their sort. Fewer than `least` rows: null."""

    @F.pandas_udf("array<bigint>")
    def bounds(n: pd.Series) -> pd.Series:
        return pd.Series([list(median_ranks(int(v))) for v in n])

    sizes = dev.groupBy("manager").agg(F.count("dev").alias("n")).withColumn("at", F.when(F.col("n") >= least, bounds("n")))
    counts = dev.filter("dev is not null").groupBy("manager", "dev").agg(F.count(F.lit(1)).alias("c"))  # equal values meet before the sort
    upto = F.sum("c").over(Window.partitionBy("manager").orderBy("dev"))
    ranked = counts.withColumn("upto", upto).join(sizes, "manager")
    found = ranked.groupBy("manager").agg(*[F.min(F.when(F.col("upto") >= F.get("at", F.lit(i)), F.col("dev"))).alias(c) for i, c in enumerate(("lo", "hi"))])
    return sizes.select("manager", "n").join(found, "manager", "left")


def significant(dev: DataFrame, least: int = 20, level: float = 0.05) -> DataFrame:
    """Regression inference beside the median's interval. Managers with fewer than `least` rows keep their estimate only; p is
    corrected by Benjamini-Hochberg over the others; robust needs both tests on the same side."""

    @F.pandas_udf("double")
    def two_sided(z: pd.Series) -> pd.Series:
        return pd.Series([None if v is None or v != v else math.erfc(abs(v) / math.sqrt(2)) for v in z], dtype="float64")

    fit = clustered_ols(dev).withColumn("thin", F.col("n") < least)
    fit = fit.withColumn("se", F.when(~F.col("thin"), F.col("se"))).withColumn("p", two_sided(F.col("coef") / F.nullif("se", F.lit(0.0))))
    down = Window.partitionBy("known").orderBy(F.desc("p"))  # a row per manager
    ranked = fit.withColumn("known", F.col("p").isNotNull()).withColumn("m", F.count("p").over(Window.partitionBy("known"))).withColumn("rank", F.rank().over(Window.partitionBy("known").orderBy("p")) + F.count(F.lit(1)).over(Window.partitionBy("known", "p")) - 1)
    fdr = F.when(F.col("known"), F.least(F.lit(1.0), F.min(F.col("p") * F.col("m") / F.col("rank")).over(down)))
    out = ranked.withColumn("p_fdr", fdr).join(median_interval(dev).select("manager", "lo", "hi"), "manager", "left")
    robust = (F.col("p_fdr") < level) & (F.signum("lo") == F.signum("hi")) & (F.signum("lo") == F.signum("coef"))
    return out.select("manager", "n", "coef", "se", "p", "p_fdr", "lo", "hi", F.coalesce(robust, F.lit(False)).alias("robust"))


def by_date(dev: DataFrame, dates: list[int]) -> DataFrame:
    """Median deviation, a row per manager and a column per date; a date without marks stays as an empty column."""
    return dev.groupBy("manager").agg(*[F.median(F.when(F.col("yr") == d, F.col("dev"))).alias(str(d)) for d in dates])


def issue_sample(dev: DataFrame, size: int = 40, least: int = 4) -> DataFrame:
    """Up to `size` issues of at least `least` managers to check by eye, picked by a hash of the issue so that each run draws the
    same ones: median in points and every manager's mark, lowest first. Only the picked issues gather their marks."""
    key = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ISSUE])
    large = dev.filter(F.col("k") >= least).withColumn("pick", F.md5(key.cast("binary")))
    picked = large.select("pick").distinct().orderBy("pick").limit(size)
    marks = F.transform(F.array_sort(F.collect_list(F.struct("mark", "manager"))), lambda s: F.concat_ws(":", s["manager"].cast("string"), F.bround(s["mark"] * 100).cast("bigint").cast("string")))
    rows = large.join(F.broadcast(picked), "pick", "left_semi")  # at most `size` rows
    return rows.groupBy(*ISSUE).agg((F.median("mark") * 100).alias("consensus"), F.array_join(marks, "  ").alias("marks"))

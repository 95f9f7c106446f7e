"""Holding prices, issue matching and mark dispersion."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.steps import step
from ..sources.staging import staged

#: Sides of more counted rows are shuffled instead of broadcast.
BROADCAST_ROWS = 1_000_000


@dataclass(frozen=True)
class PriceBands:
    par: tuple[float, float] = (0.5, 1.15)
    cost: tuple[float, float] = (0.4, 1.2)
    overhang: float = 2.5
    ceiling: float = 1.6


ISSUE = ["issuer", "yr", "sen", "ibps"]


def with_price(df: DataFrame, bands: PriceBands = PriceBands()) -> DataFrame:
    """Adds basis and price: par where the ratio is plausible and par is no overhang over cost, else cost, else par."""
    by_par = F.when(F.col("par") > 0, F.col("fv") / F.nullif("par", F.lit(0.0)))
    by_cost = F.when(F.col("cost") > 0, F.col("fv") / F.nullif("cost", F.lit(0.0)))
    overhang = F.coalesce((F.col("par") > 0) & (F.col("cost") > 0) & (F.col("par") > bands.overhang * F.col("cost")), F.lit(False))
    basis = F.when(by_par.between(*bands.par) & ~overhang, "par").when(by_cost.between(*bands.cost), "cost").when(by_par.between(*bands.par), "par")
    price = F.when(F.col("basis") == "par", by_par).when(F.col("basis") == "cost", by_cost)
    priced = step(step(df, basis=basis), price=price)
    return priced.withColumn("price", F.when((F.col("price") > 0) & (F.col("price") <= bands.ceiling), F.col("price")))


# Instrument types that are no debt, and those that may be undrawn.
EQUITY_TYPES = ("Equity", "Preferred", "Common Equity", "Warrant")
UNFUNDED_TYPES = ("Revolver", "Delayed Draw Term Loan")


def hold_class(instrument_type: Column, price: Column) -> Column:
    """equity by its type, unfunded by its type and for want of a price, else debt."""
    return F.when(instrument_type.isin(*EQUITY_TYPES), "equity").when(price.isNull() & instrument_type.isin(*UNFUNDED_TYPES), "unfunded").otherwise("debt")


def spread_bps(spread: Column) -> Column:
    """Basis points to the nearest five, halves to even."""
    return (F.bround(spread * 10000 / 5) * 5).cast("int")


def maturity_year(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(19|20)\d{2}", 0), F.lit("")).try_cast("int")


def comparison_price(price: Column, klass: Column) -> Column:
    """The price that may enter a comparison: of debt, 0.30 to 1.10; above that accrued interest is in the value."""
    return F.when((klass == "debt") & price.between(0.3, 1.10), price)


def with_issue(df: DataFrame, counted: bool = False) -> DataFrame:
    """Adds hold_class, cmp_price, mat_year and ibps to (issuer, yr, sen, bps, instrument_type, maturity, price). Only debt is
    in an issue: a holding without spread joins the only spread that debt of its issuer, date and seniority has, if there is
    just one. The spreads of a seniority are aggregated and joined, so no issuer is gathered in one place. counted: the spreads are
    staged and counted first, so that few of them shuffle no holdings; for a df that is cheap to read twice."""
    typed = step(df, hold_class=hold_class(F.col("instrument_type"), F.col("price")), mat_year=maturity_year(F.col("maturity").cast("string")))
    typed = typed.withColumn("cmp_price", comparison_price(F.col("price"), F.col("hold_class")))
    spreads = typed.filter((F.col("hold_class") == "debt") & F.col("bps").isNotNull()).groupBy(F.col("issuer").alias("i"), F.col("yr").alias("y"), F.col("sen").alias("s"))
    sole = spreads.agg(F.min("bps").alias("lo"), F.max("bps").alias("hi")).filter("lo = hi").select("i", "y", "s", F.col("lo").alias("sole"))
    if counted:
        sole = staged(sole, "spreads")
        sole = F.broadcast(sole) if sole.count() <= BROADCAST_ROWS else sole
    same = F.col("issuer").eqNullSafe(F.col("i")) & F.col("yr").eqNullSafe(F.col("y")) & F.col("sen").eqNullSafe(F.col("s"))
    joined = typed.join(sole, same & F.col("bps").isNull() & (F.col("hold_class") == "debt"), "left")
    return joined.withColumn("ibps", F.when(F.col("hold_class") == "debt", F.coalesce("bps", "sole"))).drop("i", "y", "s", "sole")


def issue_id(issuer: Column, sen: Column, ibps: Column, date: Column) -> Column:
    text = lambda c, none: F.coalesce(c.cast("string"), F.lit(none))
    return F.concat_ws("|", issuer, text(sen, "None"), text(ibps, "nospread"), date.cast("string"))


def bucket(value: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed buckets: edges[i] < value <= edges[i + 1]; outside all is null."""
    out = None
    for lo, hi, label in zip(edges, edges[1:], labels, strict=False):
        test = (value > lo) & (value <= hi)
        out = F.when(test, label) if out is None else out.when(test, label)
    return out


def _lots(matched: DataFrame) -> DataFrame:
    """A fund's lots of an issue as one row; the mark is the median of their comparable prices. Up to two prices it lies
    between the least and the largest, which a hash aggregate holds; only the few others gather their prices."""
    keys = [*ISSUE, "fund"]
    debt = matched.filter("hold_class = 'debt'").select(*keys, "manager", "cmp_price", "fv")
    ends = debt.groupBy(*keys).agg(
        F.any_value("manager").alias("manager"), F.min("cmp_price").alias("lo"), F.max("cmp_price").alias("hi"), F.count("cmp_price").alias("lots"),
        F.sum(F.when(F.col("cmp_price").isNotNull(), F.col("fv"))).alias("fv"),
    )
    other = [F.col(k).alias(f"__{k}") for k in keys]
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    several = ends.filter("lots > 2").select(*other)
    medians = debt.join(several, same, "left_semi").groupBy(*other).agg(F.median("cmp_price").alias("__mark"))
    joined = ends.join(medians, same, "left")
    return joined.select(*keys, "manager", F.coalesce("__mark", (F.col("lo") + F.col("hi")) / 2).alias("mark"), "lots", "fv")


def fund_marks(matched: DataFrame) -> DataFrame:
    """A fund's lots of an issue as one median mark, of funds with a comparable price."""
    return _lots(matched).filter("mark is not null")


def issue_stats(matched: DataFrame, trim: float = 0.25) -> DataFrame:
    """Per issue: holders, priced or not; marks and their dispersion, without those further than trim from the median; the
    maturities that holders state, which conflict if there are several."""
    lots = _lots(matched)
    med = F.median("mark").over(Window.partitionBy(*ISSUE))  # a row per fund
    clean = F.when(F.abs(F.col("mark") - F.col("med")) <= trim, F.col("mark"))
    stats = lots.withColumn("med", med).groupBy(*ISSUE).agg(
        F.count(F.lit(1)).alias("holders"), F.count("mark").alias("n_prices"), F.any_value("med").alias("med"), F.count(clean).alias("n_clean"),
        F.min(clean).alias("lo"), F.max(clean).alias("hi"), F.stddev_samp(clean).alias("sd"), F.min("mark").alias("raw_lo"), F.max("mark").alias("raw_hi"),
    )
    stated = matched.filter("hold_class = 'debt' and mat_year is not null").select(*ISSUE, "mat_year").distinct()
    years = stated.groupBy(*[F.col(c).alias(f"__{c}") for c in ISSUE]).agg(F.array_sort(F.collect_list("mat_year")).alias("years"))
    stats = stats.join(years, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in ISSUE], "left").drop(*[f"__{c}" for c in ISSUE])
    stats = stats.withColumn("years", F.coalesce("years", F.array().cast("array<int>")))
    tier = confidence(F.col("holders"), F.col("sen"), F.col("ibps"), F.size("years") > 1)
    return stats.withColumn("mat_conflict", F.size("years") > 1).withColumn("tier", tier).withColumn("years", F.nullif(F.array_join("years", ";"), F.lit("")))


def confidence(holders: Column, sen: Column, bps: Column, years_conflict: Column) -> Column:
    """Single below two holders; High with spread, seniority, one maturity at most and no more than 15 holders; Medium with a
    spread; else Low."""
    return F.when(holders < 2, "Single").when(bps.isNotNull() & sen.isNotNull() & ~years_conflict & (holders <= 15), "High").when(bps.isNotNull(), "Medium").otherwise("Low")


def stance(points: Column, band: float = 1.0) -> Column:
    return bucket(points, [float("-inf"), -band, band, float("inf")], ["Cheap", "In line", "Rich"])

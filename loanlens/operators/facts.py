"""Tagged facts as filing records: scalars, class maps, fair-value levels, the schedule of holdings, derived metrics.

facts: accession_no, row_no, concept, label, period_type ('instant' or 'duration'), period_instant, period_start, period_end (dates),
numeric_value double, value string, decimals string, dims map<string,string> (axis -> member; empty: undimensioned).
filings: accession_no, reporting_date, target_months (12 or 3). concepts: field, concept, priority; a fixed list, so it is broadcast.
Everything is a grouped aggregate on accession_no first, so one shuffle of the facts serves each operator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AFFILIATION_AXIS = "us-gaap:InvestmentIssuerAffiliationAxis"
CLASS_AXIS = "us-gaap:StatementClassOfStockAxis"
LEVEL_AXIS = "us-gaap:FairValueByFairValueHierarchyLevelAxis"
HOLDING_AXIS = "us-gaap:InvestmentIdentifierAxis"

# fmt: off
# Concepts of a holding and of the fair-value levels.
ADDITIVE = {
    "us-gaap:InvestmentOwnedAtFairValue": "fair_value", "us-gaap:InvestmentOwnedAtCost": "cost", "us-gaap:InvestmentOwnedBalancePrincipalAmount": "principal",
    "us-gaap:InvestmentOwnedBalanceShares": "shares", "us-gaap:InvestmentCompanyFinancialCommitmentToInvesteeFutureAmount": "commitment",
}
FIRST_NUMBER = {
    "us-gaap:InvestmentInterestRate": "rate", "us-gaap:InvestmentBasisSpreadVariableRate": "spread", "us-gaap:InvestmentInterestRatePaidInKind": "pik_rate",
    "us-gaap:InvestmentInterestRateFloor": "floor", "us-gaap:InvestmentOwnedPercentOfNetAssets": "pct_na",
}
FIRST_TEXT = {
    "us-gaap:InvestmentMaturityDate": "maturity", "us-gaap:InvestmentVariableInterestRateTypeExtensibleEnumeration": "reference_rate",
    "us-gaap:InvestmentAcquisitionDate": "acquisition_date",
}
LEVEL_CONCEPTS = ["us-gaap:InvestmentOwnedAtFairValue", "us-gaap:InvestmentsFairValueDisclosure"]
LEVELS = {
    "FairValueInputsLevel1Member": "level_1", "FairValueInputsLevel2Member": "level_2", "FairValueInputsLevel3Member": "level_3",
    "FairValueMeasuredAtNetAssetValuePerShareMember": "at_nav",
}
UNDRAWN = "us-gaap:LineOfCreditFacilityRemainingBorrowingCapacity"
# fmt: on


def ratio(num: Column, den: Column) -> Column:
    return num / F.nullif(den, F.lit(0.0))


def _at_date(facts: DataFrame, filings: DataFrame, concepts: list[str] | None = None) -> DataFrame:
    own = facts.filter((F.col("period_type") == "instant") & F.col("numeric_value").isNotNull())
    own = own.filter(F.col("concept").isin(concepts)) if concepts else own
    return own.join(filings, "accession_no").filter(F.col("period_instant") == F.col("reporting_date"))


def _first(column: str | Column, *order: Column | str) -> Column:
    return F.min_by(column, F.struct(*order))


def _by_field(rows: DataFrame) -> DataFrame:
    """(accession_no, field, priority, fact) -> the fact of the first concept that has a value."""
    known = rows.filter("fact.value is not null")
    return known.groupBy("accession_no", "field").agg(F.min_by("fact", "priority").alias("fact")).select("accession_no", "field", "fact.*")


def _fact(value: Column | str, confidence: float | Column, raw: Column | str) -> Column:
    value, raw = (F.col(c) if isinstance(c, str) else c for c in (value, raw))
    return F.struct(value.alias("value"), F.lit("xbrl").alias("source"), (F.lit(confidence) if isinstance(confidence, float) else confidence).alias("confidence"), raw.alias("raw_text"))


def _latest(facts: DataFrame, filings: DataFrame, concepts: DataFrame) -> DataFrame:
    """One undimensioned instant fact a concept: at the reporting date, else the latest."""
    rows = facts.filter((F.size("dims") == 0) & (F.col("period_type") == "instant")).join(F.broadcast(concepts), "concept").join(filings, "accession_no")
    other = ~F.coalesce(F.col("period_instant") == F.col("reporting_date"), F.lit(False))
    pick = _first(F.struct("numeric_value", "label"), other, -F.coalesce(F.unix_date("period_instant"), F.lit(-1000000)), "row_no")
    return rows.groupBy("accession_no", "field", "concept", "priority").agg(pick.alias("p"))


def instants(facts: DataFrame, filings: DataFrame, concepts: DataFrame) -> DataFrame:
    """Balance-sheet scalars: the first concept with a value."""
    return _by_field(_latest(facts, filings, concepts).select("accession_no", "field", "priority", _fact("p.numeric_value", 0.98, F.nullif("p.label", F.lit(""))).alias("fact")))


def instants_at(facts: DataFrame, dates: DataFrame, concepts: DataFrame) -> DataFrame:
    """dates (accession_no, at): values exactly at that day, for opening balances."""
    rows = facts.filter((F.size("dims") == 0) & (F.col("period_type") == "instant") & F.col("numeric_value").isNotNull()).join(F.broadcast(concepts), "concept")
    rows = rows.join(dates, "accession_no").filter(F.col("period_instant") == F.col("at"))
    best = rows.groupBy("accession_no", "field", "priority").agg(_first(F.struct("numeric_value", "label"), "row_no").alias("p"))
    return _by_field(best.select("accession_no", "field", "priority", _fact("p.numeric_value", 0.95, "p.label").alias("fact")))


def summed(facts: DataFrame, filings: DataFrame, concepts: DataFrame) -> DataFrame:
    """Several instants of a field added up (cash and its equivalents)."""
    short = F.element_at(F.split("concept", ":"), -1)
    parts = _latest(facts, filings, concepts).filter("p.numeric_value is not null")
    named = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("priority", short.alias("n")))), lambda s: s["n"]), " + ")
    return parts.groupBy("accession_no", "field").agg(_fact(F.sum("p.numeric_value"), 0.95, named).alias("fact")).select("accession_no", "field", "fact.*")


def durations(facts: DataFrame, filings: DataFrame, concepts: DataFrame, axis: str = AFFILIATION_AXIS, confidence: tuple[float, float] = (0.97, 0.95)) -> DataFrame:
    """Flows that end at the reporting date, of the length nearest to the target: the undimensioned fact of a concept, else
    the sum over the members of one axis (each member once), else the next concept."""
    months = F.bround(F.datediff("period_end", "period_start") / 30.44)
    rows = facts.filter((F.col("period_type") == "duration") & F.col("numeric_value").isNotNull() & F.col("period_start").isNotNull()).join(F.broadcast(concepts), "concept")
    rows = rows.join(filings, "accession_no").filter(F.col("period_end") == F.col("reporting_date")).withColumn("off", F.abs(months - F.col("target_months")))
    rows = rows.withColumn("member", F.when(F.size("dims") == 1, F.get(F.map_values("dims"), F.lit(0)))).filter((F.size("dims") == 0) | ((F.size("dims") == 1) & F.map_contains_key("dims", axis)))
    key = ["accession_no", "field", "concept", "priority"]
    once = rows.groupBy(*key, "off", "member").agg(_first(F.struct("numeric_value", "label"), "row_no").alias("p"))
    plain, split = F.col("member").isNull(), F.col("member").isNotNull()
    by_off = once.groupBy(*key, "off").agg(F.max(F.when(plain, F.col("p"))).alias("p"), F.sum(F.when(split, F.col("p.numeric_value"))).alias("total"))
    best = by_off.groupBy(*key).agg(F.min_by("p", F.when(F.col("p").isNotNull(), F.col("off"))).alias("p"), F.min_by("total", F.when(F.col("total").isNotNull(), F.col("off"))).alias("total"))
    whole = F.col("p").isNotNull()
    value = F.when(whole, F.col("p.numeric_value")).otherwise(F.col("total"))
    raw = F.when(whole, F.col("p.label")).otherwise(F.concat(F.element_at(F.split("concept", ":"), -1), F.lit(" (sum over members)")))
    return _by_field(best.select("accession_no", "field", "priority", _fact(value, F.when(whole, confidence[0]).otherwise(confidence[1]), raw).alias("fact")))


def class_label(member: Column) -> Column:
    """'x:CommonClassIMember' -> 'I'; combined members have none."""
    out = F.element_at(F.split(member, ":"), -1)
    for word in ("CommonClass", "Class", "CommonStock", "Common", "Shares", "Share", "Member", "Stock"):
        out = F.replace(out, F.lit(word), F.lit(""))
    out = F.nullif(F.trim(out), F.lit(""))
    return F.when(~F.lower(out).contains("and"), out)


def per_class(facts: DataFrame, filings: DataFrame, concepts: DataFrame) -> DataFrame:
    """(accession_no, field, class_label, value) from facts whose only axis is the share class; the first concept that yields
    any class gives them all."""
    rows = _at_date(facts.withColumn("period_type", F.lit("instant")), filings).filter((F.size("dims") == 1) & F.map_contains_key("dims", CLASS_AXIS)).join(F.broadcast(concepts), "concept")
    rows = rows.withColumn("class_label", class_label(F.get(F.map_values("dims"), F.lit(0)))).filter("class_label is not null")
    first = rows.groupBy("accession_no", "field", "priority", "class_label").agg(_first("numeric_value", "row_no").alias("value"))
    won = F.min("priority").over(Window.partitionBy("accession_no", "field"))
    return first.withColumn("won", won).filter("priority = won").select("accession_no", "field", "class_label", "value")


def undrawn(facts: DataFrame, filings: DataFrame, concept: str = UNDRAWN) -> DataFrame:
    """Undrawn capacity: the undimensioned figure, else the largest sum of distinct members over one set of axes, as the
    same total is tagged again under finer sets."""
    rows = _at_date(facts, filings, [concept]).withColumn("axes", F.array_join(F.array_sort(F.map_keys("dims")), ",")).withColumn("members", F.array_sort(F.map_entries("dims")))
    once = rows.groupBy("accession_no", "axes", "members").agg(_first("numeric_value", "row_no").alias("v"), F.min("row_no").alias("row_no"))
    sets = once.groupBy("accession_no", "axes").agg(F.sum("v").alias("total"))
    return sets.groupBy("accession_no").agg(F.max(F.when(F.col("axes") == "", F.col("total"))).alias("whole"), F.max("total").alias("largest"), F.count(F.lit(1)).alias("sets")).select(
        "accession_no", F.coalesce("whole", "largest").alias("value"), F.when(F.col("whole").isNotNull(), 0.97).otherwise(0.90).alias("confidence"), "sets"
    )


def levels(facts: DataFrame, filings: DataFrame, totals: DataFrame) -> DataFrame:
    """(accession_no, level_1, level_2, level_3, at_nav). A level is its own total, else the sum of its breakdown by one more
    axis, which is kept only if all levels reconcile to the total. A gap is filled by the NAV figure if that closes it.
    totals: (accession_no, total); a null total checks nothing."""
    rows = _at_date(facts, filings, LEVEL_CONCEPTS).filter(F.map_contains_key("dims", LEVEL_AXIS)).withColumn("member", F.col("dims")[LEVEL_AXIS])
    level = F.when(F.lit(False), F.lit(None).cast("string"))
    for suffix, name in LEVELS.items():
        level = level.when(F.col("member").endswith(suffix), name)
    prio = F.array_position(F.array(*[F.lit(c) for c in LEVEL_CONCEPTS]), F.col("concept"))
    rows = rows.withColumn("level", level).withColumn("priority", prio).filter("level is not null").withColumn("n", F.size("dims"))
    per = rows.groupBy("accession_no", "priority", "level").agg(
        F.min_by("numeric_value", F.when(F.col("n") == 1, F.col("row_no"))).alias("own"), F.sum(F.when(F.col("n") == 2, F.col("numeric_value"))).alias("parts")
    ).filter("own is not null or parts is not null")
    wide = per.groupBy("accession_no", "priority").agg(
        *[F.max(F.when(F.col("level") == n, F.coalesce("own", "parts"))).alias(n) for n in LEVELS.values()], F.bool_or(F.col("own").isNull()).alias("from_parts")
    )
    names = list(LEVELS.values())
    best = wide.groupBy("accession_no").agg(F.min_by(F.struct(*names, "from_parts"), "priority").alias("b")).select("accession_no", "b.*")
    out = best.join(totals, "accession_no", "left").join(nav_figure(facts, filings), "accession_no", "left")
    added = sum((F.coalesce(n, F.lit(0.0)) for n in names[1:]), F.coalesce(names[0], F.lit(0.0)))
    band = F.greatest(F.abs("total") * 0.001, F.lit(1000.0))
    plug = F.col("at_nav").isNull() & (added < F.col("total") - band) & (F.abs(added + F.col("nav") - F.col("total")) <= band)
    out = out.withColumn("at_nav", F.when(plug, F.col("nav")).otherwise(F.col("at_nav")))
    return out.filter(~F.coalesce(F.col("from_parts") & (F.abs(added - F.col("total")) > F.greatest(F.abs("total") * 0.005, F.lit(1000.0))), F.lit(False))).select("accession_no", *names)


def nav_figure(facts: DataFrame, filings: DataFrame) -> DataFrame:
    """(accession_no, nav): what is measured at net asset value, on the level axis or as a line of its own."""
    rows = _at_date(facts, filings)
    on_axis = (F.size("dims") == 1) & F.coalesce(F.col("dims")[LEVEL_AXIS].contains("NetAssetValue"), F.lit(False)) & F.col("concept").isin("us-gaap:AlternativeInvestment", LEVEL_CONCEPTS[0])
    line = (F.size("dims") == 0) & F.col("concept").contains("MeasuredAtNetAssetValue")
    return rows.filter(on_axis | line).groupBy("accession_no").agg(_first("numeric_value", F.when(on_axis, 0).otherwise(1), "row_no").alias("nav"))


def rate_label(uri: Column) -> Column:
    word = F.replace(F.element_at(F.split(uri, "#"), -1), F.lit("Member"), F.lit(""))
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for needle, label in (("sofr", "SOFR"), ("euribor", "EURIBOR"), ("libor", "LIBOR"), ("prime", "PRIME"), ("base", "BASE")):
        out = out.when(F.lower(word).contains(needle), label)
    return out.otherwise(F.coalesce(F.nullif(word, F.lit("")), uri))


def schedule(facts: DataFrame, filings: DataFrame) -> DataFrame:
    """One row per holding at the reporting date: amounts are summed, rates and texts are the first that are given."""
    wanted = {**ADDITIVE, **FIRST_NUMBER, **FIRST_TEXT}
    own = facts.filter((F.col("period_type") == "instant") & F.map_contains_key("dims", HOLDING_AXIS) & F.col("concept").isin(list(wanted)))
    rows = own.join(filings, "accession_no").filter(F.col("period_instant") == F.col("reporting_date")).withColumn("member", F.col("dims")[HOLDING_AXIS])
    is_ = lambda c: F.col("concept") == c
    text = F.nullif(F.trim("value"), F.lit(""))
    fv = is_(LEVEL_CONCEPTS[0]) & F.col("numeric_value").isNotNull()
    out = rows.groupBy("accession_no", "member").agg(
        *[F.sum(F.when(is_(c), F.col("numeric_value"))).alias(n) for c, n in ADDITIVE.items()],
        *[F.min_by("numeric_value", F.when(is_(c) & F.col("numeric_value").isNotNull(), F.col("row_no"))).alias(n) for c, n in FIRST_NUMBER.items()],
        *[F.min_by(text, F.when(is_(c) & text.isNotNull(), F.col("row_no"))).alias(n) for c, n in FIRST_TEXT.items()],
        F.min_by(F.coalesce("decimals", F.lit("none")), F.when(fv, F.col("row_no"))).alias("decimals"),
    )
    halves = F.split("member", r" \| ", 2)
    return out.withColumn("reference_rate", F.when(F.col("reference_rate").isNotNull(), rate_label(F.col("reference_rate")))).withColumn("issuer", F.trim(halves[0])).withColumn(
        "affiliation", F.nullif(F.trim(F.get(halves, F.lit(1))), F.lit(""))
    )


def one_scale(holdings: DataFrame, totals: DataFrame, band: float = 0.05) -> DataFrame:
    """Drops a minority group of `decimals` if the rest then lands within band of the filing's total; otherwise all stay.
    totals: (accession_no, total). Of several groups that would do, the lowest is dropped."""
    groups = holdings.groupBy("accession_no", "decimals").agg(F.sum("fair_value").alias("fv"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("accession_no")  # a row per scale
    all_fv, all_n = F.sum("fv").over(w), F.sum("n").over(w)
    near = lambda v: F.abs(v / F.col("total") - 1) <= band
    seen = groups.join(totals.filter("total > 0"), "accession_no").withColumn("all_fv", all_fv).withColumn("all_n", all_n).withColumn("scales", F.count("decimals").over(w))
    bad = seen.filter((F.col("all_fv") > 0) & ~near(F.col("all_fv")) & (F.col("scales") >= 2) & F.col("decimals").isNotNull() & (F.col("n") < F.col("all_n") - F.col("n")) & near(F.col("all_fv") - F.coalesce("fv", F.lit(0.0))))
    drop = bad.groupBy("accession_no").agg(F.min("decimals").alias("dropped"))
    return holdings.join(drop, "accession_no", "left").filter(~F.coalesce(F.col("decimals") == F.col("dropped"), F.lit(False))).drop("dropped")


def is_affiliated(label: Column) -> Column:
    return F.coalesce(F.lower(label).contains("affiliat") & ~F.lower(label).contains("non-affiliat"), F.lit(False))


def summary(holdings: DataFrame, totals: DataFrame, over: float = 1.25, under: float = 0.70, affiliation: float = 0.5, yields: float = 0.60) -> DataFrame:
    """A filing's schedule as shares and weighted means. All is null where holdings do not fit the balance sheet."""
    top = F.row_number().over(Window.partitionBy("accession_no").orderBy(F.desc_nulls_last("fair_value"), "member"))
    fv = F.col("fair_value")
    share = lambda test: F.coalesce(F.sum(F.when(test, fv)), F.lit(0.0)) / F.nullif(F.sum(fv), F.lit(0.0))
    usable = lambda c: (F.col(c) > 0) & (F.col(c) < 1) & fv.isNotNull()
    mean = lambda c: F.sum(F.when(usable(c), fv * F.col(c))) / F.nullif(F.sum(F.when(usable(c), fv)), F.lit(0.0))
    pik = F.coalesce(F.col("pik_rate") != 0, F.lit(False))
    out = holdings.withColumn("top", top).groupBy("accession_no").agg(
        F.sum("fair_value").alias("held"), F.count("fair_value").cast("double").alias("num_holdings"), (F.count_if(pik) / F.nullif(F.count("fair_value"), F.lit(0))).alias("pct_pik"),
        share(F.col("top") <= 10).alias("top_10"), share(F.col("spread").isNotNull()).alias("pct_floating"), share(pik).alias("pct_pik_weighted"),
        F.when(share(F.col("affiliation").isNotNull()) >= affiliation, share(is_affiliated(F.col("affiliation")))).alias("pct_affiliated"), mean("spread").alias("mean_spread"),
        F.when(share(usable("rate")) >= yields, mean("rate")).alias("mean_yield"), F.sum("commitment").alias("unfunded"),
    ).join(totals, "accession_no", "left")
    covered = ratio(F.col("held"), F.col("total"))
    gate = ~F.coalesce((F.col("held") != 0) & ((covered >= over) | (covered < under)), F.lit(False))
    return out.select("accession_no", *[F.when(gate, F.col(c)).alias(c) for c in out.columns if c not in ("accession_no", "held", "total")])


def derived(record: DataFrame) -> DataFrame:
    """Adds the metrics that follow from a flat record; a missing input or a zero divisor leaves them null."""
    c = F.col
    return record.withColumns({
        "leverage_ratio": ratio(c("total_debt"), c("total_net_assets")), "net_debt": c("total_debt") - c("cash_and_equivalents"),
        "asset_coverage": ratio(c("total_assets") - (c("total_liabilities") - c("total_debt")), c("total_debt")),
        "portfolio_mark": ratio(c("investments_at_fair_value"), c("investments_at_cost")), "pik_income_ratio": ratio(c("pik_interest_income"), c("total_investment_income")),
        "distribution_coverage": ratio(c("net_investment_income"), c("distributions_declared")), "liquidity_coverage": ratio(c("cash_and_equivalents") + c("undrawn"), c("unfunded")),
        "return_of_capital_pct": ratio(c("return_of_capital"), F.abs(c("distributions_declared"))),
    })


def calculated(record: DataFrame, holdings: DataFrame, key: list[str], levels: tuple[str, ...] = ("level_1", "level_2", "level_3", "at_nav")) -> DataFrame:
    """record with fair values by level, fv_total, yield, weighted_avg_interest_rate and investments_at_fair_value, holdings with fair_value: adds each
    level's share of the total, the spread of yield over cost of debt, and the holdings' sum over the record's investments."""
    held = holdings.groupBy(*key).agg(F.sum("fair_value").alias("__held"))
    shares = {f"{name}_pct": ratio(F.col(name), F.col("fv_total")) for name in levels}
    more = {"net_spread": F.col("yield") - F.col("weighted_avg_interest_rate"), "holdings_over_tagged": ratio(F.col("__held"), F.col("investments_at_fair_value"))}
    return record.join(held, key, "left").withColumns(shares | more).drop("__held")

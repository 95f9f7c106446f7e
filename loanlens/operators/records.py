"""A filing's record from its tagged facts: every field of the concept table, fair values by level, derived metrics, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.concepts import FIELDS
from ..functions.numbers import larger_split
from . import facts as X
from .rules import record_checks, validated

LONG = ["accession_no", "field", "value", "source", "confidence", "raw_text"]
#: Fields in reading order, each once. The parts of the tax only serve its total.
NAMES = [f for f in dict.fromkeys(f for _, _, f, _ in FIELDS) if f not in ("current_tax", "deferred_tax")]
#: Fields whose duration tells where the period starts, in this order.
PERIOD_FIELDS = ("total_investment_income", "net_investment_income")


def concept_table(spark: SparkSession) -> DataFrame:
    """(section, kind, field, concept, priority); a fixed list, so it may be broadcast."""
    rows = [(section, kind, field, c, k) for section, kind, field, concepts in FIELDS for k, c in enumerate(concepts)]
    return spark.createDataFrame(rows, "section string, kind string, field string, concept string, priority int")


def _of(table: DataFrame, *kinds: str) -> DataFrame:
    return table.filter(F.col("kind").isin(*kinds)).select("field", "concept", "priority")


def field_facts(facts: DataFrame, filings: DataFrame) -> DataFrame:
    """facts (see facts.py), filings (accession_no, reporting_date, target_months) -> (accession_no, field, value, source,
    confidence, raw_text), a row per field that a filing tags. Facts of other concepts are dropped before any shuffle."""
    table = concept_table(facts.sparkSession)
    known = facts.join(F.broadcast(table.select("concept").distinct()), "concept", "left_semi")
    ways = [
        X.instants(known, filings, _of(table, "instant", "either")), X.durations(known, filings, _of(table, "duration", "either")),
        X.durations(known, filings, _of(table, "classes"), X.CLASS_AXIS, (0.96, 0.93)), X.summed(known, filings, _of(table, "sum")),
    ]
    spare = X.undrawn(facts, filings).select("accession_no", F.lit("undrawn").alias("field"), "value", F.lit("xbrl").alias("source"), "confidence", F.lit(None).cast("string").alias("raw_text"))
    every = spare.withColumn("way", F.lit(len(ways)))
    for k, way in enumerate(ways):
        every = every.unionByName(way.select(*LONG).withColumn("way", F.lit(k)))
    best = every.groupBy("accession_no", "field").agg(F.min_by(F.struct(*LONG[2:]), "way").alias("f")).select("accession_no", "field", "f.*")
    return _with_tax(best)


def _with_tax(found: DataFrame) -> DataFrame:
    """Current plus deferred tax replaces a tax that is missing or smaller in size."""
    at = lambda name: F.max(F.when(F.col("field") == name, F.col("value")))
    taxes = found.filter(F.col("field").isin("income_tax_expense", "current_tax", "deferred_tax")).groupBy("accession_no").agg(at("income_tax_expense").alias("t"), at("current_tax").alias("c"), at("deferred_tax").alias("d"))
    total = larger_split(F.col("t"), F.col("c"), F.col("d"))
    split = taxes.filter(~total.eqNullSafe(F.col("t"))).select(
        "accession_no", F.lit("income_tax_expense").alias("field"), total.alias("value"), F.lit("xbrl").alias("source"), F.lit(0.95).alias("confidence"), F.lit("Current + Deferred income tax").alias("raw_text")
    )
    rest = found.filter(~F.col("field").isin("current_tax", "deferred_tax")).join(split.select("accession_no", "field"), ["accession_no", "field"], "left_anti")
    return rest.select(*LONG).unionByName(split)


def period_starts(facts: DataFrame, filings: DataFrame) -> DataFrame:
    """(accession_no, period_start): where the undimensioned income of the length nearest to the target begins."""
    order = [(c, k) for k, c in enumerate(dict.fromkeys(c for name in PERIOD_FIELDS for _, _, f, concepts in FIELDS if f == name for c in concepts))]
    table = facts.sparkSession.createDataFrame(order, "concept string, priority int")
    rows = facts.filter((F.size("dims") == 0) & (F.col("period_type") == "duration") & F.col("numeric_value").isNotNull() & F.col("period_start").isNotNull())
    rows = rows.join(F.broadcast(table), "concept").join(filings, "accession_no").filter(F.col("period_end") == F.col("reporting_date"))
    off = F.abs(F.bround(F.datediff("period_end", "period_start") / 30.44) - F.col("target_months"))
    return rows.groupBy("accession_no").agg(F.min_by("period_start", F.struct("priority", off, "row_no")).alias("period_start"))


def records(facts: DataFrame, filings: DataFrame, unfunded: DataFrame | None = None) -> DataFrame:
    """One wide row per filing, whether or not it tags anything: fields, fair values by level, net assets at both ends of the
    period, derived metrics, checks and status. unfunded (accession_no, unfunded) comes from the schedule of investments."""
    long = field_facts(facts, filings)
    wide = long.groupBy("accession_no").pivot("field", [*NAMES, "undrawn"]).agg(F.first("value"))
    by_level = X.levels(facts, filings, wide.select("accession_no", F.col("investments_at_fair_value").alias("total")))
    starts = period_starts(facts, filings)
    equity = _of(concept_table(facts.sparkSession), "instant").filter("field = 'total_net_assets'")
    opening = X.instants_at(facts, starts.select("accession_no", F.date_sub("period_start", 1).alias("at")), equity).select("accession_no", F.col("value").alias("opening_net_assets"))
    none = facts.sparkSession.createDataFrame([], "accession_no string, unfunded double")
    out = filings.join(wide, "accession_no", "left")
    for part in (by_level, starts, opening, unfunded if unfunded is not None else none):
        out = out.join(part, "accession_no", "left")
    levelled = F.coalesce(*[F.col(c) for c in X.LEVELS.values()]).isNotNull()
    out = out.withColumn("fv_total", F.when(levelled, F.col("investments_at_fair_value"))).withColumn("closing_net_assets", F.col("total_net_assets"))
    return validated(X.derived(out), record_checks())

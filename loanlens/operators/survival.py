"""Entity census and survival."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def census(births: DataFrame, deaths: DataFrame, today: str) -> DataFrame:
    """births, deaths (key, name, date) -> a row per key with earliest birth, latest death, status, lifespan in years
    and whether the birth was not seen."""
    b = births.groupBy("key").agg(F.min("date").alias("born"), F.min_by("name", "date").alias("birth_name"))
    d = deaths.groupBy("key").agg(F.max("date").alias("died"), F.max_by("name", "date").alias("death_name"))
    end = F.coalesce("died", F.lit(today).cast("date"))
    return b.join(d, "key", "full_outer").select(
        "key", F.coalesce("birth_name", "death_name").alias("name"), "born", "died", F.when(F.col("died").isNull(), "active").otherwise("dead").alias("status"),
        (F.datediff(end, F.col("born")) / 365.25).alias("years"), F.col("born").isNull().alias("left_censored"),
    )


def yearly(c: DataFrame, first: int, last: int) -> DataFrame:
    """Births, deaths, net, active entities and churn for every year of the range. Entities whose birth was not seen are active
    from before it; churn is the deaths of a year per entity active at its start, 0 if there was none."""
    spine = c.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("year"))
    born = c.groupBy(F.year("born").alias("year")).agg(F.count(F.lit(1)).alias("births"))
    died = c.groupBy(F.year("died").alias("year")).agg(F.count(F.lit(1)).alias("deaths"))
    flow = spine.join(born, "year", "left").join(died, "year", "left").na.fill(0)
    stock = c.agg(F.count_if("left_censored").alias("stock"))  # one row
    flow = flow.withColumn("net", F.col("births") - F.col("deaths")).crossJoin(F.broadcast(stock))
    flow = flow.withColumn("active", F.col("stock") + F.sum("net").over(Window.orderBy("year")))  # a row per year
    before = F.col("active") - F.col("net")
    return flow.withColumn("churn", F.when(before != 0, F.col("deaths") / before).otherwise(0.0)).drop("stock")


def kaplan_meier(c: DataFrame) -> DataFrame:
    """(t, deaths, at_risk, survival) at each whole year of age with known birth."""
    age = c.filter("born is not null").select(F.floor("years").cast("int").alias("t"), (F.col("status") == "dead").cast("int").alias("dead"))
    by = age.groupBy("t").agg(F.sum("dead").alias("deaths"), F.count(F.lit(1)).alias("n"))
    risk = by.withColumn("at_risk", F.sum("n").over(Window.orderBy(F.desc("t"))))  # a row per year of age
    step = Window.orderBy("t")
    gone = F.max((F.col("deaths") == F.col("at_risk")).cast("int")).over(step)
    logs = F.sum(F.ln(F.when(F.col("deaths") < F.col("at_risk"), 1 - F.col("deaths") / F.col("at_risk")).otherwise(1.0))).over(step)
    return risk.select("t", "deaths", "at_risk", F.when(gone == 1, 0.0).otherwise(F.exp(logs)).alias("survival"))


def hazard(c: DataFrame) -> DataFrame:
    known = c.filter("born is not null")
    return known.agg(F.count_if(F.col("status") == "dead").alias("deaths"), F.sum(F.greatest("years", F.lit(0.0))).alias("entity_years")).withColumn("hazard", F.col("deaths") / F.nullif("entity_years", F.lit(0.0)))


def lifespan(c: DataFrame) -> DataFrame:
    """One row: observed lifespans of those both born and ended on record. Survivors are left out, so it only describes."""
    return c.filter("status = 'dead' and born is not null and years is not null").agg(
        F.count(F.lit(1)).alias("n"), F.median("years").alias("median"), F.avg("years").alias("mean"), F.min("years").alias("shortest"), F.max("years").alias("longest")
    )


def family_table(c: DataFrame) -> DataFrame:
    """c (family, status, mechanism) -> launched, alive, dead, mergers and the surviving share, largest families first."""
    out = c.groupBy("family").agg(
        F.count(F.lit(1)).alias("launched"), F.count_if(F.col("status") == "active").alias("alive"), F.count_if(F.col("status") == "dead").alias("dead"), F.count_if(F.col("mechanism") == "merger").alias("mergers")
    ).withColumn("survival", F.round(F.col("alive") / F.col("launched"), 3))
    return out.orderBy(F.desc("launched"), "survival", "family")

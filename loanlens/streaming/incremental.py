"""Additive runs: files that arrived since the last one, and appends that can be repeated."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def new_files(spark: SparkSession, folder: str, schema: T.StructType, out: str, checkpoint: str, step: Callable[[DataFrame], DataFrame] = lambda df: df, form: str = "json") -> None:
    """Runs step over the files that no earlier run with this checkpoint has seen, and appends Parquet. The checkpoint and the
    sink's log make each file count once, also when a run dies between writing and committing."""
    stream = spark.readStream.schema(schema).format(form).option("multiLine", True).load(folder) if form == "json" else spark.readStream.schema(schema).format(form).load(folder)
    step(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def append_missing(rows: DataFrame, path: str, key: list[str], version: str) -> int:
    """Appends the rows whose key the table does not hold at this code version; returns how many. A repeated run adds none."""
    spark, tagged = rows.sparkSession, rows.withColumn("code_version", F.lit(version))
    try:
        held = spark.read.schema(tagged.schema).parquet(path)
        tagged = tagged.join(held.select(*key, "code_version").distinct(), [*key, "code_version"], "left_anti").select(tagged.columns)
        before = held.count()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        before = 0
    tagged.write.mode("append").parquet(path)
    return spark.read.schema(tagged.schema).parquet(path).count() - before


def since(filings: DataFrame, state: DataFrame, default: str) -> DataFrame:
    """Filings on or after the day their entity was last checked; entities without state start at the default."""
    seen = state.groupBy("cik").agg(F.max("last_checked").alias("__seen"))
    return filings.join(seen, "cik", "left").filter(F.col("filing_date") >= F.coalesce("__seen", F.lit(default).cast("date"))).drop("__seen")


def checked(state: DataFrame, handled: DataFrame, day: str) -> DataFrame:
    """The state after a run: handled entities (cik) at the day, the others as they were."""
    now = handled.select("cik").distinct().withColumn("last_checked", F.lit(day).cast("date"))
    return now.unionByName(state.select("cik", "last_checked")).groupBy("cik").agg(F.max("last_checked").alias("last_checked")).orderBy("cik")

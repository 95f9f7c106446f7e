"""Columns that the optimiser keeps apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def step(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns behind a generator of one row: the optimiser would otherwise copy each expression into all its uses, and
    with a few steps on top of each other the generated code grows beyond what the JVM compiles."""
    return df.select("*", F.inline(F.array(F.struct(*columns.values()))).alias(*columns))

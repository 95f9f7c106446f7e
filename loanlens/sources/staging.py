"""Written intermediate tables in the folder that driver and executors share, and their removal."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_SCOPE: ContextVar[list[DataFrame] | None] = ContextVar("staged", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode, where they are one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="loanlens-"))
    return spark.sparkContext.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/loanlens/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder on any file system that Spark reaches."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: cuts lineage, survives lost executors. Inside a
    scratch() the table goes when the block ends, unless kept."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_path = path
    scope = _SCOPE.get()
    if scope is not None:
        scope.append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more."""
    scope = _SCOPE.get()
    for df in tables:
        remove(df.sparkSession, df.staged_path)
        if scope is not None:
            scope[:] = [x for x in scope if x is not df]


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Tables staged inside the block are deleted at its end, also when it fails. Those appended to the list that the
    block is given stay; they belong to the block around it, if there is one."""
    kept: list[DataFrame] = []
    own: list[DataFrame] = []
    token = _SCOPE.set(own)
    try:
        yield kept
    finally:
        _SCOPE.reset(token)
        around = _SCOPE.get()
        for df in own:
            if not any(df is k for k in kept):
                remove(df.sparkSession, df.staged_path)
            elif around is not None:
                around.append(df)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores in front until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out

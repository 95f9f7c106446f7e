"""Helpers that several training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import discard, fresh, new_path, scratch, shared_dir, staged

__all__ = ["discard", "fresh", "new_path", "scratch", "shared_dir", "staged"]

#: Words of the phrase operators: runs of ASCII digits, ASCII lower-case letters and all characters above ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def broadcast_if(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """A broadcast hint for a side whose counted rows stay within the limit; beyond it Spark shuffles (and splits skew)."""
    return F.broadcast(df) if rows <= limit else df


def text_hash(text: Column) -> Column:
    """With the doc_id it tells rows apart: rows that share both hold the same text and get the same results."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """array<string> of the lower-cased words of a text; null has none."""
    parts = F.split(lower_ascii(F.coalesce(text, F.lit(""))), WORD_SEPARATOR)
    return F.filter(parts, lambda w: w != "")


def doc_crc(doc_id: Column, modulus: int) -> Column:
    """crc32 of doc_id as text, modulo modulus; null for a null doc_id."""
    return F.crc32(doc_id.cast("string")) % modulus


#: So many rows of one hash are numbered in one task; more of them are split.
HEAVY = 10_000


def serial() -> Column:
    """A number for each row, fixed once the table is staged; gapless splits equal rows by it."""
    return F.monotonically_increasing_id().alias("__serial")


def gapless(df: DataFrame, group: str, groups: int, tie_break: Sequence[str], hash_col: str, out: str, bits: int = 12) -> DataFrame:
    """Adds `out`: 0, 1, 2, ... inside each group by ranges of hash_col, inside a range by hash_col and tie_break. df is a
    staged table with __serial; `groups` bounds the number of groups.

    No task sees a whole group: rows are ranked inside 2**bits ranges of the hash, and the counts of the ranges give each
    range its offset. Rows of one hash in large number follow the others of their range, dealt by __serial to tasks of
    HEAVY rows or so: they are copies of each other, so which one gets which number does not matter."""
    part = F.shiftrightunsigned(F.col(hash_col), 64 - bits).cast("int")
    many = staged(df.groupBy(group, hash_col).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > HEAVY), "heavy")
    n_many = many.count()  # one for HEAVY rows at most
    same = F.col(group).eqNullSafe(F.col("__group")) & (F.col(hash_col) == F.col("__hash"))
    many = many.withColumnsRenamed({group: "__group", hash_col: "__hash"})
    ranged = df.join(broadcast_if(many, n_many, 1_000_000), same, "left")
    salt = F.when(F.col("__n").isNotNull(), F.pmod(F.xxhash64("__serial"), F.ceil(F.col("__n") / HEAVY))).otherwise(F.lit(-1))
    ranged = ranged.withColumn("__range", part).withColumn("__salt", salt.cast("long")).drop("__group", "__n")
    cell = ["__range", "__hash", "__salt"]
    counts = ranged.groupBy(group, *cell).agg(F.count(F.lit(1)).alias("__count"))
    before = Window.partitionBy(group).orderBy(*cell).rowsBetween(Window.unboundedPreceding, -1)
    offsets = staged(
        counts.select(
            F.col(group).alias("__g"), F.col("__range").alias("__r"), F.col("__hash").alias("__h"), F.col("__salt").alias("__s"),
            F.coalesce(F.sum("__count").over(before), F.lit(0)).alias("__offset"),
        ), "offsets",
    )
    rank = F.row_number().over(Window.partitionBy(group, *cell).orderBy(hash_col, *tie_break))
    at = F.col(group).eqNullSafe(F.col("__g")) & (F.col("__range") == F.col("__r")) & F.col("__hash").eqNullSafe(F.col("__h")) & (F.col("__salt") == F.col("__s"))
    return (
        ranged.withColumn("__rank", rank)
        .join(broadcast_if(offsets, (groups << bits) + n_many, 1_000_000), at)
        .withColumn(out, (F.col("__offset") + F.col("__rank") - 1).cast("long"))
        .drop(*cell, "__g", "__r", "__h", "__s", "__offset", "__rank", "__serial")
    )


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


_LETTER: np.ndarray | None = None


def letter_table() -> np.ndarray:
    """For each code point up to U+FFFF whether it is a letter (Python's str.isalpha)."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(i).isalpha() for i in range(0x10000)), dtype=bool, count=0x10000)
    return _LETTER


def normalised_letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text with every run of non-letters as one space, and a space at either end."""
    points = code_points(text.lower())
    letter = letter_table()[np.minimum(points, 0xFFFF)]
    if points.size and points.max() > 0xFFFF:
        high = np.nonzero(points > 0xFFFF)[0]
        letter[high] = [chr(p).isalpha() for p in points[high]]
    points = np.where(letter, points, np.uint32(32))
    keep = np.ones(points.size, dtype=bool)
    keep[1:] = letter[1:] | letter[:-1]
    if points.size and not letter[0]:
        keep[0] = False
    body = points[keep]
    tail = [] if body.size and body[-1] == 32 else [32]
    return np.concatenate([np.array([32], np.uint32), body, np.array(tail, np.uint32)])


#: Bytes of an Arrow batch that are turned into Python objects at once.
SLICE = 1 << 22


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches in slices of about SLICE bytes, one row at least: what is made of them stays small."""
    for batch in batches:
        rows = max(1, batch.num_rows * SLICE // max(batch.nbytes, SLICE))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def pieces(text: str | None, size: int, overlap: int = 0):
    """The text cut into pieces of bounded size; each repeats the last `overlap` characters before it."""
    text = text or ""
    if len(text) <= size:
        yield text
        return
    for start in range(0, len(text), size):
        yield text[max(0, start - overlap) : start + size]

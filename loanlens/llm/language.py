"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts every n-gram of every labelled row (no sample): each task adds its rows into one hashed count array a
language and the arrays are summed in Spark. The log-probability matrix, languages x bins, has a fixed size and is
broadcast; whole batches of texts are scored with numpy gathers and segment sums.

Defined results: a text that is null, empty or has no letter is `und` with score 0; rows with a null label are not learned
from; with no labelled row at all every text is `und`; of languages with equal posterior the first by name wins; rows that
repeat count, and are predicted, each on their own; a text of any length is scored whole, in blocks; an empty table gives no
rows. Only the columns named are read, so any further columns may have any name. Memory is bounded by Arrow batches, which
Spark 4.1 cuts at spark.sql.execution.arrow.maxBytesPerBatch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import normalised_letters, pieces, sliced, staged

UNKNOWN = "und"
ORDERS = (1, 2, 3)
#: Code points scored at once.
STEP = 1 << 20


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    prior: np.ndarray  # log P(language)
    matrix: np.ndarray  # log P(bin | language), float32, bins x languages
    bits: int


def hashed(points: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """(order, bins of the n-grams that end at each position from order - 1 on)."""
    h = np.zeros(points.size, dtype=np.uint64)
    for order in range(1, max(ORDERS) + 1):
        keep = points.size - order + 1
        if keep <= 0:
            return
        h = h[: points.size] if order == 1 else h[:-1]
        h = (h + points[order - 1 :].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        if order in ORDERS:
            yield order, (h >> np.uint64(64 - bits)).astype(np.int32)
        h ^= h >> np.uint64(29)


def runs(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Code points of many texts in a row, in blocks of about STEP, and for each position the number of its text."""
    held: list[np.ndarray] = []
    owner: list[np.ndarray] = []
    size = 0
    for i, text in enumerate(texts):
        for piece in pieces(text, STEP, max(ORDERS) - 1):
            points = normalised_letters(piece)
            if points.size <= 2:
                continue
            held.append(points)
            owner.append(np.full(points.size, i, dtype=np.int32))
            size += points.size
            if size >= STEP:
                yield np.concatenate(held), np.concatenate(owner)
                held, owner, size = [], [], 0
    if held:
        yield np.concatenate(held), np.concatenate(owner)


def inside(owner: np.ndarray, order: int) -> np.ndarray:
    """Which n-grams, by end position, lie in one text; those over the edge of two belong to none."""
    return owner[order - 1 :] == owner[: owner.size - order + 1]


def train(labelled: DataFrame, bits: int = 16, smoothing: float = 0.5) -> Model:
    """labelled: (text, lang). Counts over all rows; the model has len(languages) * 2**bits numbers."""
    rows = labelled.filter("lang is not null").select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in sliced(batches):
            langs = batch.column(1).to_pylist()
            for lang in set(langs):
                texts = [t for t, x in zip(batch.column(0).to_pylist(), langs, strict=True) if x == lang]
                docs[lang] = docs.get(lang, 0) + len(texts)
                own = bins.setdefault(lang, np.zeros(1 << bits, dtype=np.int64))
                for points, owner in runs(texts):
                    for order, b in hashed(points, bits):
                        own += np.bincount(b[inside(owner, order)], minlength=own.size)
        for lang, own in bins.items():
            at = np.nonzero(own)[0]
            at, n = np.append(at, -1), np.append(own[at], docs[lang])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(n, pa.int64())], names=["lang", "bin", "n"])

    counts = staged(rows.mapInArrow(count, "lang string, bin int, n bigint").groupBy("lang", "bin").agg(F.sum("n").alias("n")), "ngrams")
    langs = sorted(r[0] for r in counts.select("lang").distinct().collect())
    if not langs:
        return Model((), np.zeros(0), np.zeros((1 << bits, 0), np.float32), bits)
    table = np.zeros((1 << bits, len(langs)))
    docs = np.zeros(len(langs))
    for i, lang in enumerate(langs):  # one language at a time: 2**bits rows at most reach the driver
        own = counts.filter(F.col("lang") == lang).select("bin", "n").toArrow()
        at, n = own.column(0).to_numpy(), own.column(1).to_numpy()
        table[at[at >= 0], i] = n[at >= 0]
        docs[i] = n[at < 0][0]
    seen = (table.sum(axis=1) > 0).sum()
    matrix = np.log((table + smoothing) / (table.sum(axis=0) + smoothing * max(seen, 1)))
    return Model(tuple(langs), np.log(docs / docs.sum()), matrix.astype(np.float32), bits)


def score_texts(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray]:
    """The likeliest language of each text and its posterior probability."""
    total, n = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts), dtype=np.int64)
    for points, owner in runs(texts):
        np.add.at(n, owner[np.r_[True, owner[1:] != owner[:-1]]], 1)
        for order, bins in hashed(points, model.bits):
            within = inside(owner, order)
            own, bins = owner[order - 1 :][within], bins[within]
            if not own.size:
                continue
            first = np.nonzero(np.r_[True, own[1:] != own[:-1]])[0]
            for k in range(len(model.languages)):
                np.add.at(total[:, k], own[first], np.add.reduceat(model.matrix[:, k][bins], first, dtype=np.float64))
    if not model.languages:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    total += model.prior
    best = total.argmax(axis=1)
    odds = np.exp(total - total.max(axis=1, keepdims=True))
    score = np.where(n > 0, 1 / odds.sum(axis=1), 0.0)
    return [model.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), n.tolist(), strict=True)], score


def tag(rows: DataFrame, model: Model, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """rows with two more columns; one of the others is text. No shuffle: every row is scored where it is read."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    at = rows.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found, p = score_texts(batch.column(at).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string()), pa.array(p, pa.float64())], names=[*batch.schema.names, lang, score])

    fields = [*rows.schema.fields, StructField(lang, StringType()), StructField(score, DoubleType())]
    return rows.mapInArrow(run, StructType(fields))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) a row per row of docs."""
    return tag(docs.select("doc_id", "text"), model).drop("text")

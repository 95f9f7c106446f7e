"""Toxicity: class-conditional Kneser-Ney models over characters.

P_c(x | h) = max(count_c(h x) - D, 0) / count_c(h) + gamma_c(h) * P(x | h'), c being toxic or ordinary, h the
characters before x and h' the same without the oldest. The lower distribution P(x | h') is shared by both classes and
built from continuation counts (in how many contexts h' x was seen, of those of all h' y), interpolated in the same way
through the shorter orders down to the single character, so a rare expression that neither class has learned weighs on
neither side. D grows with the count (0.9, 1.4, 1.8: modified Kneser-Ney).

The log-likelihood ratio of a character depends on its n-gram alone, so the model is a table of ratios by n-gram, and by
context for n-grams never seen. A text is scored by its length-normalised ratio (mean over its characters) and by the
mean of its most toxic words, each normalised by its length; a logistic curve, fitted on labelled rows that the counts
leave out, turns both into a probability.

Counts and continuation counts cover all labelled rows given and are kept by the n-gram itself, summed in Spark, so the model
is the same however the rows are dealt. The tables that are broadcast have an entry for each n-gram and context counted,
found by its 64-bit hash: they grow with the different n-grams of the labelled texts, not with the corpus.

Defined results: a null, empty or letterless text has features (0, 0, 0) and the score these get; rows without a label are
not learned from; if a class has no row the score is 0; rows that repeat count, and are scored, each on their own; texts of
any length are counted and scored whole, in pieces of bounded size (words and n-grams over an edge are seen by both); equal
word means are interchangeable; an empty table gives no rows. Only the columns named are read, so any further columns may
have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import normalised_letters, pieces, sliced, staged

ORDER = 5
STEP = 1 << 20
TOP_WORDS = 3
#: A word is as toxic as its most toxic run of so many characters.
RUN = 3
#: The logistic curve is fitted on at most so many labelled rows of each class (by hash of the text).
FIT_ROWS = 20_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Ratios:
    grams: np.ndarray  # sorted hashes of the counted n-grams
    gram: np.ndarray  # float32 by n-gram
    contexts: np.ndarray  # sorted hashes of the counted contexts
    context: np.ndarray  # float32 by context


@dataclass(frozen=True)
class Model:
    ratios: Ratios
    weights: tuple[float, ...]  # bias and one for each feature; empty: no model


def _hashes(points: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of the n characters from each position on, of those that start an n-gram."""
    p = points.astype(np.uint64) + np.uint64(1)
    size = points.size - ORDER + 1
    h = np.zeros(size, dtype=np.uint64)
    for k in range(n):
        h = (h + p[k : k + size]) * _MIX
        h ^= h >> np.uint64(31)
    return h * _MIX


def _points(text: str | None) -> Iterator[np.ndarray]:
    """Normalised letters, led by ORDER - 1 spaces so that a first word has a context."""
    for piece in pieces(text, STEP, 32):
        body = normalised_letters(piece)
        if body.size > 2:
            yield np.concatenate([np.full(ORDER - 2, 32, np.uint32), body])


def _grams(texts: list[str | None]) -> Iterator[tuple[list[str], np.ndarray]]:
    """The n-grams of the texts with their counts, in parts; those that span two texts are left out."""

    def counted(held: list[np.ndarray]) -> tuple[list[str], np.ndarray]:
        points = np.concatenate(held)
        hashes = np.concatenate([_hashes(p, ORDER) for p in held])
        offsets = np.cumsum([0, *(p.size for p in held[:-1])])
        at = np.concatenate([np.arange(p.size - ORDER + 1) + o for p, o in zip(held, offsets, strict=True)])
        _, first, n = np.unique(hashes, return_index=True, return_counts=True)
        letters = np.lib.stride_tricks.sliding_window_view(points, ORDER)[at[first]]
        joined = np.ascontiguousarray(letters, dtype="<u4").tobytes().decode("utf-32-le")
        return [joined[k : k + ORDER] for k in range(0, len(joined), ORDER)], n

    held, size = [], 0
    for text in texts:
        for points in _points(text):
            held.append(points)
            size += points.size
            if size > STEP:
                yield counted(held)
                held, size = [], 0
    if held:
        yield counted(held)


def count(labelled: DataFrame) -> DataFrame:
    """labelled (text, toxic) -> (gram, toxic_n, plain_n) summed over all rows; gram is the n-gram itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            labels = batch.column(1).to_pylist()
            texts = batch.column(0).to_pylist()
            for c in (0, 1):
                for grams, n in _grams([t for t, x in zip(texts, labels, strict=True) if x == c]):
                    for k in range(0, len(grams), 100_000):
                        own = pa.array(n[k : k + 100_000].astype(np.int64))
                        none = pa.array(np.zeros(len(own), dtype=np.int64))
                        yield pa.RecordBatch.from_arrays([pa.array(grams[k : k + 100_000]), *((own, none) if c else (none, own))], names=["gram", "toxic_n", "plain_n"])

    rows = labelled.filter("toxic is not null").select("text", F.col("toxic").cast("int").alias("toxic"))
    counted = rows.mapInArrow(run, "gram string, toxic_n bigint, plain_n bigint")
    return counted.groupBy("gram").agg(F.sum("toxic_n").alias("toxic_n"), F.sum("plain_n").alias("plain_n"))


def _discount(n: str):
    return F.when(F.col(n) <= 0, 0.0).when(F.col(n) == 1, 0.9).when(F.col(n) == 2, 1.4).otherwise(1.8)


def lower_order(counts: DataFrame) -> DataFrame:
    """(suffix, lower): P(x | h') of each suffix h' x of ORDER - 1 characters, interpolated Kneser-Ney down to the single
    character and, below it, the uniform distribution over the characters seen."""
    levels = [counts.select("gram").distinct()]
    for k in range(ORDER - 1, 0, -1):
        # in how many contexts each k characters were seen: one for each longer n-gram that ends in them
        longer = levels[-1].columns[0]
        levels.append(levels[-1].groupBy(F.substring(longer, 2, k).alias(f"s{k}")).agg(F.count(F.lit(1)).alias("cont")))
    letters = levels[-1].count() or 1
    below = None
    for k, level in enumerate(reversed(levels[1:]), 1):
        context = level.withColumn("h", F.substring(f"s{k}", 1, k - 1))
        sums = context.groupBy(F.col("h").alias("g")).agg(F.sum("cont").alias("all"), F.sum(_discount("cont")).alias("held"))
        rows = context.join(sums, F.col("h") == F.col("g"))
        if below is None:
            rows = rows.withColumn("lower", F.lit(1.0 / letters))
        else:
            rows = rows.withColumn("t", F.substring(f"s{k}", 2, k - 1)).join(below.withColumnRenamed("p", "lower"), F.col("t") == F.col("suffix"))
        p = (F.greatest(F.col("cont") - _discount("cont"), F.lit(0.0)) + F.col("held") * F.col("lower")) / F.col("all")
        below = staged(rows.select(F.col(f"s{k}").alias("suffix"), p.alias("p")), "kn-lower")
    return below.withColumnRenamed("p", "lower")


def ratios(counts: DataFrame) -> Ratios:
    """The tables of log(P_toxic / P_ordinary); they grow with the n-grams counted."""
    held = lambda n: F.sum(_discount(n))
    counts = counts.withColumn("context", F.substring("gram", 1, ORDER - 1))
    contexts = counts.groupBy("context").agg(
        F.sum("toxic_n").alias("toxic_all"), F.sum("plain_n").alias("plain_all"), held("toxic_n").alias("toxic_held"), held("plain_n").alias("plain_held")
    )
    toxic_weight = F.when(F.col("toxic_all") > 0, F.col("toxic_held") / F.col("toxic_all")).otherwise(1.0)
    plain_weight = F.when(F.col("plain_all") > 0, F.col("plain_held") / F.col("plain_all")).otherwise(1.0)
    share = lambda n, all_: F.when(F.col(all_) > 0, F.greatest(F.col(n) - _discount(n), F.lit(0.0)) / F.col(all_)).otherwise(0.0)
    gram = counts.join(contexts, "context").join(lower_order(counts), F.substring("gram", 2, ORDER - 1) == F.col("suffix")).select(
        "gram",
        F.log(
            (share("toxic_n", "toxic_all") + toxic_weight * F.col("lower")) / (share("plain_n", "plain_all") + plain_weight * F.col("lower"))
        ).cast("float").alias("r"),
    )
    by_context = contexts.select("context", F.log(toxic_weight / plain_weight).cast("float").alias("r"))
    out = []
    for df, n in ((gram, ORDER), (by_context, ORDER - 1)):
        arrow = df.toArrow()  # a row per distinct n-gram or context
        points = np.frombuffer("".join(arrow.column(0).to_pylist()).encode("utf-32-le"), dtype=np.uint32).reshape(-1, n)
        # one n-gram each: _hashes over the columns instead of along a text
        h = np.zeros(len(points), dtype=np.uint64)
        for k in range(n):
            h = (h + points[:, k].astype(np.uint64) + np.uint64(1)) * _MIX
            h ^= h >> np.uint64(31)
        h *= _MIX
        order = np.argsort(h)
        out += [h[order], arrow.column(1).to_numpy().astype(np.float32)[order]]
    return Ratios(*out)


def _looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, otherwise: np.ndarray | float) -> np.ndarray:
    if not keys.size:
        return np.broadcast_to(np.float32(0) + otherwise, wanted.shape).astype(np.float32)
    at = np.minimum(np.searchsorted(keys, wanted), keys.size - 1)
    return np.where(keys[at] == wanted, values[at], otherwise)


def features(texts: list[str | None], model: Ratios) -> np.ndarray:
    """For each text: mean ratio of its characters; mean of its TOP_WORDS highest word means; the highest word mean."""
    out = np.zeros((len(texts), 3))
    for i, text in enumerate(texts):
        total, n, best = 0.0, 0, np.zeros(0)
        for points in _points(text):
            r = _looked_up(model.grams, model.gram, _hashes(points, ORDER), np.float32(np.nan))
            new = np.nonzero(np.isnan(r))[0]
            if new.size:
                r[new] = _looked_up(model.contexts, model.context, _hashes(points, ORDER - 1)[new], np.float32(0))
            space = np.nonzero(points[ORDER - 1 :] == 32)[0]
            starts = np.r_[0, space[:-1] + 1] if space.size else np.zeros(1, np.int64)
            # the most toxic run of RUN characters in a row that ends in the word
            sums = np.cumsum(np.r_[np.zeros(RUN), r], dtype=np.float64)
            means = np.maximum.reduceat((sums[RUN:] - sums[:-RUN]) / RUN, starts)
            total, n = total + float(r.sum(dtype=np.float64)), n + r.size
            best = np.concatenate([best, means])
            if best.size > TOP_WORDS:
                best = np.partition(best, -TOP_WORDS)[-TOP_WORDS:]
        if n:
            out[i] = total / n, best.sum() / TOP_WORDS, best.max()
    return out


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Newton's method with a little ridge."""
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + 1e-2 * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def featured(docs: DataFrame, model: Ratios, keep: list[str]) -> DataFrame:
    """docs (text, *keep) -> (*keep, f1, f2, f3)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            f = features(batch.column(0).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *(pa.array(f[:, k].copy()) for k in range(3))], names=[*keep, "f1", "f2", "f3"])

    types = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select("text", *keep).mapInArrow(run, f"{types}, f1 double, f2 double, f3 double")


def train(counted: DataFrame, held: DataFrame) -> Model:
    """counted, held: (text, toxic). The logistic curve comes from the second under counts of the first; then the counts of
    the second are added, so that the tables cover all rows of both."""
    counts = staged(count(counted), "kn-counts")
    tables = ratios(counts)
    rows = held.filter("toxic is not null").select("text", F.col("toxic").cast("int").alias("toxic"))
    fit = staged(featured(rows, tables, ["toxic"]), "kn-fit")
    x, y = [], []
    for c in (0, 1):
        own = fit.filter(F.col("toxic") == c).orderBy(F.xxhash64("f1", "f2", "f3")).limit(FIT_ROWS).select("f1", "f2", "f3").toPandas().to_numpy()
        x.append(own)
        y.append(np.full(len(own), float(c)))
    both = counts.unionByName(count(held)).groupBy("gram").agg(F.sum("toxic_n").alias("toxic_n"), F.sum("plain_n").alias("plain_n"))
    tables = ratios(staged(both, "kn-counts"))
    if not len(x[0]) or not len(x[1]):
        return Model(tables, ())
    return Model(tables, tuple(_logistic(np.concatenate(x), np.concatenate(y)).tolist()))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, llr) a row per row of docs; llr is the length-normalised log-likelihood ratio."""
    f = featured(docs, model.ratios, ["doc_id"])
    if not model.weights:
        return f.select("doc_id", F.lit(0.0).alias("score"), F.col("f1").alias("llr"))
    w = model.weights
    z = F.lit(w[0]) + sum(F.lit(k) * F.col(c) for k, c in zip(w[1:], ("f1", "f2", "f3"), strict=True))
    return f.select("doc_id", (1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))).alias("score"), F.col("f1").alias("llr"))

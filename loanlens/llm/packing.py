"""Packing by optimal length buckets.

Sequences are whole documents, cut every max_tokens tokens. The global histogram of their lengths (at most max_tokens
numbers, whatever the corpus) goes to the driver, where dynamic programming picks the bucket boundaries with the least
padding. Inside each bucket, batches of budget // boundary sequences are dealt in the order of a hash, so a batch mixes
sources and every batch but the last of its bucket is full.

Defined results: a document has its whitespace-separated words and one end token, so a null or empty text is one
sequence of one token with an empty text; a very long text is cut into as many sequences as it needs; rows that repeat a
doc_id, or have none, are packed each on their own; of plans with equal padding the one with fewer buckets and then smaller
boundaries wins, and sequences of one hash are dealt by doc_id and piece; an empty table gives no rows. Only doc_id and text
are read, so any further columns may have any name.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gapless, serial, staged


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """The at most `buckets` boundaries, out of the lengths, with the least sum of boundary - length over all sequences.
    Of equal plans the one with fewer buckets and then smaller boundaries wins."""
    order = np.argsort(lengths)
    lengths, counts = np.asarray(lengths, np.int64)[order], np.asarray(counts, np.int64)[order]
    n = len(lengths)
    if not n:
        return []
    below = np.concatenate([[0], np.cumsum(counts)])
    # cost[i, j]: lengths i..j in one bucket (what they hold themselves is the same for every plan)
    best = lengths * below[1:]
    last = [np.full(n, -1)]
    final = [(int(best[-1]), 1)]
    for k in range(2, min(buckets, n) + 1):
        now, cut = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
        for j in range(k - 1, n):
            cost = best[k - 2 : j] + lengths[j] * (below[j + 1] - below[k - 1 : j + 1])
            at = int(cost.argmin())
            now[j], cut[j] = cost[at], at + k - 2
        best = now
        last.append(cut)
        final.append((int(best[-1]), k))
    _, k = min(final)
    out, j = [], n - 1
    while j >= 0:
        out.append(int(lengths[j]))
        j = int(last[k - 1][j])
        k -= 1
    return out[::-1]


def words_split(text: Column) -> Column:
    """The whitespace-separated words of a text."""
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def sequences(docs: DataFrame, max_tokens: int, split=words_split) -> DataFrame:
    """(doc_id, piece, start, n_tokens, text, order_hash): the pieces of every document, in tokens."""
    text = F.coalesce("text", F.lit(""))
    cut = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("h"), split(text).alias("w"))
    number = F.floor(F.size("w") / max_tokens).cast("int")  # of the last piece, which holds the end token
    parts = F.transform(
        F.sequence(F.lit(0), number),
        lambda i: F.struct(
            i.alias("piece"), F.array_join(F.slice("w", i * max_tokens + 1, F.lit(max_tokens)), " ").alias("text"),
            (F.least(F.size("w") + 1 - i * max_tokens, F.lit(max_tokens))).alias("n"),
        ),
    )
    each = cut.select("doc_id", "h", F.explode(parts).alias("p"))
    piece = F.col("p.piece").cast("long")
    return each.select(
        "doc_id", piece.alias("piece"), (piece * max_tokens).alias("start"), F.col("p.n").cast("long").alias("n_tokens"), F.col("p.text").alias("text"),
        F.xxhash64("h", piece).alias("order_hash"),
    )


def pack(docs: DataFrame, max_tokens: int = 2048, buckets: int = 8, budget: int = 32_768, split=words_split) -> DataFrame:
    """(doc_id, piece, start, n_tokens, text, boundary, batch, place) a row per sequence. text: the tokens, joined by spaces,
    without the end token. batch counts from 0 inside its boundary; place is the row of the sequence in the batch.
    boundary * rows of a batch never exceeds max(budget, boundary). split turns a text into its array of tokens."""
    rows = staged(sequences(docs, max_tokens, split).select("*", serial()), "sequences")
    histogram = rows.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).toPandas()  # at most max_tokens rows
    chosen = boundaries(histogram["n_tokens"].to_numpy(), histogram["n"].to_numpy(), buckets) or [max_tokens]
    bound = F.lit(chosen[-1])
    for b in reversed(chosen[:-1]):
        bound = F.when(F.col("n_tokens") <= b, F.lit(b)).otherwise(bound)
    bounded = rows.withColumn("boundary", bound.cast("long"))
    ranked = gapless(bounded, "boundary", buckets, ["doc_id", "piece", "n_tokens"], "order_hash", "slot")
    size = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("boundary")))
    return ranked.select(
        "doc_id", "piece", "start", "n_tokens", "text", "boundary",
        F.floor(F.col("slot") / size).cast("long").alias("batch"), (F.col("slot") % size).cast("long").alias("place"),
    )

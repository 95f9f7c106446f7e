"""SimHash near-duplicates by covering locality-sensitive hashing.

Pagh's covering family: every bit position i gets a vector phi(i) of radius + 1 random bits; for each non-zero
v of as many bits a mask keeps the positions where <phi(i), v> = 1. The phi of at most `radius` differing
positions cannot span all radius + 1 dimensions, so some v is orthogonal to all of them: its mask drops every
differing bit and the pair has equal keys in that table. No pair within the radius is missed.

Equal fingerprints are one node, so copies are never expanded. In a bucket only a spanning forest of the links is
emitted; buckets over `block` nodes are first cut into blocks, and each pair of blocks is a task of its own.

Defined results: a null or empty text has fingerprint zero and links like any other; a bit set in exactly half of the
hashes (a tie) is 0; a text of any length is hashed whole, in bounded memory; rows that repeat a doc_id keep a row each, by
their own texts; a null doc_id gets its fingerprint and component, the smallest non-null doc_id reachable or null; an empty
table gives no rows. Only doc_id and text are read, so any further columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import scratch, sliced, staged

BITS = 64


def majority(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes (uint64) have each bit."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def packed(counts: np.ndarray, n: int) -> int:
    """The fingerprint of n hashes: a bit is 1 if set in over half of them."""
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42, step: int = 1 << 15) -> int:
    """64-bit SimHash of the shingles of `shingle` words, repeats included; memory is bounded by `step` hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = max(1, len(words) - shingle + 1)
    starts, ends = starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, step):
        spans = zip(starts[at : at + step], ends[at : at + step], strict=True)
        counts += majority(np.array([digest(joined[s:e], seed) for s, e in spans], dtype=np.uint64))
    return packed(counts, n)


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp) a row per row of docs; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            fp = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, fp bigint")


def covering_masks(radius: int = 4, seed: int = 7) -> list[int]:
    """The 2**(radius + 1) - 1 bit masks of the covering family, as unsigned numbers."""
    dims = radius + 1
    # phi takes every non-zero vector about equally often, in an order drawn from the seed
    phi = np.resize(np.arange(1, 1 << dims), BITS)
    np.random.default_rng(seed).shuffle(phi)
    return [sum(1 << i for i in range(BITS) if bin(int(phi[i]) & v).count("1") % 2) for v in range(1, 1 << dims)]


def _forest(x: np.ndarray, y: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """Spanning forest of the pairs within the radius, among x or between x and y (signed longs).

    Breadth first: a node is compared once, with the nodes that no tree has reached yet, and those it reaches are not
    compared with again as targets. So a dense bucket shrinks at once, and one without links costs a pass a node."""
    two = y is not None
    nodes = np.concatenate([x, y]) if two else x
    u = nodes.view(np.uint64)
    if nodes.size == 2:
        return [(int(nodes[0]), int(nodes[1]))] if (not two or x.size == 1) and int(u[0] ^ u[1]).bit_count() <= radius else []
    side = np.r_[np.zeros(x.size, bool), np.ones(nodes.size - x.size, bool)]
    # nodes that no tree has reached; between two sides a node meets the other side's only
    rest = [np.arange(x.size), np.arange(x.size, nodes.size)] if two else [np.arange(x.size)]
    out: list[tuple[int, int]] = []
    for root in range(x.size):
        own = rest[0]
        if not own.size or (two and not rest[1].size):
            break
        at = int(np.searchsorted(own, root))
        if at == own.size or own[at] != root:
            continue
        rest[0] = np.delete(own, at)
        queue = [root]
        while queue:
            node = queue.pop()
            k = 0 if not two or side[node] else 1
            near = np.bitwise_count(u[rest[k]] ^ u[node]) <= radius
            if near.any():
                found = rest[k][near]
                rest[k] = rest[k][~near]
                out += [(int(nodes[node]), int(v)) for v in nodes[found]]
                queue += found.tolist()
    return out


def links(distinct: DataFrame, radius: int = 4, block: int = 20_000) -> DataFrame:
    """distinct (fp) -> edges (a, b) that connect exactly what pairs within the radius connect."""
    masks = covering_masks(radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = distinct.select("fp", F.posexplode(F.array(*[F.lit(m).cast("long") for m in signed])).alias("tab", "mask")).select(
        "tab", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp"
    )
    sizes = keyed.groupBy("tab", "key").agg(F.count(F.lit(1)).alias("n"))
    large = staged(sizes.filter(F.col("n") > block).withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).drop("n"), "large-buckets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by bucket; a bucket may go on in the next batch."""
        held: list[np.ndarray] = []
        last = None

        def close() -> list[tuple[int, int]]:
            rows = np.concatenate(held)
            if len(rows) < 2:
                return []
            one, two = rows[rows[:, 0] == 0, 1].copy(), rows[rows[:, 0] == 1, 1].copy()
            return _forest(one, two if two.size else None, radius)

        found: list[tuple[int, int]] = []
        for batch in batches:
            t, k, p, s, f = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            if not len(t):
                continue
            cut = np.nonzero((t[1:] != t[:-1]) | (k[1:] != k[:-1]) | (p[1:] != p[:-1]))[0] + 1
            bounds = [0, *cut.tolist(), len(t)]
            sf = np.stack([s.astype(np.int64), f], axis=1)
            for a, b in zip(bounds, bounds[1:], strict=False):
                bucket = (t[a], k[a], p[a])
                if bucket != last and held:
                    found += close() if sum(map(len, held)) > 1 else []
                    held = []
                last = bucket
                held.append(sf[a:b])
            if len(found) > 10_000:
                yield edge_batch(found)
                found = []
        if held:
            found += close()
        yield edge_batch(found)

    def edge_batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
        pairs = np.array(found, dtype=np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    def compare(rows: DataFrame) -> DataFrame:
        """rows (tab, key, part, side, fp): one comparison for each (tab, key, part)."""
        dealt = rows.repartition("tab", "key", "part").sortWithinPartitions("tab", "key", "part")
        return dealt.mapInArrow(run, "a bigint, b bigint")

    plain = keyed.withColumn("part", F.lit(0)).withColumn("side", F.lit(0))
    if large.isEmpty():
        return compare(plain.select("tab", "key", "part", "side", "fp"))
    small = plain.join(large.select("tab", "key"), ["tab", "key"], "left_anti").select("tab", "key", "part", "side", "fp")
    # block i of a large bucket meets each block j >= i in part i * blocks + j
    cut = keyed.join(large, ["tab", "key"]).withColumn("own", F.expr("cast(pmod(xxhash64(fp), blocks) as int)"))
    met = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    big = met.select(
        "tab", "key", (F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")).alias("part"),
        (F.col("own") > F.col("other")).cast("int").alias("side"), "fp",
    )
    return compare(small).unionByName(compare(big))


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, block: int = 20_000) -> DataFrame:
    """(doc_id, fp, component_id) a row per row of docs."""
    with scratch() as kept:
        prints = staged(fingerprints(docs, shingle), "fingerprints")
        nodes = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
        groups = components(links(nodes.select("fp"), radius, block))
        grouped = nodes.join(groups, F.col("fp") == F.col("node")).select("fp", "component", "least")
        least = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
        labels = grouped.join(least, "component").select(F.col("fp").alias("f"), "component_id")
        own = nodes.join(labels, F.col("fp") == F.col("f"), "left")
        rest = staged(own.select(F.col("fp").alias("f"), F.coalesce("component_id", "least").alias("component_id")), "labels")
        kept += [prints, rest]
    return prints.join(rest, F.col("fp") == F.col("f")).select("doc_id", "fp", "component_id")

"""Chroma audio fingerprints.

PCM is cut into overlapping frames; the power spectrum of each is folded into 12 pitch classes and normalised. Sixteen
filters (halves in time, halves in pitch, centre bands and quadrants, of several sizes) compare sums of the
frames x classes image, each from four corners of its integral image, and quantise the log ratio to two Gray-coded
bits: one packed 32-bit integer a frame. Two recordings align at the offset that most of their equal integers share;
the share of differing bits over the overlap there decides.

Equal fingerprints are one class, kept once. Query classes are taken in blocks of bounded size; the fingerprints of a block
are broadcast, each worker sorts their integers into an index, and every class streams past it, so no pair is ever a row of
a join. There are as many passes over the fingerprints (a sixteenth of the samples) as the queries fill blocks; the number of
equal integers met grows with queries times recordings.

Defined results: ids are integers; a null or empty recording, or one shorter than a fingerprint needs, is padded with
silence; a recording of any length is used whole (a block holds one at least); rows that repeat an id are each in the class
of their own samples; null ids are never queries; of offsets with equal votes the one nearest to zero counts, then the
smaller, and of queries with equal errors the smaller class; an empty table gives no rows. Only the named columns are read,
so any further columns may have any name.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, sliced, staged


@dataclass(frozen=True)
class Rule:
    """Samples a second; samples a frame and between frames; lowest and highest pitch in Hz. A link needs `votes` equal
    integers at one offset, `overlap` frames in common and at most `errors` of the bits different."""

    rate: int = 8000
    frame: int = 256
    hop: int = 64
    low: float = 55.0
    high: float = 3520.0
    votes: int = 4
    overlap: int = 8
    errors: float = 0.15


WIDTH = 8
#: Frames that are transformed at once.
STEP = 1 << 15
#: (kind, frames, first class, classes) of the sixteen filters, by rule: each kind at four places and sizes.
FILTERS = [(kind, (8, 4, 6, 8)[i], (0, 3, 6, 2)[i], (12, 6, 6, 8)[i]) for kind in ("time", "pitch", "centre", "quadrant") for i in range(4)]
THRESHOLD = 0.12


def _classes(rule: Rule) -> np.ndarray:
    """rfft bins x 12: 1 where a bin belongs to a pitch class."""
    hz = np.arange(rule.frame // 2 + 1) * rule.rate / rule.frame
    ok = (hz >= rule.low) & (hz <= rule.high)
    pitch = np.round(12 * np.log2(np.where(ok, hz, rule.low) / rule.low)).astype(int) % 12
    out = np.zeros((hz.size, 12), dtype=np.float32)
    out[np.nonzero(ok)[0], pitch[ok]] = 1
    return out


def chroma(pcm: np.ndarray, rule: Rule) -> np.ndarray:
    """pcm (float32 around 0) -> frames x 12, each frame of length 1 (or all 0 in silence)."""
    least = rule.frame + (WIDTH - 1) * rule.hop
    if pcm.size < least:
        pcm = np.concatenate([pcm, np.zeros(least - pcm.size, np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(pcm, rule.frame)[:: rule.hop]
    window, fold = np.hanning(rule.frame).astype(np.float32), _classes(rule)
    out = np.empty((len(frames), 12), dtype=np.float32)
    for at in range(0, len(frames), STEP):
        power = np.abs(np.fft.rfft(frames[at : at + STEP] * window, axis=1)) ** 2
        out[at : at + STEP] = power.astype(np.float32) @ fold
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 1e-6)


def fingerprint(pcm: np.ndarray, rule: Rule = Rule()) -> np.ndarray:
    """One uint32 a frame, but for the last WIDTH - 1."""
    image = chroma(pcm, rule)
    n = len(image) - WIDTH + 1
    integral = np.zeros((len(image) + 1, 13))
    integral[1:, 1:] = image.cumsum(axis=0, dtype=np.float64).cumsum(axis=1)
    rows = np.arange(n)

    def area(t0: int, t1: int, c0: int, c1: int) -> np.ndarray:
        return integral[rows + t1, c1] - integral[rows + t0, c1] - integral[rows + t1, c0] + integral[rows + t0, c0]

    out = np.zeros(n, dtype=np.uint32)
    for k, (kind, frames, first, size) in enumerate(FILTERS):
        mid, half, end = frames // 2, first + size // 2, first + size
        whole = area(0, frames, first, end)
        if kind == "time":
            a = area(0, mid, first, end)
        elif kind == "pitch":
            a = area(0, frames, first, half)
        elif kind == "centre":
            a = area(0, frames, first + size // 4, end - size // 4)
        else:
            a = area(0, mid, first, half) + area(mid, frames, half, end)
        ratio = np.log1p(np.maximum(a, 0)) - np.log1p(np.maximum(whole - a, 0))
        level = (ratio > -THRESHOLD).astype(np.uint32) + (ratio > 0) + (ratio > THRESHOLD)
        out |= (level ^ (level >> 1)).astype(np.uint32) << np.uint32(2 * k)
    return out


def fingerprints(recordings: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """recordings (id, pcm binary: unsigned 8-bit mono) -> (id, fp binary: little-endian uint32 a frame)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out = []
            for b in batch.column(1).to_pylist():
                out.append(fingerprint((np.frombuffer(b or b"", np.uint8).astype(np.float32) - 128) / 128, rule).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "fp"])

    kind = recordings.schema["id"].dataType.simpleString()
    return recordings.select("id", "pcm").mapInArrow(run, f"id {kind}, fp binary")


def bit_errors(x: np.ndarray, y: np.ndarray, offset: int) -> tuple[int, float]:
    """Frames in common and share of differing bits when y starts `offset` frames into x."""
    a, b = (x[offset:], y) if offset >= 0 else (x, y[-offset:])
    n = min(len(a), len(b))
    return n, float(np.bitwise_count(a[:n] ^ b[:n]).sum() / (32 * n)) if n else 1.0


#: The index of the last block that this worker has met.
_INDEX: list = [None, None]


class Block:
    """The fingerprints of some query classes: (class, queries in it, fingerprint)."""

    def __init__(self, ids: list[int], weights: list[int], prints: list[np.ndarray]):
        self.ids, self.weights, self.prints, self.name = ids, weights, prints, uuid.uuid4().hex

    def index(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All integers in order, with the number of their class and their place in it; made once in a worker."""
        if _INDEX[0] != self.name:
            values = np.concatenate([np.zeros(0, np.uint32), *self.prints])
            owner = np.repeat(np.arange(len(self.prints)), [len(p) for p in self.prints]).astype(np.int64)
            place = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(p)) for p in self.prints)])
            order = np.argsort(values, kind="stable")
            _INDEX[:] = self.name, (values[order], owner[order], place[order])
        return _INDEX[1]

    def search(self, own: int, fp: np.ndarray, rule: Rule, step: int = 1 << 20) -> list[tuple[int, int, int, float]]:
        """(query class, queries in it, offset, share of differing bits) of every class that this one aligns with."""
        values, owner, place = self.index()
        lo, hi = np.searchsorted(values, fp, "left"), np.searchsorted(values, fp, "right")
        hits = np.cumsum(hi - lo)
        span = np.int64(1) << 32
        votes: dict[int, int] = {}
        at = 0
        while at < len(fp) and len(hits) and hits[-1]:
            base = hits[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(hits, base + step, "right")))
            n = (hi - lo)[at:stop]
            if total := int(n.sum()):
                first = np.repeat(lo[at:stop] - np.r_[0, np.cumsum(n)[:-1]], n)
                k = first + np.arange(total)
                key = owner[k] * span + (np.repeat(np.arange(at, stop), n) - place[k]) + (span >> 1)
                for x, c in zip(*(z.tolist() for z in np.unique(key, return_counts=True)), strict=True):
                    votes[x] = votes.get(x, 0) + c
            at = stop
        top: dict[int, tuple[int, int]] = {}
        for x, c in votes.items():
            q, offset = divmod(x, int(span))
            offset -= int(span >> 1)
            if c >= rule.votes and (q not in top or (-c, abs(offset), offset) < (-top[q][0], abs(top[q][1]), top[q][1])):
                top[q] = (c, offset)
        out = []
        for q, (_, offset) in sorted(top.items()):
            if self.ids[q] != own:
                n, errors = bit_errors(fp, self.prints[q], offset)
                if n >= min(rule.overlap, len(fp), len(self.prints[q])) and errors <= rule.errors:
                    out.append((self.ids[q], self.weights[q], offset, errors))
        return out


def classes_of(own: DataFrame, every: int) -> DataFrame:
    """(id, fp) -> (fp, class_id, queries, frames): class_id is the smallest id of an equal fingerprint, queries how many of
    its ids are divisible by `every`."""
    is_query = F.coalesce((F.col("id") % every == 0).cast("int"), F.lit(0))
    found = own.groupBy("fp").agg(F.min("id").alias("class_id"), F.sum(is_query).alias("queries"))
    return found.withColumn("frames", (F.octet_length("fp") / 4).cast("long"))


def _searched(classes: DataFrame, rule: Rule, block_frames: int, rows, names: tuple[str, ...], kinds: tuple) -> DataFrame:
    """What `rows` makes of the links of each class with each block of query classes; every block is bounded, whatever the
    corpus, and searched by all classes."""
    total = classes.filter("queries > 0").agg(F.coalesce(F.sum("frames"), F.lit(0))).first()[0]
    n_blocks = max(1, -(-total // block_frames))
    types = ", ".join(f"{n} {'double' if k == pa.float64() else 'bigint'}" for n, k in zip(names, kinds, strict=True))
    found = None
    for b in range(n_blocks):
        part = classes.filter((F.col("queries") > 0) & (F.pmod(F.xxhash64("fp"), F.lit(n_blocks)) == b)).select("class_id", "queries", "fp").toArrow()
        block = Block(part.column(0).to_pylist(), part.column(1).to_pylist(), [np.frombuffer(x, "<u4") for x in part.column(2).to_pylist()])
        shared = classes.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for own, fp in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    out += rows(own, shared.value.search(own, np.frombuffer(fp, "<u4"), rule))
                columns = list(zip(*out, strict=True)) or [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=list(names))

        hits = staged(classes.select("class_id", "fp").mapInArrow(run, types), "audio-links")
        found = hits if found is None else found.unionByName(hits)
    return found


def links(classes: DataFrame, rule: Rule = Rule(), block_frames: int = 8_000_000) -> DataFrame:
    """classes as of classes_of -> (class_id, query_class, offset, errors), a row per class and query class that align."""
    rows = lambda own, found: [(own, q, offset, errors) for q, _, offset, errors in found]
    return _searched(classes, rule, block_frames, rows, ("class_id", "query_class", "offset", "errors"), (pa.int64(), pa.int64(), pa.int64(), pa.float64()))


def align(recordings: DataFrame, every: int = 50, rule: Rule = Rule(), block_frames: int = 8_000_000) -> DataFrame:
    """(id, class_id, n_frames, fp_sha256, n_links, best_class, best_offset, best_errors) a row per recording. Queries are
    the recordings whose id is divisible by `every`; n_links counts those in other classes that the recording aligns with,
    best_class is the class of the one with the fewest bit errors. links() has them all. class_id: the smallest id of an
    equal fingerprint."""

    def rows(own: int, found: list[tuple[int, int, int, float]]) -> list[tuple]:
        if not found:
            return []
        best = min(found, key=lambda f: (f[3], f[0], f[2]))
        return [(own, sum(f[1] for f in found), best[0], best[2], best[3])]

    names = ("class_id", "n_links", "best_class", "best_offset", "best_errors")
    with scratch() as kept:
        own = staged(fingerprints(recordings, rule), "audio")
        classes = staged(classes_of(own, every), "audio-classes")
        found = _searched(classes, rule, block_frames, rows, names, (*[pa.int64()] * 4, pa.float64()))
        best = F.min_by(F.struct("best_class", "best_offset", "best_errors"), F.struct("best_errors", "best_class")).alias("best")
        merged = found.groupBy(F.col("class_id").alias("c")).agg(F.sum("n_links").alias("n_links"), best)
        answers = classes.join(merged, F.col("class_id").eqNullSafe(F.col("c")), "left").select(
            F.sha2("fp", 256).alias("fp_sha256"), "class_id", F.col("frames").alias("n_frames"),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "best.best_class", "best.best_offset", "best.best_errors",
        )
        kept += [own, staged(answers, "audio-answers")]
    own, answers = kept
    return own.select("id", F.sha2(F.col("fp"), 256).alias("fp_sha256")).join(answers, "fp_sha256").select(
        "id", "class_id", "n_frames", "fp_sha256", "n_links", "best_class", "best_offset", "best_errors"
    )

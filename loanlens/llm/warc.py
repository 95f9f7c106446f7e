"""WARC archives over a chunked record table.

A payload is a run of rows (row, record_id, part, data) of at most `chunk` bytes each, written once: past the source row no
column holds a whole record, neither in the JVM nor in Python. Each part is cut out of the source's bytes by itself; a record
of one part is digested as it is cut, the digests of longer ones are carried from part to part. Writing: each part becomes a
WARC record (a first segment and `continuation` records after it, as WARC/1.0 segmentation has them), and Spark's own text
sink writes them, gzipped, to any file system that Spark reaches, CR LF CR LF closing every record. Reading: Spark's text
source cuts the files at record heads without holding a file, and the segments of a record are digested in order as they
stream by. The writer ends a segment inside every version mark that a payload holds itself, so a cut is always a record's
edge; a segment whose length is not its Content-Length is refused.

Of records with equal payloads of at least `least` bytes, the one with the largest id is a `response` and the others are
`revisit` records without payload that refer to it.

Defined results: a null payload is empty; rows that repeat an id and payload are all the same type, and each comes back;
a null id is written as an empty one, comes back null, and is a response; a payload of any length that a cell can hold is cut
into as many segments as it needs; an empty table gives an archive without records. Only the named columns are read, so any
further columns may have any name; the uri may be null, and CR or LF in it become spaces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import broadcast_if, scratch, staged

HEAD = "WARC/1.0\r\n"
END = "\r\n\r\n"
#: Bytes of a payload in one row or segment, at most.
CHUNK = 1 << 18
#: Revisits beyond this count are joined by a shuffle instead of a broadcast.
BROADCAST_ROWS = 1_000_000
MARK = "WARC/1.0"


def edge(data: Column, at: Column) -> Column:
    """The last start of a character at or before byte `at`: at most three bytes back."""
    byte = lambda k: F.hex(F.substring(data, at + 1 - k, F.lit(1)))
    inside = lambda k: byte(k).between("80", "BF")
    return F.when(~inside(0), at).when(~inside(1), at - 1).when(~inside(2), at - 2).otherwise(at - 3)


def chunked(records: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """records (record_id, uri, payload string) -> (row, record_id, uri, single, cut, part, data string): the parts of each
    record, by cut and part. A part has at most `chunk` bytes and holds no version mark (WARC/1.0). single: the record's
    only part. row tells records apart once the table is staged."""
    if chunk < 16:
        raise ValueError("a chunk has 16 bytes at least")
    data = F.coalesce("payload", F.lit("")).cast("binary")
    rows = records.select(F.monotonically_increasing_id().alias("row"), "record_id", "uri", data.alias("data"))
    n = F.octet_length("data")
    cuts = F.greatest(F.ceil(n / chunk).cast("int"), F.lit(1))
    each = rows.select("*", cuts.alias("cuts"), F.explode(F.sequence(F.lit(0), cuts - 1)).alias("cut"))
    low = F.when(F.col("cut") == 0, F.lit(0)).otherwise(edge(F.col("data"), F.col("cut") * chunk))
    high = F.when(F.col("cut") + 1 == F.col("cuts"), n).otherwise(edge(F.col("data"), (F.col("cut") + 1) * chunk))
    text = each.select("row", "record_id", "uri", "cuts", "cut", F.substring("data", low + 1, high - low).cast("string").alias("text"))
    # a cut inside every version mark; a mark that is over an edge is cut already
    parts = F.when(F.contains("text", F.lit(MARK)), F.split("text", "(?<=W)(?=ARC/1[.]0)", -1)).otherwise(F.array("text"))
    split = text.select("row", "record_id", "uri", "cuts", "cut", parts.alias("parts"))
    return split.select(
        "row", "record_id", "uri", ((F.col("cuts") == 1) & (F.size("parts") == 1)).alias("single"), "cut", F.posexplode("parts").alias("part", "data")
    )


def digested(parts: DataFrame) -> DataFrame:
    """Staged parts -> (row, record_id, n_bytes, sha1), a row per record: those of one part from their digest, the others
    brought together and streamed in order."""
    single = parts.filter("single").select("row", "record_id", "n_bytes", "sha1")
    number = F.row_number().over(Window.partitionBy("row").orderBy("cut", "part"))
    long = parts.filter("not single").select("row", "record_id", number.alias("number"), F.col("data").cast("binary").alias("data"))
    urns = long.select(F.col("row").cast("string").alias("record_urn"), F.col("number").alias("segment"), "data")
    summed = _streamed(urns).select(F.col("record_urn").cast("long").alias("row"), "n_bytes", "sha1")
    ids = parts.filter("not single and cut = 0 and part = 0").select("row", "record_id")
    return single.unionByName(summed.join(ids, "row").select("row", "record_id", "n_bytes", "sha1"))


def revisits(digests: DataFrame, least: int) -> DataFrame:
    """(row, refers_to): the records whose payload another one holds, with the largest id of them."""
    large = digests.filter((F.col("n_bytes") >= least) & F.col("record_id").isNotNull())
    heads = large.groupBy("sha1", "n_bytes").agg(F.max("record_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return large.join(heads, ["sha1", "n_bytes"]).filter("record_id <> refers_to").select("row", "refers_to")


def urn(record_id: Column, sha1: Column) -> Column:
    return F.concat(F.lit("<urn:record:"), F.coalesce(record_id.cast("string"), F.lit("")), F.lit(":"), sha1, F.lit(">"))


def write(records: DataFrame, path: str, chunk: int = CHUNK, least: int = 1000, date: str = "2024-01-01T00:00:00Z") -> None:
    """records (record_id, uri, payload) -> WARC files in path."""
    with scratch():
        parts = chunked(records.select("record_id", "uri", "payload"), chunk)
        data = F.col("data").cast("binary")
        own = lambda c: F.when(F.col("single"), c)
        parts = staged(parts.select("*", own(F.octet_length(data).cast("long")).alias("n_bytes"), own(F.sha1(data)).alias("sha1")), "parts")
        digests = staged(digested(parts), "digests")
        again = staged(revisits(digests, least), "revisits")
        n_again = again.count()
        again = broadcast_if(again.withColumnRenamed("row", "r"), n_again, BROADCAST_ROWS)
        typed = parts.join(again, F.col("row") == F.col("r"), "left").drop("r")
        # a revisit is its first part without data
        typed = typed.filter("refers_to is null or (cut = 0 and part = 0)").withColumn("data", F.when(F.col("refers_to").isNull(), F.col("data")).otherwise(F.lit("")))
        single = typed.filter("single").withColumn("number", F.lit(1))
        order = F.row_number().over(Window.partitionBy("row").orderBy("cut", "part"))
        sums = digests.select(F.col("row").alias("r"), F.col("n_bytes").alias("total"), F.col("sha1").alias("digest"))
        long = typed.filter("not single").join(sums, F.col("row") == F.col("r")).withColumn("number", order)
        long = long.withColumn("sha1", F.col("digest")).drop("r", "total", "digest")
        lines = single.unionByName(long).select(_record(date).alias("value"))
        lines.write.option("lineSep", END).option("compression", "gzip").text(path)


def _record(date: str) -> Column:
    """The WARC record of a part (record_id, uri, single, number, sha1, refers_to, data)."""
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit("\r\n"))
    none, number, first = F.lit(""), F.col("number").cast("string"), F.col("number") == 1
    again = F.col("refers_to").isNotNull()
    own = urn(F.col("record_id"), F.col("sha1"))
    uri = F.regexp_replace(F.col("uri"), "[\r\n]", " ")
    segmented = ~F.col("single") & ~again
    return F.concat(
        F.lit(HEAD),
        line("WARC-Type", F.when(~first, F.lit("continuation")).when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.when(first, own).otherwise(F.concat(F.regexp_replace(own, ">$", ""), F.lit(":"), number, F.lit(">")))),
        line("WARC-Date", F.lit(date)),
        F.when(uri.isNotNull() & first, line("WARC-Target-URI", uri)).otherwise(none),
        F.when(first, line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1")))).otherwise(none),
        F.when(again, F.concat(
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")),
            line("WARC-Refers-To", urn(F.col("refers_to"), F.col("sha1"))),
        )).otherwise(none),
        F.when(segmented, line("WARC-Segment-Number", number)).otherwise(none),
        F.when(segmented & ~first, line("WARC-Segment-Origin-ID", own)).otherwise(none),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.octet_length("data").cast("string")),
        F.lit("\r\n"), F.col("data"),
    )


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """WARC files -> a row per WARC record: type, record_urn, refers_urn, uri, digest, segment, segmented, data."""
    cut = spark.read.option("lineSep", END + HEAD).text(path)
    record = F.when(F.startswith(F.col("value"), F.lit(HEAD)), F.substring("value", len(HEAD) + 1, F.lit(2**31 - 1))).otherwise(F.col("value"))
    split = F.locate(END, record)
    rows = cut.select(F.concat(F.lit("\r\n"), F.substring(record, F.lit(1), split + 1)).alias("head"), F.substring(record, split + len(END), F.lit(2**31 - 1)).alias("body"))
    get = lambda name: F.nullif(F.regexp_extract("head", rf"\r\n{name}: ([^\r\n]*)\r\n", 1), F.lit(""))
    size = get("Content-Length").cast("long")
    body = F.col("body").cast("binary")
    # the last record of a file keeps the end mark
    data = F.when(F.octet_length(body) == size, body).when(F.octet_length(body) == size + 4, F.substring(body, F.lit(1), size.cast("int")))
    data = F.when(data.isNull(), F.raise_error(F.concat(F.lit("a WARC record is cut short: "), F.coalesce(get("WARC-Record-ID"), F.lit("?"))))).otherwise(data)
    return rows.select(
        get("WARC-Type").alias("type"), F.coalesce(get("WARC-Segment-Origin-ID"), get("WARC-Record-ID")).alias("record_urn"), get("WARC-Refers-To").alias("refers_urn"),
        get("WARC-Target-URI").alias("uri"), get("WARC-Payload-Digest").alias("digest"), F.coalesce(get("WARC-Segment-Number").cast("int"), F.lit(1)).alias("segment"),
        get("WARC-Segment-Number").isNotNull().alias("segmented"), data.alias("data"),
    )


def _streamed(segments: DataFrame) -> DataFrame:
    """(record_urn, segment, data) sorted by both -> (record_urn, n_bytes, sha1, copies, whole), one row per record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, size, copies, last = None, hashlib.sha1(), 0, 0, 0
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[]] * 4
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["record_urn", "n_bytes", "sha1", "copies"])

        for batch in batches:
            data = batch.column(2)
            for i, (record, number) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if record != now:
                    if now is not None:
                        out.append((now, size, digest.hexdigest(), copies))
                    now, digest, size, copies, last = record, hashlib.sha1(), 0, 0, 0
                copies += number == 1
                if number == last:  # the same record once more
                    continue
                if number != last + 1:
                    raise ValueError(f"segment {last + 1} of {record} is missing")
                piece = data[i].as_buffer()
                digest.update(piece)
                size, last = size + piece.size, number
            if len(out) > 5000:
                yield flush()
                out = []
        if now is not None:
            out.append((now, size, digest.hexdigest(), copies))
        yield flush()

    dealt = segments.select("record_urn", "segment", "data").repartition("record_urn").sortWithinPartitions("record_urn", "segment")
    return dealt.mapInArrow(run, "record_urn string, n_bytes bigint, sha1 string, copies int")


def read(spark: SparkSession, path: str) -> DataFrame:
    """WARC files of write -> (record_id string, payload_bytes, payload_digest, record_type, refers_to string), a row per
    record written. Bytes and digest of a response are those of its streamed payload; a revisit takes them from the
    response that it refers to."""
    segments = read_segments(spark, path)
    # a record in one segment is as small as a chunk and digested where it is read; only the others are brought together
    kept = segments.filter("type in ('response', 'continuation')")
    single = kept.filter(~F.col("segmented")).select("record_urn", F.octet_length("data").cast("long").alias("n_bytes"), F.sha1("data").alias("sha1"), F.lit(1).alias("copies"))
    payloads = staged(single.unionByName(_streamed(kept.filter("segmented"))), "payloads")  # read lazily by the result
    name = lambda c: F.nullif(F.regexp_extract(c, r"^<urn:record:(.*):[0-9a-f]*>$", 1), F.lit(""))
    responses = payloads.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select(
        name("record_urn").alias("record_id"), F.col("n_bytes").alias("payload_bytes"), F.col("sha1").alias("payload_digest"),
        F.lit("response").alias("record_type"), F.lit(None).cast("string").alias("refers_to"),
    )
    revisits = segments.filter("type = 'revisit'").select(name("record_urn").alias("record_id"), "refers_urn")
    whole = payloads.select(F.col("record_urn").alias("u"), "n_bytes", "sha1").distinct()
    resolved = revisits.join(whole, F.col("refers_urn") == F.col("u")).select(
        "record_id", F.col("n_bytes").alias("payload_bytes"), F.col("sha1").alias("payload_digest"), F.lit("revisit").alias("record_type"), name("refers_urn").alias("refers_to")
    )
    return responses.unionByName(resolved)

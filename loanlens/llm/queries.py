"""The op queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chroma, decontaminate, language, licenses, packing, privacy, sharding, simhash, toxicity, warc
from .common import doc_crc, shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(table(spark, sf_dir, "documents"))
    return out.withColumn("text_sha256", F.sha2(F.col("text").cast("binary"), 256)).drop("text")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated"
    )


def op2_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The looser matches of op2_decontaminate, whose own columns its SQL fixes."""
    found = decontaminate.decontaminate_loosely(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "items", "contaminated", "proximity_items", "near_items", "near")


def held_out_languages(docs: DataFrame) -> language.Model:
    return language.train(docs.filter(~F.coalesce(doc_crc(F.col("doc_id"), 3) == 1, F.lit(False))))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(doc_crc(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out")
    return language.predict(docs, held_out_languages(docs)).select("doc_id", held, "lang_pred", "score")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("record_id"), F.col("url").alias("uri"), F.col("html").alias("payload"))
    path = f"{shared_dir(spark)}/loanlens/warc-{uuid.uuid4().hex}"
    warc.write(pages, path)
    return warc.read(spark, path).select(
        F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to")
    )


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    """The curve from one fifth of the labelled rows under counts of three, then counts from all four; the fifth with remainder 0 is never learned from."""
    rest = doc_crc(F.col("doc_id"), 5)
    # a doc_id that is labelled more than once is toxic if any label says so
    once = labels.filter(rest != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # one physical join at every size: texts and labels meet in a shuffle, never by a broadcast of labels
    joined = docs.select("doc_id", "text").filter(rest != 0).join(once.hint("merge"), "doc_id")
    return toxicity.train(joined.filter(rest.isin(1, 2, 3)), joined.filter(rest == 4))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    held = F.coalesce(doc_crc(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out")
    return toxicity.score(docs, model).select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "llr")


def op7_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = privacy.find(table(spark, sf_dir, "documents"))
    text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["kind"] != "term")
    counts = [F.size(F.expr(f"filter(spans, s -> s.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in privacy.KINDS]
    joined = lambda spans: F.array_join(F.transform(spans, text), ",")
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op8_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no audio: each document's UTF-8 bytes are played as 8-bit PCM."""
    docs = table(spark, sf_dir, "documents")
    out = chroma.align(docs.select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("pcm")))
    return out.withColumnRenamed("id", "doc_id")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = licenses.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    named = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    return spans.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(F.transform(base, lambda s: s["start"])).alias("first_word"),
        F.array_max(F.transform(base, lambda s: s["start"])).alias("last_word"), named(base).alias("base_labels"), named(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["coverage"])), F.lit(0.0)).alias("score"),
    )


def queries() -> dict:
    return {
        "op1_packing": op1_packing, "op2_decontaminate": op2_decontaminate, "op2_proximity": op2_proximity, "op3_language": op3_language, "op4_sharding": op4_sharding, "op5_warc": op5_warc,
        "op6_toxicity": op6_toxicity, "op7_privacy": op7_privacy, "op8_chroma": op8_chroma, "op9_simhash": op9_simhash, "op10_licenses": op10_licenses,
    }


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def oracle_sql() -> dict[str, str]:
    return {
        "op2_decontaminate": f"""
WITH w AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
win AS (SELECT item_id, list_slice(ws, k, k + 9) AS win FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS k FROM w WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT len(win) AS n FROM win),
d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
pos AS (SELECT doc_id, n, k, list_slice(ws, k, k + n - 1) AS win FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM d, sizes WHERE len(ws) >= n)),
m AS (SELECT pos.doc_id, pos.k, pos.n, win.item_id FROM pos JOIN win USING (win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM (SELECT DISTINCT doc_id, k, n FROM m)) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)""",
        "op5_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
h AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS head FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN head <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN head <> page_id THEN head END AS refers_to
FROM h""",
    }

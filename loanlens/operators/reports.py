"""Report documents: statement sections, inline tagged values, and the ends of the model stage."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import markup

SECTIONS = "path string, raw_chars bigint, titles array<string>, kinds array<string>, spans array<struct<start:bigint,end:bigint>>, flags array<string>, text string, error string"


def sections(documents: DataFrame, limits: markup.Limits = markup.Limits()) -> DataFrame:
    """documents (path, content binary) -> statement sections. A document that fails is a row with `error`, not a failed task;
    null content is an empty document. Batches are read one document at a time, so a task holds one text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split(" ", 1)[0] for f in SECTIONS.split(", ")]
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                row: dict = dict.fromkeys(names) | {"path": path.as_py(), "raw_chars": 0}
                try:
                    raw = markup.decode(content.as_py() or b"")
                    got = markup.sections(raw, limits)
                    kinds = list(dict.fromkeys(k for b in got["blocks"] for k in b.kinds))
                    spans = [{"start": s, "end": e} for b in got["blocks"] for s, e in b.spans]
                    row |= {"raw_chars": len(raw), "titles": got["titles"], "kinds": kinds, "spans": spans, "flags": got["flags"], "text": got["text"]}
                except (ValueError, RecursionError, AssertionError) as e:
                    row["error"] = type(e).__name__
                yield pa.RecordBatch.from_pylist([row], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(T._parse_datatype_string(SECTIONS))
    return documents.select("path", "content").mapInArrow(run, SECTIONS)


def census(found: DataFrame) -> DataFrame:
    """Flags over a corpus, with blocks of any number as one flag, and the documents that carry them."""
    each = found.select("path", F.explode("flags").alias("flag"))
    return each.groupBy(F.regexp_replace("flag", r"\d+", "n").alias("flag")).agg(F.count_distinct("path").alias("documents"))


def inventory(found: DataFrame, scope: DataFrame, chars_a_token: float = 4.0, shares: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.9, 0.99)) -> DataFrame:
    """sections() and scope (path, in_scope) -> one row a corpus: documents, located ones, the gate (in scope, with a statement title),
    coverage of the located, exact quantiles of their size in tokens, and how much smaller the text is than the document."""
    has = lambda kind: F.coalesce(F.array_contains("kinds", kind), F.lit(False))
    rows = found.join(scope.groupBy("path").agg(F.bool_or("in_scope").alias("__in")), "path", "left").select(
        F.coalesce(F.size("spans") > 0, F.lit(False)).alias("hit"), (F.coalesce("__in", F.lit(False)) & F.coalesce(F.size("titles") > 0, F.lit(False))).alias("gate"),
        has("assets_liabilities").alias("sheet"), has("cash_flows").alias("cash"), has("financial_highlights").alias("highlights"),
        F.length("text").alias("chars"), "raw_chars", F.col("error").isNotNull().alias("failed"),
    )
    tokens = F.when(F.col("hit"), F.ceil(F.col("chars") / chars_a_token))
    located = lambda c: F.count_if(F.col("hit") & F.col(c))
    kept = F.sum(F.when(F.col("hit"), F.col("chars"))) / F.nullif(F.sum(F.when(F.col("hit"), F.col("raw_chars"))), F.lit(0))
    return rows.agg(
        F.count(F.lit(1)).alias("documents"), F.count_if("failed").alias("failed"), F.count_if("hit").alias("located"), F.count_if("gate").alias("in_gate"), F.count_if(F.col("gate") & F.col("hit")).alias("gate_hits"),
        located("sheet").alias("balance_sheets"), located("cash").alias("cash_flows"), located("highlights").alias("highlights"),
        F.percentile(tokens, F.array(*map(F.lit, shares))).alias("tokens"), F.avg(tokens).alias("mean_tokens"), (1 - kept).alias("smaller"),
    )


CONTEXT = r"(?is)<xbrli:context\b[^>]*\bid\s*=\s*[\"']([^\"']+)[\"'][^>]*>(.*?)</xbrli:context\s*>"
FACT = r"(?is)<ix:(?:nonFraction|nonNumeric)\b[^>]*>.*?</ix:(?:nonFraction|nonNumeric)\s*>"


def _one(text: Column, pattern: str) -> Column:
    return F.nullif(F.trim(F.regexp_extract(text, pattern, 1)), F.lit(""))


def displayed_value(text: Column, scale: Column, sign: Column) -> Column:
    """'(237,536)' with scale 3 -> -237536000; brackets and a minus sign negate once."""
    plain = F.trim(F.regexp_replace(text, "[,$%]", ""))
    brackets = plain.rlike(r"^\(.*\)$")
    number = F.trim(F.regexp_replace(plain, "[()]", "")).try_cast("double") * F.pow(F.lit(10.0), F.coalesce(scale.try_cast("int"), F.lit(0)))
    return F.when(brackets | F.coalesce(sign == "-", F.lit(False)), -number).otherwise(number)


def inline_values(documents: DataFrame) -> DataFrame:
    """documents (path, text) -> (path, position, concept, value, text, period_start, period_end, member) of tagged values;
    nil and empty ones are left out. Built-in functions only; a value joins its context inside its document."""
    contexts = F.transform(F.regexp_extract_all("text", F.lit(CONTEXT), F.lit(0)), lambda c: F.struct(
        F.regexp_extract(c, CONTEXT, 1).alias("id"), _one(c, r"(?i)<xbrli:startDate\s*>\s*(\d{4}-\d{2}-\d{2})").try_cast("date").alias("start"),
        _one(c, r"(?i)<xbrli:(?:endDate|instant)\s*>\s*(\d{4}-\d{2}-\d{2})").try_cast("date").alias("end"), _one(c, r"(?i)<xbrldi:explicitMember\b[^>]*>\s*([^<]+)").alias("member")))
    held = documents.select("path", contexts.alias("contexts"), F.regexp_extract_all("text", F.lit(FACT), F.lit(0)).alias("facts"))
    rows = held.select("path", "contexts", F.posexplode("facts").alias("position", "fact"))
    head = F.regexp_extract("fact", r"(?s)^<[^>]*>", 0)
    attribute = lambda name: F.nullif(F.regexp_extract(head, r"(?s)\s" + name + r"\s*=\s*[\"']([^\"']*)[\"']", 1), F.lit(""))
    bare = F.regexp_replace("fact", "(?s)<[^>]*>", "")
    for entity, char in (("&nbsp;", " "), ("&#160;", " "), ("&#xa0;", " "), ("&#36;", "$"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    shown = F.trim(F.regexp_replace(bare, r"[\s ]+", " "))
    out = rows.select("path", "position", "contexts", attribute("name").alias("concept"), attribute("contextRef").alias("ref"), attribute("scale").alias("scale"), attribute("sign").alias("sign"),
                      F.coalesce(F.lower(attribute("xs:nil")), F.lit("")).alias("nil"), head.rlike("(?i)^<ix:nonFraction").alias("numeric"), F.nullif(shown, F.lit("")).alias("shown"))
    context = F.get(F.filter("contexts", lambda c: c["id"] == F.col("ref")), F.lit(0))
    value = F.when(F.col("numeric"), displayed_value(F.col("shown"), F.col("scale"), F.col("sign")))
    return out.filter("concept is not null and shown is not null and nil <> 'true'").withColumn("c", context).select(
        "path", "position", "concept", value.alias("value"), F.col("shown").alias("text"), F.col("c.start").alias("period_start"), F.col("c.end").alias("period_end"), F.col("c.member").alias("member")
    )


def member_words(member: Column) -> Column:
    """'XCAPX:ClassAMember' -> 'Class A'."""
    bare = F.regexp_replace(F.regexp_replace(member, "^[^:]*:", ""), "Member$", "")
    return F.nullif(F.trim(F.regexp_replace(bare, "(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ")), F.lit(""))


def values_at(values: DataFrame, dates: DataFrame) -> DataFrame:
    """dates (path, at): the first undimensioned value of a concept that ends at the day."""
    own = values.join(dates, "path").filter((F.col("period_end") == F.col("at")) & F.col("member").isNull() & F.col("value").isNotNull())
    return own.groupBy("path", "concept").agg(F.min_by("value", "position").alias("value"))


def requests(found: DataFrame, schema: T.StructType, instruction: str) -> DataFrame:
    """The request table of a model: id (at most 64 characters), prompt, schema. A provider sends it; nothing here calls one."""
    fields = F.lit("\n".join(f"- {f.name}: {f.dataType.simpleString()}" for f in schema.fields))
    prompt = F.concat_ws("\n\n", F.lit(instruction), fields, "text")
    return found.filter("text <> ''").select(F.substring(F.sha2(F.col("path").cast("binary"), 256), 1, 64).alias("id"), "path", prompt.alias("prompt"), F.lit(json.dumps(schema.jsonValue())).alias("schema"))


def responses(answers: DataFrame, schema: T.StructType) -> DataFrame:
    """answers (id, stop_reason, body) -> record and status: refused, truncated, empty, invalid or ok."""
    marked = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    record = F.from_json("body", marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    read = answers.withColumn("record", record)
    status = (
        F.when(F.col("stop_reason") == "refusal", "refused").when(F.col("stop_reason") == "max_tokens", "truncated").when(F.coalesce(F.trim("body"), F.lit("")) == "", "empty")
        .when(F.col("record").isNull() | F.col("record._bad").isNotNull(), "invalid").otherwise("ok")
    )
    names = [f.name for f in schema.fields]
    return read.select("id", status.alias("status"), F.when(status == "ok", F.struct(*[F.col(f"record.{n}").alias(n) for n in names])).alias("record"))


def scaled(value: Column, kind: Column, amounts: Column, shares: Column) -> Column:
    """A number as printed in actual units: amounts and shares by their own scale, percents as fractions, per-share as is."""
    factor = lambda c: F.when(c == "thousands", 1e3).when(c == "millions", 1e6).otherwise(1.0)
    return F.when(kind == "amount", value * factor(amounts)).when(kind == "shares", value * factor(shares)).when(kind == "percent", value / 100).otherwise(value)


def agreement(read: Column, tagged: Column, trusted: Column) -> Column:
    """Confidence of a read value: 0.40 against a differing tag, 0.60 without trust in the document's identity, 0.97 with an
    agreeing tag (within 1 %), else 0.80."""
    both = F.greatest(F.abs(read), F.abs(tagged))
    close = F.when((read == 0) & (tagged == 0), True).otherwise(F.abs(read - tagged) / F.nullif(both, F.lit(0.0)) <= 0.01)
    return F.when(tagged.isNotNull() & ~close, 0.40).when(~F.coalesce(trusted, F.lit(False)), 0.60).when(close, 0.97).otherwise(0.80)


def cost(located: DataFrame, per_million_in: float, per_million_out: float, overhead: int, expected_out: int) -> DataFrame:
    """located (period, tokens, located) -> one row: distinct located periods, their mean request with its overhead, what all would cost."""
    one = located.filter("located").groupBy("period").agg(F.max("tokens").alias("tokens"))
    each = F.coalesce(F.avg("tokens"), F.lit(0.0)) + overhead
    spent = F.count(F.lit(1)) * (each / 1e6 * per_million_in + expected_out / 1e6 * per_million_out)
    return one.agg(F.count(F.lit(1)).alias("periods"), each.alias("tokens_in"), spent.alias("cost"))

"""Issuer strings: parsing, keys, and clusters of names for the same issuer."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.steps import step as _step
from ..sources.staging import staged
from .graph import components

DASHES = "[�\u0096\u0097–—]"
SUBTOTAL = r"(?i)\b(total|subtotal)\b"
PERCENT_ONLY = r"^[^a-zA-Z]*\( *\d+\.?\d* *% *\) *$"
ATTRIBUTE = r"(?i)\b(" + "|".join(V.ATTRIBUTES) + r")\b"


def heading_pattern(headings: list[str] = V.HEADINGS) -> str:
    """One anchored pattern for a run of headings, stray percentages, numbers and dashes. More words go first; a word may
    carry punctuation at its ends, and '&' reads as 'and'."""

    def escaped(word: str) -> str:
        return "".join(c if c.isalnum() else "[" + c + "]" for c in word.strip(" ,.:;-"))

    def phrase(text: str) -> str:
        return r"\s+".join(r"[,.:;-]*" + ("(and|&)" if w == "and" else escaped(w)) + r"[,.:;-]*" for w in text.split())

    ordered = sorted(dict.fromkeys(headings), key=lambda h: -len(h.split()))
    stray = [r"[-–—(]*\d+(\.\d+)?\s*%[)]*", r"[-–—:;,.]+", r"\d+(\.\d+)?"]
    return r"(?i)^\s*((" + "|".join(stray + [phrase(h) for h in ordered]) + r")(\s+|$))+"


HEADING = heading_pattern()


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def plain_dashes(text: Column) -> Column:
    """Dashes of any encoding as ' - ', runs of spaces as one."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, DASHES, " - "), r"\s+", " "))


def normalised(name: Column) -> Column:
    """Lower case without brackets, punctuation and legal suffixes; nothing left is null."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(name), r"\([^)]*\)", " "), r"[^a-z0-9&\s]", " ")
    plain = F.regexp_replace(plain, r"\b(" + "|".join(V.SUFFIXES) + r")\b", " ")
    return blank_to_null(F.trim(F.regexp_replace(plain, r"\s+", " ")))


def core(norm: Column) -> Column:
    """Distinct, sorted words that tell issuers apart; empty if there are none."""
    keep = F.filter(F.split(F.coalesce(norm, F.lit("")), " "), lambda w: (F.length(w) >= 2) & ~w.isin(V.GENERIC) & ~w.rlike("^[0-9]+$"))
    return F.array_join(F.array_sort(F.array_distinct(keep)), " ")


def first_label(text: Column, ladder: list[tuple[str, str]]) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for pattern, label in ladder:
        out = out.when(F.lower(text).rlike(pattern), label)
    return out


def parse(df: DataFrame, raw: str = "issuer") -> DataFrame:
    """Adds issuer_name, instrument_text, parse_ok, issuer_norm, seniority and instrument_type. All in built-in functions.

    'Name, Suffix, Sector, Instrument', 'Name - Instrument' or a path of headings; a tail of attributes goes to
    instrument_text. Not a holding (null, junk, percentages, totals) or without a telling word: parse_ok is false.
    """
    s = F.col("__s")
    out = _step(df, __s=plain_dashes(F.col(raw)))
    rejected = F.col(raw).isNull() | F.lower(s).isin(V.JUNK) | s.rlike(PERCENT_ONLY) | s.rlike(SUBTOTAL)
    out = _step(out, __a=F.when(~rejected, s), __at=F.regexp_instr(s, F.lit(ATTRIBUTE)))
    cut = F.col("__at") > 1
    head = F.when(cut, F.btrim(F.expr("substring(__a, 1, __at - 1)"), F.lit(" ,-:"))).otherwise(F.col("__a"))
    # headings, then a copy's number at the end
    bare = F.regexp_replace(F.regexp_replace(head, HEADING, ""), r"^[ ,:-]+", "")
    out = _step(out, __n=F.trim(F.regexp_replace(F.trim(bare), r"\s+\d{1,2}$", "")), __tail=F.when(cut, F.expr("substring(__a, __at)")))

    # commas: the parts after the first belong to the name as long as they are suffixes; one with a dash ends it
    legal = [*V.LEGAL, *(w.rstrip(".") for w in V.LEGAL)]
    word = lambda p: F.rtrim(F.lower(p), F.lit("."))
    suffix = lambda p: word(p).isin(legal) | F.get(F.split(word(p), " "), F.lit(0)).isin(legal) | p.startswith("(") | word(p).rlike("d/b/a|f/k/a|fka|dba")
    out = _step(out, __p=F.filter(F.transform(F.split("__n", ","), lambda p: F.trim(p)), lambda p: p != ""))
    out = _step(out, __rest=F.when(F.size("__p") > 1, F.slice("__p", F.lit(2), F.greatest(F.size("__p") - 1, F.lit(1)))).otherwise(F.array().cast("array<string>")))
    out = _step(out, __own=F.transform("__rest", suffix), __split=F.transform("__rest", lambda p: p.contains(" - ")))
    stop = F.array_position("__own", F.lit(False))
    out = _step(out, __stop=F.when(stop > 0, stop).otherwise((F.size("__rest") + 1).cast("long")), __dashed=F.array_position("__split", F.lit(True)))
    out = _step(out, __dash=F.when((F.col("__dashed") > 0) & (F.col("__dashed") < F.col("__stop")), F.col("__dashed")))
    last = F.coalesce("__dash", F.col("__stop") - 1).cast("int")  # parts of rest inside the name
    name_parts = F.concat(F.slice("__p", 1, 1), F.transform(F.slice("__rest", F.lit(1), last), lambda p: F.split(p, " - ", 2)[0]))
    after = F.slice("__rest", F.col("__stop").cast("int"), F.greatest(F.size("__rest"), F.lit(0)))
    comma_text = F.when(F.col("__dash").isNotNull(), F.trim(F.split(F.get("__rest", (F.col("__dash") - 1).cast("int")), " - ", 2)[1])).otherwise(blank_to_null(F.array_join(after, ", ")))

    has_comma, has_dash, halves = F.col("__n").contains(","), F.col("__n").contains(" - "), F.split("__n", " - ", 2)
    name = F.when(has_comma, F.when(F.size("__p") > 0, F.array_join(name_parts, ", "))).when(has_dash, F.trim(halves[0])).otherwise(F.col("__n"))
    text = F.when(has_comma, comma_text).when(has_dash, blank_to_null(F.trim(F.get(halves, F.lit(1)))))
    out = _step(out, issuer_name=blank_to_null(name), instrument_text=blank_to_null(F.concat_ws(" ", text, "__tail")))
    out = _step(out, issuer_norm=normalised(F.col("issuer_name")))
    fine = F.col("issuer_name").isNotNull() & ~F.lower("issuer_name").isin(V.JUNK) & ~F.col("issuer_name").rlike(SUBTOTAL) & (F.length("issuer_name") > 1) & (core(F.col("issuer_norm")) != "")
    whole = F.concat_ws(" ", F.col(raw), "instrument_text")
    out = _step(out, parse_ok=F.coalesce(fine, F.lit(False)), seniority=first_label(whole, V.SENIORITY), instrument_type=first_label(whole, V.INSTRUMENT))
    return out.drop("__s", "__a", "__at", "__n", "__tail", "__p", "__rest", "__own", "__split", "__stop", "__dashed", "__dash")


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit per character of a."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    rest = full  # a zero bit: the subsequence grows there
    for c in b:
        hit = rest & masks.get(c, 0)
        rest = ((rest + hit) | (rest - hit)) & full
    return len(a) - rest.bit_count()


def sorted_ratio(a: str | None, b: str | None) -> float | None:
    """0 to 100: twice the common subsequence of the texts with sorted words, over both lengths."""
    if a is None or b is None:
        return None
    a, b = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    return 200.0 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def similarity(a: Column | str, b: Column | str) -> Column:
    """sorted_ratio over Arrow batches; Spark's levenshtein counts a substitution once and is no stand-in."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([sorted_ratio(p, q) for p, q in zip(x, y, strict=True)], dtype="float64")

    return ratio(a, b)


def core_pairs(cores: DataFrame, threshold: float = 92.0, largest: int | None = 1500) -> DataFrame:
    """cores (core), distinct -> (a, b, score) of cores that share a word and are at least threshold alike.

    A word that more than `largest` cores hold links nothing, which bounds each block; None lets every word link, at a cost
    that grows with the square of its cores. The length bound
    200 * shorter / both >= threshold is exact and is tested before any text is compared."""
    words = cores.select("core", F.explode(F.array_distinct(F.split("core", " "))).alias("word"), F.length("core").alias("n"))
    counts = words.groupBy("word").count().filter("count > 1")
    sizes = (counts if largest is None else counts.filter(F.col("count") <= largest)).select("word")
    blocks = words.join(sizes, "word")
    x, y = blocks.alias("x"), blocks.alias("y")
    near = (F.col("x.word") == F.col("y.word")) & (F.col("x.core") < F.col("y.core")) & (200.0 * F.least("x.n", "y.n") >= threshold * (F.col("x.n") + F.col("y.n")))
    pairs = x.join(y, near).select(F.col("x.core").alias("a"), F.col("y.core").alias("b")).distinct()
    return pairs.withColumn("score", similarity("a", "b")).filter(F.col("score") >= threshold)


def clusters(names: DataFrame, threshold: float = 92.0, largest: int | None = 1500) -> DataFrame:
    """names (norm, rows), norm distinct -> (norm, issuer_cluster). Equal cores are one cluster, then similar cores; names
    without a core stay alone. A cluster's name has the fewest words, then the most rows, then comes first."""
    keyed = staged(names.select("norm", "rows", core(F.col("norm")).alias("core")), "cores")
    known = keyed.filter("core <> ''")
    linked = components(core_pairs(known.select("core").distinct(), threshold, largest).select("a", "b"))
    grouped = known.join(linked.withColumnRenamed("node", "core"), "core", "left").withColumn("group", F.coalesce("component", "core"))
    key = F.struct(F.size(F.split("norm", " ")), -F.col("rows"), F.col("norm"))
    best = grouped.groupBy("group").agg(F.min_by("norm", key).alias("issuer_cluster"))
    return grouped.join(best, "group").select("norm", "issuer_cluster").unionByName(keyed.filter("core = ''").select("norm", F.col("norm").alias("issuer_cluster")))

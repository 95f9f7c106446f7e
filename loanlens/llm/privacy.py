"""Information-theoretic sanitisation of personal data (DataFrame functions only).

Base detectors find protected entities (e-mail, ip, card, phone). The corpus then tells which ordinary terms reveal them.
The documents that hold an entity are what it is known by: with n(t, e) the occurrences of term t in the documents that
hold entity e, n(t) all occurrences of t in the corpus and n(e) those of e, the share of the entity's information that t
discloses is PMI(t; e) / IC(e) = 1 + log(n(t, e) / n(t)) / -log(n(e) / N), N being the corpus's words. Terms that disclose
at least `generalise` of it are spans of kind `term` wherever they stand in a document that holds the entity, and those of
at least `remove` are cut out instead of generalised.

Which terms are tried: all of every document that holds the entity, if they stand in at least `support` of these documents
(told by doc_id, or by text where it is null). An entity of a single document has no such term: one document tells nothing
about co-occurrence, every rare word in it would count. Entities of the same documents occur with the same terms, so they are
counted once, as one group. A finite `reach` tries only the terms within so many code points of the entity, up to the next
match of its kind; it changes nothing else.

Defined results: a null text is empty; documents without entities get no spans; rows that repeat a doc_id are scanned each
on their own and share term spans only if their texts are equal; rows with a null doc_id are told by their texts; of two
disclosures of one place the larger counts; texts of any length are scanned whole; an empty table gives no rows. find reads
doc_id and text only; sanitise keeps any further columns, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if, fresh, lower_ascii, scratch, staged, text_hash

# The patterns of the four kinds. Possessive repeats and the look-behinds change no match; they keep
# the scan linear and free of recursion on long runs.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
TERM = r"[A-Za-z\x{80}-\x{10FFFF}]{3,}"
BROADCAST_ROWS = 200_000


@dataclass(frozen=True)
class Disclosure:
    """reach: code points on either side of an entity where its terms are looked for, without end by default: in the whole
    document. support: the least number of documents in which a term stands there."""

    reach: float = math.inf
    support: int = 2
    generalise: float = 0.9
    remove: float = 0.98


def located(text: Column, pattern: str) -> Column:
    """array<struct<start,end,value,before,after>> of the matches, in code points, with the text between matches."""
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    zipped = F.transform(values, lambda v, i: F.struct(v.alias("value"), F.get(gaps, i).alias("before"), F.get(gaps, i + 1).alias("after")))
    none = F.array().cast("array<struct<start:int,end:int,value:string,before:string,after:string>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("found"))

    def add(acc: Column, m: Column) -> Column:
        begin = acc["at"] + F.length(m["before"])
        stop = begin + F.length(m["value"])
        one = F.struct(begin.alias("start"), stop.alias("end"), m["value"].alias("value"), m["before"].alias("before"), m["after"].alias("after"))
        return F.struct(stop.alias("at"), F.concat(acc["found"], F.array(one)).alias("found"))

    return F.when(F.size(values) == 0, none).otherwise(F.aggregate(zipped, start, add)["found"])


def luhn(value: Column) -> Column:
    """Whether the digits of value pass the Luhn check."""
    digits = F.reverse(F.regexp_replace(value, "[^0-9]", ""))
    each = F.transform(F.split(digits, ""), lambda d, i: F.when(i % 2 == 1, d.try_cast("int") * 2).otherwise(d.try_cast("int")))
    total = F.aggregate(each, F.lit(0), lambda a, d: a + F.when(d > 9, d - 9).otherwise(F.coalesce(d, F.lit(0))))
    return total % 10 == 0


def n_digits(value: Column) -> Column:
    return F.length(F.regexp_replace(value, "[^0-9]", ""))


def holds(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return n_digits(value).between(16, 19) & luhn(value)
    if kind == "phone":
        return n_digits(value).between(8, 15)
    return F.lit(True)


def entity_key(kind: str, value: Column) -> Column:
    """What counts as the same entity: the kind and the value without case or punctuation of numbers."""
    return F.concat(F.lit(f"{kind}:"), lower_ascii(value) if kind in ("email", "ip") else F.regexp_replace(value, "[^0-9]", ""))


def scan(docs: DataFrame, reach: float) -> DataFrame:
    """(doc_id, text_hash, n_words, entities): the base entities of every row, by kind and start, with what stands beside them
    if reach is finite."""
    reach = 0 if math.isinf(reach) else int(reach)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("__t"))
    rows = rows.select("doc_id", "__t", *[located(F.col("__t"), p).alias(f"__{k}") for k, p in zip(KINDS, (EMAIL, IP, CARD, PHONE))])

    def kept(kind: str) -> Column:
        good = F.filter(F.col(f"__{kind}"), lambda m: holds(kind, m["value"]))
        return F.transform(
            good,
            lambda m: F.struct(
                F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), entity_key(kind, m["value"]).alias("key"),
                F.substring(m["before"], -reach, reach).alias("before"), (F.length(m["before"]) > reach).alias("cut_before"),
                F.substring(m["after"], 1, reach).alias("after"), (F.length(m["after"]) > reach).alias("cut_after"),
            ),
        )

    return rows.select(
        "doc_id", text_hash(F.col("__t")).alias("text_hash"), F.regexp_count("__t", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_words"),
        F.concat(*[kept(k) for k in KINDS]).alias("entities"),
    )


def beside(scanned: DataFrame) -> DataFrame:
    """(doc_id, text_hash, key, term): the terms within reach of each entity. A term that the reach cuts, and one that is part
    of another entity, does not count."""
    e = scanned.select("doc_id", "text_hash", "entities", F.explode("entities").alias("e"))
    left = F.transform(
        F.filter(located(F.col("e.before"), TERM), lambda m: ~(F.col("e.cut_before") & (m["start"] == 0))),
        lambda m: F.struct(m["value"].alias("value"), (F.col("e.start") - F.length("e.before") + m["start"]).alias("start")),
    )
    right = F.transform(
        F.filter(located(F.col("e.after"), TERM), lambda m: ~(F.col("e.cut_after") & (m["end"] == F.length("e.after")))),
        lambda m: F.struct(m["value"].alias("value"), (F.col("e.end") + m["start"]).alias("start")),
    )
    terms = e.select("doc_id", "text_hash", "entities", F.col("e.key").alias("key"), F.explode(F.concat(left, right)).alias("t"))
    stop = F.col("t.start") + F.length("t.value")
    inside = F.exists("entities", lambda x: (x["start"] < stop) & (x["end"] > F.col("t.start")))
    return terms.filter(~inside).select("doc_id", "text_hash", "key", lower_ascii(F.col("t.value")).alias("term"))


ROW = ["doc_id", "text_hash"]


def _same_row() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("__doc_id")) & (F.col("text_hash") == F.col("__text_hash"))


def _other_row(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({c: "__" + c for c in ROW})


def _who() -> Column:
    """What a row's document is told by."""
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("#"), "text_hash")).alias("who")


def carriers(scanned: DataFrame, holders: DataFrame, rule: Disclosure) -> DataFrame:
    """(key, group, carried): the entities of `support` documents or more, with IC(e) and the group they are counted in. Those of
    the same rows are one group (told by two 64-bit hashes of the rows); with a finite reach each is a group of its own."""
    total = scanned.agg(F.greatest(F.sum("n_words"), F.lit(2)).alias("n"))
    rows = [F.bit_xor(F.xxhash64(F.lit(seed), *ROW)).alias(f"rows{seed}") for seed in (1, 2)]
    each = holders.withColumn("who", _who()).groupBy("key").agg(F.sum("times").alias("n_e"), F.count(F.lit(1)).alias("rows"), F.count_distinct("who").alias("n_who"), *rows)
    carried = F.greatest(-F.log(F.least(F.col("n_e"), F.col("n") - 1) / F.col("n")), F.lit(1e-9))
    group = F.concat_ws(":", "rows", "rows1", "rows2") if math.isinf(rule.reach) else F.col("key")
    known = each.filter(F.col("n_who") >= rule.support).join(F.broadcast(total))  # total is one row
    return known.select("key", group.alias("group"), carried.alias("carried"))


def tried(scanned: DataFrame, own: DataFrame, found: DataFrame, rule: Disclosure) -> DataFrame:
    """(group, term, n_te): the terms to test against each group, with their places in its documents. own: (doc_id, text_hash,
    group); found: the places of all terms in them, each in so many equal rows (copies)."""
    counts = _other_row(found.groupBy(*ROW, "term").agg(F.sum("copies").alias("n")))
    each = own.join(counts, _same_row()).select("group", "term", _who(), "n").groupBy("group", "term", "who").agg(F.sum("n").alias("n"))
    pairs = each.groupBy("group", "term").agg(F.sum("n").alias("n_te"), F.count(F.lit(1)).alias("n_who")).filter(F.col("n_who") >= rule.support)
    if not math.isinf(rule.reach):
        near = beside(scanned.filter(F.size("entities") > 0)).select(F.col("key").alias("group"), "term", _who()).distinct()
        near = near.groupBy("group", "term").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") >= rule.support)
        pairs = pairs.join(near, ["group", "term"], "left_semi")
    return pairs.select("group", "term", "n_te")


def occurrences(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(term, n_t): all occurrences in the corpus of the terms of wanted, a staged table."""
    n_wanted = wanted.count()
    tokens = docs.select(F.explode(F.regexp_extract_all(lower_ascii(F.coalesce("text", F.lit(""))), F.lit(TERM), F.lit(0))).alias("term"))
    if n_wanted <= BROADCAST_ROWS:
        tokens = tokens.join(F.broadcast(wanted), "term", "left_semi")
    n_t = tokens.groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))  # counted where they are read, before any shuffle
    return n_t if n_wanted <= BROADCAST_ROWS else n_t.join(wanted, "term", "left_semi")


def places(rows: DataFrame) -> DataFrame:
    """rows (doc_id, text_hash, text), distinct -> (doc_id, text_hash, term, start, end) of every term, in code points. A
    running sum of the lengths of terms and of what stands between them: linear in a text of any length."""
    text = lower_ascii(F.col("text"))
    each = rows.select(*ROW, F.posexplode(F.arrays_zip(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)).alias("term"), F.split(text, TERM, -1).alias("gap"))).alias("k", "z"))
    upto = F.sum(F.length("z.gap") + F.length("z.term")).over(Window.partitionBy(*ROW).orderBy("k"))
    ended = each.filter("z.term is not null").withColumn("end", upto.cast("int"))
    return ended.select(*ROW, F.col("z.term").alias("term"), (F.col("end") - F.length("z.term")).alias("start"), "end")


def revealing(docs: DataFrame, scanned: DataFrame, rule: Disclosure) -> DataFrame:
    """(doc_id, text_hash, start, end, disclosed): every place of a term in a document that holds an entity of which the term
    discloses at least `generalise`."""
    each = scanned.select(*ROW, F.explode("entities.key").alias("key"))
    holders = staged(each.groupBy(*ROW, "key").agg(F.count(F.lit(1)).alias("times")), "holders")
    known = staged(carriers(scanned, holders, rule), "carriers")
    n_known = known.count()
    groups = known.groupBy("group").agg(F.max("carried").alias("carried"))  # the rarest entity is the one that most is told of
    own = staged(holders.join(broadcast_if(known.select("key", "group"), n_known, BROADCAST_ROWS), "key").select(*ROW, "group").distinct(), "own-groups")
    held = staged(own.select(*ROW).distinct(), "held")
    keyed = docs.select("doc_id", text_hash(F.col("text")).alias("text_hash"), "text")
    texts = keyed.join(broadcast_if(_other_row(held), held.count(), BROADCAST_ROWS), _same_row(), "left_semi").dropDuplicates(ROW)
    spans = F.transform("entities", lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"))).alias("entities")
    rows = scanned.filter(F.size("entities") > 0).select(*ROW, spans)
    entities = _other_row(rows.groupBy(*ROW).agg(F.first("entities").alias("entities"), F.count(F.lit(1)).alias("copies")))  # equal for equal rows
    inside = F.exists("entities", lambda x: (x["start"] < F.col("end")) & (x["end"] > F.col("start")))
    found = staged(places(texts).join(entities, _same_row()).filter(~inside).select(*ROW, "term", "start", "end", "copies"), "places")
    pairs = staged(tried(scanned, own, found, rule), "tried")
    n_t = occurrences(docs, staged(pairs.select("term").distinct(), "terms"))
    seen = F.least(F.col("n_te") / F.greatest("n_t", "n_te"), F.lit(1.0))
    told = pairs.join(n_t, "term").join(broadcast_if(groups, n_known, BROADCAST_ROWS), "group").withColumn("disclosed", 1 + F.log(seen) / F.col("carried"))
    passed = staged(told.filter(F.col("disclosed") >= rule.generalise).select("group", "term", "disclosed"), "disclosures")
    marked = own.join(broadcast_if(passed, passed.count(), BROADCAST_ROWS), "group").groupBy(*ROW, "term").agg(F.max("disclosed").alias("disclosed"))
    same = _same_row() & (F.col("term") == F.col("t"))
    return found.join(_other_row(marked.withColumnRenamed("term", "t")), same).select(*ROW, "start", "end", "disclosed")


def find(docs: DataFrame, rule: Disclosure = Disclosure()) -> DataFrame:
    """(doc_id, text_hash, spans) a row per row of docs. spans: array<struct<kind,start,end,disclosed>> of all kinds;
    base entities first by kind and start (disclosed null), then the term spans by start."""
    with scratch() as kept:
        scanned = staged(scan(docs, rule.reach), "entities")
        terms = F.array_sort(F.collect_list(F.struct(F.lit("term").alias("kind"), "start", "end", "disclosed"))).alias("__terms")
        flagged = staged(revealing(docs, scanned, rule).groupBy(*ROW).agg(terms), "term-spans")
        kept += [scanned, flagged]
    base = F.transform(
        "entities", lambda e: F.struct(e["kind"].alias("kind"), e["start"].alias("start"), e["end"].alias("end"), F.lit(None).cast("double").alias("disclosed"))
    )
    none = F.array().cast("array<struct<kind:string,start:int,end:int,disclosed:double>>")
    return scanned.join(broadcast_if(_other_row(flagged), flagged.count(), BROADCAST_ROWS // 10), _same_row(), "left").select(
        "doc_id", "text_hash", F.concat(base, F.coalesce("__terms", none)).alias("spans")
    )


def sanitise(docs: DataFrame, rule: Disclosure = Disclosure()) -> DataFrame:
    """docs with the spans in text replaced: entities by [KIND], generalised terms by [TERM], removed ones by nothing.

    All columns of docs are kept; a null text stays null. Where spans overlap, the one that starts first counts.
    """
    key, doc, own, marks = fresh(docs, "key", "doc", "own", "spans")
    spans = find(docs, rule).select(F.col("doc_id").alias(doc), F.col("text_hash").alias(own), F.col("spans").alias(marks)).filter(F.size(marks) > 0)
    spans = staged(spans.groupBy(doc, own).agg(F.first(marks).alias(marks)), "spans")  # equal for rows with equal text
    ordered = F.array_sort(F.transform(marks, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["disclosed"].alias("disclosed"))))
    mark = lambda s: F.when(s["kind"] != "term", F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).when(s["disclosed"] >= rule.remove, F.lit("")).otherwise(F.lit("[TERM]"))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        said = F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(F.substring("text", acc["at"] + 1, s["start"] - acc["at"]), mark(s))).alias("out"))
        return F.when(s["start"] < acc["at"], acc).otherwise(said)

    clean = F.aggregate(ordered, begin, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring("text", acc["at"] + 1, F.lit(2**31 - 1))))
    joined = docs.withColumn(key, text_hash(F.col("text"))).join(spans, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(key) == F.col(own)), "left")
    return joined.withColumn("text", F.when(F.col(marks).isNotNull() & F.col("text").isNotNull(), clean).otherwise(F.col("text"))).select(docs.columns)

"""Benchmark decontamination over a distributed positional inverted index (DataFrame functions only).

build_index stores a posting (term_id, row, pos) for every document word that any test item uses, and one for the end of each
document, whose position is its number of words: the texts are read once. A test window is looked
up from its rarest term: the offset-adjusted posting list of that term is intersected with the second rarest, and the
survivors with all the remaining terms, so common terms are only met in documents that two rare ones already agree on.

A row is told by its doc_id and a hash of its text, so rows that share a doc_id, or have none, keep positions of their own.
Defined results: a null or empty text has no words; an item without words has no window; rows with equal doc_id and text get
equal results each; benchmark rows that repeat an item_id are one item with the windows of all of them, and one without
item_id is found but not listed. Terms of equal rarity are taken by term id and offset, which changes no result. Texts of
any length are indexed whole. Only doc_id, text and item_id, text are read, so any further columns may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if, scratch, staged, text_hash, words_of

#: Sides of more counted rows are shuffled instead of broadcast.
BROADCAST_ROWS = 1_000_000
ROW = ["doc_id", "text_hash"]
#: The term of the posting behind the last word of a document; no word is empty and no term of a test has this id.
END, END_ID = "", -1


@dataclass
class TestSet:
    """vocabulary(term, term_id), terms(win_id, length, offset, term_id), members(win_id, item_id)."""

    vocabulary: DataFrame
    terms: DataFrame
    members: DataFrame
    n_vocabulary: int
    n_windows: int
    n_members: int
    window: int


@dataclass
class Index:
    postings: DataFrame
    frequencies: DataFrame


def same_row(left: str = "", right: str = "__") -> Column:
    return F.col(f"{left}doc_id").eqNullSafe(F.col(f"{right}doc_id")) & (F.col(f"{left}text_hash") == F.col(f"{right}text_hash"))


def other_row(df: DataFrame, prefix: str = "__") -> DataFrame:
    """df with its row columns renamed for a join by same_row."""
    return df.withColumnsRenamed({c: prefix + c for c in ROW})


def rows_of(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", text_hash(F.col("text")).alias("text_hash"), words_of(F.col("text")).alias("words"))


def build_tests(items: DataFrame, window: int = 10) -> TestSet:
    """Cuts each item into its windows of `window` words (one shorter window for a shorter item)."""
    if not 1 <= window <= 60:
        raise ValueError("window must be 1 to 60 words")
    words = items.select("item_id", words_of(F.col("text")).alias("words")).filter(F.size("words") > 0)
    last = F.greatest(F.size("words") - window, F.lit(0))
    at = words.select("item_id", "words", F.explode(F.sequence(F.lit(0), last)).alias("k"))
    cut = staged(at.select("item_id", F.slice("words", F.col("k") + 1, F.lit(window)).alias("win")).distinct(), "cut")
    windows = staged(cut.select("win").distinct().withColumn("win_id", F.monotonically_increasing_id()), "windows")
    n_windows = windows.count()
    members = staged(cut.join(broadcast_if(windows, n_windows, BROADCAST_ROWS // 10), "win").select("win_id", "item_id"), "members")
    vocabulary = staged(
        windows.select(F.explode("win").alias("term")).distinct().withColumn("term_id", F.monotonically_increasing_id()), "vocabulary"
    )
    n_vocabulary = vocabulary.count()
    terms = windows.select("win_id", F.size("win").alias("length"), F.posexplode("win").alias("offset", "term")).join(
        broadcast_if(vocabulary, n_vocabulary, BROADCAST_ROWS), "term"
    )
    return TestSet(vocabulary, staged(terms.drop("term"), "window-terms"), members, n_vocabulary, n_windows, members.count(), window)


def build_index(docs: DataFrame, tests: TestSet) -> Index:
    """Postings of all test terms over the whole corpus and of the end of each row, with each test term's number of postings."""
    tokens = rows_of(docs).select(*ROW, F.posexplode(F.concat("words", F.array(F.lit(END)))).alias("pos", "term"))
    end = tests.vocabulary.sparkSession.range(1).select(F.lit(END).alias("term"), F.lit(END_ID).cast("long").alias("term_id"))
    terms = tests.vocabulary.select("term", "term_id").unionByName(end)
    postings = staged(tokens.join(broadcast_if(terms, tests.n_vocabulary, BROADCAST_ROWS), "term").select("term_id", *ROW, "pos"), "postings")
    frequencies = staged(postings.filter(F.col("term_id") != END_ID).groupBy("term_id").agg(F.count(F.lit(1)).alias("df")), "frequencies")
    return Index(postings, frequencies)


def lengths(index: Index) -> DataFrame:
    """(doc_id, text_hash, n_words), a row per row of the documents."""
    return index.postings.filter(F.col("term_id") == END_ID).select(*ROW, F.col("pos").cast("long").alias("n_words"))


def with_rarity(tests: TestSet, index: Index) -> DataFrame:
    """tests.terms with df; at most a row per term is broadcast, so no term's windows meet in one task."""
    return tests.terms.join(broadcast_if(index.frequencies, tests.n_vocabulary, BROADCAST_ROWS), "term_id", "left")


def ranked_terms(tests: TestSet, index: Index) -> DataFrame:
    """The terms of each window that can occur, rarest first (rarity 1, 2, ...)."""
    whole = Window.partitionBy("win_id")
    return (
        with_rarity(tests, index)
        .withColumn("missing", F.max(F.col("df").isNull()).over(whole))
        .filter(~F.col("missing"))
        .withColumn("rarity", F.row_number().over(whole.orderBy("df", "term_id", "offset")))
        .select("win_id", "length", "offset", "term_id", "rarity")
    )


def _postings_of(index: Index, found: DataFrame) -> DataFrame:
    """The postings of the rows found, as (t, __doc_id, __text_hash, q)."""
    found = staged(found.select(*ROW).distinct(), "found")
    here = index.postings.join(broadcast_if(other_row(found), found.count(), BROADCAST_ROWS), same_row(), "left_semi")
    return other_row(here.select(F.col("term_id").alias("t"), *ROW, F.col("pos").alias("q")))


def _in_place() -> Column:
    """Whether the posting (t, __row, q) stands where the window that starts at `start` has its term."""
    return (F.col("term_id") == F.col("t")) & same_row() & (F.col("start") + F.col("offset") == F.col("q"))


def phrase_matches(tests: TestSet, index: Index) -> DataFrame:
    """Every place where a whole window occurs: (win_id, length, doc_id, text_hash, start)."""
    ranked = staged(ranked_terms(tests, index), "ranked")
    postings = index.postings
    rarest = broadcast_if(ranked.filter("rarity = 1"), tests.n_windows, BROADCAST_ROWS)
    first = postings.join(rarest, "term_id").withColumn("start", F.col("pos") - F.col("offset")).filter("start >= 0")
    first = first.select("win_id", "length", *ROW, "start")
    single = first.filter("length = 1")
    # second rarest: offset-adjusted lists meet on (term, row, position)
    second = ranked.filter("rarity = 2").select("win_id", "offset", "term_id")
    wanted = first.filter("length > 1").join(broadcast_if(second, tests.n_windows, BROADCAST_ROWS), "win_id")
    seconds = second.select("term_id").distinct()
    lists = postings.join(broadcast_if(seconds, tests.n_vocabulary, BROADCAST_ROWS), "term_id", "left_semi")
    shifted = other_row(lists.select(F.col("term_id").alias("t"), *ROW, F.col("pos").alias("q")))
    both = staged(wanted.join(shifted, _in_place(), "left_semi").select("win_id", "length", *ROW, "start"), "two-rarest")
    others = broadcast_if(ranked.filter("rarity > 2").drop("length"), tests.n_windows, BROADCAST_ROWS // 10)
    agreed = (
        both.filter("length > 2").join(others, "win_id").join(_postings_of(index, both), _in_place())
        .groupBy("win_id", "length", *ROW, "start")
        .agg(F.bit_count(F.expr("bit_or(shiftleft(1L, offset))")).alias("n"))
        .filter("n = length - 2")
        .drop("n")
    )
    return single.unionByName(both.filter("length = 2")).unionByName(agreed).distinct()


def proximity_matches(tests: TestSet, index: Index, terms: int = 3, slop: int = 20) -> DataFrame:
    """Looser matches: (win_id, doc_id, text_hash, pos) where the window's `terms` rarest distinct terms all lie within
    `slop` words of the posting at pos of the rarest one. Position blocks of `slop` words make it an equi-join."""
    distinct = Window.partitionBy("win_id").orderBy("df", "term_id")
    once = with_rarity(tests, index).filter("df is not null").select("win_id", "term_id", "df").distinct()
    ranked = staged(once.withColumn("rarity", F.row_number().over(distinct)).filter(F.col("rarity") <= terms), "nearest")
    need = ranked.groupBy("win_id").agg((F.count(F.lit(1)) - 1).alias("need"))
    first = ranked.filter("rarity = 1").select("win_id", "term_id").join(need, "win_id")
    anchors = index.postings.join(broadcast_if(first, tests.n_windows, BROADCAST_ROWS), "term_id").select(
        "win_id", *ROW, F.col("pos").alias("at"), "need"
    )
    alone = anchors.filter("need = 0").select("win_id", *ROW, F.col("at").alias("pos"))
    block = F.floor(F.col("at") / slop)
    rest = broadcast_if(ranked.filter("rarity > 1").select("win_id", "term_id"), tests.n_windows, BROADCAST_ROWS // 10)
    wanted = anchors.filter("need > 0").join(rest, "win_id").withColumn("block", F.explode(F.array(block - 1, block, block + 1)))
    lists = other_row(index.postings.select(F.col("term_id").alias("t"), *ROW, "pos", F.floor(F.col("pos") / slop).alias("b")))
    close = (F.col("term_id") == F.col("t")) & same_row() & (F.col("block") == F.col("b")) & (F.abs(F.col("pos") - F.col("at")) <= slop)
    near = wanted.join(lists, close, "left_semi")
    return (
        near.groupBy("win_id", *ROW, "at", "need").agg(F.count_distinct("term_id").alias("n")).filter("n = need")
        .select("win_id", *ROW, F.col("at").alias("pos")).unionByName(alone)
    )


def near_matches(docs: DataFrame, tests: TestSet) -> DataFrame:
    """Verified looser matches: every (win_id, doc_id, text_hash, start) where at least four fifths of the window's words
    stand in their places. Cut into one block more than words may be missing, a window has a whole block in any such place:
    the first three words of its blocks (two of a window of five words) are looked up, and each start they give is
    verified against the window's words where the text is read, so only matches are shuffled."""
    may_miss = F.floor(F.col("length") / 5).cast("int")
    terms = tests.terms.select("win_id", "length", "offset", "term_id", may_miss.alias("may_miss")).filter("may_miss > 0")
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("offset", "term"))), lambda x: x["term"])  # 60 words at most
    named = terms.join(broadcast_if(tests.vocabulary, tests.n_vocabulary, BROADCAST_ROWS), "term_id")
    words = named.groupBy("win_id", "length", "may_miss").agg(in_order.alias("own"))
    at = F.expr("cast(floor(block * length / (may_miss + 1)) as int)")
    blocks = words.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("may_miss")))).withColumn("at", at)
    two, three = (F.xxhash64(*(F.expr(f"own[at + {k}]") for k in range(n))) for n in (2, 3))
    short = F.col("length") == 5
    keys = staged(blocks.select("win_id", "length", "may_miss", "at", "own", F.when(short, two).otherwise(three).alias("key"), short.alias("short")), "near-keys")
    three_words = F.arrays_zip(
        F.col("words").alias("a"), F.expr("slice(words, 2, size(words))").alias("b"), F.expr("slice(words, 3, size(words))").alias("c")
    )
    places = rows_of(docs).select(*ROW, "words", F.posexplode(three_words).alias("pos", "z"))
    found = None
    for n, is_short in ((3, False), (2, True)):
        own = keys.filter(F.col("short") == is_short).drop("short")
        if is_short and own.isEmpty():
            continue
        hashed = places.select(*ROW, "words", "pos", F.xxhash64(*(F.col(f"z.{c}") for c in "abc"[:n])).alias("k"))
        met = hashed.join(broadcast_if(own, tests.n_windows, BROADCAST_ROWS // 10), F.col("k") == F.col("key"))
        met = met.withColumn("start", F.col("pos") - F.col("at"))
        # spelt out, not as a higher-order function: it stays in the generated code of the join, and no row with a whole text leaves it
        other = lambda i: ~F.get("words", F.col("start") + i).eqNullSafe(F.get("own", F.lit(i)))
        missing = sum(F.when((F.lit(i) < F.col("length")) & other(i), 1).otherwise(0) for i in range(tests.window))
        met = met.filter(missing <= F.col("may_miss")).select("win_id", *ROW, "start")
        found = met if found is None else found.unionByName(met)
    return found.distinct()


def _items(found: DataFrame, tests: TestSet, out: str) -> DataFrame:
    """(doc_id, text_hash, out): the sorted item ids, as strings, of the windows found in each row."""
    named = found.select("win_id", *ROW).distinct().join(broadcast_if(tests.members, tests.n_members, BROADCAST_ROWS), "win_id")
    return named.groupBy(*ROW).agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias(out))


def _hits(matches: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_hit): the words inside any match."""
    spans = matches.groupBy(*ROW, "start").agg(F.max(F.col("start") + F.col("length")).alias("stop"))
    before = Window.partitionBy(*ROW).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max("stop").over(before), F.lit(0))
    new = F.greatest(F.lit(0), F.col("stop") - F.greatest("start", reached))
    return spans.withColumn("new", new).groupBy(*ROW).agg(F.sum("new").cast("long").alias("n_hit"))


def _with_found(rows: DataFrame, found: list[DataFrame]) -> DataFrame:
    """doc_id, n_words, n_hit and the item lists, a row per row of rows (see lengths)."""
    out = rows
    for table in found:
        out = out.join(other_row(table), same_row(), "left").drop("__doc_id", "__text_hash")
    for name in out.columns:
        if name == "n_hit":
            out = out.withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))
        elif name.endswith("items"):
            out = out.withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return out.withColumn("contaminated", F.col("n_hit") > 0).drop("text_hash")


def decontaminate_loosely(docs: DataFrame, items: DataFrame, window: int = 10, terms: int = 3, slop: int = 20) -> DataFrame:
    """The columns of decontaminate and: proximity_items (items with a proximity match), near_items (items with an exact or a
    near match, see near_matches) and near (whether there is any). n_hit and contaminated stay exact."""
    with scratch() as kept:
        tests = build_tests(items, window)
        index = build_index(docs, tests)
        exact = staged(phrase_matches(tests, index), "matches")
        near = near_matches(docs, tests).select("win_id", *ROW).unionByName(exact.select("win_id", *ROW))
        lists = ((exact, "items"), (proximity_matches(tests, index, terms, slop), "proximity_items"), (near, "near_items"))
        found = [staged(_hits(exact), "hits"), *(staged(_items(matches, tests, name), name) for matches, name in lists)]
        rows = staged(lengths(index), "lengths")
        kept += [rows, *found]
    return _with_found(rows, found).withColumn("near", F.size("near_items") > 0)


def near_documents(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """(doc_id, text_hash) of the rows with an exact or a near match of any item, once each."""
    with scratch() as kept:
        tests = build_tests(items, window)
        index = build_index(docs, tests)
        found = phrase_matches(tests, index).select(*ROW).unionByName(near_matches(docs, tests).select(*ROW))
        kept.append(staged(found.distinct(), "contaminated"))
    return kept[0]


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """A row per row of docs: doc_id, n_words, n_hit, items (sorted array of item ids as strings), contaminated."""
    with scratch() as kept:
        tests = build_tests(items, window)
        index = build_index(docs, tests)
        matches = staged(phrase_matches(tests, index), "matches")
        found = _hits(matches).join(other_row(_items(matches, tests, "items")), same_row(), "left").drop("__doc_id", "__text_hash")
        hits, rows = staged(found, "hits"), staged(lengths(index), "lengths")
        kept += [hits, rows]
    return _with_found(rows, [hits])

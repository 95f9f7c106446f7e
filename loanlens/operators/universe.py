"""The fund universe: selection, matching to a directory, filing footprints, additive runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .issuers import similarity

# fmt: off
# Form sets.
FORMS = {
    "merger": ["425", "DEFM14A", "PREM14A", "DEFA14A", "N-14", "N-14/A", "N-14 8C", "N-14 8C/A", "S-4", "S-4/A"],
    "deregistered": ["15-12B", "15-12G", "15-15D", "25", "25-NSE"],
    "withdrawn": ["RW", "AW", "RW WD", "AW WD"],
    "periodic": ["10-K", "10-K/A", "10-Q", "10-Q/A", "N-CSR", "N-CSRS", "N-CSR/A", "N-CSRS/A", "10-KSB", "10-QSB", "10-KSB/A", "N-30D"],
    "listed": ["8-A12B", "25", "25-NSE", "15-12B"],
    "registered": ["N-2", "N-2/A", "N-2 8C", "N-2 8C/A", "N-2MEF", "N-2ASR", "N-2 POS"],
}
SUBSTANTIVE = ["10-K", "10-Q", "N-CSR", "N-CSRS"]
CATEGORY_FORMS = {"interval_fund": ["N-CSR", "N-CSRS", "N-23C3A"], "ncsr_fund": ["N-CSR", "N-CSRS"], "bdc": ["10-K", "10-Q", "SC TO-I"], "reit": ["10-K", "10-Q", "SC TO-I"]}
TYPES = ["Unlisted BDC", "Listed BDC", "Deregistered BDC"]
BOILERPLATE = r"(?i)^(inc|corp|corporation|company|co|llc|l\.?l\.?c|lp|l\.?p|ltd|capital|investment|investments|finance|financial|lending|credit|income|fund|funds|trust|bdc|partners|holdings|group|the|of|and|&|i|ii|iii|iv|v|vi|vii|viii|ix|x)$"
SCHEDULED = r"(?i)venture lending\s*&?\s*leasing|credit income fund\s*20\d\d|\b(19|20)\d\d[- ]?t?\b.*fund|liquidat"
# fmt: on


def selected(universe: DataFrame) -> DataFrame:
    """Funds with a key that are of one of the types or of category bdc; one row a key, by name; other types read 'Unlisted BDC'."""
    own = universe.withColumn("cik", F.trim("cik")).filter((F.col("vehicle_type").isin(TYPES) | (F.col("category") == "bdc")) & (F.col("cik") != ""))
    rest = [c for c in own.columns if c != "cik"]
    first = own.groupBy("cik").agg(F.min_by(F.struct(*rest), F.struct("fund_name", "vehicle_type")).alias("f")).select("cik", "f.*")
    kind = F.when(F.col("vehicle_type").isin("Listed BDC", "Deregistered BDC"), F.col("vehicle_type")).otherwise("Unlisted BDC")
    return first.withColumn("vehicle_type", kind)


def downloadable(universe: DataFrame, category_forms: dict[str, list[str]] = CATEGORY_FORMS) -> DataFrame:
    """(fund, form) to fetch: funds with a key whose category has forms. The table of forms is a fixed list."""
    rows = [(k, f) for k, v in category_forms.items() for f in v]
    forms = universe.sparkSession.createDataFrame(rows, "category string, form string")
    return universe.filter(F.trim("cik") != "").join(F.broadcast(forms), "category")


def file_name(fund: Column, cik: Column, form: Column, date: Column) -> Column:
    safe = lambda c: F.btrim(F.regexp_replace(c, r'[<>:"/\\|?*\s]+', "_"), F.lit("_"))
    return F.concat(F.concat_ws("_", safe(fund), cik, safe(form), date.cast("string")), F.lit(".htm"))


def family(name: Column) -> Column:
    """The first two telling words of a fund's name, in title case; without one its first word."""
    words = F.filter(F.split(F.regexp_replace(F.regexp_replace(name, r"[.,/\\&]", " "), r"\b\d{4}\b", " "), r"\s+"), lambda w: w != "")
    telling = F.filter(words, lambda w: ~w.rlike(BOILERPLATE))
    return F.when(F.size(telling) > 0, F.initcap(F.array_join(F.slice(telling, 1, 2), " "))).otherwise(F.initcap(F.get(F.split(F.trim(name), r"\s+"), F.lit(0))))


def matched(funds: DataFrame, directory: DataFrame, least: float = 85.0, review: float = 92.0) -> DataFrame:
    """funds (fund, cik, norm) against directory (entry, cik, norm), fund and entry unique -> fund, entry, how (cik, name, none),
    score, review. The key decides; else the most similar name of at least `least`, ties by entry.

    Names meet by length: only lengths within least / (200 - least) of each other can reach the score, so the join is an
    equi-join on length and exact."""
    keys = directory.filter(F.trim("cik") != "").groupBy("cik").agg(F.min("entry").alias("entry"))
    by_key = funds.join(keys, "cik", "left")
    low, high = least / (200.0 - least), (200.0 - least) / least
    n = F.length("norm")
    left = by_key.filter("entry is null and norm <> ''").select("fund", F.col("norm").alias("a"), F.explode(F.sequence(F.greatest(F.ceil(n * low).cast("int"), F.lit(1)), F.floor(n * high).cast("int"))).alias("n"))
    pairs = left.join(directory.filter("norm <> ''").select(F.col("entry"), F.col("norm").alias("b"), n.alias("n")), "n")
    scores = pairs.select("a", "b").distinct().withColumn("score", similarity("a", "b")).filter(F.col("score") >= least)
    best = pairs.join(scores, ["a", "b"]).groupBy("fund").agg(F.min_by(F.struct("entry", "score"), F.struct(-F.col("score"), F.col("entry"))).alias("m"))
    out = by_key.select("fund", F.col("entry").alias("k")).join(best, "fund", "left")
    how = F.when(F.col("k").isNotNull(), "cik").when(F.col("m").isNotNull(), "name").otherwise("none")
    return out.select("fund", F.coalesce("k", "m.entry").alias("entry"), how.alias("how"), F.when(how == "name", F.col("m.score")).alias("score"), (how == "name") & F.coalesce(F.col("m.score") < review, F.lit(False))).toDF("fund", "entry", "how", "score", "review")


def split_known(funds: DataFrame, incoming: DataFrame, key: str = "cik") -> tuple[DataFrame, DataFrame]:
    """Incoming rows whose key the universe has, and those to append."""
    known = funds.select(key).distinct()
    return incoming.join(known, key, "left_semi"), incoming.join(known, key, "left_anti")


def footprint(filings: DataFrame) -> DataFrame:
    """filings (cik, form, filing_date, inline boolean, tagged boolean) -> counts, first inline year, last date, forms."""
    inline = F.coalesce("inline", F.lit(False))
    return filings.groupBy("cik").agg(
        F.count_if(F.col("form") == "10-K").alias("n_10k"), F.count_if(F.col("form") == "10-Q").alias("n_10q"), F.count(F.lit(1)).alias("n_total"), F.count_if(inline).alias("n_inline"),
        F.count_if(F.coalesce("tagged", F.lit(False))).alias("n_tagged"), F.min(F.when(inline, F.year("filing_date"))).alias("first_inline_year"), F.max("filing_date").alias("last_date"),
        F.bool_or(inline).alias("extractable"), F.array_join(F.array_sort(F.collect_set(F.when(inline, F.col("form")))), ",").alias("inline_forms"),
    )


def signals(filings: DataFrame, ends: DataFrame, lasting: int = 365) -> DataFrame:
    """ends (cik, name, ended): what the filings say about an end: form sets, and reports long after it (a conversion)."""
    rows = ends.join(filings.select("cik", "form", "filing_date"), "cik", "left")
    has = lambda test: F.bool_or(F.coalesce(test, F.lit(False)))
    bare = F.replace("form", F.lit("/A"), F.lit(""))
    sets = [has(F.col("form").isin(v) if k != "deregistered" else bare.isin(v) | F.col("form").startswith("15-")).alias(k) for k, v in FORMS.items()]
    after = F.max(F.when(F.col("form").isin(SUBSTANTIVE) & (F.col("filing_date") > F.col("ended")), F.datediff("filing_date", "ended")))
    return rows.groupBy("cik", "name", "ended").agg(*sets, F.coalesce(after, F.lit(0)).alias("days_after")).withColumn("continued", F.col("days_after") > lasting).withColumn("scheduled", F.coalesce(F.col("name").rlike(SCHEDULED), F.lit(False)))


def due(filings: DataFrame, funds: DataFrame, done: DataFrame, key: list[str], first_year: int = 2016) -> DataFrame:
    """Filings still to extract: of the two forms, no amendment, from the first year on (an unknown year passes), not after
    the fund's deregistration, and not done before."""
    capped = filings.join(funds.select("cik", F.col("deregistration_date").try_cast("date").alias("__cap")), "cik")
    own = capped.filter(F.col("form").isin("10-K", "10-Q") & (F.coalesce(F.year("filing_date"), F.lit(first_year)) >= first_year) & (F.col("__cap").isNull() | (F.col("period") <= F.col("__cap"))))
    return own.drop("__cap").join(done.select(*key).distinct(), key, "left_anti")


def sizing(births: DataFrame, deaths: DataFrame) -> DataFrame:
    """One row: entities born, ended, both, and either alone."""
    b, d = (t.select("key").distinct().withColumn(n, F.lit(1)) for t, n in ((births, "b"), (deaths, "d")))
    both = b.join(d, "key", "full_outer")
    count = lambda c: F.count_if(c)
    return both.agg(F.count("b").alias("born"), F.count("d").alias("ended"), count(F.col("b").isNotNull() & F.col("d").isNotNull()).alias("both"), count(F.col("d").isNull()).alias("born_only"), count(F.col("b").isNull()).alias("ended_only"))


def five_years(dates: DataFrame, column: str = "date") -> DataFrame:
    return dates.groupBy((F.floor(F.year(column) / 5) * 5).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def cross_tab(rows: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts of row by the given columns, with the row's total over all rows."""
    return rows.groupBy(row).agg(*[F.count_if(F.col(column).eqNullSafe(v)).alias(v) for v in values], F.count(F.lit(1)).alias("total"))


def latest_filing(filings: DataFrame, form: str) -> DataFrame:
    """The latest filing of each entity, of the form where there is one."""
    w = Window.partitionBy("cik").orderBy((F.col("form") == form).desc(), F.desc("filing_date"), "form")
    return filings.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def with_manager(funds: DataFrame, managers: DataFrame, broadcast_rows: int = 100_000) -> DataFrame:
    """Adds the manager of each fund's key, 'UNMAPPED' without one. The map is broadcast only up to a counted size."""
    one = managers.groupBy("cik").agg(F.min("manager").alias("manager"))
    small = one.limit(broadcast_rows + 1).count() <= broadcast_rows
    return funds.join(F.broadcast(one) if small else one, "cik", "left").withColumn("manager", F.coalesce("manager", F.lit("UNMAPPED")))


def manager_audit(funds: DataFrame) -> DataFrame:
    """funds (cik, manager), one or more rows a fund -> funds per manager, whether it has several and whether it stands for the unmapped."""
    counts = funds.select("cik", "manager").distinct().groupBy("manager").agg(F.count(F.lit(1)).alias("funds"))
    return counts.withColumn("several", F.col("funds") >= 2).withColumn("unmapped", F.col("manager") == "UNMAPPED").orderBy(F.desc("funds"), "manager")

"""Adapters: the driver's tables as the shapes that the operators read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: One position of a fund at a date.
HOLDING = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("cik", "fund_name", "form_type", "reporting_date", "issuer", "affiliation")]
    + [T.StructField(n, T.DoubleType()) for n in ("fair_value", "cost", "principal", "shares", "commitment", "rate", "spread", "pik_rate", "floor", "pct_na")]
    + [T.StructField(n, T.StringType()) for n in ("maturity", "reference_rate", "acquisition_date")]
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_holdings_csv(spark: SparkSession, path: str) -> DataFrame:
    """Per-filing CSVs with an explicit schema; rows that do not parse are kept in `corrupt`, not skipped silently."""
    schema = T.StructType([*HOLDING.fields, T.StructField("corrupt", T.StringType())])
    return spark.read.schema(schema).csv(path, header=True, mode="PERMISSIVE", columnNameOfCorruptRecord="corrupt")


def read_filings_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One JSON object per filing, with an explicit schema."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Raw report HTML with the parts of its file name: fund, ten-digit key, form, date, amendment."""
    name = F.element_at(F.split("path", "/"), -1)
    pattern = r"^(.*)_(\d{10})_([A-Z0-9-]+?)(_A\d*)?_(\d{4}-\d{2}-\d{2})\.html?$"
    get = lambda k: F.nullif(F.regexp_extract(name, pattern, k), F.lit(""))
    return spark.read.format("binaryFile").load(path).select(
        "path", get(1).alias("fund"), get(2).alias("cik"), get(3).alias("form"), get(4).isNotNull().alias("is_amendment"), get(5).try_cast("date").alias("filing_date"), "content"
    )


#: Parts or suppliers up to so many are broadcast, and no line item is shuffled to meet them.
BROADCAST_ROWS = 2_000_000


def holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as holdings: supplier = fund, its nation = manager, part name = issuer, ship year = date, ship mode =
    instrument type, commit date = maturity. Every seventh line has no spread, so that the attach rule has work to do;
    every eleventh no maturity."""
    li, part, supp = (table(spark, sf_dir, n) for n in ("lineitem", "part", "supplier"))
    small = lambda df, t: F.broadcast(df) if t.count() <= BROADCAST_ROWS else df
    bps = (F.bround(F.col("l_tax") * 10000 / 5) * 5).cast("int")
    joined = li.join(small(part.select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_retailprice"), part), "l_partkey").join(
        small(supp.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), supp), "l_suppkey"
    )
    return joined.select(
        F.col("l_suppkey").alias("fund"), F.col("s_nationkey").alias("manager"), F.col("p_name").alias("issuer"), F.year("l_shipdate").alias("yr"),
        F.col("l_returnflag").alias("sen"), F.when(F.col("l_linenumber") % 7 != 0, bps).alias("bps"), F.col("l_extendedprice").alias("par"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("fv"), (F.col("l_quantity") * F.col("p_retailprice")).alias("cost"),
        F.col("l_orderkey").alias("lot"), F.col("l_linenumber").alias("line"),
        F.when(F.col("l_orderkey") % 19 == 0, "Warrant").when(F.col("l_orderkey") % 13 == 0, "Revolver").otherwise("Term Loan").alias("instrument_type"),
        F.when(F.col("l_orderkey") % 11 != 0, F.concat(F.lit("due "), F.year("l_shipdate") + 5 + F.when(F.col("l_orderkey") % 101 == 0, 1).otherwise(0))).alias("maturity"),
    )


HOLDINGS_SQL = """h AS (
SELECT l_suppkey AS fund, s_nationkey AS manager, p_name AS issuer, CAST(year(l_shipdate) AS INTEGER) AS yr, l_returnflag AS sen,
 CASE WHEN l_linenumber % 7 <> 0 THEN CAST(round_even(l_tax * 10000 / 5, 0) * 5 AS INTEGER) END AS bps,
 l_extendedprice AS par, l_extendedprice * (1 - l_discount) AS fv, l_quantity * p_retailprice AS cost, l_orderkey AS lot, l_linenumber AS line,
 CASE WHEN l_orderkey % 19 = 0 THEN 'Warrant' WHEN l_orderkey % 13 = 0 THEN 'Revolver' ELSE 'Term Loan' END AS instrument,
 CASE WHEN l_orderkey % 11 <> 0 THEN year(l_shipdate) + 5 + CASE WHEN l_orderkey % 101 = 0 THEN 1 ELSE 0 END END AS mat
FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey),
p AS (SELECT *, CASE WHEN basis = 'par' THEN fv / par WHEN basis = 'cost' THEN fv / cost END AS price FROM (
 SELECT *, CASE WHEN par > 0 AND fv / par BETWEEN 0.5 AND 1.15 AND NOT coalesce(cost > 0 AND par > 2.5 * cost, false) THEN 'par'
  WHEN cost > 0 AND fv / cost BETWEEN 0.4 AND 1.2 THEN 'cost' WHEN par > 0 AND fv / par BETWEEN 0.5 AND 1.15 THEN 'par' END AS basis FROM h)),
cl AS (SELECT *, CASE WHEN cls = 'debt' AND price BETWEEN 0.3 AND 1.10 THEN price END AS cmp FROM (SELECT *, CASE WHEN instrument IN ('Equity', 'Preferred', 'Common Equity', 'Warrant') THEN 'equity'
 WHEN (price IS NULL OR price <= 0 OR price > 1.6) AND instrument IN ('Revolver', 'Delayed Draw Term Loan') THEN 'unfunded' ELSE 'debt' END AS cls FROM p)),
sp AS (SELECT issuer, yr, sen, min(bps) AS sole FROM cl WHERE cls = 'debt' AND bps IS NOT NULL GROUP BY ALL HAVING count(DISTINCT bps) = 1),
m AS (SELECT cl.*, coalesce(bps, sole) AS ibps FROM cl LEFT JOIN sp ON cl.issuer = sp.issuer AND cl.yr = sp.yr AND cl.sen IS NOT DISTINCT FROM sp.sen WHERE cls = 'debt'),
lt AS (SELECT issuer, yr, sen, ibps, fund, any_value(manager) AS manager, median(cmp) AS mark, count(cmp) AS lots, sum(fv) FILTER (cmp IS NOT NULL) AS fv FROM m GROUP BY ALL),
fm AS (SELECT * FROM lt WHERE mark IS NOT NULL),
im AS (SELECT *, median(mark) OVER (PARTITION BY issuer, yr, sen, ibps) AS med FROM lt),
ys AS (SELECT issuer, yr, sen, ibps, count(DISTINCT mat) > 1 AS conflict, string_agg(DISTINCT CAST(mat AS VARCHAR), ';' ORDER BY CAST(mat AS VARCHAR)) AS years FROM m GROUP BY ALL),
iss AS (SELECT i.*, conflict, years, CASE WHEN holders < 2 THEN 'Single' WHEN i.ibps IS NOT NULL AND i.sen IS NOT NULL AND NOT conflict AND holders <= 15 THEN 'High' WHEN i.ibps IS NOT NULL THEN 'Medium' ELSE 'Low' END AS tier
 FROM (SELECT issuer, yr, sen, ibps, count(*) AS holders, count(mark) AS n_prices, any_value(med) AS med, count(*) FILTER (abs(mark - med) <= 0.25) AS n_clean,
 min(mark) FILTER (abs(mark - med) <= 0.25) AS lo, max(mark) FILTER (abs(mark - med) <= 0.25) AS hi, stddev_samp(mark) FILTER (abs(mark - med) <= 0.25) AS sd,
 min(mark) AS raw_lo, max(mark) AS raw_hi FROM im GROUP BY ALL) i
 JOIN ys ON i.issuer = ys.issuer AND i.yr = ys.yr AND i.sen IS NOT DISTINCT FROM ys.sen AND i.ibps IS NOT DISTINCT FROM ys.ibps)"""


def existing(spark: SparkSession, path: str) -> DataFrame:
    """A table that an earlier stage wrote. Missing is an error, never a silent recomputation."""
    try:
        return spark.read.parquet(path)
    except Exception as e:
        raise FileNotFoundError(f"no table at {path}: run the stage that writes it") from e


def union_tabs(tabs: dict[str, DataFrame]) -> DataFrame:
    """Tabs with different optional columns as one table, with the tab's name."""
    out = None
    for name, tab in tabs.items():
        own = tab.withColumn("tab", F.lit(name))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def write_tables(tables: dict[str, DataFrame], folder: str, partition_by: dict[str, list[str]] | None = None) -> None:
    """One Parquet table per name: what a workbook's tabs hold."""
    for name, df in tables.items():
        df.write.mode("overwrite").partitionBy(*(partition_by or {}).get(name, [])).parquet(f"{folder}/{name}")

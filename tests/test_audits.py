"""Return chains, record upkeep and the corpus inventory on literal rows."""

from pyspark.sql import functions as F

from loanlens.functions import numbers as N
from loanlens.functions import text as X
from loanlens.operators import bias as B
from loanlens.operators import reports, returns
from loanlens.operators import rules as V
from loanlens.operators import universe as U


def test_window_returns(spark):
    rows = [
        ("chained", "10-Q", "2024-12-31", 0.0277), ("chained", "10-K", "2025-09-30", 0.0936), ("chained", "10-Q", "2025-12-31", 0.0195),
        ("opens", "10-K", "2024-12-31", 0.5), ("opens", "10-Q", "2025-12-31", 0.02), ("no start", "10-Q", "2025-12-31", 0.02), ("no end", "10-Q", "2024-12-31", 0.02),
        ("gap", "10-Q", "2024-12-31", 0.02), ("gap", "10-K", "2025-06-30", None), ("gap", "10-Q", "2025-12-31", 0.02),
        ("twice", "10-Q", "2024-12-31", 0.9), ("twice", "10-K", "2024-12-31", 0.1), ("twice", "10-Q", "2025-12-31", 0.02), ("lost", "10-Q", "2024-12-31", -1.0), ("lost", "10-Q", "2025-12-31", 0.02),
    ]
    df = spark.createDataFrame(rows, "fund string, form_type string, date string, ytd double")
    got = {r.fund: (None if r.window_return is None else round(r.window_return, 4), r.reason) for r in returns.window_returns(df, "2024-12-31", "2025-12-31").collect()}
    assert got == {
        "chained": (0.0849, ""), "opens": (0.02, ""), "no start": (None, "no YTD at window start"), "no end": (None, "no YTD at window end"),
        "gap": (None, "no YTD at fiscal year end 2025-06-30"), "twice": (0.02, ""), "lost": (None, ""),
    }
    assert returns.window_returns(df.limit(0), "2024-12-31", "2025-12-31").count() == 0


def test_rounding_keeps_the_sign_of_zero(spark):
    values = [-1e-9, 1e-9, -0.5, 2.675, 0.0, None]
    got = [r.v for r in spark.createDataFrame([(v,) for v in values], "v double").coalesce(1).select(N.rounded("v", 2).alias("v")).collect()]
    assert [str(v) for v in got] == ["-0.0", "0.0", "-0.5", "2.68", "0.0", "None"]


def test_nav_band_follows_the_rounding_of_its_inputs(spark):
    rows = [(10_000.0, 382.0, 25.13), (10_001.0, 382.0, 25.13), (1_000_000.0, 0.0, 10.0), (25_130_001.0, 1_000_001.0, 25.135), (25_130_001.0, 1_000_001.0, 25.2), (None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "net double, shares double, nav double").coalesce(1)
    got = [r.s for r in df.select(V.nav_per_share(F.col("net"), F.col("shares"), F.col("nav"))["status"].alias("s")).collect()]
    assert got == ["pass", "fail", "skipped", "pass", "fail", "skipped"]


def test_revalidated_takes_over_metadata(spark):
    records = spark.createDataFrame([("1", "old", 5.0, "pass"), ("2", "kept", -5.0, "pass"), (None, "no key", 1.0, "review")], "cik string, fund_name string, net double, status string")
    fresh = spark.createDataFrame([("1", "new")], "cik string, fund_name string")
    out = V.revalidated(records, [V.check("A1", F.col("net") > 0, [F.col("net")])], fresh)
    assert {(r.cik, r.fund_name, r.status) for r in out.collect()} == {("1", "new", "pass"), ("2", "kept", "review"), (None, "no key", "pass")}


def test_names_urls_and_tolerances(spark):
    row = spark.range(1).select(
        X.names_agree(F.lit("Alpha Fund"), F.lit("The ALPHA Fund, Inc.")).alias("a"), X.names_agree(F.lit("--"), F.lit("x")).alias("b"), X.filing_url(F.lit("0000000012"), F.lit("1-2-3"), "b").alias("c"),
        X.filing_url(F.lit(None).cast("string"), F.lit("1-2-3")).alias("d"), X.period_start(F.lit("2025-04-30").cast("date"), F.lit(6)).cast("string").alias("e"), N.close(F.lit(0.0), F.lit(0.0)).alias("f"),
        N.spread_label(F.lit(None).cast("int")).alias("g"), N.flags({"x": F.lit(None).cast("boolean"), "y": F.lit(True)}).alias("h"),
    ).first()
    assert tuple(row) == (True, None, "b/12/123/1-2-3-index.htm", "", "2024-11-01", True, "—", "y")


def test_managers(spark):
    funds = spark.createDataFrame([("1",), ("2",), ("2",), ("3",)], "cik string")
    held = spark.createDataFrame([("1", "A"), ("2", "A"), ("2", "B")], "cik string, manager string")
    out = U.manager_audit(U.with_manager(funds, held)).collect()
    assert [tuple(r) for r in out] == [("A", 2, True, False), ("UNMAPPED", 1, False, True)]
    assert [tuple(r) for r in U.manager_audit(U.with_manager(funds, held, broadcast_rows=0)).collect()] == [tuple(r) for r in out]


def test_inventory_and_cost(spark):
    rows = [
        ("a", 1000, ["operations"], ["operations", "cash_flows"], [(0, 100)], "x" * 400, None), ("b", 3000, ["operations"], [], [], "y" * 50, None),
        ("c", 10, [], [], [], "", None), ("d", 0, None, None, None, None, "ValueError"),
    ]
    found = spark.createDataFrame(rows, "path string, raw_chars bigint, titles array<string>, kinds array<string>, spans array<struct<start:bigint,end:bigint>>, text string, error string")
    scope = spark.createDataFrame([("a", True), ("b", True), ("c", True)], "path string, in_scope boolean")
    r = reports.inventory(found, scope).first()
    assert (r.documents, r.failed, r.located, r.in_gate, r.gate_hits, r.balance_sheets, r.cash_flows) == (4, 1, 1, 2, 1, 0, 1)
    assert (r.tokens[2], r.mean_tokens, round(r.smaller, 6)) == (100.0, 100.0, 0.6)
    assert reports.inventory(found.limit(0), scope).first().documents == 0
    spent = reports.cost(spark.createDataFrame([("p", 100, True), ("p", 100, True), ("q", 9, False)], "period string, tokens int, located boolean"), 2.0, 10.0, 900, 1000).first()
    assert (spent.periods, spent.tokens_in, round(spent.cost, 9)) == (1, 1000.0, 0.012)


def test_issue_sample_picks_by_hash(spark):
    rows = [("i", 1, "S", None, m, mark, k, 0.0) for i, k in (("i", 4),) for m, mark in ((1, 0.97), (2, 0.95), (3, 0.99), (4, 0.95))] + [("j", 1, "S", 500, 1, 0.9, 3, 0.0)]
    dev = spark.createDataFrame(rows, "issuer string, yr int, sen string, ibps int, manager int, mark double, k bigint, dev double")
    got = B.issue_sample(dev).collect()
    assert [(r.issuer, round(r.consensus, 6), r.marks) for r in got] == [("i", 96.0, "2:95  4:95  1:97  3:99")]
    assert B.issue_sample(dev, size=0).count() == 0

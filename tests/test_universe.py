"""Universe, matching, statistics of bias, additive runs."""

import itertools
import json
import math
import random
import statistics

from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanlens.operators import bias as B
from loanlens.operators import universe as U
from loanlens.operators.issuers import sorted_ratio
from loanlens.sources import tables
from loanlens.streaming import incremental as S


def test_binomial_tail():
    for n, p in ((1, 0.5), (7, 0.5), (30, 0.2)):
        for k in range(n + 2):
            assert math.isclose(B.upper_tail(n, k, p), sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1)), abs_tol=1e-12)
    assert abs(B.upper_tail(20_001, 10_100) - B.upper_tail(20_000, 10_100)) < 0.01


def test_median_ranks_against_all_resamples():
    for n in (3, 5):
        medians = sorted(statistics.median(r) for r in itertools.product(range(1, n + 1), repeat=n))
        lo, hi = (medians[math.ceil(q * len(medians)) - 1] for q in (0.025, 0.975))
        assert B.median_ranks(n) == (lo, hi)


def test_bias_inference(spark):
    rng = random.Random(3)
    rows = [(f"i{i}", 2020, "S", 500, m, rng.gauss(shift, 0.5)) for m, shift in (("rich", 2.0), ("none", 0.0), ("none2", 0.0)) for i in range(40)] + [("i1", 2020, "S", 500, "thin", 9.0)]
    dev = spark.createDataFrame(rows, "issuer string, yr int, sen string, ibps int, manager string, dev double")
    got = {r.manager: r for r in B.significant(dev).collect()}
    assert got["rich"].robust and not got["none"].robust and got["thin"].p is None and got["thin"].coef == 9.0 and got["thin"].lo is None
    p = sorted((r.p, r.manager) for r in got.values() if r.p is not None)
    for k, (v, m) in enumerate(p):
        assert math.isclose(got[m].p_fdr, min(1.0, *[q * len(p) / (j + 1) for j, (q, _) in enumerate(p) if j >= k]), rel_tol=1e-9)
    own = sorted(r[5] for r in rows if r[4] == "rich")
    lo, hi = B.median_ranks(40)
    assert (got["rich"].lo, got["rich"].hi) == (own[lo - 1], own[hi - 1])
    signs = {r.manager: (r.above, r.below, r.p) for r in B.sign_test(dev).collect()}
    assert signs["rich"][2] < 1e-6 and signs["thin"] == (1, 0, 1.0)


def test_matching_against_all_pairs(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randrange(2, 6)))
    names = [" ".join(word() for _ in range(rng.randrange(1, 4))) for _ in range(40)]
    entries = [(f"e{i:02d}", "7" if i == 5 else "", n) for i, n in enumerate(names)]
    funds = [(i, "7" if i == 0 else "", "".join(c for c in n if rng.random() > 0.08).strip()) for i, n in enumerate(names)] + [(99, "", "")]
    got = {r.fund: r for r in U.matched(spark.createDataFrame(funds, "fund int, cik string, norm string"), spark.createDataFrame(entries, "entry string, cik string, norm string")).collect()}
    for fund, cik, norm in funds:
        best = min(((-sorted_ratio(norm, n), e) for e, _, n in entries if norm and sorted_ratio(norm, n) >= 85), default=None)
        want = ("e05", "cik", None) if cik else (best[1], "name", -best[0]) if best else (None, "none", None)
        assert (got[fund].entry, got[fund].how, got[fund].score) == want
        assert got[fund].review == (want[1] == "name" and want[2] < 92)


def test_universe(spark):
    rows = [("1", "A", "Listed BDC", "x"), ("1", "B", "REIT", "bdc"), (" ", "C", "Listed BDC", "bdc"), ("2", "D", "REIT", "bdc"), ("3", "E", "REIT", "reit"), (None, "F", None, "bdc")]
    u = spark.createDataFrame(rows, "cik string, fund_name string, vehicle_type string, category string")
    assert {(r.cik, r.vehicle_type) for r in U.selected(u).collect()} == {("1", "Listed BDC"), ("2", "Unlisted BDC")}
    assert U.downloadable(u).filter("cik = '3'").count() == 3
    df = spark.createDataFrame([("Ares Capital Corp",), ("Fund of Funds 2019",), ("TPG/Specialty Lending, Inc.",)], "n string")
    assert [r[0] for r in df.select(U.family(F.col("n"))).collect()] == ["Ares", "Fund", "Tpg Specialty"]
    name = spark.range(1).select(U.file_name(F.lit("A: B/C "), F.lit("0001"), F.lit("10-K/A"), F.lit("2020-01-31"))).first()[0]
    assert name == "A_B_C_0001_10-K_A_2020-01-31.htm"


def test_signals_and_due(spark):
    filings = spark.createDataFrame([("1", "N-14", "2020-01-05", "2019-12-31"), ("1", "15-12G/A", "2020-02-01", "2019-12-31"), ("1", "10-K", "2022-03-01", "2021-12-31"), ("1", "10-Q", "2015-01-01", "2014-12-31")], "cik string, form string, filing_date string, period string")
    filings = filings.withColumn("filing_date", F.col("filing_date").cast("date")).withColumn("period", F.col("period").cast("date"))
    ends = spark.createDataFrame([("1", "Old Fund", "2020-01-31"), ("2", "Credit Income Fund 2016", "2020-01-31")], "cik string, name string, ended string").withColumn("ended", F.col("ended").cast("date"))
    got = {r.cik: r for r in U.signals(filings, ends).collect()}
    assert got["1"].merger and got["1"].deregistered and got["1"].continued and not got["1"].listed and got["2"].scheduled and got["2"].days_after == 0
    funds, none = spark.createDataFrame([("1", "bad")], "cik string, deregistration_date string"), spark.createDataFrame([], "cik string, form string, period date")
    assert [r.form for r in U.due(filings, funds, none, ["cik", "form", "period"]).collect()] == ["10-K"]
    assert U.due(filings, funds, filings, ["cik", "form", "period"]).count() == 0
    assert U.due(filings, spark.createDataFrame([("1", "2020-06-30")], "cik string, deregistration_date string"), none, ["cik", "form", "period"]).count() == 0


def test_new_files_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = T.StructType([T.StructField("cik", T.StringType()), T.StructField("v", T.DoubleType())])
    run = lambda: S.new_files(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "check"), lambda df: df.filter("v > 0"))
    for k in range(3):
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps({"cik": str(k), "v": float(k)}))
        run(), run()
    assert sorted(r.cik for r in tables.existing(spark, str(tmp_path / "out")).collect()) == ["1", "2"]


def test_append_and_state(spark, tmp_path):
    rows, path = spark.createDataFrame([("1", 2.0), ("2", 3.0)], "cik string, v double"), str(tmp_path / "t")
    assert [S.append_missing(rows, path, ["cik"], v) for v in ("a", "a", "b")] == [2, 0, 2]
    state = spark.createDataFrame([("1", "2020-05-01")], "cik string, d string").select("cik", F.col("d").cast("date").alias("last_checked"))
    filings = spark.createDataFrame([("1", "2020-04-30"), ("1", "2020-05-01"), ("2", "2016-01-01")], "cik string, d string").select("cik", F.col("d").cast("date").alias("filing_date"))
    assert S.since(filings, state, "2016-01-01").count() == 2
    assert [(r.cik, str(r.last_checked)) for r in S.checked(state, filings.filter("cik = '2'"), "2021-01-01").collect()] == [("1", "2020-05-01"), ("2", "2021-01-01")]
    tables.write_tables({"a": rows, "b": tables.union_tabs({"x": rows, "y": rows.select("cik")})}, str(tmp_path / "w"))
    assert tables.existing(spark, str(tmp_path / "w/b")).filter("v is null and tab = 'y'").count() == 2

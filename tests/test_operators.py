"""Literal cases of the operators, and every registered query against its SQL."""

import datetime
import math
import os
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

from loanlens.operators import bias as B
from loanlens.operators import history as H
from loanlens.operators import marks as M
from loanlens.operators import migration as G
from loanlens.operators import survival as S
from loanlens.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_price_cascade(spark):
    cases = [  # fair value, par, cost -> price, basis
        (98.0, 100.0, 99.0, 0.98, "par"), (60.0, 100.0, 80.0, 0.60, "par"), (30.0, 100.0, 31.0, 0.967742, "cost"), (45.0, None, 50.0, 0.9, "cost"),
        (20.0, 100.0, 100.0, None, None), (130.0, 100.0, 110.0, 1.181818, "cost"), (130.0, 100.0, None, None, None), (98.0, 100.0, None, 0.98, "par"),
    ]
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, fv double, par double, cost double")
    for row in M.with_price(df).collect():
        price, basis = cases[row.i][3:]
        assert row.basis == basis
        assert row.price is None if price is None else math.isclose(row.price, price, abs_tol=1e-6)


def test_buckets_are_right_closed(spark):
    w = G.Window2(0, 1)
    want = {0.0: None, 85.0: "<85", 85.01: "85-90", 90.0: "85-90", 95.0: "90-95", 100.0: "98-100", 110.0: "100-110", 111.0: ">110 (suspect)"}
    df = spark.createDataFrame([(v,) for v in want], "v double").select("v", M.bucket(F.col("v"), w.edges, w.labels).alias("b"), M.stance(F.col("v") - 86).alias("s"))
    assert {r.v: r.b for r in df.collect()} == want
    assert {r.v: r.s for r in df.collect()}[85.0] == "Cheap"


LOT = "issuer string, yr int, sen string, bps int, instrument_type string, maturity string, price double, fund int, manager int, fv double"


def lot(issuer, bps, fund=1, sen="S", kind="Term Loan", maturity=None, price=0.98):
    return (issuer, 1, sen, bps, kind, maturity, price, fund, fund, 1.0)


def test_attach_rule(spark):
    rows = [lot("a", 525), lot("a", None), lot("b", 500), lot("b", 525), lot("b", None), lot("c", 500, sen=None), lot("c", None, sen=None)]
    rows += [lot("d", 500, kind="Warrant"), lot("d", None), lot("e", 500), lot("e", 525, kind="Revolver", price=None), lot("e", None), lot("e", None, kind="Revolver", price=None)]
    out = M.with_issue(spark.createDataFrame(rows, LOT))
    got = {(r.issuer, r.hold_class): r.ibps for r in out.filter("bps is null").collect()}
    # equity and undrawn lines neither give a spread nor get one
    assert got == {("a", "debt"): 525, ("b", "debt"): None, ("c", "debt"): 500, ("d", "debt"): None, ("e", "debt"): 500, ("e", "unfunded"): None}
    assert out.filter("hold_class = 'equity'").first().ibps is None and out.filter("hold_class <> 'debt' and cmp_price is not null").isEmpty()


def test_confidence(spark):
    rows = [lot("one", 500)] + [lot("two", 500, f) for f in (1, 2)] + [lot("fifteen", 500, f) for f in range(15)] + [lot("sixteen", 500, f) for f in range(16)]
    rows += [lot("conflict", 500, f, maturity=m) for f, m in ((1, "2027"), (2, "June 2028"))] + [lot("agreed", 500, f, maturity=m) for f, m in ((1, "2027-01-01"), (2, "2027"), (3, None))]
    rows += [lot("unknown", 500, f, sen=None) for f in (1, 2)] + [lot("bare", None, f) for f in (1, 2)] + [lot("unpriced", 500, 1), lot("unpriced", 500, 2, price=None), lot("unpriced", 500, 3, price=1.2)]
    rows += [lot("undrawn", 500, 1), lot("undrawn", 500, 2, kind="Delayed Draw Term Loan", price=None)]
    out = {r.issuer: r for r in M.issue_stats(M.with_issue(spark.createDataFrame(rows, LOT))).collect()}
    want = {"one": "Single", "two": "High", "fifteen": "High", "sixteen": "Medium", "conflict": "Medium", "agreed": "High", "unknown": "Medium", "bare": "Low", "unpriced": "High", "undrawn": "Single"}
    assert {i: r.tier for i, r in out.items()} == want
    assert out["conflict"].years == "2027;2028" and out["agreed"].years == "2027" and out["one"].years is None
    # holders without a comparable price are holders
    assert out["unpriced"].holders == 3 and out["unpriced"].n_prices == 1


def test_sign_test_tail_is_exact():
    for n, least in ((1, 1), (7, 2), (20, 20), (20_001, 10_150), (50_000, 25_300), (50_000, 24_900)):
        exact = sum(math.comb(n, k) for k in range(least, n + 1)) if n < 100 else None
        if exact is None:
            term, total = math.comb(n, least), 0
            for k in range(least, n + 1):
                total += term
                term = term * (n - k) // (k + 1)
            exact = total
        assert abs(B.upper_tail(n, least) / float(Fraction(exact, 2**n)) - 1) < 1e-9


def test_chained_return(spark):
    df = spark.range(1).select(G.chained_return(F.lit(0.0277), F.array(F.lit(0.0936)), F.lit(0.0195)).alias("r"))
    assert round(df.first().r, 4) == 0.0849


def _norm(rows):
    def one(v):
        if isinstance(v, float):
            return None if math.isnan(v) else f"{v:.6g}"
        return v.isoformat()[:10] if hasattr(v, "isoformat") else None if v is None else str(v)

    return sorted((tuple(one(v) for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_sql(spark, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = _norm(df.select(*[f"`{c}`" for c in columns]).collect())
    if name not in registry.oracle_sql():
        assert got
        return
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    r = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in r.description]
    assert sorted(names) == columns
    assert got == _norm([tuple(x[names.index(c)] for c in columns) for x in r.fetchall()])


def test_migration_of_funds_and_issuers(spark):
    w = G.Window2(1, 2)
    rows = [  # fund, issuer, yr, price, par, fv
        ("f", "a", 1, 0.99, 100.0, 60.0), ("f", "a", 2, 0.80, 100.0, 50.0), ("f", "b", 1, 0.97, 50.0, 20.0),
        ("g", "a", 1, 0.96, 40.0, 40.0), ("g", "a", 2, 0.92, 40.0, 30.0), ("g", "c", 2, 0.99, 10.0, 10.0),
    ]
    panel = spark.createDataFrame(rows, "fund string, issuer string, yr int, price double, par double, fv double")
    totals = spark.createDataFrame([("f", 1, 100.0), ("f", 2, 100.0), ("g", 1, 30.0)], "fund string, yr int, total double")
    p, checked = G.pairs(panel, w), G.reconciliation(panel, totals)
    got = {r.fund: r for r in G.fund_migration(p, checked, w).collect()}
    f, g = got["f"], got["g"]
    assert (f.migrated_fv, f.migrated_n, f.exited_fv, f.exited_n, f.both_n, f.usable) == (60.0, 1, 20.0, 1, 1, True)
    assert (f.start_4, f.start_3, f.end_0, f.migrated_pct, f.start_coverage, f.end_coverage) == pytest.approx((60.0, 20.0, 50.0, 60.0, 0.8, 0.5))
    # 40 of a total of 30 does not reconcile; without a total at the end there is no share
    assert (g.usable, g.entered_n, g.end_2, g.end_coverage) == (False, 1, None, None) and g.start_3 == pytest.approx(400 / 3)
    only = G.issuer_impact(p, G.usable(checked, w)).collect()
    assert [(r.issuer, r.funds, r.universe_share) for r in only] == [("a", 1, 1.0)] and only[0].contribution == pytest.approx(-19)
    both = G.issuer_impact(p, panel.select("fund").distinct()).first()
    assert (both.funds, both.change, both.par_change) == (2, pytest.approx((-19 * 60 - 4 * 40) / 100), pytest.approx((-19 * 100 - 4 * 40) / 140))
    assert tuple(G.cohort(p, panel.select("fund").distinct()).select("issuers", "pairs", "at_start", "share", "change").first()) == pytest.approx((1, 1, 60.0, 0.6, -19.0))
    counts = {r.start_bucket: r.asDict() for r in G.matrix(p, w, counts=True).collect()}
    assert (counts["98-100"]["<85"], counts["95-98"]["EXITED"], counts["95-98"]["90-95"], counts["95-98"]["<85"]) == (1, 1, 1, 0)
    managers = spark.createDataFrame([("f", "m"), ("g", "m")], "fund string, manager string")
    rolled = G.manager_rollup(G.fund_drag(G.attribution(p)), G.fund_migration(p, checked, w), managers).collect()
    assert [(r.manager, r.funds, r.start_fv, r.migrated_fv, r.migrated_n, r.exited_fv) for r in rolled] == [("m", 1, 60.0, 60.0, 1, 20.0)]
    none = panel.limit(0)
    assert G.fund_migration(G.pairs(none, w), G.reconciliation(none, totals), w).count() == 0 and G.issuer_impact(G.pairs(none, w), managers).count() == 0


def test_churn_counts_entities_whose_birth_was_not_seen(spark):
    day = lambda y: datetime.date(y, 6, 1)
    rows = [(day(2001), day(2002), False), (None, day(2001), True), (None, None, True), (None, day(2002), True)]
    c = spark.createDataFrame(rows, "born date, died date, left_censored boolean")
    got = [(r.year, r.births, r.deaths, r.active, round(r.churn, 4)) for r in S.yearly(c, 2000, 2003).orderBy("year").collect()]
    assert got == [(2000, 0, 0, 3, 0.0), (2001, 1, 1, 3, 0.3333), (2002, 0, 2, 1, 0.6667), (2003, 0, 0, 1, 0.0)]
    assert [(r.active, r.churn) for r in S.yearly(c.limit(0), 2000, 2000).collect()] == [(0, 0.0)]


def test_manager_stats_at_the_edge_of_the_band(spark):
    rows = [("m", 1, -1.0, 0.95), ("m", 1, 1.0, 0.95), ("m", 2, -3.0, 0.5), ("n", 1, 2.0, 0.5)]
    dev = spark.createDataFrame(rows, "manager string, yr int, dev double, consensus double")
    got = {r.manager: r for r in B.manager_stats(dev).collect()}
    assert (got["m"].rich, got["m"].in_line, got["m"].cheap) == pytest.approx((0, 2 / 3, 1 / 3))
    assert (got["m"].median, got["m"].median_sound, got["n"].median_sound) == (-1.0, 0.0, None)


def test_owners(spark):
    rows = [("i", "f", 2, 5.0, 0.9), ("i", "g", 2, 7.0, None), ("i", "f", 1, 4.0, 0.95), ("i", "h", 1, 2.0, 0.9), ("j", "f", 2, 1.0, 0.7), ("j", "g", 2, 1.0, 0.8)]
    at = spark.createDataFrame(rows, "issuer string, fund string, yr int, fv double, mark double")
    rolled = {r.issuer: (r.holders, r.exposure, r.apart) for r in H.holder_rollup(at.filter("yr = 2")).collect()}
    assert rolled == {"i": (2, 12.0, None), "j": (2, 2.0, pytest.approx(10.0))}
    ranked = spark.createDataFrame([("i", 1)], "issuer string, rank int")
    change = spark.createDataFrame([("i", -5.0)], "issuer string, change double")
    got = H.owners(at, ranked, H.tenure(at), change, 2, 1).orderBy("fund").collect()
    assert [(r.fund, r.since, r.mark_then, r.exposure_then, r.holders, r.change) for r in got] == [("f", 1, 0.95, 6.0, 2, -5.0), ("g", 2, None, None, 2, -5.0)]

"""Operators whose plans split their work: the split changes no result."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loanlens.operators import bias as B
from loanlens.operators import history as H
from loanlens.operators import issuers as I
from loanlens.operators import overlap as O
from loanlens.sources import tables


def test_fund_pairs_in_blocks(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(yr, f"f{f:02d}", f"e{e}", rng.random()) for yr in (1, 2) for f in range(30) for e in rng.sample(range(25), rng.randint(3, 12))]
    held = spark.createDataFrame(rows, "yr int, fund string, element string, weight double")
    sets = O.fund_sets(held).cache()
    frame = sets.toPandas()
    want = {}
    for yr, part in frame.groupby("yr"):
        own = {f: dict(zip(x.element, x.share)) for f, x in part.groupby("fund")}
        for a in own:
            for b in own:
                if a < b and own[a].keys() & own[b].keys():
                    same = own[a].keys() & own[b].keys()
                    want[yr, a, b] = (len(same), len(own[a]), len(own[b]), sum(min(own[a][e], own[b][e]) for e in same))
    for funds, size in ((400, 1_000_000), (7, 60)):
        monkeypatch.setattr(O, "FUNDS", funds)
        monkeypatch.setattr(O, "ROWS", size)
        got = {(r.yr, r.a, r.b): (r.shared, r.na, r.nb, pytest.approx(r.weighted)) for r in O.fund_pairs(sets).collect()}
        assert want == got
    best = max(((yr, len({x for k in want if k[0] == yr for x in k[1:]})) for yr in (1, 2)), key=lambda x: (x[1], -x[0]))
    assert tuple(O.snapshot(sets).first()) == best


def test_copies_of_funds_in_classes(spark, monkeypatch):
    """Pairs are counted between classes of equal funds, whatever the number of copies, and no pairs of funds are joined or shuffled."""
    rng = random.Random(4)
    kinds = [(yr, e, rng.sample([f"e{x}" for x in range(14)], rng.randint(5, 9))) for yr in (1, 2) for e in range(9)]
    rows = [(yr, 100 * c + k, e, 1.0 + len(e) + k % 3) for yr, k, own in kinds for c in range(6) for e in own]
    rows += [(1, 50, e, 1.0) for e in ("e0", "e1", "e2", "e3", None)] + [(1, 51, f"only{x}", 1.0) for x in range(5)]
    held = spark.createDataFrame(rows, "yr int, fund int, element string, weight double")
    sets, fine = O.fund_sets(held).cache(), O.fund_sets(held.filter("fund % 100 < 7 and element not in ('e3', 'e4', 'e7')").withColumn("element", F.concat("element", F.lit("x"))), 3).cache()
    plain = lambda s: {k: dict(zip(p.element, p.share)) for k, p in s.toPandas().groupby(["yr", "fund"])}
    jac = lambda x, y: len((x.keys() & y.keys()) - {None}) / (len(x) + len(y) - len((x.keys() & y.keys()) - {None}))
    coarse, small = plain(sets), plain(fine)
    want, both, ways = {}, {}, {}
    for yr, a in coarse:
        for other, b in coarse:
            x, y = coarse[yr, a], coarse[other, b]
            if yr == other and a < b and jac(x, y):
                want[yr, a, b] = (len(x), len(y), pytest.approx(sum(min(x[e], y[e]) for e in x.keys() & y.keys() if e)), pytest.approx(jac(x, y)))
                both[yr, a, b] = (pytest.approx(jac(x, y)), pytest.approx(jac(small[yr, a], small[yr, b])) if (yr, a) in small and (yr, b) in small and jac(small[yr, a], small[yr, b]) else None)
                for f, g in ((a, b), (b, a)):
                    ways.setdefault((yr, f), []).append((-round(jac(x, y), 9), g, jac(x, y)))
    summed = {k: (sum(j >= 0.5 for *_, j in v), min(v)[1], pytest.approx(max(j for *_, j in v)), pytest.approx(sum(j for *_, j in v) / len(v))) for k, v in ways.items()}
    for funds, size, members in ((400, 1_000_000, 1000), (4, 1_000_000, 4), (2, 10, 3)):
        for name, value in (("FUNDS", funds), ("ROWS", size), ("MEMBERS", members)):
            monkeypatch.setattr(O, name, value)
        pairs = O.fund_pairs(sets)
        assert {(r.yr, r.a, r.b): (r.na, r.nb, r.weighted, r.jaccard) for r in pairs.collect()} == want
        assert {(r.yr, r.a, r.b): (r.jaccard, r.fine_jaccard) for r in O.grain_pairs(sets, fine).collect()} == both
        assert {(r.yr, r.fund): (r.partners, r.nearest, r.max_jaccard, r.mean_jaccard) for r in O.fund_summary(sets, 0.5).collect()} == summed
        if members == 1000:
            classes = O.fund_classes([sets], True)
            assert classes.count() == len({(yr, k) for yr, k, _ in kinds}) + 2 and O.class_pairs([sets], classes, True).count() < len(want) / 20


def test_values_of_pairs_are_rounded_before_funds_are_expanded(spark, monkeypatch):
    """A value that is the same for all funds of two classes is computed and rounded once, and many funds are many tasks."""
    rows = [(1, 10 * c + k, f"e{x}", 1.0 + x + k % 2) for k in range(8) for c in range(10) for x in range(k, k + 6)]
    sets = O.fund_sets(spark.createDataFrame(rows, "yr int, fund int, element string, weight double")).cache()
    key = lambda df: {(r.yr, r.a, r.b): r for r in df.collect()}
    plain, fine = key(O.fund_pairs(sets)), key(O.grain_pairs(sets, sets))
    for funds in (5000, 20):
        monkeypatch.setattr(O, "EXPANDED", funds)
        pairs, both = O.fund_pairs(sets, 5), O.grain_pairs(sets, sets, 5)
        for df, want in ((pairs, plain), (both, fine)):
            above = df._jdf.queryExecution().optimizedPlan().toString().split("Generate explode")[0]
            assert "Generate" not in above and "round(" not in above
            got = key(df)
            assert got.keys() == want.keys() and got
            for k, r in got.items():
                assert r.asDict() == {c: pytest.approx(v, abs=6e-6) for c, v in want[k].asDict().items()}
                assert all(round(v, 5) == v for v in r)
        dealt, _ = O._dealt([sets], O.fund_classes([sets], True), True, funds)
        assert dealt.select("yr", "part").distinct().count() == {5000: 1, 20: 10}[funds]


def test_different_funds_are_neither_looked_up_nor_counted_one_by_one(spark, monkeypatch):
    """Frequent elements are counted by products of matrices, funds unlike all others are not looked up, ratios are rounded exactly."""
    rng = random.Random(8)
    rows = [(1, f, f"e{e}", 1.0) for f in range(40) for e in {*rng.sample(range(30), rng.randint(6, 20)), 100 + f}]
    sets = O.fund_sets(spark.createDataFrame(rows, "yr int, fund int, element string, weight double")).cache()
    seen = []
    for dense in (0, 5, 10**9):
        monkeypatch.setattr(O, "DENSE", dense)
        monkeypatch.setattr(O, "COLUMNS", 3)
        pairs = O.grain_pairs(sets, sets, 5)
        plan = pairs._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan.split("FlatMapGroups")[0] and "Generate" not in plan.split("FlatMapGroups")[0]
        seen.append({tuple(r) for r in pairs.collect()})
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) > 700
    ratios = spark.createDataFrame([(s, u) for u in (1, 3, 7, 64, 320, 960, 1600) for s in range(u + 1)], "s bigint, u bigint")
    got = ratios.select(O._jaccard("s", "u", "s", 5).alias("exact"), F.round(F.col("s") / F.col("u"), 5).alias("rounded")).collect()
    assert all(r.exact == r.rounded for r in got)


def test_line_items_are_not_shuffled_to_meet_few_parts(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = tables.holdings(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan


def test_medians(spark):
    rng = random.Random(5)
    rows = [(k, rng.choice([round(rng.random(), 3), rng.random(), 0.5])) for k in ("a", "b", None, "c") for _ in range(rng.randint(1, 60))] + [("one", 0.25)]
    got = {r.k: r.v for r in H.medians(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", 0.01).collect()}
    want = pd.DataFrame(rows, columns=["k", "v"]).groupby("k", dropna=False).v.median()
    assert {("-" if pd.isna(k) else k): pytest.approx(v) for k, v in want.items()} == {k or "-": v for k, v in got.items()}


def test_deviations_without_gathering(spark):
    rng = random.Random(6)
    rows = [("i", yr, "S", 500, m, rng.choice([0.9, 0.95, rng.random()])) for yr in range(12) for m in range(yr)]
    df = spark.createDataFrame(rows, "issuer string, yr int, sen string, ibps int, manager int, mark double")
    got = {(r.yr, r.manager): r.dev for r in B.deviations(df).collect()}
    want = {}
    for yr in range(3, 12):
        own = [r for r in rows if r[1] == yr]
        for r in own:
            want[yr, r[4]] = pytest.approx((r[5] - pd.Series([x[5] for x in own if x[4] != r[4]]).median()) * 100)
    assert want == got


def test_words_of_many_names(spark):
    cores = spark.createDataFrame([(f"alpha holding{i % 4} group{i}",) for i in range(12)] + [("alpha holding1 group1x",)], "core string")
    pairs = lambda largest: {tuple(r) for r in I.core_pairs(cores, 85.0, largest).collect()}
    assert pairs(13) == pairs(None) and pairs(None) and pairs(1) == set() and pairs(12) < pairs(None)

"""Issuer strings and clusters of names."""

import random

from pyspark.sql import functions as F

from loanlens.operators import graph
from loanlens.operators import issuers as I


def lcs_table(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
        row = new
    return row[-1]


def test_lcs_against_the_table():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randrange(12))) for _ in range(2))
        assert I.lcs(a, b) == lcs_table(a, b)


def test_parse(spark):
    cases = {  # raw: name, instrument text, ok, norm
        "Belnick, LLC (d/b/a Ubique), Retail, First Lien Term Loan": ("Belnick, LLC (d/b/a Ubique)", "Retail, First Lien Term Loan", True, "belnick"),
        "Anaplan, Inc. - Delayed Draw Loan": ("Anaplan, Inc.", "Delayed Draw Loan", True, "anaplan"),
        "Finastra USA - Revolver": ("Finastra USA", "Revolver", True, "finastra usa"),
        "Investments United States Health Care Equipment & Services Zendesk": ("Zendesk", None, True, "zendesk"),
        "Debt Investments 233.2% United States - 220.5% 1st Lien Avalara Investment Type First Lien Maturity Date 11/2030": (
            "Avalara", "Investment Type First Lien Maturity Date 11/2030", True, "avalara"),
        "PetVet — Term Loan 2": ("PetVet", "Term Loan", True, "petvet"),
        "(2.02%)": (None, None, False, None), "Total investments": (None, None, False, None), "Investments": (None, None, False, None), None: (None, None, False, None), "": (None, None, False, None),
        "in Securities": ("in Securities", None, False, "in securities"),
    }
    df = I.parse(spark.createDataFrame([(k,) for k in cases], "issuer string"))
    for r in df.collect():
        assert (r.issuer_name, r.instrument_text, r.parse_ok, r.issuer_norm) == cases[r.issuer], r
    seen = {r.issuer: (r.seniority, r.instrument_type) for r in df.collect()}
    assert seen["Belnick, LLC (d/b/a Ubique), Retail, First Lien Term Loan"] == ("First Lien", "Term Loan")
    assert seen["Anaplan, Inc. - Delayed Draw Loan"] == (None, "Delayed Draw Term Loan")


def test_core(spark):
    names = {"finastra usa": "finastra", "anaplan anaplan": "anaplan", "non controlled software avalara avalara first lien": "avalara", "in securities": ""}
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", I.core(F.col("n")).alias("c"))
    assert {r.n: r.c for r in df.collect()} == names


def test_components_of_a_path_and_loops(spark):
    edges = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)] + [("z", "z"), ("p", "q"), ("q", "p")]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {f"n{i:03d}": "n000" for i in range(61)} | {"p": "p", "q": "p"}
    assert graph.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_clusters_against_all_pairs(spark):
    rng = random.Random(2)
    names = sorted({" ".join(rng.choice(["alpha", "alphas", "beta", "betta", "delta", "inc", "usa"]) + rng.choice(["", "x"]) for _ in range(rng.randrange(1, 4))) for _ in range(60)})
    df = spark.createDataFrame([(n, i % 3 + 1) for i, n in enumerate(names)], "norm string, rows long")
    got = {r.norm: r.issuer_cluster for r in I.clusters(df, 85.0).collect()}
    cores = {r.norm: r.c for r in df.select("norm", I.core(F.col("norm")).alias("c")).collect()}
    group = {n: n for n in names}
    for _ in names:  # least label until nothing changes
        for a in names:
            for b in names:
                ca, cb = cores[a], cores[b]
                if ca and cb and (ca == cb or set(ca.split()) & set(cb.split()) and 200 * lcs_table(ca, cb) / (len(ca) + len(cb)) >= 85):
                    group[a] = group[b] = min(group[a], group[b])
    rows = {n: i % 3 + 1 for i, n in enumerate(names)}
    want = {n: min((m for m in names if group[m] == group[n]), key=lambda m: (len(m.split()), -rows[m], m)) for n in names}
    assert got == want

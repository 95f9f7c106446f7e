"""Facts to records, and the checks of a record, on literal filings."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from loanlens.operators import facts as X
from loanlens.operators import rules as V

SCHEMA = "accession_no string, row_no int, concept string, label string, period_type string, period_instant date, period_start date, period_end date, numeric_value double, value string, decimals string, dims map<string,string>"
D, OLD = dt.date(2025, 12, 31), dt.date(2024, 12, 31)


class Facts:
    def __init__(self):
        self.rows = []

    def at(self, concept, value, day=D, dims=None, decimals="0", text=None, acc="a"):
        self.rows.append((acc, len(self.rows), concept, "L", "instant", day, None, None, value, text, decimals, dims or {}))

    def over(self, concept, value, start, end=D, dims=None, acc="a"):
        self.rows.append((acc, len(self.rows), concept, "L", "duration", None, start, end, value, None, "0", dims or {}))

    def frame(self, spark):
        return spark.createDataFrame(self.rows, SCHEMA)


@pytest.fixture
def filings(spark):
    return spark.createDataFrame([("a", D, 12)], "accession_no string, reporting_date date, target_months int")


def concepts(spark, *rows):
    return spark.createDataFrame(rows, "field string, concept string, priority int")


def test_instants(spark, filings):
    f = Facts()
    f.at("second", 5.0), f.at("first", None), f.at("old", 1.0, dt.date(2023, 1, 1)), f.at("old", 2.0, OLD), f.at("cash", 3.0), f.at("equivalents", 4.0)
    f.at("second", 9.0, dims={"axis": "m"})
    got = {r.field: (r.value, r.confidence) for r in X.instants(f.frame(spark), filings, concepts(spark, ("x", "first", 1), ("x", "second", 2), ("y", "old", 1), ("z", "none", 1))).collect()}
    assert got == {"x": (5.0, 0.98), "y": (2.0, 0.98)}
    row = X.summed(f.frame(spark), filings, concepts(spark, ("cash", "cash", 1), ("cash", "equivalents", 2))).first()
    assert (row.value, row.raw_text) == (7.0, "cash + equivalents")
    dates = spark.createDataFrame([("a", OLD)], "accession_no string, at date")
    assert X.instants_at(f.frame(spark), dates, concepts(spark, ("y", "old", 1))).first().value == 2.0


def test_durations(spark, filings):
    f, year, quarter = Facts(), dt.date(2025, 1, 1), dt.date(2025, 10, 1)
    f.over("income", 12.0, year), f.over("income", 3.0, quarter), f.over("income", 99.0, year, OLD)
    for member, v in (("m1", 5.0), ("m2", 6.0), ("m2", 6.0)):
        f.over("split", v, year, dims={X.AFFILIATION_AXIS: member})
    f.over("split", 50.0, quarter, dims={X.AFFILIATION_AXIS: "m1"}), f.over("split", 7.0, year, dims={X.AFFILIATION_AXIS: "m1", "other": "o"})
    got = {r.field: (r.value, r.confidence) for r in X.durations(f.frame(spark), filings, concepts(spark, ("i", "income", 1), ("s", "none", 1), ("s", "split", 2))).collect()}
    assert got == {"i": (12.0, 0.97), "s": (11.0, 0.95)}


def test_classes_and_undrawn(spark, filings):
    f = Facts()
    for member, v in (("x:CommonClassIMember", 1.0), ("us-gaap:ClassSMember", 2.0), ("x:ClassIandClassSMember", 3.0)):
        f.at("nav", v, dims={X.CLASS_AXIS: member})
    f.at("nav", 8.0, dims={X.CLASS_AXIS: "x:ClassDMember", "other": "o"})
    assert {(r.class_label, r.value) for r in X.per_class(f.frame(spark), filings, concepts(spark, ("nav", "nav", 1))).collect()} == {("I", 1.0), ("S", 2.0)}
    for dims, v in (({"c": "1"}, 10.0), ({"c": "2"}, 20.0), ({"c": "2"}, 20.0), ({"c": "1", "l": "x"}, 10.0), ({"d": "1"}, 25.0)):
        f.at(X.UNDRAWN, v, dims=dims)
    assert X.undrawn(f.frame(spark), filings).first().value == 30.0
    f.at(X.UNDRAWN, 4.0)
    assert X.undrawn(f.frame(spark), filings).first().value == 4.0


def test_levels(spark, filings):
    totals = spark.createDataFrame([("a", 100000.0)], "accession_no string, total double")
    f = Facts()
    level = lambda k: {X.LEVEL_AXIS: f"us-gaap:FairValueInputsLevel{k}Member"}
    f.at(X.LEVEL_CONCEPTS[0], 20000.0, dims=level(1)), f.at(X.LEVEL_CONCEPTS[0], 70000.0, dims=level(3))
    f.at(X.LEVEL_CONCEPTS[0], 65000.0, dims=level(3) | {"type": "loan"})
    f.at("x:FundsMeasuredAtNetAssetValue", 10000.0)
    assert tuple(X.levels(f.frame(spark), filings, totals).first())[1:] == (20000.0, None, 70000.0, 10000.0)
    g = Facts()
    for t in ("loan", "bond"):
        g.at(X.LEVEL_CONCEPTS[0], 50000.0, dims=level(2) | {"type": t})
    assert X.levels(g.frame(spark), filings, totals).first().level_2 == 100000.0
    g.at(X.LEVEL_CONCEPTS[0], 50000.0, dims=level(2) | {"technique": "dcf"})  # counted twice: nothing is kept
    assert X.levels(g.frame(spark), filings, totals).count() == 0


def test_schedule_scale_and_summary(spark, filings):
    f, fv = Facts(), X.LEVEL_CONCEPTS[0]
    for k in range(12):
        d = {X.HOLDING_AXIS: f"Issuer {k} | {'Non-Affiliated' if k else 'Affiliated'} Issuer"}
        f.at(fv, 60.0, dims=d), f.at(fv, 40.0, dims=d), f.at("us-gaap:InvestmentBasisSpreadVariableRate", 0.05, dims=d), f.at(fv, 77.0, OLD, dims=d)
    f.at("us-gaap:InvestmentVariableInterestRateTypeExtensibleEnumeration", None, dims={X.HOLDING_AXIS: "Issuer 1 | Non-Affiliated Issuer"}, text="http://x#SecuredOvernightFinancingRateSofrMember")
    f.at(fv, 100000.0, dims={X.HOLDING_AXIS: "Issuer 0 twin"}, decimals="-3")
    rows = X.schedule(f.frame(spark), filings)
    totals = spark.createDataFrame([("a", 1200.0)], "accession_no string, total double")
    assert {(r.issuer, r.affiliation, r.reference_rate) for r in rows.filter("member like 'Issuer 1 %'").collect()} == {("Issuer 1", "Non-Affiliated Issuer", "SOFR")}
    assert X.summary(rows, totals).first().num_holdings is None  # the twin makes the schedule overshoot
    kept = X.one_scale(rows, totals)
    assert kept.count() == 12 and kept.agg(F.sum("fair_value")).first()[0] == 1200.0
    s = X.summary(kept, totals).first()
    assert (s.num_holdings, round(s.top_10, 6), round(s.pct_affiliated, 6), round(s.mean_spread, 6), s.mean_yield) == (12.0, round(10 / 12, 6), round(1 / 12, 6), 0.05, None)
    assert X.one_scale(rows, spark.createDataFrame([("a", 5.0)], "accession_no string, total double")).count() == 13


RECORD = [
    "total_assets", "total_liabilities", "total_net_assets", "liabilities_and_equity", "level_1", "level_2", "level_3", "at_nav", "fv_total", "total_investment_income",
    "net_investment_income", "total_expenses", "income_tax_expense", "nii_after_expense_and_tax", "income_before_tax", "interest_income", "dividend_income", "other_investment_income",
    "pik_interest_income", "pik_dividend_income", "pik_income_combined", "net_cash_operating", "net_cash_financing", "net_change_in_cash", "net_cash_investing", "effect_of_fx", "tax_unrealized_appreciation",
    "tax_unrealized_depreciation", "tax_unrealized_net", "asset_coverage", "leverage_ratio", "undrawn", "management_fee", "incentive_fee", "interest_expense", "administrative_fees",
    "professional_fees", "other_g_and_a", "director_trustee_fees", "amortization_of_financing_costs",
]


@pytest.mark.parametrize(
    "values, rule, status",
    [
        ({"total_assets": 1e6, "total_liabilities": 4e5, "total_net_assets": 600500.0}, "C1", "pass"), ({"total_assets": 1e6, "total_liabilities": 4e5, "total_net_assets": 602000.0}, "C1", "fail"),
        ({"total_assets": 1e6}, "C1", "skipped"), ({"fv_total": 5e6, "level_1": 2e6, "at_nav": 3e6}, "C4", "pass"), ({"fv_total": 5e6}, "C4", "skipped"),
        ({"total_investment_income": 1e6, "total_expenses": 4e5, "income_tax_expense": 1e5, "net_investment_income": 5e5}, "C5", "pass"),
        ({"total_investment_income": 1e6, "total_expenses": 4e5, "net_investment_income": 7e5}, "C5", "fail"),
        ({"total_investment_income": 1e6, "interest_income": 8e5, "dividend_income": 0.0, "other_investment_income": 0.0, "pik_interest_income": 2e5}, "C7", "pass"),
        ({"total_investment_income": 1e6, "interest_income": 7e5, "dividend_income": 0.0, "other_investment_income": 0.0, "pik_interest_income": 2e5}, "C7", "fail"),
        ({"net_cash_operating": -5e6, "net_cash_financing": 6e6, "net_change_in_cash": 1e6}, "C9", "pass"), ({"net_cash_operating": -5e6, "net_cash_financing": 6e6, "net_change_in_cash": 2e6}, "C9", "fail"),
        ({"undrawn": -1.0}, "C8", "fail"), ({"undrawn": 5.0}, "C8", "pass"), ({"total_net_assets": 10.0, "management_fee": 6.0}, "C10", "fail"), ({"total_net_assets": -1.0, "management_fee": 6.0}, "C10", "skipped"),
        ({"tax_unrealized_appreciation": 1e5, "tax_unrealized_depreciation": 3e4, "tax_unrealized_net": -7e4}, "C11", "pass"), ({"leverage_ratio": 2.1}, "I2", "fail"), ({"asset_coverage": 1.5}, "I1", "pass"),
    ],
)
def test_record_checks(spark, values, rule, status):
    df = spark.createDataFrame([tuple(values.get(n) for n in RECORD)], ", ".join(f"{n} double" for n in RECORD))
    row = V.validated(df, V.record_checks()).first()
    assert {c.rule: c.status for c in row.checks}[rule] == status
    assert row.status == ("review" if any(c.status == "fail" for c in row.checks) else "pass")


def test_class_checks(spark):
    df = spark.createDataFrame([([("I", 10000.0, 382.0, 25.13), ("S", 25000.0, 1.0, 25.0), ("D", None, 0.0, 0.0), ("Z", 2e5, 1e3, 200.0)], 235000.0)], "c array<struct<label:string,net_assets:double,shares:double,nav:double>>, net double")
    got = {c.rule: (c.status, c.message) for c in df.select(V.class_checks(F.col("c"), F.col("net")).alias("x")).first().x}
    assert got == {"C2[I]": ("pass", None), "C2[S]": ("fail", "unit"), "C2[D]": ("skipped", None), "C2[Z]": ("pass", None), "A2[Z]": ("fail", "A2"), "C3": ("pass", None)}

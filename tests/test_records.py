"""From tagged facts to a checked record, on two literal filings."""

import datetime as dt

import pytest

from loanlens.functions.concepts import FIELDS
from loanlens.operators import facts as X
from loanlens.operators import records as R

from tests.test_facts import Facts

START, END = dt.date(2025, 1, 1), dt.date(2025, 12, 31)


@pytest.fixture
def filings(spark):
    return spark.createDataFrame([("a", END, 12), ("b", END, 12)], "accession_no string, reporting_date date, target_months int")


@pytest.fixture
def tagged():
    f = Facts()
    for concept, v in (("Assets", 1e6), ("Liabilities", 4e5), ("AssetsNet", -6e5), ("StockholdersEquity", 6e5), ("InvestmentOwnedAtFairValue", 9e5), ("InvestmentOwnedAtCost", 1e6), ("Cash", 3e4), ("CashEquivalentsAtCarryingValue", 2e4), ("LineOfCredit", 2e5), ("NotesPayable", 1e5)):
        f.at(f"us-gaap:{concept}", v, END)
    f.at("us-gaap:StockholdersEquity", 5e5, dt.date(2024, 12, 31))
    for level, v in (("1", 1e5), ("3", 8e5)):
        f.at("us-gaap:InvestmentOwnedAtFairValue", v, END, dims={X.LEVEL_AXIS: f"us-gaap:FairValueInputsLevel{level}Member"})
    f.at(X.UNDRAWN, 5e4, END)
    for concept, v in (("GrossInvestmentIncomeOperating", 1e5), ("OperatingExpenses", 3e4), ("NetInvestmentIncome", 6e4), ("IncomeTaxExpenseBenefit", 1.0), ("CurrentIncomeTaxExpenseBenefit", 1.2e4), ("DeferredIncomeTaxExpenseBenefit", -2e3), ("DistributionsMade", 5e4)):
        f.over(f"us-gaap:{concept}", v, START, END)
    for member, v in (("A", 10.0), ("B", 5.0)):
        f.over("us-gaap:StockIssuedDuringPeriodSharesNewIssues", v, START, END, dims={X.CLASS_AXIS: member})
    f.at("us-gaap:InvestmentCompanyExpenseRatio", 0.02, END), f.over("us-gaap:InvestmentCompanyExpenseRatio", 0.03, START, END), f.at("x:Unknown", 1.0, END)
    return f


def test_field_facts(spark, filings, tagged):
    got = {r.field: (r.value, r.confidence) for r in R.field_facts(tagged.frame(spark), filings).filter("accession_no = 'a'").collect()}
    assert got["total_net_assets"] == (6e5, 0.98)  # not the last candidate, which has the wrong sign
    assert got["cash_and_equivalents"] == (5e4, 0.95) and got["total_debt"] == (3e5, 0.95)  # sums stand in
    assert got["income_tax_expense"] == (1e4, 0.95) and "current_tax" not in got
    assert got["shares_issued_new"] == (15.0, 0.93) and got["expense_ratio"] == (0.02, 0.98) and got["undrawn"] == (5e4, 0.97)
    assert got["distributions_declared"] == (5e4, 0.97)


def test_records(spark, filings, tagged):
    rows = {r.accession_no: r for r in R.records(tagged.frame(spark), filings, spark.createDataFrame([("a", 1e4)], "accession_no string, unfunded double")).collect()}
    a, b = rows["a"], rows["b"]
    assert (a.level_1, a.level_2, a.level_3, a.fv_total) == (1e5, None, 8e5, 9e5)
    assert (a.period_start, a.opening_net_assets, a.closing_net_assets) == (START, 5e5, 6e5)
    assert (a.leverage_ratio, a.net_debt, a.portfolio_mark, a.liquidity_coverage, a.distribution_coverage) == (0.5, 2.5e5, 0.9, 10.0, 1.2)
    status = {c.rule: c.status for c in a.checks}
    assert (status["C1"], status["C4"], status["C5"], status["A1"], status["C8"]) == ("pass", "pass", "pass", "pass", "pass") and a.status == "pass"
    assert b.total_assets is None and b.fv_total is None and {c.status for c in b.checks} == {"skipped"} and b.status == "pass"


def test_no_facts(spark, filings, tagged):
    empty = tagged.frame(spark).limit(0)
    assert R.field_facts(empty, filings).count() == 0
    assert R.records(empty, filings).count() == 2 and R.records(empty, filings.limit(0)).count() == 0


def test_the_table_names_a_concept_once_a_field():
    assert all(len(c) == len(set(c)) and all(":" in x for x in c) for _, _, _, c in FIELDS)
    assert len({(kind, f) for _, kind, f, _ in FIELDS}) == len(FIELDS)

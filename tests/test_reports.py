"""Report sections on documents written by hand."""

import datetime as dt
import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanlens.functions import markup as M
from loanlens.operators import reports as R

PAD = "<p>" + "text without titles " * 100 + "</p>"
TABLE = "<table><tr><td>Fund A</td><td></td><td></td><td>$</td><td>1,234</td></tr><tr><td>Loss<sup>1</sup></td><td>(</td><td>237,536</td><td>)</td></tr>" + "".join(f"<tr><td>Line {i}</td><td>{i},{i}00.25</td></tr>" for i in range(1, 9)) + "</table>"
SHEET = "<h2>Statement of Assets and Liabilities</h2>" + TABLE + PAD
OPERATIONS = "<h2>Statement of <b>Operations</b></h2>" + TABLE + PAD
CHANGES = "<h2>Statements of Changes in Net Asset<span>s</span></h2>" + TABLE + PAD
NOTES = "<h2>Notes to Financial Statements</h2>" + PAD
CONTENTS = "<p>Schedule of Investments 1</p><p>Statement of Assets and Liabilities 2</p><p>Statement of Operations 3</p><p>Statement of Changes in Net Assets 4</p>"
SCHEDULE = "<h2>Schedule of Investments</h2>" + PAD


def test_blanking_keeps_offsets():
    raw = "a<!-- x\ny -->b<script>var s = '</p>';</script>c&amp;<b>d</b>"
    flat = M.blanked(raw)
    assert len(flat) == len(raw) and "".join(flat.split()) == "abcd"


def test_full_report():
    got = M.sections(CONTENTS + PAD + SCHEDULE + SHEET + OPERATIONS + CHANGES + NOTES)
    assert len(got["blocks"]) == 1 and got["blocks"][0].kinds == ["assets_liabilities", "operations", "changes_in_net_assets"] and got["flags"] == []
    assert "Fund A |  | $1,234\nLoss | (237,536)\nLine 1 | 1,100.25" in got["text"]
    assert "Notes to Financial" not in got["text"]


def test_contents_only_and_no_titles():
    assert M.sections(CONTENTS + PAD)["blocks"] == []
    assert M.sections(CONTENTS + PAD)["flags"][0] == "preprocess:block_selection_failed"
    assert M.sections("<p>hello</p>")["flags"] == ["preprocess:no_statement_titles", "preprocess:fallback_wholedoc"]
    assert M.sections("")["text"] == ""


def test_sheet_before_schedule_and_late_highlights():
    got = M.sections(SHEET + SCHEDULE + OPERATIONS + CHANGES + NOTES + PAD * 70 + "<h2>Financial Highlights</h2>" + TABLE)
    assert len(got["blocks"][0].spans) == 3
    assert {"preprocess:balance_sheet_before_holdings", "preprocess:highlights_after_notes"} <= set(got["flags"])
    assert "preprocess:no_balance_sheet_title" in M.sections(OPERATIONS + CHANGES + NOTES)["flags"]


def test_references_are_not_headings():
    found = M.titles("See accompanying Notes to Financial Statements." + PAD + "<b>Statement of Operations</b>")
    assert [(t.kind, t.reference) for t in found] == [("notes", True), ("operations", False)]


def test_dot_leaders_and_space_columns():
    assert M.serialised("<p>Net assets .......... $ 5</p>") == "Net assets | $ 5"
    assert M.serialised("<table>Cash      1,000\nDebt   (  2,000  )\n-----  ----\n</table>").splitlines()[1:3] == ["Cash | 1,000", "Debt | (2,000)"]


def test_encodings():
    assert M.decode("é—".encode()) == "é—"
    assert M.decode("é—".encode("cp1252")) == "é—"
    assert M.decode("é".encode() * 20000 + b"\xff").count("é") == 20000


def test_sections_of_a_corpus(spark):
    docs = [("a", (SHEET + OPERATIONS + CHANGES + NOTES).encode()), ("b", None), ("c", b"\xff\xfe")]
    out = {r.path: r for r in R.sections(spark.createDataFrame(docs, "path string, content binary")).collect()}
    assert out["a"].kinds[0] == "assets_liabilities" and "$1,234" in out["a"].text and out["b"].raw_chars == 0 and out["c"].error is None
    assert R.census(R.sections(spark.createDataFrame(docs, "path string, content binary"))).filter("flag = 'preprocess:fallback_wholedoc'").first().documents == 2


def test_inline_values(spark):
    raw = """<xbrli:context id="c1"><xbrli:startDate>2025-01-01</xbrli:startDate><xbrli:endDate>2025-12-31</xbrli:endDate></xbrli:context>
    <xbrli:context id='c2'><xbrldi:explicitMember dimension="d">XCAPX:ClassAMember</xbrldi:explicitMember><xbrli:instant>2025-12-31</xbrli:instant></xbrli:context>
    <ix:nonFraction name="cef:Ratio" contextRef="c1" scale="-2">1.50</ix:nonFraction> <ix:nonFraction name="x:Loss" contextRef="c1" sign="-" scale="3">(<b>237</b>,536)</ix:nonFraction>
    <ix:nonFraction name="x:Nil" contextRef="c1" xs:nil="true">5</ix:nonFraction> <ix:nonFraction name="x:Nav" contextRef="c2">$&#160;25.10</ix:nonFraction> <ix:nonNumeric name="x:Name" contextRef="c9">A &amp; B</ix:nonNumeric>"""
    values = R.inline_values(spark.createDataFrame([("p", raw), ("q", None)], "path string, text string"))
    got = {r.concept: r for r in values.withColumn("words", R.member_words(F.col("member"))).collect()}
    assert {k: (round(r.value, 6) if r.value is not None else None, r.text) for k, r in got.items()} == {"cef:Ratio": (0.015, "1.50"), "x:Loss": (-237536000.0, "(237,536)"), "x:Nav": (25.1, "$ 25.10"), "x:Name": (None, "A & B")}
    assert got["x:Nav"].words == "Class A" and got["cef:Ratio"].period_start == dt.date(2025, 1, 1) and got["x:Name"].period_end is None
    at = spark.createDataFrame([("p", dt.date(2025, 12, 31))], "path string, at date")
    assert {r.concept for r in R.values_at(values, at).collect()} == {"cef:Ratio", "x:Loss"}


def test_model_ends(spark):
    schema = T.StructType([T.StructField("net", T.DoubleType()), T.StructField("scale", T.StringType())])
    ask = R.requests(spark.createDataFrame([("p", "body"), ("q", "")], "path string, text string"), schema, "Read.").collect()
    assert len(ask) == 1 and re.fullmatch("[0-9a-f]{64}", ask[0].id) and "net: double" in ask[0].prompt
    rows = [("1", "end", '{"net": 1234.5, "scale": "thousands"}'), ("2", "refusal", None), ("3", "max_tokens", '{"net"'), ("4", "end", " "), ("5", "end", '{"net": "x'), ("6", "end", '{"net": "words"}')]
    got = {r.id: (r.status, r.record) for r in R.responses(spark.createDataFrame(rows, "id string, stop_reason string, body string"), schema).collect()}
    assert {k: v[0] for k, v in got.items()} == {"1": "ok", "2": "refused", "3": "truncated", "4": "empty", "5": "invalid", "6": "invalid"}
    assert got["1"][1].net == 1234.5
    df = spark.createDataFrame([(1234.5, "amount"), (10000.0, "shares"), (42.0, "percent"), (9.5, "per_share")], "v double, k string")
    assert [r[0] for r in df.select(R.scaled(F.col("v"), F.col("k"), F.lit("thousands"), F.lit("units"))).collect()] == [1234500.0, 10000.0, 0.42, 9.5]
    trust = spark.createDataFrame([(100.0, 100.5, True), (100.0, 120.0, True), (100.0, None, True), (100.0, 100.0, False), (0.0, 0.0, True)], "r double, t double, ok boolean")
    assert [r[0] for r in trust.select(R.agreement(F.col("r"), F.col("t"), F.col("ok"))).collect()] == [0.97, 0.40, 0.80, 0.60, 0.97]

"""Validation: every check is a row (rule, status, message); missing inputs are skipped, never failed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import looks_rounded


def tolerance(x: Column, relative: float = 1e-3, floor: float = 1000.0) -> Column:
    return F.greatest(F.abs(x) * relative, F.lit(floor))


def check(rule: str, ok: Column, inputs: list[Column], message: Column | None = None) -> Column:
    missing = F.lit(False)
    for c in inputs:
        missing = missing | c.isNull()
    status = F.when(missing, "skipped").when(ok, "pass").otherwise("fail")
    return F.struct(F.lit(rule).alias("rule"), status.alias("status"), F.when(status == "fail", message if message is not None else F.lit(rule)).alias("message"))


def balance(assets: Column, liabilities: Column, net: Column) -> Column:
    """C1: assets = liabilities + net assets."""
    return check("C1", F.abs(assets - liabilities - net) <= tolerance(assets), [assets, liabilities, net])


def nav_per_share(net: Column, shares: Column, reported: Column) -> Column:
    """C2: reported NAV against net assets / shares. The band propagates the rounding of each input (half a thousand where it looks
    stored in thousands, else half a unit) and that of the NAV itself; at least a cent."""
    computed = net / F.nullif(shares, F.lit(0.0))
    half = lambda x: F.when(looks_rounded(x), 500.0).otherwise(0.5)
    size = F.nullif(F.abs(shares), F.lit(0.0))
    band = F.greatest(F.lit(0.01), half(net) / size + F.abs(computed) * half(shares) / size + 0.005)
    return check("C2", F.abs(computed - reported) <= band, [computed, reported])


def validated(df: DataFrame, checks: list[Column]) -> DataFrame:
    """Adds checks (array of structs) and status: review as soon as one check fails."""
    return df.withColumn("checks", F.array(*checks)).withColumn("status", F.when(F.exists("checks", lambda c: c["status"] == "fail"), "review").otherwise("pass"))


def record_checks(levels: list[str] = ["level_1", "level_2", "level_3", "at_nav"], fees: list[str] | None = None) -> list[Column]:
    """The checks of a flat filing record, each over the columns it names."""
    c = F.col
    zero = lambda name: F.coalesce(c(name), F.lit(0.0))
    total = lambda names: sum((zero(n) for n in names[1:]), zero(names[0]))
    any_of = lambda names: F.coalesce(*[c(n) for n in names])
    fees = fees or ["management_fee", "incentive_fee", "interest_expense", "administrative_fees", "professional_fees", "other_g_and_a", "director_trustee_fees", "amortization_of_financing_costs"]
    assets, net, tii, nii, expenses, tax = c("total_assets"), c("total_net_assets"), c("total_investment_income"), c("net_investment_income"), c("total_expenses"), zero("income_tax_expense")
    off = F.least(F.abs(tii - expenses - nii), F.abs(tii - expenses - tax - nii), F.abs(c("nii_after_expense_and_tax") - nii), F.abs(c("income_before_tax") - tax - nii))
    gap = tii - c("interest_income") - c("dividend_income") - c("other_investment_income")
    pik = F.greatest(c("pik_interest_income") + zero("pik_dividend_income"), zero("pik_income_combined"))
    op, fin, change = c("net_cash_operating"), c("net_cash_financing"), c("net_change_in_cash")
    foots = op + zero("net_cash_investing") + fin + zero("effect_of_fx") - change
    up, down, unrealised = c("tax_unrealized_appreciation"), c("tax_unrealized_depreciation"), c("tax_unrealized_net")
    positive = F.when(net > 0, net)
    return [
        balance(assets, c("total_liabilities"), net),
        check("C1b", F.abs(c("liabilities_and_equity") - assets) <= tolerance(assets), [assets, c("liabilities_and_equity")]),
        check("C4", F.abs(total(levels) - c("fv_total")) <= tolerance(c("fv_total")), [c("fv_total"), any_of(levels)]),
        check("C5", off <= tolerance(tii), [tii, expenses, nii]),
        check("C7", (gap >= -tolerance(tii)) & (gap <= pik + tolerance(tii)), [tii, gap, c("pik_interest_income")]),
        check("C9", F.abs(foots) <= F.greatest(tolerance(change), 0.005 * F.greatest(F.abs(op), F.abs(fin), F.abs(change))), [op, fin, change]),
        check("I1", c("asset_coverage") >= 1.5, [c("asset_coverage")]),
        check("I2", c("leverage_ratio").between(0.0, 2.0), [c("leverage_ratio")]),
        check("A1", net > 0, [net]),
        check("C8", (c("undrawn") >= 0) & F.coalesce(c("undrawn") <= assets, F.lit(True)), [c("undrawn")]),
        check("C10", total(fees) <= 0.5 * net, [positive, any_of(fees)]),
        check("C11", F.abs(F.abs(up - down) - F.abs(unrealised)) <= F.greatest(tolerance(unrealised), 0.015 * F.greatest(F.abs(up), F.abs(down), F.abs(unrealised))), [up, down, unrealised]),
    ]


def class_checks(classes: Column, net: Column) -> Column:
    """array of checks on array<struct<label, net_assets, shares, nav>>: C2 a class, A2 where a NAV is not plausible, C3."""
    def c2(s: Column) -> Column:
        computed = s["net_assets"] / F.nullif(s["shares"], F.lit(0.0))
        unit = F.coalesce((computed / F.nullif(s["nav"], F.lit(0.0)) / 1000).between(0.5, 1.5), F.lit(False))
        out = nav_per_share(s["net_assets"], s["shares"], s["nav"])
        return F.struct(F.concat(F.lit("C2["), s["label"], F.lit("]")).alias("rule"), out["status"].alias("status"), F.when(out["status"] == "fail", F.when(unit, "unit").otherwise("C2")).alias("message"))

    implausible = F.filter(classes, lambda s: (s["nav"] != 0) & ~s["nav"].between(1.0, 100.0))
    a2 = F.transform(implausible, lambda s: F.struct(F.concat(F.lit("A2["), s["label"], F.lit("]")).alias("rule"), F.lit("fail").alias("status"), F.lit("A2").alias("message")))
    known = F.filter(F.transform(classes, lambda s: s["net_assets"]), lambda v: v.isNotNull())
    added = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda x, v: x + v))
    c3 = check("C3", F.abs(added - net) <= tolerance(net), [added, net])
    return F.concat(F.transform(classes, c2), a2, F.array(c3))


def review_queue(validated_records: DataFrame) -> DataFrame:
    """Adds flags, 'rule: message; ...' of the failed checks, and keeps the records under review."""
    failed = F.transform(F.filter("checks", lambda c: c["status"] == "fail"), lambda c: F.concat_ws(": ", c["rule"], c["message"]))
    return validated_records.filter("status = 'review'").withColumn("flags", F.array_join(failed, "; "))


def revalidated(records: DataFrame, checks: list[Column], metadata: DataFrame | None = None, key: str = "cik") -> DataFrame:
    """Stored records with their checks recomputed from the values they hold, and the columns of metadata (one row a key) taken
    over where it knows the key; nothing is extracted again."""
    plain = records.drop("checks", "status")
    if metadata is not None:
        fresh = [c for c in metadata.columns if c != key]
        known = metadata.select(key, F.struct(*fresh).alias("__new"))
        joined = plain.join(known, key, "left")
        plain = joined.select(*[F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c) if c in fresh else F.col(c) for c in plain.columns])
    return validated(plain, checks)

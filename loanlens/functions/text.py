"""Scalar functions on names, keys, dates and printed numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocabulary import GENERIC


def key10(text: Column) -> Column:
    """Digits padded to ten; null if there are none."""
    digits = F.regexp_replace(F.regexp_replace(F.trim(text), r"\.0$", ""), "[^0-9]", "")
    return F.when(digits != "", F.lpad(digits, 10, "0"))


def name_norm(text: Column) -> Column:
    plain = F.regexp_replace(F.lower(text), r"\(.*?\)", " ")
    plain = F.regexp_replace(plain, r"\b(incorporated|inc|llc|l\.l\.c|lp|l\.p|ltd|limited|corp|corporation|company|co)\b\.?", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]", " "), " +", " "))


def core_key(norm: Column, generic: list[str] = GENERIC) -> Column:
    """Distinct, sorted words of at least two characters that are neither generic nor numbers."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(norm, " "), lambda w: (F.length(w) >= 2) & ~w.isin(generic) & ~w.rlike("^[0-9]+$")))), " ")


def printed_date(text: Column) -> Column:
    """'Sept 30, 2025', '9/30/2025' or ISO; anything else is null."""
    words = F.regexp_replace(F.trim(text), r"^([A-Za-z]{3})[a-z]*\.? +(\d{1,2}),? +(\d{4})$", "$1 $2 $3")
    return F.coalesce(F.try_to_timestamp(words, F.lit("MMM d yyyy")), F.try_to_timestamp(text, F.lit("M/d/yyyy")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))).cast("date")


def printed_number(text: Column, scale: Column | int = 0) -> Column:
    """'$1,234' or '(237,536)' times a power of ten."""
    sign = F.when(F.trim(text).rlike(r"^\(.*\)$"), -1).otherwise(1)
    return F.regexp_replace(text, r"[,$%()\s]", "").try_cast("double") * sign * F.pow(F.lit(10.0), F.lit(scale) if isinstance(scale, int) else scale)


def months_between_ends(start: Column, end: Column) -> Column:
    return F.bround(F.datediff(end, start) / 30.44).cast("int")


def years_between(start: Column, end: Column) -> Column:
    return F.datediff(end, start) / 365.25


def period_start(end: Column, months: Column) -> Column:
    """First day of a period of whole months that ends in the month of `end`; null without an end or a length."""
    return F.when(months != 0, F.trunc(F.add_months(end, -(months - 1)), "MM"))


def known_text(text: Column, missing: tuple[str, ...] = ("-", "nan", "None")) -> Column:
    """Trimmed text; null and the marks of missing values are empty."""
    plain = F.trim(F.coalesce(text, F.lit("")))
    return F.when(plain.isin(*missing), "").otherwise(plain)


def loose_key(name: Column) -> Column:
    """Lower-case letters and digits only; null is empty."""
    return F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]", "")


def names_agree(a: Column, b: Column) -> Column:
    """Whether one loose key contains the other; null if either has no letter or digit."""
    x, y = loose_key(a), loose_key(b)
    return F.when((x != "") & (y != ""), F.contains(x, y) | F.contains(y, x))


def filing_url(cik: Column, accession: Column, base: str = "https://www.sec.gov/Archives/edgar/data") -> Column:
    """Index page of a filing; empty without a key or an accession number."""
    key, number = F.ltrim(F.coalesce(cik, F.lit("")), F.lit("0")), F.coalesce(accession, F.lit(""))
    return F.when((key == "") | (number == ""), "").otherwise(F.concat(F.lit(f"{base}/"), key, F.lit("/"), F.replace(number, F.lit("-"), F.lit("")), F.lit("/"), number, F.lit("-index.htm")))

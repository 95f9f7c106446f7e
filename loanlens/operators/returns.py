"""Returns over a window, chained from year-to-date figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_returns(reported: DataFrame, start: str | int, end: str | int, annual: str = "10-K") -> DataFrame:
    """reported (fund, form_type, date, ytd) -> a row per fund: window_return and reason, the return from `start` to `end`.

    Year-to-date figures reset at a fiscal year end, the date of an annual form, so they are chained: out of the first year
    (from zero if the window opens on a year end), times each year end strictly inside, times the last stub. A missing link gives
    null and a reason. Of several figures for one date that of the annual form counts. One shuffle on fund."""
    by_date = reported.groupBy("fund", "date").agg(
        F.min_by("ytd", F.struct((F.col("form_type") != annual).alias("later"), F.col("form_type"), F.col("ytd"))).alias("ytd"), F.bool_or(F.col("form_type") == annual).alias("year_end")
    )
    date, first, last = F.col("date"), F.lit(start), F.lit(end)
    inside = F.col("year_end") & (date > first) & (date < last)
    one = by_date.groupBy("fund").agg(
        F.max(F.when(date == first, F.col("ytd"))).alias("at_start"), F.bool_or((date == first) & F.col("year_end")).alias("opens"), F.max(F.when(date == last, F.col("ytd"))).alias("at_end"),
        F.coalesce(F.product(F.when(inside, 1 + F.col("ytd"))), F.lit(1.0)).alias("chain"), F.min(F.when(inside & F.col("ytd").isNull(), date)).alias("gap"),
    )
    reason = F.when(F.col("at_start").isNull(), "no YTD at window start").when(F.col("at_end").isNull(), "no YTD at window end").when(F.col("gap").isNotNull(), F.concat(F.lit("no YTD at fiscal year end "), F.col("gap").cast("string"))).otherwise("")
    base = F.when(F.col("opens"), 0.0).otherwise(F.col("at_start"))
    value = F.col("chain") / F.nullif(1 + base, F.lit(0.0)) * (1 + F.col("at_end")) - 1
    return one.select("fund", F.when(reason == "", value).alias("window_return"), reason.alias("reason"))

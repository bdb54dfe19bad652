"""Step 1, dates in nine spellings. The spelling that matches first decides; if its fields make no date, the result is
null and no other spelling is tried."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridra.functions.text import month_number, part, stamp, text, two_digit_year
from veridra.operators.base import Step, counted, measure
from veridra.rules import DATE_FORMATS, DATE_NULLS

TARGETS = {"TXN_DATE_TIME": "TXN_DATE_TIME_CLEANED", "SETTLE_DATE": "SETTLE_DATE_CLEANED"}


def spelling(v: Column) -> Column:
    """Name of the first spelling that fits stripped text; null for null tokens and unknown ones."""
    out = F.when(v.isin(*DATE_NULLS), F.lit(None).cast("string"))
    for name, pattern in DATE_FORMATS:
        out = out.when(v.rlike(pattern), F.lit(name))
    return out


def value_of(v: Column, name: Column) -> Column:
    """The wall-clock time of stripped text in a known spelling."""
    month = month_number(F.substring(v, 4, 3))
    year = two_digit_year(part(v, 8, 2))
    iso = (part(v, 1, 4), part(v, 6, 2), part(v, 9, 2))
    slash = (part(v, 7, 4), part(v, 4, 2), part(v, 1, 2))
    dash = (part(v, 7, 4), part(v, 1, 2), part(v, 4, 2))
    minute = (part(v, 12, 2), part(v, 15, 2))
    millis = F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(secs=(v.try_cast("long") / 1000).cast("decimal(18,6)"))
    return (
        F.when(name == "iso_datetime", F.when(F.substring(v, 11, 1) == " ", stamp(*iso, *minute, part(v, 18, 2))))
        .when(name == "iso_date", stamp(*iso))
        .when(name == "epoch_millis", millis)
        .when(name == "day_month_abbrev_datetime", stamp(year, month, part(v, 1, 2), part(v, 11, 2), part(v, 14, 2)))
        .when(name == "day_month_abbrev", stamp(year, month, part(v, 1, 2)))
        .when(name == "slash_day_first_datetime", stamp(*slash, *minute))
        .when(name == "slash_day_first", stamp(*slash))
        .when(name == "dash_month_first_datetime", stamp(*dash, *minute))
        .when(name == "dash_month_first", stamp(*dash))
    )


def parsed(df: DataFrame, source: str, target: str, name: str | None = None) -> DataFrame:
    """df with the time in target, and the spelling in name (null where there is no time)."""
    out = df.withColumn("_text", text(F.col(source))).withColumn("_spelling", spelling(F.col("_text")))
    out = out.withColumn(target, value_of(F.col("_text"), F.col("_spelling")))
    if name:
        out = out.withColumn(name, F.when(F.col(target).isNotNull(), F.col("_spelling")))
    return out.drop("_text", "_spelling")


class DateNormalizer(Step):
    name = "dates"

    def apply(self, df: DataFrame) -> DataFrame:
        for source, target in TARGETS.items():
            if source in df.columns:
                df = parsed(df, source, target)
        return df

    def metrics(self, before: DataFrame, after: DataFrame) -> list[DataFrame]:
        out = []
        for source, target in TARGETS.items():
            if source not in before.columns:
                continue
            token, lost = text(F.col(source)).isin(*DATE_NULLS), F.col(target).isNull()
            out.append(measure(after, [(f"{source}.unparseable", F.count_if(lost) - F.count_if(token), True), (f"{source}.missing_or_placeholder", F.count_if(token), True)]))
            named = parsed(before, source, "_time", "_name")
            out.append(counted(named, f"{source}.format", "_name"))
        return out

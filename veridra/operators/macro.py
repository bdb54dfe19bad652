"""Step 11, macro columns recovered by lookup, and the extraction of the series from rows that state them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridra.functions.text import number, text
from veridra.operators.base import Step, measure
from veridra.rules import MACRO_SERIES, OUT_OF_PANEL

COVERAGE = ("OBSERVED", "RECOVERED", "UNRECOVERABLE", "OUT_OF_PANEL")


def coerced(source: str, c: Column) -> Column:
    """The value as the type of its column; what can't be read is null."""
    if source == "IS_HOLIDAY_MONTH":
        v = F.upper(text(c))
        return F.when(v.isin("TRUE", "1"), True).when(v.isin("FALSE", "0"), False)
    return number(c)


def month_key(timestamp: Column, *context: Column) -> Column:
    """yyyy-MM and the context, joined by bars; null without a time."""
    return F.when(timestamp.isNotNull(), F.concat_ws("|", F.date_format(timestamp, "yyyy-MM"), *(text(c) for c in context)))


def extract(df: DataFrame, column: str, context: tuple[str, ...] = (), timestamp: str = "TXN_TS") -> DataFrame:
    """key and value of a series that is constant within its key; a key with two values raises when rows are read."""
    rows = df.where(F.col(column).isNotNull() & F.col(timestamp).isNotNull())
    for c in context:
        rows = rows.where(F.col(c).isNotNull())
    by = rows.groupBy(month_key(F.col(timestamp), *map(F.col, context)).alias("key")).agg(F.min(column).alias("value"), F.max(column).alias("other"))
    clash = F.raise_error(F.concat(F.lit(f"{column} is not constant in "), F.col("key"))).cast("string")
    return by.select("key", F.when(F.col("value") == F.col("other"), F.col("value").cast("string")).otherwise(clash).alias("value"))


class MacroCleaner(Step):
    """config series maps a macro column to a frame of key and value (as from `extract`), or a dict; timestamp_col names
    the time. Nothing is recovered for a column without a series."""

    name = "macro"

    def apply(self, df: DataFrame) -> DataFrame:
        timestamp = self.config.get("timestamp_col", "TXN_TS")
        if timestamp not in df.columns:
            return df
        for source, context in MACRO_SERIES:
            if not {source, *context} <= set(df.columns):
                continue
            series = self.config.get("series", {}).get(source, {})
            if not isinstance(series, DataFrame):
                series = df.sparkSession.createDataFrame([(k, str(v)) for k, v in series.items()], "key string, value string")
            found = series.select(F.col("key").alias("_key"), F.col("value").cast("string").alias("_value"))
            out = df.withColumn("_month", month_key(F.col(timestamp), *map(F.col, context)))
            out = out.join(found, F.col("_month") == F.col("_key"), "left")
            seen = F.col(source).isNotNull()
            outside = text(F.col(context[0])).isin(*OUT_OF_PANEL) if context and source == "INFLATION_INDEX" else F.lit(False)
            status = F.when(seen, "OBSERVED").when(outside, "OUT_OF_PANEL").when(F.col("_value").isNotNull(), "RECOVERED").otherwise("UNRECOVERABLE")
            value = F.when(seen, coerced(source, F.col(source))).otherwise(coerced(source, F.col("_value")))
            df = out.withColumn(f"{source}_CLEANED", value).withColumn(f"{source}_COVERAGE", status).drop("_month", "_key", "_value")
        return df

    def metrics(self, before: DataFrame, after: DataFrame) -> list[DataFrame]:
        rows = [(f"{s}.{x.lower()}", F.count_if(F.col(f"{s}_COVERAGE") == x), False) for s, _ in MACRO_SERIES if f"{s}_COVERAGE" in after.columns for x in COVERAGE]
        return [measure(after, rows)] if rows else []

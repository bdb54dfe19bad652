"""Step 2, duplicates: exact rows go, business keys are counted, ids that collide get a suffix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridra.functions.text import text
from veridra.operators.base import Step, measure, row_order


def exact(df: DataFrame) -> DataFrame:
    """df without rows that repeat an earlier one in every column but the ingest order."""
    keys = [c for c in df.columns if c != "_row_ix"]
    if "_row_ix" not in df.columns:
        return df.dropDuplicates(keys)
    return df.groupBy(*keys).agg(F.min("_row_ix").alias("_row_ix")).select(*df.columns)


def repeats(df: DataFrame, keys: list[str]) -> Column:
    """How many rows share their keys with another (an aggregate over counted groups, which no hot key gathers)."""
    return F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0))


def repeat_count(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(repeats(df, keys), F.lit(0)).alias("value"))


def suffixed(df: DataFrame, id_col: str = "TXN_ID", order_col: str = "TXN_DATE_TIME_CLEANED") -> DataFrame:
    """df with {id_col}_CLEANED: ids met more than once get _1, _2 in order of time, then of ingest."""
    own = Window.partitionBy("_id")
    order = [F.asc_nulls_last(order_col)] if order_col in df.columns else []
    out = df.withColumn("_id", text(F.col(id_col))).withColumn("_ix", row_order(df))
    at = F.row_number().over(own.orderBy(*order, "_ix"))
    out = out.withColumn("_n", F.count("*").over(own)).withColumn("_at", at)
    new = F.when(F.col("_n") > 1, F.concat_ws("_", "_id", F.col("_at").cast("string"))).otherwise(F.col("_id"))
    return out.withColumn(f"{id_col}_CLEANED", new).drop("_id", "_ix", "_n", "_at")


class DuplicateCleaner(Step):
    name = "duplicates"

    def apply(self, df: DataFrame) -> DataFrame:
        df = exact(df)
        id_col = self.config.get("id_col", "TXN_ID")
        return suffixed(df, id_col, self.config.get("order_col", "TXN_DATE_TIME_CLEANED")) if id_col in df.columns else df

    def metrics(self, before: DataFrame, after: DataFrame) -> list[DataFrame]:
        n = before.agg(F.count("*").alias("b")).crossJoin(after.agg(F.count("*").alias("a")))  # one row each
        row = lambda at, metric, df: df.select(F.lit(at).alias("at"), F.lit(metric).alias("metric"), F.col("value").cast("long").alias("value"))
        out = [row(0, "exact_duplicate_rows_dropped", n.select((F.col("b") - F.col("a")).alias("value")))]
        for k, keys in enumerate(self.policy.business_keys):
            if set(keys) <= set(after.columns):
                out.append(row(1 + k, f"business_key_repeats[{'+'.join(keys)}]", repeat_count(after, list(keys))))
        id_col = self.config.get("id_col", "TXN_ID")
        if id_col in after.columns:
            out.append(measure(after, [("txn_id_collisions", F.count_if(text(F.col(id_col)) != F.col(f"{id_col}_CLEANED")), True)]))
        return out

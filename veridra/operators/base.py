"""What every cleaning step is: a lazy DataFrame to DataFrame transform, with its metrics as one aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridra.policy import Policy, default_policy

#: A metric: its name, the aggregate, and whether it is reported when zero.
Metric = tuple[str, Column, bool]


def measure(df: DataFrame, metrics: Sequence[Metric]) -> DataFrame:
    """Rows at, metric and value of the metrics, from one aggregate over df."""
    if not metrics:
        return df.sparkSession.createDataFrame([], "at long, metric string, value long")
    row = df.agg(*(value.cast("long").alias(f"m{k}") for k, (_, value, _) in enumerate(metrics)))
    each = F.array(*(F.struct(F.lit(k).cast("long").alias("at"), F.lit(name).alias("metric"), F.coalesce(f"m{k}", F.lit(0)).alias("value"), F.lit(always).alias("always")) for k, (name, _, always) in enumerate(metrics)))
    return row.select(F.inline(each)).where("always or value > 0").select("at", "metric", "value")


def counted(df: DataFrame, prefix: str, column: str) -> DataFrame:
    """Rows at, metric and value: how often each non-empty value comes, the commonest first in `at`."""
    rows = df.where(F.coalesce(F.col(column), F.lit("")) != "").groupBy(column).agg(F.count("*").alias("value"))
    return rows.select((-F.col("value")).cast("long").alias("at"), F.concat(F.lit(prefix + "["), column, F.lit("]")).alias("metric"), "value")


class Step:
    """One step. It skips what its input lacks the columns for, and never changes a raw column."""

    name = "step"

    def __init__(self, policy: Policy | None = None, **config):
        self.policy, self.config = policy or default_policy(), config

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.apply(df)

    def apply(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def metrics(self, before: DataFrame, after: DataFrame) -> list[DataFrame]:
        """Frames with at, metric and value; before and after are the step's input and output."""
        return []


def row_order(df: DataFrame) -> Column:
    """What breaks ties: the ingest order where it is known."""
    return F.col("_row_ix") if "_row_ix" in df.columns else F.monotonically_increasing_id()

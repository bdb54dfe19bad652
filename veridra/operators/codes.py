"""Step 3, fixed-width codes: leading zeros restored, labels regenerated, categories looked up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridra.functions.text import lookup, text, zfill
from veridra.operators.base import Step, measure
from veridra.rules import PROCESSING_CODES


def reference_frame(rows: DataFrame, code: str, category: str, width: int = 4) -> DataFrame:
    """code and category of a reference sheet; a later row of the same code wins."""
    from veridra.operators.base import row_order

    each = rows.select(zfill(text(F.col(code)), width).alias("code"), F.col(category).alias("category"), row_order(rows).alias("ix"))
    return each.groupBy("code").agg(F.max_by("category", "ix").alias("category"))


class CodeNormalizer(Step):
    """config mcc_reference: DataFrame of code and category, or a small dict."""

    name = "codes"

    def apply(self, df: DataFrame) -> DataFrame:
        if "PROCESSING_CODE" in df.columns:
            df = df.withColumn("PROCESSING_CODE_CLEANED", zfill(text(F.col("PROCESSING_CODE")), self.policy.processing_code_width))
            df = df.withColumn("PROCESSING_TYPE_CLEANED", lookup(F.col("PROCESSING_CODE_CLEANED"), PROCESSING_CODES))
        if "MCC_CODE" in df.columns:
            df = df.withColumn("MCC_CODE_CLEANED", zfill(text(F.col("MCC_CODE")), self.policy.mcc_width))
            reference = self.config.get("mcc_reference")
            if isinstance(reference, DataFrame):
                known = reference.select(F.col("code").alias("_code"), F.col("category").alias("_category"))
                df = df.join(known, F.col("MCC_CODE_CLEANED") == F.col("_code"), "left").withColumn("MCC_CATEGORY", F.coalesce("_category", F.lit(""))).drop("_code", "_category")
            else:
                df = df.withColumn("MCC_CATEGORY", F.coalesce(lookup(F.col("MCC_CODE_CLEANED"), reference or {}), F.lit("")))
        return df

    def metrics(self, before: DataFrame, after: DataFrame) -> list[DataFrame]:
        rows = []
        if "PROCESSING_CODE" in before.columns:
            label = F.col("PROCESSING_TYPE_CLEANED")
            rows.append(("processing_code.unknown", F.count_if(~F.col("PROCESSING_CODE_CLEANED").isin(*PROCESSING_CODES)), True))
            if "PROCESSING_TYPE" in before.columns:
                rows.append(("processing_type.disagrees_with_code", F.count_if(label.isNotNull() & (text(F.col("PROCESSING_TYPE")) != label)), True))
        if "MCC_CODE" in before.columns:
            if self.config.get("mcc_reference") is not None:
                rows.append(("mcc.not_in_reference", F.count_if(F.col("MCC_CATEGORY") == ""), True))
            rows.append(("mcc.distinct", F.count_distinct("MCC_CODE_CLEANED"), True))
        return [measure(after, rows)]

"""Step 9, contradictions between fields: flags only, nothing repaired or dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridra.functions.text import lookup, number, text, true
from veridra.operators.base import Metric, Step, measure
from veridra.rules import REFUND, UNITS_PER_USD


class ConsistencyValidator(Step):
    name = "consistency"

    def flags(self, df: DataFrame) -> list[tuple[str, Column]]:
        """Each flag whose columns are there, in the order they are appended, with its predicate."""
        has, out = set(df.columns), []
        col = F.col
        for c in self.policy.required_columns:
            if c in has:
                out.append((f"REQUIRED_NULL[{c}]", col(c).isNull()))
        if {"TXN_DATE_TIME_CLEANED", "SETTLE_DATE_CLEANED"} <= has:
            out.append(("SETTLE_BEFORE_TXN", F.to_date("SETTLE_DATE_CLEANED") < F.to_date("TXN_DATE_TIME_CLEANED")))
        if {"TXN_AMOUNT_CLEANED", "FX_RATE", "BILLING_AMOUNT"} <= has:
            expected = F.abs("TXN_AMOUNT_CLEANED") * number(col("FX_RATE"))
            billed = F.abs(number(col("BILLING_AMOUNT")))
            out.append(("FX_RECONCILE_MISMATCH", F.when(expected > 0, F.abs(expected - billed) / expected > self.policy.reconcile_tolerance)))
        if {"TXN_CCY", "FX_RATE"} <= has:
            units = lookup(F.upper(text(col("TXN_CCY"))), {k: repr(float(v)) for k, v in UNITS_PER_USD.items()}).cast("double")
            stated, reference = number(col("FX_RATE")), 1.0 / units
            out.append(("FX_RATE_OFF_REFERENCE", F.when(stated > 0, F.abs(stated - reference) / reference > self.policy.reference_tolerance)))
        if {"PROCESSING_TYPE_CLEANED", "BILLING_AMOUNT"} <= has:
            refund, billed = true(col("PROCESSING_TYPE_CLEANED") == REFUND), number(col("BILLING_AMOUNT"))
            out += [("REFUND_NEGATIVE", refund & (billed < 0)), ("PURCHASE_POSITIVE", ~refund & (billed > 0))]
        if {"MERCHANT_COUNTRY_EXPECTED", "MERCHANT_COUNTRY"} <= has:
            expected = col("MERCHANT_COUNTRY_EXPECTED")
            out.append(("GEO_CITY_COUNTRY_MISMATCH", (expected != "") & (text(col("MERCHANT_COUNTRY")) != expected)))
        if {"PROCESSING_TYPE_CLEANED", "PROCESSING_TYPE"} <= has:
            out.append(("CODE_TYPE_MISMATCH", ~text(col("PROCESSING_TYPE")).eqNullSafe(col("PROCESSING_TYPE_CLEANED"))))
        return out

    def apply(self, df: DataFrame) -> DataFrame:
        old = F.nullif(F.col("VALIDATION_FLAGS"), F.lit("")) if "VALIDATION_FLAGS" in df.columns else F.lit(None).cast("string")
        return df.withColumn("VALIDATION_FLAGS", F.concat_ws(";", old, *(F.when(true(p), F.lit(name)) for name, p in self.flags(df))))

    def metrics(self, before: DataFrame, after: DataFrame) -> list[DataFrame]:
        seen = F.split("VALIDATION_FLAGS", ";")
        rows: list[Metric] = [(name, F.count_if(F.array_contains(seen, name)), True) for name, _ in self.flags(before)]
        return [measure(after, [*rows, ("rows_with_any_flag", F.count_if(F.col("VALIDATION_FLAGS") != ""), True)])]

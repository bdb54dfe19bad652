"""Step 5, absent values told apart: terminals, authorisation codes, settlement dates, blanks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veridra.functions.text import text, true
from veridra.operators.base import Step, measure

ZEROS = r"^0+$"
BLANK_COLUMNS = ("MERCHANT_CITY", "MERCHANT_COUNTRY")


def auth_repeats(df: DataFrame, threshold: int) -> DataFrame:
    """The codes (column _code) that come `threshold` times or more, from pre-aggregated counts."""
    codes = df.groupBy(text(F.col("AUTH_CODE")).alias("_code")).agg(F.count("*").alias("_n"))
    return codes.where((F.col("_n") >= threshold) & (F.col("_code") != "")).select("_code")


class MissingValueHandler(Step):
    name = "missing"

    def apply(self, df: DataFrame) -> DataFrame:
        if "TERMINAL_ID" in df.columns:
            df = df.withColumn("HAS_TERMINAL", ~text(F.col("TERMINAL_ID")).rlike(ZEROS))
        if "AUTH_CODE" in df.columns:
            code = text(F.col("AUTH_CODE"))
            # counts first, then a join on codes that repeat: the all-zero filler would make one window partition of a third of the rows
            again = auth_repeats(df, self.policy.auth_repeat_threshold).where(~F.col("_code").rlike(ZEROS)).withColumn("_again", F.lit(True))
            df = df.withColumn("_auth", F.when((code != "") & ~code.rlike(ZEROS), code))
            df = df.join(again, F.col("_auth") == F.col("_code"), "left")
            df = df.withColumn("AUTH_CODE_VALID", F.col("_auth").isNotNull() & F.col("_again").isNull()).drop("_auth", "_code", "_again")
        if "SETTLE_DATE_CLEANED" in df.columns:
            settle = F.col("SETTLE_DATE_CLEANED")
            late = F.to_date(settle) < F.to_date("TXN_DATE_TIME_CLEANED") if "TXN_DATE_TIME_CLEANED" in df.columns else F.lit(False)
            df = df.withColumn("SETTLE_DATE_STATUS", F.when(settle.isNull(), "UNKNOWN").when(true(late), "ANOMALOUS").otherwise("OBSERVED"))
        return df

    def metrics(self, before: DataFrame, after: DataFrame) -> list[DataFrame]:
        rows, out = [], []
        if "TERMINAL_ID" in before.columns:
            rows.append(("terminal_id.sentinel_rows", F.count_if(~F.col("HAS_TERMINAL")), True))
        if "AUTH_CODE" in before.columns:
            rows.append(("auth_code.invalid_rows", F.count_if(~F.col("AUTH_CODE_VALID")), True))
            repeated = auth_repeats(before, self.policy.auth_repeat_threshold).agg(F.count("*").alias("value"))
            out.append(repeated.select(F.lit(2).alias("at"), F.lit("auth_code.repeated_values").alias("metric"), "value"))
        if "SETTLE_DATE_STATUS" in after.columns:
            rows += [(f"settle_date.{x.lower()}", F.count_if(F.col("SETTLE_DATE_STATUS") == x), True) for x in ("ANOMALOUS", "UNKNOWN")]
        rows += [(f"{c.lower()}.blank", F.count_if(text(F.col(c)) == ""), False) for c in BLANK_COLUMNS if c in before.columns]
        return [measure(after, rows), *out]


def repeated_by_window(df: DataFrame, key: str) -> DataFrame:
    """df with n, the rows that share the key: for keys known to be spread out."""
    return df.withColumn("n", F.count("*").over(Window.partitionBy(key)))

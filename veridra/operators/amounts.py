"""Step 4, amounts in mixed conventions, and the sign that the processing type implies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridra.functions.text import let, number, text, true
from veridra.operators.base import Step, measure
from veridra.rules import REFUND, ZERO_DECIMAL

SIGN_FLAG = "AMOUNT_SIGN_RESTORED"


def _magnitude(t: Column, zero_decimal: Column) -> Column:
    """Text with marks to a double: of both marks the last is the decimal one; one met twice only groups digits."""
    comma, dot = F.instr(F.reverse(t), ","), F.instr(F.reverse(t), ".")
    pieces = F.split(t, "[.,]")
    grouped = (F.size(pieces) > 2) | (zero_decimal & (F.length(F.get(pieces, 1)) == 3))
    plain = (
        F.when((comma > 0) & (dot > 0) & (dot < comma), F.regexp_replace(t, ",", ""))
        .when((comma > 0) & (dot > 0), F.translate(F.regexp_replace(t, r"\.", ""), ",", "."))
        .when(((comma > 0) | (dot > 0)) & grouped, F.regexp_replace(t, "[.,]", ""))
        .otherwise(F.translate(t, ",", "."))
    )
    return let(plain, lambda x: F.when(x.rlike(r"^-?(\d+\.?\d*|\.\d+)$"), x.try_cast("double")))


def parse(v: Column, currency: Column) -> Column:
    """The amount that text states, null if none. Letters vanish first; brackets around it, or a minus in front, negate."""
    zero = true(F.upper(text(currency)).isin(*ZERO_DECIMAL))

    def signed(t: Column) -> Column:
        bracket = t.startswith("(") & t.endswith(")")

        def bare(u: Column) -> Column:
            minus = u.startswith("-")
            size = _magnitude(F.when(minus, F.substr(u, F.lit(2))).otherwise(u), zero)
            return F.when(bracket | minus, -size).otherwise(size)

        return let(F.regexp_replace(t, r"^[()]+|[()]+$", ""), bare)

    return let(F.regexp_replace(text(v), r"[^0-9.,()\-]", ""), signed)


def with_flag(df: DataFrame, flag: str, where: Column) -> DataFrame:
    """df with the flag put behind those a row has already."""
    old = F.nullif(F.col("VALIDATION_FLAGS"), F.lit("")) if "VALIDATION_FLAGS" in df.columns else F.lit(None).cast("string")
    return df.withColumn("VALIDATION_FLAGS", F.concat_ws(";", old, F.when(true(where), F.lit(flag))))


class AmountNormalizer(Step):
    """A column named by config numeric_marker (boolean) tells cells that were numbers, not text, in the source."""

    name = "amounts"

    def apply(self, df: DataFrame) -> DataFrame:
        if "TXN_AMOUNT" not in df.columns:
            return df
        currency = F.col("TXN_CCY") if "TXN_CCY" in df.columns else F.lit("")
        value = parse(F.col("TXN_AMOUNT"), currency)
        marker = self.config.get("numeric_marker", "_is_numeric")
        if marker in df.columns:
            value = F.when(F.col(marker), number(F.col("TXN_AMOUNT"))).otherwise(value)
        df = df.withColumn("TXN_AMOUNT_CLEANED", value)
        if "PROCESSING_TYPE_CLEANED" in df.columns:
            df = df.withColumn("_before", F.col("TXN_AMOUNT_CLEANED"))
            right = F.when(true(F.col("PROCESSING_TYPE_CLEANED") == REFUND), F.abs("_before")).otherwise(-F.abs("_before"))
            df = df.withColumn("TXN_AMOUNT_CLEANED", right + F.lit(0.0))
            df = with_flag(df, SIGN_FLAG, F.col("TXN_AMOUNT_CLEANED") != F.col("_before")).drop("_before")
        return df

    def metrics(self, before: DataFrame, after: DataFrame) -> list[DataFrame]:
        if "TXN_AMOUNT" not in before.columns:
            return []
        raw, lost = F.col("TXN_AMOUNT"), F.col("TXN_AMOUNT_CLEANED").isNull()
        failed = lost & (text(raw) != "")
        odd = number(raw).isNull() & (text(raw) != "")
        rows = [("TXN_AMOUNT.unparseable", F.count_if(failed), True), ("TXN_AMOUNT.reformatted", F.count_if(odd) - F.count_if(failed), True)]
        if "PROCESSING_TYPE_CLEANED" in after.columns:
            rows.append(("TXN_AMOUNT_CLEANED.sign_restored", F.count_if(F.array_contains(F.split("VALIDATION_FLAGS", ";"), SIGN_FLAG)), True))
        return [measure(after, rows)]

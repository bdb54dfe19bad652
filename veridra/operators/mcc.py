"""Step 8, merchant category codes: a decision for each merchant from the histogram of its codes, then row rules."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridra.functions.text import lookup, text, true
from veridra.operators.amounts import with_flag
from veridra.operators.base import Step, counted, measure, row_order
from veridra.rules import BINOMIAL_HIGH, BINOMIAL_MEDIUM, CATCH_ALL, DETERMINISTIC, MASTER, SUSPECT_CODES

TIERS = ("HIGH", "MEDIUM", "PENDING")
HALF_LOG_TAU = 0.5 * math.log(2 * math.pi)


def log_factorial(n: Column) -> Column:
    """log n! by Stirling's series, shifted by eight so that small numbers are exact to 1e-13."""
    x = n.cast("double") + 1.0
    y = x + 8.0
    series = (y - 0.5) * F.log(y) - y + HALF_LOG_TAU + 1.0 / (12.0 * y) - 1.0 / (360.0 * F.pow(y, F.lit(3.0))) + 1.0 / (1260.0 * F.pow(y, F.lit(5.0)))
    shift = x
    for k in range(1, 8):
        shift = shift * (x + float(k))
    return series - F.log(shift)


def binomial_tail(n: Column, k: Column, hits: Column) -> Column:
    """Chance of `hits` or more of n at odds 1/k each. Terms beyond 12 deviations add nothing, so the sum stays short."""
    p = 1.0 / k.cast("double")
    first = log_factorial(n) - log_factorial(hits) - log_factorial(n - hits) + hits * F.log(p) + (n - hits) * F.log1p(-p)
    last = F.least(n, hits + (6.0 * F.sqrt(n.cast("double"))).cast("long") + 40)
    steps = F.sequence(hits, last)
    ratio = p / (1.0 - p)
    zero = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum"))
    total = F.aggregate(steps, zero, lambda acc, i: F.struct((acc["term"] * (n - i) / (i + 1) * ratio).alias("term"), (acc["sum"] + acc["term"]).alias("sum")), lambda acc: acc["sum"])
    return F.when(k > 1, F.least(F.exp(first) * total, F.lit(1.0))).otherwise(F.lit(1.0))


def histogram(df: DataFrame) -> DataFrame:
    """merchant, code, n and first (ingest order of the first row) for each merchant's codes."""
    rows = df.select(F.col("MERCHANT_NAME_CLEANED").alias("merchant"), F.col("MCC_CODE_CLEANED").alias("code"), row_order(df).alias("ix"))
    return rows.where(F.coalesce("merchant", F.lit("")) != "").groupBy("merchant", "code").agg(F.count("*").alias("n"), F.min("ix").alias("first"))


def decisions(counts: DataFrame, master: dict[str, dict] | None = None) -> DataFrame:
    """merchant, mcc, confidence, signal, p_value, rows and observed for each merchant of a histogram."""
    curated = {m: e["mcc"] for m, e in (MASTER if master is None else master).items() if "mcc" in e}
    one = F.struct((-F.col("n")).alias("neg"), "first", "code", "n")
    by = counts.groupBy("merchant").agg(F.array_sort(F.collect_list(one)).alias("codes"), F.sum("n").alias("rows"))  # as many entries as codes exist
    top, second = F.get("codes", 0), F.get("codes", 1)
    specific = F.filter("codes", lambda x: x["code"] != CATCH_ALL)
    by = by.withColumns({
        "top": top["code"], "top_n": top["n"], "second_n": F.coalesce(second["n"], F.lit(0)), "k": F.size("codes"),
        "best": F.get(specific, 0)["code"], "best_n": F.get(specific, 0)["n"],
        "catch_n": F.coalesce(F.get(F.filter("codes", lambda x: x["code"] == CATCH_ALL), 0)["n"], F.lit(0)),
        "observed": F.array_join(F.transform("codes", lambda x: F.concat(x["code"], F.lit(": "), x["n"].cast("string"))), ", "),
        "asserted": lookup(F.col("merchant"), curated),
    })
    by = by.withColumn("clear", F.filter("codes", lambda x: (x["n"] == F.col("top_n")) & ~x["code"].isin(*SUSPECT_CODES)))
    conflict = F.col("asserted").isNull() & (F.col("k") > 1)
    by = by.withColumn("p_value", F.when(conflict, binomial_tail(F.col("rows"), F.col("k"), F.col("top_n"))))
    tie = F.col("top_n") == F.col("second_n")
    by = by.withColumn(
        "signal",
        F.when(F.col("asserted").isNotNull(), "curated").when(F.col("k") == 1, "consistent")
        .when(F.col("best").isNotNull() & (F.col("catch_n") >= F.col("best_n")), "catch_all_override")
        .when(tie & (F.size("clear") == 1), "suspect_tiebreak").when(tie, "unresolved_tie")
        .when(F.col("p_value") <= BINOMIAL_MEDIUM, "majority").otherwise("weak_majority"),
    )
    signal = F.col("signal")
    mcc = F.when(signal == "curated", F.col("asserted")).when(signal == "catch_all_override", F.col("best")).when(signal == "suspect_tiebreak", F.get("clear", 0)["code"]).when(signal == "majority", F.col("top"))
    high = signal.isin("curated", "consistent") | ((signal == "majority") & (F.col("p_value") <= BINOMIAL_HIGH))
    confidence = F.when(high, "HIGH").when(signal.isin("unresolved_tie", "weak_majority"), "PENDING").otherwise("MEDIUM")
    return by.select("merchant", mcc.alias("mcc"), confidence.alias("confidence"), signal, "p_value", "rows", "observed")


def suggested(df: DataFrame, decided: DataFrame) -> DataFrame:
    """df with MCC_CODE_SUGGESTED, MCC_CONFIDENCE and _MCC_SIGNAL; the decisions are joined on the merchant."""
    small = decided.select("merchant", "mcc", "confidence", "signal")
    out = df.join(small, F.col("MERCHANT_NAME_CLEANED") == F.col("merchant"), "left")
    new = true(F.col("mcc") != F.col("MCC_CODE_CLEANED")) | (F.col("mcc").isNotNull() & F.col("MCC_CODE_CLEANED").isNull())
    out = out.withColumn("MCC_CODE_SUGGESTED", F.when(new, F.col("mcc")).otherwise(""))
    return out.withColumn("MCC_CONFIDENCE", F.col("confidence")).withColumn("_MCC_SIGNAL", F.coalesce("signal", F.lit(""))).drop("merchant", "mcc", "confidence", "signal")


def row_rules(df: DataFrame) -> DataFrame:
    """df after the rules by which another column fixes the code; they override the merchant's decision."""
    for column, value, code, flag in DETERMINISTIC:
        if column not in df.columns:
            continue
        df = df.withColumn("_wrong", (text(F.col(column)) == value) & ~F.col("MCC_CODE_CLEANED").eqNullSafe(F.lit(code)))
        for target, new in (("MCC_CODE_SUGGESTED", code), ("MCC_CONFIDENCE", "HIGH"), ("_MCC_SIGNAL", "deterministic")):
            df = df.withColumn(target, F.when(F.col("_wrong"), F.lit(new)).otherwise(F.col(target)))
        df = with_flag(df, flag, F.col("_wrong")).drop("_wrong")
    return df


class MccResolver(Step):
    """config master is the merchant master; config keep_signal leaves _MCC_SIGNAL in."""

    name = "mcc"

    def apply(self, df: DataFrame) -> DataFrame:
        out = self.scored(df)
        if out is df:
            return df
        new = F.col("MCC_CODE_SUGGESTED") != ""
        return out.withColumn("MCC_CODE_CLEANED", F.when(new, F.col("MCC_CODE_SUGGESTED")).otherwise(F.col("MCC_CODE_CLEANED"))).drop("_MCC_SIGNAL")

    def scored(self, df: DataFrame) -> DataFrame:
        """df with the suggestion and its signal, before the suggestion is adopted."""
        if not {"MCC_CODE_CLEANED", "MERCHANT_NAME_CLEANED"} <= set(df.columns):
            return df
        return row_rules(suggested(df, decisions(histogram(df), self.config.get("master"))))

    def metrics(self, before: DataFrame, after: DataFrame) -> list[DataFrame]:
        if "MCC_CONFIDENCE" not in after.columns:
            return []
        scored, new = self.scored(before), F.count_if(F.col("MCC_CODE_SUGGESTED") != "")
        rows = [(f"{flag}", F.count_if(F.array_contains(F.split("VALIDATION_FLAGS", ";"), flag)), True) for column, _, _, flag in DETERMINISTIC if column in before.columns]
        rows += [(f"confidence[{x}]", F.count_if(F.col("MCC_CONFIDENCE") == x), False) for x in TIERS]
        return [measure(after, rows), counted(scored, "signal", "_MCC_SIGNAL"), measure(after, [("rows_with_suggestion", new, True), ("mcc_code.reassigned", new, True)])]

    def review(self, before: DataFrame) -> DataFrame:
        """One row for each merchant that is still undecided; before is the step's input."""
        pending = decisions(histogram(before), self.config.get("master")).where("confidence = 'PENDING'")
        p = F.round("p_value", 4)
        return pending.select(
            F.col("merchant").alias("MERCHANT_NAME_CLEANED"), F.col("observed").alias("MCC_OBSERVED"), F.coalesce("mcc", F.lit("")).alias("MCC_CODE_SUGGESTED"),
            F.col("confidence").alias("MCC_CONFIDENCE"), F.when(F.col("p_value") != 0, p).alias("BINOMIAL_P"), F.col("signal").alias("SIGNAL"), F.col("rows").alias("ROW_COUNT"),
        ).orderBy("MCC_CONFIDENCE", F.desc("ROW_COUNT"), "MERCHANT_NAME_CLEANED")

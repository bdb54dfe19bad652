"""Step 6, merchant names: prefixes, references and noise off, aliases resolved against a master."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridra.functions.text import fold, strip
from veridra.operators.base import Step, measure
from veridra.rules import MASTER, PROCESSORS, alias_table

# Patterns of what is not part of a name, in the order they are taken off.
AFFIXES = (
    r"(?U)^(?:ECOM\s*/|POS\b\s*|POS(?=[A-Z]))",
    r"(?U)^TRM\s*:\s*\d+\s*",
    r"(?U)\s*/\s*REF\s*\d+\s*$",
    r"(?U)\s*-\s*CARD\s*PMT\s*-\s*$",
)
NOISE = (
    r"(?U)\*\s*[A-Z0-9]{2,6}\s*$",
    r"(?U)\s/[A-Z]{2,4}\b",
    r"(?U)\.(COM|NET|ORG|CO|IO|AI|ME|SA|AE|LB|FR|DE|EG)\b",
    r"[^A-Z0-9&' ]",
    r"\b(BR|BRANCH|STORE|SHOP)\s*#?\d+\b",
    r"\b(INC|LLC|LTD|LIMITED|SAL|SARL|PLC|GMBH|AG|AB|BV|NV|CO)\b",
)
UNKNOWN_PROCESSOR = "Unknown"


def cleaned(df: DataFrame, source: str, name: str = "_name", prefix: str = "_prefix") -> DataFrame:
    """df with the cleaned name and the processor prefix (empty: none) of a raw merchant column."""
    out = df.withColumn("_m", fold(F.coalesce(F.col(source).cast("string"), F.lit(""))))
    star = F.instr("_m", "*")
    left = F.when(star > 0, F.substring_index("_m", "*", 1)).otherwise(F.col("_m"))
    out = out.withColumn("_left", left).withColumn("_right", F.when(star > 0, F.substr("_m", star + 1)).otherwise(""))
    out = out.withColumn("_key", strip(F.regexp_replace(strip(F.col("_left")), r"\.[A-Z]{2,10}$", "")))
    gate = F.col("_key").isin(*PROCESSORS) & (strip(F.col("_right")) != "")
    out = out.withColumn(prefix, F.when(gate, F.col("_key")).otherwise("")).withColumn("_m", F.when(gate, F.col("_right")).otherwise(F.col("_left")))
    body: Column = F.col("_m")
    for pattern in AFFIXES:
        body = F.regexp_replace(strip(body), pattern, "")
    for pattern in NOISE:
        body = F.regexp_replace(body, pattern, " ")
    out = out.withColumn("_m", body)
    out = out.withColumn("_tokens", F.filter(F.split("_m", r"\s+"), lambda t: t != ""))
    out = out.withColumn(
        "_tokens_kept",
        F.filter("_tokens", lambda t, i: ~((t.rlike(r"^[A-Z\d]+$") & t.rlike("[A-Z]") & t.rlike(r"\d")) | (t.rlike(r"^\d+$") & (i > 0)))),
    )
    enough = F.exists("_tokens_kept", lambda t: ~t.rlike(r"^\d+$"))
    body = F.array_join(F.when(enough, F.col("_tokens_kept")).otherwise(F.col("_tokens")), " ")
    out = out.withColumn(name, F.trim(F.regexp_replace(body, r"\s+BR$", "")))
    return out.drop("_m", "_left", "_right", "_key", "_tokens", "_tokens_kept")


class MerchantCleaner(Step):
    """config input_col names the raw column; config master is the merchant master (canonical name to entry)."""

    name = "merchant"

    def apply(self, df: DataFrame) -> DataFrame:
        source = self.config.get("input_col", "MERCHANT_NAME")
        if source not in df.columns:
            return df
        table = alias_table(self.config.get("master", MASTER))
        known = df.sparkSession.createDataFrame(sorted(table.items()) or [("", "")], "_alias string, _canonical string")
        out = cleaned(df, source).join(F.broadcast(known), F.col("_name") == F.col("_alias"), "left")  # no larger than the master on the driver
        found = F.col("_alias").isNotNull() & (F.col("_name") != "")
        out = out.withColumn("MERCHANT_PROCESSOR", F.coalesce(F.nullif("_prefix", F.lit("")), F.lit(UNKNOWN_PROCESSOR)))
        out = out.withColumn("MERCHANT_NAME_CLEANED", F.coalesce("_canonical", "_name"))
        out = out.withColumn("MERCHANT_RECOGNISED", found).withColumn("MATCHES_STATUS_CLEANED", F.when(found, "Confirmed").otherwise("Pending"))
        return out.drop("_name", "_prefix", "_alias", "_canonical")

    def metrics(self, before: DataFrame, after: DataFrame) -> list[DataFrame]:
        if "MERCHANT_RECOGNISED" not in after.columns:
            return []
        name, new = F.col("MERCHANT_NAME_CLEANED"), ~F.col("MERCHANT_RECOGNISED")
        rows = [
            ("matches_status.pending", F.count_if(F.col("MATCHES_STATUS_CLEANED") == "Pending"), True),
            ("merchants_distinct", F.count_distinct(name), True),
            ("merchant.unrecognised_rows", F.count_if(new), True),
            ("merchant.unrecognised_names", F.count_distinct(F.when(new, name)), True),
            ("processor_prefix_stripped", F.count_if(F.col("MERCHANT_PROCESSOR") != UNKNOWN_PROCESSOR), True),
            ("empty_after_clean", F.count_if(name == ""), True),
        ]
        return [measure(after, rows)]

    def review(self, after: DataFrame) -> DataFrame:
        """One row for each name that isn't in the master, with the evidence; the commonest first."""
        source = self.config.get("input_col", "MERCHANT_NAME")
        rows = after.where(~F.col("MERCHANT_RECOGNISED") & (F.col("MERCHANT_NAME_CLEANED") != ""))
        joined = lambda c: F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), "; ")
        country = joined("MERCHANT_COUNTRY") if "MERCHANT_COUNTRY" in after.columns else F.lit("")
        out = rows.groupBy("MERCHANT_NAME_CLEANED").agg(F.count("*").alias("ROW_COUNT"), joined(source).alias("RAW_SPELLINGS"), country.alias("COUNTRIES"))
        if "MCC_CODE_CLEANED" in after.columns:
            seen = rows.groupBy("MERCHANT_NAME_CLEANED", "MCC_CODE_CLEANED").agg(F.count("*").alias("n"))
            text_of = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col("MCC_CODE_CLEANED").alias("c")))), lambda x: F.concat(x["c"], F.lit(": "), (-x["n"]).cast("string")))
            out = out.join(seen.groupBy("MERCHANT_NAME_CLEANED").agg(F.array_join(text_of, ", ").alias("MCC_OBSERVED")), "MERCHANT_NAME_CLEANED")
        return out.orderBy(F.desc("ROW_COUNT"), "MERCHANT_NAME_CLEANED")


def trap_violations(df: DataFrame, traps, key: str = "MERCHANT_NAME_CLEANED", raw: str = "MERCHANT_NAME") -> DataFrame:
    """id, members_seen and merged for each group of names that must stay apart: merged if one name took another's rows."""
    rows = [(group, member) for group, members in traps for member in members]
    names = df.sparkSession.createDataFrame(rows, "id string, member string")
    own = cleaned(df.select(key, raw), raw).select(F.col("_name").alias("member"), F.col(key).alias("became")).distinct()
    joined = names.join(own, "member", "left")
    return joined.groupBy("id").agg(F.count_distinct(F.when(F.col("became").isNotNull(), F.col("member"))).alias("members_seen"), F.bool_or(F.coalesce(F.col("became") != F.col("member"), F.lit(False))).alias("merged"))



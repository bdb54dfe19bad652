"""Step 10, timestamps of the forecast source: six spellings, of which NN/NN/YYYY is settled in passes.

Fields above twelve force a reading. What stays open is compared with the months in which rows already placed state
the same macro figure, then bracketed between the placed rows before and after it in its account; the rest is read
month first and flagged where the readings differ. Only rows of that spelling serve as evidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridra.functions.text import month_number, part, stamp, text, true, two_digit_year
from veridra.operators.base import Step, measure
from veridra.rules import STAMP_FORMATS, STAMP_NULLS, ZONE

PRECISIONS, SOURCES = ("SECOND", "MINUTE", "DAY"), ("AS_WRITTEN", "OFFSET_APPLIED")
STATUSES = ("OBSERVED", "TIME_UNKNOWN", "DATE_AMBIGUOUS", "UNKNOWN")
ORACLES = (("INTEREST_RATE_INDEX", ()), ("INFLATION_INDEX", ("MERCHANT_COUNTRY",)))
SETTLE = (("iso_date", r"^\d{4}-\d{2}-\d{2}$"), ("day_month_abbrev", r"^\d{2}-[A-Za-z]{3}-\d{2}$"), ("slash_date", r"^\d{2}/\d{2}/\d{4}$"))


def _first_match(v: Column, formats) -> Column:
    out = F.when(v.isin(*STAMP_NULLS), F.lit(None).cast("string"))
    for name, pattern, *_ in formats:
        out = out.when(v.rlike(pattern), F.lit(name))
    return out


def _seconds(v: Column) -> Column:
    return F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(secs=v.try_cast("long").cast("decimal(18,6)"))


def _plain(v: Column, name: Column) -> Column:
    """The time of every spelling but the ambiguous one."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(ZONE), _seconds(v))
    day = F.regexp_extract(v, r" (\d{1,2}),", 1).try_cast("int")
    return (
        F.when(name == "epoch_seconds", local)
        .when(name == "iso_second", stamp(part(v, 1, 4), part(v, 6, 2), part(v, 9, 2), part(v, 12, 2), part(v, 15, 2), part(v, 18, 2)))
        .when(name == "iso_slash_minute", stamp(part(v, 1, 4), part(v, 6, 2), part(v, 9, 2), part(v, 12, 2), part(v, 15, 2)))
        .when(name == "day_month_abbrev_minute", stamp(two_digit_year(part(v, 8, 2)), month_number(F.substring(v, 4, 3)), part(v, 1, 2), part(v, 11, 2), part(v, 14, 2)))
        .when(name == "month_day_year", stamp(F.substring(v, -4, 4).try_cast("int"), month_number(F.substring(v, 1, 3)), day))
    )


def read(df: DataFrame, source: str = "TXN_DATE_TIME") -> DataFrame:
    """df with _raw, _spelling, _time (null for the ambiguous spelling), _mf and _df (its two readings)."""
    out = df.withColumn("_raw", text(F.col(source))).withColumn("_spelling", _first_match(F.col("_raw"), STAMP_FORMATS))
    v, slash = F.col("_raw"), F.col("_spelling") == "slash_minute"
    out = out.withColumn("_time", _plain(v, F.col("_spelling")))
    clock = (part(v, 12, 2), part(v, 15, 2))
    month_first = F.when(slash, stamp(part(v, 7, 4), part(v, 1, 2), part(v, 4, 2), *clock))
    day_first = F.when(slash, stamp(part(v, 7, 4), part(v, 4, 2), part(v, 1, 2), *clock))
    return out.withColumn("_mf", month_first).withColumn("_df", day_first)


def forced(df: DataFrame) -> DataFrame:
    """df with _out (the reading that fields above twelve force) and _how (what settled it)."""
    v, slash = F.col("_raw"), F.col("_spelling") == "slash_minute"
    day = true(slash & (part(v, 1, 2) > 12) & F.col("_df").isNotNull())
    month = true(slash & (part(v, 4, 2) > 12) & F.col("_mf").isNotNull())
    out = df.withColumn("_out", F.when(day, F.col("_df")).when(month, F.col("_mf")))
    return out.withColumn("_how", F.when(day, "forced_day_first").when(month, "forced_month_first"))


def by_macros(df: DataFrame, oracles) -> DataFrame:
    """df with open rows settled whose figure was placed in the month of exactly one of the two readings.

    What settles a row is its figures and the months of its readings, so the oracles take turns (a later one also sees
    what the earlier ones settled) on the different combinations of those; df is read for them once and joined once,
    however many oracles there are. The combinations are a few hundred months wide at most for each figure."""
    slash, month = F.col("_spelling") == "slash_minute", lambda c: F.date_format(c, "yyyy-MM")
    keys = [f"_key{k}" for k in range(len(oracles))]
    same = [*keys, "_month_mf", "_month_df"]
    df = df.withColumns({key: F.concat_ws("|", text(F.col(column)), *(text(F.col(c)) for c in context)) for key, (column, context) in zip(keys, oracles)})
    df = df.withColumns({"_month_mf": month("_mf"), "_month_df": month("_df")})
    seen = df.where(slash).select(*same, month("_out").alias("_placed")).distinct()
    seen = seen.withColumn("_open", F.col("_placed").isNull()).withColumn("_by", F.lit(None).cast("string"))
    for key, (column, _) in zip(keys, oracles):
        seen = seen.withColumn("_months", F.collect_set("_placed").over(Window.partitionBy(key)))
        fits = [true(F.array_contains("_months", F.col(c))) for c in ("_month_mf", "_month_df")]
        hit = F.col("_placed").isNull() & (fits[0] != fits[1])
        seen = seen.withColumn("_hit", hit).withColumn("_placed", F.when(F.col("_hit"), F.when(fits[0], F.col("_month_mf")).otherwise(F.col("_month_df"))).otherwise(F.col("_placed")))
        seen = seen.withColumn("_by", F.when(F.col("_hit"), F.lit(f"macro[{column}]")).otherwise(F.col("_by"))).drop("_months", "_hit")
    settled = seen.where("_open and _by is not null").select(*same, "_by", (F.col("_placed") == F.col("_month_mf")).alias("_first"))
    out = df.join(settled, same, "left")
    hit = F.col("_by").isNotNull() & slash & F.col("_out").isNull()
    out = out.withColumn("_hit", hit).withColumn("_out", F.when(F.col("_hit"), F.when(F.col("_first"), F.col("_mf")).otherwise(F.col("_df"))).otherwise(F.col("_out")))
    return out.withColumn("_how", F.when(F.col("_hit"), F.col("_by")).otherwise(F.col("_how"))).drop(*same, "_by", "_first", "_hit")


def by_sequence(df: DataFrame, group: str, order: str) -> DataFrame:
    """df with open rows settled by the only reading between the placed rows next before and after in their group. Rows
    without a group have no neighbours; they are spread, as they would meet in one task.

    A frame from the row to the end of its group would be worked out anew for each row. So a run is the rows up to and
    with a placed one, numbered by the placed rows before; the row that ends a run is next for all of it."""
    apart = F.when(F.col(group).isNull(), F.xxhash64(F.col(order)))
    own = Window.partitionBy(group, "_apart").orderBy(F.col(order).try_cast("long"))
    low = F.last("_out", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0))
    run = F.count("_out").over(own.rowsBetween(Window.unboundedPreceding, -1))
    out = df.withColumn("_apart", apart).withColumns({"_low": low, "_run": run})
    out = out.withColumn("_high", F.max("_out").over(Window.partitionBy(group, "_apart", "_run")))
    open_row = (F.col("_spelling") == "slash_minute") & F.col("_out").isNull() & F.col(group).isNotNull()
    month, day = (true(F.col(c).between(F.col("_low"), F.col("_high"))) for c in ("_mf", "_df"))
    out = out.withColumn("_pick", F.when(true(open_row) & month & ~day, "bracket_month_first").when(true(open_row) & day & ~month, "bracket_day_first"))
    pick = F.col("_pick")
    out = out.withColumn("_out", F.when(pick == "bracket_month_first", F.col("_mf")).when(pick == "bracket_day_first", F.col("_df")).otherwise(F.col("_out")))
    return out.withColumn("_how", F.coalesce("_pick", "_how")).drop("_apart", "_run", "_low", "_high", "_pick")


def offset_label(t: Column) -> Column:
    """The source clock's offset on a wall-clock reading, as UTC+N; empty for null."""
    utc = F.convert_timezone(F.lit(ZONE), F.lit("UTC"), t)
    hours = F.floor(F.timestamp_diff("SECOND", utc, t) / 3600).cast("int")
    return F.coalesce(F.concat(F.lit("UTC"), F.when(hours >= 0, "+").otherwise("-"), F.abs(hours).cast("string")), F.lit(""))


def settle_date(v: Column) -> Column:
    name = _first_match(v, SETTLE)
    month_first, day_first = stamp(part(v, 7, 4), part(v, 1, 2), part(v, 4, 2)), stamp(part(v, 7, 4), part(v, 4, 2), part(v, 1, 2))
    return (
        F.when(name == "iso_date", stamp(part(v, 1, 4), part(v, 6, 2), part(v, 9, 2)))
        .when(name == "day_month_abbrev", stamp(two_digit_year(part(v, 8, 2)), month_number(F.substring(v, 4, 3)), part(v, 1, 2)))
        .when(name == "slash_date", F.when((part(v, 1, 2) > 12) & day_first.isNotNull(), day_first).otherwise(month_first))
    )


class TimestampNormalizer(Step):
    """config: input_col, group_col, sequence_col, macro_oracles, and keep_how, which leaves _how and _spelling in."""

    name = "timestamps"

    def apply(self, df: DataFrame) -> DataFrame:
        out = self.resolved(df)
        return out if out is df or self.config.get("keep_how") else out.drop("_how", "_spelling")

    def resolved(self, df: DataFrame) -> DataFrame:
        source = self.config.get("input_col", "TXN_DATE_TIME")
        if source not in df.columns:
            return df
        out = forced(read(df, source))
        oracles = [(column, tuple(context)) for column, context in self.config.get("macro_oracles", ORACLES) if {column, *context} <= set(df.columns)]
        if oracles:
            out = by_macros(out, oracles)
        group, order = self.config.get("group_col", "ACCOUNT_ID"), self.config.get("sequence_col", "TXN_SEQ")
        if {group, order} <= set(df.columns):
            out = by_sequence(out, group, order)
        name, slash = F.col("_spelling"), F.col("_spelling") == "slash_minute"
        open_row = true(slash & F.col("_out").isNull())
        out = out.withColumn("TXN_TS_AMBIGUOUS", open_row & ~true(F.col("_mf") == F.col("_df")))
        out = out.withColumn("TXN_TS", F.when(slash, F.coalesce("_out", "_mf")).otherwise(F.col("_time")))
        midnight = F.date_format("_time", "HH:mm:ss") == "00:00:00"
        precision = F.when((name == "epoch_seconds") & midnight, "DAY")
        for known, _, kind in STAMP_FORMATS:
            precision = precision.when(name == known, kind)
        out = out.withColumn("TXN_TS_UTC_OFFSET", offset_label(F.col("TXN_TS"))).withColumn("TXN_TS_PRECISION", precision)
        out = out.withColumn("TXN_TS_SOURCE", F.when(true(name == "epoch_seconds"), "OFFSET_APPLIED").otherwise("AS_WRITTEN"))
        status = F.when(F.col("TXN_TS").isNull(), "UNKNOWN").when(F.col("TXN_TS_AMBIGUOUS"), "DATE_AMBIGUOUS").when(true(F.col("TXN_TS_PRECISION") == "DAY"), "TIME_UNKNOWN")
        out = out.withColumn("TXN_TS_STATUS", status.otherwise("OBSERVED"))
        if "SETTLE_DATE" in df.columns:
            out = out.withColumn("_settle", text(F.col("SETTLE_DATE"))).withColumn("SETTLE_DATE_CLEANED", settle_date(F.col("_settle"))).drop("_settle")
        return out.drop("_raw", "_time", "_mf", "_df", "_out")

    def metrics(self, before: DataFrame, after: DataFrame) -> list[DataFrame]:
        source = self.config.get("input_col", "TXN_DATE_TIME")
        if source not in before.columns:
            return []
        rows = self.resolved(before)
        how, out = F.col("_how"), []
        out += [("txn_ts.slash_forced_month_first", F.count_if(how == "forced_month_first"), True), ("txn_ts.slash_forced_day_first", F.count_if(how == "forced_day_first"), True)]
        out += [(f"txn_ts.slash_resolved_by[{c}]", F.count_if(how == f"macro[{c}]"), True) for c, extra in self.config.get("macro_oracles", ORACLES) if {c, *extra} <= set(before.columns)]
        if {self.config.get("group_col", "ACCOUNT_ID"), self.config.get("sequence_col", "TXN_SEQ")} <= set(before.columns):
            out += [(f"txn_ts.slash_{x}", F.count_if(how == x), True) for x in ("bracket_month_first", "bracket_day_first")]
        unknown = F.col("_spelling").isNull() & ~text(F.col(source)).isin(*STAMP_NULLS)
        out.append(("txn_ts.unrecognised_format", F.count_if(unknown), True))
        out += [(f"txn_ts.status[{x}]", F.count_if(F.col("TXN_TS_STATUS") == x), True) for x in STATUSES]
        out += [("txn_ts.unparseable", F.count_if(F.col("TXN_TS").isNull()), True), ("txn_ts.offset_applied", F.count_if(F.col("TXN_TS_SOURCE") == "OFFSET_APPLIED"), True), ("txn_ts.ambiguous_day_month", F.count_if("TXN_TS_AMBIGUOUS"), True)]
        out += [(f"txn_ts.precision[{x}]", F.count_if(F.col("TXN_TS_PRECISION") == x), True) for x in PRECISIONS]
        if "SETTLE_DATE" in before.columns:
            token = text(F.col("SETTLE_DATE")).isin(*STAMP_NULLS)
            out += [("settle_date.null_token", F.count_if(token), True), ("settle_date.unparseable", F.count_if(F.col("SETTLE_DATE_CLEANED").isNull()) - F.count_if(token), True)]
        return [measure(rows, out)]

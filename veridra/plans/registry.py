"""One query for each operator, by name. Transactions are the dirty view of orders; profiles also read given tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veridra import rules
from veridra.functions.text import text, true
from veridra.operators import amounts, codes, dates, duplicates, geo, macro, mcc, merchant, missing, profile, timestamps
from veridra.operators.consistency import ConsistencyValidator
from veridra.plans import dirty
from veridra.plans.pipeline import TransactionCleaner, build_sheets
from veridra.plans.present import output_names, presented, shown_dates
from veridra.policy import default_policy
from veridra.sources import readers
from veridra.sources.sinks import write_sheets
from veridra.streaming.stream import stateless

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
def K() -> Column:  # noqa: N802  the key of a transaction in results
    return F.col("_row_ix").alias("k")

# A small code reference; the first code comes twice, and the later row counts.
REFERENCE = (("5411", "Groceries"), ("5812", "Restaurants"), ("742", "Veterinary"), ("8220", "Colleges"), ("5999", "Other retail"), ("5411", "Supermarkets"))


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def stamp_text(c: str | Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def staging(spark: SparkSession) -> str:
    """A new path in the shared folder of the session; a folder of this machine only where all of Spark runs on it."""
    root = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.gettempdir()
    return f"{root}/veridra-{uuid.uuid4().hex}"


def tx(spark: SparkSession, sf_dir: str, repeats: bool = False) -> DataFrame:
    return dirty.transactions(spark, sf_dir, repeats)


def after(name: str, spark: SparkSession, sf_dir: str, repeats: bool = False) -> DataFrame:
    """The dirty view after the default steps up to the one named."""
    return staged(name, spark, sf_dir, repeats)[2]


def staged(name: str, spark: SparkSession, sf_dir: str, repeats: bool = False):
    cleaner = TransactionCleaner(mcc_reference=reference(spark))
    cleaner.run(tx(spark, sf_dir, repeats))
    return cleaner.around(name)


def reference(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([(*x, k) for k, x in enumerate(REFERENCE)], "MCC string, CATEGORY string, _row_ix long")
    return codes.reference_frame(rows, "MCC", "CATEGORY")


def metrics(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, [m.select("metric", F.col("value").cast("long").alias("value")) for m in frames])


def step_metrics(name: str, spark: SparkSession, sf_dir: str, repeats: bool = False) -> DataFrame:
    step, before, out = staged(name, spark, sf_dir, repeats)
    return metrics(step.metrics(before, out))


# -- sources and step 1


@query
def src_scan(spark, sf_dir):
    return readers.all_text(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"), "c_custkey").withColumnRenamed("_row_ix", "row_ix")


@query
def src_csv(spark, sf_dir):
    path = staging(spark)
    spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", F.when(F.col("n_nationkey") % 5 != 0, F.col("n_name")).alias("n_name"), F.lit("NA").alias("note")).write.csv(path, header=True)
    return readers.csv(spark, path).drop("_row_ix")


@query
def dates_parse(spark, sf_dir):
    df = dates.DateNormalizer()(tx(spark, sf_dir))
    return df.select(K(), stamp_text("TXN_DATE_TIME_CLEANED").alias("txn_date_time"), stamp_text("SETTLE_DATE_CLEANED").alias("settle_date"))


@query
def dates_formats(spark, sf_dir):
    df = tx(spark, sf_dir)
    step = dates.DateNormalizer()
    return metrics(step.metrics(df, step(df)))


# -- steps 3 to 5


@query
def code_pad(spark, sf_dir):
    return codes.CodeNormalizer()(tx(spark, sf_dir)).select(K(), F.col("PROCESSING_CODE_CLEANED").alias("processing_code"), F.col("MCC_CODE_CLEANED").alias("mcc_code"))


@query
def code_label(spark, sf_dir):
    return codes.CodeNormalizer()(tx(spark, sf_dir)).select(K(), F.col("PROCESSING_TYPE_CLEANED").alias("processing_type"))


@query
def code_disagree(spark, sf_dir):
    return step_metrics("codes", spark, sf_dir)


@query
def mcc_category(spark, sf_dir):
    return codes.CodeNormalizer(mcc_reference=reference(spark))(tx(spark, sf_dir)).select(K(), F.col("MCC_CATEGORY").alias("category"))


@query
def mcc_reference(spark, sf_dir):
    """The reference of part types: the later of two sizes of one padded code wins."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_size", "p_type", F.col("p_partkey").alias("_row_ix"))
    return codes.reference_frame(parts, "p_size", "p_type")


def _amounts(spark, sf_dir):
    return amounts.AmountNormalizer()(codes.CodeNormalizer()(tx(spark, sf_dir)))


@query
def amount_parse(spark, sf_dir):
    return tx(spark, sf_dir).select(K(), F.round(amounts.parse(F.col("TXN_AMOUNT"), F.col("TXN_CCY")) + 0.0, 2).alias("amount"))


@query
def amount_separator(spark, sf_dir):
    """Quantities of parts written with one mark, read under a currency with and without minor units."""
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("k"), F.concat((F.col("p_size") + 1).cast("string"), F.when(F.col("p_partkey") % 2 == 0, ",").otherwise("."), F.lpad(F.pmod("p_partkey", F.lit(1000)).cast("string"), 3, "0")).alias("v"))
    return rows.select("k", *(amounts.parse(F.col("v"), F.lit(c)).alias(c.lower()) for c in ("USD", "LBP")))


@query
def amount_sign(spark, sf_dir):
    return _amounts(spark, sf_dir).select(K(), F.round("TXN_AMOUNT_CLEANED", 2).alias("amount"), F.col("VALIDATION_FLAGS").alias("flags"))


@query
def amount_metrics(spark, sf_dir):
    return step_metrics("amounts", spark, sf_dir)


@query
def terminal_flag(spark, sf_dir):
    return missing.MissingValueHandler()(tx(spark, sf_dir).select("TERMINAL_ID", "_row_ix")).select(K(), F.col("HAS_TERMINAL").alias("has_terminal"))


@query
def auth_valid(spark, sf_dir):
    return missing.MissingValueHandler()(tx(spark, sf_dir).select("AUTH_CODE", "_row_ix")).select(K(), F.col("AUTH_CODE_VALID").alias("auth_code_valid"))


@query
def settle_status(spark, sf_dir):
    return missing.MissingValueHandler()(dates.DateNormalizer()(tx(spark, sf_dir))).select(K(), F.col("SETTLE_DATE_STATUS").alias("status"))


@query
def blank_counts(spark, sf_dir):
    return step_metrics("missing", spark, sf_dir)


# -- steps 2, 6, 7


@query
def dup_exact(spark, sf_dir):
    return duplicates.exact(tx(spark, sf_dir, True)).groupBy("TXN_ID").agg(F.count("*").alias("n"), F.min("_row_ix").alias("first")).withColumnRenamed("TXN_ID", "txn_id")


@query
def dup_business_key(spark, sf_dir):
    return step_metrics("duplicates", spark, sf_dir, True)


@query
def dup_id_seq(spark, sf_dir):
    df = dates.DateNormalizer()(tx(spark, sf_dir))
    return duplicates.DuplicateCleaner()(df).select(K(), F.col("TXN_ID_CLEANED").alias("txn_id"))


def _geo(spark, sf_dir):
    return geo.CityNormalizer()(missing.MissingValueHandler()(tx(spark, sf_dir).select("MERCHANT_CITY", "MERCHANT_COUNTRY", "TERMINAL_ID", "_row_ix")))


def _geo_query(name: str, column: str) -> None:
    def f(spark, sf_dir):
        return _geo(spark, sf_dir).select(K(), F.col(column).alias("value"))

    f.__name__ = name
    query(f)


for _name, _column in {"geo_city": "MERCHANT_CITY_CLEANED", "geo_location_type": "LOCATION_TYPE", "geo_ecommerce": "IS_ECOMMERCE", "geo_expected": "MERCHANT_COUNTRY_EXPECTED", "geo_country": "MERCHANT_COUNTRY_CLEANED"}.items():
    _geo_query(_name, _column)


@query
def geo_metrics(spark, sf_dir):
    return step_metrics("geo", spark, sf_dir)


@query
def merchant_clean(spark, sf_dir):
    return merchant.cleaned(tx(spark, sf_dir), "MERCHANT_NAME").select(K(), F.col("_name").alias("name"))


@query
def merchant_processor(spark, sf_dir):
    return merchant.MerchantCleaner()(tx(spark, sf_dir)).select(K(), F.col("MERCHANT_PROCESSOR").alias("processor"))


@query
def merchant_master(spark, sf_dir):
    return merchant.MerchantCleaner()(tx(spark, sf_dir)).select(K(), F.col("MERCHANT_NAME_CLEANED").alias("name"), F.col("MERCHANT_RECOGNISED").alias("recognised"), F.col("MATCHES_STATUS_CLEANED").alias("status"))


@query
def merchant_review(spark, sf_dir):
    step, _, out = staged("merchant", spark, sf_dir)
    return output_names(step.review(out))


@query
def merchant_metrics(spark, sf_dir):
    return step_metrics("merchant", spark, sf_dir)


@query
def trap_pairs(spark, sf_dir):
    return merchant.trap_violations(after("merchant", spark, sf_dir), rules.TRAPS)


# -- step 8


def _histogram(spark, sf_dir):
    return mcc.histogram(staged("mcc", spark, sf_dir)[1])


@query
def mcc_histogram(spark, sf_dir):
    return _histogram(spark, sf_dir)


@query
def mcc_decide(spark, sf_dir):
    return mcc.decisions(_histogram(spark, sf_dir)).select("merchant", "mcc", "confidence", "signal", "rows", F.round("p_value", 9).alias("p_value"))


@query
def mcc_binomial(spark, sf_dir):
    """Upper tails for the order counts of customers: of n orders, the hits above half at odds of one half."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderkey") % 2 == 0).alias("even"))
    hits = F.greatest("even", F.col("n") - F.col("even"))
    return orders.select("o_custkey", "n", hits.alias("hits"), F.round(mcc.binomial_tail(F.col("n"), F.lit(2), hits) + 1e-11, 9).alias("p"))


@query
def mcc_suggest(spark, sf_dir):
    df = staged("mcc", spark, sf_dir)[1]
    out = mcc.suggested(df, mcc.decisions(mcc.histogram(df)))
    return out.select(K(), F.col("MCC_CODE_SUGGESTED").alias("suggested"), F.col("MCC_CONFIDENCE").alias("confidence"), F.col("_MCC_SIGNAL").alias("signal"))


@query
def mcc_atm(spark, sf_dir):
    step, before, _ = staged("mcc", spark, sf_dir)
    out = step.scored(before)
    return out.where("_MCC_SIGNAL = 'deterministic'").select(K(), F.col("MCC_CODE_SUGGESTED").alias("suggested"), F.col("VALIDATION_FLAGS").alias("flags"))


@query
def mcc_adopt(spark, sf_dir):
    return after("mcc", spark, sf_dir).select(K(), F.col("MCC_CODE_CLEANED").alias("mcc_code"))


@query
def mcc_metrics(spark, sf_dir):
    return step_metrics("mcc", spark, sf_dir)


@query
def mcc_review(spark, sf_dir):
    step, before, _ = staged("mcc", spark, sf_dir)
    return output_names(step.review(before))


# -- step 9


def _flag_query(name: str, flags: tuple[str, ...]) -> None:
    def f(spark, sf_dir):
        df = staged("consistency", spark, sf_dir)[1]
        known = dict(ConsistencyValidator().flags(df))
        own = [n for n in known if n.startswith(flags)]
        return df.select(K(), *(F.coalesce(known[n], F.lit(False)).alias(n.replace("[", "_").replace("]", "").lower()) for n in own))

    f.__name__ = name
    query(f)


for _name, _flags in {
    "con_required": ("REQUIRED_NULL",), "con_settle": ("SETTLE_BEFORE_TXN",), "con_fx_reconcile": ("FX_RECONCILE_MISMATCH",), "con_fx_reference": ("FX_RATE_OFF_REFERENCE",),
    "con_sign": ("REFUND_NEGATIVE", "PURCHASE_POSITIVE"), "con_geo": ("GEO_CITY_COUNTRY_MISMATCH",), "con_code_type": ("CODE_TYPE_MISMATCH",),
}.items():
    _flag_query(_name, _flags)


@query
def con_flags(spark, sf_dir):
    return step_metrics("consistency", spark, sf_dir)


@query
def pipeline_full(spark, sf_dir):
    """All nine steps over the dirty view with repeats: rows and amounts by flag combination."""
    out = TransactionCleaner(mcc_reference=reference(spark)).run(tx(spark, sf_dir, True))
    return out.groupBy(F.col("VALIDATION_FLAGS").alias("flags"), F.col("MCC_CONFIDENCE").alias("confidence")).agg(F.count("*").alias("n"), F.round(F.sum("TXN_AMOUNT_CLEANED") + 0.0, 2).alias("amount"), F.count_distinct("TXN_ID_CLEANED").alias("ids"))


# -- presentation, sheets, report


def _sheets(spark, sf_dir):
    cleaner = TransactionCleaner(mcc_reference=reference(spark), persist=True)
    raw = tx(spark, sf_dir)
    return build_sheets(raw, cleaner.run(raw), cleaner, reference(spark))


@query
def present_view(spark, sf_dir):
    """Place and name of the columns of the published view."""
    names = presented(after("consistency", spark, sf_dir)).columns
    return spark.createDataFrame(list(enumerate(names)), "place int, name string")


@query
def present_names(spark, sf_dir):
    names = output_names(presented(after("consistency", spark, sf_dir))).columns
    return spark.createDataFrame(list(enumerate(names)), "place int, name string")


@query
def present_dates(spark, sf_dir):
    return shown_dates(dates.DateNormalizer()(tx(spark, sf_dir)).select(K(), "TXN_DATE_TIME_CLEANED", "SETTLE_DATE_CLEANED")).toDF("k", "txn_date_time_cleaned", "settle_date_cleaned")


@query
def sheet_pending(spark, sf_dir):
    return _sheets(spark, sf_dir)["pending_settlement"].select("txn_id_cleaned", "account_id", "settle_date_status")


@query
def sheet_anomaly(spark, sf_dir):
    return _sheets(spark, sf_dir)["anomaly_settlement"].select("txn_id_cleaned", "account_id", stamp_text("settle_date_cleaned").alias("settle_date"))


@query
def sheet_processing_codes(spark, sf_dir):
    """Written as a sheet and read back."""
    root = staging(spark)
    path = write_sheets({"processing_codes": _sheets(spark, sf_dir)["processing_codes"]}, root)[0]
    return spark.read.parquet(path)


@query
def report(spark, sf_dir):
    return _sheets(spark, sf_dir)["cleaning_report"]


# -- steps 10 and 11


def _stamps(spark, sf_dir, **config):
    return timestamps.TimestampNormalizer(**config)(dirty.forecast(spark, sf_dir))


def _stamp_query(name: str, *columns: str) -> None:
    def f(spark, sf_dir):
        out = _stamps(spark, sf_dir)
        return out.select(K(), *((stamp_text(c) if kind.startswith("timestamp") else F.col(c)).alias(c.lower()) for c in columns for n, kind in out.dtypes if n == c))

    f.__name__ = name
    query(f)


for _name, _columns in {
    "ts_parse": ("TXN_TS",), "ts_precision": ("TXN_TS_PRECISION",), "ts_ambiguous": ("TXN_TS_AMBIGUOUS",), "ts_offset": ("TXN_TS_UTC_OFFSET",), "ts_status": ("TXN_TS_STATUS",), "ts_settle": ("SETTLE_DATE_CLEANED",),
}.items():
    _stamp_query(_name, *_columns)


@query
def ts_epoch(spark, sf_dir):
    return _stamps(spark, sf_dir).where("TXN_TS_SOURCE = 'OFFSET_APPLIED'").select(K(), stamp_text("TXN_TS").alias("txn_ts"), F.col("TXN_TS_PRECISION").alias("txn_ts_precision"))


def _how(name: str, how: str) -> None:
    # the figures would settle nearly all that brackets can, and accounts have too few rows here to bracket any
    config = {"macro_oracles": (), "group_col": "USER_ID"} if how == "bracket" else {}

    def f(spark, sf_dir):
        out = _stamps(spark, sf_dir, keep_how=True, **config)
        return out.where(F.col("_how").startswith(how)).select(K(), F.col("_how").alias("how"), stamp_text("TXN_TS").alias("txn_ts"))

    f.__name__ = name
    query(f)


for _name, _prefix in {"ts_slash_forced": "forced", "ts_slash_macro": "macro", "ts_slash_bracket": "bracket"}.items():
    _how(_name, _prefix)


@query
def ts_metrics(spark, sf_dir):
    step, df = timestamps.TimestampNormalizer(), dirty.forecast(spark, sf_dir)
    return metrics(step.metrics(df, step(df)))


def _dated(spark, sf_dir):
    """All forecast rows with their times."""
    return dirty.forecast(spark, sf_dir).transform(timestamps.TimestampNormalizer(keep_how=True))


def _series(df: DataFrame) -> dict[str, DataFrame]:
    """The series, on the evidence of the rows whose month is written or forced. Ambiguous rows are read month first, and
    what figures or neighbours settle is inferred, so constancy can't be asked of those; they are recovered all the same."""
    sure = df.where(~F.col("TXN_TS_AMBIGUOUS") & ~true(~F.col("_how").startswith("forced")))
    return {name: macro.extract(sure, name, context) for name, context in rules.MACRO_SERIES}


@query
def macro_extract(spark, sf_dir):
    parts = [df.select(F.lit(name).alias("series"), "key", "value") for name, df in _series(_dated(spark, sf_dir)).items()]
    return reduce(DataFrame.union, parts)


def _macro(spark, sf_dir):
    df = _dated(spark, sf_dir)
    return macro.MacroCleaner(series=_series(df))(df)


@query
def macro_recover(spark, sf_dir):
    return _macro(spark, sf_dir).select(K(), F.col("INTEREST_RATE_INDEX_CLEANED").alias("rate"), F.col("INFLATION_INDEX_CLEANED").alias("inflation"))


@query
def macro_coverage(spark, sf_dir):
    return _macro(spark, sf_dir).select(K(), *(F.col(f"{c}_COVERAGE").alias(c.lower()) for c, _ in rules.MACRO_SERIES))


@query
def macro_coerce(spark, sf_dir):
    return _macro(spark, sf_dir).select(K(), F.col("IS_HOLIDAY_MONTH_CLEANED").alias("holiday"))


@query
def macro_metrics(spark, sf_dir):
    df = _dated(spark, sf_dir)
    step = macro.MacroCleaner(series=_series(df))
    return metrics(step.metrics(df, step(df)))


# -- profiles


def _events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet")


@query
def prof_duplicates(spark, sf_dir):
    return profile.duplicates(tx(spark, sf_dir, True))


@query
def prof_nulls(spark, sf_dir):
    return profile.nulls(tx(spark, sf_dir))


@query
def prof_missing(spark, sf_dir):
    return profile.missing(tx(spark, sf_dir))


@query
def eda_column_kinds(spark, sf_dir):
    return profile.column_kinds(tx(spark, sf_dir).select("TXN_ID", "TXN_DATE_TIME", "SETTLE_DATE", "MERCHANT_NAME", "FX_RATE", "PROCESSING_CODE"))


@query
def eda_missing(spark, sf_dir):
    return profile.gaps(tx(spark, sf_dir))


@query
def eda_patterns(spark, sf_dir):
    return profile.patterns(tx(spark, sf_dir), ["SETTLE_DATE", "TXN_AMOUNT", "MERCHANT_CITY", "MERCHANT_COUNTRY", "AUTH_CODE"])


@query
def eda_dups(spark, sf_dir):
    df = tx(spark, sf_dir, True)
    keys = {"rows": tuple(profile.raw_columns(df)), "TXN_ID": ("TXN_ID",), "TXN_SEQ": ("TXN_SEQ",)} | {"+".join(k): k for k in default_policy().business_keys}
    return profile.repeated(df, keys)


@query
def eda_cardinality(spark, sf_dir):
    return profile.cardinality(tx(spark, sf_dir))


@query
def eda_values(spark, sf_dir):
    return profile.value_counts(tx(spark, sf_dir), ["TXN_CCY", "PROCESSING_CODE", "MERCHANT_CITY", "TXN_ID"])


@query
def eda_code_pairs(spark, sf_dir):
    return profile.code_pairs(tx(spark, sf_dir))


@query
def eda_lenient(spark, sf_dir):
    df = dirty.forecast(spark, sf_dir)
    return df.select(K(), stamp_text(profile.lenient(text(F.col("TXN_DATE_TIME")))).alias("seen"))


@query
def eda_blocks(spark, sf_dir):
    return profile.blocks(_events(spark, sf_dir), "user_id", "event_id")


@query
def eda_monotonic(spark, sf_dir):
    """Orders dated along their keys: customers whose dates never fall, beside users whose events never go back."""
    orders = profile.monotonic(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_custkey", "o_orderkey", "o_orderdate")
    events = profile.monotonic(_events(spark, sf_dir), "user_id", "event_id", "ts")
    return orders.select(F.lit("orders").alias("name"), "*").union(events.select(F.lit("events").alias("name"), "*"))


@query
def eda_backwards(spark, sf_dir):
    df = dates.DateNormalizer()(tx(spark, sf_dir)).withColumn("seq", F.col("TXN_SEQ").cast("long"))
    return profile.backwards(df, "ACCOUNT_ID", "seq", "TXN_DATE_TIME_CLEANED", "TXN_DATE_TIME")


@query
def eda_months(spark, sf_dir):
    return profile.months(_events(spark, sf_dir), "user_id", "ts")


@query
def eda_spread(spark, sf_dir):
    return profile.spread(tx(spark, sf_dir), "PROCESSING_TYPE", "TXN_AMOUNT").withColumnRenamed("PROCESSING_TYPE", "processing_type")


@query
def seq_spearman(spark, sf_dir):
    return profile.spearman(_events(spark, sf_dir), "user_id", "event_id", "value")


@query
def stream_stateless(spark, sf_dir):
    """The steps that keep no state, as a stream over the written dirty view; same rows as in batch."""
    return stateless(spark, tx(spark, sf_dir), staging(spark)).select(K(), stamp_text("TXN_DATE_TIME_CLEANED").alias("txn_date_time"), F.col("MERCHANT_NAME_CLEANED").alias("name"), F.col("MERCHANT_CITY_CLEANED").alias("city"))



"""The ordered steps over a frame, the report of their metrics, and the sheets that a run publishes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridra.operators.amounts import AmountNormalizer
from veridra.operators.base import Step
from veridra.operators.codes import CodeNormalizer
from veridra.operators.consistency import ConsistencyValidator
from veridra.operators.dates import DateNormalizer
from veridra.operators.duplicates import DuplicateCleaner
from veridra.operators.geo import CityNormalizer
from veridra.operators.mcc import MccResolver
from veridra.operators.merchant import MerchantCleaner
from veridra.operators.missing import MissingValueHandler
from veridra.plans.present import output_names, presented
from veridra.policy import Policy, default_policy
from veridra.rules import PROCESSING_CODES

DEFAULT_STEPS: tuple[type[Step], ...] = (
    DateNormalizer, DuplicateCleaner, CodeNormalizer, AmountNormalizer, MissingValueHandler, MerchantCleaner, CityNormalizer, MccResolver, ConsistencyValidator,
)


class TransactionCleaner:
    """Steps by class or instance, in order. `run` is lazy; `report` works its aggregates out when it is read.

    With persist, what a step gives is kept (in memory, then on disk) once it is read, so that a report and several
    sheets don't run the steps before it again; without, nothing is kept.
    """

    def __init__(self, steps: Sequence[type[Step] | Step] = DEFAULT_STEPS, *, policy: Policy | None = None, mcc_reference=None, master: dict | None = None, persist: bool = False):
        self.policy, self.persist = policy or default_policy(), persist
        self.steps: list[Step] = []
        for step in steps:
            if isinstance(step, Step):
                self.steps.append(step)
                continue
            config = {}
            if step is CodeNormalizer and mcc_reference is not None:
                config["mcc_reference"] = mcc_reference
            if step in (MerchantCleaner, MccResolver) and master is not None:
                config["master"] = master
            self.steps.append(step(self.policy, **config))
        self.stages: list[tuple[Step, DataFrame, DataFrame]] = []

    def run(self, df: DataFrame) -> DataFrame:
        self.stages, self.input = [], df
        for step in self.steps:
            out = step.apply(df)
            if self.persist and out is not df:
                out = out.persist(StorageLevel.MEMORY_AND_DISK)
            self.stages.append((step, df, out))
            df = out
        self.output = df
        return df

    def close(self) -> None:
        """Lets go of what persist kept."""
        for _, _, out in self.stages:
            if self.persist:
                out.unpersist()

    def step(self, name: str) -> Step | None:
        return next((s for s, _, _ in self.stages if s.name == name), None)

    def around(self, name: str) -> tuple[Step, DataFrame, DataFrame] | None:
        return next((x for x in self.stages if x[0].name == name), None)

    def report(self) -> DataFrame:
        """step, metric and value (text) in the order of the run, plus seq, which sorts them."""
        frames, size = [], lambda name, df: df.agg(F.count("*").alias("value")).select(F.lit(0).alias("at"), F.lit(name).alias("metric"), "value")
        parts = [("pipeline", [size("input_rows", self.input)])]
        parts += [(step.name, step.metrics(before, after)) for step, before, after in self.stages]
        parts.append(("pipeline", [size("output_rows", self.output)]))
        for k, (name, metrics) in enumerate(parts):
            for j, m in enumerate(metrics):
                frames.append(m.select(F.lit(k * 1000 + j).alias("seq"), F.lit(name).alias("step"), "at", "metric", F.col("value").cast("string").alias("value")))
        return reduce(DataFrame.unionByName, frames)


def clean(source: DataFrame | str, spark: SparkSession | None = None, **config) -> tuple[DataFrame, TransactionCleaner]:
    """The cleaned frame and the cleaner that made it; source is a frame or a path of all-text Parquet or CSV."""
    if isinstance(source, str):
        from veridra.sources.readers import scan

        source = scan(spark or SparkSession.getActiveSession(), source)
    cleaner = TransactionCleaner(**config)
    return cleaner.run(source), cleaner


def build_sheets(raw: DataFrame, cleaned: DataFrame, cleaner: TransactionCleaner, reference: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables that a run publishes, by name."""
    spark, view = raw.sparkSession, presented(cleaned)
    sheets = {"raw_transactions": raw, "cleaned_transactions": view}
    sheets["processing_codes"] = spark.createDataFrame(sorted(PROCESSING_CODES.items()), "PROCESSING_CODE_CLEANED string, PROCESSING_TYPE string")
    if reference is not None:
        sheets["mcc_codes"] = reference.select(F.col("code").alias("MCC_CODE"), F.col("category").alias("CATEGORY")).orderBy("MCC_CODE")
    if "SETTLE_DATE_STATUS" in view.columns:
        sheets["pending_settlement"] = view.where("SETTLE_DATE_STATUS = 'UNKNOWN'")
        sheets["anomaly_settlement"] = view.where("SETTLE_DATE_STATUS = 'ANOMALOUS'")
    if found := cleaner.around("merchant"):
        if "MERCHANT_RECOGNISED" in found[2].columns:
            sheets["merchant_review"] = found[0].review(found[2])
    if found := cleaner.around("mcc"):
        if "MCC_CONFIDENCE" in found[2].columns:
            sheets["mcc_review"] = found[0].review(found[1])
    sheets["cleaning_report"] = cleaner.report().orderBy("seq", "at").select("step", "metric", "value")
    return {name: output_names(df) for name, df in sheets.items()}

"""The cleaning steps over streams.

Steps without state run unchanged under readStream. Exact repeats are dropped within a watermark. What needs counts
over all rows (authorisation codes, merchant codes) runs for each batch against counts kept in a table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veridra.operators.amounts import AmountNormalizer
from veridra.operators.codes import CodeNormalizer
from veridra.operators.dates import DateNormalizer
from veridra.operators.geo import CityNormalizer
from veridra.operators.merchant import MerchantCleaner

STATELESS = (DateNormalizer, CodeNormalizer, AmountNormalizer, MerchantCleaner, CityNormalizer)


def clean_stream(stream: DataFrame, steps=STATELESS) -> DataFrame:
    """A stream of raw transactions through the steps that keep no state."""
    for step in steps:
        stream = step()(stream)
    return stream


def without_repeats(stream: DataFrame, time: str, delay: str, keys: list[str]) -> DataFrame:
    """The stream without rows whose keys came before, as far back as the watermark reaches."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def run_available(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Processes what the source holds now, writes Parquet and stops; a rerun goes on after it (exactly once)."""
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def each_batch(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Processes what is there batch by batch; for steps that need counts kept outside."""
    stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def stateless(spark: SparkSession, raw: DataFrame, root: str) -> DataFrame:
    """Writes raw below root, streams it through the stateless steps, and reads the result."""
    raw.write.parquet(f"{root}/raw")
    stream = spark.readStream.schema(raw.schema).parquet(f"{root}/raw")
    run_available(clean_stream(stream), f"{root}/out", f"{root}/state")
    return spark.read.parquet(f"{root}/out")

"""What the operators share: reading tables, cutting lineage and walking Arrow batches in bounded slices."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that a Python worker turns into arrays at once; one longer text makes a slice of its own.
SLICE_CHARS = 2_000_000

#: Rows up to this number (16 bytes each) are broadcast to the larger side of a join; more are joined by a shuffle.
SMALL = 1_000_000

#: Word separators of the contracts: the ASCII white space characters.
SPACE = "\\x20\\x09-\\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session. Only where none is configured and all of Spark runs here (tests), a local one is
    set; a cluster must name one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="veridra-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df with its rows stored in the checkpoint folder and its lineage cut; survives lost executors. The shuffle files that
    made them are deleted at once: the driver's garbage collector would, but a driver with little to do seldom collects."""
    checkpoint_dir(df.sparkSession)
    out = df.checkpoint()
    _unshuffle(df)
    return out


def _unshuffle(df: DataFrame) -> None:
    """Deletes the shuffle files of df's own plan, as Spark's cleaner does; what runs the plan again makes them anew."""
    plan, cleaner = df._jdf.queryExecution().executedPlan(), df.sparkSession._jsc.sc().cleaner()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" and cleaner.isDefined():
        for k in list(plan.context().shuffleIds().keySet()):
            cleaner.get().doCleanupShuffle(k, False)


def let_go(df: DataFrame) -> None:
    """Deletes the stored rows of a frame that cut returned, once nothing reads it any more."""
    stored = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if stored.isDefined():
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(stored.get())
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if it holds at most SMALL rows."""
    df = cut(df)
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def text_slices(batches: Iterable[pa.RecordBatch], limit: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows whose texts (column "text") hold about `limit` bytes."""
    import numpy as np

    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column(batch.schema.get_field_index("text"))
        sizes = np.asarray(pa.compute.binary_length(text).fill_null(0), dtype=np.int64)
        part = (np.cumsum(sizes) - sizes) // limit
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        for a, b in zip(starts, np.r_[starts[1:], batch.num_rows], strict=True):
            yield batch.slice(int(a), int(b - a))


def texts(batch: pa.RecordBatch) -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [x if x is not None else "" for x in batch.column(batch.schema.get_field_index("text")).to_pylist()]

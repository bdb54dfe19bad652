"""Scans of raw transactions: every column as text, with the ingest order beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def all_text(df: DataFrame, order: str | None = None) -> DataFrame:
    """df with each column as text, and _row_ix: the column named by order, else the place in the scan."""
    ix = F.col(order).cast("long") if order else F.monotonically_increasing_id()
    return df.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in df.columns), ix.alias("_row_ix"))


def csv(spark: SparkSession, path: str, blank_is_null: bool = True) -> DataFrame:
    """A CSV file with a header; words such as NA stay text, and blank cells become null only on request."""
    df = spark.read.csv(path, header=True, inferSchema=False, nullValue="\0", emptyValue="", multiLine=False)
    return all_text(df.select(*(F.nullif(F.col(f"`{c}`"), F.lit("")).alias(c) if blank_is_null else F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns)))


def scan(spark: SparkSession, path: str) -> DataFrame:
    """Raw transactions from Parquet, CSV, or (where openpyxl is installed) a workbook."""
    if path.endswith(".csv"):
        return csv(spark, path)
    if path.endswith((".xlsx", ".xlsm")):
        return workbook(spark, path)[0]
    return all_text(spark.read.parquet(path))


def workbook(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame | None]:
    """The transactions sheet (else the first) and the code reference of a workbook (the first sheet named for MCC)."""
    try:
        from openpyxl import load_workbook
    except ImportError:
        raise RuntimeError("reading workbooks needs openpyxl, which is not installed; convert to Parquet or CSV") from None
    from veridra.operators.codes import reference_frame

    book = load_workbook(path, read_only=True, data_only=True)

    def frame(name: str) -> DataFrame:
        head, *rows = book[name].iter_rows(values_only=True)
        schema = ", ".join(f"`{c}` string" for c in head) + ", _row_ix long, _is_numeric boolean"
        at = list(head).index("TXN_AMOUNT") if "TXN_AMOUNT" in head else None
        return spark.createDataFrame([(*(None if v is None else str(v) for v in r), k, at is not None and isinstance(r[at], int | float)) for k, r in enumerate(rows)], schema)

    names = book.sheetnames
    codes = next((n for n in names if "MCC" in n.upper()), None)
    reference = None
    if codes:
        raw = frame(codes)
        reference = reference_frame(raw, raw.columns[0], raw.columns[1])
    return frame("Transactions" if "Transactions" in names else names[0]), reference

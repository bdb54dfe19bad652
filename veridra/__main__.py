"""One run from a source to its sheets: python -m veridra SOURCE FOLDER [--csv] [--policy FILE] [--reference FILE]."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from veridra.operators.codes import reference_frame
from veridra.plans.pipeline import build_sheets, clean
from veridra.policy import load
from veridra.sources.readers import scan, workbook
from veridra.sources.sinks import write_sheets


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> list[str]:
    """Reads the source (Parquet, CSV or a workbook), runs the nine steps, writes a folder for each sheet and prints the
    report; the paths written. The reference is a table of codes and categories, its first two columns."""
    args = argparse.ArgumentParser(prog="veridra", description=__doc__)
    args.add_argument("source")
    args.add_argument("folder")
    args.add_argument("--csv", action="store_true", help="sheets as CSV, with times as they are shown")
    args.add_argument("--policy", help="policy file")
    args.add_argument("--reference", help="Parquet or CSV of merchant codes")
    given = args.parse_args(argv)
    spark = spark or SparkSession.builder.appName("veridra").getOrCreate()
    reference = None
    if given.source.endswith((".xlsx", ".xlsm")):
        raw, reference = workbook(spark, given.source)
    else:
        raw = scan(spark, given.source)
    if given.reference:
        codes = scan(spark, given.reference)
        reference = reference_frame(codes, codes.columns[0], codes.columns[1])
    config = {"policy": load(given.policy)} if given.policy else {}
    cleaned, cleaner = clean(raw, mcc_reference=reference, persist=True, **config)
    try:
        sheets = build_sheets(raw, cleaned, cleaner, reference)
        paths = write_sheets(sheets, given.folder, "csv" if given.csv else "parquet")
        for row in sheets["cleaning_report"].collect():  # one row for each metric
            print(*row, sep="\t")
    finally:
        cleaner.close()
    return paths


if __name__ == "__main__":
    main()

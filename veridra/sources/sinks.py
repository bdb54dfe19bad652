"""Sinks: one folder for each sheet, and the macro series as a rule file."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

from veridra.plans.present import shown_dates

#: Sheet names are cut here, as workbooks do.
NAME_LENGTH = 31


def write_sheets(sheets: dict[str, DataFrame], root: str, kind: str = "parquet", display: bool = False) -> list[str]:
    """Writes each sheet below root as Parquet or CSV, with times as a sheet shows them on request; the paths."""
    paths = []
    for name, df in sheets.items():
        out = shown_dates(df) if display or kind == "csv" else df
        path = f"{root}/{name[:NAME_LENGTH]}"
        writer = out.write.mode("overwrite")
        writer.csv(path, header=True) if kind == "csv" else writer.parquet(path)
        paths.append(path)
    return paths


def macro_rules(series: dict[str, DataFrame], most: int = 100_000) -> str:
    """The series as JSON text; there is a key for each month and country, and more than `most` raise."""
    out = {}
    for name, df in series.items():
        rows = df.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"{name} has more than {most} keys: it is no broadcast series")
        out[name] = {r["key"]: r["value"] for r in rows}
    return json.dumps(out, indent=1, sort_keys=True)

"""Sinks for other programs: CSV that spreadsheets read, and gzipped JSON records."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_csv(rows: DataFrame, path: str, mark: bool = False) -> None:
    """CSV with a header, quotes doubled and lines that end in CR LF; a part file for each partition, with a byte order mark if one is asked for."""
    if mark:
        rows = rows.withColumnRenamed(rows.columns[0], "\ufeff" + rows.columns[0])  # the header is all that comes first
    rows.write.mode("overwrite").option("header", True).option("escape", '"').option("lineSep", "\r\n").csv(path)


def write_records(rows: DataFrame, path: str) -> None:
    """A JSON record for each row, gzipped; nulls are written, so that each record names every column."""
    rows.write.mode("overwrite").option("compression", "gzip").option("ignoreNullFields", False).json(path)


def write_periods(rows: DataFrame, path: str) -> None:
    """Parquet parted by quarter; only the quarters in `rows` are replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("period_end").parquet(path)

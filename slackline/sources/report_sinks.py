"""Report tables as files: CSV, JSON and Markdown."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def markdown(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One line of a Markdown table for each row, cells escaped; header() gives the first two lines."""
    cells = [F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("-")), r"\|", r"\\|") for c in columns]
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def header(columns: list[str]) -> str:
    return f"| {' | '.join(columns)} |\n|{'|'.join('-' * len(columns))}|"


#: How each format is written: (rows, mode, path).
WRITERS = {
    "csv": lambda rows, mode, path: rows.write.mode(mode).option("header", True).csv(path),
    "json": lambda rows, mode, path: rows.write.mode(mode).json(path),
    "markdown": lambda rows, mode, path: markdown(rows, rows.columns).write.mode(mode).text(path),
}


def export(rows: DataFrame, path: str, output_format: str, append: bool = False) -> dict:
    """Writes a report table; returns ok and an error text where Spark cannot write it, so one sink does not stop the others."""
    if output_format not in WRITERS:
        return {"ok": False, "path": path, "error": f"unknown format {output_format}; known: {', '.join(WRITERS)}"}
    try:
        WRITERS[output_format](rows, "append" if append else "overwrite", path)
    except (PySparkException, Py4JJavaError) as e:
        return {"ok": False, "path": path, "error": str(e)}
    return {"ok": True, "path": path, "error": None}

"""Sinks: result tables, error logs, timings."""

from __future__ import annotations

from pyspark.sql import DataFrame


def results(df: DataFrame, path: str, append: bool = False) -> None:
    """CSV with a header line; appends to earlier results or replaces them."""
    df.write.mode("append" if append else "overwrite").option("header", True).csv(path)


def errors(df: DataFrame, path: str) -> None:
    """(code, message) rows beside the results."""
    df.select("code", "message").write.mode("append").json(path)


def times(df: DataFrame, path: str) -> None:
    """One number a line."""
    df.selectExpr("cast(value as string) as value").write.mode("append").text(path)

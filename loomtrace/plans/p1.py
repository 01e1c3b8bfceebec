"""Queries on kernel files (problem 1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.kernel_files import file_table, kernel_rows
from ..sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct block and label links of all kernels of all files."""
    files = table(spark, folder, "kernel").select("file_id", "body")
    rows = kernel_rows(files, ["file_id"])
    return rows.where(F.col("child") != "kernel").select("file_id", "kid", "child", "item").distinct()


def p1_kernels(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct kernels: key of the file, own key, key of the enclosing kernel, depth."""
    files = table(spark, folder, "kernel").select("file_id", "body")
    rows = kernel_rows(files, ["file_id"])
    return rows.where(F.col("child") == "kernel").select("file_id", "kid", "outer_kid", "depth").distinct()


def p1_files(spark: SparkSession, folder: str) -> DataFrame:
    """One row per stored file with its layout and number of outermost kernels."""
    files = table(spark, folder, "kernel").select("file_id", "trace_id", "tool", "written_at", "body")
    return file_table(files, ["file_id", "trace_id", "tool", "written_at"])


QUERIES = {"p1_found": p1_found, "p1_kernels": p1_kernels, "p1_files": p1_files}
ORACLE: dict[str, str] = {}

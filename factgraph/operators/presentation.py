"""What reports show of findings: escaped cells, places, the first entries of each variable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What stands for a missing cell, file and line.
NO_CELL, NO_FILE, NO_LINE = "—", "未知", "?"


def cell(value: Column) -> Column:
    """A value as a cell of a Markdown table: bars escaped, newlines as blanks."""
    return F.coalesce(F.replace(F.replace(value.cast("string"), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")), F.lit(NO_CELL))


def place(file: Column, line: Column) -> Column:
    """file:line, with marks for what is missing, empty or 0."""
    return F.concat_ws(":", F.coalesce(F.nullif(file, F.lit("")), F.lit(NO_FILE)), F.coalesce(F.nullif(line, F.lit(0)).cast("string"), F.lit(NO_LINE)))


def first_entries(entries: DataFrame, shown: int = 2) -> DataFrame:
    """symbol_id, entries (the first `shown` contexts, those of MAIN first, then the nearer, then by id), n_more of entries (symbol_id, context_id, kind, distance)."""
    order = [F.col("kind") != "MAIN", F.coalesce("distance", F.lit(999)), F.col("context_id")]
    x = entries.withColumn("nth", F.row_number().over(Window.partitionBy("symbol_id").orderBy(*order)))
    return x.groupBy("symbol_id").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("nth") <= shown, F.struct("nth", "context_id")))), lambda e: e["context_id"]).alias("entries"), F.greatest(F.count("*") - shown, F.lit(0)).alias("n_more"))

"""Consecutive numbers for the rows of written files, without gathering them in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_positions(df: DataFrame, name: str) -> DataFrame:
    """Adds 0, 1, 2, ... in the order of file names and rows, so in the order in which the rows were written.

    ``df`` is a plain scan of files in one folder; one small row a file reaches the driver.
    """
    marked = df.withColumns({"__file": F.col("_metadata.file_name"), "__row": F.col("_metadata.row_index")})
    before: list[Column] = []
    at = 0
    for file, n in sorted((r["__file"], r["count"]) for r in marked.groupBy("__file").count().collect()):
        before += [F.lit(file), F.lit(at).cast("bigint")]
        at += n
    start = F.create_map(*before)[F.col("__file")] if before else F.lit(0).cast("bigint")
    return marked.withColumn(name, start + F.col("__row")).drop("__file", "__row")

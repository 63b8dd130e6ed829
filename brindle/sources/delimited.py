"""Delimited text: every field arrives as text and is cast by the table that takes it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as t

#: Separators of fields and records: fixed values.
FORMS = {"csv": (",", None), "tsv": ("\t", None), "ascii": ("\x1f", "\x1e")}


def read_delimited(spark: SparkSession, path: str, names: list[str], form: str = "csv", skip_header: bool = False, escape: str | None = None, multi_line: bool = True) -> DataFrame:
    """``multi_line`` lets quoted fields hold line feeds, at the price of one task a file; without it files are split."""
    field, record = FORMS[form]
    reader = spark.read.schema(t.StructType([t.StructField(n, t.StringType()) for n in names])).option("sep", field).option("mode", "FAILFAST").option("header", skip_header).option("enforceSchema", True).option("emptyValue", "").option("nullValue", "\x00")
    reader = reader.option("escape", escape or '"')
    reader = reader.option("lineSep", record) if record else reader.option("multiLine", multi_line)
    return reader.csv(path)

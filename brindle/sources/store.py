"""Tables as immutable Parquet snapshots.

A table's snapshot is a list of Parquet folders. INSERT adds a folder, UPDATE and DELETE write those anew that hold rows they
change; a commit swaps the catalog's pointers, a rollback forgets the new folders. ``ParquetStore`` keeps the catalog in a JSON manifest beside them, so a
database can be opened again; without a path it lives in a folder of its own below ``spark.checkpoint.dir``. ``BlackholeStore`` takes writes and reads empty.
"""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as t

_TYPES = {"INTEGER": t.LongType(), "REAL": t.DoubleType(), "BOOLEAN": t.BooleanType(), "TEXT": t.StringType(), "BLOB": t.BinaryType()}


def schema_of(columns) -> t.StructType:
    return t.StructType([t.StructField(c["name"], _TYPES[c["type"]]) for c in columns])


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path that all executors share: below ``spark.checkpoint.dir``, or a temporary one where that is unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}" if shared else "file://" + tempfile.mkdtemp(prefix=f"{name}-")


class ParquetStore:
    """Folders below one root, local or in any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.keeps = root is not None
        self.root = (root or scratch(spark, "brindle-db")).rstrip("/")

    def write(self, df: DataFrame) -> str:
        """Write rows to a new folder; its path."""
        path = f"{self.root}/data/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path

    def read(self, paths: tuple[str, ...], columns) -> DataFrame:
        schema = schema_of(columns)
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def drop(self, path: str) -> None:
        where = self._path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def save(self, manifest: dict) -> None:
        if not self.keeps:
            return
        fs = self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())
        fs.mkdirs(self._path(self.root))
        out = fs.create(self._path(f"{self.root}/manifest.json.new"), True)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        fs.delete(self._path(f"{self.root}/manifest.json"), False)
        fs.rename(self._path(f"{self.root}/manifest.json.new"), self._path(f"{self.root}/manifest.json"))

    def load(self) -> dict | None:
        fs = self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())
        at = self._path(f"{self.root}/manifest.json")
        if not self.keeps or not fs.exists(at):
            return None
        return json.loads("".join(r.value for r in self.spark.read.text(f"{self.root}/manifest.json").collect()))


class BlackholeStore(ParquetStore):
    """Runs writes and forgets them."""

    def __init__(self, spark: SparkSession):
        super().__init__(spark)

    def write(self, df: DataFrame) -> str:
        df.write.format("noop").mode("overwrite").save()
        return ""

    def read(self, paths: tuple[str, ...], columns) -> DataFrame:
        return self.spark.createDataFrame([], schema_of(columns))

    def drop(self, path: str) -> None:
        pass

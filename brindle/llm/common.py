"""Helpers shared by the training-data operators."""

from __future__ import annotations

import sys
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

import brindle

# Worker functions travel by value, so executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(brindle)

#: Characters that part words: space and U+0009 to U+000D.
WORD_RE = r"[^\x20\x09-\x0D]+"
#: Texts are handed to numpy in slices of at most this many characters (a longer text is a slice of its own).
SLICE_CHARS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``; one of our own where that is unset (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        path = "file://" + tempfile.mkdtemp(prefix="brindle-shared-")
        spark.sparkContext.setCheckpointDir(path)
        path = spark.sparkContext.getCheckpointDir() or path
    return path.rstrip("/")


def materialize(df: DataFrame, **options: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/brindle-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what ``materialize`` wrote for these, once nothing reads them any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.written)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: So many ids (8 bytes each) at most are broadcast.
BROADCAST_IDS = 1_000_000


def sized(ids: DataFrame) -> DataFrame:
    """``ids``, written, with a broadcast hint if they are few enough; beyond that a join with them is shuffled."""
    ids = materialize(ids)
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def text_slices(texts, limit: int = SLICE_CHARS):
    """(start, end) ranges over ``texts`` that hold at most ``limit`` characters each, or a single text."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if len(texts) > start:
        yield start, len(texts)


def _parsed(schema: str) -> T.StructType:
    return T._parse_datatype_string(schema)  # noqa: SLF001


def per_slice(df: DataFrame, carry: list[str], text: str, make, schema: str, others: tuple[str, ...] = (), limit: int = SLICE_CHARS) -> DataFrame:
    """The columns ``carry`` of ``df`` with those of ``schema``, which Python works out from slices of texts.

    ``make()`` is called once a task and gives a function of (texts, *values of ``others``), lists of equal length. It returns
    (rows, columns): for each row of output the place of its input row (None: one each, in order) and a list for each name of
    ``schema``. What is carried passes through Arrow as it is: ids of any type and size, nulls beside them, never pandas.
    """
    added = _parsed(schema)
    out = T.StructType([df.schema[c] for c in carry] + added.fields)
    need = list(dict.fromkeys([*carry, text, *others]))
    empty = not carry

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        work, types = make(), [to_arrow_type(f.dataType) for f in added.fields]
        for batch in batches:
            texts = batch.column(need.index(text)).to_pylist()
            more = [batch.column(need.index(c)).to_pylist() for c in others]
            for a, b in text_slices(texts, limit):
                rows, columns = work(texts[a:b], *[m[a:b] for m in more])
                own = [batch.column(need.index(c)).slice(a, b - a) for c in carry]
                if rows is not None:
                    at = pa.array(rows, pa.int64())
                    own = [c.take(at) for c in own]
                new = [pa.array(columns[f.name], t) for f, t in zip(added.fields, types)]
                if len(new[0] if empty else own[0]):
                    yield pa.RecordBatch.from_arrays(own + new, names=[*carry, *added.names])

    return df.select(*need).mapInArrow(run, out)


#: Keys with so many rows or more are hot, or so many times as many that at most ``BROADCAST_KEYS`` are.
HOT_ROWS = 5_000
BROADCAST_KEYS = 200_000


def _hot(keyed: DataFrame, weight: str) -> int:
    """From what weight on a key is hot; 0 if none is. Rows / weight bounds the number of hot keys, so they can be broadcast."""
    sums = keyed.agg(F.sum(weight).alias("rows"), F.max(weight).alias("top")).first()
    least = max(HOT_ROWS, (sums["rows"] or 0) // BROADCAST_KEYS)
    return least if (sums["top"] or 0) >= least else 0


def join_hot(rows: DataFrame, keyed: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """``rows`` inner-joined with ``keyed``, narrow, which has one row a key and in ``weight`` about how many of ``rows`` share the key.

    The rows of a hot key don't meet in one task: hot keys are broadcast, and only rows of other keys are shuffled. Both inputs
    should be written tables, as they are read more than once. Keys aren't null.
    """
    least = _hot(keyed, weight)
    if not least:
        return rows.join(keyed, keys)
    many = F.broadcast(keyed.filter(F.col(weight) >= least))
    few = rows.join(many.select(*keys), keys, "left_anti").join(keyed.filter(F.col(weight) < least), keys)
    return few.unionByName(rows.join(many, keys))


def join_salted(rows: DataFrame, wide: DataFrame, key: str, counted: DataFrame, spread: str) -> DataFrame:
    """``rows`` inner-joined with ``wide``, one row a key and too wide to broadcast. The rows of a hot key are dealt, by column
    ``spread``, to as many copies of its row of ``wide`` as keep each below the bound. counted: the keys of ``rows``, written."""
    counts = counted.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    least = _hot(counts, "__n")
    if not least:
        return rows.join(wide, key)
    salts = F.broadcast(materialize(counts.filter(F.col("__n") >= least).select(key, F.ceil(F.col("__n") / least).cast("int").alias("__salts"))))
    dealt = rows.join(salts, key, "left").withColumn("__salt", F.coalesce(F.pmod(F.hash(spread), F.col("__salts")), F.lit(0)))
    copies = wide.join(salts, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1)))
    return dealt.drop("__salts").join(copies.drop("__salts"), [key, "__salt"]).drop("__salt")


class WordHashes(dict):
    """word bytes -> stable 64-bit hash, remembering a bounded number of words."""

    LIMIT = 100_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def mix64(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for every endpoint of ``edges`` (a, b); component is the smallest id reachable.

    Distributed min-label propagation with pointer jumping. Only a changed-rows counter reaches the driver; each round is
    materialised in the shared folder. Star-shaped input settles in a few rounds. Neither the neighbours of a hub nor the members
    of a large component meet in one task.
    """
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = materialize(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component"), F.count(F.lit(1)).alias("degree")))
    while True:
        # a vertex's label goes to its neighbours, as many as its degree
        heard = join_hot(both, labels.withColumnRenamed("id", "b"), ["b"], "degree").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("heard"))
        low = materialize(labels.join(heard, "id").select("id", "degree", F.col("component").alias("old"), F.least("component", "heard").alias("low")))
        members = low.groupBy("low").agg(F.count(F.lit(1)).alias("members"))
        top = materialize(members.join(labels.select(F.col("id").alias("low"), F.col("component").alias("higher")), "low"))
        step = materialize(join_hot(low, top, ["low"], "members").select("id", "degree", "old", F.least("low", "higher").alias("component")))
        changed = step.filter("component <> old").limit(1).count()
        labels = step.select("id", "component", "degree")
        if not changed:
            discard(both, low, top)
            return labels.select("id", "component")

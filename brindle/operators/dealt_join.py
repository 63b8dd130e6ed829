"""Joins that are mostly work on pairs: keys that many rows of both sides have are cut into cells, which tasks share.

Spark plans a join by bytes. A key of n rows on one side and m on the other gives n * m pairs to look at, however few bytes these
rows have, so that one task may get all pairs of a small table, and a broadcast table is walked through once for each row. Here
rows are counted by key first. Where pairs prevail, the n rows are dealt to p slots and the m rows to q; each row is copied to the
slots of the other side, so that each pair meets in one of p * q cells and in no other. Cells are of bounded size, hashed to tasks
and joined by sorting. Only the keys' counts reach the driver: one small row for each key of ``LEAST_CUT`` pairs or more.
"""

from __future__ import annotations

from math import ceil, sqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fewer pairs in all, or on average for a row, are left to Spark's plan.
FEW_PAIRS, FEW_A_ROW = 10_000_000, 16
#: Keys of fewer pairs stay whole.
LEAST_CUT = 1 << 20
#: Bounds of the rows of one side in a cell, and the cells that a core gets.
LEAST_ROWS, MOST_ROWS, CELLS_A_CORE = 1024, 8192, 16
#: Pairs of a task, and the most tasks.
PAIRS_A_TASK, MOST_TASKS = 20_000_000, 2000


def counts(a: DataFrame, b: DataFrame, keys: list[tuple[str, str]]):
    """Pairs in all, rows that have some, and the keys of many pairs with their rows on each side."""
    names = [f"k{i}" for i in range(len(keys))]
    count = lambda df, own, n: df.groupBy(*[F.col(k).alias(x) for k, x in zip(own, names)]).agg(F.count(F.lit(1)).alias(n))
    both = count(a, [k for k, _ in keys], "n").join(count(b, [k for _, k in keys], "m"), names)
    pairs = F.col("n").cast("double") * F.col("m")
    return both.agg(F.sum(pairs).alias("pairs"), F.sum(F.col("n") + F.col("m")).alias("rows"), F.collect_list(F.when(pairs >= LEAST_CUT, F.struct(*names, "n", "m"))).alias("large")).first()


def deal(a: DataFrame, b: DataFrame, keys: list[tuple[str, str]], types: list[str], hashed: tuple[list[str], list[str]], found) -> tuple[DataFrame, DataFrame, list[tuple[str, str]]] | None:
    """Both sides, dealt to cells, and pairs of columns that must be equal besides the keys; None where Spark's plan will do.

    ``found`` is the row of ``counts``; ``hashed`` names the columns of each side by which a row's slot is chosen.
    """
    pairs, rows = found["pairs"] or 0, found["rows"] or 0
    if pairs < FEW_PAIRS or pairs < FEW_A_ROW * rows:
        return None
    spark = a.sparkSession
    size = min(MOST_ROWS, max(LEAST_ROWS, sqrt(pairs / (CELLS_A_CORE * spark.sparkContext.defaultParallelism))))
    cut = [(*r[: len(keys)], ceil(r["n"] / size), ceil(r["m"] / size)) for r in found["large"]]
    cut = [r for r in cut if r[-1] * r[-2] > 1]
    tasks = min(MOST_TASKS, max(ceil(pairs / PAIRS_A_TASK), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    names = [f"__k{i}" for i in range(len(keys))]

    def side(df: DataFrame, own: list[str], cols: list[str], at: int) -> DataFrame:
        slots = [f"__slot{at}{i}" for i in range(2)]
        if cut:
            given = spark.createDataFrame(cut, ", ".join(f"{n} {t}" for n, t in zip(names, types)) + ", __p0 int, __p1 int")
            same = F.lit(True)
            for k, n in zip(own, names):
                same = same & (F.col(k) == F.col(n))
            mark = F.xxhash64(*cols)
            df = df.repartition(mark).join(F.broadcast(given), same, "left")  # spread out before rows are copied
            p = [F.coalesce(F.col(f"__p{i}"), F.lit(1)) for i in range(2)]
            df = df.withColumns({slots[at]: F.pmod(mark, p[at]).cast("int"), slots[1 - at]: F.explode(F.sequence(F.lit(0), p[1 - at] - 1))})
            df = df.drop(*names, "__p0", "__p1")
        return df.repartition(tasks, *own, *(slots if cut else ())).hint("merge")

    out = [side(df, [k[at] for k in keys], hashed[at], at) for at, df in enumerate((a, b))]
    return *out, [(f"__slot0{i}", f"__slot1{i}") for i in range(2)] if cut else []

"""Line dedup by a suffix array over line IDs.

Every text is a sequence of lines (parted at LF; lines without a word take no position). Lines that occur once can't repeat; the
suffixes that start at the others are ranked by prefix doubling: the rank of a suffix by its first 2^(k+1) lines comes from its
rank and that of the suffix 2^k lines on. Ranks keep the order (a range sort numbers the distinct pairs), so the rounds build the
suffix array of the repeated part. Suffixes that agree in their first n lines are an LCP interval of it, of depth n: they have equal
ranks at the two overlapping blocks of 2^floor(log2 n) lines.

A run of lines with at least ``min_words`` words that occurs earlier, in the order of (doc_id, position), is a later copy and is
deleted; shorter runs stay. A maximal such run of any length is the union of the shortest runs of that many words that start or end
in it, each an interval of depth ``min_words`` at most (a line has a word), so log2(min_words) rounds are all that runs of any
length need; deeper intervals would say nothing new. Each of these is compared with its interval's first member, found by one
aggregation: no interval is gathered in a task, copies are never paired, and very large intervals are no join key of a shuffle.
Overlapping ones are then merged into the maximal runs. Occurrences may overlap (a long line that is repeated over and over
keeps its first).

Null text stays null and has no lines, as an empty text. Repeated rows count as one document; rows that share a doc_id but not the
text are documents of their own. A null doc_id sorts first; ids pass through Arrow as they are. Ties in order can't arise. Extra
columns stay as they are, but for columns named n_lines, n_removed or removed, which are replaced. An empty table stays empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.common import join_hot, materialize

MIN_WORDS = 50
#: So many runs at most are broadcast to the texts; beyond it the texts are shuffled.
BROADCAST_RUNS = 500_000
_WORD = r"[^\x20\x09-\x0D]++"
_KEYS = ["__uid", "__doc"]


def _ranked(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Rows whose ``keys`` occur twice or more, with the order-preserving number ``name`` of the keys instead of them."""
    repeated = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1")
    ranks = materialize(repeated.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(name, F.monotonically_increasing_id()))
    return join_hot(rows, ranks, keys, "__n").drop(*keys, "__n")


def _windows(rows: DataFrame, min_words: int, rounds: int) -> DataFrame:
    """Of each document the shortest runs of ``min_words`` words that start or end at a repeated line, with the ranks at the two
    blocks that cover them. rows: _KEYS, lines, ranks."""
    names = ["pos", "len", "first_line", "last_line", "words", "left", "right"]

    def run(batches):
        for batch in batches:
            at, out = [], []
            for i, (lines, ranks) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                lines = sorted((x["pos"], x["line_no"], x["words"]) for x in lines)
                pos, no, words = (np.array(v, dtype=np.int64) for v in zip(*lines))
                rank = {(x["k"], x["pos"]): x["rank"] for x in ranks}
                cw = np.concatenate([[0], np.cumsum(words)])
                breaks = np.concatenate([[0], np.flatnonzero(np.diff(pos) != 1) + 1, [len(pos)]])
                seg = np.searchsorted(breaks, np.arange(len(pos)), side="right")
                ends = np.searchsorted(cw, cw[:-1] + min_words)  # the first end at which a run from here has enough words
                starts = np.searchsorted(cw, cw[1:] - min_words, side="right") - 1  # the last start for a run to here
                found = {(a, int(e)) for a, e in enumerate(ends) if e <= breaks[seg[a]]} | {(int(a), e + 1) for e, a in enumerate(starts) if a >= breaks[seg[e] - 1]}
                for a, e in found:
                    n = e - a
                    k = min(n.bit_length() - 1, rounds)
                    left, right = rank.get((k, int(pos[a]))), rank.get((k, int(pos[a]) + n - (1 << k)))
                    if left is not None and right is not None:
                        at.append(i)
                        out.append((int(pos[a]), n, int(no[a]), int(no[e - 1]), int(cw[e] - cw[a]), left, right))
            if out:
                keys = [batch.column(c).take(pa.array(at, pa.int64())) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays(keys + [pa.array(v, pa.int64()) for v in zip(*out)], names=[*_KEYS, *names])

    schema = T.StructType([rows.schema[c] for c in _KEYS] + [T.StructField(n, T.LongType()) for n in names])
    return rows.select(*_KEYS, "lines", "ranks").mapInArrow(run, schema)


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(__uid, __doc, first_line, last_line) of each maximal run to delete. docs has __uid, doc_id and text."""
    at = F.transform(F.split("text", "\n", -1), lambda line, i: F.struct(i.alias("line_no"), line.alias("line")))
    lines = docs.select("__uid", F.col("doc_id").alias("__doc"), F.posexplode_outer(F.filter(at, lambda s: s.line.rlike(_WORD))).alias("pos", "s")).filter("pos IS NOT NULL")
    lines = materialize(lines.select(*_KEYS, "pos", "s.line_no", F.xxhash64("s.line").alias("lid"), F.regexp_count("s.line", F.lit(_WORD)).alias("words")))
    first = materialize(_ranked(lines, ["lid"], "rank").distinct())
    rounds = max(0, min_words.bit_length() - 1)
    level, levels = first.select(*_KEYS, "pos", "rank"), []
    for k in range(rounds + 1):
        levels.append(level.select(*_KEYS, F.lit(k).alias("k"), "pos", "rank"))
        if k < rounds:
            ahead = Window.partitionBy(*_KEYS).orderBy("pos").rangeBetween(1 << k, 1 << k)
            pairs = materialize(level.withColumn("next", F.first("rank").over(ahead)).filter("next IS NOT NULL").withColumnRenamed("rank", "here"))
            level = materialize(_ranked(pairs, ["here", "next"], "rank"))
    ranks = levels[0]
    for more in levels[1:]:
        ranks = ranks.unionByName(more)
    # A document's own lines meet here: as many as its text holds.
    ranks = ranks.groupBy(*_KEYS).agg(F.collect_list(F.struct("k", "pos", "rank")).alias("ranks"))
    own = first.groupBy(*_KEYS).agg(F.collect_list(F.struct("pos", "line_no", "words")).alias("lines"))
    both = own.join(ranks, (own["__uid"] == ranks["__uid"]) & own["__doc"].eqNullSafe(ranks["__doc"])).select(own["__uid"], own["__doc"], "lines", "ranks")
    windows = materialize(_windows(both, min_words, rounds))
    interval = ["len", "left", "right", "words"]
    place = F.struct("__doc", "__uid", "pos")
    heads = materialize(windows.groupBy(*interval).agg(F.min(place).alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    later = join_hot(windows, heads, interval, "n").filter(place > F.col("head")).select(*_KEYS, "first_line", "last_line").distinct()
    order = Window.partitionBy(*_KEYS).orderBy("first_line", "last_line")
    reach = F.max("last_line").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = later.withColumn("opens", F.when(F.col("first_line") <= reach + 1, 0).otherwise(1))
    runs = opens.withColumn("run", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*_KEYS, "run").agg(F.min("first_line").alias("first_line"), F.max("last_line").alias("last_line")).drop("run")


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later copies of repeated line runs cut from text, and three columns more: n_lines (lines of the text,
    blank ones included; 0 for null or empty), n_removed, and removed (sorted line numbers from 0, comma-joined)."""
    # A blank line between two deleted lines of one run goes with them: runs are cut from first to last line.
    docs = docs.drop("n_lines", "n_removed", "removed").withColumn("__uid", F.xxhash64("doc_id", "text"))
    runs = repeated_runs(docs.select("__uid", "doc_id", "text"), min_words)
    drops = runs.groupBy(F.col("__uid").alias("__u"), F.col("__doc").alias("__d")).agg(F.collect_list(F.struct("first_line", "last_line")).alias("__runs"))
    drops = materialize(drops)
    few = (drops.agg(F.sum(F.size("__runs"))).first()[0] or 0) <= BROADCAST_RUNS
    held = docs.join(F.broadcast(drops) if few else drops, (F.col("__uid") == F.col("__u")) & F.col("doc_id").eqNullSafe(F.col("__d")), "left")
    parts = F.split("text", "\n", -1)
    gone = F.array_sort(F.flatten(F.transform("__runs", lambda r: F.sequence(r.first_line, r.last_line))))
    held = held.withColumns({"__drop": F.when(F.col("__runs").isNotNull(), gone), "__parts": F.when(F.col("__runs").isNotNull(), parts)})
    stay = F.array_sort(F.array_except(F.sequence(F.lit(0).cast("long"), F.size("__parts").cast("long") - 1), F.col("__drop")))
    cut = F.when(F.col("__drop").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("__parts", i.cast("int"))), "\n"))
    n = F.when(F.coalesce(F.length("text"), F.lit(0)) == 0, F.lit(0)).otherwise(F.size(parts))
    out = held.withColumns({"n_lines": n.cast("long"), "n_removed": F.greatest(F.coalesce(F.size("__drop"), F.lit(0)), F.lit(0)).cast("long"), "removed": F.coalesce(F.array_join("__drop", ","), F.lit(""))})
    return out.withColumn("text", cut).drop("__uid", "__u", "__d", "__runs", "__drop", "__parts")

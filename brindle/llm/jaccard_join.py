"""N-gram Jaccard self-join by adaptive multi-match prefixes.

A document's set is its distinct word shingles (lower-cased A-Z; words part at space and U+0009-U+000D); with fewer words than
a shingle the whole sequence is one shingle; a text that is null, empty or without words has the empty set and links with
nothing. Two documents link when their sets' Jaccard similarity reaches percent / 100, compared in whole numbers.

Steps, all distributed:

1. *Sets.* One pass hashes shingles to 64 bits and writes every document's set, sorted and packed to the first 48 bits of each;
   nothing is hashed again. Sizes are those of the 64-bit sets. Equal sets (compared by size and 128 bits of hash) form a class of
   which only one goes on, so copies cost no pairs. The packed sets tell in how many texts every shingle occurs, counted in
   blocks dealt by hash range; the at most ``HOT_LIMIT`` most frequent shingles (the threshold grows until they fit) are the
   only counts that are broadcast.
2. *Prefixes.* Shingles are ordered rare first: those not listed as frequent by hash, then the listed ones by frequency. If
   sets x and y link, they share at least l of the first |x| - ceil(t|x|) + l and |y| - ceil(t|y|) + l shingles, for any l.
   Each document takes the l (up to ``MAX_MATCH``) whose estimated cost is least: postings read, plus the candidates expected
   to share l of them. A pair is verified only if it shares at least the smaller l of both prefixes, whatever its size. Sound bounds
   rule out more pairs before they are formed: the prefix shingles that others have in a prefix with what follows the
   prefix bound what a pair can share, and so do the bits of 1024 in which the parities of the whole sets differ.
3. *Stars first.* Each document is paired with up to three pseudo-random members of each of its shingles' buckets that aren't in
   its component yet; these pairs, once verified, join the bulk of large groups of near copies in linear work. Three rounds.
4. *The rest.* Then every pair that shares a prefix shingle, passes the bounds and isn't in one component yet becomes a candidate. A
   pair meets once for each run of shared shingles. A pair that is left out is thus either known to be in one component or
   proven dissimilar: no link between components is lost, and no bucket is expanded into all its pairs once its members are joined.
5. *Verification* counts shared prefix shingles first, then intersects the whole hashed sets. Pairs of one much-paired
   document are dealt to copies of its set. Components come from distributed label propagation.

Repeated rows give repeated results; rows that share a doc_id but not the text are documents of their own, each with its
component. A null doc_id takes part and is returned; a component's id is the smallest that isn't null. Columns other than doc_id
and text are ignored, also where their names clash. An empty table gives an empty result. Ties can't arise: all is compared in
whole numbers.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.common import WordHashes, connected_components, discard, join_hot, join_salted, materialize, mix64, text_slices
from brindle.llm.common import sized as sized_ids

HOT_LIMIT = 1 << 18
MAX_MATCH = 4
#: Verifying a candidate costs as much as reading so many postings.
VERIFY_COST = 20
PARITY_BITS = 1024
#: Rounds of star pairs before the rest is looked at.
STAR_ROUNDS = 3
FLUSH_TOKENS = 1_000_000
_MUL = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def shingle_sets(texts, hashes: WordHashes, width: int):
    """For each text its sorted distinct shingle hashes (uint64)."""
    words, ends = [], []
    for t in texts:
        words += t.encode("utf-8", "surrogatepass").lower().split() if t else []
        ends.append(len(words))
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    roll = h[: max(0, len(h) - width + 1)]
    for k in range(1, width):
        roll = roll * np.uint64(_MUL[k % 3]) + h[k : len(h) - width + 1 + k]
    roll = mix64(roll)
    start = 0
    for end in ends:
        n = end - start
        if n >= width:
            yield np.unique(roll[start : end - width + 1])
        elif n:
            short = np.uint64(n)
            for x in h[start:end]:
                short = mix64(np.array([x ^ short], dtype=np.uint64) * np.uint64(_MUL[n % 3]))[0]
            yield np.array([short], dtype=np.uint64)
        else:
            yield np.zeros(0, dtype=np.uint64)
        start = end


def _pack(sorted32: np.ndarray, base: int) -> bytes:
    """Sorted 32-bit values from ``base`` on as 16-bit steps; 0xFFFF means: add 65535 and go on."""
    gap = np.diff(sorted32.astype(np.int64), prepend=base)
    more, last = gap // 65535, gap % 65535
    out = np.full(int(more.sum()) + len(gap), 65535, dtype=np.uint16)
    out[np.cumsum(more + 1) - 1] = last
    return out.tobytes()


def _unpack(data: bytes, base: int) -> np.ndarray:
    steps = np.frombuffer(data, dtype=np.uint16)
    return (base + np.cumsum(steps.astype(np.int64))[steps != 65535]).astype(np.uint32)


def _signed(x) -> int:
    x = int(x)
    return x - (1 << 64) if x >> 63 else x


def _pack_set(s: np.ndarray) -> bytes:
    """The first 48 bits of sorted hashes: four byte planes of the steps between their first 32 bits, then the 16 bits after them."""
    steps = np.diff((s >> np.uint64(32)).astype("<u4"), prepend=np.uint32(0))
    return steps.view(np.uint8).reshape(-1, 4).T.tobytes() + (s >> np.uint64(16)).astype("<u2").tobytes()


def _unpack_set(data: bytes) -> np.ndarray:
    """What ``_pack_set`` kept: sorted 48-bit hashes (uint64)."""
    n = len(data) // 6
    if not n:
        return np.zeros(0, dtype=np.uint64)
    planes = np.frombuffer(data, dtype=np.uint8, count=4 * n).reshape(4, n)
    first = np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint64)
    return (first << np.uint64(16)) | np.frombuffer(data, dtype="<u2", offset=4 * n).astype(np.uint64)


def _scan(docs: DataFrame, width: int) -> DataFrame:
    """A document's packed set with its size and hash."""
    names = ["doc_id", "n", "s1", "s2", "packed"]
    types = [T.LongType(), T.LongType(), T.LongType(), T.BinaryType()]
    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(n, t) for n, t in zip(names[1:], types)]])

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in text_slices(texts):
                rows = []
                for s in shingle_sets(texts[a:b], hashes, width):
                    s1 = _signed(np.bitwise_xor.reduce(s)) if len(s) else 0
                    rows.append((len(s), s1, _signed(mix64(s + np.uint64(_MUL[0])).sum(dtype=np.uint64)), _pack_set(s)))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), *columns], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _blocks(sets: DataFrame, bits: int) -> DataFrame:
    """The first 32 bits of shingle hashes in blocks by their first ``bits`` bits, with counts (null: all one)."""

    def run(batches):
        held, size = [], 0

        def flush():
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            cuts = np.searchsorted(values.astype(np.uint64), np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(32 - bits))
            rows = [(b, _pack(v, b << (32 - bits)), np.minimum(c, 0xFFFF).astype(np.uint16).tobytes() if c.max() > 1 else None) for b, (v, c) in enumerate(zip(np.split(values, cuts), np.split(counts, cuts))) if len(v)]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))]
            return pa.RecordBatch.from_arrays(columns, names=["block", "tokens", "counts"])

        for batch in batches:
            for data in batch.column(0):
                held.append((_unpack_set(data.as_py()) >> np.uint64(16)).astype(np.uint32))
                size += len(held[-1])
                if size >= FLUSH_TOKENS:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return sets.filter("n > 0").select("packed").mapInArrow(run, "block int, tokens binary, counts binary")


def _frequent(blocks: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent 32-bit shingle hashes, sorted, and their counts: at most HOT_LIMIT."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        values, counts = [], []
        base = int(pdf["block"].iloc[0]) << (32 - bits)
        for t, c in zip(pdf["tokens"], pdf["counts"]):
            values.append(_unpack(t, base))
            counts.append(np.frombuffer(c, dtype=np.uint16).astype(np.int64) if c is not None else np.ones(len(values[-1]), dtype=np.int64))
        token, at = np.unique(np.concatenate(values), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate(counts)).astype(np.int64)
        keep = total >= 8
        return pd.DataFrame({"token": token[keep].astype(np.int64), "df": total[keep]})

    found = materialize(blocks.groupBy("block").applyInPandas(merge, "token long, df long"))
    level = F.floor(F.log2("df") * 2)
    steps = found.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect()  # at most 128 rows
    total, least = 0, None
    for row in steps:
        total += row["count"]
        if total > HOT_LIMIT:
            break
        least = row["level"]
    if least is None:
        return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
    hot = found.filter(level >= least).toPandas().sort_values("token")
    return hot["token"].to_numpy().astype(np.uint32), hot["df"].to_numpy()


def _prefixes(sets: DataFrame, percent: int, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """node, n, m, prefix, parity of the sets (node, n, packed) that aren't empty."""
    shared = sets.sparkSession.sparkContext.broadcast(hot)  # HOT_LIMIT bounds it: 3 MB

    def frequency(s: np.ndarray) -> np.ndarray:
        token, counts = shared.value
        if not len(token):
            return np.ones(len(s), dtype=np.int64)
        top = (s >> np.uint64(16)).astype(np.uint32)
        at = np.minimum(np.searchsorted(token, top), len(token) - 1)
        return np.where(token[at] == top, counts[at], 1)

    def run(batches):
        for batch in batches:
            sizes, matches, prefixes, parities = [], [], [], []
            for data in batch.column(1):
                s = _unpack_set(data.as_py())
                n, df = len(s), frequency(s)
                least = -(-percent * n // 100)
                # the bits are of the whole set
                bits = (np.bincount((s & np.uint64(PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS) & 1).astype(np.uint8)
                parities.append(np.packbits(bits).view(np.int64))
                # a stable sort keeps the order by hash within a frequency
                if df.max() > 1:
                    order = np.argsort(df, kind="stable")[: min(n, n - least + MAX_MATCH)]
                    s, df = s[order], df[order]
                cost = np.cumsum(df - 1)
                best = min(range(1, min(MAX_MATCH, least) + 1), key=lambda m: (cost[n - least + m - 1] * (1 + VERIFY_COST / m), m))
                sizes.append(n)
                matches.append(best)
                prefixes.append(s[: n - least + best].view(np.int64))
            long = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), pa.array(matches, pa.int32()), pa.array(prefixes, long), pa.array(parities, long)], names=["node", "n", "m", "prefix", "parity"])

    return sets.filter("n > 0").select("node", "packed").mapInArrow(run, "node long, n int, m int, prefix array<long>, parity array<long>")


def _unpacked(sets: DataFrame) -> DataFrame:
    """node and shingles of sets (node, packed), in batches of a bounded number of shingles or one set."""

    def run(batches):
        for batch in batches:
            sizes = np.array([len(data.as_py()) // 6 for data in batch.column(1)])
            start = 0
            while start < len(sizes):
                end = start + max(1, int(np.searchsorted(np.cumsum(sizes[start:]), FLUSH_TOKENS, side="right")))
                lists = [_unpack_set(data.as_py()).view(np.int64) for data in batch.column(1).slice(start, end - start)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), pa.array(lists, pa.list_(pa.int64()))], names=["node", "shingles"])
                start = end

    return sets.select("node", "packed").mapInArrow(run, "node long, shingles array<long>")


def _verified(sets: DataFrame, prefixes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Those (a, b) of ``pairs`` that share enough prefix shingles and whose whole sets reach the similarity."""
    if not pairs.limit(1).count():
        return pairs.select("a", "b")

    def beside(found: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
        """``found`` with structs x and y, the columns of both sides."""
        # A broadcast of the ids spares the other rows of the table a shuffle.
        needed = sized_ids(found.select(F.col("a").alias("node")).unionByName(found.select(F.col("b").alias("node"))).distinct())
        own = table.join(needed, "node", "left_semi")
        own = (_unpacked(own) if columns == ["shingles"] else own).select("node", F.struct(*columns).alias("own"))
        held = found.select("a", "b").join(own.select(F.col("node").alias("b"), F.col("own").alias("y")), "b")
        # "a" is the one that may be in very many pairs
        return join_salted(held, own.select(F.col("node").alias("a"), F.col("own").alias("x")), "a", found, "b")

    # Pair by pair in the JVM: a batch of pairs of long sets would be large.
    told = F.size(F.array_intersect("x.prefix", "y.prefix")) >= F.least("x.m", "y.m")
    close = materialize(beside(pairs, prefixes, ["m", "prefix"]).filter(told).select("a", "b"))
    n = F.size(F.array_intersect("x.shingles", "y.shingles")).cast("long")
    reach = 100 * n >= percent * (F.size("x.shingles") + F.size("y.shingles") - n)
    return materialize(beside(close, sets, ["shingles"]).filter(reach).select("a", "b"))


def ngram_jaccard_join(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row a document: doc_id, n_shingles, class_id (smallest doc_id with the same set) and component_id (smallest doc_id
    reachable by links, itself included)."""
    docs = docs.select("doc_id", "text")
    bits = min(20, max(6, docs.select(F.lit(1)).count() // 4000).bit_length())
    plain = {"compression": "zstd", "parquet.enable.dictionary": "false"}
    scan = materialize(_scan(docs, width).withColumn("node", F.monotonically_increasing_id()), **plain)
    sized = scan.select("doc_id", "node", "n", "s1", "s2")
    sets = scan.select("node", "n", "packed")
    hot = _frequent(_blocks(sets, bits), bits)

    classes = sized.filter("n > 0").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("class_id"), F.min("node").alias("node"), F.count(F.lit(1)).alias("rows"))
    classes = materialize(classes)
    # Copies are told by id alone, and fewer than the rows: unless they are very many, no prefix is shuffled to leave them out.
    copies = sized_ids(sized.filter("n > 0").select("node").join(classes.select("node"), "node", "left_anti"))
    prefixes = materialize(_prefixes(sets, percent, hot).join(copies, "node", "left_anti"), **plain)
    postings = prefixes.select("node", F.explode("prefix").alias("token"))
    shared = postings.groupBy("token").count().filter("count > 1").select("token")
    postings = materialize(postings.join(shared, "token", "left_semi"))
    # "found" bounds what two prefixes share, "after" counts what follows the prefix. A document without a shared prefix shingle
    # links with nothing.
    found = postings.groupBy("node").agg(F.count(F.lit(1)).cast("int").alias("found"))
    after = F.expr(f"({percent} * n + 99) div 100") - F.col("m")
    info = materialize(prefixes.drop("prefix").join(found, "node").select("node", "n", "m", "parity", "found", after.cast("int").alias("after")))

    def fits(x: str, y: str):
        """Whether the pair can still reach the similarity, from both sizes and what they can share at most. A prefix shingle of
        one may follow the prefix of the other: only up to the prefix that ends first are all shared shingles in both prefixes."""
        size = F.col(f"{x}n") + F.col(f"{y}n")
        both = F.least(F.least(F.col(f"{x}found"), F.col(f"{y}found")) + F.greatest(F.col(f"{x}after"), F.col(f"{y}after")), F.col(f"{x}n"), F.col(f"{y}n"))
        return (100 * both >= percent * (size - both)) & (F.least(F.col(f"{x}found"), F.col(f"{y}found")) >= F.least(F.col(f"{x}m"), F.col(f"{y}m")))

    def alike(x: str, y: str):
        """Whether it can, from the bits in which the parities differ (no more than the shingles that only one of both has)."""
        size = F.col(f"{x}n") + F.col(f"{y}n")
        differ = sum(F.bit_count(F.col(f"{x}parity")[k].bitwiseXOR(F.col(f"{y}parity")[k])) for k in range(PARITY_BITS // 64))
        return (100 + percent) * (size - differ) >= 2 * percent * size

    def beside(found: DataFrame, *columns: str) -> DataFrame:
        """``found`` (a, b) with structs x and y, these columns of both sides."""
        own = lambda side, alias: info.select(F.col("node").alias(side), F.struct(*columns).alias(alias))
        return found.join(own("b", "y"), "b").join(own("a", "x"), "a")

    pairs = edges = known = None
    held = postings.withColumn("c", F.col("node"))
    for turn in range(STAR_ROUNDS):
        # At first the same few documents stand for most buckets of a group, so that its pairs are few; then others do.
        by = ["token", "node"] if turn else ["node"]
        stars = [F.min(F.struct(F.hash(*by, F.lit(3 * turn + k)).alias("h"), "node", "c")).alias(f"s{k}") for k in range(3)]
        anchors = held.groupBy("token").agg(*stars).select("token", F.explode(F.array_distinct(F.transform(F.array("s0", "s1", "s2"), lambda s: F.struct(s.node.alias("node"), s.c.alias("c"))))).alias("s"))
        tied = held.join(anchors, "token").filter((F.col("node") != F.col("s.node")) & (F.col("c") != F.col("s.c")))
        # "a" is the one that stands for a bucket, and so in many pairs
        tied = tied.select(F.col("s.node").alias("a"), F.col("node").alias("b")).distinct()
        tied = beside(tied, "n", "m", "found", "after").filter(fits("x.", "y.")).select("a", "b")
        tied = tied.groupBy(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.min("a").alias("a")).select("a", F.when(F.col("a") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("b"), "lo", "hi")
        tied = tied if pairs is None else tied.join(pairs, ["lo", "hi"], "left_anti")
        # Parities are wide: they are moved only beside pairs that sizes leave over.
        new = materialize(beside(tied, "n", "parity").filter(alike("x.", "y.")).select("a", "b", "lo", "hi"))
        linked = _verified(sets, prefixes, new, percent)
        pairs = new.select("lo", "hi") if pairs is None else pairs.unionByName(new.select("lo", "hi"))
        if linked.limit(1).count():
            edges = linked if edges is None else edges.unionByName(linked)
            known = connected_components(edges)
        elif turn:
            break
        placed = postings if known is None else postings.join(known, postings.node == known.id, "left")
        placed = placed.select("token", "node", F.coalesce("component", "node").alias("c") if known is not None else F.col("node").alias("c"))
        mixed = placed.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("token")
        held = materialize(placed.join(mixed, "token", "left_semi"))

    # Two documents that share a run of prefix shingles, each following the other in both, need to meet at its first one only:
    # where the shingles before are equal, they have met already.
    before = Window.partitionBy("node").orderBy("token")
    open_ = materialize(held.withColumn("before", F.lag("token").over(before)).join(info, "node"))
    x, y = open_.alias("x"), open_.alias("y")
    fresh = F.coalesce(F.col("x.before") != F.col("y.before"), F.lit(True))
    across = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.c") != F.col("y.c")) & fresh & fits("x.", "y.") & alike("x.", "y."))
    rest = across.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    rest = materialize(rest.join(pairs.select(F.col("lo").alias("a"), F.col("hi").alias("b")), ["a", "b"], "left_anti"))
    last = _verified(sets, prefixes, rest, percent)
    edges = last if edges is None else edges.unionByName(last)
    components = connected_components(edges)

    member = materialize(classes.join(components, classes.node == components.id, "left").select("n", "s1", "s2", "class_id", "rows", F.coalesce("component", "node").alias("component")))
    least = member.groupBy("component").agg(F.min("class_id").alias("component_id"), F.count(F.lit(1)).alias("classes"))
    labelled = materialize(join_hot(member, materialize(least), ["component"], "classes").drop("component", "classes"))
    written = materialize(sized.drop("node"))
    discard(scan, prefixes, postings, open_, held)
    linked = join_hot(written.filter("n > 0"), labelled, ["n", "s1", "s2"], "rows").select("doc_id", "n", "class_id", "component_id")
    alone = written.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), "class_id", "component_id")

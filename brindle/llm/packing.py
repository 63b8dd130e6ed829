"""Best-fit packing with several permitted sequence lengths, optimised jointly.

``pack(docs)`` lays every document of (doc_id, text) into training sequences. A document's length is its number of words (or a given
column). A document longer than the largest permitted length is cut into full pieces and a rest. Pieces are dealt by a hash to shards
of about ``shard_pieces`` pieces, whose number follows the pieces counted, so a hot source, a huge document, many rows of one id or
without one are spread. A sequence of c tokens costs c + c^2 / ``ATTENTION`` + ``OVERHEAD``: its positions, what attention
adds, and what a sequence costs by itself; padding is paid like text. Within each shard:

1. pieces are taken longest first; each goes to the open bin with the least room that still holds it (best fit);
2. where none holds it, a bin opens: of the lengths in use that hold it the one with the least cost a token, of the tokens
   that it can be expected to hold: itself, and as much of the rest of it as pieces still to come fill;
3. at the end each bin shrinks to the smallest permitted length that holds its contents.

The lengths in use are chosen jointly: from all of them, single lengths are put out of use or back while that makes the
shard's total cost, after shrinking, less (the best change each time). The largest always stays. Ties prefer fewer changes.

Returns one row a piece: doc_id, piece, piece_start, piece_len, bin_id ("shard-bin"), bin_capacity, bin_offset. Null or empty
texts have length 0 and one piece of length 0 in no bin (bin_id null). Ties between bins go to the one opened first, ties
between pieces to the smaller (doc_id, piece), a null id last, so the result depends on the rows alone. Repeated rows are
packed each, rows of one id and different lengths too. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.common import materialize

CAPACITIES = (256, 512, 1024, 2048, 4096)
#: Cost of a sequence beside its length, in tokens; and the length at which attention costs as much as the rest.
OVERHEAD, ATTENTION = 16, 24_576
SHARD_PIECES = 20_000


def cost(capacity: int) -> float:
    return capacity + capacity * capacity / ATTENTION + OVERHEAD


def best_fit(lengths: list[int], capacities=CAPACITIES, in_use=None) -> tuple[list[int], list[int], list[int], float]:
    """Bins of ``lengths`` (longest first): (bin of each piece, offset of each piece, final capacity of each bin, total cost)."""
    sizes = sorted(capacities)
    opened = sorted(in_use or sizes)
    top = sizes[-1]
    rest = sum(lengths)
    room: list[list[int]] = [[] for _ in range(top + 1)]  # bins by room left, first opened first
    some = 0  # bit r is set where room[r] has bins
    bin_of, offset, used = [], [], []
    choice: dict[int, list[int]] = {}  # lengths in use that hold a piece, by cost a token when full
    for n in lengths:
        fits = some >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = heapq.heappop(room[r])
            if not room[r]:
                some &= ~(1 << r)
        else:
            if n not in choice:
                choice[n] = sorted((c for c in opened if c >= n), key=lambda c: (cost(c) / c, c))
            cap = choice[n][0] if rest >= top else min(choice[n], key=lambda c: (cost(c) / min(c, rest), c))
            b, r = len(used), cap
            used.append(0)
        bin_of.append(b)
        offset.append(used[b])
        used[b] += n
        rest -= n
        heapq.heappush(room[r - n], b)
        some |= 1 << (r - n)
    final = {u: next(c for c in sizes if c >= u) for u in set(used)}
    caps = [final[u] for u in used]
    return bin_of, offset, caps, sum(map(cost, caps))


def best_lengths(lengths: list[int], capacities=CAPACITIES) -> tuple[int, ...]:
    """The lengths to open bins of, chosen jointly by their total cost."""
    every = tuple(sorted(capacities))
    tried = {every: best_fit(lengths, every)[3]}
    now = every
    while True:
        near = [tuple(c for c in every if (c in now) != (c == x)) for x in every[:-1]]
        for use in near:
            if use not in tried:
                tried[use] = best_fit(lengths, every, use)[3]
        best = min([now, *near], key=lambda u: (tried[u], u != now, u))
        if best == now:
            return now
        now = best


def pack(docs: DataFrame, capacities=CAPACITIES, length_col: str | None = None, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    top = max(capacities)
    words = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]++")) if length_col is None else F.greatest(F.coalesce(F.col(length_col), F.lit(0)), F.lit(0))
    # Rows alike in id and length are interchangeable: they are counted before the shuffle and numbered after it.
    sized = materialize(docs.select("doc_id", words.cast("long").alias("n")).groupBy("doc_id", "n").agg(F.count(F.lit(1)).alias("rows")))
    last = F.expr(f"greatest(0L, (n - 1) div {top})")
    total = sized.agg(F.sum(F.col("rows") * (last + 1))).first()[0] or 0
    shards = max(1, -(-total // shard_pieces))
    pieces = sized.select("doc_id", "n", F.explode(F.expr("sequence(1L, rows)")).alias("row")).select("doc_id", "n", "row", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    pieces = pieces.select(
        "doc_id", "piece", (F.col("piece") * top).alias("piece_start"), F.least(F.lit(top).cast("long"), F.col("n") - F.col("piece") * top).alias("piece_len"),
        F.pmod(F.xxhash64("doc_id", "n", "row", "piece"), F.lit(shards)).alias("shard"),
    )

    def pack_shard(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("piece_len", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        shard = rows.column("shard")[0].as_py()
        lengths = rows.column("piece_len").to_pylist()
        real = [n for n in lengths if n > 0]
        bins, offsets, caps, _ = best_fit(real, capacities, best_lengths(real, capacities))
        none = [None] * (len(lengths) - len(real))
        out = rows.drop_columns(["shard"])
        out = out.append_column("bin_id", pa.array([f"{shard}-{b}" for b in bins] + none, pa.string()))
        out = out.append_column("bin_capacity", pa.array([caps[b] for b in bins] + none, pa.int64()))
        return out.append_column("bin_offset", pa.array(offsets + none, pa.int64()))

    long = T.LongType()
    names = [("piece", long), ("piece_start", long), ("piece_len", long), ("bin_id", T.StringType()), ("bin_capacity", long), ("bin_offset", long)]
    return pieces.groupBy("shard").applyInArrow(pack_shard, T.StructType([docs.schema["doc_id"], *[T.StructField(n, t) for n, t in names]]))

"""Benchmark decontamination by template canonicalisation, in DataFrame operations only.

A text becomes a template, word for word: a number is <num>, a unit after a number is <unit>, a capitalised word that doesn't
open a sentence is <name>; other words are lower-cased and lose outer punctuation. Placeholders are slots. Windows of 8 template
words are hashed (by doubling: hashes of 1, 2, 4, 8 words) and joined with those of the benchmark; an item of 4 to 7 words has
windows of 4, all of which must be found. A shorter item is found where a whole line of a document says it, in plain words: any
less would find every text that holds such a phrase. Item windows of more than half slots say too little
and aren't used, but for items that have no others: then those with a word besides slots are, and half of the values must be
the item's own. A document is a candidate for an item when it holds ``min_percent`` percent of the item's distinct windows.
Beside templates, windows of the plain lower-cased words are joined in the same way: a document that holds all of an item's
holds it verbatim, whatever its slots. Of an item of numbers or names only, which has no template window, the share is enough;
with other values such an item is any list of numbers or names, and so can't be told.

Slots of matched windows are then compared: each value of the item must stand for one value of the document and the other way
round (7 -> 12 everywhere). A candidate whose slots clash stays only if windows without slots reach the share on their own, or
if one occurrence, by the difference of positions in document and item, reaches it without a clash; its slots are then counted.
Verbatim copies are consistent by nature, re-parameterised questions are so too.

Returns a row for each (doc_id, item_id) found: n_windows (matched, distinct), item_windows, n_slots (distinct pairs of values),
n_changed (those that differ); what only plain words found has their windows and no slots. Null texts hold no words, rows with
null ids are skipped, repeated rows count once (also rows that share an id: their windows are joined), extra columns are ignored,
also where their names clash, empty tables give no rows; a text of any length is one row of windows. Benchmark windows are
broadcast only after their number is checked; larger benchmarks take a shuffled join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import materialize

MIN_PERCENT = 50
#: So many window hashes (8 bytes each) of the benchmark are broadcast to sift those of the documents before any shuffle.
BROADCAST_KEYS = 500_000
#: Words taken as units after a number.
UNITS = "km|m|cm|mm|mi|miles?|ft|feet|inch|inches|kg|g|mg|lbs?|pounds?|l|ml|hours?|minutes?|seconds?|days?|weeks?|months?|years?|dollars?|euros?|cents?|percent|usd|eur|mph|degrees?"
_SPACE, _MARK = r"[\x20\x09-\x0D]", r"[\p{P}\p{S}&&[^<>%]]"
_WORD = r"[^\x20\x09-\x0D]"


def _words(text: Column) -> Column:
    return F.filter(F.split(text, _SPACE + "+"), lambda w: w != "")


def _bare(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, rf"(?<!{_WORD}){_MARK}++(?=[\p{{L}}\p{{N}}])|(?<=[\p{{L}}\p{{N}}]){_MARK}++(?!{_WORD})", ""))


def template(text: Column) -> Column:
    """The template of a text; it has as many words as the text."""
    text = F.regexp_replace(text, rf"(?<!{_WORD})[+$€-]?\d[\d.,:/]*+%?[.,;:!?]?(?!{_WORD})", "<num>")
    text = F.regexp_replace(text, rf"(?<!{_WORD})<num>({_SPACE}++)(?i:{UNITS})[.,;:!?]?(?!{_WORD})", "<num>$1<unit>")
    text = F.regexp_replace(text, rf"(?<=[^.!?:\x20\x09-\x0D]{_SPACE})\p{{Lu}}\p{{Ll}}{_WORD}*+", "<name>")
    return _bare(text)


def _rolled(df: DataFrame, col: str, step: int, to: str) -> DataFrame:
    """Column ``to``: hashes of 2 * step words, from ``col`` with hashes of step words."""
    n = F.greatest(F.size(col) - step, F.lit(0))
    return df.withColumn(to, F.zip_with(F.slice(col, 1, n), F.slice(col, step + 1, n), lambda a, b: F.xxhash64(a, b)))


def _windows(df: DataFrame, width: int) -> DataFrame:
    """Rows (id, pos, h) of the windows of ``width`` words; df has id and t, the template's words."""
    df = df.select("id", F.transform("t", lambda w: F.xxhash64(w)).alias("h1"))
    step = 1
    while step < width:
        df = _rolled(df, f"h{step}", step, f"h{2 * step}").drop(f"h{step}")
        step *= 2
    # The outer form keeps Spark from testing the size of the array first, which would compute it several times.
    return df.select("id", F.posexplode_outer(f"h{width}").alias("pos", "h")).filter("h IS NOT NULL")


def _hits(docs: DataFrame, own: DataFrame, width: int) -> DataFrame:
    """Windows of ``docs`` (doc_id, pos, h) with the rows of ``own`` that have the same h."""
    hits = _windows(docs, width).select(F.col("id").alias("doc_id"), "pos", "h")
    keys = own.select("h").distinct()
    if keys.count() <= BROADCAST_KEYS:  # beyond it, a shuffled join on the hash does it all
        hits = hits.join(F.broadcast(keys), "h", "left_semi")
    return hits.join(own, "h")


def _verbatim(docs: DataFrame, items: DataFrame, usable: DataFrame, width: int, share: int) -> DataFrame:
    """(doc_id, item_id, n_windows, item_windows) where all of an item's windows of plain words are found, or ``share`` percent
    of those of items that aren't among the ``usable`` ones."""
    own = _windows(items, width).select(F.col("id").alias("item_id"), "h").distinct()
    own = own.join(own.groupBy("item_id").agg(F.count(F.lit(1)).alias("item_windows")), "item_id")
    own = materialize(own.join(usable.withColumn("least", F.lit(100)), "item_id", "left").withColumn("least", F.coalesce("least", F.lit(share))))
    sums = _hits(docs, own, width).groupBy("doc_id", "item_id").agg(F.count_distinct("h").alias("n_windows"), F.first("item_windows").alias("item_windows"), F.first("least").alias("least"))
    return sums.filter("100 * n_windows >= least * item_windows").drop("least")


def _whole_lines(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) where a line of the document is the item, in plain words; for items of one to three words."""
    lines = F.transform(F.split(F.col("text"), "\n"), lambda x: F.array_join(_words(_bare(x)), " "))
    lines = docs.select(F.col("id").alias("doc_id"), F.explode(F.array_distinct(F.filter(lines, lambda x: x != ""))).alias("line"))
    own = items.select(F.col("id").alias("item_id"), F.array_join("b", " ").alias("line"))
    return lines.join(own, "line").select("doc_id", "item_id").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_percent: int = MIN_PERCENT) -> DataFrame:
    docs = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").alias("id"), "text")
    items = benchmark.filter("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").alias("id"), "text").distinct()
    items = materialize(items.select("id", _words("text").alias("w"), _words(template(F.col("text"))).alias("t"), _words(_bare(F.col("text"))).alias("b")))
    as_words = docs.select("id", _words(template(F.col("text"))).alias("t"))
    as_plain = docs.select("id", _words(_bare(F.col("text"))).alias("t"))
    found = verbatim = None
    for width, own in ((8, items.filter("size(t) >= 8")), (4, items.filter("size(t) BETWEEN 4 AND 7"))):
        if width == 4 and not own.limit(1).count():
            continue
        share = min_percent if width == 8 else 100
        bare_words = own.select("id", F.col("b").alias("t"))
        own = _windows(own, width).join(own.select(F.col("id").alias("i"), "t", "w"), F.col("id") == F.col("i"))
        slot = F.transform(F.slice("t", F.col("pos") + 1, width), lambda w: w.rlike("^<(?:num|unit|name)>$"))
        values = F.transform(F.filter(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.get("slot", k)), lambda k: F.struct(k.alias("k"), F.get("w", F.col("pos") + k).alias("v")))
        own = own.withColumn("slot", slot).withColumn("slots", values).withColumn("heavy", F.min(F.size("slots")).over(Window.partitionBy("id")) > width // 2)
        own = own.filter(F.size("slots") <= F.when(F.col("heavy"), width - 1).otherwise(width // 2)).groupBy(F.col("id").alias("item_id"), "heavy", "h", "slots").agg(F.collect_set("pos").alias("ats"), F.max(F.size("t")).alias("item_words"))
        own = own.join(own.groupBy("item_id").agg(F.count_distinct("h").alias("item_windows")), "item_id")
        own = materialize(own)
        exact = _verbatim(as_plain, bare_words, own.select("item_id").distinct(), width, share)
        verbatim = exact if verbatim is None else verbatim.unionByName(exact)
        hits = _hits(as_words, own, width).select("doc_id", "item_id", "heavy", "h", "pos", "slots", "ats", "item_words", "item_windows", F.lit(share).alias("share"))
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = docs.limit(0).selectExpr("id AS doc_id", "0L AS item_id", "false AS heavy", "0L AS h", "0 AS pos", "array(struct(0 AS k, '' AS v)) AS slots", "array(0) AS ats", "0 AS item_words", "0L AS item_windows", "0 AS share")
    found = materialize(found)
    pair = ["doc_id", "item_id"]
    plain = F.when(F.size("slots") == 0, F.col("h"))
    sums = found.groupBy(*pair).agg(F.count_distinct("h").alias("n_windows"), F.count_distinct(plain).alias("n_plain"), F.first("item_windows").alias("item_windows"), F.first("share").alias("share"), F.first("heavy").alias("heavy"), F.max(F.size("slots")).alias("slotted"))
    sums = materialize(sums.filter("100 * n_windows >= share * item_windows"))
    # Values of slots are looked up only for candidates that have some.
    open_ = found.filter("size(slots) > 0").join(sums.filter("slotted > 0").select(*pair), pair, "left_semi").select(*pair, "pos", "ats", "item_words", F.explode("slots").alias("s"))
    texts = docs.join(sums.filter("slotted > 0").select(F.col("doc_id").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("d"), _words("text").alias("words"))
    bare = lambda c: F.lower(F.regexp_replace(c, r"^[^\p{L}\p{N}%]+|[^\p{L}\p{N}%]+$", ""))
    values = open_.join(texts, F.col("doc_id") == F.col("d")).select(*pair, "pos", "ats", "item_words", bare(F.col("s.v")).alias("ours"), bare(F.get("words", F.col("pos") + F.col("s.k"))).alias("theirs"))
    values = materialize(values)

    def told(rows: DataFrame, by: list[str]) -> DataFrame:
        return rows.groupBy(*by).agg(F.count_distinct("ours", "theirs").alias("n_slots"), F.count_distinct("ours").alias("n_ours"), F.count_distinct("theirs").alias("n_theirs"), F.count_distinct(F.when(F.col("ours") != F.col("theirs"), F.struct("ours", "theirs"))).alias("n_changed"))

    def placed(rows: DataFrame) -> DataFrame:
        """Rows by occurrence: k and o are the same for hits that one copy may have made. The position in the document less
        that in the item is the same throughout a verbatim copy; in halves of the item's length, shifted by a quarter too,
        a copy with words put in or left out stays together, and two copies never do."""
        half = F.greatest(F.floor(F.col("item_words") / 2), F.lit(2))
        rows = rows.join(unclear, pair, "left_semi").withColumn("off", F.explode(F.transform("ats", lambda at: F.col("pos") - at)))
        of = [F.col("off").cast("long"), F.floor(F.col("off") / half), F.floor((F.col("off") + F.floor(half / 2)) / half)]
        return rows.withColumn("at", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), o.alias("o")) for k, o in enumerate(of)]))).select("*", "at.k", "at.o")

    steady = (F.col("n_slots") == F.col("n_ours")) & (F.col("n_slots") == F.col("n_theirs")) & (~F.col("heavy") | (2 * F.col("n_changed") <= F.col("n_slots")))
    out = materialize(sums.join(told(values, pair), pair, "left").withColumn("kept", F.col("n_slots").isNull() | steady | F.expr("100 * n_plain >= share * item_windows")))
    # Where the slots of all copies together clash, each copy is looked at.
    unclear = out.filter("NOT kept").select(*pair, "heavy")
    here = placed(found).groupBy(*pair, "k", "o").agg(F.count_distinct("h").alias("n_here"), F.first("item_windows").alias("of"), F.first("share").alias("share")).filter("100 * n_here >= share * of").select(*pair, "k", "o", "n_here")
    copies = told(placed(values), [*pair, "k", "o"]).join(unclear, pair).filter(steady).join(here, [*pair, "k", "o"])
    copies = copies.groupBy(*pair).agg(F.max(F.struct("n_here", (-F.col("n_changed")).alias("less"), "n_slots")).alias("copy"))
    copies = copies.select(*pair, F.col("copy.n_slots").alias("n_slots"), (-F.col("copy.less")).alias("n_changed"))
    single = out.select(*pair, "n_windows", "item_windows").join(copies, pair)
    out = out.filter("kept").select(*pair, "n_windows", "item_windows", "n_slots", "n_changed").unionByName(single)
    if verbatim is not None:
        out = materialize(out)
        verbatim = verbatim.join(out.select(*pair), pair, "left_anti").select(*pair, "n_windows", "item_windows", F.lit(0).alias("n_slots"), F.lit(0).alias("n_changed"))
        out = out.unionByName(verbatim)
    short = items.filter("size(b) BETWEEN 1 AND 3 AND size(t) < 4")
    if short.limit(1).count():
        whole = _whole_lines(docs, short).select(*pair, F.lit(1).alias("n_windows"), F.lit(1).alias("item_windows"), F.lit(0).alias("n_slots"), F.lit(0).alias("n_changed"))
        out = out.unionByName(whole)
    return out.select(*pair, "n_windows", "item_windows", F.coalesce("n_slots", F.lit(0)).cast("long").alias("n_slots"), F.coalesce("n_changed", F.lit(0)).cast("long").alias("n_changed"))

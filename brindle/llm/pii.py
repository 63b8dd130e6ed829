"""Personal data and secrets by bootstrapped contextual extraction, in DataFrame operations only.

*Base.* Four kinds of identifier are found by pattern and check (email, ip with parts to 255, card with 13 to 19 digits and a right
Luhn sum, phone with 9 to 15 digits), leftmost and without overlap within a kind; matches that fail the check are dropped.

*Method.* Base entities are seeds, and so are random strings that stand quoted after an equals sign or colon or carry a known
key prefix, as a fifth kind, secret. An entity's instance is its text. Its lexical patterns are the two words before it, the one
before, the one after, and the ones on both sides (words lower-cased, quotes around the entity left out; a wildcard stands for all else). Candidates of no known kind
are words with four digits, an at sign (also written (at) or [at]) or sixteen mixed letters and digits, and groups of digits
parted by single spaces. Rounds over the bipartite graph of patterns and instances:

* a pattern's confidence for a kind is (its instances known to be of the kind) / (all its instances + 1), counted once for each
  text of an instance; patterns with ``min_support`` known instances and ``min_confidence`` are kept. Single-word patterns are
  broad and need ``BROAD_SUPPORT``;
* an instance becomes known when the patterns around it agree (noisy or of their confidences) and its characters suit the kind.

Rounds go on until no instance is added (``MAX_ROUNDS`` at most). Every mention of a newly known instance that overlaps no base span
becomes a span; so does a mention of a seed secret. Base spans always stay.

Patterns and instances travel as hashes and are joined after aggregation; nothing is gathered per pattern or text, and patterns
that hold very many instances aren't a join key of a shuffle. Texts without a digit or an at sign or "at" in brackets leave after
one scan. Positions are code points, ends exclusive. A null text counts as empty; repeated rows give repeated results; a null
doc_id is kept; extra columns are ignored, also where their names clash; an empty table gives an empty result; ties between kinds
go to the better scored, then to the first by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import join_hot, materialize

KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]
# Possessive forms of the patterns in the contract; they match the same, in linear time. An email starts where a run of its
# characters starts or where the match before ended; the other kinds can't start within such a run either.
_LOCAL = "[A-Za-z0-9._%+-]"
_KEY = "[A-Za-z0-9_+/=-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # a quoted string of sixteen characters or more after = or :, or one with the prefix of a public key format
    "secret": rf"(?<=[=:]\s?[\"']){_KEY}{{16,}}+(?=[\"'])|(?<!{_KEY})(?:AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|glpat-|xox[abps]-|sk-|eyJ){_KEY}{{16,}}+",
    "other": r"(?<!\S)(?=(?:[^\s\d]*+\d){4}|[^\s@]*+@|[^\s(\[]*+[(\[]at[)\]]|\S{16})\S++",
    "group": r"(?<!\S)[(0-9][0-9().-]*+(?:\x20[0-9().-]++)++(?!\S)",
}
MIN_SUPPORT, BROAD_SUPPORT, MIN_CONFIDENCE, MAX_ROUNDS = 3, 10, 0.75, 8
#: What the text of a discovered instance must look like to be of a kind.
SHAPES = {
    "email": r"^\S*[A-Za-z0-9]\S*(?:@|\(at\)|\[at\])\S*[A-Za-z]\S*$",
    "ip": r"^(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}|[0-9a-fA-F]{0,4}(?::[0-9a-fA-F]{0,4}){2,7})(?:[:/][0-9]{1,5})?$",
    "card": r"^(?:[0-9][\x20-]?){12,18}[0-9]$",
    "phone": r"^[+(]?(?:[0-9][\x20()./-]{0,2}){7,15}$",
    "secret": r"^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9_+/=.~!@#$%^&*-]{8,}$",
}
#: A seed secret mixes letters and digits like a random string: three changes between them or more.
_RANDOM = r"(?:[A-Za-z]+[^A-Za-z]*[0-9]+[^A-Za-z0-9]*){3}"
_DOC = ["doc_id", "th"]


def _luhn(digits: Column) -> Column:
    def add(total: Column, k: Column) -> Column:
        x = F.substring(digits, F.length(digits) - k + 1, F.lit(1)).cast("int")
        twice = F.when(x > 4, 2 * x - 9).otherwise(2 * x)
        return total + F.when(k % 2 == 0, twice).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: Column, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    card = F.when(n.between(13, 19), _luhn(digits)).otherwise(False)
    out = F.when(kind == "ip", match.rlike(rf"^{part}(?:\.{part}){{3}}$")).when(kind == "card", card).when(kind == "phone", n.between(9, 15))
    return out.when(kind == "secret", match.rlike(_RANDOM)).when(kind == "group", n.between(7, 19)).otherwise(True)


def mentions(docs: DataFrame) -> DataFrame:
    """Matches of all patterns that pass their checks: doc_id, th, kind, start, end, inst (hash of the text), suits (kinds whose
    shape the text has) and patterns (hashes of its lexical patterns; single words first)."""
    # U+0001 and U+0002 frame matches; both lie outside all patterns but "other", which drops them with other odd marks.
    text = F.translate("text", "\x01\x02", "\x03\x03")
    framed = [F.struct(F.lit(k).alias("kind"), F.split(F.regexp_replace(text, p, "\x01$0\x02"), "[\x01\x02]", -1).alias("parts")) for k, p in PATTERNS.items()]
    rows = docs.filter(F.col("text").rlike(r"[0-9@]|[(\[]at[)\]]")).select("doc_id", F.xxhash64("text").alias("th"), F.explode_outer(F.array(*framed)).alias("f")).filter("size(f.parts) > 1")
    rows = rows.select(*_DOC, "f.kind", F.posexplode_outer("f.parts").alias("i", "part"))
    # Of what lies between matches only its length and the words at its ends go on. A reversed text yields its last words in one step.
    odd = F.col("i") % 2 == 1
    ends = F.regexp_extract(F.reverse("part"), r"^[\"'(\[{<]*+\s*+(\S++(?:\s++\S++)?)", 1)
    last = F.lower(F.reverse(F.regexp_replace(ends, r"\s++", " ")))
    between = F.when(~odd, F.struct(F.xxhash64(last).alias("two"), F.xxhash64(F.substring_index(last, " ", -1)).alias("one"), F.xxhash64(F.lower(F.regexp_extract("part", r"^[\"')\]}>,;]*+\s*+(\S++)", 1))).alias("next"), (F.length(F.trim(last)) == 0).alias("none")))
    rows = rows.select(*_DOC, "kind", "i", F.length("part").alias("n"), F.when(odd, F.col("part")).alias("text"), between.alias("gap"))
    rows = rows.dropDuplicates([*_DOC, "kind", "i"])  # of repeated rows
    order = Window.partitionBy(*_DOC, "kind").orderBy("i")
    rows = rows.withColumns({"start": F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "before": F.lag("gap").over(order), "after": F.lead("gap").over(order)})
    rows = rows.filter("i % 2 = 1")
    # quotes and brackets around a word aren't part of it
    head = F.when(F.col("kind") == "other", F.length(F.regexp_extract("text", r"^[\"'(\[{<]*+", 0))).otherwise(0)
    bare = F.when(F.col("kind") == "other", F.regexp_replace(F.regexp_replace("text", r"^[\"'(\[{<]++", ""), r"[^\p{L}\p{N}\]})=]++$|[\"'}>]++\S{0,3}$", "")).otherwise(F.col("text"))
    rows = rows.withColumns({"start": F.col("start") + head, "text": bare}).filter((F.length("text") > 0) & _valid(F.col("kind"), F.col("text")))
    rows = rows.filter((F.col("kind") != "other") | F.col("text").rlike(r"(?:\D*\d){4}|@|[(\[]at[)\]]") | F.col("text").rlike(_RANDOM))
    one, two, after = F.col("before.one"), F.col("before.two"), F.col("after.next")
    found = F.array(F.xxhash64(F.lit("one"), one), F.xxhash64(F.lit("after"), after), F.xxhash64(F.lit("two"), two), F.xxhash64(F.lit("both"), one, after))
    suits = F.array(*[F.col("text").rlike(p) for p in SHAPES.values()])
    kind = F.when(F.col("kind") == "group", "other").otherwise(F.col("kind"))
    return rows.select(*_DOC, kind.alias("kind"), F.col("start").cast("long").alias("start"), (F.col("start") + F.length("text")).cast("long").alias("end"), F.xxhash64("text").alias("inst"), suits.alias("suits"), F.when(~F.coalesce("before.none", F.lit(True)), found).otherwise(F.array()).alias("patterns"))


def bootstrap(edges: DataFrame, min_support: int = MIN_SUPPORT, broad_support: int = BROAD_SUPPORT, min_confidence: float = MIN_CONFIDENCE, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(inst, kind) of the instances that the graph reveals. edges: inst, kind ('other' where unknown), suits, pattern, broad."""
    edges = materialize(edges)
    seeds = edges.filter("kind <> 'other'").select("inst", "kind").distinct()
    graph = materialize(edges.select("inst", "pattern").distinct())
    total = edges.groupBy("pattern").agg(F.count_distinct("inst").alias("total"), F.first("broad").alias("broad"))
    total = materialize(total.filter(F.col("total") >= min_support))
    open_ = edges.filter("kind = 'other'").select("inst", "suits", "pattern").distinct().join(seeds.select("inst").distinct(), "inst", "left_anti")
    open_ = materialize(open_.join(total.select("pattern"), "pattern", "left_semi"))
    known, n_found = materialize(seeds), 0
    found = known.limit(0)
    for _ in range(max_rounds):
        hits = graph.join(known, "inst").groupBy("pattern", "kind").agg(F.count_distinct("inst").alias("hits"))
        good = hits.join(total, "pattern").filter(F.col("hits") >= F.when(F.col("broad"), broad_support).otherwise(min_support))
        good = good.select("pattern", "total", "kind", (F.col("hits") / (F.col("total") + 1)).alias("conf")).filter(F.col("conf") >= min_confidence)
        # a pattern may be good for one kind alone, as its confidence is above a half
        told = join_hot(open_, materialize(good), ["pattern"], "total").filter(F.element_at("suits", sum(F.when(F.col("kind") == k, i).otherwise(0) for i, k in enumerate(SHAPES, 1))))
        score = 1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("conf"), F.lit(1e-6)))))
        best = told.groupBy("inst", "kind").agg(score.alias("score")).groupBy("inst").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"))
        found = materialize(best)
        n, n_found = n_found, found.count()
        if n_found <= n:
            break
        known = materialize(seeds.unionByName(found))
    return found


def find_pii(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_email, n_ip, n_card, n_phone (base), base_sha256, spans (all), n_learned (spans that the method
    adds), n_secret (those of secrets) and n_spans."""
    seen = materialize(mentions(docs))
    base = seen.filter(F.col("kind").isin(*BASE_KINDS))
    inside = base.select(*[F.col(c).alias(f"b_{c}") for c in (*_DOC, "start", "end")])
    same = F.col("doc_id").eqNullSafe(F.col("b_doc_id")) & (F.col("th") == F.col("b_th"))
    free = seen.filter(~F.col("kind").isin(*BASE_KINDS)).join(inside, same & (F.col("start") < F.col("b_end")) & (F.col("b_start") < F.col("end")), "left_anti")
    # A word that holds a seed secret is the same mention.
    strong = free.filter("kind = 'secret'").select(*[F.col(c).alias(f"b_{c}") for c in (*_DOC, "start", "end")])
    others = free.filter("kind = 'other'").join(strong, same & (F.col("start") < F.col("b_end")) & (F.col("b_start") < F.col("end")), "left_anti")
    others = materialize(others.unionByName(free.filter("kind = 'secret'")))
    edges = base.unionByName(others).select("inst", "kind", "suits", F.posexplode("patterns").alias("k", "pattern")).select("inst", "kind", "suits", "pattern", (F.col("k") < 2).alias("broad")).distinct()
    found = bootstrap(edges)
    learned = others.filter("kind = 'other'").drop("kind").join(found, "inst").select(*_DOC, "kind", "start", "end")
    learned = learned.unionByName(others.filter("kind = 'secret'").select(*_DOC, "kind", "start", "end"))
    # of overlapping learned spans of one kind (a word, and a digit group that holds it) the one that starts first and ends last
    order = Window.partitionBy(*_DOC, "kind").orderBy("start", F.desc("end"))
    learned = learned.withColumn("reach", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))).filter(F.col("reach").isNull() | (F.col("start") >= F.col("reach"))).drop("reach")
    spans = base.select(*_DOC, "kind", "start", "end", F.lit(True).alias("base")).unionByName(learned.withColumn("base", F.lit(False)))
    rank = sum(F.when(F.col("kind") == k, i).otherwise(0) for i, k in enumerate(KINDS))
    one = F.struct(rank.alias("r"), "start", "end", F.concat_ws(":", "kind", "start", "end").alias("s"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(c), lambda x: x.s), ",")
    count = lambda k: F.count_if((F.col("kind") == k) & F.col("base")).alias(f"n_{k}")
    more = [F.count_if(~F.col("base")).alias("n_learned"), F.count_if(F.col("kind") == "secret").alias("n_secret"), F.count(F.lit(1)).alias("n_spans")]
    per = spans.groupBy(*_DOC).agg(*[count(k) for k in BASE_KINDS], F.collect_list(F.when(F.col("base"), one)).alias("b"), F.collect_list(one).alias("a"), *more)
    names = [*[f"n_{k}" for k in BASE_KINDS], "n_learned", "n_secret", "n_spans"]
    per = per.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), joined("b").alias("b"), joined("a").alias("a"), *names)
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"))
    out = rows.join(per, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", *[number(n) for n in names[:4]], F.sha2(text("b"), 256).alias("base_sha256"), text("a").alias("spans"), *[number(n) for n in names[4:]])

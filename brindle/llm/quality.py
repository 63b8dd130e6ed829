"""Quality rules: counts over a document's words, and the fertility of public tokenisers on it.

``quality_rules(docs)`` adds to each row of (doc_id, text, lang if there is one):

* base counts: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed;
* fertility under two public vocabularies: of a byte-level one for many languages n_tokens, chars_per_token and entropy (bits a
  token of the document's own token distribution), of a sentence-piece one byte_share, the share of characters that it can only
  spell by byte fallback;
* script (the one that holds more than half of all letters, else "other") and kept: not base_failed, and every measure in its band.

*Bands.* A document must lie within ``LIMITS``, fixed and wide, by script: outside them a vocabulary can't read the text at all.
It must also lie within the bands of its language and script, which come from the corpus: median +- ``SPREADS`` robust standard
deviations (quartile distance / 1.349) of the documents that pass the base rules, all of them, by mergeable quantile sketches.
Junk of up to a quarter of a group doesn't move them much. A group (lang, script) of under ``MIN_GROUP`` documents, or one
without a language, takes the bands of its script; a script of under ``MIN_GROUP`` has the fixed limits alone.

Null text counts as empty (all counts 0, base_failed). Ties do not arise; repeated rows give repeated results and weigh as
often; other columns are ignored, also where their names clash (keep_documents returns them as they are); an empty table gives an
empty result. Memory is bounded by one slice of texts (or the longest text).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import join_hot, materialize, per_slice

#: Limits [low, high] by script; "other" is for scripts that have no row. Wide on purpose: outside them a text is unreadable.
LIMITS = {
    "latin": {"chars_per_token": (1.2, 12.0), "byte_share": (0.0, 0.2), "entropy": (2.5, 16.0)},
    "cyrillic": {"chars_per_token": (1.0, 12.0), "byte_share": (0.0, 0.3), "entropy": (2.5, 16.0)},
    "greek": {"chars_per_token": (0.5, 12.0), "byte_share": (0.0, 0.9), "entropy": (2.5, 16.0)},
    "cjk": {"chars_per_token": (0.25, 8.0), "byte_share": (0.0, 0.98), "entropy": (2.0, 16.0)},
    "other": {"chars_per_token": (0.15, 12.0), "byte_share": (0.0, 1.0), "entropy": (2.0, 16.0)},
}
#: Half-width of fitted bands in robust standard deviations, and documents that a group needs for bands of its own.
SPREADS, MIN_GROUP = 4.0, 200
#: The least standard deviation of a measure, so that a group of like texts doesn't get bands of no width.
LEAST_SPREAD = {"chars_per_token": 0.05, "byte_share": 0.02, "entropy": 0.1}
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"
MEASURES = "n_tokens long, chars_per_token double, byte_share double, entropy double, script string"
_NAMES = [c.split()[0] for c in f"{BASE}, {MEASURES}".split(", ")]
_SYMBOLS, _BLANK = "#*$%&|<>", " \t\n\v\f\r"
#: Ranges of code points (first, last) of the scripts that have limits of their own.
_SCRIPTS = {"latin": ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F)), "greek": ((0x370, 0x3FF),), "cyrillic": ((0x400, 0x52F),), "cjk": ((0x3040, 0x30FF), (0x3400, 0x9FFF), (0xAC00, 0xD7A3))}


def vocabulary_paths(ranks: str = "byte_bpe_multi_50k.tiktoken", pieces: str = "piece_bpe_32k.model") -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(ranks), public_tokenizers.path(pieces)


class Fertility:
    """Tokens of texts under a byte-level vocabulary for many languages, and characters that a sentence-piece one can't spell."""

    def __init__(self, ranks: str, pieces: str):
        import base64

        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("multi", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        sp = sentencepiece.SentencePieceProcessor(model_file=pieces)
        # A character falls back to bytes when it is no piece: merges start from pieces of one character.
        self.falls = np.ones(0x110000, dtype=bool)
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if len(piece) == 1:
                self.falls[ord(piece)] = False
        self.letters = _letters()

    def tokens(self, words: list[bytes]) -> np.ndarray:
        """Token numbers of the words with a space before each."""
        cuts = [0, len(words)]
        if sum(map(len, words)) > self.STRETCH:
            ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)))
            cuts = sorted({*np.searchsorted(ends, np.arange(0, ends[-1], self.STRETCH)).tolist(), len(words)})
        ids: list[int] = []
        for a, b in zip(cuts, cuts[1:]):
            ids += self.encoding.encode_ordinary(" " + b" ".join(words[a:b]).decode("utf-8", "replace"))
        return np.array(ids, dtype=np.int64)

    #: Bytes of words, or one word, handed to the vocabulary at once: no token crosses a space.
    STRETCH = 200_000


def _letters() -> np.ndarray:
    """For each code point 0 if it is no letter, else 1 + the place of its script in _SCRIPTS, or 1 + their number."""
    kind = np.fromiter(map(str.isalpha, map(chr, range(0x110000))), dtype=np.uint8, count=0x110000)
    other = kind > 0
    kind[other] = 1 + len(_SCRIPTS)
    for k, ranges in enumerate(_SCRIPTS.values(), 1):
        for first, last in ranges:
            kind[first : last + 1][other[first : last + 1]] = k
    return kind


def _characters(text: str, fertility: Fertility) -> tuple[str, float]:
    """Script of most of the letters, and share of the characters, white space apart, that the pieces can't spell."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    counts = np.bincount(fertility.letters[points], minlength=2 + len(_SCRIPTS))[1:]
    best = int(counts.argmax())
    blank = sum(map(text.count, _BLANK))
    falls = int(fertility.falls[points].sum()) - sum(text.count(c) for c in _BLANK if fertility.falls[ord(c)])
    return [*_SCRIPTS, "other"][best] if 2 * counts[best] > counts.sum() else "other", falls / (len(text) - blank) if len(text) > blank else 0.0


def repeated_words(ids: np.ndarray) -> int:
    """Words that lie in a 3-word window found twice or more."""
    n = len(ids)
    if n < 4:
        return 0
    base = np.int64(ids.max()) + 1
    pair = ids[:-1] * base + ids[1:]
    if base >= 1 << 20:
        pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    windows = pair[:-1] * base + ids[2:]
    ordered = np.sort(windows)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    starts = np.flatnonzero(np.isin(windows, twice))
    covered = np.zeros(n, dtype=bool)
    for k in range(3):
        covered[starts + k] = True
    return int(covered.sum())


def measure(texts: list, fertility: Fertility) -> dict[str, list]:
    """All columns of BASE and MEASURES for a slice of texts."""
    texts = [t or "" for t in texts]
    words: list[bytes] = []
    ends = []
    for t in texts:
        words += t.encode("utf-8", "surrogatepass").split()  # bytes part at the same six characters as words do
        ends.append(len(words))
    codes = pd.factorize(np.array(words, dtype=object))[0].astype(np.int64) if words else np.zeros(0, dtype=np.int64)
    rows, start = [], 0
    for text, end in zip(texts, ends):
        own = codes[start:end]
        n = len(own)
        seen, dup = set(), 0
        for line in text.split("\n"):
            if line in seen:
                dup += 1
            elif line.strip(_BLANK):
                seen.add(line)
        chars = len(text) - sum(map(text.count, _BLANK))
        repeat = repeated_words(own)
        failed = n < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * n
        ids = fertility.tokens(words[start:end])
        start = end
        entropy = 0.0
        if len(ids):
            counts = np.bincount(ids) if len(ids) > 2000 else np.unique(ids, return_counts=True)[1]
            p = counts[counts > 0] / len(ids)
            entropy = float(-(p * np.log2(p)).sum()) + 0.0
        script, share = _characters(text, fertility)
        rows.append((n, chars, sum(map(text.count, _SYMBOLS)), dup, repeat, failed, len(ids), chars / len(ids) if len(ids) else 0.0, share, entropy, script))
    return dict(zip(_NAMES, map(list, zip(*rows)), strict=False))


def _measured(docs: DataFrame, carry: list[str], lang: str | None, vocabularies, prefix: str) -> DataFrame:
    """``carry`` with the measures of text, and the group that a document is judged in, all under ``prefix``; written."""
    ranks, pieces = vocabularies or vocabulary_paths()

    def make():
        fertility = Fertility(ranks, pieces)
        return lambda texts: (None, {prefix + k: v for k, v in measure(texts, fertility).items()})

    schema = ", ".join(prefix + c for c in f"{BASE}, {MEASURES}".split(", "))
    group = F.coalesce(F.col(lang).cast("string"), F.lit("")) if lang else F.lit("")
    held = docs.withColumn(f"{prefix}lang", group)
    return materialize(per_slice(held, [*carry, f"{prefix}lang"], "text", make, schema))


def fit_bands(measured: DataFrame, prefix: str = "", min_group: int = MIN_GROUP) -> DataFrame:
    """(lang, script, n, b): bands b of each group of at least ``min_group`` documents that pass the base rules; lang NULL is for
    all of a script."""
    col = lambda c: F.col(prefix + c)
    good = measured.filter(~col("base_failed"))
    aggs = [F.percentile_approx(col(m), [0.25, 0.5, 0.75], 10_000).alias(m) for m in LEAST_SPREAD]
    stats = good.select(col("lang").alias("lang"), col("script").alias("script"), *[col(m).alias(prefix + m) for m in LEAST_SPREAD])
    stats = stats.rollup("script", "lang").agg(F.count(F.lit(1)).alias("n"), *aggs).filter((F.col("n") >= min_group) & F.col("script").isNotNull())
    wide = {m: F.lit(SPREADS) * F.greatest((F.get(m, F.lit(2)) - F.get(m, F.lit(0))) / 1.349, F.lit(least)) for m, least in LEAST_SPREAD.items()}
    bands = [F.struct((F.get(m, F.lit(1)) - wide[m]).alias("low"), (F.get(m, F.lit(1)) + wide[m]).alias("high")).alias(m) for m in LEAST_SPREAD]
    return stats.select("lang", "script", "n", F.struct(*bands).alias("b"))


def _judged(measured: DataFrame, prefix: str, min_group: int) -> DataFrame:
    """``measured`` with the column ``prefix`` + kept."""
    bands = materialize(fit_bands(measured, prefix, min_group))
    lang, script = f"{prefix}lang", f"{prefix}script"
    own = bands.filter("lang IS NOT NULL AND lang <> ''").select(F.col("lang").alias(lang), F.col("script").alias(script), F.col("n").alias(f"{prefix}n"), F.col("b").alias(f"{prefix}own"))
    whole = bands.filter("lang IS NULL").select(F.col("script").alias(script), F.col("b").alias(f"{prefix}all"))  # five rows at most
    known = own.select(lang, script, F.lit(True).alias(f"{prefix}has"))
    if own.count() <= 10_000:
        held = measured.join(F.broadcast(own), [lang, script], "left")
    else:  # a language's rows don't meet in one task
        with_bands = join_hot(measured, own, [lang, script], f"{prefix}n")
        held = with_bands.unionByName(measured.join(known, [lang, script], "left_anti"), allowMissingColumns=True)
    held = held.join(F.broadcast(whole), script, "left")
    ok = ~F.col(f"{prefix}base_failed")
    for m in LEAST_SPREAD:
        b = F.coalesce(F.col(f"{prefix}own"), F.col(f"{prefix}all"))[m]
        ok &= F.coalesce(F.col(prefix + m).between(b["low"], b["high"]), F.lit(True))
    for s, limits in LIMITS.items():
        for m, (low, high) in limits.items():
            ok &= (F.col(script) != s) | F.col(prefix + m).between(low, high)
    return held.withColumn(f"{prefix}kept", ok)


def keep_documents(docs: DataFrame, vocabularies: tuple[str, str] | None = None, lang: str | None = "lang", min_group: int = MIN_GROUP) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that the rules keep."""
    prefix = "__quality_"
    measured = _measured(docs, docs.columns, lang if lang in docs.columns else None, vocabularies, prefix)
    return _judged(measured, prefix, min_group).filter(f"{prefix}kept").select(*[F.col(f"`{c}`") for c in docs.columns])


def quality_rules(docs: DataFrame, vocabularies: tuple[str, str] | None = None, lang: str | None = "lang", min_group: int = MIN_GROUP) -> DataFrame:
    """One row a document: doc_id, the base counts, kept, and the measures."""
    prefix = "__quality_"
    measured = _measured(docs, ["doc_id"], lang if lang in docs.columns else None, vocabularies, prefix)
    names = [*_NAMES[:6], "kept", *_NAMES[6:]]
    return _judged(measured, prefix, min_group).select("doc_id", *[F.col(prefix + c).alias(c) for c in names])

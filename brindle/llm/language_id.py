"""Language ID by a linear-chain conditional random field over words.

Each run of letters is a word (lower case) with a label, its language. Features of a word: its character n-grams up to three, with
marks at both ends (so affixes show), longer affixes of three and four letters, and the word itself (a lexicon), hashed to a
fixed table of weights. Transitions between labels are learned too. Forward-backward gives each word's label probabilities in its
sentence's context, so code-switched texts are labelled part by part; a document's score for a language is the mean over its words.

*Training* takes a bounded sample of labelled documents to the driver, whole texts: for each language an equal part of
``MAX_TRAIN_DOCS`` documents and of ``MAX_TRAIN_CHARS`` characters, in the order of a hash, so that rare languages are in it; documents
of over ``MAX_DOC_CHARS`` characters aren't drawn. Texts are cut into short stretches, and stretches of different languages
strung together, so that transitions are seen; the gradient of the log-likelihood comes from forward-backward. Text and language
are all that it learns from.

*Prediction* covers every word of every text. Long texts are cut into blocks of words whose transfer matrices are multiplied, which is
exact, so no text takes more than a few vectorised steps; memory is bounded by a slice of texts, smaller for more languages, or
the longest text.

A null text or one without letters (Unicode category L) is "und" with score 0; null languages aren't learned; with no labelled
document all is "und". Ids pass through as they are, null or not. Repeated rows give repeated results; ties go to the first language
by name; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import mix64, per_slice

MAX_TRAIN_DOCS, MAX_TRAIN_CHARS, MAX_DOC_CHARS = 3000, 12_000_000, 100_000
BITS, BLOCK, STEPS, BATCH, LENGTH = 17, 32, 300, 64, 24
#: Characters of these words are letters, but for a few numbers (a half, a superscript, a Roman numeral sign).
_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters (Unicode category L), lower case."""
    found = _LETTERS.findall(text.lower()) if text else []
    if all(map(str.isalpha, found)):
        return found
    return [part for w in found for part in (w if w.isalpha() else "".join(c if c.isalpha() else " " for c in w)).split()]


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all words on end, and where each word's begin."""
    points = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    ends = np.cumsum(sizes)
    starts = ends - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(ends, sizes) - np.arange(len(points))  # characters from here to the word's end
    found, owners = [], []
    gram = points.copy()
    whole = np.add.reduceat(mix64(points * np.uint64(0x9E3779B97F4A7C15) + (np.arange(len(points)) - starts[owner]).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)), starts)
    for n in range(1, 6):
        if n > 1:
            gram = gram[:-1] * np.uint64(0x100000001B3) + points[n - 1 :]
        at = np.flatnonzero(left[: len(gram)] >= n)
        if n > 3:  # affixes only
            at = at[(at == starts[owner[at]]) | (left[at] == n)]
        found.append(mix64(gram[at] + np.uint64(n * 0x632BE59BD9B4E019 % (1 << 64))))
        owners.append(owner[at])
    found.append(mix64(whole))
    owners.append(np.arange(len(words)))
    owners = np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    index = (np.concatenate(found)[order] >> np.uint64(64 - BITS)).astype(np.int64)
    return index, np.searchsorted(owners[order], np.arange(len(words)))


def emissions(words: list[str], weights: np.ndarray, step: int = 20_000) -> np.ndarray:
    out = [np.zeros((0, weights.shape[1]))]
    for a in range(0, len(words), step):
        index, starts = word_features(words[a : a + step])
        out.append(np.add.reduceat(weights[index], starts, axis=0).astype(np.float64))
    return np.concatenate(out)


def marginals(scores: np.ndarray, sizes: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Label probabilities of all words. scores: emissions of all words of all sequences on end; sizes: words of each (> 0)."""
    n_labels = scores.shape[1]
    A = np.exp(trans)
    n_blocks = -(-sizes // BLOCK)
    first = np.cumsum(n_blocks) - n_blocks
    nb = int(n_blocks.sum())
    begin = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(len(sizes)), sizes)
    inside = np.arange(len(scores)) - begin[doc]
    row, col = first[doc] + inside // BLOCK, inside % BLOCK
    E, real = np.ones((nb, BLOCK, n_labels)), np.zeros((nb, BLOCK), dtype=bool)
    E[row, col], real[row, col] = np.exp(scores - scores.max(axis=1, keepdims=True)), True
    opens = np.zeros(nb, dtype=bool)
    opens[first] = True

    def norm(x):
        return x / x.sum(axis=-1, keepdims=True)

    M = np.where(opens[:, None, None], np.eye(n_labels), A) * E[:, 0, None, :]
    for j in range(1, BLOCK):
        M = np.where(real[:, j, None, None], (M @ A) * E[:, j, None, :], M)
        M /= M.sum(axis=(1, 2), keepdims=True)
    into, after = np.full((nb, n_labels), 1.0 / n_labels), np.full((nb, n_labels), 1.0 / n_labels)
    order = np.argsort(-n_blocks, kind="stable")
    ranked = -n_blocks[order]
    top = int(n_blocks.max())
    for k in range(1, top):
        at = first[order[: np.searchsorted(ranked, -k)]] + k
        into[at] = norm(np.einsum("bi,bij->bj", into[at - 1], M[at - 1]))
    for k in range(top - 1, 0, -1):
        at = first[order[: np.searchsorted(ranked, -k)]] + k
        after[at - 1] = norm(np.einsum("bij,bj->bi", M[at], after[at]))
    alpha, beta = np.empty_like(E), np.empty_like(E)
    a = into
    for j in range(BLOCK):
        ahead = np.where(opens[:, None], a, a @ A) if j == 0 else a @ A
        a = np.where(real[:, j, None], norm(ahead * E[:, j]), a)
        alpha[:, j] = a
    b = after
    for j in range(BLOCK - 1, -1, -1):
        beta[:, j] = b
        b = np.where(real[:, j, None], norm((E[:, j] * b) @ A.T), b)
    return norm(alpha * beta)[row, col]


def train(texts: list[str], labels: list[str]) -> tuple[list[str], np.ndarray, np.ndarray] | None:
    """(languages, feature weights, transition weights); None without a labelled word."""
    rng = np.random.default_rng(7)
    names = sorted(set(labels))
    docs: dict[int, list[list[str]]] = {k: [] for k in range(len(names))}
    for t, lab in zip(texts, labels):
        if w := words_of(t):
            docs[names.index(lab)].append(w)
    names = [x for k, x in enumerate(names) if docs[k]]
    pools = [v for v in docs.values() if v]
    if not pools:
        return None
    vocab: dict[str, int] = {}
    coded = [[np.array([vocab.setdefault(w, len(vocab)) for w in d]) for d in pool] for pool in pools]
    index, starts = word_features(list(vocab))
    ends = np.append(starts[1:], len(index))
    n = len(pools)
    W, T = np.zeros((1 << BITS, n)), np.eye(n)
    gW, gT = np.full(W.shape, 1e-4), np.full(T.shape, 1e-4)
    for _ in range(STEPS if n > 1 else 0):
        ids, gold = np.empty((BATCH, LENGTH), dtype=np.int64), np.empty((BATCH, LENGTH), dtype=np.int64)
        for s in range(BATCH):
            at = 0
            while at < LENGTH:
                k = int(rng.integers(n))
                d = coded[k][int(rng.integers(len(coded[k])))]
                m = min(LENGTH - at, len(d), LENGTH if rng.random() < 0.4 else int(rng.integers(4, 13)))
                o = int(rng.integers(len(d) - m + 1))
                ids[s, at : at + m], gold[s, at : at + m] = d[o : o + m], k
                at += m
        uniq, back = np.unique(ids, return_inverse=True)
        back = back.reshape(ids.shape)
        lens = ends[uniq] - starts[uniq]
        feat = index[np.repeat(starts[uniq] - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())]
        own = np.repeat(np.arange(len(uniq)), lens)
        em = np.zeros((len(uniq), n))
        np.add.at(em, own, W[feat])
        score = em[back]
        E, A = np.exp(score - score.max(axis=2, keepdims=True)), np.exp(T)
        alpha, beta = np.empty_like(E), np.ones_like(E)
        alpha[:, 0] = E[:, 0] / E[:, 0].sum(axis=1, keepdims=True)
        for t in range(1, LENGTH):
            x = (alpha[:, t - 1] @ A) * E[:, t]
            alpha[:, t] = x / x.sum(axis=1, keepdims=True)
        for t in range(LENGTH - 2, -1, -1):
            x = (E[:, t + 1] * beta[:, t + 1]) @ A.T
            beta[:, t] = x / x.sum(axis=1, keepdims=True)
        gamma = alpha * beta
        gamma /= gamma.sum(axis=2, keepdims=True)
        pair = alpha[:, :-1, :, None] * A * (E[:, 1:] * beta[:, 1:])[:, :, None, :]
        pair /= pair.sum(axis=(2, 3), keepdims=True)
        truth = np.eye(n)[gold]
        hope_pair = np.einsum("sti,stj->ij", truth[:, :-1], truth[:, 1:])
        dT = (pair.sum(axis=(0, 1)) - hope_pair) / BATCH + 1e-3 * T
        dword = np.zeros((len(uniq), n))
        np.add.at(dword, back.ravel(), (gamma - truth).reshape(-1, n) / BATCH)
        touched, slot = np.unique(feat, return_inverse=True)
        dW = np.zeros((len(touched), n))
        np.add.at(dW, slot, dword[own])
        gW[touched] += dW * dW
        W[touched] -= 0.15 * dW / np.sqrt(gW[touched])
        gT += dT * dT
        T -= 0.1 * dT / np.sqrt(gT)
    return names, W.astype(np.float32), T


def predict(texts: list, model) -> list[tuple[str, float]]:
    names, W, T = model
    words, sizes = [], []
    for t in texts:
        own = words_of(t)
        words += own
        sizes.append(len(own))
    sizes = np.array(sizes, dtype=np.int64)
    out = [("und", 0.0)] * len(texts)
    has = np.flatnonzero(sizes)
    if not len(has):
        return out
    codes, uniques = pd.factorize(np.array(words, dtype=object))
    prob = marginals(emissions(list(uniques), W)[codes], sizes[has], T)
    starts = np.cumsum(sizes[has]) - sizes[has]
    mean = np.add.reduceat(prob, starts, axis=0) / sizes[has][:, None]
    best = mean.argmax(axis=1)
    for i, k, p in zip(has, best, mean[np.arange(len(has)), best]):
        out[i] = (names[k], float(min(1.0, p)))
    return out


def fit(labelled: DataFrame, max_docs: int = MAX_TRAIN_DOCS, max_chars: int = MAX_TRAIN_CHARS):
    """A model from rows (doc_id, text, lang). doc_id only picks the sample."""
    size = F.length("text").cast("long")
    part = labelled.filter("lang IS NOT NULL AND text IS NOT NULL").select(F.xxhash64("doc_id").alias("h"), size.alias("size"), "text", "lang").filter(F.col("size") <= MAX_DOC_CHARS)
    counts = part.groupBy("lang").count().collect()  # one row a language
    if not counts:
        return None
    docs, chars = max(1, max_docs // len(counts)), max_chars // len(counts)
    # Only hashes under a cut that leaves about twice a language's part are sorted, so few texts are moved.
    cuts = [(r["lang"], min((1 << 63) - 1, -(1 << 63) + int((1 << 64) * min(1.0, 2 * docs / r["count"])))) for r in counts]
    cuts = labelled.sparkSession.createDataFrame(cuts, "lang string, cut long")
    low = part.join(F.broadcast(cuts), "lang").filter("h <= cut")
    order = Window.partitionBy("lang").orderBy("h", "size", "text")
    low = low.withColumns({"nth": F.row_number().over(order), "before": F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1))})
    rows = low.filter((F.col("nth") <= docs) & (F.coalesce("before", F.lit(0)) <= chars)).orderBy("lang", "nth").select("text", "lang").collect()  # max_chars bounds it
    return train([r["text"] for r in rows], [r["lang"] for r in rows])


def identify_language(docs: DataFrame, model) -> DataFrame:
    """``docs`` (doc_id, text, held_out) with lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^BITS weights a language

    def make():
        known = shared.value

        def work(texts):
            got = predict(texts, known) if known else [("und", 0.0)] * len(texts)
            return None, {"lang_pred": [g[0] for g in got], "score": [g[1] for g in got]}

        return work

    n = len(model[0]) if model else 1
    # a block's transfer matrix has a cell for each pair of languages
    return per_slice(docs, ["doc_id", "held_out"], "text", make, "lang_pred string, score double", limit=max(50_000, 3_000_000 * 16 // max(16, n * n)))

"""Toxicity by a support vector machine over a gap-weighted subsequence string kernel, with Nystroem landmarks.

Strings are the words of a text (and runs of single letters, for insults that are spelt out). A string is known
by its subsequences of three characters, each weighted by DECAY to the power of the span it takes, up to SPAN
characters: inserted characters weaken a match and don't break it. The kernel of two strings is the scalar
product of these weights over the strings' norms of occurrences. Words get Nystroem features from landmark words,
and a linear SVM is trained on them from texts labelled as wholes: the most telling words of each toxic text are
its positive cases, chosen anew as the machine gets better; words of clean texts are negative, but for those that
toxic texts have much more often.

The machine's decision is linear in the landmarks' subsequences, so it is folded into one weight per triple of
characters; scoring looks these up for every distinct word of a text. A text's score is a logistic function of the
decisions of its worst words and of its number of words, since long clean texts have more chance likenesses.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jaglet.llm import wordhash as wh
from jaglet.llm.common import crc_mod, extended, over_batches, place, session_of, slices, table, text_view

DECAY, SPAN = 0.7, 5
LANDMARKS = 128
#: Bound of the labelled sample: about so many toxic and clean texts, by a hash of their ids, and words of each.
TOXIC, CLEAN, WORDS = 1500, 3000, 4000
#: Bounds of what is learnt from the sample's words: positive cases, clean words drawn and hardest clean words, words that
#: landmarks are spread over, and a word's bytes (longer ones are scored, but not learnt from).
POSITIVE, NEGATIVE, HARDEST, POOL, LONGEST = 1500, 3000, 600, 600, 200
CHUNK = 1 << 21
CACHE = 1 << 18
#: Decisions are cut off below this; the WORST highest of a text count, beside its length.
LOWEST, WORST = -0.8, 4
#: Weight of toxic texts with characters put into their worst words.
HIDDEN = 0.1
RESULT = "toxicity"

_classes = np.zeros(256, np.int64)  # letters, digits as one, accents by their last byte, 1 and 2 mark the ends
_classes[33:127] = 3
_classes[48:58] = 4
_classes[97:123] = np.arange(5, 31)
_classes[65:91] = np.arange(5, 31)
_classes[160:192] = _classes[128:160] = np.arange(40, 72)  # upper and lower case of Latin accents differ by 32
_steps = [(a, b) for b in range(2, SPAN) for a in range(1, b)]


def spell(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(classes, lengths): the characters of the spans of data, each between two end marks."""
    size = ends - starts
    total = size + 2
    first = np.cumsum(total) - total
    at = np.arange(total.sum()) - np.repeat(first, total)
    c = np.where(at == 0, 1, 2)
    inner = (at > 0) & (at <= np.repeat(size, total))
    c[inner] = _classes[data[(np.repeat(starts, total) + at - 1)[inner]]]
    keep = c > 0  # lead bytes of longer characters and blanks within runs go
    word = np.repeat(np.arange(len(size)), total)[keep]
    return c[keep], np.bincount(word, minlength=len(size))


def norms(lengths: np.ndarray) -> np.ndarray:
    """The norm of a string's occurrences, which only depends on its length."""
    n = np.asarray(lengths, np.float64)
    return np.sqrt(np.maximum(sum(np.maximum(n - b, 0) * DECAY ** (2 * (b + 1)) for _, b in _steps), 1e-12))


def triples(c: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(keys, word of each, weight) of all subsequences, one span shape at a time."""
    word = np.repeat(np.arange(len(lengths)), lengths)
    for a, b in _steps:
        n = len(c) - b
        if n <= 0:
            continue
        ok = word[:n] == word[b:]
        yield ((c[:n] << 14) | (c[a : a + n] << 7) | c[b:])[ok], word[:n][ok], DECAY ** (b + 1)


def products(c: np.ndarray, lengths: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Of each string, the sum of its subsequences' weights, over its norm."""
    total = np.zeros(len(lengths))
    for keys, word, w in triples(c, lengths):
        total += w * np.bincount(word, weights[keys], len(lengths))
    return total / norms(lengths)


def kernel(words: list[bytes], others: list[bytes]) -> np.ndarray:
    """The kernel of each word with each of the others."""
    c, n = _spelled(others)
    own = np.unique(np.concatenate([k for k, _, _ in triples(c, n)] or [np.zeros(0, np.int64)]))
    if not len(own):
        return np.zeros((len(words), len(others)))
    right = _dense(c, n, own)
    out = []
    for k in range(0, len(words), 256):
        out.append(_dense(*_spelled(words[k : k + 256]), own) @ right.T)
    return np.vstack(out)


def _dense(c: np.ndarray, n: np.ndarray, own: np.ndarray) -> np.ndarray:
    """(strings, len(own)) subsequence weights over the strings' norms, for the triples in own (sorted)."""
    out = np.zeros(len(n) * len(own))
    for keys, word, w in triples(c, n):
        at = np.searchsorted(own, keys)
        at[at == len(own)] = 0
        ok = own[at] == keys
        out += w * np.bincount(word[ok] * len(own) + at[ok], minlength=len(out))
    return out.reshape(len(n), len(own)) / norms(n)[:, None]


def _spelled(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"".join(words) or b"\0", np.uint8)
    ends = np.cumsum([len(w) for w in words], dtype=np.int64)
    return spell(data, ends - np.array([len(w) for w in words], np.int64), ends)


def _weights(landmarks: list[bytes], alpha: np.ndarray) -> np.ndarray:
    c, n = _spelled(landmarks)
    table_, g = np.zeros(1 << 21), alpha / norms(n)
    for keys, word, w in triples(c, n):
        table_ += np.bincount(keys, w * g[word], 1 << 21)
    return table_


class Scorer:
    """weights by triple and bias: a word's decision; logit: constant, and weights of what features() gives."""

    def __init__(self, weights: np.ndarray, bias: float, logit: np.ndarray):
        self.weights, self.bias, self.logit = weights.astype(np.float32), bias, logit
        self._seen = (np.zeros(0, np.uint64), np.zeros(0))

    def decisions(self, data, starts, ends) -> np.ndarray:
        return np.maximum(products(*spell(data, starts, ends), self.weights) + self.bias, LOWEST)

    def worst(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(texts, WORST) decisions of the worst words, highest first, LOWEST where there are fewer; numbers of words."""
        h, s, e, first = wh.words(data, offsets, wh.BLANKS)
        n = np.diff(first)
        text = np.repeat(np.arange(len(n)), n)
        rs, re_, rt = spelt_out(s, e, text)
        values = np.concatenate((self._cached(data, h, s, e), self.decisions(data, rs, re_) if len(rs) else np.zeros(0)))
        text = np.concatenate((text, rt))
        some = np.flatnonzero(values > LOWEST)
        values, text = values[some], text[some]
        order = np.lexsort((-values, text))
        values, text = values[order], text[order]
        rank = np.arange(len(text)) - np.searchsorted(text, text)
        out = np.full((len(n), WORST), LOWEST)
        lead = rank < WORST
        out[text[lead], rank[lead]] = values[lead]
        return out, n

    def _cached(self, data, h, s, e) -> np.ndarray:
        if not len(h):
            return np.zeros(0)
        own, at, back = np.unique(h, return_index=True, return_inverse=True)
        known, values = self._seen
        place = np.searchsorted(known, own)
        place[place == len(known)] = 0
        hit = known[place] == own if len(known) else np.zeros(len(own), bool)
        out = np.zeros(len(own))
        if hit.any():
            out[hit] = values[place[hit]]
        new = np.flatnonzero(~hit)
        for k in range(0, len(new), 1 << 14):
            part = new[k : k + (1 << 14)]
            out[part] = self.decisions(data, s[at[part]], e[at[part]])
        if len(known) + len(new) > CACHE:
            self._seen = (own, out)
        else:
            order = np.argsort(np.concatenate((known, own[new])), kind="stable")
            self._seen = (np.concatenate((known, own[new]))[order], np.concatenate((values, out[new]))[order])
        return out[back]

    def score(self, worst: np.ndarray, n: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit[0] + features(worst, n) @ self.logit[1:], -40, 40)))

    def __getstate__(self):
        return {"weights": self.weights, "bias": self.bias, "logit": self.logit, "_seen": (np.zeros(0, np.uint64), np.zeros(0))}


def features(worst: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.column_stack((worst, np.log1p(n)))


def spelt_out(s: np.ndarray, e: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, texts) of runs of three single characters or more."""
    single = e - s == 1
    chained = single[1:] & single[:-1] & (s[1:] - e[:-1] == 1) & (text[1:] == text[:-1])
    edge = np.flatnonzero(np.diff(np.concatenate(([0], chained.astype(np.int8), [0]))))
    lo, hi = edge[::2], edge[1::2]
    some = hi - lo >= 2
    return s[lo[some]], e[hi[some]], text[lo[some]]


def machine(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 0.02) -> np.ndarray:
    """Weights and bias (last) of the linear SVM with squared hinge loss, by Newton steps on the support vectors."""
    x = np.hstack((x, np.ones((len(x), 1))))
    w = np.zeros(x.shape[1])
    for _ in range(25):
        active = y * (x @ w) < 1
        xa, ca = x[active], cost[active]
        new = np.linalg.solve((xa * ca[:, None]).T @ xa + ridge * np.eye(len(w)), xa.T @ (ca * y[active]))
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    x = np.hstack((np.ones((len(x), 1)), x))
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (weight * p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, x.T @ (weight * (y - p)) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(bags: list[list[bytes]], toxic: np.ndarray, lengths: np.ndarray | None = None, rounds: int = 4, seed: int = 17) -> Scorer | None:
    """A scorer from the words of labelled texts, repeated ones as often as they occur; None unless both labels occur."""
    words = pa.array([w for b in bags for w in b], pa.binary())
    first = np.concatenate(([0], np.cumsum([len(b) for b in bags], dtype=np.int64)))
    return _train(words, first, toxic, np.diff(first) if lengths is None else lengths, rounds, seed)


def _train(words: pa.Array, first: np.ndarray, toxic: np.ndarray, lengths: np.ndarray, rounds: int = 4, seed: int = 17) -> Scorer | None:
    """train, for texts whose words are words[first[i]:first[i + 1]]."""
    if not toxic.any() or toxic.all() or not len(words):
        return None
    rng = np.random.default_rng(seed)
    coded = words.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    vocabulary = coded.dictionary.take(pa.array(order)).to_pylist()
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    numbers = number[coded.indices.to_numpy()]
    repeated = [numbers[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
    member = [np.unique(b) for b in repeated]
    c, n = _spelled(vocabulary)
    # how many toxic and clean texts have each word, and each triple without gaps
    keys, word, _ = next(iter(triples(c, n)))
    order = np.argsort(word, kind="stable")
    keys, cuts = keys[order], np.concatenate(([0], np.cumsum(np.bincount(word, minlength=len(n)))))
    df, wf, size = np.zeros((2, 1 << 21)), np.zeros((2, len(vocabulary))), np.array([(~toxic).sum(), toxic.sum()])
    for b, t in zip(member, toxic, strict=True):
        if len(b):
            df[int(t)][np.unique(np.concatenate([keys[cuts[i] : cuts[i + 1]] for i in b]))] += 1
            wf[int(t)][b] += 1
    odds = np.log((df[1] + 0.5) / (size[1] + 1)) - np.log((df[0] + 0.5) / (size[0] + 1))
    telling = wf[1] / size[1] > 4 * (wf[0] + (wf[0] > 0)) / size[0]  # far more often in toxic texts
    f = products(c, n, odds) / np.sqrt(norms(n))
    f[~telling] = f.min()
    negative = np.flatnonzero((wf[0] > 0) & ~telling)
    weights, bias = None, 0.0
    for _ in range(rounds):
        chosen = set()
        for b, t in zip(member, toxic, strict=True):
            if t and len(b):
                best = b[np.argsort(-f[b], kind="stable")]
                chosen.update(i for i in best[: 2 if weights is None else 6] if i == best[0] or weights is None or f[i] > 0)
        pos = np.array(sorted(i for i in chosen if telling[i]), np.int64)
        if not len(pos) or not len(negative):
            return None
        if len(pos) > POSITIVE:
            pos = rng.permutation(pos)[:POSITIVE]
        hard = negative[np.argsort(-f[negative], kind="stable")[:HARDEST]] if weights is not None else negative[:0]
        neg = np.unique(np.concatenate((hard, rng.permutation(negative)[:NEGATIVE])))
        marks = [vocabulary[i] for i in np.concatenate((_spread(vocabulary, pos, LANDMARKS * 3 // 4, rng), rng.permutation(neg)[: LANDMARKS // 4]))]
        cases = [vocabulary[i] for i in pos] + [gapped(vocabulary[i], rng) for i in pos] + [vocabulary[i] for i in neg]
        val, vec = np.linalg.eigh(kernel(marks, marks))
        root = vec[:, val > 1e-6] / np.sqrt(val[val > 1e-6])
        y = np.concatenate((np.ones(2 * len(pos)), -np.ones(len(neg))))
        w = machine(kernel(cases, marks) @ root, y, np.where(y > 0, 0.3, max(1.0, len(pos) / len(neg))))
        weights, bias = _weights(marks, root @ w[:-1]), float(w[-1])
        f = products(c, n, weights) + bias
    scorer = Scorer(weights, bias, np.zeros(2 + WORST))
    worst = np.full((len(repeated), WORST), LOWEST)
    for k, b in enumerate(repeated):
        top = np.sort(f[b])[::-1][:WORST]
        worst[k, : len(top)] = np.maximum(top, LOWEST)
    # toxic texts count once more with a character put into their worst words
    hidden = worst[toxic].copy()
    for k, b in enumerate([b for b, t in zip(repeated, toxic, strict=True) if t]):
        own = [gapped(vocabulary[i], rng) for i in b[np.argsort(-f[b], kind="stable")[:WORST]]]
        if own:
            hidden[k, : len(own)] = np.maximum(np.sort(products(*_spelled(own), weights) + bias)[::-1], LOWEST)
    x = np.vstack((features(worst, lengths), features(hidden, lengths[toxic])))
    y = np.concatenate((toxic, np.ones(len(hidden)))).astype(float)
    wt = np.concatenate((np.ones(len(toxic)), np.full(len(hidden), HIDDEN)))
    scorer.logit = logistic(x, y, weight=wt)
    return scorer


def gapped(word: bytes, rng: np.random.Generator) -> bytes:
    """The word with a character put in, as insults are hidden."""
    at = 1 + int(rng.integers(max(1, len(word) - 1)))
    while at < len(word) and word[at] & 0xC0 == 0x80:
        at += 1
    return word[:at] + b"-.*_x"[int(rng.integers(5)) :][:1] + word[at:]


def _spread(vocabulary: list[bytes], pool: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    """Up to size words of the pool, each the least like those before."""
    pool = rng.permutation(pool)[:POOL]
    words = [vocabulary[i] for i in pool]
    alike = kernel(words, words)
    picked, near = [0], alike[0].copy()
    while len(picked) < min(size, len(pool)):
        picked.append(int(near.argmin()))
        near = np.maximum(near, alike[picked[-1]])
    return pool[picked]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", toxic: int = TOXIC, clean: int = CLEAN) -> Scorer | None:
    """A scorer from a bounded, hash-chosen sample of the labelled documents; None unless both labels occur.

    Bounds: about `toxic` and `clean` documents, of each text WORDS distinct words chosen by hash over the whole text, and
    those named beside them. Null labels and ids are left out; a document with several labels is toxic if one says
    so. Rows of docs that repeat an id are cases of their own.
    """
    session_of(docs)
    marks = labels.where(F.col(f"`{label_col}`").isNotNull() & F.col(f"`{id_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").alias("__id")).agg(F.max(f"`{label_col}`").alias("__toxic"))
    sizes = {r["__toxic"]: r["count"] for r in marks.groupBy("__toxic").count().collect()}
    share = {t: min(1.0, (toxic if t else clean) / n) for t, n in sizes.items()}
    level = F.pmod(F.xxhash64("__id"), F.lit(1_000_003)) / 1_000_003.0
    some = marks.where(level < F.when(F.col("__toxic") > 0, share.get(1, 0.0)).otherwise(share.get(0, 0.0)))
    rows = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text")).join(F.broadcast(some), "__id").select("__id", "__toxic", "__text")

    def distinct(b: pa.RecordBatch) -> pa.RecordBatch:
        data, at = text_view(b.column(2))
        out, lengths = [], []
        for k in range(b.num_rows):
            h, s, e, _ = wh.words(data, at[k : k + 2], wh.BLANKS)
            _, i, n = np.unique(h, return_index=True, return_counts=True)
            lengths.append(len(h))
            i = np.repeat(i[:WORDS], np.minimum(n[:WORDS], WORST))  # by hash, so of all parts of the text
            out.append([data[x:y].tobytes().lower() for x, y in zip(s[i], e[i], strict=True) if y - x <= LONGEST])
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(pa.int32()), pa.array(lengths, pa.int64()), pa.array(out, pa.list_(pa.binary()))], ["id", "toxic", "n", "words"])

    found = over_batches(rows, distinct, T.StructType([T.StructField("id", rows.schema["__id"].dataType), T.StructField("toxic", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("words", T.ArrayType(T.BinaryType()))])).toArrow()
    found = found.sort_by([("id", "ascending"), ("toxic", "ascending"), ("n", "ascending")]).combine_chunks()
    if not found.num_rows:
        return None
    bags = found.column("words").combine_chunks()
    first = bags.offsets.to_numpy().astype(np.int64)
    return _train(bags.flatten(), first - first[0], found.column("toxic").to_numpy() > 0, found.column("n").to_numpy())


def score_toxicity(docs: DataFrame, scorer: Scorer | None, text_col: str = "text", keep: Iterable[str] | None = None) -> DataFrame:
    """docs (or its columns `keep`) with toxicity, 0 to 1; no shuffle.

    Null and wordless texts score as texts without a telling word; without a scorer every text scores 0. Rows are
    judged one by one, repeated ones alike; a column of docs named toxicity is replaced. An empty table gives an empty table.
    Texts may be of any length. Letters beyond Latin are known by their last byte modulo 32.
    """
    spark = session_of(docs)
    shared = spark.sparkContext.broadcast(scorer)

    def kernel_(b: pa.RecordBatch):
        m, scores = shared.value, np.zeros(b.num_rows)
        if m is not None:
            data, at = text_view(b.column(0))
            for i, j in slices(at, CHUNK):
                scores[i:j] = m.score(*m.worst(data, at[i : j + 1]))
        yield 0, b.num_rows, [pa.array(scores)]

    return extended(docs, kernel_, [T.StructField(RESULT, T.DoubleType())], [F.col(f"c{place(docs, text_col)}")], keep)


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    """The toxicity of every document; learnt from labelled ones whose crc32(doc_id) mod 3 isn't 1."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    scorer = fit(docs, labels.where(crc_mod(F.col("doc_id"), 3) != 1))
    scored = score_toxicity(docs, scorer, keep=["doc_id"])
    return scored.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), F.col(RESULT).alias("score"), (F.col(RESULT) >= 0.7).cast("int").alias("predicted"))

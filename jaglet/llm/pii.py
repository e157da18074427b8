"""Personal data in texts: exact patterns, and spans that a character BiLSTM-CRF adds to them.

The patterns (email, ip, card, phone) give the base spans; they always stay. A bidirectional LSTM over the
characters of whole texts, with a linear-chain CRF on top, is trained in numpy from base spans as labels, in a
bounded sample of documents, with spans respelled as people hide them ("name at host dot org", spaced digits, no
plus). It reads every text in overlapping windows. A window owns its middle; spans that lie there are kept, and
what windows of one text found is reconciled by score over the whole text. Where a span reaches over all that two
windows share, the text is read again in windows of twice the size, until the span is whole. An added span never touches a base span
nor a match of its own kind that the base rules dropped.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterable
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jaglet.llm.common import extended, materialize, over_batches, place, session_of, slices, table, text_view
from jaglet.llm.wordhash import mix

KINDS = ("email", "ip", "card", "phone")
HIDDEN, CHUNK = 8, 1 << 21
#: Windows have at most LENGTH characters and share OVERLAP: a span up to that long is whole in the window that owns it.
#: Their lengths are rounded up to STEP, so that many are read side by side, and cells are at most so many at once.
LENGTH, OVERLAP, STEP, CELLS = 1024, 128, 128, 1 << 19
#: Bound of the sample that the model is trained on: about so many documents, chosen by a hash of their ids.
SAMPLE = 3000
#: Of a document of the sample, chosen by hash: windows around so many base spans of a kind, and so many failed matches
#: and mistakes. Of all these windows so many with base spans, and so many others, are learnt from.
PER_KIND, FAILED, MISTAKES = 2, 2, 6
WITH_SPANS, WITHOUT_SPANS = 700, 900
#: An added span needs this mean advantage of its tag over "none", and this many characters.
MARGIN, SHORTEST = 2.0, 7
#: Digits that an added span has, by kind.
DIGITS = ((0, 99), (4, 12), (13, 19), (7, 15))
#: Rounds in which the model's own mistakes in the sample join the training windows.
MINED = 2
RESULT = "pii_spans"

# The base patterns. Digit runs are matched whole, which changes no match and keeps scans linear.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """([(kind, start, end)] by kind, then start; the matches that fail a check of their kind, likewise)."""
    out, dropped = [], []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        host = DOMAIN.match(text, at + 1) if start < at else None
        if host:
            done = host.end()
            out.append((0, start, done))
        at = text.find("@", max(at + 1, done))
    for m in IP.finditer(text):
        parts = [p.lstrip("0") or "0" for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p) <= 255 for p in parts):
            out.append((1, *m.span()))
        else:
            dropped.append((1, *m.span()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
        elif len(digits) >= 7:
            dropped.append((2, *m.span()))
    for m in PHONE.finditer(text):
        if 8 <= sum(c in "0123456789" for c in m[0]) <= 15:
            out.append((3, *m.span()))
        else:
            dropped.append((3, *m.span()))
    return out, dropped


_classes = np.full(256, 19, np.int8)
_classes[:128] = 18
for _k, _c in enumerate((" \t", "\n\r", "0123456789", "@", ".", "-", "+", "(", ")", "_", "%", ":", "/", '"', "'", "=", ",")):
    for _x in _c:
        _classes[ord(_x)] = _k + 1
_classes[97:123] = np.arange(20, 46)
_classes[65:91] = np.arange(20, 46)
CLASSES, DIGIT = 46, int(_classes[48])  # 0 pads


def classes_of(data: np.ndarray) -> np.ndarray:
    """The class of each code point of UTF-8 bytes."""
    return _classes[data[(data & 0xC0) != 0x80]]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * z) + 0.5


class Tagger:
    """A BiLSTM-CRF; tag 0 is none, tag k is KINDS[k - 1]."""

    def __init__(self, seed: int = 11, hidden: int = HIDDEN):
        rng = np.random.default_rng(seed)
        self.h = hidden
        tags = len(KINDS) + 1
        self.p = {"A": np.zeros((tags, tags)), "W": rng.normal(0, 0.3, (tags, 2 * hidden)), "b": np.zeros((tags, 1))}
        self.p["b"][0] = 2
        for d in "fb":
            self.p["P" + d] = rng.normal(0, 0.4, (4 * hidden, CLASSES))
            self.p["P" + d][hidden : 2 * hidden] += 1  # open forget gates
            self.p["U" + d] = rng.normal(0, 0.3, (4 * hidden, hidden))
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _lstm(self, d: str, x: np.ndarray, keep: bool):
        """Hidden states (T, H, B) of classes x (T, B) in the order given; with keep, what learning needs."""
        n, (steps, batch) = self.h, x.shape
        P, U = np.ascontiguousarray(self.p["P" + d]), np.ascontiguousarray(self.p["U" + d])
        P, U = P.copy(), U.copy()
        P[: 3 * n] *= 0.5
        U[: 3 * n] *= 0.5
        out = np.empty((steps, n, batch), np.float32)
        h, c = np.zeros((n, batch), np.float32), np.zeros((n, batch), np.float32)
        z, q = np.empty((4 * n, batch), np.float32), np.empty((4 * n, batch), np.float32)
        gates, cells = [], []
        for t in range(steps):
            np.matmul(U, h, out=z)
            np.take(P, x[t], axis=1, out=q, mode="clip")
            z += q
            np.tanh(z, out=z)
            g = z[: 3 * n]
            g *= 0.5
            g += 0.5
            if keep:
                gates.append(z.copy())
            c = c * z[n : 2 * n]
            z[:n] *= z[3 * n :]
            c += z[:n]
            if keep:
                cells.append(c)
            h = np.tanh(c, out=out[t])
            h *= z[2 * n : 3 * n]
        return out, gates, cells

    def _states(self, d: str, x: np.ndarray) -> np.ndarray:
        """Twice the hidden states of _lstm, in fewer steps: sigmoid(z) is (tanh(z / 2) + 1) / 2, its halves are put off."""
        n, (steps, batch) = self.h, x.shape
        P, U = self.p["P" + d].copy(), 0.5 * self.p["U" + d]
        P[: 3 * n] *= 0.5
        U[: 3 * n] *= 0.5
        out = np.empty((steps, n, batch), np.float32)
        h, c, half = np.zeros((n, batch), np.float32), np.zeros((n, batch), np.float32), np.float32(0.5)
        z, q = np.empty((4 * n, batch), np.float32), np.empty((4 * n, batch), np.float32)
        for t in range(steps):
            np.matmul(U, h, out=z)
            np.take(P, x[t], axis=1, out=q, mode="clip")
            z += q
            np.tanh(z, out=z)
            z[: 3 * n] += 1
            c *= z[n : 2 * n]
            z[:n] *= z[3 * n :]
            c += z[:n]
            c *= half
            h = np.tanh(c, out=out[t])
            h *= z[2 * n : 3 * n]
        return out

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """(T, tags, B) of classes x (T, B)."""
        n, half = self.h, np.float32(0.5)
        e = np.matmul(half * self.p["W"][:, :n], self._states("f", x))
        e += np.matmul(half * self.p["W"][:, n:], self._states("b", np.ascontiguousarray(x[::-1])))[::-1]
        e += self.p["b"]
        return e

    def viterbi(self, e: np.ndarray) -> np.ndarray:
        """The best tags (T, B) under the CRF."""
        steps, tags, batch = e.shape
        back = np.zeros((steps, tags, batch), np.int8)
        score = e[0]
        for t in range(1, steps):
            s = score[:, None, :] + self.p["A"][:, :, None]
            back[t] = s.argmax(0)
            score = s.max(0) + e[t]
        path = np.zeros((steps, batch), np.int8)
        path[-1] = score.argmax(0)
        cols = np.arange(batch)
        for t in range(steps - 1, 0, -1):
            path[t - 1] = back[t][path[t], cols]
        return path

    def maybe(self, e: np.ndarray) -> np.ndarray:
        """Columns whose best path may leave tag 0. In all others no stretch of tags can repay, so it can't."""
        A = self.p["A"]
        gain = (e[:, 1:].max(1) - e[:, 0]) + max(0.0, float(A[1:, 1:].max() - A[0, 0]))
        enter, leave = float(A[0, 1:].max() - A[0, 0]), float(A[1:, 0].max() - A[0, 0])
        inside = np.maximum(gain, 0).sum(0) + enter + leave
        ahead, behind = np.cumsum(gain, 0).max(0) + leave, np.cumsum(gain[::-1], 0).max(0) + enter
        return np.flatnonzero(np.maximum.reduce([inside, ahead, behind, gain.sum(0)]) > -1e-3)

    def learn(self, x: np.ndarray, y: np.ndarray, steps: int = 260, batch: int = 48, rate: float = 0.02, seed: int = 5) -> None:
        """Adam on the CRF's negative log-likelihood of windows x (N, T) with tags y."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(a) for k, a in self.p.items()}
        order = np.zeros(0, np.int64)
        for step in range(1, steps + 1):
            if len(order) < batch:
                order = np.concatenate((order, rng.permutation(len(x))))
            pick, order = order[:batch], order[batch:]
            g = self._gradients(x[pick].T, y[pick].T)
            lr = rate * min(1.0, 2.0 * (1 - step / (steps + 1)))
            for k, a in g.items():
                a = np.clip(a / len(pick), -1, 1)
                m[k] = 0.9 * m[k] + 0.1 * a
                v[k] = 0.99 * v[k] + 0.01 * a * a
                self.p[k] -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        n, (steps, batch) = self.h, x.shape
        f, gf, cf = self._lstm("f", x, True)
        rb, gb, cb = self._lstm("b", x[::-1], True)
        states = np.concatenate((f, rb[::-1]), 1)
        e = np.matmul(self.p["W"], states) + self.p["b"]
        de, dA = self._crf(e, y)
        g = {"A": dA, "W": np.einsum("tkb,thb->kh", de, states), "b": de.sum((0, 2))[:, None]}
        ds = np.matmul(self.p["W"].T, de)
        for d, dh, gates, cells, hs, xs in (("f", ds[:, :n], gf, cf, f, x), ("b", ds[::-1, n:], gb, cb, rb, x[::-1])):
            dz = np.zeros((steps, 4 * n, batch), np.float32)
            carry, dc = np.zeros((n, batch), np.float32), np.zeros((n, batch), np.float32)
            U = self.p["U" + d]
            for t in range(steps - 1, -1, -1):
                i, fo, o, c = (gates[t][k * n : (k + 1) * n] for k in range(4))
                th = np.tanh(cells[t])
                dht = dh[t] + carry
                dc = dht * o * (1 - th * th) + dc
                dz[t, :n] = dc * c * i * (1 - i)
                if t:
                    dz[t, n : 2 * n] = dc * cells[t - 1] * fo * (1 - fo)
                dz[t, 2 * n : 3 * n] = dht * th * o * (1 - o)
                dz[t, 3 * n :] = dc * i * (1 - c * c)
                dc = dc * fo
                carry = U.T @ dz[t]
            g["U" + d] = np.einsum("tzb,thb->zh", dz[1:], hs[:-1])
            one = np.zeros((CLASSES, steps * batch), np.float32)
            one[xs.ravel(), np.arange(steps * batch)] = 1
            g["P" + d] = (one @ dz.transpose(0, 2, 1).reshape(steps * batch, 4 * n)).T
        return g

    def _crf(self, e: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of the negative log-likelihood for emissions and transitions."""
        steps, tags, batch = e.shape
        A = self.p["A"][:, :, None].astype(np.float64)
        e = e.astype(np.float64)
        lse = lambda s: (lambda top: top[0] + np.log(np.exp(s - top).sum(0)))(s.max(0, keepdims=True))
        a, b = np.zeros_like(e), np.zeros_like(e)
        a[0] = e[0]
        for t in range(1, steps):
            a[t] = lse(a[t - 1][:, None] + A) + e[t]
        for t in range(steps - 2, -1, -1):
            b[t] = lse((A + (e[t + 1] + b[t + 1])[None]).transpose(1, 0, 2))
        z = lse(a[-1])
        de = np.exp(a + b - z)
        dA = np.zeros((tags, tags))
        for t in range(1, steps):
            dA += np.exp(a[t - 1][:, None] + A + (e[t] + b[t])[None] - z).sum(2)
        cols = np.arange(batch)
        for t in range(steps):
            de[t, y[t], cols] -= 1
            if t:
                np.subtract.at(dA, (y[t - 1], y[t]), 1)
        return de.astype(np.float32), dA.astype(np.float32)

    def tag(self, texts: list[np.ndarray], length: int = LENGTH, overlap: int = OVERLAP) -> list[list[tuple[int, int, int, float]]]:
        """(kind, start, end, score) of each text's classes, reconciled over its windows; equal texts are read once."""
        first: dict[bytes, int] = {}
        same = [first.setdefault(x.tobytes(), i) for i, x in enumerate(texts)]
        found = self._tag([texts[i] for i in first.values()], length, overlap)
        by = dict(zip(first.values(), found, strict=True))
        return [by[i] for i in same]

    def _tag(self, texts: list[np.ndarray], length: int, overlap: int) -> list[list[tuple[int, int, int, float]]]:
        out: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
        by: dict[int, list[tuple[int, int, int]]] = {}
        for i, x in enumerate(texts):
            # windows of one text are about equal, so few sizes are there and batches are wide
            n = max(1, -(-(len(x) - overlap) // (length - overlap)))
            most, s = -(-(len(x) + (n - 1) * overlap) // n), 0
            while len(x) >= SHORTEST:
                size = min(most, len(x) - s)
                step = STEP if most > STEP else 32
                by.setdefault(-(-most // step) * step, []).append((i, s, size))
                if s + size >= len(x):
                    break
                s += most - overlap
        cut = set()
        for steps, rows in by.items():
            wide = max(1, CELLS // steps)
            for k in range(0, len(rows), wide):
                part = rows[k : k + wide]
                x = np.zeros((steps, len(part)), np.int64)
                for c, (i, s, size) in enumerate(part):
                    x[:size, c] = texts[i][s : s + size]
                e = self.emissions(x)
                some = self.maybe(e)
                if not len(some):
                    continue
                e = np.ascontiguousarray(e[:, :, some])
                path = self.viterbi(e)
                lead = e - e[:, :1]
                for c, (i, s, size) in zip(range(len(some)), (part[j] for j in some), strict=True):
                    tags = np.concatenate(([0], path[:size, c], [0]))
                    edge = np.flatnonzero(tags[1:] != tags[:-1])
                    last = s + size >= len(texts[i])
                    lo = s + overlap // 2 if s else 0
                    hi = len(texts[i]) if last else s + size - overlap // 2
                    for a, b in zip(edge[:-1], edge[1:], strict=True):
                        kind = int(tags[a + 1])
                        if not kind:
                            continue
                        if b - a >= overlap and (a == 0 < s or (b == size and not last)) and (texts[i][s + a : s + b] == DIGIT).sum() <= DIGITS[kind - 1][1]:
                            cut.add(i)
                        if lo <= s + (a + b) // 2 < hi:
                            out[i].append((kind - 1, s + int(a), s + int(b), float(lead[a:b, kind, c].mean())))
        out = [apart(spans) for spans in out]
        if cut:
            again = sorted(cut)
            for i, spans in zip(again, self._tag([texts[i] for i in again], 2 * length, 2 * overlap), strict=True):
                out[i] = spans
        return out


def apart(spans: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int, float]]:
    """The spans by falling score, without those that overlap one before."""
    starts: list[int] = []
    held: list[tuple[int, int, int, float]] = []
    kept = []
    for x in sorted(spans, key=lambda x: (-x[3], x[1], x[0])):
        k = bisect.bisect_left(starts, x[1])
        if (k == 0 or held[k - 1][2] <= x[1]) and (k == len(held) or x[2] <= held[k][1]):
            starts.insert(k, x[1])
            held.insert(k, x)
            kept.append(x)
    return kept


class Taken:
    """Spans that may overlap; touches() says whether another one does, by binary search."""

    def __init__(self, spans: Iterable[tuple[int, int]]):
        rows = sorted(spans)
        self.starts, self.ends = [s for s, _ in rows], list(accumulate((e for _, e in rows), max))

    def touches(self, s: int, e: int) -> bool:
        k = bisect.bisect_left(self.starts, e)
        return k > 0 and self.ends[k - 1] > s


def respelled(text: str, kind: int, rng: np.random.Generator) -> str:
    """A personal datum as people write it to escape patterns."""
    way = int(rng.integers(3))
    if kind == 0:
        at, dot = ((" @ ", " . "), (" at ", " dot "), ("(at)", "."))[way]
        return text.replace("@", at).replace(".", dot)
    if kind == 1:
        return text.replace(".", (" . ", ". ", " .")[way])
    if kind == 2:
        return (".", "/", " - ")[way].join(text[k : k + 4] for k in range(0, len(text), 4))
    return text.lstrip("+").replace(" ", ("-", ".", " ")[way])


def examples(windows: Iterable[tuple[str, list[tuple[int, int, int]]]], size: int = 96, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Classes and tags (N, size) of windows of text with their base spans; every other one respelled."""
    rng = np.random.default_rng(seed)
    xs, ys = [], []
    for text, spans in windows:
        for change in (False, True) if spans else (False,):
            parts, tags, at = [], [], 0
            for kind, s, e in sorted(spans, key=lambda k: k[1]):
                if s < at:
                    continue
                new = respelled(text[s:e], kind, rng) if change and rng.random() < 0.6 else text[s:e]
                parts += [text[at:s], new]
                tags += [0] * (s - at) + [kind + 1] * len(new)
                at = e
            parts.append(text[at:])
            whole = "".join(parts)
            tags += [0] * (len(text) - at)
            x = classes_of(np.frombuffer(whole.encode(), np.uint8))[:size]
            xs.append(np.pad(x, (0, size - len(x)))), ys.append(np.pad(np.array(tags[:size], np.int8), (0, size - len(x))))
    return np.array(xs, np.int64).reshape(-1, size), np.array(ys, np.int64).reshape(-1, size)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Tagger | None:
    """A tagger of windows around base spans, and elsewhere, of about `sample` documents; None without a span."""
    spark = session_of(docs)
    total = docs.count()
    # rows without id go by their texts; rows that share a hash are one
    own, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    rows = docs.select(F.when(own.isNotNull(), F.xxhash64(own)).otherwise(F.xxhash64(text)).alias("h"), text.alias("t"))
    chosen = rows.where(F.pmod("h", F.lit(1_000_003)) < F.lit(1_000_003 * min(1.0, sample / max(1, total))))
    chosen = materialize(chosen.groupBy("h").agg(F.min("t").alias("t")), "sample")

    def cut(b: pa.RecordBatch) -> pa.RecordBatch:
        ids, windows, marks = [], [], []
        for h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            spans, dropped = base_spans(t or "")
            middles = [[(s + e) // 2 for k, s, e in spans if k == kind] for kind in range(len(KINDS))]
            places = [x for m in middles for x in _some(h, m, PER_KIND)] + _some(h, [(s + e) // 2 for _, s, e in dropped], FAILED) + [abs(h) % max(1, len(t or ""))]
            taken = Taken((s, e) for _, s, e in spans)
            for place in places:
                _window(t or "", h, place, spans, taken, ids, windows, marks)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(windows, pa.string()), pa.array(marks, pa.list_(pa.int32()))], ["h", "window", "marks"])

    labelled = lambda kernel: sorted((r["h"], r["window"], list(r["marks"])) for r in over_batches(chosen, kernel, "h long, window string, marks array<int>").collect())
    full = [(w, [tuple(m[k : k + 3]) for k in range(0, len(m), 3)]) for _, w, m in labelled(cut)]
    held = [x for x in full if x[1]]
    if not held:
        return None
    rng = np.random.default_rng(1)
    held = [held[i] for i in rng.permutation(len(held))[:WITH_SPANS]]
    rest = [x for x in full if not x[1]]
    rest = [rest[i] for i in rng.permutation(len(rest))[:WITHOUT_SPANS]]
    model = Tagger()
    model.learn(*examples([*held, *rest]), steps=280)
    for _ in range(MINED):
        wrong = [(w, [tuple(m[k : k + 3]) for k in range(0, len(m), 3)]) for _, w, m in labelled(_mistakes(spark.sparkContext.broadcast(model)))]
        rest += [wrong[i] for i in rng.permutation(len(wrong))[:WITHOUT_SPANS]]
        model.learn(*examples([*held, *rest]), steps=280, rate=0.01)
    return model


def _some(h: int, places: list[int], n: int) -> list[int]:
    """n of the places, chosen by hash, so from anywhere in the text."""
    if len(places) <= n:
        return places
    with np.errstate(over="ignore"):
        order = np.argsort(mix(np.array(places, np.int64).view(np.uint64) + np.uint64(h & 0xFFFFFFFFFFFFFFFF)), kind="stable")
    return [places[i] for i in order[:n]]


def _window(text: str, h: int, place: int, spans, taken: Taken, ids: list, windows: list, marks: list) -> None:
    """Add the window of 96 characters around the place, unless it is empty or cuts a base span."""
    lo = max(0, place - 24 - (h ^ place) % 48)
    hi = lo + 96
    if not text[lo:hi]:
        return
    first = bisect.bisect_left(taken.ends, lo + 1)
    last = bisect.bisect_left(taken.starts, hi)
    near = [x for x in sorted(spans, key=lambda x: x[1:])[first:last] if x[1] < hi and x[2] > lo] if first < last else []
    if any(not (lo <= s and e <= hi) for _, s, e in near):
        return
    ids.append(h), windows.append(text[lo:hi]), marks.append([x for k, s, e in near for x in (k, s - lo, e - lo)])


def _mistakes(shared):
    """Windows of the sample around what the model finds beside the base spans, with their base spans."""

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch:
        ids, windows, marks = [], [], []
        texts = [t or "" for t in b.column(1).to_pylist()]
        tagged = shared.value.tag([classes_of(np.frombuffer(t.encode(), np.uint8)) for t in texts])
        for h, t, found in zip(b.column(0).to_pylist(), texts, tagged, strict=True):
            base, _ = base_spans(t)
            taken = Taken((s, e) for _, s, e in base)
            for place in _some(h, [(s + e) // 2 for _, s, e, _score in found if not taken.touches(s, e)], MISTAKES):
                _window(t, h, place, base, taken, ids, windows, marks)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(windows, pa.string()), pa.array(marks, pa.list_(pa.int32()))], ["h", "window", "marks"])

    return kernel


def find_personal_data(docs: DataFrame, model: Tagger | None, text_col: str = "text", keep: Iterable[str] | None = None) -> DataFrame:
    """docs (or its columns `keep`) with pii_spans: kind, start, end (code points, end exclusive), base, by kind, then start.

    Base spans are those of the patterns; without a model there are no others. Null and empty texts have none.
    Rows are judged one by one; a column of docs named pii_spans is replaced. An empty table gives an empty table.
    """
    spark = session_of(docs)
    shared = spark.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
    fields = [T.StructField(n, t()) for n, t in (("kind", T.StringType), ("start", T.LongType), ("end", T.LongType), ("base", T.BooleanType))]

    def kernel(b: pa.RecordBatch):
        texts = b.column(0)
        data, at = text_view(texts)
        for i, j in slices(at, CHUNK):
            more = shared.value.tag([classes_of(data[at[k] : at[k + 1]]) for k in range(i, j)]) if shared.value else [[]] * (j - i)
            found = [[{"kind": KINDS[a], "start": s, "end": e, "base": c} for a, s, e, c in all_spans(texts[k].as_py() or "", more[k - i])] for k in range(i, j)]
            yield i, j, [pa.array(found, span)]

    return extended(docs, kernel, [T.StructField(RESULT, T.ArrayType(T.StructType(fields)))], [F.col(f"c{place(docs, text_col)}")], keep)


def all_spans(text: str, more: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int, bool]]:
    """The base spans of a text, and those of `more` that are let in beside them, by kind, then start."""
    base, dropped = base_spans(text)
    spans = [(kind, s, e, True) for kind, s, e in base]
    if more:
        # a match that failed as a card may well be a phone, and one that failed as an address a phone or a card
        taken = [Taken([(s, e) for _, s, e in base] + [(s, e) for failed, s, e in dropped if failed == kind]) for kind in range(len(KINDS))]
        for kind, s, e, score in more:
            while s < e and not text[s].isalnum() and text[s] != "+":
                s += 1
            while s < e and not text[e - 1].isalnum():
                e -= 1
            digits = sum(c.isdigit() for c in text[s:e])
            if score >= MARGIN and e - s >= SHORTEST and DIGITS[kind][0] <= digits <= DIGITS[kind][1] and not taken[kind].touches(s, e):
                spans.append((kind, s, e, False))
    return sorted(spans)


def _count(spans, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def op9_personal_data(spark, sf_dir: str) -> DataFrame:
    """Personal data in every document; counts and the hash are of base spans, spans are all."""
    docs = table(spark, sf_dir, "documents")
    found = find_personal_data(docs, fit(docs), keep=["doc_id"])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter(RESULT, lambda s: s["base"])
    return found.select(
        "doc_id", *[_count(base, k).alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(RESULT).alias("spans"),
    )

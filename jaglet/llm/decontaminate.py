"""Benchmark decontamination with suffix arrays over the training texts.

Texts are word sequences (A-Z lower-cased). Every shard, a run of whole texts, gets a suffix array of all of
its suffixes that can match: a word that no item has ends every match, so suffixes that reach such a word, or
the end of their text, before the shortest window are left out. Every suffix of every item is then binary-
searched by its window (13 words, or the whole of a shorter item), narrowing its interval word by word; equal windows
are searched once. Windows of one length have intervals apart, so all occurrences of all windows are at most as
many as the shard's suffixes, however repetitive texts and items are. They mark the words that are hit, and are
the places where matches begin; the longest verbatim match of each is with a neighbour in the items' own suffix
array, found by binary search too, on lengths by rolling hashes.

Words are numbered by 64-bit hashes of their bytes. A wrong window takes two of an item's words that collide with others of
the text's in the very same order, or one beside twelve equal ones.

Items are few beside the training texts; they are collected in blocks of at most BLOCK_BYTES of text. One block at a
time is broadcast; with several, the results of one are written before the next, so memory holds one. Nothing
is shuffled, and with one block texts are read once.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jaglet.llm import wordhash as wh
from jaglet.llm.common import extended, materialize, place, session_of, slices, table, text_view, without

WINDOW = 13
BLOCK_BYTES = 32 << 20
SHARD = 1 << 21
FOUND = ("bench_words", "bench_spans", "bench_items", "bench_longest", "bench_matches")
_MATCH = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("item_start", T.LongType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType())])
FOUND_FIELDS = [
    T.StructField("bench_words", T.LongType()),
    T.StructField("bench_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("bench_items", T.ArrayType(T.StringType())),
    T.StructField("bench_longest", _MATCH),
    T.StructField("bench_matches", T.ArrayType(_MATCH)),
]
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_FOUND_MATCH = pa.struct([("item_id", pa.string()), ("item_start", pa.int64()), ("start", pa.int64()), ("length", pa.int64())])


class Items:
    """The windows and suffixes of a block of items, as word numbers in the block's vocabulary (from 1; 0 is any other word)."""

    def __init__(self, ids: list, texts: list[str | None], window: int = WINDOW):
        self.names = ["null" if i is None else str(i) for i in ids]
        data, at = text_view(pa.array([t or "" for t in texts], pa.large_string()))
        h, _, _, first = wh.words(data, at, wh.ALNUM)
        self.vocabulary, numbers = np.unique(h, return_inverse=True)
        counts = np.diff(first)
        item = np.repeat(np.arange(len(counts)), counts)
        #: all items' words in a row, a 0 behind each item, and the item of each place
        self.seq = np.zeros(len(h) + len(counts), np.int32)
        self.seq[np.arange(len(h)) + item] = numbers + 1
        self.item = np.repeat(np.arange(len(counts)), counts + 1)
        self.begin = first[:-1] + np.arange(len(counts))
        #: by window length: the distinct windows as rows, and the number of each one's list of items
        self.windows: list[tuple[int, np.ndarray, np.ndarray]] = []
        self.lists: list[list[str]] = []
        known: dict[bytes, int] = {}
        names, name = np.unique(np.array(self.names, object), return_inverse=True) if self.names else ([], np.zeros(0, np.int64))
        lengths = np.minimum(counts, window)
        for k in np.unique(lengths[lengths > 0]).tolist():
            own = np.flatnonzero(lengths == k)
            start = np.concatenate([np.arange(self.begin[i], self.begin[i] + counts[i] - k + 1) for i in own])
            rows, number = np.unique(self.seq[start[:, None] + np.arange(k)], axis=0, return_inverse=True)
            pair = np.unique(number.reshape(-1) * len(names) + name[self.item[start]])
            cuts = np.searchsorted(pair, np.arange(len(rows) + 1) * len(names))
            of = np.zeros(len(rows), np.int64)
            for w in range(len(rows)):
                held = pair[cuts[w] : cuts[w + 1]] % len(names)
                of[w] = known.setdefault(held.tobytes(), len(known))
                if of[w] == len(self.lists):
                    self.lists.append([names[x] for x in held])
            self.windows.append((k, rows, of))
        self.shortest = min((w[0] for w in self.windows), default=0)
        self.order = whole_order(self.seq, int(counts.max(initial=0)))
        self.sums = _sums(self.seq)

    def number(self, h: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(h), np.int32)
        at = np.searchsorted(self.vocabulary, h)
        at[at == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[at] == h, at + 1, 0).astype(np.int32)


def suffix_array(seq: np.ndarray, depth: int, shortest: int) -> np.ndarray:
    """Starts of the suffixes of seq that have no 0 among their first `shortest` words, sorted by their first `depth`."""
    blocked = np.concatenate((np.flatnonzero(seq == 0), [len(seq)]))
    starts = np.flatnonzero(seq)
    run = blocked[np.searchsorted(blocked, starts)] - starts
    starts = starts[run >= shortest]
    padded = np.concatenate((seq, np.zeros(depth, seq.dtype)))
    return starts[np.lexsort([padded[starts + k] for k in range(depth - 1, -1, -1)])] if len(starts) else starts


def whole_order(seq: np.ndarray, longest: int) -> np.ndarray:
    """The places of seq, by the words from there to the next 0: ranks of doubled lengths, until no place ties or none is longer."""
    order, rank, k = np.argsort(seq, kind="stable"), seq.astype(np.int64), 1
    while k < longest:
        after = np.zeros(len(seq), np.int64)
        after[: max(0, len(seq) - k)] = rank[k:]
        after[seq == 0] = 0
        order = np.lexsort((after, rank))
        fresh = np.concatenate(([False], (rank[order][1:] != rank[order][:-1]) | (after[order][1:] != after[order][:-1])))
        new = np.cumsum(fresh)
        rank = np.empty(len(seq), np.int64)
        rank[order] = new
        rank[seq > 0] += 1
        rank[seq == 0] = 0
        if len(new) and new[-1] == len(seq) - 1:
            break
        k *= 2
    return order[seq[order] > 0]


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers = np.ones(1, np.uint64)


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        with np.errstate(over="ignore"):
            _powers = np.cumprod(np.concatenate(([np.uint64(1)], np.full(2 * n, _BASE))), dtype=np.uint64)
    return _powers


def _sums(seq: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate((np.zeros(1, np.uint64), np.cumsum(wh.mix(seq.astype(np.uint64) + np.uint64(1)) * _power(len(seq))[: len(seq)], dtype=np.uint64)))


def common(a: np.ndarray, b: np.ndarray, p: np.ndarray, q: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many words sequences agree in from places p and q on, `most` at most; a and b are their _sums."""
    power, lo, hi = _power(max(len(a), len(b))), np.zeros(len(p), np.int64), most.copy()
    with np.errstate(over="ignore"):
        while (lo < hi).any():
            mid = (lo + hi + 1) >> 1
            same = (a[p + mid] - a[p]) * power[q] == (b[q + mid] - b[q]) * power[p]
            lo, hi = np.where(same, mid, lo), np.where(same, hi, np.maximum(mid - 1, lo))
    return lo


def longest(items: Items, seq: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of words, place in the items) of the longest match from each place `at` of seq."""
    order, own, other = items.order, _sums(seq), items.sums
    ends = lambda s: np.append(np.flatnonzero(s == 0), len(s))
    seq_ends, item_ends = ends(seq), ends(items.seq)
    left = seq_ends[np.searchsorted(seq_ends, at)] - at

    def meet(k):
        q = order[k]
        return common(own, other, at, q, np.minimum(left, item_ends[np.searchsorted(item_ends, q)] - q)), q

    lo, hi = np.zeros(len(at), np.int64), np.full(len(at), len(order), np.int64)
    while (lo < hi).any():
        mid = np.minimum((lo + hi) >> 1, len(order) - 1)
        n, q = meet(mid)
        mine = np.where(at + n < len(seq), seq[np.minimum(at + n, len(seq) - 1)], 0)
        right = (lo < hi) & (items.seq[q + n] < mine)
        lo, hi = np.where(right, mid + 1, lo), np.where((lo < hi) & ~right, mid, hi)
    before, behind = meet(np.maximum(lo - 1, 0)), meet(np.minimum(lo, len(order) - 1))
    nearer = before[0] >= behind[0]
    return np.where(nearer, before[0], behind[0]), np.where(nearer, before[1], behind[1])


def search(seq: np.ndarray, suffixes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of words, the interval of the suffix array whose suffixes begin with it."""
    lo, hi = np.zeros(len(rows), np.int64), np.full(len(rows), len(suffixes), np.int64)
    alive = np.flatnonzero(hi > lo)
    for k in range(rows.shape[1]):
        want = rows[alive, k]
        a, b = _bound(seq, suffixes, k, want, lo[alive], hi[alive], False), None
        b = _bound(seq, suffixes, k, want, a, hi[alive], True)
        lo[alive], hi[alive] = a, b
        alive = alive[b > a]
        if not len(alive):
            break
    return lo, hi


def _bound(seq, suffixes, k, want, lo, hi, after):
    lo, hi = lo.copy(), hi.copy()
    top = len(seq) - 1
    while True:
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            return lo
        mid = (lo[open_] + hi[open_]) >> 1
        at = suffixes[mid] + k
        word = np.where(at <= top, seq[np.minimum(at, top)], 0)
        right = word <= want[open_] if after else word < want[open_]
        lo[open_[right]] = mid[right] + 1
        hi[open_[~right]] = mid[~right]


def find(items: Items, data: np.ndarray, offsets: np.ndarray):
    """Of each text: its number of words, hit spans [(start, end)], items found, matches (-length, start, item, start there)."""
    h, _, _, first = wh.words(data, offsets, wh.ALNUM)
    counts = np.diff(first)
    out = [[int(n), [], [], []] for n in counts]
    if not len(h) or not items.windows:
        return out
    text = np.repeat(np.arange(len(counts)), counts)
    seq = np.zeros(len(h) + len(counts), np.int32)
    places = np.arange(len(h)) + text  # a 0 stands between texts
    seq[places] = items.number(h)
    suffixes = suffix_array(seq, max(w[0] for w in items.windows), items.shortest)
    if not len(suffixes):
        return out
    owner = np.repeat(np.arange(len(counts)), counts + 1)
    delta = np.zeros(len(seq) + 1, np.int64)
    begins, met = np.zeros(len(seq), bool), []
    for k, rows, of in items.windows:
        lo, hi = search(seq, suffixes, rows)
        n = hi - lo
        at = suffixes[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        delta[at] += 1
        delta[at + k] -= 1
        begins[at] = True
        met.append(owner[at] * len(items.lists) + np.repeat(of, n))
    at = np.flatnonzero(begins)
    if not len(at):
        return out
    hit = np.cumsum(delta[:-1])[places] > 0
    found = np.unique(np.concatenate(met))
    for d in np.unique(found // len(items.lists)).tolist():
        lists = found[np.searchsorted(found, d * len(items.lists)) : np.searchsorted(found, (d + 1) * len(items.lists))] % len(items.lists)
        out[d][2] = sorted({name for x in lists for name in items.lists[x]})
        mine = np.concatenate(([False], hit[first[d] : first[d + 1]], [False]))
        edge = np.flatnonzero(mine[1:] != mine[:-1])
        out[d][1] = [(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2], strict=True)]
    size, there = longest(items, seq, at)
    # a match that only is the rest of the one before, a word further on, isn't one of its own
    rest = np.concatenate(([False], (at[1:] == at[:-1] + 1) & (size[1:] == size[:-1] - 1)))
    at, size, there = at[~rest], size[~rest], there[~rest]
    item = items.item[there]
    for d, n, p, i, q in zip(owner[at].tolist(), size.tolist(), at.tolist(), item.tolist(), (there - items.begin[item]).tolist(), strict=True):
        out[d][3].append((-n, p - int(first[d]) - d, items.names[i], q))
    return out


def merge_spans(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted([*a, *b]):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def match_items(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", keep: Iterable[str] | None = None, window: int = WINDOW) -> DataFrame:
    """docs (or its columns `keep`) with bench_words, bench_spans, bench_items, bench_longest and bench_matches.

    bench_words counts the text's words, bench_spans are the hit words as [start, end), bench_items the ids (as
    text, sorted, each once) of items with an occurring window. bench_matches has the longest verbatim match from each
    place where a window occurs (item, first word there, first word here, number of words), but for those that
    are the rest of the one before; of several items alike there, one. bench_longest is the longest of them (null
    without one; ties: the first place). Null and wordless texts have no words; null and wordless items no windows;
    a null item id reads "null"; items that share an id count once. Columns of docs that bear a result's name
    are replaced. Rows that repeat are judged one by one; an empty table on either side gives no hits. Texts may be of
    any length; a text is in one shard.
    """
    spark = session_of(docs)
    docs = without(docs, *FOUND)
    keep = list(docs.columns if keep is None else keep)
    picked = items.select(F.col(f"`{item_id}`").cast("string").alias("i"), F.col(f"`{item_text}`").alias("t"))
    size = picked.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    for k in range(blocks):
        rows = picked.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k).collect()
        block = spark.sparkContext.broadcast(Items([r[0] for r in rows], [r[1] for r in rows], window))
        text, earlier = F.col(f"c{place(docs, text_col)}"), [F.col(f"c{place(docs, c)}") for c in FOUND] if k else []
        docs = extended(docs, _kernel(block), FOUND_FIELDS, [text, *earlier], keep if k == blocks - 1 else None)
        if k < blocks - 1:
            names = docs.columns
            docs = materialize(docs.toDF(*[f"c{i}" for i in range(len(names))]), "matches").toDF(*names)
            block.unpersist()
    return docs


def _kernel(block):
    def kernel(b: pa.RecordBatch):
        data, at = text_view(b.column(0))
        found = [x for i, j in slices(at, SHARD) for x in find(block.value, data, at[i : j + 1])]
        if b.num_columns > 1:
            spans, names, matches = (b.column(1 + FOUND.index(c)).to_pylist() for c in ("bench_spans", "bench_items", "bench_matches"))
            for x, s, n, m in zip(found, spans, names, matches, strict=True):
                x[1] = merge_spans(x[1], [(y["start"], y["end"]) for y in s])
                x[2] = sorted({*x[2], *n})
                x[3] = x[3] + [(-y["length"], y["start"], y["item_id"], y["item_start"]) for y in m]
        match = lambda m: {"item_id": m[2], "item_start": m[3], "start": m[1], "length": -m[0]}
        yield 0, b.num_rows, [
            pa.array([x[0] for x in found], pa.int64()), pa.array([[{"start": s, "end": e} for s, e in x[1]] for x in found], _SPANS), pa.array([x[2] for x in found], pa.list_(pa.string())),
            pa.array([match(min(x[3])) if x[3] else None for x in found], _FOUND_MATCH), pa.array([[match(m) for m in sorted(x[3], key=lambda m: (m[1], *m))] for x in found], pa.list_(_FOUND_MATCH)),
        ]

    return kernel


def hit_words():
    return F.aggregate("bench_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])


def contaminated():
    """At least one hit word, and hits in at least a twentieth of the words."""
    return (hit_words() > 0) & (20 * hit_words() >= F.col("bench_words"))


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents, all columns, that no benchmark item contaminates."""
    names = docs.columns
    held = docs.toDF(*[f"c{i}" for i in range(len(names))])
    return match_items(held, items, f"c{place(docs, text_col)}").where(~contaminated()).drop(*FOUND).toDF(*names)


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    """Hits of the benchmark's 13-word windows in every document."""
    found = match_items(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id", F.col("bench_words").alias("n_words"), hit_words().alias("n_hit"), F.size("bench_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("bench_items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"),
    )


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
i AS (
  SELECT DISTINCT item_id, least(13, len(ws)) AS k, unnest(list_transform(range(1, len(ws) - least(13, len(ws)) + 2), lambda p: array_to_string(ws[p:p + least(13, len(ws)) - 1], ' '))) AS w
  FROM b WHERE len(ws) > 0),
k AS (SELECT DISTINCT k FROM i),
p AS (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM d, k WHERE len(ws) >= k),
h AS (SELECT doc_id, p, i.k, item_id FROM (SELECT doc_id, k, p, array_to_string(ws[p:p + k - 1], ' ') AS w FROM p) q JOIN i ON q.k = i.k AND q.w = i.w),
n AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(p, p + k)) AS pos FROM h) GROUP BY 1),
m AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY 1)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n.n, 0) AS n_hit, coalesce(m.n, 0) AS n_items, sha256(coalesce(m.ids, '')) AS items_sha256,
  coalesce(n.n, 0) > 0 AND 20 * coalesce(n.n, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""

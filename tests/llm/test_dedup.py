import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from jaglet.llm import decontaminate, jaccard, linededup
from jaglet.llm.components import connected_components
from tests.llm.helpers import frame, plain, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def roots(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(k, k + 1) for k in range(200, 240)] + [(500, k) for k in range(501, 560)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in roots(edges).items() if any(k in e and e[0] != e[1] for e in edges)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- near duplicates


def shingle_sets(texts, size):
    out = []
    for t in texts:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").translate(LOWER)) if x]
        out.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set()))
    return out


def brute_classes(rows, size, percent):
    sets = shingle_sets([t for _, t in rows], size)
    ids = [i for i, _ in rows]
    edges = [(i, i) for i in ids if i is not None]
    for x in range(len(rows)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if sets[x] and sets[y] and None not in (ids[x], ids[y]) and 100 * both >= percent * len(sets[x] | sets[y]):
                edges.append((ids[x], ids[y]))
    root = roots(edges)
    return sorted(((i, len(s), (root[i] if s else i) if i is not None else None) for i, s in zip(ids, sets, strict=True)), key=repr)


def near_corpus(seed):
    rng = random.Random(seed)
    rows, n = [], 0
    for _ in range(12):
        base = words(rng, rng.choice([3, 5, 9, 30, 80, 200]))
        for _ in range(rng.choice([1, 2, 6, 14])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                w[rng.randrange(len(w))] = rng.choice(["new", "other", "thing"]) + str(rng.randrange(50))
            sep = rng.choice([" ", " ", "\n", " \t "])
            rows.append((n, sep.join(w).upper() if rng.random() < 0.2 else sep.join(w)))
            n += 1
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, rows[0][1]), (None, rows[0][1]), (n + 4, "one"), (n + 5, "One")]


@pytest.mark.parametrize("seed,size,percent,hot,most", [(1, 4, 85, 32, 8192), (2, 5, 80, 32, 2), (3, 4, 85, 0.0001, 3)])
def test_near_duplicates_against_brute_force(spark, monkeypatch, seed, size, percent, hot, most):
    monkeypatch.setattr(jaccard, "HOT", hot)
    monkeypatch.setattr(jaccard, "LIST_ROWS", most)
    rows = near_corpus(seed)
    got = plain(jaccard.near_duplicates(frame(spark, rows, "component_id").repartition(3), size=size, percent=percent))
    assert got == brute_classes(rows, size, percent)


def test_hot_groups_split(spark, monkeypatch):
    """Parts of a hot posting list still meet, and blocks of a long one, pair by pair."""
    monkeypatch.setattr(jaccard, "HOT", 0.0001)
    monkeypatch.setattr(jaccard, "LIST_ROWS", 3)
    rng = random.Random(9)
    base = words(rng, 60)
    rows = [(k, " ".join([*base[:10], f"edit{k}", *base[11:]])) for k in range(40)]
    assert plain(jaccard.near_duplicates(frame(spark, rows), size=4, percent=80)) == brute_classes(rows, 4, 80)


def test_near_duplicates_of_nothing(spark):
    assert jaccard.near_duplicates(frame(spark, [])).count() == 0
    assert plain(jaccard.near_duplicates(frame(spark, [(3, None), (3, "")]))) == [(3, 0, 3), (3, 0, 3)]
    assert [r[2] for r in plain(jaccard.near_duplicates(frame(spark, [(5, "a b c d e f"), (5, "a b c d e f"), (9, "a b c d e f")])))] == [5, 5, 5]


# ---- line windows


def brute_lines(rows):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    first, cover = {}, {i: set() for i in order}
    full = {i: [(n, x) for n, x in enumerate((rows[i][1] or "").split("\n")) if x] for i in order}
    for i in order:
        for p in range(len(full[i]) - 2):
            w = tuple(x for _, x in full[i][p : p + 3])
            place = (rows[i][0], p)
            if first.setdefault(w, place) != place:
                cover[i] |= {full[i][p + k][0] for k in range(3)}
    return [(rows[i][0], None if rows[i][1] is None else "\n".join(x for n, x in enumerate(rows[i][1].split("\n")) if n not in cover[i]), (rows[i][1] or "").count("\n") + 1, sorted(cover[i])) for i in range(len(rows))]


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(5)
    pool = [" ".join(words(rng, 6)) for _ in range(30)]
    rows = []
    for k in range(60):
        lines = [rng.choice(pool) for _ in range(rng.choice([0, 1, 2, 3, 8, 25]))]
        at = rng.randrange(26)
        lines += pool[at : at + rng.choice([0, 3, 4])]
        if rng.random() < 0.3:
            lines.insert(rng.randrange(len(lines) + 1), "")
        rows.append((k, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "a\na\na\na\na"), (104, "a\na\na\na\na"), (None, "\n".join(pool[:4])), (105, "b\nc\nd"), (105, "b\nc\nd"), (106, "x\n" + "\n".join(pool[:3]) + "\n")]
    out = linededup.dedup_lines(frame(spark, rows, "line_count").repartition(3))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "line_count", "removed_lines"]
    got = sorted(((r["doc_id"], r["text"], r["line_count"], list(r["removed_lines"])) for r in out.collect()), key=repr)
    assert got == sorted(brute_lines(rows), key=repr)


def test_line_dedup_of_nothing(spark):
    assert linededup.dedup_lines(frame(spark, [])).count() == 0


# ---- benchmark items


def brute_hits(docs, items, window=13):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = lambda t: pattern.findall((t or "").translate(LOWER))
    out = []
    for i, t in docs:
        w, hit, ids, longest = cut(t), set(), set(), 0
        for name, text in items:
            x = cut(text)
            k = min(window, len(x))
            for p in range(len(x) - k + 1 if k else 0):
                for q in range(len(w) - k + 1):
                    if w[q : q + k] == x[p : p + k]:
                        n = k
                        while p + n < len(x) and q + n < len(w) and x[p + n] == w[q + n]:
                            n += 1
                        longest = max(longest, n)
                        hit |= set(range(q, q + k))
                        ids.add("null" if name is None else str(name))
        out.append((i, len(w), len(hit), sorted(ids), longest))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def benchmark_case():
    rng = random.Random(6)
    items = [(k, " ".join(words(rng, rng.choice([1, 5, 13, 14, 40]), 3000))) for k in range(9)] + [(9, None), (10, "  "), (None, "only nulls have this name"), (2, "second text of item two"), (11, "a b a b a b a b a b a b a b a b a b a b")]
    docs = []
    for k in range(50):
        w = words(rng, rng.choice([0, 4, 60, 300]), 3000)
        for _ in range(rng.choice([0, 1, 2])):
            x = (rng.choice(items)[1] or "").split()
            a = rng.randrange(len(x) or 1)
            w[rng.randrange(len(w) + 1) : 0] = x[a : a + rng.choice([6, 13, 20, 50])]
        docs.append((k, rng.choice([" ", ", ", "\n"]).join(w).upper()))
    return docs + [(60, None), (61, "..."), (62, "a b " * 30), (62, "a b " * 30), (None, items[4][1])], items


@pytest.mark.parametrize("block", [1 << 25, 60])
def test_item_hits_against_brute_force(spark, monkeypatch, benchmark_case, block):
    docs, items = benchmark_case
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    monkeypatch.setattr(decontaminate, "SHARD", 500)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.match_items(frame(spark, docs, "bench_items").repartition(3), bench)
    got = [(r["doc_id"], r["bench_words"], sum(s["end"] - s["start"] for s in r["bench_spans"]), list(r["bench_items"]), (r["bench_longest"] or {"length": 0})["length"]) for r in found.collect()]
    assert sorted(got, key=repr) == brute_hits(docs, items)
    kept = {r[0] for r in decontaminate.decontaminate(frame(spark, docs), bench).select("doc_id").collect()}
    assert kept == {i for i, n, h, _, _ in brute_hits(docs, items) if not (h > 0 and 20 * h >= n)}


def test_items_of_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    out = decontaminate.match_items(frame(spark, [(1, "a b")]), none).first()
    assert (out["bench_words"], out["bench_spans"], out["bench_items"], out["bench_longest"]) == (2, [], [], None)
    assert decontaminate.match_items(frame(spark, []), none).count() == 0
    assert out["bench_items"] == [] and hashlib.sha256(b"").hexdigest().startswith("e3b0")
    assert decontaminate.decontaminate(frame(spark, [(1, "a b")], "bench_words"), none).columns[-1] == "bench_words"
    assert F is not None

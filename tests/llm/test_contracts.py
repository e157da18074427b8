"""The queries without SQL as queries, on whole tables, against plain versions; and what every operator has to bear."""

import hashlib
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from jaglet.llm import decontaminate, hnsw, htmlextract, jaccard, langid, linededup, packing, pii, tokencounts, toxicity
from jaglet.llm.queries import QUERIES
from jaglet.llm.tokenizer import default_path
from tests.llm.helpers import frame, words
from tests.llm.test_models import naive

SMALL, DATA = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
need = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def crc(i, n):
    return zlib.crc32(str(i).encode()) % n


@need
def test_packing_query(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(default_path())
    out = QUERIES["op2_best_fit_packing"](spark, SMALL)
    assert out.columns[:7] == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    got, fill = {}, {}
    for r in out.collect():
        got.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    total = 0
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        ids = [*whole.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        first = (len(ids) - 1) % 2048 + 1
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        assert sorted(got.pop(r["doc_id"])) == [(k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
        total += len(ids)
    assert not got
    for parts in fill.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    assert -(-total // 2048) <= len(fill) <= -(-total // 2048) + 1


def test_two_for_one_takes_the_best_pair():
    def bins(lengths, limit=2048):
        plan = packing.Plan(np.bincount(lengths, minlength=limit + 1), limit)
        lengths = np.array(sorted(lengths))
        rank = np.arange(len(lengths)) - np.searchsorted(lengths, lengths)
        seq, _ = plan.place(lengths, rank)
        return sorted(sorted(lengths[seq == s].tolist()) for s in set(seq.tolist()))

    assert bins([1948, 60, 50, 45]) == [[45, 50, 1948], [60]]
    assert bins([1948, 60, 50, 50]) == [[50, 50, 1948], [60]]


def test_two_for_one_against_all_pairs():
    rng = random.Random(3)
    for _ in range(300):
        limit = 40
        left = [0] + [rng.choice([0, 0, 1, 1, 2]) for _ in range(limit)]
        small = rng.choice([n for n in range(1, limit) if left[n]] or [0])
        if not small:
            continue
        gap = rng.randrange(0, limit - small + 1)
        bin_ = {small: 1}
        free = [c - (n == small) for n, c in enumerate(left)]
        best = max((a + b for a in range(1, limit) for b in range(1, a + 1) if a + b <= gap + small and free[a] and free[b] and (a != b or free[a] > 1)), default=0)
        packing.Plan._two_for_one(bin_, gap, left, limit)
        assert sum(n * k for n, k in bin_.items()) == (best if best > small else small)


@need
def test_language_query(spark):
    rows = QUERIES["op4_language_id"](spark, DATA).collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    learned = {r["lang"] for i, r in docs.items() if crc(i, 4) != 2 and r["lang"]}
    right = []
    for r in rows:
        text = docs[r["doc_id"]]["text"]
        assert r["held_out"] == (crc(r["doc_id"], 4) == 2) and 0 <= r["score"] <= 1
        letters = any(c.isalpha() for c in text or "")
        assert (r["lang_pred"] == "und") == (not letters) and (not letters or r["lang_pred"] in learned)
        if r["held_out"] and letters and docs[r["doc_id"]]["lang"]:
            right.append(r["lang_pred"] == docs[r["doc_id"]]["lang"])
    assert len(right) > 100 and np.mean(right) > 0.97


@need
def test_toxicity_query(spark):
    rows = {r["doc_id"]: r for r in QUERIES["op7_toxicity"](spark, DATA).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    assert set(rows) == {r[0] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id").collect()}
    for i, r in rows.items():
        assert r["held_out"] == (crc(i, 3) == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    held = [(rows[i]["predicted"], t) for i, t in labels.items() if crc(i, 3) == 1 and t is not None]
    assert len(held) > 50 and np.mean([p == t for p, t in held]) > 0.95


@need
def test_personal_data_query(spark):
    rows = {r["doc_id"]: r for r in QUERIES["op9_personal_data"](spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        r, base = rows[d["doc_id"]], naive(d["text"] or "")
        said = [f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in base]
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x == n for x, _, _ in base) for n in range(4)]
        assert r["base_sha256"] == hashlib.sha256(",".join(said).encode()).hexdigest()
        spans = [x.split(":") for x in r["spans"].split(",") if x]
        assert set(said) <= {":".join(x) for x in spans} and spans == sorted(spans, key=lambda x: (pii.KINDS.index(x[0]), int(x[1])))


@need
def test_pages_query(spark):
    rows = {r["page_id"]: r for r in QUERIES["op3_html_extraction"](spark, SMALL).collect()}
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").collect()
    assert len(rows) == len(pages)
    plain = htmlextract.main_texts([p["html"] for p in pages], htmlextract.trained())
    for p, text in zip(pages, plain, strict=True):
        r = rows[p["page_id"]]
        assert (r["url"], r["text"], r["n_chars"]) == (p["url"], text, len(text))
        assert not text or all(b and b == " ".join(b.split()) for b in text.split("\n\n"))


# ---- pages written by hand

STORY = [
    "The river rose overnight and by morning the lower road was under water, said the people who live along it.",
    "Nobody was hurt, but two barns were lost and the school stayed closed until the afternoon.",
    "Engineers will look at the bridge tomorrow; it was last repaired eleven years ago.",
    "“We have seen worse,” an old farmer told us, “but never so early in the year.”",
]
PARAS = "".join(f"<p>{p}</p>" for p in STORY)
PAGES = {
    "article": f"<html><body><nav><a href=/>Home</a> <a href=/n>News</a></nav><article><h1>High water</h1>{PARAS}</article><footer>© The Valley Post</footer></body></html>",
    "main in div": f'<body><div id="header"><a href=/>The Valley Post</a></div><div id="content"><h1>High water</h1>{PARAS}</div><div id="footer">All rights reserved</div></body>',
    "sidebar": f'<body><main><article><h1>High water</h1>{PARAS}</article></main><aside><h3>Most read</h3><ul><li><a href=/1>Cows on the loose</a></li><li><a href=/2>Market prices</a></li></ul></aside></body>',
    "cookie notice": f'<body><div class="cookie-banner"><p>We use cookies to make this site better.</p><button>Accept all</button></div><article><h1>High water</h1>{PARAS}</article></body>',
    "advert inside": f'<body><article><h1>High water</h1><p>{STORY[0]}</p><div class="advert"><p>Boots half price this week only!</p></div>{"".join(f"<p>{p}</p>" for p in STORY[1:])}</article></body>',
    "comments": f'<body><article><h1>High water</h1>{PARAS}</article><section class="comments"><h2>Comments</h2><div class="comment"><p>My cellar is full of water too.</p></div><div class="comment"><p>Stay safe everyone!</p></div></section></body>',
    "newsletter form": f'<body><article><h1>High water</h1>{PARAS}</article><form action="/join"><label>Your address</label><input name=mail><button>Join</button></form></body>',
    "scripts and styles": f"<head><style>p{{color:red}}</style><script>var x = '<p>no</p>';</script></head><body><article><h1>High water</h1>{PARAS}<script>track('</p>')</script></article></body>",
    "old table page": f"<html><body><table><tr><td><a href=a.html>Index</a><br><a href=b.html>Links</a></td></tr></table><div class=content><h1>High water</h1>{PARAS}</div></body></html>",
    "breadcrumbs": f'<body><ul class="breadcrumb"><li><a href=/>Home</a></li><li><a href=/local>Local</a></li></ul><article><h1>High water</h1>{PARAS}</article><div class="share"><a href=#>Share</a> <a href=#>Post</a></div></body>',
    "unclosed": f"<body><div class=menu><ul><li><a href=/>Home<li><a href=/x>More</ul></div><article><h1>High water</h1>{PARAS.replace('</p>', '')}</article>",
    "entities and white space": "<body><article><h1>High&nbsp;water</h1>" + "".join(f"<p>\n  {p.replace('“', '&ldquo;').replace('”', '&rdquo;').replace(' ', chr(10) + ' ', 2)}\t</p>" for p in STORY) + "</article></body>",
}


@pytest.mark.parametrize("name", sorted(PAGES))
def test_pages_by_hand(name):
    got = htmlextract.main_texts([PAGES[name]], htmlextract.trained())[0].split("\n\n")
    assert got == ["High water", *STORY]


# ---- names, repeats, nulls, long texts

NAMES = ["x.y", "`q`", "__text", "__html", "__gone", "__hash", "__id", "gone", "row", "c0", "c1", "k0", "i0", "a0", "h", "Text_", "node", "component", "bench_items", "lang_rejected", "sequence_id"]


def odd_frame(spark, texts):
    df = frame(spark, texts)
    return df.select("*", *[F.lit(k).alias(n) for k, n in enumerate(NAMES)])


def kept(names, *results):
    return [n for n in names if n not in results]


def test_operators_bear_clashing_names(spark):
    rng = random.Random(4)
    line = [" ".join(words(rng, 8)) for _ in range(6)]
    df = odd_frame(spark, [(1, "\n".join(line)), (2, "\n".join(line)), (3, None), (None, ""), (4, "mail a.b@c.example now")])
    names = df.columns
    items = spark.createDataFrame([(1, " ".join(words(rng, 20)))], "item_id long, text string")
    outs = {
        "lines": (linededup.dedup_lines(df), kept(names, *linededup.RESULT) + list(linededup.RESULT)),
        "language": (langid.identify(df, langid.fit(df)), kept(names, *langid.RESULT) + list(langid.RESULT)),
        "items": (decontaminate.match_items(df, items), kept(names, *decontaminate.FOUND) + list(decontaminate.FOUND)),
        "clean": (decontaminate.decontaminate(df, items), names),
        "toxic": (toxicity.score_toxicity(df, None), [*names, toxicity.RESULT]),
        "personal": (pii.find_personal_data(df, pii.fit(df)), [*names, pii.RESULT]),
        "counts": (tokencounts.count_tokens(df, keep=names), [*names, "n_tokens"]),
        "pages": (htmlextract.extract(df.withColumn("html", F.col("text"))), [*names, "html", htmlextract.RESULT]),
    }
    for name, (out, columns) in outs.items():
        assert out.columns == columns, name
        rows = out.collect()
        assert len(rows) == 5 and all(r[k] == n for r in rows for k, c in enumerate(columns) if c in NAMES for n in [NAMES.index(c)] if c not in (*linededup.RESULT, *langid.RESULT, *decontaminate.FOUND)), name
    assert packing.packed(df).count() == 5 and jaccard.near_duplicates(df).count() == 5


def test_samples_of_rows_without_ids_stay_bounded(spark, monkeypatch):
    """Repeated texts without ids are one case of a sample, or as many as it is large."""
    some = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("to ann.bell@mail.example.com again and again").alias("text"), F.lit("en").alias("lang"))
    assert set(langid.fit(some, sample=20).langs) == {"en"}
    # all rows share the hash of their text: as one case they are in the sample of personal data, or not, together
    monkeypatch.setattr(pii.Tagger, "learn", lambda self, x, y, **k: sizes.append(len(x)))
    sizes = []
    pii.fit(some, sample=3000)
    assert sizes and max(sizes) < 20


def test_many_languages(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 3)
    rng = random.Random(2)
    rows = [(k, " ".join(words(rng, 20)), f"l{min(k // 4, 8)}", "s", 1) for k in range(60)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    assert set(model.langs) == {"l8", "l0", "l1"}  # the commonest, ties by name


def test_tables_without_rows(spark):
    df = frame(spark, [])
    assert tokencounts.count_tokens(df).count() == 0 and packing.packed(df).count() == 0
    assert toxicity.score_toxicity(df, None).count() == 0 and htmlextract.extract(df, html_col="text").count() == 0


def test_repeated_rows_are_judged_alike(spark):
    df = frame(spark, [(1, "mail ann@mail.example.com"), (1, "mail ann@mail.example.com"), (2, "you idiot"), (2, "you idiot")])
    model = langid.fit(df)
    for out, result in ((langid.identify(df, model), "lang_pred"), (toxicity.score_toxicity(df, None), "toxicity"), (pii.find_personal_data(df, None), "pii_spans"), (tokencounts.count_tokens(df), "n_tokens")):
        rows = out.select("doc_id", result).collect()
        assert len(rows) == 4 and all(a[1] == b[1] for a in rows for b in rows if a[0] == b[0])


def test_long_and_repetitive_texts(spark):
    """Costs stay about linear in a text's length: lists of contacts, and texts of one phrase."""
    contacts = "".join(f"+1 (212) 555-{k % 10000:04d} x{k}@mail.example.com " for k in range(20_000))
    spans = [(k % 4, 5 * j, 5 * j + 4, float(j % 7)) for k in range(4) for j in range(30_000)]
    assert len(pii.apart(spans)) == 30_000
    df = frame(spark, [(1, contacts), (2, "a b " * 100_000), (3, "same line\n" * 50_000)])
    found = {r["doc_id"]: len(r["pii_spans"]) for r in pii.find_personal_data(df, None).collect()}
    assert found == {1: 40_000, 2: 0, 3: 0}
    items = spark.createDataFrame([(1, "a b " * 100)], "item_id long, text string")
    hits = {r["doc_id"]: r for r in decontaminate.match_items(df, items, keep=["doc_id"]).collect()}
    assert hits[2]["bench_longest"]["length"] == 200 and sum(s["end"] - s["start"] for s in hits[2]["bench_spans"]) == 200_000
    lines = {r["doc_id"]: len(r["removed_lines"]) for r in linededup.dedup_lines(df).collect()}
    assert lines[3] == 49_999
    assert jaccard.near_duplicates(df).count() == 3 and packing.packed(df.where("doc_id > 1")).agg(F.max("length")).first()[0] == 2048


def test_recall_is_measured_where_no_query_has_a_link():
    rng = np.random.default_rng(5)
    x = hnsw.unit(rng.normal(size=(400, 16)))
    beside, known = hnsw._beside(x, 0.98, 50)
    cos = np.einsum("ij,ij->i", beside, x[known])
    assert len(known) == 50 and (cos >= 0.98).all() and (cos < 0.99).all()
    got = np.array([True] * 98 + [False, False])
    assert hnsw._mean_recall(np.array([1] * 98 + [2, 3]), got) == pytest.approx(1 / 3) and hnsw._mean_recall(np.zeros(0), got[:0]) == 1.0


def test_longest_matches_against_all_places(spark):
    rng = random.Random(11)
    items = [" ".join(rng.choice("abc") for _ in range(rng.choice([2, 5, 14, 30]))) for _ in range(6)]
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.choice([0, 3, 40, 90]))) for _ in range(25)] + [items[3], f"d {items[2]} d {items[5]} a"]
    df = frame(spark, list(enumerate(texts)))
    out = {r["doc_id"]: r for r in decontaminate.match_items(df, spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), window=4).collect()}
    cut = [t.split() for t in items]
    for i, t in enumerate(texts):
        w = t.split()
        best = {}
        for p in range(len(w)):
            n = max((next((k for k in range(min(len(w) - p, len(x) - q)) if w[p + k] != x[q + k]), min(len(w) - p, len(x) - q)) for x in cut for q in range(len(x))), default=0)
            if any(w[p : p + min(4, len(x))] == x[q : q + min(4, len(x))] for x in cut for q in range(len(x) - min(4, len(x)) + 1)):
                best[p] = n
        want = {p: n for p, n in best.items() if best.get(p - 1, 0) != n + 1}
        got = {m["start"]: m for m in out[i]["bench_matches"]}
        assert {p: m["length"] for p, m in got.items()} == want
        for p, m in got.items():
            assert cut[int(m["item_id"])][m["item_start"] : m["item_start"] + m["length"]] == w[p : p + m["length"]]

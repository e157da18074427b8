import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from jaglet.llm import hnsw, htmlextract, langid, pii, toxicity
from tests.llm.helpers import SCHEMA, frame, plain

# ---- language


def tongue(rng, lang, n):
    parts = {"en": ["th", "ing", "er", "and", "wh", "tion"], "de": ["sch", "ung", "ein", "ü", "keit", "ß"], "el": ["θη", "και", "ός", "ου", "να", "με"]}[lang]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def tongues(spark):
    rng = random.Random(8)
    rows = [(k, tongue(rng, lang, rng.choice([8, 40, 200])), lang, "s", 1) for k in range(150) for lang in [("en", "de", "el")[k % 3]]]
    return spark.createDataFrame([*rows, (900, None, "en", "s", 0), (901, "lost", None, "s", 4)], SCHEMA)


def test_language_held_out(spark, tongues):
    model = langid.fit(tongues.where("doc_id % 4 <> 2"))
    assert set(model.langs) == {"en", "de", "el"} and len(model.langs) > 3
    out = langid.identify(tongues.withColumn("lang_pred", F.lit("clash")), model)
    assert out.columns == [*tongues.columns, "lang_pred", "lang_score", "lang_rejected"]
    rows = out.where("doc_id % 4 = 2 and lang is not null and text is not null").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97 and all(0 <= r["lang_score"] <= 1 for r in rows) and not any(r["lang_rejected"] for r in rows)


def test_language_edges(spark, tongues):
    model = langid.fit(tongues)
    odd = frame(spark, [(1, None), (2, ""), (3, "123 ... !?"), (4, "§"), (5, "x"), (6, "ab " * 5000), (7, "the " * 200_000)])
    got = {r["doc_id"]: r for r in langid.identify(odd, model, keep=["doc_id"]).collect()}
    assert all(got[k]["lang_pred"] == "und" and got[k]["lang_score"] == 0 and got[k]["lang_rejected"] for k in (1, 2, 3, 4))
    assert all(got[k]["lang_pred"] in model.langs for k in (5, 6, 7))
    assert langid.identify(odd.limit(0), model).count() == 0
    assert langid.fit(odd.limit(0)) is None and {r["lang_pred"] for r in langid.identify(odd, None).collect()} == {"und"}


def test_language_rejects_what_none_speaks(spark, tongues):
    """Random letters, encoded bytes, another script, another tongue and one word over and over; members of any length stay."""
    model, rng = langid.fit(tongues), random.Random(3)
    odd = ["".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(n)) for n in (60, 300)]
    odd += [bytes(rng.randrange(256) for _ in range(200)).hex(), "Все счастливые семьи похожи друг на друга, каждая несчастлива по-своему. " * 4]
    odd += ["Kaikki ihmiset syntyvat vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. " * 4, "lorem " * 300]
    own = [tongue(rng, lang, n) for lang in ("en", "de", "el") for n in (30, 120, 600)]
    got = {r["doc_id"]: r["lang_rejected"] for r in langid.identify(frame(spark, list(enumerate(odd + own))), model).collect()}
    assert [got[k] for k in range(len(odd))] == [True] * len(odd)
    assert not any(got[len(odd) + k] for k in range(len(own)))


def test_ngram_counts_do_not_depend_on_company():
    import pyarrow as pa

    from jaglet.llm.common import text_view

    texts = ["Hello wörld", "", "x", "abc 123 def", "ΑΒΓ"]
    together = langid.counts_of(*text_view(pa.array(texts)))
    for k, t in enumerate(texts):
        assert (together[k] == langid.counts_of(*text_view(pa.array([t])))[0]).all()
    assert together[1].sum() == 0 and together[2].sum() == 1


# ---- toxicity


def toxic_corpus(rng, n):
    insults = ["idiot", "moron", "stupid", "loser"]
    syllables = ["ta", "re", "mi", "lo", "shan", "ter", "vo", "ne"]
    bags, labels = [], []
    for k in range(n):
        w = ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(30)]
        if k % 3 == 0:
            for _ in range(2):
                w[rng.randrange(30)] = rng.choice(insults)
        bags.append(w), labels.append(k % 3 == 0)
    return bags, labels


@pytest.fixture(scope="module")
def scorer():
    bags, labels = toxic_corpus(random.Random(1), 240)
    return toxicity.train([sorted({w.encode() for w in b}) for b in bags], np.array(labels))


def test_toxic_words_with_gaps(spark, scorer):
    bags, labels = toxic_corpus(random.Random(2), 90)
    df = frame(spark, [(k, " ".join(b)) for k, b in enumerate(bags)], "toxicity")
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.score_toxicity(df, scorer).collect()}
    assert np.mean([(got[k] >= 0.7) == t for k, t in enumerate(labels)]) > 0.97
    tricky = ["you IDIOT, you moron!", "i-diot and st-upid", "idi.ot mo*ron", "i d i o t s t u p i d", None, "", "tare milo", "\n" + "tare " * 100_000]
    got = [r["toxicity"] for r in toxicity.score_toxicity(frame(spark, list(enumerate(tricky))), scorer, keep=["doc_id"]).orderBy("doc_id").collect()]
    assert min(got[:3]) >= 0.7 and got[3] > 0.3 and max(got[4:]) < 0.3 and all(0 <= s <= 1 for s in got)


def test_kernel_is_a_kernel():
    words = [b"idiot", b"id-iot", b"tomato", b"a", b"aa", "é".encode()]
    k = toxicity.kernel(words, words)
    assert np.allclose(k, k.T) and np.linalg.eigvalsh(k).min() > -1e-9 and k[0, 1] > 0.3 > k[0, 2]

    def slow(a, b):
        def weights(w):
            chars = [1, *[int(toxicity._classes[x]) for x in w if toxicity._classes[x]], 2]
            out = {}
            for i in range(len(chars)):
                for q in range(2, toxicity.SPAN):
                    for p in range(1, q):
                        if i + q < len(chars):
                            u = (chars[i], chars[i + p], chars[i + q])
                            out[u] = out.get(u, 0) + toxicity.DECAY ** (q + 1)
            return out, len(chars)

        (x, n), (y, m) = weights(a), weights(b)
        return sum(v * y.get(u, 0) for u, v in x.items()) / float(toxicity.norms(n) * toxicity.norms(m))

    assert all(k[i, j] == pytest.approx(slow(a, b)) for i, a in enumerate(words[:3]) for j, b in enumerate(words[:3]))


def test_no_scorer(spark):
    assert toxicity.train([[b"a"]], np.array([True])) is None
    assert [r["toxicity"] for r in toxicity.score_toxicity(frame(spark, [(1, "x")]), None).collect()] == [0.0]
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.fit(frame(spark, [(1, "x")]), labels) is None
    assert toxicity.score_toxicity(frame(spark, []), None).count() == 0


# ---- personal data

NAIVE = {
    0: r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    1: r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    2: r"[0-9]([\x20-]?[0-9])+",
    3: r"\+[0-9][\x20().0-9-]+[0-9]",
}


def naive(text):
    out = []
    for kind, p in NAIVE.items():
        for m in re.finditer(p, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            ok = kind == 0 or (kind == 1 and all(int(x) <= 255 for x in m[0].split("."))) or (kind == 2 and 16 <= len(digits) <= 19 and pii.luhn(digits)) or (kind == 3 and 8 <= len(digits) <= 15)
            if ok:
                out.append((kind, *m.span()))
    return out


def test_base_spans_are_the_patterns():
    rng = random.Random(7)
    for _ in range(4000):
        t = "".join(rng.choice("ab1234567890.@-+() %é" + "0" * 6) for _ in range(rng.randrange(50)))
        assert sorted(pii.base_spans(t)[0]) == naive(t), t
    assert pii.base_spans("a@b.c@d.e")[0] == [(0, 0, 5)] and pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    pii.base_spans("1" * 300_000 + "@" * 1000 + "a" * 300_000)


@pytest.fixture(scope="module")
def people(spark):
    rng = random.Random(12)
    card = lambda: next(c for c in iter(lambda: "4" + "".join(str(rng.randrange(10)) for _ in range(15)), None) if pii.luhn(c))
    make = [lambda: f"{rng.choice(['ann', 'bob', 'eve'])}.{rng.randrange(99)}@mail{rng.randrange(9)}.example.com", lambda: ".".join(str(rng.randrange(256)) for _ in range(4)), card, lambda: f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"]
    rows = []
    for k in range(260):
        w = ["".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 8))) for _ in range(40)]
        if k % 2:
            w[rng.randrange(40)] = rng.choice(make)()
        rows.append((k, " ".join(w)))
    return frame(spark, rows)


def test_tagger_learns_and_only_adds(spark, people):
    model = pii.fit(people)
    hidden = ["zq rt", "mail to bob.7 at mail3 dot example dot com now", "é" * 700 + " eve.5 at mail1 dot example dot com " + "ü" * 300]
    texts = [(1000 + k, t) for k, t in enumerate(hidden)]
    out = {r["doc_id"]: r["pii_spans"] for r in pii.find_personal_data(people.unionByName(frame(spark, texts)), model).collect()}
    plain_ = {r["doc_id"]: r["text"] for r in people.collect()}
    for k, t in plain_.items():
        base = [(pii.KINDS.index(s["kind"]), s["start"], s["end"]) for s in out[k] if s["base"]]
        assert base == naive(t)
    extra = [s for k in plain_ for s in out[k] if not s["base"]]
    assert len(extra) <= 3 and out[1000] == []
    found = [[hidden[k][s["start"] : s["end"]] for s in out[1000 + k] if s["kind"] == "email"] for k in (1, 2)]
    assert sum(bool(f) and "at mail" in f[0] for f in found) >= 1


class Says:
    """A tagger that finds one given span, of a given kind, in each text."""

    def __init__(self, kind, score=9.0):
        self.kind, self.score = kind, score

    def tag(self, texts):
        return [[(self.kind, 0, len(x), self.score)] for x in texts]


@pytest.mark.parametrize(
    "kind, texts, added",
    [
        (3, ["1 (212) 555-1234", "(212) 555-1234", "212 555 1234", "0044 20 7946 0958", "1.212.555.1234", "1-212-555-1234"], True),
        (2, ["4111.1111.1111.1111", "4111/1111/1111/1111"], True),
        (3, ["+1 212 55", "bob@mail.example.com 212 555 1234"], False),
        (2, ["4111 1111 1111 1112", "4111-1111-1111-1112"], False),
        (1, ["300.1.2.3"], False),
    ],
)
def test_added_spans_yield_to_dropped_matches_of_their_kind_only(spark, kind, texts, added):
    got = {r["doc_id"]: [s for s in r["pii_spans"] if not s["base"]] for r in pii.find_personal_data(frame(spark, list(enumerate(texts))), Says(kind)).collect()}
    for k, t in enumerate(texts):
        whole = [(t[s["start"] : s["end"]].strip("()"), s["kind"]) for s in got[k]]
        assert (len(whole) == 1 and whole[0][0] == t.lstrip("(") and whole[0][1] == pii.KINDS[kind]) if added else not whole, t


def test_respelled_phones_and_cards_are_found(spark, people):
    texts = [(k, f"{'soe tin hera ' * (k % 3)}note {t} then {'ria ' * 5}") for k, t in enumerate(["1 (212) 555-1234", "1-(312)-555-9876", "1.(415).555-2468", "4111.1111.1111.1111", "4012/8888/8888/1881"])]
    out = {r["doc_id"]: r for r in pii.find_personal_data(frame(spark, texts), pii.fit(people)).collect()}
    kinds = [{s["kind"] for s in out[k]["pii_spans"] if not s["base"]} for k in range(5)]
    assert sum("phone" in x for x in kinds[:3]) >= 2 and sum("card" in x for x in kinds[3:]) >= 1, kinds


def test_windows_agree_with_whole_and_maybe_is_exact():
    model = pii.Tagger(3)
    rng = np.random.default_rng(0)
    x = rng.integers(1, pii.CLASSES, (64, 50))
    for scale in (0.5, 2.0):
        model.p["b"][0] = scale
        e = model.emissions(x)
        path = model.viterbi(e)
        assert set(np.flatnonzero(path.any(0))) <= set(model.maybe(e).tolist())


class Marks(pii.Tagger):
    """A tagger that takes each run of @ for an email."""

    def emissions(self, x):
        e = np.zeros((x.shape[0], len(pii.KINDS) + 1, x.shape[1]), np.float32)
        e[:, 1] = np.where(x == pii.classes_of(np.frombuffer(b"@", np.uint8))[0], 5, -5)
        e[:, 2:] = -9
        return e


@pytest.mark.parametrize("size", [8, 44, 60, 128, 300, 900])
def test_spans_over_window_edges_stay_whole(size):
    places = [0, 1, *range(100, 1200, 7)]
    texts = [pii.classes_of(np.frombuffer(b"a" * p + b"@" * size + b"b" * (2500 - p - size), np.uint8)) for p in places]
    got = Marks(1).tag([*texts, texts[0][:size], texts[0][:3]])
    assert [[x[:3] for x in g] for g in got] == [*[[(0, p, p + size)] for p in places], [(0, 0, size)], []]


def test_gradients():
    model = pii.Tagger(1)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, pii.CLASSES, (7, 3)), rng.integers(0, 5, (7, 3))

    def loss():
        e = model.emissions(x).astype(np.float64)
        A = model.p["A"]
        a = e[0]
        for t in range(1, 7):
            s = a[:, None] + A[:, :, None]
            a = np.log(np.exp(s).sum(0)) + e[t]
        gold = sum(e[t, y[t], np.arange(3)] + (A[y[t - 1], y[t]] if t else 0) for t in range(7))
        return float((np.log(np.exp(a).sum(0)) - gold).sum())

    g = model._gradients(x, y)
    for k in ("A", "W", "b", "Uf", "Ub", "Pf", "Pb"):
        i = tuple(int(rng.integers(n)) for n in model.p[k].shape) if k not in ("Pf", "Pb") else (int(rng.integers(32)), int(x[3, 1]))
        before = model.p[k][i]
        model.p[k][i] = before + 1e-2
        up = loss()
        model.p[k][i] = before - 1e-2
        down = loss()
        model.p[k][i] = before
        assert g[k][i] == pytest.approx((up - down) / 2e-2, rel=0.05, abs=5e-3), k


def test_personal_data_of_nothing(spark):
    assert pii.fit(frame(spark, [(1, "nothing here")])) is None
    df = frame(spark, [(1, None), (2, ""), (3, "a@b.cd")], "pii_spans")
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["pii_spans"]] for r in pii.find_personal_data(df, None).collect()}
    assert got == {1: [], 2: [], 3: [("email", 0, 6)]}
    assert pii.find_personal_data(df.limit(0), None).count() == 0


# ---- pages


def test_pages_held_out():
    rng = np.random.default_rng(77)
    pages = [htmlextract.page_maker(rng) for _ in range(80)]
    model, dom = htmlextract.trained(), htmlextract.Dom()
    for p in pages:
        dom.add(p)
    nodes = htmlextract.Nodes(dom)
    truth, _ = htmlextract.truth(nodes)
    got = nodes.decode(model.scores(nodes.features()))
    leaf = nodes.kind == 0
    right = (got == truth)[leaf] * nodes.own[0][leaf]
    assert right.sum() / nodes.own[0][leaf].sum() > 0.97
    for k, p in enumerate(nodes.parent):
        assert p < 0 or got[p] == htmlextract.OPEN or got[k] == got[p]


def test_page_text():
    model = htmlextract.trained()
    body = "".join(f"<p>Sentence number {k} of the story, with  some\n&amp; more &eacute;&#33; words in it.</p>" for k in range(6))
    page = f'<html><head><title>t</title><script>var a="</p>"</script></head><body><nav><ul><li><a href=/>Home</a></li><li><a href=/b>News</a></li></ul></nav><article><h1>The <b>Title</b></h1>{body}<p><b>Bold start<br>of line<p>Last one</article><footer>&copy; site</footer></body>'
    text = htmlextract.main_texts([page], model)[0].split("\n\n")
    assert text[0] == "The Title" and text[1] == "Sentence number 0 of the story, with some & more é! words in it." and text[-2:] == ["Bold start of line", "Last one"] and len(text) == 9
    for odd in ("", "<", "<p", "<!--", "<a href='", "</p></div>", "<script>never ends", "<b>" * 5000, "<div>" * 3000 + "x", "<table><tr><td>1<td>2<tr><td>3</table>", "plain &lt;text&gt;", "\0�<p>\x0b</p>"):
        htmlextract.main_texts([odd], model)


def test_pages_of_nothing(spark):
    df = spark.createDataFrame([(1, "u", None), (2, "u", "")], "page_id long, url string, html string")
    assert [r["main_text"] for r in htmlextract.extract(df).collect()] == ["", ""]
    assert htmlextract.extract(df.limit(0)).count() == 0 and htmlextract.extract(df.withColumn("main_text", F.lit(1)), keep=["page_id"]).columns == ["page_id", "main_text"]


# ---- embeddings


def brute_vectors(rows, least):
    ids, edges, links = [r[0] for r in rows], [], {}
    for i, x, lab in rows:
        for j, y, other in rows:
            if i == j or lab is None or lab != other or x is None or y is None or len(x) != len(y):
                continue
            a, b = np.array(x, float), np.array(y, float)
            if None in x or None in y or not (np.isfinite(a).all() and np.isfinite(b).all()) or not a.any() or not b.any():
                continue
            if a @ b / np.sqrt((a @ a) * (b @ b)) >= least:
                edges.append((i, j))
                links[i] = links.get(i, 0) + 1
    up = {i: i for i in ids}
    for _ in ids:
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    return sorted(((i, links.get(i, 0), up[i], up[i] == i) for i in ids), key=repr)


@pytest.mark.parametrize("shard", [4096, 40])
def test_vectors_against_brute_force(spark, shard):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(140):
        base = rng.normal(size=12) if k % 7 == 0 else base  # noqa: F821
        x = base + rng.normal(size=12) * [0, 0.02, 0.08, 1][k % 4]
        rows.append((k, [float(np.float32(v)) for v in x], int(k // 7 % 3)))
    rows += [(200, None, 1), (201, [0.0] * 12, 1), (202, [float("nan")] * 12, 1), (203, [None] * 12, 1), (204, [float("inf")] + [1.0] * 11, 1), (205, rows[0][1], None), (206, [2 * v for v in rows[0][1]], rows[0][2]), (207, rows[0][1][:5], rows[0][2]), (208, [], 1), (209, rows[0][1], rows[0][2]), (210, rows[0][1], rows[0][2])]
    df = spark.createDataFrame([(*r, 9) for r in rows], "vec_id long, embedding array<float>, label int, n_links int").repartition(3)
    assert plain(hnsw.near_duplicates(df, shard=shard, recall=1.0)) == brute_vectors(rows, 0.98)


def test_graph_recall():
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(60, 32))
    x = hnsw.unit(np.vstack([c + 0.05 * rng.normal(size=(30, 32)) for c in centers] + [rng.normal(size=(600, 32))]))
    x = x[rng.permutation(len(x))]
    g = hnsw.Graph.build(x)
    true = set(zip(*np.nonzero(x @ x.T >= 0.98), strict=True))
    i, j = g.links(x, 0.98 - hnsw.SLACK, hnsw.BEAM)
    got = {(a, b) for a, b in zip(i, j, strict=True) if x[a] @ x[b] >= 0.98}
    assert got <= true and len(got) / len(true) > 0.98


def test_vectors_of_nothing(spark):
    assert hnsw.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    odd = spark.createDataFrame([(None, [1.0], 1), (1, None, None), (1, [1.0], 2), (1, [1.0], 2)], "vec_id long, embedding array<float>, label int")
    assert plain(hnsw.near_duplicates(odd)) == plain(spark.createDataFrame([(None, 0, None, False), (1, 0, 1, True), (1, 0, 1, True), (1, 0, 1, True)], "vec_id long, n_links long, component_id long, kept boolean"))

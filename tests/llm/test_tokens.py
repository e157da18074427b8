import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from jaglet.llm import packing, tokencounts
from jaglet.llm.common import materialize
from jaglet.llm.tokenizer import default_path, encoder
from tests.llm.helpers import frame, words


@pytest.fixture(scope="module")
def slow():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(default_path())
    return lambda t: whole.encode(t, add_special_tokens=False).ids


def test_ids_are_the_library_s(slow):
    rng = random.Random(1)
    alphabet = "aZé漢 \n\t'0½$_.<|endoftext|>\U0001f600"
    encode = encoder(default_path())
    for _ in range(300):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))
        assert encode(t).tolist() == slow(t)
    assert encode("<|endoftext|>").tolist() == slow("<|endoftext|>")


def corpus():
    rng = random.Random(2)
    rows = [(k, " ".join(words(rng, rng.choice([1, 3, 30, 200, 700])))) for k in range(60)]
    return rows + [(100, None), (101, ""), (102, " ".join(words(rng, 5000))), (103, "x " * 2047), (104, "same"), (105, "same"), (105, "same"), (None, "no id")]


def test_pieces_and_packing(spark, slow):
    rows = corpus()
    pieces = packing.tokenize_pieces(frame(spark, rows, "ids").repartition(3))
    held = pieces.toPandas()
    want = []
    for i, t in rows:
        ids = [*slow(t or ""), 0]
        first = (len(ids) - 1) % 2048 + 1
        at, k = 0, 0
        while at < len(ids):
            n = first if k == 0 else 2048
            want.append((i, k, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())))
            at, k = at + n, k + 1
    clean = lambda v: None if v is None or v != v else int(v)
    got = [(clean(r.doc_id), r.piece, r.start, r.length, zlib.crc32(r.ids)) for r in held.itertuples()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    out = packing.packed(frame(spark, rows).repartition(5))
    by = {}
    for r in out.collect():
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    assert sorted(by) == list(range(len(by))) and out.count() == len(want)
    total = sum(x[3] for x in want)
    assert len(by) <= -(-total // 2048) + 2


def simple_bfd(lengths, limit):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, g in enumerate(bins) if g >= n]
        if fits:
            k = min(fits, key=lambda k: bins[k])
            bins[k] -= n
        else:
            bins.append(limit - n)
    return len(bins)


@pytest.mark.parametrize("seed", range(4))
def test_plan(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(1 + rng.exponential(60, 3000).astype(int), 200) if seed % 2 else rng.integers(30, 110, 2000)
    counts = np.bincount(lengths, minlength=201)
    plan = packing.Plan(counts, 200)
    n = np.repeat(np.arange(201), counts)
    rank = np.concatenate([np.arange(c) for c in counts])
    seq, at = plan.place(n, rank)
    for s in range(plan.sequences):
        parts = sorted(zip(at[seq == s], n[seq == s], strict=True))
        assert parts[0][0] == 0 and all(a + x == b for (a, x), (b, _) in zip(parts, parts[1:], strict=False)) and sum(parts[-1]) <= 200
    assert plan.sequences <= simple_bfd(lengths.tolist(), 200) + 1 and plan.sequences >= -(-lengths.sum() // 200)
    assert len(plan.table) < 201 * 12


def test_packing_limits(spark):
    some = spark.createDataFrame([(1, 5), (2, 5)], "k long, length long")
    assert [r["sequence_id"] for r in packing.pack(some, 10).collect()] == [0, 0]
    with pytest.raises(ValueError):
        packing.pack(some, 4)
    assert packing.packed(frame(spark, [])).count() == 0


# ---- rollups


def brute(state):
    out = {}
    for (_, tokenizer), (source, lang, n) in state.items():
        d, t = out.get((source, lang, tokenizer), (0, 0))
        out[(source, lang, tokenizer)] = (d + 1, t + n)
    return sorted(((*k, *v) for k, v in out.items()), key=repr)


def test_rollup_against_replay(spark, tmp_path):
    rng = random.Random(3)
    rollup = tokencounts.Rollup(spark, str(tmp_path / "r"))
    kind = "doc_id long, source string, lang string, tokenizer string, n_tokens long, op string"
    state = {}
    for b in range(5):
        rows, seen = [], set()
        for _ in range(40):
            key = (rng.randrange(30), rng.choice(["v1", "v2"]))
            if key in seen:
                continue
            seen.add(key)
            op = "delete" if rng.random() < 0.3 else "upsert"
            row = (rng.choice(["a", "b", None]), rng.choice(["en", None]), rng.randrange(100))
            rows.append((key[0], row[0], row[1], key[1], row[2], op))
            state.pop(key, None)
            if op == "upsert":
                state[key] = row
        changes = spark.createDataFrame(rows, kind)
        assert rollup.commit(f"b{b}", changes)
        assert not rollup.commit(f"b{b}", changes.limit(3))
        assert sorted(map(tuple, rollup.totals().collect()), key=repr) == brute(state)
        if b == 2:  # the batches so far as one; later ones go on from it
            rollup.compact()
            rollup.compact()
            assert sorted(map(tuple, rollup.totals().collect()), key=repr) == brute(state)
    assert rollup.committed() == [f"b{b}" for b in range(5)]
    rollup.commit("empty", spark.createDataFrame([], kind))
    rollup.commit("odd", spark.createDataFrame([(None, "a", "en", "v1", 5, "upsert"), (99, "z", "en", "v1", None, "upsert"), (98, "z", "en", "v1", 4, "upsert"), (98, "z", "en", "v1", 4, "delete"), (98, "z", "en", "v1", 9, "upsert")], kind))
    assert ("z", "en", "v1", 1, 0) in [tuple(r) for r in rollup.totals().collect()]
    with pytest.raises(ValueError):
        rollup.commit("bad", spark.createDataFrame([(1, "a", "en", "v1", 5, "move")], kind))
    with pytest.raises(ValueError):
        rollup.commit("a/b", spark.createDataFrame([], kind))


def test_interrupted_batch_is_not_read(spark, tmp_path):
    rollup = tokencounts.Rollup(spark, str(tmp_path / "r"))
    kind = "doc_id long, source string, lang string, tokenizer string, n_tokens long, op string"
    one = spark.createDataFrame([(1, "a", "en", "v1", 5, "upsert")], kind)
    rollup.commit("x", one)
    for part in ("ledger", "deltas"):  # a batch that got this far and no marker
        spark.read.parquet(str(tmp_path / "r" / part / "batch=x")).write.parquet(str(tmp_path / "r" / part / "batch=y"))
    assert [tuple(r) for r in rollup.totals().collect()] == [("a", "en", "v1", 1, 5)]
    rollup.commit("y", spark.createDataFrame([(2, "a", "en", "v1", 7, "upsert")], kind))
    assert [tuple(r) for r in rollup.totals().collect()] == [("a", "en", "v1", 2, 12)]


def test_of_two_writers_one_fails(spark, tmp_path):
    rollup = tokencounts.Rollup(spark, str(tmp_path / "r"))
    one = spark.createDataFrame([(1, "a", "en", "v1", 5, "upsert")], "doc_id long, source string, lang string, tokenizer string, n_tokens long, op string")
    assert rollup._mark("markers", 0, "theirs") and not rollup._mark("markers", 0, "ours") and rollup.committed() == ["theirs"]
    late = tokencounts.Rollup(spark, str(tmp_path / "s"))
    late.committed = lambda: []  # saw the state before another's batch
    late._mark("markers", 0, "theirs")
    with pytest.raises(RuntimeError):
        late.commit("ours", one)


def test_counts_query(spark, slow, tmp_path):
    rows = [(1, "Hello there"), (2, None), (3, ""), (4, "x" * 50)]
    df = frame(spark, rows, "n_tokens")
    got = {r["doc_id"]: r["n_tokens"] for r in tokencounts.count_tokens(df).collect()}
    assert got == {i: len(slow(t or "")) for i, t in rows}
    df.write.parquet(str(tmp_path / "documents.parquet"))
    out = {(r["source"], r["lang"], r["tokenizer"]): (r["n_docs"], r["n_tokens"]) for r in tokencounts.op8_token_counts(spark, str(tmp_path)).collect()}
    assert out[("src1", "en", "words_v1")] == (1, 2) and out[("src1", "fr", "byte_bpe_50k")] == (1, len(slow("x" * 50))) and sum(v[0] for v in out.values()) == 4
    assert materialize(df, "t").count() == 4 and F is not None

import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from jaglet.llm import wordhash as wh
from jaglet.llm.common import crc_mod_value, slices, text_view

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PATTERNS = ((wh.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), (wh.BLANKS, r"[^\x20\x09-\x0D]+"))
texts = st.lists(st.one_of(st.none(), st.text(st.sampled_from("aAbZ09 \t\n.-\x0b\x1f\x7fé漢 "), max_size=40)), max_size=8)


@given(texts, st.sampled_from([1, 3, 7, 1 << 20]))
def test_words_are_those_of_the_pattern(some, block):
    before, wh.BLOCK = wh.BLOCK, block
    try:
        data, at = text_view(pa.array(some, pa.string()))
        for table, pattern in PATTERNS:
            h, s, e, first = wh.words(data, at, table)
            got = [bytes(data[a:b]).decode().translate(LOWER) for a, b in zip(s, e, strict=True)]
            want = [re.findall(pattern, (t or "").translate(LOWER)) for t in some]
            assert got == [w for x in want for w in x]
            assert np.diff(first).tolist() == [len(x) for x in want]
            assert len(set(h.tolist())) == len(set(got))
            assert all((h[i] == h[j]) == (got[i] == got[j]) for i in range(min(6, len(h))) for j in range(i))
    finally:
        wh.BLOCK = before


@given(texts, st.integers(1, 5))
def test_shingles(some, size):
    data, at = text_view(pa.array(some, pa.string()))
    h, _, _, first = wh.words(data, at, wh.BLANKS)
    s, text = wh.distinct(*wh.shingles(h, first, size))
    for i, t in enumerate(some):
        w = (t or "").translate(LOWER)
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", w) if x]
        want = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
        assert (text == i).sum() == len(want)
        own = s[text == i]
        assert (np.diff(own.astype(object)) > 0).all() if len(own) > 1 else True


def test_views_and_slices():
    a = pa.array(["ab", None, "", "c"]).slice(1)
    data, at = text_view(a)
    assert np.diff(at).tolist() == [0, 0, 1] and bytes(data[at[0] : at[-1]]) == b"c"
    assert list(slices(np.array([0, 5, 6, 7, 30]), 3)) == [(0, 1), (1, 3), (3, 4)]
    assert text_view(pa.array([], pa.string()))[1].tolist() == [0]
    assert crc_mod_value(17, 4) == __import__("zlib").crc32(b"17") % 4


def test_long_word():
    t = "x" * 3_000_000 + " y"
    data, at = text_view(pa.array([t]))
    h, s, e, _ = wh.words(data, at, wh.BLANKS)
    assert (e - s).tolist() == [3_000_000, 1] and len(set(h.tolist())) == 2


@pytest.mark.parametrize("a,b", [("Aa", "aA"), ("É", "é")])
def test_case(a, b):
    data, at = text_view(pa.array([a, b]))
    h, s, e, _ = wh.words(data, at, wh.BLANKS)
    assert (h[0] == h[1]) == a.isascii()
    x = wh.exact(data, s, e)
    assert x[0] != x[1]

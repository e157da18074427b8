"""Words of UTF-8 texts as 64-bit hashes, vectorised over many texts at once.

A text is lower-cased over A-Z only and cut at separator bytes. Both word patterns in use keep every byte
from 0x80 up inside words, so bytes may stand for code points. The hash of a word is a polynomial over random
64-bit values of its bytes, modulo 2**64; sums of a prefix table give every word's polynomial in a few passes.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15 | 1)
INVERSE = U64(pow(int(BASE), -1, 1 << 64))
BLOCK = 1 << 20

_values = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) | U64(1)
_values[ord("A") : ord("Z") + 1] = _values[ord("a") : ord("z") + 1]
LOWERED = _values


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    """in_word[byte] for separators given as inclusive byte ranges."""
    in_word = np.ones(256, bool)
    for a, b in ranges:
        in_word[a : b + 1] = False
    return in_word


#: Words of letters, digits and non-ASCII characters, once A-Z is lower-cased.
ALNUM = separators((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
#: Words between white space.
BLANKS = separators((0x20, 0x20), (0x09, 0x0D))

EXACT = np.random.default_rng(20240301).integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) | U64(1)

_power = np.ones(1, U64)
_unpower = np.ones(1, U64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _power, _unpower
    if len(_power) < n:
        size = max(n, BLOCK + 1024)
        with np.errstate(over="ignore"):
            _power = np.cumprod(np.concatenate(([U64(1)], np.full(size - 1, BASE))), dtype=U64)
            _unpower = np.cumprod(np.concatenate(([U64(1)], np.full(size - 1, INVERSE))), dtype=U64)
    return _power, _unpower


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def words(data: np.ndarray, offsets: np.ndarray, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends, first): all words of the texts data[offsets[i]:offsets[i+1]] in order.

    starts and ends are byte positions in data; words of text i are first[i]:first[i+1]. Bytes are handled in
    blocks that end between words, so memory beyond the result doesn't grow with a text.
    """
    lo, hi = int(offsets[0]), int(offsets[-1])
    edges = np.unique(offsets)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while lo < hi:
        end = min(lo + BLOCK, hi)
        if end < hi and in_word[data[end]] and in_word[data[end - 1]]:
            # step back to the last place where a word can't go on
            apart = np.flatnonzero(~in_word[data[lo:end]])
            edge = int(edges[np.searchsorted(edges, end, "right") - 1])
            cut = max(lo + int(apart[-1]) + 1 if len(apart) else lo, edge)
            if cut <= lo:  # one word fills the block: run to its end
                cut, step = end, BLOCK
                stop = int(edges[np.searchsorted(edges, end, "left")])
                while cut < stop:
                    apart = np.flatnonzero(~in_word[data[cut : min(cut + step, stop)]])
                    if len(apart):
                        cut += int(apart[0])
                        break
                    cut = min(cut + step, stop)
            end = cut
        found.append(_block(data, lo, end, edges, in_word))
        lo = end
    if not found:
        none = np.zeros(0, np.int64)
        return np.zeros(0, U64), none, none, np.zeros(len(offsets), np.int64)
    h, s, e = (np.concatenate(x) if len(found) > 1 else x[0] for x in zip(*found, strict=True))
    return h, s, e, np.searchsorted(s, offsets)


def _block(data, lo, hi, edges, in_word):
    part = data[lo:hi]
    inside = in_word[part]
    inner = edges[np.searchsorted(edges, lo, "right") : np.searchsorted(edges, hi, "left")] - lo
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[inner] = inside[inner]
    starts = np.flatnonzero(begins)
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    stops[inner - 1] = inside[inner - 1]
    ends = np.flatnonzero(stops) + 1
    power, unpower = _tables(len(part) + 1)
    with np.errstate(over="ignore"):
        sums = np.cumsum(LOWERED[part] * power[: len(part)], dtype=U64)
        total = sums[ends - 1]
        head = starts > 0
        total[head] -= sums[starts[head] - 1]
        h = mix(total * unpower[starts])
    return h, starts + lo, ends + lo


def exact(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Second, case-keeping hashes of the spans data[starts:ends], which ascend and don't overlap."""
    if not len(starts):
        return np.zeros(0, U64)
    out, i = [], 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        power, unpower = _tables(hi - lo + 1)
        with np.errstate(over="ignore"):
            sums = np.concatenate((np.zeros(1, U64), np.cumsum(EXACT[data[lo:hi]] * power[: hi - lo], dtype=U64)))
            out.append(mix((sums[ends[i:j] - lo] - sums[starts[i:j] - lo]) * unpower[starts[i:j] - lo]))
        i = j
    return np.concatenate(out)


def shingles(h: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, text of each): runs of `size` consecutive words; the whole of a shorter text is one run."""
    counts = np.diff(first)
    if not len(h):
        return np.zeros(0, U64), np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(counts)), counts)
    left = first[1:][text] - np.arange(len(h))  # words from here to the end of the text
    with np.errstate(over="ignore"):
        rolled = np.zeros(len(h), U64)
        for k in range(min(size, len(h))):
            nxt = np.zeros(len(h), U64)
            nxt[: len(h) - k] = h[k:] if k else h
            nxt[left <= k] = 0
            rolled = mix(rolled + U64(0x9E3779B97F4A7C15)) + nxt
    keep = (left >= size) | ((counts[text] < size) & (left == counts[text]))
    return mix(rolled[keep]), text[keep]


def distinct(h: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each text, sorted by text, then hash."""
    if not len(h):
        return h, text
    order = np.argsort(h, kind="stable")
    order = order[np.argsort(text[order], kind="stable")]
    h, text = h[order], text[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[keep], text[keep]

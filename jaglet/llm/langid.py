"""Language identification by nearest centroid over TF-IDF vectors of character n-grams.

A text is lower-cased over A-Z, runs of other ASCII than letters are one blank, and its 1- to 4-grams of UTF-8 bytes
are counted in BUCKETS hashed features, over the whole text. Weights are (1 + ln count) * idf, normalised. Document
frequencies are counted over all learnable documents; centroids are clustered, several per language, from a
hash-chosen sample of about SAMPLE documents of each language. A text gets the language of the centroid with the
highest cosine. It is rejected when that cosine is below what its centroid's own members reach, for its length.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jaglet.llm.common import crc_mod, extended, over_batches, place, session_of, slices, table, text_view

BUCKETS = 4096
#: Bound of the labelled sample: about so many documents of each language, chosen by a hash of their ids.
SAMPLE = 300
CENTROIDS = 3
#: Bound of the languages learnt, which the broadcast centroids grow with: those with the most documents.
MOST_LANGUAGES = 1000
#: A text is rejected below both these shares of what its language's texts of its length come to: of their median
#: cosine, and of the cosine that a twentieth of them is below (short texts scatter widely).
REJECT, LOW = 0.4, 0.8
CHUNK = 1 << 19
LENGTHS = np.array([1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048, 4096, 8192])
RESULT = ("lang_pred", "lang_score", "lang_rejected")

_letters = np.zeros(256, np.uint8) + 32
for _a, _b in ((97, 122), (128, 255)):
    _letters[_a : _b + 1] = np.arange(_a, _b + 1)
_letters[65:91] = np.arange(97, 123)
_tables = np.random.default_rng(7).integers(1, 1 << 32, (4, 256), dtype=np.int64).astype(np.uint32)


def counts_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, BUCKETS) counts of the n-grams that hold a letter."""
    n = len(offsets) - 1
    lo, hi = int(offsets[0]), int(offsets[-1])
    total = np.zeros(n * BUCKETS, np.int32)
    step = 1 << 20
    for a in range(lo, hi, step):  # blocks overlap by the longest n-gram less one byte
        b = min(a + step, hi)
        part = _letters[data[a : min(b + 3, hi)]]
        text = np.searchsorted(offsets, np.arange(a, a + len(part)), "right") - 1 if n > 1 else np.zeros(len(part), np.int64)
        blank = part == 32
        base = text * BUCKETS
        h = np.zeros(len(part), np.uint32)
        with np.errstate(over="ignore"):
            for k in range(4):
                size = len(part) - k
                if size <= 0:
                    break
                h = h[:size] + _tables[k][part[k:]]
                # a gram starts in the block, stays in its text, and is no run of blanks
                ok = (text[:size] == text[k:]) & ~(blank[:size] & blank[k:])
                ok[b - a :] = False
                mixed = (h * np.uint32(0x9E3779B1)) >> np.uint32(20)
                total += np.bincount((base[:size] + mixed)[ok], minlength=len(total)).astype(np.int32)
    return total.reshape(n, BUCKETS)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = counts.astype(np.float32)
    some = x > 0
    x[some] = 1 + np.log(x[some])
    x *= idf
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def cluster(x: np.ndarray, k: int) -> np.ndarray:
    """Up to k unit centroids: spherical k-means from the first row on, each next start the farthest row."""
    centers = x[:1]
    while len(centers) < min(k, len(x)):
        best = (x @ centers.T).max(1)
        if best.min() > 0.9999:
            break
        centers = np.vstack((centers, x[int(best.argmin())]))
    for _ in range(12):
        near = (x @ centers.T).argmax(1)
        sums = np.stack([x[near == i].sum(0) if (near == i).any() else c for i, c in enumerate(centers)])
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = sums / np.where(norm > 0, norm, 1)
    return centers


class Model:
    """langs[i] is the language of row i of centroids; floor[i, k] the least cosine for texts of length class k."""

    def __init__(self, langs: list[str], centroids: np.ndarray, idf: np.ndarray, floor: np.ndarray):
        self.langs, self.centroids, self.idf, self.floor = langs, centroids, idf, floor

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of the nearest centroid, cosine, rejected) of each text."""
        near, score, low = [], [], []
        for i, j in slices(offsets, CHUNK):
            for a in range(i, j, 128):
                b = min(a + 128, j)
                cos = vectors(counts_of(data, offsets[a : b + 1]), self.idf) @ self.centroids.T
                k = cos.argmax(1)
                s = cos[np.arange(len(k)), k]
                near.append(k), score.append(np.clip(s, 0, 1)), low.append(s < self.floor[k, length_class(np.diff(offsets[a : b + 1]))])
        if not near:
            return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool)
        return np.concatenate(near), np.concatenate(score).astype(np.float64), np.concatenate(low)


def _by_length(cos: np.ndarray, near: np.ndarray, q: float) -> np.ndarray:
    """A quantile of cosines by length class; classes without members take from those beside them, the first ones nothing."""
    own = np.array([np.quantile(cos[near == k], q) if (near == k).any() else np.nan for k in range(len(LENGTHS))])
    seen = np.flatnonzero(~np.isnan(own))
    own = np.minimum.accumulate(np.interp(np.arange(len(LENGTHS)), seen, own[seen])[::-1])[::-1].copy()
    own[: seen[0]] = 0
    return own


def length_class(size: np.ndarray) -> np.ndarray:
    return np.maximum(np.searchsorted(LENGTHS, size, "right") - 1, 0)


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE) -> Model | None:
    """The model of all rows of docs with a text and a language; None without any.

    Document frequencies are of all rows. The sample of a language has `sample` rows in expectation (all rows of
    a rarer one) and twice that at most, chosen by hash of the id, or of the text where there is no id. Repeated rows
    are rows of their own; rows with a null text or language are left out; texts are read whole, in blocks. Of more
    than MOST_LANGUAGES languages the commonest are learnt.
    """
    spark = session_of(docs)
    own = F.when(F.col(f"`{id_col}`").isNotNull(), F.xxhash64(f"`{id_col}`")).otherwise(F.xxhash64(f"`{text_col}`"))
    rows = docs.select(own.alias("h"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").alias("text")).where("lang is not null and text is not null")

    def frequencies(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(BUCKETS, np.int64), 0
        for b in batches:
            data, at = text_view(b.column(0))
            for i, j in slices(at, CHUNK):
                for a in range(i, j, 128):
                    df += (counts_of(data, at[a : min(a + 128, j) + 1]) > 0).sum(0)
            n += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS + 1)), pa.array(np.append(df, n))], ["k", "n"])

    df = np.zeros(BUCKETS + 1, np.int64)
    got = rows.select("text").mapInArrow(frequencies, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    df[got.column(0).to_numpy()] = got.column(1).to_numpy()
    if not df[-1]:
        return None
    idf = np.log((1 + df[-1]) / (1 + df[:-1])).astype(np.float32)
    # the share of a row's hash in its range picks the rows of a language evenly, the lowest in any case
    level = F.pmod("h", F.lit(1_000_003)) / 1_000_003.0
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min(level).alias("low")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], max(float(sample) / r["n"], r["low"]))])
    picked = rows.where(level <= F.try_element_at(share, F.col("lang"))).select("lang", "h", "text")
    shared = spark.sparkContext.broadcast(idf)

    def vectorise(b: pa.RecordBatch) -> pa.RecordBatch:
        data, at = text_view(b.column(2))
        x = [vectors(counts_of(data, at[i : j + 1]), shared.value) for i, j in slices(at, CHUNK)]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.diff(at)), pa.array([r.tobytes() for p in x for r in p], pa.binary())], ["lang", "h", "size", "x"])

    def centroids(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        x = np.stack([np.frombuffer(r, np.float32) for r in pdf["x"]])
        c = cluster(x, CENTROIDS)
        cos, near = (x @ c.T).max(1), length_class(pdf["size"].to_numpy())
        floor = np.minimum(REJECT * _by_length(cos, near, 0.5), LOW * _by_length(cos, near, 0.05))
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "k": range(len(c)), "x": [r.astype(np.float32).tobytes() for r in c], "floor": [floor.astype(np.float32).tobytes()] * len(c)})

    # rows that share a hash (without ids, equal texts) are in the sample together; a language's part of it stays bounded
    place_in = F.row_number().over(Window.partitionBy("lang").orderBy("h", "size", "x"))
    bounded = over_batches(picked, vectorise, "lang string, h long, size long, x binary").withColumn("at", place_in).where(F.col("at") <= 2 * sample)
    grouped = bounded.groupBy("lang").applyInPandas(centroids, "lang string, k int, x binary, floor binary")
    found = sorted(grouped.collect(), key=lambda r: (r["lang"], r["k"]))
    return Model([r["lang"] for r in found], np.stack([np.frombuffer(r["x"], np.float32) for r in found]), idf, np.stack([np.frombuffer(r["floor"], np.float32) for r in found]))


def identify(docs: DataFrame, model: Model | None, text_col: str = "text", keep: Iterable[str] | None = None) -> DataFrame:
    """docs (or its columns `keep`) with lang_pred, lang_score (cosine, 0 to 1) and lang_rejected; no shuffle.

    A null text, or one without a letter, is "und" with score 0 and rejected, as is every text without a model.
    Others always have a learned language; ties go to the first in order of name. Columns of docs that bear
    a result's name are replaced. An empty table gives an empty table.
    """
    spark = session_of(docs)
    shared = spark.sparkContext.broadcast(model)
    text = F.col(f"c{place(docs, text_col)}")

    def kernel(b: pa.RecordBatch):
        m, letters = shared.value, np.asarray(b.column(1))
        if m is None:
            pred, score, low = ["und"] * b.num_rows, np.zeros(b.num_rows), np.ones(b.num_rows, bool)
        else:
            near, score, low = m.predict(*text_view(b.column(0)))
            pred = [m.langs[k] if ok else "und" for k, ok in zip(near, letters, strict=True)]
            score, low = np.where(letters, score, 0.0), low | ~letters
        yield 0, b.num_rows, [pa.array(pred, pa.string()), pa.array(score), pa.array(low)]

    added = [T.StructField(n, t()) for n, t in zip(RESULT, (T.StringType, T.DoubleType, T.BooleanType), strict=True)]
    return extended(docs, kernel, added, [text, F.coalesce(text.rlike(r"\p{L}"), F.lit(False))], keep)


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every document; learnt from documents whose crc32(doc_id) mod 4 isn't 2."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(crc_mod(F.col("doc_id"), 4) != 2))
    return identify(docs, model, keep=["doc_id"]).select(
        "doc_id", F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), "lang_rejected"
    )

"""Packing documents into training sequences: best fit with a two-for-one refinement.

Tokenizing is a single pass without a shuffle. Which piece goes where only depends on lengths, and there are at
most `limit` of them, so the plan is made on the driver from a histogram of lengths, whatever the corpus's size:
a sequence is filled greedily with the longest length that fits, then its shortest piece is replaced by two
unpacked ones if these fill the expanded gap more tightly. The pattern found is what the same procedure would
choose again until a length runs out, so it is repeated that often at once; there are a few patterns per length at
most. A piece finds its place from its rank among the pieces of its length. Ranks are counted in salted buckets of
a length, so many equal lengths (copies) don't meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jaglet.llm.common import materialize, session_of, table
from jaglet.llm.tokenizer import default_path, encoder

LIMIT = 2048
END_ID = 0
BUCKET_ROWS = 20_000


def tokenize_pieces(docs: DataFrame, path: str | None = None, limit: int = LIMIT, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids (unsigned 32-bit little-endian): documents as pieces of at most limit ids.

    A document is its text's ids, then end_id; a null text counts as empty. Only longer documents are cut,
    so that all pieces but the first are full. Rows that repeat give pieces each; other columns are not read.
    """
    session_of(docs)
    path = path or default_path()
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    kind = T.StructType([rows.schema["doc_id"], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for b in batches:
            row, piece, start, length, ids, held = [], [], [], [], [], 0
            for i, t in enumerate(b.column(1)):
                raw = np.append(encode(t.as_py() or ""), np.uint32(end_id)).astype("<u4")
                at, k = 0, 0
                while at < len(raw):
                    n = (len(raw) - at - 1) % limit + 1 if k == 0 else limit
                    row.append(i), piece.append(k), start.append(at), length.append(n), ids.append(raw[at : at + n].tobytes())
                    at, k, held = at + n, k + 1, held + n
                if held >= 1 << 20 or i + 1 == b.num_rows:
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())], kind.names)
                    row, piece, start, length, ids, held = [], [], [], [], [], 0

    return rows.mapInArrow(run, kind)


class Plan:
    """Where the pieces of each length go: the r-th piece of a length has a sequence and an offset."""

    def __init__(self, counts: np.ndarray, limit: int):
        """counts[n] pieces of n ids, 0 <= n <= limit."""
        left = [int(c) for c in counts]
        mask = sum(1 << n for n in range(1, limit + 1) if left[n])
        rank = [0] * (limit + 1)
        out: list[tuple[int, int, int, int, int]] = []
        self.sequences = 0
        while mask:
            bin_, gap, free = {}, limit, mask
            while fits := free & ((1 << (gap + 1)) - 1):
                n = fits.bit_length() - 1
                take = min(gap // n, left[n])
                bin_[n] = take
                gap -= n * take
                free &= ~(1 << n)
            if gap:
                self._two_for_one(bin_, gap, left, limit)
            repeat = min(left[n] // k for n, k in bin_.items())
            offset = 0
            for n, k in bin_.items():
                out.append((n, rank[n], k, self.sequences, offset))
                rank[n] += k * repeat
                left[n] -= k * repeat
                offset += n * k
                if not left[n]:
                    mask &= ~(1 << n)
            self.sequences += repeat
        out.sort()
        self.table = np.array(out, np.int64).reshape(-1, 5)
        self.keys = (self.table[:, 0] << 44) + self.table[:, 1]

    @staticmethod
    def _two_for_one(bin_: dict[int, int], gap: int, left: list[int], limit: int) -> None:
        small = min(bin_)
        room = gap + small
        free = np.array(left[: limit + 1]) - np.bincount(list(bin_), list(bin_.values()), limit + 1).astype(np.int64)
        lengths = np.flatnonzero(free > 0)
        a = lengths[(lengths > 0) & (lengths < room)]
        if not len(a):
            return
        # of each length as the longer one, the longest that is no longer, fits beside it, and is there once more
        largest = np.maximum.accumulate(np.where(free > 0, np.arange(limit + 1), 0))
        b = largest[np.minimum(a, room - a)]
        b = np.where((b == a) & (free[a] < 2), largest[a - 1], b)
        total = np.where(b > 0, a + b, 0)
        best = int(np.argmax(total))
        if total[best] <= small:
            return
        bin_[small] -= 1
        if not bin_[small]:
            del bin_[small]
        for n in (int(a[best]), int(b[best])):
            bin_[n] = bin_.get(n, 0) + 1

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces by length and rank (from 0)."""
        row = self.table[np.searchsorted(self.keys, (length << 44) + rank, "right") - 1]
        r = rank - row[:, 1]
        return row[:, 3] + r // row[:, 2], row[:, 4] + r % row[:, 2] * row[:, 0]


def pack(pieces: DataFrame, limit: int = LIMIT) -> DataFrame:
    """pieces (with length, 1 to limit; materialized) and sequence_id, offset; sequences are gapless from 0.

    Which of several pieces of one length comes first is decided by all columns in order; pieces alike in all
    columns are interchangeable. An empty table gives an empty table.
    """
    pieces = pieces.drop("sequence_id", "offset")
    total, most = pieces.agg(F.count("*"), F.max("length")).first()
    if most and most > limit:
        raise ValueError(f"a piece of {most} ids doesn't fit into {limit}")
    counts = np.zeros(limit + 1, np.int64)
    for n, c in pieces.groupBy("length").count().collect():
        counts[n] = c
    plan = pieces.sparkSession.sparkContext.broadcast(Plan(counts, limit))
    order = [F.col(f"`{c}`") for c in pieces.columns]
    salted = pieces.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(max(16, total // BUCKET_ROWS))).cast("int"))
    before = salted.groupBy("length", "__bucket").count()
    before = before.withColumn("__before", F.sum("count").over(Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("length", "__bucket", F.coalesce("__before", F.lit(0)).alias("__before"))
    ranked = salted.withColumn("__rank", F.row_number().over(Window.partitionBy("length", "__bucket").orderBy(*order)) - 1).join(before, ["length", "__bucket"])
    ranked = ranked.select(*order, (F.col("__rank") + F.col("__before")).alias("__rank"))
    names = pieces.columns
    kind = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seq, at = plan.value.place(b.column("length").to_numpy().astype(np.int64), b.column("__rank").to_numpy().astype(np.int64))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(seq), pa.array(at)], kind.names)

    return ranked.mapInArrow(run, kind)


def op2_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 ids."""
    return packed(table(spark, sf_dir, "documents"))


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of all pieces of docs, which needs doc_id and text.

    Null and empty texts are a piece of the end id alone. Other columns, whatever their names, aren't read; an empty
    table gives an empty table. Texts of any length are cut into pieces; a task holds one text's ids at a time.
    """
    pieces = tokenize_pieces(docs).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(materialize(pieces, "pieces"))

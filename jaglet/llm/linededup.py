"""Line deduplication over overlapping windows of three lines.

Lines are what "\\n" cuts; empty lines are kept but are no part of windows. A window is three consecutive
non-empty lines of one text, known by 128 bits of hash. The first occurrence of a window, by document id, then
place, stays; every later one, in the same document too, is removed. Where later windows of a document overlap,
the lines they cover are merged and removed once.

Windows alone are shuffled to find the first of each. Texts are joined with what goes only where a Bloom filter of the
documents with later windows lets them through; all others pass without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jaglet.llm import wordhash as wh
from jaglet.llm.common import bloom, by_place, in_bloom, materialize, over_batches, place, session_of, slices, table, text_view, without

WINDOW = 3
CHUNK = 1 << 20
LINES = wh.separators((0x0A, 0x0A))
RESULT = ("line_count", "removed_lines")


def windows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, row (hash of the text), pos (first line of the window, among non-empty lines), h1, h2."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(f"`{text_col}`").alias("row"), F.col(f"`{text_col}`").alias("text"))

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch:
        data, at = text_view(b.column(2))
        out: list[list[np.ndarray]] = [[], [], [], []]
        for i, j in slices(at, CHUNK):
            h, s, e, first = wh.words(data, at[i : j + 1], LINES)
            exact = wh.exact(data, s, e)
            counts = np.diff(first)
            text = np.repeat(np.arange(j - i), counts)
            pos = np.arange(len(h)) - first[:-1][text]
            some = np.flatnonzero(pos + WINDOW <= counts[text])
            for k, x in enumerate((i + text[some], pos[some], _rolled(h, some), _rolled(exact, some))):
                out[k].append(x)
        row, pos, h1, h2 = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)
        at_row = pa.array(row.astype(np.int64))
        return pa.RecordBatch.from_arrays([b.column(0).take(at_row), b.column(1).take(at_row), pa.array(pos.astype(np.int32)), pa.array(h1.astype(np.uint64).view(np.int64)), pa.array(h2.astype(np.uint64).view(np.int64))], ["doc_id", "row", "pos", "h1", "h2"])

    kind = rows.schema["doc_id"].dataType
    return over_batches(rows, kernel, T.StructType([T.StructField("doc_id", kind), T.StructField("row", T.LongType()), T.StructField("pos", T.IntegerType()), T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType())]))


def _rolled(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.zeros(len(at), np.uint64)
        for k in range(WINDOW):
            out = wh.mix(out + wh.U64(0x9E3779B97F4A7C15)) + h[at + k]
    return wh.mix(out)


def repeated_windows(found: DataFrame) -> DataFrame:
    """doc_id, row, pos of every later occurrence of a window; found is materialized."""
    place = F.struct("doc_id", "row", "pos")
    first = found.groupBy("h1", "h2").agg(F.min(place).alias("lead"), F.max(place).alias("tail")).where("lead <> tail")
    first = materialize(first.select("h1", "h2", F.col("lead.doc_id").alias("d"), F.col("lead.row").alias("r"), F.col("lead.pos").alias("p")), "first")
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row") == F.col("r")) & (F.col("pos") == F.col("p"))
    return found.join(first, ["h1", "h2"]).where(~same).select("doc_id", "row", "pos")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with repeated lines taken out of text_col, and line_count and removed_lines (from 0, over all lines).

    A text of fewer than three non-empty lines has no window and stays as it is, null and empty texts too (they
    have one empty line, line_count 1; null stays null). Every document stays, if only as an empty text. Rows
    that repeat both id and text are one occurrence and fare alike; a null id sorts first. Columns of docs
    that bear a result's name are replaced. An empty table gives an empty table. Texts may be
    of any length: lines are hashed in blocks, and a text is cut up in its own row only.
    """
    session_of(docs)
    docs = without(docs, *RESULT)
    names, own = docs.columns, place(docs, text_col)
    found = materialize(windows(docs, id_col, text_col), "windows")
    gone = repeated_windows(found).groupBy("doc_id", "row").agg(F.collect_set("pos").alias("gone"))
    gone = materialize(gone.select(F.col("doc_id").alias("id"), "row", "gone"), "gone")
    session_of(docs)
    hits = docs.sparkSession.sparkContext.broadcast(bloom(gone.select(F.xxhash64("id", "row"))))
    id_, text = F.col(f"c{place(docs, id_col)}"), F.col(f"c{own}")
    held = by_place(docs).withColumn("hash", F.xxhash64(text)).withColumn("key", F.xxhash64(id_, "hash"))
    plain = T.StructType([f for f in held.schema.fields if f.name != "key"])
    out = T.StructType([*plain.fields[:-1], T.StructField("line_count", T.LongType()), T.StructField("removed_lines", T.ArrayType(T.LongType()))])

    def some(b: pa.RecordBatch) -> pa.RecordBatch:
        return b.filter(pa.array(in_bloom(hits.value, b.column(len(names) + 1).to_numpy()))).select(plain.names)

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch:
        texts, removed = b.column(own), [[] for _ in range(b.num_rows)]
        counts = np.ones(b.num_rows, np.int64)
        data, at = text_view(texts)
        ends = np.concatenate(([0], np.cumsum(data[at[0] : at[-1]] == 0x0A)))
        counts += ends[at[1:] - at[0]] - ends[at[:-1] - at[0]]
        changed = {}
        for i in np.flatnonzero(np.asarray(b.column("gone").is_valid())).tolist():
            covered = {p + k for p in b.column("gone")[i].as_py() for k in range(WINDOW)}
            kept, full = [], 0
            for n, line in enumerate(texts[i].as_py().split("\n")):
                if line and full in covered:
                    removed[i].append(n)
                else:
                    kept.append(line)
                full += bool(line)
            changed[i] = "\n".join(kept)
        if changed:
            values = texts.to_pylist()
            for i, t in changed.items():
                values[i] = t
            texts = pa.array(values, texts.type)
        return pa.RecordBatch.from_arrays([*[texts if k == own else b.column(k) for k in range(len(names))], pa.array(counts), pa.array(removed, pa.list_(pa.int64()))], names=out.names)

    def others(b: pa.RecordBatch) -> pa.RecordBatch:
        rest = b.filter(pa.array(~in_bloom(hits.value, b.column(len(names) + 1).to_numpy())))
        return kernel(rest.select(names_by_place).append_column("gone", pa.nulls(rest.num_rows, pa.list_(pa.int32()))))

    names_by_place = plain.names[:-1]
    met = over_batches(held, some, plain)
    same = id_.eqNullSafe(F.col("id")) & (F.col("hash") == F.col("row"))
    joined = met.join(gone, same, "left").select(*names_by_place, "gone")
    return over_batches(joined, kernel, out).unionByName(over_batches(held, others, out)).toDF(*names, *RESULT)


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Lines of every document that repeat an earlier three-line window, and what is left."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("line_count").alias("n_lines"), F.size("removed_lines").cast("long").alias("n_removed"), F.array_join(F.col("removed_lines").cast("array<string>"), ",").alias("removed_lines"), F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n_chars"), F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


OP1_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS n FROM documents),
f AS (SELECT doc_id, n, line, row_number() OVER w - 1 AS pos, line || chr(10) || lead(line, 1) OVER w || chr(10) || lead(line, 2) OVER w AS win FROM l WHERE line <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
r AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS k FROM f WHERE win IS NOT NULL) WHERE k > 1),
c AS (SELECT DISTINCT doc_id, pos + k AS pos FROM r, range(3) t(k)),
g AS (SELECT f.doc_id, f.n FROM f JOIN c USING (doc_id, pos)),
s AS (SELECT l.doc_id, count(*) AS n_lines, count(g.n) AS n_removed, coalesce(string_agg(CAST(g.n AS VARCHAR), ',' ORDER BY g.n), '') AS removed_lines, coalesce(string_agg(CASE WHEN g.n IS NULL THEN l.line END, chr(10) ORDER BY l.n), '') AS kept
  FROM l LEFT JOIN g ON g.doc_id = l.doc_id AND g.n = l.n GROUP BY 1)
SELECT doc_id, n_lines, n_removed, removed_lines, length(kept) AS n_chars, md5(kept) AS text_md5 FROM s
"""

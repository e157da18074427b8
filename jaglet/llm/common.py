"""What the corpus operators share: a shared workspace, Arrow text access, learn/held-out splits."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jaglet.llm.wordhash import mix
from jaglet.session import shared_dir

#: Rows and bytes of one Arrow batch sent to a Python worker. Texts may be long, so batches are kept small.
BATCH_ROWS, BATCH_BYTES = "1000", "8388608"


def session_of(df: DataFrame) -> SparkSession:
    """The session, with Arrow batches small enough for long texts: settings that stay, since plans read them when they run."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_view(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying its text; offsets index bytes, nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not wide and not (pa.types.is_string(column.type) or pa.types.is_binary(column.type)):
        column, wide = column.cast(pa.large_string()), True
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    if column.null_count:
        # a null slot may span bytes in a foreign buffer; only the lengths that count are kept
        valid = np.asarray(column.is_valid())
        if (np.diff(at)[~valid] != 0).any():
            return text_view(column.fill_null(""))
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def slices(offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Runs of rows (first, last+1) with about `size` bytes of text each, at least one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def over_batches(df: DataFrame, kernel: Callable[[pa.RecordBatch], pa.RecordBatch], schema) -> DataFrame:
    """df through kernel, Arrow batch by Arrow batch; schema is what kernel returns."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield kernel(b)

    return df.mapInArrow(run, schema)


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the decimal doc_id, modulo n; null ids give null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def crc_mod_value(doc_id: int, n: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % n


def place(df: DataFrame, name: str) -> int:
    """Where the column of that name stands: the one spelt alike, else the first that is but for case."""
    for names, wanted in ((df.columns, name), ([c.lower() for c in df.columns], name.lower())):
        if wanted in names:
            return names.index(wanted)
    raise KeyError(f"no column {name!r}")


def by_place(df: DataFrame) -> DataFrame:
    """df with its columns named c0, c1, … by their places: names may hold dots, or be those that an operator uses."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns that a result is going to name (compared as Spark does, without case)."""
    taken = {n.lower() for n in names}
    held = [i for i, c in enumerate(df.columns) if c.lower() not in taken]
    return by_place(df).select(*[f"c{i}" for i in held]).toDF(*[df.columns[i] for i in held])


def extended(df: DataFrame, kernel: Callable[[pa.RecordBatch], Iterator[tuple[int, int, list[pa.Array]]]], added: list[T.StructField], inputs: list[Column], keep: Iterable[str] | None = None) -> DataFrame:
    """df (or its columns `keep`) with the columns `added`, which replace others of their names; no shuffle.

    kernel gets Arrow batches of the inputs, columns of by_place(df) in their order, and gives for each run of rows
    (first, last + 1) the arrays of the added columns.
    """
    taken = {f.name.lower() for f in added}
    held = [i for i, c in enumerate(df.columns) if c.lower() not in taken] if keep is None else [place(df, c) for c in keep if c.lower() not in taken]
    n = len(held)
    rows = by_place(df).select(*[F.col(f"c{i}").alias(f"k{j}") for j, i in enumerate(held)], *[c.alias(f"i{j}") for j, c in enumerate(inputs)])
    out = T.StructType([*[T.StructField(f"k{j}", df.schema.fields[i].dataType) for j, i in enumerate(held)], *[T.StructField(f"a{j}", f.dataType) for j, f in enumerate(added)]])
    names = out.names

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                for i, j, arrays in kernel(pa.RecordBatch.from_arrays(b.columns[n:], names=[f"i{k}" for k in range(b.num_columns - n)])):
                    yield pa.RecordBatch.from_arrays([*[b.column(k).slice(i, j - i) for k in range(n)], *arrays], names=names)

    return rows.mapInArrow(run, out).toDF(*[df.columns[i] for i in held], *[f.name for f in added])


#: A Bloom filter has 16 bits an id, and 2**27 (16 MB) at most; beyond that it lets more through.
LEAST_BITS, MOST_BITS = 16, 27


def bloom(ids: DataFrame) -> np.ndarray:
    """A Bloom filter, as bytes, of the ids (one long column, no nulls); sized by their number, put together in Spark."""
    spread = min(MOST_BITS, max(LEAST_BITS, int(16 * max(1, ids.count())).bit_length()))

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch:
        h = np.unique(_bits_of(b.column(0).to_numpy(), spread).ravel())
        at, where = np.unique(h >> 5, return_inverse=True)
        held = np.zeros(len(at), np.int64)
        np.bitwise_or.at(held, where, np.int64(1) << (h & 31))
        return pa.RecordBatch.from_arrays([pa.array(at), pa.array(held)], ["word", "bits"])

    rows = over_batches(ids, kernel, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (spread - 5), "<u4")
    out[rows.column(0).to_numpy()] = rows.column(1).to_numpy().astype(np.uint32)
    return out.view(np.uint8)


def in_bloom(held: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether each id may be among those that the filter was made of; never false for one that is."""
    h = _bits_of(ids, (len(held) * 8).bit_length() - 1)
    return ((held[h >> 3] >> (h & 7).astype(np.uint8)) & 1).astype(bool).all(0)


def _bits_of(ids: np.ndarray, spread: int) -> np.ndarray:
    """Three bit positions (rows) of each id."""
    h = mix(ids.astype(np.int64).view(np.uint64))
    return np.stack([((h >> np.uint64(s)) & np.uint64((1 << spread) - 1)).astype(np.int64) for s in (0, 18, 37)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

"""Bounded chunks of a chain in event order, and folds over them.

Chunks are planned on the driver from the record table (a row per record), which is small beside the events. They
follow files and records: a chunk never spans files, a record is never split, and a chunk stays within its budget
unless one record alone is over it.
"""

from __future__ import annotations

import functools
import re
import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_UNITS = {"b": 1, "kb": 10**3, "mb": 10**6, "gb": 10**9, "tb": 10**12, "kib": 1 << 10, "mib": 1 << 20, "gib": 1 << 30, "tib": 1 << 40}
_SIZE = re.compile(r"\s*([0-9]+(?:\.[0-9]+)?)\s*([a-zA-Z]+)\s*")


def step_size(step: int | str) -> tuple[int | None, int | None]:
    """(events, bytes) of a step: a count, or a size like "200 MB" or "1 GiB"."""
    if isinstance(step, bool):
        raise TypeError("a step is a number of events or a size")
    if isinstance(step, int):
        if step <= 0:
            raise ValueError("a step is positive")
        return step, None
    m = _SIZE.fullmatch(step)
    if not m or m[2].lower() not in _UNITS:
        raise ValueError(f"not a size: {step!r}")
    size = int(float(m[1]) * _UNITS[m[2].lower()])
    if size <= 0:
        raise ValueError("a step is positive")
    return None, size


@dataclass(frozen=True)
class RecordRow:
    """A record in the table that chunks are planned from: its file, first event, number of events and bytes."""

    file_index: int
    file_path: str
    first: int
    events: int
    bytes: int = 0


@dataclass(frozen=True)
class Chunk:
    """Events [start, stop) of one file."""

    number: int
    start: int
    stop: int
    file_path: str


def plan(records: list[RecordRow], step: int | str, start: int | None = None, stop: int | None = None) -> list[Chunk]:
    """The chunks of the events in [start, stop); the first and last are cut to the range, none is empty."""
    most_events, most_bytes = step_size(step)
    low = max(0, start or 0)
    high = max((r.first + r.events for r in records), default=0) if stop is None else stop
    out: list[Chunk] = []
    held: list[RecordRow] = []

    def close():
        if held:
            a, b = max(low, held[0].first), min(high, held[-1].first + held[-1].events)
            if a < b:
                out.append(Chunk(len(out), a, b, held[0].file_path))
        held.clear()

    for r in sorted(records, key=lambda r: r.first):
        if r.first + r.events <= low or r.first >= high or not r.events:
            continue
        size = sum(h.events if most_events else h.bytes for h in held) + (r.events if most_events else r.bytes)
        if held and (held[-1].file_index != r.file_index or size > (most_events or most_bytes)):
            close()
        held.append(r)
    close()
    return out


def chunked(df: DataFrame, chunks: list[Chunk]) -> DataFrame:
    """df with chunk, the number of the chunk that its event is in; other events are left out.

    Chunks are dealt to stretches of ids as long as a chunk is on average, so that events meet them by an equi-join
    on the stretch and are compared with the chunks of their own stretch only. The table has two rows a chunk at
    most on average; Spark broadcasts it while it is within its own threshold.
    """
    width = max(1, sum(c.stop - c.start for c in chunks) // max(1, len(chunks)))
    starts, stops = (np.array([getattr(c, k) for c in chunks], np.int64) for k in ("start", "stop"))
    first = starts // width
    times = (stops - 1) // width - first + 1
    row = np.repeat(np.arange(len(chunks)), times)
    stretch = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
    numbers = np.array([c.number for c in chunks], np.int64)
    held = pa.table({"chunk": numbers[row], "c_start": starts[row], "c_stop": stops[row], "c_stretch": stretch})
    table = df.sparkSession.createDataFrame(held, "chunk long, c_start long, c_stop long, c_stretch long")
    own = (F.floor(F.col("event_id") / F.lit(width)) == F.col("c_stretch")) & (F.col("event_id") >= F.col("c_start")) & (F.col("event_id") < F.col("c_stop"))
    return df.join(table, own).drop("c_start", "c_stop", "c_stretch")


def iterate(read: Callable[[Chunk], DataFrame], chunks: list[Chunk], ahead: int = 0) -> Iterator[tuple[pa.Table, Chunk]]:
    """Each chunk's events in order, and what it covers; read(chunk) is the frame of its events alone.

    With `ahead`, the jobs of so many further chunks run meanwhile; the order stays. The driver holds these chunks.
    """
    get = lambda c: read(c).orderBy("event_id").toArrow()
    if ahead < 0:
        raise ValueError("ahead isn't negative")
    if not ahead:
        for c in chunks:
            yield get(c), c
        return
    with ThreadPoolExecutor(ahead + 1) as pool:
        flying: deque = deque()
        try:
            for c in chunks:
                flying.append((pool.submit(get, c), c))
                if len(flying) > ahead:
                    job, done = flying.popleft()
                    yield job.result(), done
            while flying:
                job, done = flying.popleft()
                yield job.result(), done
        finally:
            for job, _ in flying:
                job.cancel()


def map_chunks(df: DataFrame, chunks: list[Chunk], fn: Callable[[pa.Table], Any]) -> DataFrame:
    """chunk and the pickled result of fn on each chunk that has events; fn gets the events in order, on an executor."""
    payload = cloudpickle.dumps(fn)

    def run(table):
        indices = pc.sort_indices(table.column("event_id").combine_chunks())
        result = cloudpickle.loads(payload)(table.take(indices).drop_columns(["chunk"]))
        return pa.table({"chunk": table.column("chunk").slice(0, 1), "result": pa.array([cloudpickle.dumps(result)], pa.binary())})

    return chunked(df, chunks).groupBy("chunk").applyInArrow(run, "chunk long, result binary")


_MISSING = object()


def map_reduce(df: DataFrame, chunks: list[Chunk], fn: Callable[[pa.Table], Any], reduce: Callable[[Any, Any], Any], initial: Any = _MISSING) -> Any:
    """fn on each chunk, and the results folded in event order on the driver, which gets one result a chunk."""
    rows = sorted(map_chunks(df, chunks, fn).collect(), key=lambda r: r["chunk"])
    results = [cloudpickle.loads(bytes(r["result"])) for r in rows]
    if initial is _MISSING:
        if not results:
            raise ValueError("no events to reduce and no initial value")
        return functools.reduce(reduce, results)
    return functools.reduce(reduce, results, initial)


def par_fold(df: DataFrame, zero: Callable[[], Any], fold: Callable[[Any, dict], Any], merge: Callable[[Any, Any], Any]) -> Any:
    """A fold per partition and a tree of merges; merge is associative, its order open, zero may be called often."""

    def partial(batches):
        acc = zero()
        for b in batches:
            for row in b.to_pylist():
                acc = fold(acc, row)
        yield pa.RecordBatch.from_arrays([pa.array([cloudpickle.dumps(acc)], pa.binary())], ["acc"])

    parts = df.mapInArrow(partial, "acc binary").rdd.map(lambda r: cloudpickle.loads(bytes(r[0])))
    return zero() if parts.isEmpty() else parts.treeReduce(merge)


def fold(df: DataFrame, acc: Any, step: Callable[[Any, dict], Any]) -> Any:
    """A fold over all events in order on the driver, which holds a partition at a time."""
    for row in df.orderBy("event_id").toLocalIterator(prefetchPartitions=True):
        acc = step(acc, row.asDict(recursive=True))
    return acc


def for_each(df: DataFrame, fn: Callable[[dict], None]) -> dict[str, float]:
    """fn on every event, on executors, for what it does; how many events and partitions it saw, and the seconds."""
    started = time.perf_counter()
    sc = df.sparkSession.sparkContext
    events, parts = sc.accumulator(0), sc.accumulator(0)

    def run(it):
        n = 0
        for row in it:
            fn(row.asDict(recursive=True))
            n += 1
        events.add(n)
        parts.add(1)

    df.foreachPartition(run)
    return {"events": events.value, "partitions": parts.value, "elapsed": time.perf_counter() - started}

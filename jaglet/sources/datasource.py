"""Event-record containers as a Spark data source: format "eventrec", for reading and for writing.

A partition is a run of records of one file of about `partition_bytes`. Which banks and columns are decoded is an
option, since Python data sources aren't told the projection. So are ranges and tags: records that no event of is
wanted are left out when partitions are planned, and events are dropped before their banks are decoded. (Spark keeps
filters that it pushed into a Python source for later queries of the same DataFrame, so none are taken that way.)
event_id is the global index before any filter.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from jaglet.schema import Bank, Dictionary
from jaglet.sources import container as C
from jaglet.sources.paths import SUFFIX, resolve, store_of
from jaglet.tags import TagRegistry

FORMAT = "eventrec"
FIXED_FIELDS = [T.StructField("event_id", T.LongType()), T.StructField("file_index", T.IntegerType()), T.StructField("file_path", T.StringType()), T.StructField("record_index", T.IntegerType()), T.StructField("record_tag", T.LongType()), T.StructField("event_tag", T.LongType())]
FIXED = [f.name for f in FIXED_FIELDS]
_FORMS = {letter: sign for sign, letter in C.COMPOSITE.items()}
PARTITION_BYTES, FILE_BYTES = 64 << 20, 128 << 20


def frame_schema(banks: list[Bank]) -> T.StructType:
    return T.StructType([*FIXED_FIELDS, *[b.field() for b in banks]])


def open_files(paths: list[str], salvage: bool = False) -> list[C.FileInfo]:
    """Headers, dictionaries and record maps, read side by side in order."""
    from concurrent.futures import ThreadPoolExecutor

    def one(path: str) -> C.FileInfo:
        source = C.FileBytes(path)
        try:
            return C.open_file(source, salvage)
        finally:
            source.close()

    with ThreadPoolExecutor(16) as pool:
        return list(pool.map(one, paths))


def inflated_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file_index, record_index, bytes) of rows (file_index, record_index, path, position), from the records' headers."""
    source = None
    try:
        for b in batches:
            sizes = []
            for path, at in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if source is None or source.path != path:
                    if source is not None:
                        source.close()
                    source = C.FileBytes(path)
                sizes.append(C.RecordHeader.parse(source.read(at, C.HEADER), path, at).inflated)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64())], ["file_index", "record_index", "bytes"])
    finally:
        if source is not None:
            source.close()


def selected(dictionary: Dictionary, options: dict[str, str]) -> list[Bank]:
    """The banks and columns that options ask for: banks is a JSON map of names to column lists (null: all)."""
    wanted = json.loads(options["banks"]) if options.get("banks") else {n: None for n in dictionary.names()}
    return [dictionary[n] if cols is None else dictionary[n].select(cols) for n, cols in wanted.items()]


def composite_bank(options: dict[str, str], infos: list[C.FileInfo]) -> Bank | None:
    """The schema of the composite bank that options name, from the first event that has it."""
    name = options.get("composite")
    if not name:
        return None
    ids = None
    for info in infos:
        if name in info.dictionary:
            ids = info.dictionary[name].group, info.dictionary[name].item
    if ids is None and name.count("/") == 1:
        ids = tuple(int(x) for x in name.split("/"))
    if ids is None:
        raise KeyError(f"no bank {name!r}")
    seen = False
    for info in infos:
        source = C.FileBytes(info.path)
        try:
            for _, _, record in C.records(source, info):
                for form in record.composites(*ids):
                    if form:
                        return Bank(name, *ids, tuple(C.composite_columns(form[0])))
                seen |= bool(record.present(Bank(name, *ids, ())).any())
        finally:
            source.close()
    raise KeyError(f"bank {name!r} is " + ("no composite bank" if seen else "in no event"))


@dataclass
class Records(InputPartition):
    """A run of records of a file."""

    path: str
    file_index: int
    first_event: int
    first_record: int
    spans: list[C.RecordSpan]
    dictionary: str


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], infos: list[C.FileInfo], banks: list[Bank], composite: Bank | None):
        self.banks, self.composite = banks, composite
        self.size = int(options.get("partition_bytes", PARTITION_BYTES))
        self.infos = infos
        some = lambda name: {int(x) for x in json.loads(options[name])} if options.get(name) else None
        self.tags, self.exact = some("record_tags"), some("event_tags")
        self.low, self.high = int(options.get("start", 0)), int(options["stop"]) if options.get("stop") else None
        self.require = json.loads(options.get("require", "[]"))
        self.mask = int(options.get("event_tag_any", 0))

    def partitions(self) -> list[Records]:
        out, event = [], 0
        for index, info in enumerate(self.infos):
            text, run, held, first, start = info.dictionary.to_text(), [], 0, 0, event
            for k, span in enumerate(info.spans):
                stop = event + span.events
                skip = (self.tags is not None and _signed(span.user_word_1) not in self.tags) or stop <= self.low or (self.high is not None and event >= self.high)
                if run and (skip or held + span.length > self.size):
                    out.append(Records(info.path, index, start, first, run, text))
                    run, held = [], 0
                if not skip:
                    if not run:
                        first, start = k, event
                    run.append(span)
                    held += span.length
                event = stop
            if run:
                out.append(Records(info.path, index, start, first, run, text))
        return out or [Records("", 0, 0, 0, [], "")]

    def read(self, partition: Records) -> Iterator[pa.RecordBatch]:
        if not partition.spans:
            return
        source, dictionary = C.FileBytes(partition.path), Dictionary.parse(partition.dictionary)
        try:
            event = partition.first_event
            for k, span in enumerate(partition.spans):
                record = C.read_record(source, span, dictionary)
                yield from self._batches(partition, partition.first_record + k, event, span, record, dictionary)
                event += span.events
        finally:
            source.close()

    def _batches(self, p: Records, index: int, event: int, span: C.RecordSpan, record: C.Record, dictionary: Dictionary):
        n = span.events
        keep = np.ones(n, bool)
        if self.mask:
            keep &= (record.tags & self.mask) != 0
        if self.exact is not None:
            keep &= np.isin(record.tags, list(self.exact))
        for name in self.require:
            keep &= record.present(dictionary[name]) if name in dictionary else False
        if not keep.any():
            return
        cols = [pa.array(event + np.arange(n)), pa.array(np.full(n, p.file_index, np.int32)), pa.array([p.path] * n, pa.string()), pa.array(np.full(n, index, np.int32)), pa.array(np.full(n, _signed(span.user_word_1))), pa.array(record.tags)]
        for bank in self.banks:
            cols.append(_bank_array(record, bank, dictionary, n))
        if self.composite:
            cols.append(_composite_array(record, self.composite, n))
        names = [*FIXED, *[b.name for b in self.banks], *([self.composite.name] if self.composite else [])]
        batch = pa.RecordBatch.from_arrays(cols, names)
        yield batch if keep.all() else batch.filter(pa.array(keep))


def _signed(word: int) -> int:
    return word - (1 << 64) if word >> 63 else word


def _offsets(rows: np.ndarray) -> tuple[pa.Array, pa.Array]:
    at = np.concatenate(([0], np.cumsum(np.maximum(rows, 0)))).astype(np.int32)
    return pa.array(at), pa.array(rows < 0)


def _bank_array(record: C.Record, bank: Bank, dictionary: Dictionary, n: int) -> pa.Array:
    kinds = [pa.from_numpy_dtype(np.dtype(C.LETTERS[c.letter][2])) for c in bank.columns]
    fields = [pa.field(c.name, k if c.length == 1 else pa.list_(pa.field("element", k, False))) for c, k in zip(bank.columns, kinds, strict=True)]
    if bank.name not in dictionary:
        return pa.nulls(n, pa.list_(pa.struct(fields)))
    rows, cols = record.read(dictionary[bank.name], [c.name for c in bank.columns])
    parts = []
    for c, f in zip(bank.columns, fields, strict=True):
        a = cols[c.name]
        if c.length > 1:
            parts.append(pa.ListArray.from_arrays(pa.array(np.arange(0, a.size + 1, c.length, dtype=np.int32)), pa.array(a.ravel()), type=f.type))
        else:
            parts.append(pa.array(a))
    offsets, absent = _offsets(rows)
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(parts, fields=fields), mask=absent)


def _composite_array(record: C.Record, bank: Bank, n: int) -> pa.Array:
    found = record.composites(bank.group, bank.item)
    tables = [C.composite_rows(*x) if x else None for x in found]
    rows = np.array([-1 if t is None else len(t) for t in tables], np.int64)
    kinds = [pa.from_numpy_dtype(np.dtype(C.LETTERS[c.letter][2])) for c in bank.columns]
    parts = []
    for c, k in zip(bank.columns, kinds, strict=True):
        values = [t[c.name] for t in tables if t is not None and c.name in (t.dtype.names or ())]
        parts.append(pa.array(np.concatenate(values) if values else np.zeros(0, C.LETTERS[c.letter][2]), k))
    offsets, absent = _offsets(rows)
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(parts, names=[c.name for c in bank.columns]), mask=absent)


@dataclass
class Written(WriterCommitMessage):
    """The files of a task, in event order."""

    paths: list[str]
    events: int


class ArrowWriter(DataSourceArrowWriter):
    """Containers of each partition, of about file_bytes, which bounds what a task holds. Names are final only after all
    parts are written; an abort removes them."""

    def __init__(self, options: dict[str, str], schema: T.StructType, overwrite: bool):
        self.folder, self.overwrite = options["path"].rstrip("/"), overwrite
        #: column name -> [group, item] of banks that are written as composite ones
        self.composites = json.loads(options.get("composites", "{}"))
        places = {f.name: k for k, f in enumerate(schema.fields)}
        self.forms = {n: "".join(_FORMS[Bank.from_spark(schema.fields[places[n]], *ids).columns[k].letter] for k in range(len(schema.fields[places[n]].dataType.elementType.fields))) for n, ids in self.composites.items()}
        fields = [f for f in schema.fields if f.name not in FIXED and f.name not in self.composites]
        given = Dictionary.parse(options["dictionary"]) if options.get("dictionary") else None
        self.banks = [given[f.name] if given and f.name in given else Bank.from_spark(f, 20_000 + k // 200, k % 200 + 1) for k, f in enumerate(fields)]
        self.all = given.to_text() if given else Dictionary(self.banks).to_text()
        self.registry, self.config = options.get("tag_registry", ""), options.get("config", "{}")
        self.compression = options.get("compression", "lz4")
        self.most = int(options.get("record_events", 100_000)), int(options["record_bytes"]) if options.get("record_bytes") else None
        self.level = int(options["zstd_level"]) if options.get("zstd_level") else None
        self.split = options.get("byte_split", "false") == "true"
        self.file_bytes = int(options.get("file_bytes", FILE_BYTES))
        self.job = uuid.uuid4().hex
        if not overwrite and self._there():
            raise FileExistsError(self.folder)

    def _there(self) -> list[str]:
        try:
            return resolve(self.folder)
        except FileNotFoundError:
            return []

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        store, folder = store_of(self.folder)
        store.create_dir(folder, recursive=True)
        done, events, w = [], 0, None
        for batch in iterator:
            for at in range(0, batch.num_rows, 1000):
                w = w or self._open()
                self._add(w, batch.slice(at, 1000))
                if w.size >= self.file_bytes:
                    events += self._close(w, store, f"{folder}/.{self.job}-{task:05d}-{uuid.uuid4().hex}", done)
                    w = None
        if w or not (done or task):  # a table without events still is a file
            events += self._close(w or self._open(), store, f"{folder}/.{self.job}-{task:05d}-{uuid.uuid4().hex}", done)
        return Written(done, events)

    def _open(self) -> C.Writer:
        return C.Writer(io.BytesIO(), Dictionary.parse(self.all), TagRegistry.parse(self.registry), json.loads(self.config), self.compression, *self.most, self.level, self.split)

    @staticmethod
    def _close(w: C.Writer, store, path: str, done: list[str]) -> int:
        w.finish()
        with store.open_output_stream(path) as f:
            f.write(w.out.getbuffer())
        done.append(path)
        return w.events

    def _add(self, w: C.Writer, batch: pa.RecordBatch) -> None:
        names = batch.schema.names
        tags = batch.column("event_tag").to_pylist() if "event_tag" in names else [0] * batch.num_rows
        words = batch.column("record_tag").to_pylist() if "record_tag" in names else [0] * batch.num_rows
        cols = []
        for b in self.banks:
            a = batch.column(b.name)
            at = a.offsets.to_numpy()
            flat = a.values
            values = {}
            for k, c in enumerate(b.columns):
                x = flat.field(k)
                if c.length > 1:
                    if len(x) and set(np.diff(x.offsets.to_numpy())) - {c.length}:
                        raise ValueError(f"{b.name}/{c.name} needs arrays of {c.length}")
                    x = x.values
                if x.null_count:
                    raise ValueError(f"{b.name}/{c.name} holds nulls; a bank can't")
                values[c.name] = x.to_numpy(zero_copy_only=False).reshape((-1, c.length) if c.length > 1 else -1)
            cols.append((b, at, np.asarray(a.is_valid()), values))
        for e in range(batch.num_rows):
            if words[e] is not None:
                w.set_record_tag(int(words[e]) & 0xFFFFFFFFFFFFFFFF)
            event = C.Event(int(tags[e] or 0))
            for b, at, valid, values in cols:
                if valid[e]:
                    s, t = int(at[e]), int(at[e + 1])
                    event.bank(b, {k: v[s:t] for k, v in values.items()}, t - s)
            for name, ids in self.composites.items():
                held = batch.column(name)[e]
                if held.is_valid:
                    event.composite(*ids, self.forms[name], [tuple(r.values()) for r in held.as_py()])
            w.add(event)

    def commit(self, messages: list[Written | None]) -> None:
        """New files get their names, which no old file has, before old ones go: a crash in between loses nothing."""
        parts = [p for m in messages if m for p in m.paths]
        store, folder = store_of(self.folder)
        old = self._there() if self.overwrite else []
        for k, path in enumerate(parts):
            store.move(path, f"{folder}/part-{k:06d}-{self.job}{SUFFIX}")
        for path in old:
            store.delete_file(store_of(path)[1])

    def abort(self, messages: list[Written | None]) -> None:
        store, _ = store_of(self.folder)
        for path in (p for m in messages if m for p in m.paths):
            if store.get_file_info(path).is_file:
                store.delete_file(path)


class EventRecords(DataSource):
    """Options: path (or paths, a JSON list), banks, composite, salvage, partition_bytes; to select events start, stop,
    event_tag_any, and JSON lists of require, record_tags and event_tags; to write, composites, a JSON map of columns to
    [group, item], which are written as composite banks and stay out of the dictionary."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _infos(self) -> list[C.FileInfo]:
        paths = json.loads(self.options["paths"]) if self.options.get("paths") else resolve(self.options["path"])
        return open_files(paths, self.options.get("salvage", "false") == "true")

    def _plan(self):
        infos = self._infos()
        banks = selected(Dictionary.union((i.path, i.dictionary) for i in infos), self.options)
        composite = composite_bank(self.options, infos)
        return infos, [b for b in banks if not composite or b.name != composite.name], composite

    def schema(self) -> T.StructType:
        _, banks, composite = self._plan()
        return frame_schema([*banks, *([composite] if composite else [])])

    def reader(self, schema: T.StructType) -> Reader:
        return Reader(self.options, *self._plan())

    def writer(self, schema: T.StructType, overwrite: bool) -> ArrowWriter:
        return ArrowWriter(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(EventRecords)

"""Chains: an ordered list of event files, or an event frame, as one immutable query object over a DataFrame.

An event frame has event_id (the global index before any filter), file_index, file_path, record_index, record_tag,
event_tag, and a nullable array of structs for each bank. Every method that narrows returns a new chain; every
method that reads returns a lazy DataFrame.
"""

from __future__ import annotations

import copy
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jaglet.operators import batches, jagged, link, occupancy, sinks
from jaglet.operators.filters import FilterSpec, in_ranges, merge_ranges
from jaglet.schema import Bank, Dictionary, is_glob, match_names
from jaglet.sources import datasource
from jaglet.sources.paths import resolve
from jaglet.tags import TagRegistry


@dataclass(frozen=True)
class Selection:
    """Banks with their columns, and whether one bank was asked for by its bare name (then columns keep bare names)."""

    banks: dict[str, list[str]]
    single: bool


class EventView(dict):
    """An event as a dict of its columns; banks that it lacks are None."""

    @property
    def tag(self) -> int:
        return self["event_tag"]

    def has(self, bank: str) -> bool:
        return self.get(bank) is not None

    def structures(self) -> list[str]:
        """The banks that are there, with rows or without."""
        return [n for n, v in self.items() if n not in datasource.FIXED and v is not None]

    def bank(self, name: str) -> list[dict]:
        """The bank's rows; a KeyError if the chain has no such bank, a LookupError if the event lacks it."""
        rows = self[name]
        if rows is None:
            raise LookupError(f"event {self['event_id']} has no {name!r}")
        return rows

    def size(self, bank: str) -> int:
        """The bank's rows in number, 0 if the event lacks it."""
        return len(self[bank] or ())

    def column(self, bank: str, name: str) -> list:
        return [r[name] for r in self.bank(bank)]


class EventChain:
    """One stream of events; open() reads containers, from_frame() takes any event frame."""

    def __init__(self, df: DataFrame, dictionary: Dictionary, registry: TagRegistry | None = None, config: dict[str, str] | None = None, spec: FilterSpec | None = None, infos: list | None = None, options: dict[str, str] | None = None):
        self._df, self.dictionary = df, dictionary
        self.registry, self.config, self.spec = registry or TagRegistry(), dict(config or {}), spec or FilterSpec()
        self.infos, self._options = infos, options

    # ---- opening

    @classmethod
    def open(cls, spark: SparkSession, source, salvage: bool = False) -> EventChain:
        """Containers as a chain: a file, a folder, a glob or a list. Dictionaries are united, layouts have to agree."""
        datasource.register(spark)
        paths = resolve(source)
        infos = datasource.open_files(paths, salvage)
        dictionary = Dictionary.union((i.path, i.dictionary) for i in infos)
        registry = next((i.registry for i in infos if len(i.registry)), TagRegistry())
        config = next((i.config for i in infos if i.config), {})
        options = {"paths": json.dumps(paths), "salvage": str(salvage).lower()}
        df = spark.createDataFrame([], datasource.frame_schema(list(dictionary))) if not paths else spark.read.format(datasource.FORMAT).options(**options).load()
        return cls(df, dictionary, registry, config, None, infos, options if paths else None)

    @classmethod
    def from_frame(cls, df: DataFrame, registry: TagRegistry | dict[str, int] | None = None, config: dict[str, str] | None = None) -> EventChain:
        """An event frame as a chain; its array-of-struct columns are the banks."""
        banks = [f for f in df.schema.fields if f.name not in datasource.FIXED and isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)]
        dictionary = Dictionary(Bank.from_spark(f, 20_000 + k // 200, k % 200 + 1) for k, f in enumerate(banks))
        return cls(df, dictionary, TagRegistry(registry) if isinstance(registry, dict) else registry, config)

    @classmethod
    def concat(cls, chains: Iterable[EventChain]) -> EventChain:
        """Chains one after the other: banks united, event ids and file indices carried on."""
        parts = list(chains)
        dictionary = Dictionary.union((f"chain {k}", c.dictionary) for k, c in enumerate(parts))
        out, events, files = None, 0, 0
        for c in parts:
            last, top = c._df.agg(F.max("event_id"), F.max("file_index")).first()
            df = c._df.withColumns({"event_id": F.col("event_id") + events, "file_index": F.col("file_index") + files})
            for b in dictionary:
                if b.name not in c.dictionary:
                    df = df.withColumn(b.name, F.lit(None).cast(b.field().dataType))
            out = df if out is None else out.unionByName(df)
            events, files = events + (-1 if last is None else last) + 1, files + (-1 if top is None else top) + 1
        if out is None:
            raise ValueError("no chains")
        registry = next((c.registry for c in parts if len(c.registry)), TagRegistry())
        return cls(out, dictionary, registry, next((c.config for c in parts if c.config), {}))

    def _with(self, **changes: Any) -> EventChain:
        out = copy.copy(self)
        for k, v in changes.items():
            setattr(out, k, v)
        return out

    # ---- what there is

    @property
    def spark(self) -> SparkSession:
        return self._df.sparkSession

    def __contains__(self, bank: str) -> bool:
        return bank in self.dictionary

    def __iter__(self) -> Iterator[str]:
        return iter(self.dictionary.names())

    def __len__(self) -> int:
        """The number of events before any filter."""
        return self.num_entries

    @property
    def num_entries(self) -> int:
        return sum(i.events for i in self.infos) if self.infos is not None else self._df.count()

    @property
    def files(self) -> list[str]:
        if self.infos is not None:
            return [i.path for i in self.infos]
        return [r[0] for r in self._df.groupBy("file_index", "file_path").count().orderBy("file_index").select("file_path").collect()]

    @property
    def tag_names(self) -> dict[str, int]:
        return dict(self.registry)

    def file_header(self, index: int = 0) -> dict:
        if self.infos is None:
            raise ValueError("this chain isn't of containers")
        return dict(self.infos[index].header)

    def bank_ids(self, bank: str) -> tuple[int, int]:
        b = self.dictionary[bank]
        return b.group, b.item

    def columns(self, bank: str) -> list[str]:
        return [c.name for c in self.dictionary[bank].columns]

    def keys(self, recursive: bool = True, filter_name: str | Iterable[str] | None = None) -> list[str]:
        """Bank names, and with recursive bank/column too, as far as globs match."""
        found = match_names(self.dictionary, filter_name) if filter_name is not None else {b.name: [c.name for c in b.columns] for b in self.dictionary}
        return [k for b, cols in found.items() for k in ([b] + [f"{b}/{c}" for c in cols] if recursive else [b])]

    def typenames(self) -> dict[str, str]:
        return {f"{b.name}/{c.name}": c.type_text for b in self.dictionary for c in b.columns}

    def show(self, limit: int | None = 8) -> str:
        """The schemas, by group and item; beyond `limit` (None: all) only how many more there are."""
        lines = [b.to_text() for b in self.dictionary.sorted()]
        more = 0 if limit is None else max(0, len(lines) - limit)
        return "\n".join([*lines[: len(lines) - more], *([f"... {more} more"] if more else [])])

    def records(self) -> list[batches.RecordRow]:
        """The record table: from headers for containers, by one aggregation otherwise."""
        if self.infos is not None:
            out, first = [], 0
            for k, info in enumerate(self.infos):
                for s in info.spans:
                    out.append(batches.RecordRow(k, info.path, first, s.events, s.length))
                    first += s.events
            return out
        rows = self._df.groupBy("file_index", "file_path", "record_index").agg(F.min("event_id").alias("first"), F.count("*").alias("n")).orderBy("first").collect()
        return [batches.RecordRow(r["file_index"], r["file_path"], r["first"], r["n"]) for r in rows]

    # ---- narrowing

    def filtered(self, require=None, record_tag=None, event_tag=None, event_tag_any=None) -> EventChain:
        """The events that also meet these clauses; see FilterSpec.narrowed."""
        return self._with(spec=self.spec.narrowed(self.dictionary, self.registry, require, record_tag, event_tag, event_tag_any))

    def with_filter(self, spec: FilterSpec) -> EventChain:
        """The same events under another filter altogether."""
        for n in spec.require:
            self.dictionary[n]
        return self._with(spec=spec)

    def _events(self, selection: dict[str, list[str]] | None = None, start: int | None = None, stop: int | None = None, ranges=None) -> DataFrame:
        """The surviving events of a range; containers decode only the selected banks and those the filter needs."""
        df = self._df if not self._options else self._load(selection, start, stop, ranges)
        if ranges is not None:
            df = df.where(in_ranges(F.col("event_id"), ranges))
        if start is not None:
            df = df.where(F.col("event_id") >= start)
        if stop is not None:
            df = df.where(F.col("event_id") < stop)
        condition = self.spec.condition()
        return df if condition is None else df.where(condition)

    def _load(self, selection, start, stop, ranges) -> DataFrame:
        """Containers anew, with what their reader can leave out by itself."""
        options = dict(self._options)
        if selection is not None:
            wanted = dict(selection)
            for n in self.spec.require:
                wanted.setdefault(n, [self.dictionary[n].columns[0].name])
            options["banks"] = json.dumps(wanted)
        if ranges is not None:
            merged = merge_ranges(ranges)
            start, stop = (merged[0][0], merged[-1][1]) if merged else (0, 0)
        if start is not None:
            options["start"] = str(max(0, start))
        if stop is not None:
            options["stop"] = str(stop)
        if self.spec.require:
            options["require"] = json.dumps(list(self.spec.require))
        if self.spec.record_tags is not None:
            options["record_tags"] = json.dumps(sorted(self.spec.record_tags))
        if self.spec.event_tags is not None:
            options["event_tags"] = json.dumps(sorted(self.spec.event_tags))
        if self.spec.any_mask:
            options["event_tag_any"] = str(int(self.spec.any_mask))
        # with the schema given, files are opened once a read, to plan it
        schema = datasource.frame_schema(datasource.selected(self.dictionary, options))
        return self.spark.read.format(datasource.FORMAT).schema(schema).options(**options).load()

    # ---- selecting

    def select(self, banks: str | Iterable[str] | None = None, columns: Iterable[str] | None = None, filter_name: str | Iterable[str] | None = None) -> Selection:
        """Resolve names before anything is read: unknown ones are errors, globs without a match give nothing."""
        if filter_name is not None:
            if banks is not None or columns is not None:
                raise TypeError("filter_name excludes banks and columns")
            return Selection(match_names(self.dictionary, filter_name), False)
        single = isinstance(banks, str) and not is_glob(banks)
        if columns is not None and not single:
            raise TypeError("columns need one bank by its name")
        if banks is None:
            names = self.dictionary.names()
        elif isinstance(banks, str):
            names = [banks] if single else list(match_names(self.dictionary, banks))
        else:
            names = [n for b in banks for n in (match_names(self.dictionary, b) if is_glob(b) else [b])]
        out = {n: [c.name for c in self.dictionary[n].columns] for n in dict.fromkeys(names)}
        if columns is not None and list(columns):
            out = {banks: [self.dictionary[banks].column(c).name for c in columns]}
        return Selection(out, single)

    def arrays(self, banks=None, columns=None, filter_name=None, entry_start: int | None = None, entry_stop: int | None = None, entries: Iterable[int] | None = None, cut: str | None = None) -> DataFrame:
        """event_id and the selected banks as arrays of structs, a row for each surviving event.

        `entries` gives a row for each listed event instead, in the list's order (column pos), with empty banks for
        events that aren't there. `cut` is a row cut or an event cut on one bank; columns only it needs are dropped.
        """
        s = self.select(banks, columns, filter_name)
        if entries is not None:
            if cut is not None or entry_start is not None or entry_stop is not None:
                raise ValueError("entries exclude ranges and cuts")
            return self._gather(s, list(entries))
        if cut is None:
            df = self._events(s.banks, entry_start, entry_stop)
            return df.select("event_id", *[self._rows(b, cols).alias(b) for b, cols in s.banks.items()])
        if len(s.banks) != 1:
            raise ValueError("a cut is on exactly one bank")
        bank, cols = next(iter(s.banks.items()))
        own = self.dictionary[bank]
        parsed = jagged.Cut(cut, {c.name: c.letter in "FD" and c.length == 1 for c in own.columns})
        read = list(dict.fromkeys([*cols, *parsed.names]))
        df = self._events({bank: read}, entry_start, entry_stop).select("event_id", self._rows(bank, read).alias("__b"))
        result = F.expr(parsed.sql("__b"))
        if parsed.by_event:
            df = df.withColumn("__keep", result)
            if df.schema["__keep"].dataType != T.BooleanType():
                raise ValueError(f"the cut {cut!r} is no condition")
            kept = df.where("__keep")
        else:
            kept = df.withColumn("__b", result)
        return kept.select("event_id", F.transform("__b", lambda r: F.struct(*[r[c].alias(c) for c in cols])).alias(bank) if read != cols else F.col("__b").alias(bank))

    @staticmethod
    def _rows(bank: str, cols: list[str]) -> Column:
        rows = jagged.rows(bank, cols)
        return F.when(jagged.field(bank, cols[0]).isNotNull(), rows).otherwise(F.filter(F.array(F.get(rows, F.lit(0))), lambda r: F.lit(False)))

    def _gather(self, s: Selection, entries: list[int]) -> DataFrame:
        if self.spec.active:
            raise ValueError("entries need an unfiltered chain")
        if any(isinstance(e, bool) or not isinstance(e, int) for e in entries):
            raise TypeError("entries are integers")
        if any(e < 0 for e in entries):
            raise ValueError("entries are not negative")
        wanted = self.spark.createDataFrame(list(enumerate(entries)), "pos long, event_id long")
        some = sorted(set(entries))
        # records outside of the range aren't read; beyond 10,000 entries the join alone picks among the others
        df = self._events(s.banks, some[0] if some else 0, some[-1] + 1 if some else 0).select("event_id", *[f"`{n}`" for n in s.banks])
        if len(some) <= 10_000:
            df = df.where(F.col("event_id").isin(some))
        return wanted.join(df, "event_id", "left").select("pos", "event_id", *[self._rows(b, cols).alias(b) for b, cols in s.banks.items()])

    def array(self, bank: str, column: str) -> DataFrame:
        """event_id and one column as an array, [] without rows."""
        self.dictionary[bank].column(column)
        df = self._events({bank: [column]})
        return df.select("event_id", F.coalesce(jagged.field(bank, column), F.array().cast(df.select(jagged.field(bank, column)).schema[0].dataType)).alias(column))

    def __getitem__(self, key) -> DataFrame:
        """chain["B"], chain["B/c"], chain["B", "c"], chain["B", ["c", "d"]]."""
        if isinstance(key, tuple):
            bank, cols = key
            return self.array(bank, cols) if isinstance(cols, str) else self.arrays(bank, cols)
        if key not in self.dictionary and "/" in key:
            bank, _, column = key.rpartition("/")
            return self.array(bank, column)
        return self.arrays(key)

    def flat(self, bank: str, columns: Iterable[str] | None = None, keep: Iterable[str] = ("event_id",), **ranges: Any) -> DataFrame:
        """The bank's rows with event_id and row_idx; events without rows are absent."""
        s = self.select(bank, columns)
        return jagged.flat(self._events(s.banks, **ranges), bank, s.banks[bank], keep)

    def numpy(self, bank: str, column: str):
        """(values, offsets, inner length) of a column over all surviving events, in order, on the driver."""
        c = self.dictionary[bank].column(column)
        table = self.array(bank, column).orderBy("event_id").select(column).toArrow()
        held = table.column(0).combine_chunks()
        flat = held.flatten()
        values = flat.flatten() if c.length > 1 else flat
        offsets = held.offsets.to_numpy()
        return values.to_numpy(zero_copy_only=False), offsets - offsets[0], c.length

    def to_arrow(self, *args: Any, **kwargs: Any) -> pa.Table:
        return self.arrays(*args, **kwargs).orderBy("event_id").toArrow()

    def to_pandas(self, bank: str, columns: Iterable[str] | None = None):
        """Rows under (entry, subentry), events without rows absent; attrs["num_entries"] counts all that survive."""
        s = self.select(bank, columns)
        out = self.flat(bank, columns).orderBy("event_id", "row_idx").toPandas().set_index(["event_id", "row_idx"]).rename_axis(["entry", "subentry"])
        out.attrs["num_entries"] = self._events(s.banks).count()
        return out

    def composite(self, bank: str, entry_start: int | None = None, entry_stop: int | None = None) -> DataFrame:
        """event_id and the rows of a composite bank as structs f0, f1, …; a range is on event ids like all others."""
        if not self._options:
            raise KeyError(f"no composite bank {bank!r}")
        df = self.spark.read.format(datasource.FORMAT).options(**self._options, banks="{}", composite=bank).load()
        return self._with(_df=df, _options=None)._events(None, entry_start, entry_stop).select("event_id", F.col(f"`{bank}`"))

    def event_tags(self, entry_start: int | None = None, entry_stop: int | None = None) -> DataFrame:
        return self._events({}, entry_start, entry_stop).select("event_id", "event_tag")

    def event(self, index: int) -> EventView | None:
        """One event by its index before any filter; None beyond the end."""
        row = self._with(spec=FilterSpec())._events(None, index, index + 1).first()
        return EventView(row.asDict(recursive=True)) if row else None

    def events(self) -> Iterator[dict]:
        """All surviving events in order, a partition at a time."""
        for row in self._events().orderBy("event_id").toLocalIterator():
            yield row.asDict(recursive=True)

    def take(self, n: int) -> list[dict]:
        """The first n surviving events."""
        return [r.asDict(recursive=True) for r in self._events().orderBy("event_id").limit(n).collect()]

    def typed_column(self, bank: str, column: str, kind: str) -> DataFrame:
        """One column of all rows (event_id, row_idx, column), strict: another type letter than `kind` is an error."""
        own = self.dictionary[bank].column(column)
        if own.letter != kind:
            raise TypeError(f"{bank}/{column} is {own.type_text}, not {kind}")
        return self.flat(bank, [column])

    def record_spans(self) -> DataFrame:
        """The record table: file_index, file_path, first event, events, bytes."""
        rows = [(r.file_index, r.file_path, r.first, r.events, r.bytes) for r in self.records()]
        return self.spark.createDataFrame(rows, "file_index int, file_path string, first long, events long, bytes long")

    def record_decompressed_sizes(self) -> DataFrame:
        """file_index, record_index and the bytes that each record takes once inflated, from the records' headers alone."""
        if self.infos is None:
            raise ValueError("this chain isn't of containers")
        rows = [(k, n, i.path, s.position) for k, i in enumerate(self.infos) for n, s in enumerate(i.spans)]
        spans = self.spark.createDataFrame(rows, "file_index int, record_index int, path string, position long")
        return spans.repartition("path").sortWithinPartitions("path", "position").mapInArrow(datasource.inflated_sizes, "file_index int, record_index int, bytes long")

    def offsets(self, bank: str, column: str) -> DataFrame:
        """event_id, rows and offset_end of every event: the bank's rows up to its end, over all surviving events.

        Rows add up within records first; of records and files only sums go on to the next window, so no window has
        more rows than a record has events, a file records, or the chain files.
        """
        self.dictionary[bank].column(column)
        df = self._events({bank: [column]}).select("event_id", "file_index", "record_index", jagged.counts(bank, column).alias("rows"))
        up_to = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        inner = df.withColumn("inside", F.sum("rows").over(up_to(Window.partitionBy("file_index", "record_index").orderBy("event_id"))))
        records = df.groupBy("file_index", "record_index").agg(F.sum("rows").alias("n"))
        files = records.groupBy("file_index").agg(F.sum("n").alias("n"))
        files = files.select("file_index", (F.sum("n").over(up_to(Window.orderBy("file_index"))) - F.col("n")).alias("before_file"))
        sums = records.withColumn("before", F.sum("n").over(up_to(Window.partitionBy("file_index").orderBy("record_index"))) - F.col("n"))
        before = sums.join(files, "file_index").select("file_index", "record_index", (F.col("before") + F.col("before_file")).alias("before"))
        return inner.join(before, ["file_index", "record_index"]).select("event_id", "rows", (F.col("inside") + F.col("before")).alias("offset_end"))

    def scan_rate(self, banks=None) -> float:
        """Thousands of events a second that a full read of the banks gives."""
        import time

        start = time.perf_counter()
        self.arrays(banks).write.format("noop").mode("overwrite").save()
        return self.num_entries / 1000 / max(time.perf_counter() - start, 1e-9)

    def for_ranges(self, ranges: Iterable[tuple[int, int]], banks=None, columns=None) -> DataFrame:
        """arrays() over a union of ranges; each event once."""
        s = self.select(banks, columns)
        df = self._events(s.banks, ranges=list(ranges))
        return df.select("event_id", *[self._rows(b, cols).alias(b) for b, cols in s.banks.items()])

    # ---- joins within events

    def link(self, banks: Iterable[str], particles: str, index: str = "pindex", directions: str = "both") -> DataFrame:
        """The banks with particles beside detector rows and detector rows beside particles."""
        names = list(dict.fromkeys([particles, *banks]))
        fields = {n: self.columns(n) for n in names}
        df = link.link(self._events(fields), particles, [n for n in names if n != particles], fields, index, directions)
        return df.select("event_id", *names)

    # ---- reductions

    def occupancy(self, entry_start: int | None = None, entry_stop: int | None = None) -> DataFrame:
        """bank, events (with a row or more), rows, max_rows, scanned; banks without rows have zeros."""
        narrow = {b.name: [min(b.columns, key=lambda c: c.size).name] for b in self.dictionary}
        return occupancy.occupancy(self._events(narrow, entry_start, entry_stop), {b: c[0] for b, c in narrow.items()})

    def chunks(self, step: int | str, entry_start: int | None = None, entry_stop: int | None = None) -> list[batches.Chunk]:
        return batches.plan(self.records(), step, entry_start, entry_stop)

    def iterate(self, step: int | str, banks=None, columns=None, filter_name=None, entry_start=None, entry_stop=None, cut=None, ahead: int = 0) -> Iterator[tuple[pa.Table, batches.Chunk]]:
        """Chunks in event order, each read by itself, so that only its records are; `ahead` more are read meanwhile."""
        read = lambda c: self.arrays(banks, columns, filter_name, c.start, c.stop, cut=cut)
        self.select(banks, columns, filter_name)
        return batches.iterate(read, self.chunks(step, entry_start, entry_stop), ahead)

    def map_reduce(self, fn, reduce, step: int | str, banks=None, columns=None, filter_name=None, entry_start=None, entry_stop=None, cut=None, **initial: Any) -> Any:
        df = self.arrays(banks, columns, filter_name, entry_start, entry_stop, cut=cut)
        return batches.map_reduce(df, self.chunks(step, entry_start, entry_stop), fn, reduce, **initial)

    def par_fold(self, zero, fold, merge, banks=None, columns=None) -> Any:
        return batches.par_fold(self.arrays(banks, columns), zero, fold, merge)

    def fold(self, acc, step, banks=None, columns=None) -> Any:
        return batches.fold(self.arrays(banks, columns), acc, step)

    def for_each(self, fn, banks=None, columns=None) -> dict[str, int]:
        stats = batches.for_each(self.arrays(banks, columns), fn)
        spans = len(self.infos) and sum(len(i.spans) for i in self.infos) if self.infos is not None else self._df.select("file_index", "record_index").distinct().count()
        return {"events_in": self.num_entries, "events_yielded": stats["events"], "records": spans, "files": len(self.files), "partitions": stats["partitions"], "elapsed": stats["elapsed"]}

    # ---- writing

    def skim(self, path: str, tags: Column | None = None, **options: Any) -> sinks.Summary:
        return sinks.skim(self, path, tags=tags, **options)

    def skim_banks(self, path: str, patterns: str | Iterable[str], **options: Any) -> sinks.Summary:
        return sinks.skim_banks(self, path, patterns, **options)

    def retagged(self, updates: DataFrame) -> EventChain:
        return sinks.retag(self, updates)

    def decorated(self, bank: Bank, rows: DataFrame) -> EventChain:
        return sinks.decorate(self, bank, rows)

    def to_parquet(self, path: str, banks=None, columns=None, filter_name=None, cut=None, compression: str = "zstd", mode: str = "errorifexists") -> None:
        """A list column for each bank column, bare names for one bank, bank/column otherwise."""
        s = self.select(banks, columns, filter_name)
        df = self.arrays(banks, columns, filter_name, cut=cut)
        df.select(*sinks.list_columns(s.banks, s.single)).write.mode(mode).option("compression", compression).parquet(path)

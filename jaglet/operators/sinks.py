"""Writing chains: skims, bank projections, new tags, decorated copies; as containers or as Parquet event frames."""

from __future__ import annotations

import contextlib
import dataclasses
import json
import re
import threading
import uuid
from collections.abc import Iterable
from dataclasses import dataclass
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jaglet.schema import Bank, Dictionary, resolve_banks
from jaglet.sources import datasource

if TYPE_CHECKING:
    from jaglet.frame import EventChain


@dataclass(frozen=True)
class Summary:
    """What a write did; dropped and dangling are of bank projections."""

    events: int
    kept: tuple[str, ...]
    dropped_structures: int = 0
    dangling: tuple[str, ...] = ()
    files: int = 0
    bytes: int = 0
    records: int | None = None  # of containers


def write(df: DataFrame, path: str, format: str = "parquet", dictionary: Dictionary | None = None, registry=None, config=None, compression: str | None = None, mode: str = "errorifexists", **options: Any) -> None:
    """An event frame as Parquet (with the dictionary, tags and config in the schema) or as containers."""
    if format == "parquet":
        facts = {"dictionary": dictionary.to_text() if dictionary else "", "tag_registry": registry.to_text() if registry else "", "config": json.dumps(config or {})}
        marked = df.withMetadata("event_id", facts)
        marked.write.mode(mode).option("compression", compression or "zstd").options(**options).parquet(path)
        return
    datasource.register(df.sparkSession)
    extra = {"compression": compression or "lz4", "config": json.dumps(config or {}), **{k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items()}}
    if dictionary:
        extra["dictionary"] = dictionary.to_text()
    if registry:
        extra["tag_registry"] = registry.to_text()
    if mode not in ("errorifexists", "overwrite"):
        raise ValueError("containers are written anew: errorifexists or overwrite")
    df.write.format(datasource.FORMAT).mode("append" if mode == "errorifexists" else "overwrite").options(**extra).save(path)


def read_frame(spark, path: str) -> EventChain:
    """A Parquet event frame that write() made, with what its schema says."""
    from jaglet.frame import EventChain
    from jaglet.tags import TagRegistry

    df = spark.read.parquet(path)
    facts = df.schema["event_id"].metadata
    chain = EventChain.from_frame(df, TagRegistry.parse(facts.get("tag_registry", "")), json.loads(facts.get("config", "{}")))
    if facts.get("dictionary"):
        chain.dictionary = Dictionary.parse(facts["dictionary"])
    return chain


def skim(chain: EventChain, path: str, tags: Column | None = None, banks: list[str] | None = None, dictionary: Dictionary | None = None, registry=None, progress=None, **options: Any) -> Summary:
    """Copy the surviving events. Event tags stay, or become `tags` (then the names of tags go); record tags become 0.

    Events are counted while they are written. progress(done, total) is called with the tasks of the write, about once a
    second while it runs and once at its end.
    """
    names = chain.dictionary.names() if banks is None else banks
    df = chain._events({n: chain.columns(n) for n in names}).withColumn("record_tag", F.lit(0).cast("long"))
    if tags is not None:
        df = df.withColumn("event_tag", tags.cast("long"))
        bad = df.where("event_tag is null or event_tag < 0 or event_tag > 4294967295").limit(1).count()
        if bad:
            raise ValueError("tags are 0 to 2**32-1 for every event")
    kept = registry if tags is not None else chain.registry
    seen = Observation()
    counted = df.select(*datasource.FIXED, *[f"`{n}`" for n in names]).observe(seen, F.count(F.lit(1)).alias("events"))
    with _watched(chain.spark, progress):
        write(counted, path, dictionary=dictionary or Dictionary(chain.dictionary[n] for n in names), registry=kept, config=chain.config, **options)
    files, size = chain.spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    records = sum(len(i.spans) for i in datasource.open_files(datasource.resolve(path))) if options.get("format") == datasource.FORMAT else None
    return Summary(seen.get.get("events", 0), tuple(names), files=files, bytes=size, records=records)


@contextlib.contextmanager
def _watched(spark, progress):
    """Calls progress(done, total) with the tasks of this thread's jobs while the block runs, and once behind it."""
    if progress is None:
        yield
        return
    sc, group, over, last = spark.sparkContext, f"skim-{uuid.uuid4().hex}", threading.Event(), [0, 0]
    sc.setJobGroup(group, "skim")
    tracker = sc.statusTracker()

    def look():
        stages = {s for j in tracker.getJobIdsForGroup(group) if (job := tracker.getJobInfo(j)) for s in job.stageIds}
        infos = [i for i in map(tracker.getStageInfo, stages) if i]
        last[:] = sum(i.numCompletedTasks for i in infos), max(last[1], sum(i.numTasks for i in infos))
        progress(*last)

    def watch():
        while not over.wait(1):
            look()

    thread = threading.Thread(target=watch, daemon=True)
    thread.start()
    try:
        yield
    finally:
        over.set()
        thread.join()
        look()
        sc._jsc.clearJobGroup()


def dangling(dictionary: Dictionary, kept: Iterable[str], index: str = "pindex") -> list[str]:
    """Kept banks whose rows point into a particle bank of their family that is dropped."""
    kept = set(kept)
    out = []
    for n in sorted(kept):
        family, sep, own = n.partition("::")
        target = f"{family}{sep}Particle"
        if sep and own != "Particle" and target in dictionary and target not in kept and any(c.name == index for c in dictionary[n].columns):
            out.append(n)
    return out


def skim_banks(chain: EventChain, path: str, patterns: str | Iterable[str], prune_dictionary: bool = True, **options: Any) -> Summary:
    """Copy the events with some banks only; counts the structures that go, names references that then lead nowhere."""
    kept = resolve_banks(chain.dictionary, patterns)
    gone = [n for n in chain.dictionary.names() if n not in kept]
    dropped = 0
    if gone:
        held = chain._events({n: [chain.columns(n)[0]] for n in gone})
        dropped = held.agg(sum((F.count(F.col(f"`{n}`")) for n in gone[1:]), F.count(F.col(f"`{gone[0]}`")))).first()[0]
    done = skim(chain, path, banks=kept, dictionary=Dictionary(chain.dictionary[n] for n in kept) if prune_dictionary else chain.dictionary, registry=chain.registry, **options)
    return dataclasses.replace(done, dropped_structures=int(dropped), dangling=tuple(dangling(chain.dictionary, kept)))


def retag(chain: EventChain, updates: DataFrame) -> EventChain:
    """The chain with other tags for the events in updates(event_id, event_tag); all are checked before any changes."""
    bad = updates.where("event_id is null or event_tag is null or event_tag < 0 or event_tag > 4294967295").limit(1).count()
    twice = updates.groupBy("event_id").count().where("count > 1").limit(1).count()
    unknown = updates.join(chain._df.select("event_id"), "event_id", "left_anti").limit(1).count()
    if bad or twice or unknown:
        raise ValueError("updates need one tag of 0 to 2**32-1 for events that are there")
    new = updates.select("event_id", F.col("event_tag").cast("long").alias("__tag"))
    df = chain._df.join(new, "event_id", "left").withColumn("event_tag", F.coalesce("__tag", "event_tag")).select(*chain._df.columns)
    return chain._with(_df=df, _options=None)


def decorate(chain: EventChain, bank: Bank, rows: DataFrame) -> EventChain:
    """The chain with one more bank from rows(event_id, array of structs or its columns as arrays), one row for every event."""
    if bank.name in chain.dictionary:
        raise ValueError(f"there is a bank {bank.name!r}")
    names = [c.name for c in bank.columns]
    if bank.name in rows.columns:
        new = rows.select("event_id", F.col(f"`{bank.name}`").alias("__new"))
    else:
        arrays = [F.when(F.lit(isinstance(rows.schema[n].dataType, T.ArrayType)), F.col(f"`{n}`")).otherwise(F.col(f"`{n}`")) if isinstance(rows.schema[n].dataType, T.ArrayType) else F.array(F.col(f"`{n}`")) for n in names]
        even = F.lit(True)
        for a in arrays[1:]:
            even = even & (F.size(a) == F.size(arrays[0]))
        if rows.where(~even).limit(1).count():
            raise ValueError(f"columns of {bank.name!r} differ in their counts")
        zipped = F.arrays_zip(*[a.alias(n) for a, n in zip(arrays, names, strict=True)])
        new = rows.select("event_id", zipped.cast(bank.field().dataType).alias("__new"))
    if chain._df.join(new, "event_id", "left_anti").limit(1).count() or new.join(chain._df, "event_id", "left_anti").limit(1).count() or new.groupBy("event_id").count().where("count > 1").limit(1).count():
        raise ValueError(f"{bank.name!r} needs one entry for each of the chain's events")
    df = chain._df.join(new.withColumnRenamed("__new", bank.name), "event_id", "left")
    return chain._with(_df=df, dictionary=Dictionary([*chain.dictionary, bank]), _options=None)


def flat_names(banks: dict[str, list[str]], single: bool) -> list[str]:
    return [c if single else f"{b}/{c}" for b, cols in banks.items() for c in cols]


def safe_names(names: Iterable[str]) -> list[str]:
    """Names for systems that want identifiers: other characters become one _, a leading digit gets one; no two may meet."""
    out = []
    for n in names:
        safe = re.sub(r"\W+", "_", n)
        if not safe:
            raise ValueError(f"nothing is left of {n!r}")
        out.append("_" + safe if safe[0].isdigit() else safe)
    if len(set(out)) < len(out):
        raise ValueError(f"names collide: {sorted({n for n in out if out.count(n) > 1})}")
    return out


def list_columns(banks: dict[str, list[str]], single: bool) -> list[Column]:
    return [F.col(f"`{b}`.`{c}`").alias(c if single else f"{b}/{c}") for b, cols in banks.items() for c in cols]

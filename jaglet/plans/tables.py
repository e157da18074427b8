"""The event model over the star-schema tables: orders are events, their line items a particle and a detector bank."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jaglet.frame import EventChain
from jaglet.schema import Bank, Column as BankColumn, Dictionary
from jaglet.session import shared_dir
from jaglet.sources.datasource import FIXED

ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus"]
REGISTRY = {"urgent": 0, "high": 1, "medium": 2, "unspecified": 3, "low": 4, "fulfilled": 5, "open": 6, "partial": 7}
# The particle codes that part keys stand for.
CODES = [11, 22, 211, 2212, 0]
PARTICLE = Bank("Particle", 300, 1, tuple(BankColumn(n, t) for n, t in (("pid", "I"), ("px", "D"), ("py", "D"), ("pz", "D"), ("status", "I"))))
CALO = Bank("Calo", 332, 11, tuple(BankColumn(n, t) for n, t in (("pindex", "I"), ("layer", "I"), ("energy", "D"))))
FILE_EVENTS, RECORD_EVENTS, TAG_EVENTS = 4000, 100, 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _particle(get) -> dict[str, Column]:
    pid = F.element_at(F.array(*[F.lit(c) for c in CODES]), (get("l_partkey") % 5 + 1).cast("int"))
    return {"pid": pid, "px": get("l_quantity"), "py": F.round(get("l_discount") * 100), "pz": F.round(get("l_tax") * 100), "status": ((get("l_partkey") % 5000) - 2000).cast("int")}


def _calo(get) -> dict[str, Column]:
    return {"pindex": (get("l_linenumber") - 1).cast("int"), "layer": (get("l_suppkey") % 3).cast("int"), "energy": get("l_extendedprice")}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, file_index, file_path, record_index, record_tag and event_tag of every order."""
    key, priority = F.col("o_orderkey"), F.substring("o_orderpriority", 1, 1).cast("int")
    status = F.when(F.col("o_orderstatus") == "F", 32).when(F.col("o_orderstatus") == "O", 64).otherwise(128)
    tag = F.call_function("shiftleft", F.lit(1), priority - 1).bitwiseOR(status).cast("long")
    index = F.floor(key / FILE_EVENTS).cast("int")
    return table(spark, sf_dir, "orders").select(key.alias("event_id"), index.alias("file_index"), F.format_string("orders-%d", index).alias("file_path"), F.floor((key % FILE_EVENTS) / RECORD_EVENTS).cast("int").alias("record_index"), F.floor(key / TAG_EVENTS).cast("long").alias("record_tag"), tag.alias("event_tag"))


def banks(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """event_id and the banks, rows in the total order of their line items; one shuffle of the columns of that order."""
    packed = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(*ORDER))).alias("s"))
    return packed.select(F.col("l_orderkey").alias("event_id"), *[_bank("s", _particle if n == "Particle" else _calo).alias(n) for n in names])


def _bank(packed: str, fields) -> Column:
    return F.transform(packed, lambda r: F.struct(*[c.alias(k) for k, c in fields(lambda n: r[n]).items()]))


def flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat twin of both banks without row numbers, for reductions that need no order: no shuffle."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("event_id"), *[c.alias(k) for k, c in {**_particle(F.col), **_calo(F.col)}.items()])


def _stamp(spark: SparkSession, sf_dir: str) -> tuple:
    """What files the frame is made of, by path, length and time; contents aren't read."""
    paths = [f"{sf_dir}/{name}.parquet" for name in ("orders", "lineitem")]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path", "length", F.col("modificationTime").cast("double").alias("at"))
    seen = files.agg(F.count("*"), F.sum("length"), F.max("at"), F.sum(F.xxhash64("path", "length", "at").cast("decimal(20,0)"))).first()
    return (spark.sparkContext.applicationId, sf_dir, *seen)


_written: dict[tuple, str] = {}


def _there(spark: SparkSession, path: str) -> bool:
    """Whether the shared folder still has a file, which may have been cleaned."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event frame with both banks, as nested Parquet in event order within files.

    It is written once for an application and state of the tables, in the shared folder, as chains are stored event by
    event as well; queries read the columns that they need of it, and none shuffles line items again. Events
    without line items lack the banks.
    """
    key = _stamp(spark, sf_dir)
    if key not in _written or not _there(spark, f"{_written[key]}/_SUCCESS"):
        path = f"{shared_dir(spark)}/frame-{uuid.uuid4().hex}"
        df = events(spark, sf_dir).join(banks(spark, sf_dir, "Particle", "Calo"), "event_id", "left")
        df.sortWithinPartitions("event_id").write.option("compression", "zstd").parquet(path)
        _written[key] = path
    return spark.read.parquet(_written[key])


def chain(spark: SparkSession, sf_dir: str, *names: str) -> EventChain:
    """The chain of all orders with the named banks (both, without names); orders without line items lack them."""
    names = names or ("Particle", "Calo")
    out = EventChain.from_frame(frame(spark, sf_dir).select(*FIXED, *names), REGISTRY, {"tables": "star"})
    out.dictionary = Dictionary([b for b in (PARTICLE, CALO) if b.name in names])
    return out


#: The same model in SQL: ev has a row for each event, part for each row of both banks.
SQL = """WITH ev AS (SELECT o_orderkey AS event_id, o_orderkey // 4000 AS file_index, (o_orderkey % 4000) // 100 AS record_index, o_orderkey // 1000 AS record_tag,
  CAST((1 << (CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1)) | (CASE o_orderstatus WHEN 'F' THEN 32 WHEN 'O' THEN 64 ELSE 128 END) AS BIGINT) AS event_tag FROM orders),
part AS (SELECT l_orderkey AS event_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) - 1 AS row_idx,
  CASE l_partkey % 5 WHEN 0 THEN 11 WHEN 1 THEN 22 WHEN 2 THEN 211 WHEN 3 THEN 2212 ELSE 0 END AS pid, l_quantity AS px, round(l_discount * 100) AS py, round(l_tax * 100) AS pz, (l_partkey % 5000) - 2000 AS status,
  l_linenumber - 1 AS pindex, l_suppkey % 3 AS layer, l_extendedprice AS energy FROM lineitem)
"""

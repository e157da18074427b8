"""Token counts as delta-maintained rollups.

A rollup is a folder of committed batches. A batch of changes (inserts and revisions of a document's count, deletes)
becomes signed deltas against what the ledger has of these documents: the old count leaves, the new one enters.
Totals by source, language and tokenizer version are additive, so they are the sum of all deltas. The ledger is kept
in buckets of document ids, and a batch is joined with the buckets that its documents are in; compact() writes what
the ledger has come to as one table, so the cost of a batch doesn't grow with their number. Batches are written under
their id and take effect with their marker file, which is written last: a batch that failed half-way leaves
nothing that is read and may be run again, and a batch that is committed once more changes nothing. A marker has the
batch's number for its name and is never overwritten, so of two writers that saw the same state one fails.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jaglet.llm.common import extended, place, session_of, table
from jaglet.llm.tokenizer import default_path, encoder
from jaglet.session import shared_dir

KEYS = ["source", "lang", "tokenizer"]
LEDGER = "doc_id long, source string, lang string, tokenizer string, n_tokens long, batch_no long, deleted boolean"
#: Buckets of the ledger, the same for all of a rollup's life.
BUCKETS = 64
DELTAS = "source string, lang string, tokenizer string, d_docs long, d_tokens long"


def count_tokens(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep: Iterable[str] = ("doc_id", "source", "lang")) -> DataFrame:
    """docs' columns `keep` and n_tokens, the ids of the whole text (null and empty: none); no shuffle.

    Rows are counted one by one, repeated ones too; an empty table gives an empty table; a column named n_tokens is
    replaced.
    """
    session_of(docs)
    path = path or default_path()

    def kernel(b: pa.RecordBatch):
        encode = encoder(path)
        yield 0, b.num_rows, [pa.array([len(encode(t.as_py() or "")) for t in b.column(0)], pa.int64())]

    return extended(docs, kernel, [T.StructField("n_tokens", T.LongType())], [F.col(f"c{place(docs, text_col)}")], keep)


class Rollup:
    """Totals of documents and tokens by source, lang and tokenizer in the folder root, any that Spark can write to."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _marked(self, folder: str) -> dict[int, str]:
        """What the marker files of a folder say, by their numbers."""
        fs, at = self._fs(f"{self.root}/{folder}")
        out, read = {}, self.spark._jvm.org.apache.commons.io.IOUtils.toString
        for f in fs.listStatus(at) if fs.exists(at) else ():
            name = f.getPath().getName()
            if name.isdigit():
                stream = fs.open(f.getPath())
                out[int(name)] = read(stream, "UTF-8")
                stream.close()
        return dict(sorted(out.items()))

    def _mark(self, folder: str, number: int, text: str) -> bool:
        """Write a marker file; False if there is one of that number."""
        fs, at = self._fs(f"{self.root}/{folder}/{number:08d}")
        if fs.exists(at):
            return False
        try:
            out = fs.create(at, False)
        except Py4JJavaError as e:
            if "Exist" in e.java_exception.getClass().getSimpleName():
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def committed(self) -> list[str]:
        """Ids of the committed batches in their order."""
        return list(self._marked("markers").values())

    def _parts(self, kind: str, done: list[str]) -> list[str]:
        """Folders of a kind that make up the state after the batches `done`: the last compact one, and the batches since."""
        whole = max(self._marked("compact"), default=0)
        head = [f"{self.root}/{kind}/batch=compact-{whole:08d}"] if whole else []
        return [*head, *(f"{self.root}/{kind}/batch={b}" for b in done[whole:])]

    def _read(self, kind: str, schema: str, done: list[str]) -> DataFrame:
        paths = self._parts(kind, done)
        return self.spark.read.option("basePath", f"{self.root}/{kind}").schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _write_ledger(self, rows: DataFrame, batch: str) -> None:
        held = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int")).repartition("bucket")
        held.write.mode("overwrite").partitionBy("bucket").option("compression", "zstd").parquet(f"{self.root}/ledger/batch={batch}")

    def ledger(self, buckets: list[int] | None = None) -> DataFrame:
        """The current count of each document and tokenizer (of some buckets), and whether it is deleted."""
        rows = self._read("ledger", f"{LEDGER}, batch string, bucket int", self.committed())
        if buckets is not None:
            rows = rows.where(F.col("bucket").isin(buckets))
        newest = F.struct("batch_no", "source", "lang", "n_tokens", "deleted")
        last = rows.groupBy("doc_id", "tokenizer").agg(F.max(newest).alias("x"))
        return last.select("doc_id", "tokenizer", "x.source", "x.lang", "x.n_tokens", "x.deleted")

    def compact(self) -> None:
        """Write the ledger and totals as they are as one batch, which is read instead of those that it sums up."""
        done = self.committed()
        if not done or len(done) in self._marked("compact"):
            return
        batch, names = f"compact-{len(done):08d}", [c.split()[0] for c in LEDGER.split(", ")]
        self._write_ledger(self.ledger().where("not deleted").withColumn("batch_no", F.lit(len(done) - 1).cast("long")).select(*names), batch)
        totals = self.totals().select(*KEYS, F.col("n_docs").alias("d_docs"), F.col("n_tokens").alias("d_tokens"))
        totals.write.mode("overwrite").parquet(f"{self.root}/deltas/batch={batch}")
        self._mark("compact", len(done), batch)

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Commit changes(doc_id, source, lang, tokenizer, n_tokens, op) as the batch; False if it is there already.

        op is "upsert" (an insert, or a revised count, source or language) or "delete"; another one is an
        error. Rows without doc_id or tokenizer are left out. Of several rows of one document and tokenizer in a
        batch a delete wins, then the greatest count. A null count is 0. Deleting what isn't there changes
        nothing. Null sources and languages are keys of their own. An empty batch is committed as such.
        """
        if not batch or "/" in batch or batch.startswith("compact-"):
            raise ValueError("a batch needs an id without slashes that doesn't begin with compact-")
        done = self.committed()
        if batch in done:
            return False
        if not changes.where("op is null or op not in ('upsert', 'delete')").isEmpty():
            raise ValueError("op must be upsert or delete")
        rows = changes.where("doc_id is not null and tokenizer is not null").select("doc_id", "tokenizer", F.struct((F.col("op") == "delete").alias("deleted"), F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"), "source", "lang").alias("x"))
        new = rows.groupBy("doc_id", "tokenizer").agg(F.max("x").alias("x")).select("doc_id", "tokenizer", F.col("x.source").alias("source"), F.col("x.lang").alias("lang"), F.col("x.n_tokens").alias("n_tokens"), F.lit(len(done)).cast("long").alias("batch_no"), F.col("x.deleted").alias("deleted"))
        self._write_ledger(new.select(*[c.split()[0] for c in LEDGER.split(", ")]), batch)
        new = self.spark.read.schema(f"{LEDGER}, bucket int").parquet(f"{self.root}/ledger/batch={batch}")
        touched = [r[0] for r in new.select("bucket").distinct().collect()]
        old = self.ledger(touched).where("not deleted").join(new.select("doc_id", "tokenizer"), ["doc_id", "tokenizer"], "left_semi")
        signed = new.where("not deleted").select(*KEYS, F.lit(1).alias("d_docs"), F.col("n_tokens").alias("d_tokens")).unionByName(old.select(*KEYS, F.lit(-1).alias("d_docs"), (-F.col("n_tokens")).alias("d_tokens")))
        deltas = signed.groupBy(*KEYS).agg(F.sum("d_docs").cast("long").alias("d_docs"), F.sum("d_tokens").cast("long").alias("d_tokens")).where("d_docs <> 0 or d_tokens <> 0")
        deltas.write.mode("overwrite").parquet(f"{self.root}/deltas/batch={batch}")
        if not self._mark("markers", len(done), batch):
            raise RuntimeError(f"another batch was committed meanwhile; commit {batch!r} again")
        return True

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens of the keys that have documents."""
        deltas = self._read("deltas", f"{DELTAS}, batch string", self.committed())
        return deltas.groupBy(*KEYS).agg(F.sum("d_docs").alias("n_docs"), F.sum("d_tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    """Token totals of all documents by source, language and tokenizer version, kept by signed deltas.

    Batches: all documents with their counts of blank-separated words under "words_v1"; all documents with byte
    BPE counts under "byte_bpe_50k"; a revision of "words_v1" to counts of letter or digit runs ("words_v1" keeps its
    name, so the old counts leave); a delete of the documents without text; the revision once more, which does nothing.
    """
    import uuid

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    rollup = Rollup(spark, f"{shared_dir(spark)}/token-counts-{uuid.uuid4().hex}")
    as_changes = lambda df, name, op="upsert": df.withColumn("tokenizer", F.lit(name)).withColumn("op", F.lit(op))
    counted = lambda pattern: docs.select("doc_id", "source", "lang", F.regexp_count("text", F.lit(pattern)).cast("long").alias("n_tokens"))
    rollup.commit("words", as_changes(counted(r"\S+"), "words_v1"))
    rollup.commit("bpe", as_changes(count_tokens(docs), "byte_bpe_50k"))
    revised = as_changes(counted(r"[\p{L}\p{N}]+"), "words_v1")
    rollup.commit("words-revised", revised)
    empty = docs.where("text is null or text = ''").select("doc_id", "source", "lang", F.lit(0).cast("long").alias("n_tokens"))
    rollup.commit("no-text", as_changes(empty, "words_v1", "delete").unionByName(as_changes(empty, "byte_bpe_50k", "delete")))
    rollup.commit("words-revised", revised)
    return rollup.totals()

import os

import pytest

import corpus_pipeline
from jaglet.llm import langid
from jaglet.llm.queries import ORACLES, QUERIES
from tests.llm.helpers import frame
from tests.llm.test_dedup import brute_classes, brute_hits, brute_lines
from tests.test_queries import DATA, TABLES, rows

need = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@need
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, name):
    import duckdb

    df = QUERIES[name](spark, DATA)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    ref = con.execute(ORACLES[name])
    assert got == rows([c[0] for c in ref.description], ref.fetchall())


@need
def test_pipeline_against_plain_stages(spark):
    """Each stage on what the one before kept, by brute force; the language stage by its own model."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    held = [(r["doc_id"], r["text"]) for r in docs.collect()]
    gone = {r["doc_id"] for r in langid.identify(docs, langid.fit(docs)).where("lang_rejected").collect()}
    held = [x for x in held if x[0] not in gone]
    held = [(i, t) for i, t, _, gone in brute_lines(held) if not gone or t.strip()]
    keep = {i for i, _, c in brute_classes(held, 5, 80) if i == c}
    held = [x for x in held if x[0] in keep]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    clean = {i for i, n, h, _, _ in brute_hits(held, items) if not (h > 0 and 20 * h >= n)}
    out = corpus_pipeline.run(spark, DATA)
    assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} == clean and 0 < len(clean) < docs.count()
    fill = out.groupBy("sequence_id").sum("length").collect()
    assert max(r[1] for r in fill) <= 2048


def test_stages_keep_columns_and_bear_edges(spark, tmp_path):
    df = frame(spark, [(1, None), (2, ""), (3, "a b c d e f g h"), (4, "a b c d e f g h"), (None, "q w e")], "sequence_id")
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for table in (df, df.limit(0)):
        docs = table
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
            if name != "packing":
                assert docs.columns == df.columns
        docs.count()
    assert len(corpus_pipeline.STAGES) == 5


def test_language_stage_without_labels_keeps_texts_with_letters(spark, tmp_path):
    from pyspark.sql import functions as F

    df = frame(spark, [(1, None), (2, ""), (3, "a clean text"), (4, "12 ..."), (5, "çà")]).withColumn("lang", F.lit(None).cast("string"))
    out = corpus_pipeline.identify_language(spark, df, str(tmp_path))
    assert out.columns == df.columns and sorted(r["doc_id"] for r in out.collect()) == [3, 5]

"""Every registered query of the engine against its SQL on the smallest tables."""

import os

import pytest
from pyspark.sql import functions as F

from jaglet.plans.catalogue import ORACLES, QUERIES
from jaglet.streaming import running

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    import duckdb

    df = QUERIES[name](spark, DATA)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    ref = con.execute(ORACLES[name])
    columns = [c[0] for c in ref.description]
    assert sorted(columns) == sorted(df.columns)
    want = rows(columns, [tuple(float(v) if type(v).__name__ == "Decimal" else v for v in r) for r in ref.fetchall()])
    if "w_start" in columns:
        got, want = ([tuple(str(v).replace("+00:00", "") for v in r) for r in x] for x in (got, want))
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_sessions_of_files_whose_times_interleave(spark, tmp_path):
    """Files hours behind the newest row seen, and rows that join two sessions, all count."""
    import datetime

    day = datetime.datetime(2024, 1, 1)
    files = [[(1, 600), (1, 0), (2, 5)], [(1, 20), (2, 300), (1, 615)], [(1, 40), (2, 10), (1, 590), (2, 310)]]
    for k, part in enumerate(files):
        spark.createDataFrame([(u, day + datetime.timedelta(minutes=m)) for u, m in part], "user_id long, ts timestamp").coalesce(1).write.parquet(str(tmp_path / f"p{k}"))
        (f,) = (tmp_path / f"p{k}").glob("*.parquet")
        f.rename(tmp_path / f"events{k}.parquet")
        os.utime(tmp_path / f"events{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    whole = spark.read.parquet(f"{tmp_path}/events*.parquet")
    stream = running.read_files(spark, f"{tmp_path}/events*.parquet", like=whole)
    got = running.sessions(stream, "ts", "30 minutes", "user_id", n=F.count("*")).select("user_id", "w_start", "n").collect()
    minutes = sorted((r["user_id"], int((r["w_start"] - day).total_seconds()) // 60, r["n"]) for r in got)
    assert minutes == [(1, 0, 3), (1, 590, 3), (2, 5, 2), (2, 300, 2)]


def test_entry(spark):
    import __spark_entry__ as entry

    if os.path.isdir(DATA):
        assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_event_frame_is_written_once_and_again_when_it_is_gone(spark):
    import shutil

    from jaglet.plans import tables

    tables.frame(spark, DATA)
    held = dict(tables._written)
    assert tables.frame(spark, DATA).count() > 0 and tables._written == held
    key = next(k for k in held if k[1] == DATA)
    shutil.rmtree(held[key].removeprefix("file:"))
    assert tables.frame(spark, DATA).count() > 0 and tables._written[key] != held[key]

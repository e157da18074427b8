import os

import pytest
from pyspark.sql import functions as F

from jaglet.errors import CorruptFileError
from jaglet.frame import EventChain
from jaglet.operators import batches, jagged, sinks
from jaglet.schema import Bank
from jaglet.sources.paths import resolve
from tests.fixtures import PIDS, sample

P = "REC::Particle"


@pytest.fixture(scope="module")
def chain(spark):
    return sample(spark)


@pytest.fixture(scope="module", params=["frame", "lz4", "zstd+percolumn", "gzip+perbank"])
def any_chain(request, spark, chain, tmp_path_factory):
    if request.param == "frame":
        return chain
    path = str(tmp_path_factory.mktemp("c") / "out")
    chain.skim(path, format="eventrec", compression=request.param, record_events=3)
    return EventChain.open(spark, path)


def pids(df, name=P):
    return [[r["pid"] for r in row[name]] for row in df.orderBy("event_id").collect()]


def test_reads(any_chain):
    c = any_chain
    assert len(c) == 8 and list(c) == [P, "REC::Event"] and P in c and c.columns(P) == ["pid", "px", "cov"]
    assert pids(c.arrays(P, ["pid"])) == PIDS
    values, offsets, inner = c.numpy(P, "pid")
    assert values.tolist() == sum(PIDS, []) and offsets.tolist() == [0, 0, 1, 3, 6, 6, 7, 9, 12] and inner == 1
    assert c.numpy(P, "cov")[2] == 3 and c.numpy(P, "cov")[0][:3].tolist() == [100, 100.5, 100.25]
    assert c.keys(filter_name="*/p*") == [P, f"{P}/pid", f"{P}/px"] and c.typenames()[f"{P}/cov"] == "F#3"
    assert [r[0] for r in c[P, "pid"].orderBy("event_id").select("pid").collect()] == PIDS
    assert c["REC::Event/evno"].count() == 8 and c.tag_names["sidis"] == 1 and c.config == {"run": "42"}
    assert c.event(3)["event_tag"] == 1 and c.event(99) is None and len(list(c.events())) == 8


def test_small_reads(any_chain):
    c = any_chain
    assert [e["event_id"] for e in c.filtered(require=P).take(2)] == [1, 2] and c.scan_rate(P) > 0
    assert c.typed_column(P, "pid", "I").count() == 12 and [r["events"] for r in c.record_spans().orderBy("first").collect()] == [3, 3, 2]
    with pytest.raises(TypeError):
        c.typed_column(P, "pid", "F")
    a = c.arrays(P).orderBy("event_id")
    got = a.select(jagged.value(F.col(P), 1, "pid", "double").alias("v"), jagged.value_or(F.col(P), 5, "pid", -1).alias("d"), jagged.typed_rows(F.col(P), {"pid": "long", "none": "double"}, ["pid", "px"]).alias("t"), jagged.inner_total(F.col(P), "cov").alias("s")).collect()
    assert [r["v"] for r in got[:4]] == [None, None, 201.0, 301.0] and got[3]["d"] == -1 and got[2]["t"] == [(200, 0.0), (201, 0.0)] and got[1]["s"] == [300.75]


def test_filters(any_chain):
    c = any_chain
    ids = lambda x: [r[0] for r in x.event_tags().orderBy("event_id").collect()]
    assert ids(c.filtered(require=P)) == [1, 2, 3, 5, 6, 7]
    assert ids(c.filtered(event_tag=2)) == [1, 4, 7] and ids(c.filtered(event_tag="sidis")) == [1, 4, 7]
    assert ids(c.filtered(event_tag_any=["sidis", "elastic"], require=P)) == [1, 2, 5, 7]
    assert pids(c.filtered(require=P).arrays(P, ["pid"], entry_start=2, entry_stop=6)) == [PIDS[2], PIDS[3], PIDS[5]]
    with pytest.raises(KeyError):
        c.filtered(require="REC::None")
    assert ids(c.filtered(record_tag=0)) == list(range(8)) and ids(c.filtered(record_tag=5)) == []


def test_entries(any_chain):
    c = any_chain
    out = c.arrays(P, ["pid"], entries=[5, 3, 5, 99]).orderBy("pos").collect()
    assert [[r["pid"] for r in x[P]] for x in out] == [[500], [300, 301, 302], [500], []]
    for bad in ({"entries": [-1]}, {"entries": [1], "entry_start": 0}, {"entries": [1], "cut": "pid > 1"}):
        with pytest.raises(ValueError):
            c.arrays(P, ["pid"], **bad)
    with pytest.raises(ValueError):
        c.filtered(require=P).arrays(P, entries=[1])


def test_cuts(any_chain):
    c = any_chain
    assert pids(c.arrays(P, ["pid"], cut="px > 3.05")) == [[], [], [], [301, 302], [], [500], [600, 601], [700, 701, 702]]
    only = c.arrays(P, ["px"], cut="pid = 301").orderBy("event_id").collect()
    assert [len(r[P]) for r in only] == [0, 0, 0, 1, 0, 0, 0, 0] and only[3][P][0].asDict().keys() == {"px"}
    assert pids(c.arrays(P, ["pid"], cut="num() >= 2 and max(px) < 4")) == [PIDS[2], PIDS[3]]
    with pytest.raises(ValueError):
        c.arrays(None, cut="pid > 1")
    with pytest.raises(Exception):  # noqa: B017
        c.arrays(P, ["pid"], cut="sum(px)").count()


def test_nan_meets_no_cut(spark):
    df = spark.sql("SELECT 0L AS event_id, 0 AS file_index, 'm' AS file_path, 0 AS record_index, 0L AS record_tag, 0L AS event_tag, array(named_struct('x', float('NaN')), named_struct('x', 2f)) AS B")
    assert EventChain.from_frame(df).arrays("B", cut="x > 1").first()["B"] == [(2.0,)]


def test_selection_rules(chain):
    with pytest.raises(TypeError):
        chain.select(P, filter_name="*")
    with pytest.raises(TypeError):
        chain.select(None, ["pid"])
    with pytest.raises(KeyError):
        chain.select(P, ["nope"])
    with pytest.raises(KeyError):
        chain.select(["REC::None"])
    assert chain.select(filter_name="zzz").banks == {} and chain.select(P).single and not chain.select([P]).single and not chain.select("REC::P*").single


def test_occupancy_and_pandas(any_chain):
    rows = {r["bank"]: (r["events"], r["rows"], r["max_rows"], r["scanned"]) for r in any_chain.occupancy().collect()}
    assert rows == {P: (6, 12, 3, 8), "REC::Event": (8, 8, 1, 8)}
    pdf = any_chain.to_pandas(P, ["pid"])
    assert pdf.attrs["num_entries"] == 8 and pdf.loc[(3, 1), "pid"] == 301 and len(pdf) == 12


def test_empty_present_bank_counts_as_present(spark):
    df = spark.sql("SELECT id AS event_id, 0 AS file_index, 'm' AS file_path, 0 AS record_index, 0L AS record_tag, 0L AS event_tag, CAST(array() AS array<struct<q:int>>) AS Empty, CAST(NULL AS array<struct<z:int>>) AS Never FROM range(3)")
    c = EventChain.from_frame(df)
    assert c.filtered(require="Empty").event_tags().count() == 3 and c.filtered(require="Never").event_tags().count() == 0
    assert {r["bank"]: (r["events"], r["rows"]) for r in c.occupancy().collect()} == {"Empty": (0, 0), "Never": (0, 0)}


def test_batches_and_folds(any_chain):
    c = any_chain
    assert [(k.start, k.stop) for _, k in c.iterate(4, P, ["pid"])] == [(0, 3), (3, 6), (6, 8)]
    assert c.map_reduce(lambda t: [t.column("event_id").to_pylist()], lambda a, b: a + b, 3, P) == [[0, 1, 2], [3, 4, 5], [6, 7]]
    with pytest.raises(ValueError):
        c.map_reduce(lambda t: 1, lambda a, b: a + b, 3, P, entry_start=50)
    assert c.map_reduce(lambda t: 1, lambda a, b: a + b, 3, P, entry_start=50, initial=0) == 0
    assert c.par_fold(lambda: 0, lambda a, e: a + len(e[P]), lambda a, b: a + b, P, ["pid"]) == 12
    assert c.fold([], lambda a, e: [*a, e["event_id"]], "REC::Event") == list(range(8))
    assert c.for_each(lambda e: None, P)["events_yielded"] == 8


def test_writes(spark, chain, tmp_path):
    path = str(tmp_path / "frame")
    s = chain.filtered(require=P).skim(path)
    back = sinks.read_frame(spark, path)
    assert s.events == 6 and back.tag_names == chain.tag_names and back.dictionary.to_text() == chain.dictionary.to_text() and back.config == {"run": "42"}
    with pytest.raises(Exception):  # noqa: B017
        chain.skim(path)
    s = chain.skim_banks(str(tmp_path / "banks"), "REC::E*")
    assert s.kept == ("REC::Event",) and s.dropped_structures == 6
    tagged = str(tmp_path / "tagged")
    chain.skim(tagged, tags=F.col("event_id") * 2)
    assert [r[0] for r in sinks.read_frame(spark, tagged).event_tags().orderBy("event_id").select("event_tag").collect()] == list(range(0, 16, 2)) and sinks.read_frame(spark, tagged).tag_names == {}
    with pytest.raises(ValueError):
        chain.skim(str(tmp_path / "bad"), tags=F.lit(-1))
    flat = str(tmp_path / "flat")
    chain.to_parquet(flat, P, ["pid", "px"])
    assert spark.read.parquet(flat).columns == ["pid", "px"]
    chain.to_parquet(flat, [P], mode="overwrite")
    assert spark.read.parquet(flat).columns == [f"{P}/pid", f"{P}/px", f"{P}/cov"]


def test_retag_and_decorate(spark, chain):
    up = spark.createDataFrame([(1, 99), (7, 0)], "event_id long, event_tag long")
    assert [r[1] for r in chain.retagged(up).event_tags().orderBy("event_id").collect()] == [1, 99, 4, 1, 2, 4, 1, 0]
    for bad in ([(1, -1)], [(99, 1)], [(1, 1), (1, 2)], [(1, 1 << 32)]):
        with pytest.raises(ValueError):
            chain.retagged(spark.createDataFrame(bad, "event_id long, event_tag long"))
    bank = Bank.parse("{My::Bank/500/1}{n/L}")
    new = chain.arrays(P, ["pid"]).select("event_id", F.size(P).cast("long").alias("n"))
    assert [r[0] for r in chain.decorated(bank, new)["My::Bank", "n"].orderBy("event_id").select("n").collect()] == [[0], [1], [2], [3]] * 2
    with pytest.raises(ValueError):
        chain.decorated(bank, new.where("event_id < 7"))


def test_union_of_chains(spark, chain):
    two = EventChain.concat([chain, chain])
    assert two.num_entries == 16 and pids(two.arrays(P, ["pid"])) == PIDS * 2


def test_source_errors_and_pushdown(spark, chain, tmp_path):
    path = str(tmp_path / "c")
    tagged = chain._with(_df=chain._df.withColumn("record_tag", F.col("record_index").cast("long")))
    sinks.write(tagged._df, path, format="eventrec", dictionary=chain.dictionary, compression="none")
    c = EventChain.open(spark, path)
    assert [r.events for r in c.records()] == [3, 3, 2]
    assert [r[0] for r in c.filtered(record_tag=[1]).event_tags().orderBy("event_id").collect()] == [3, 4, 5]
    assert c._df.where("event_id >= 6").count() == 2 and c._df.where("event_id = 4").count() == 1 and c._df.count() == 8
    assert c.arrays(P, entry_start=6).rdd.getNumPartitions() == 1 and c.arrays(P, entry_start=6).count() == 2 and c.for_ranges([(7, 9), (0, 1)], P).count() == 2
    with pytest.raises(Exception):  # noqa: B017
        sinks.write(tagged._df, path, format="eventrec", dictionary=chain.dictionary)
    sinks.write(tagged._df, path, format="eventrec", dictionary=chain.dictionary, mode="overwrite")
    file = resolve(path)[0]
    raw = bytearray(open(file, "rb").read())
    raw[20] = 99
    open(file, "wb").write(raw)
    with pytest.raises(Exception):  # noqa: B017
        EventChain.open(spark, path)
    open(file, "wb").write(b"short")
    with pytest.raises(CorruptFileError):
        EventChain.open(spark, path)


def test_files_stay_small(spark, chain, tmp_path):
    path = str(tmp_path / "many")
    many = spark.range(400).withColumnRenamed("id", "k").join(chain._df).withColumn("event_id", F.col("k") * 8 + F.col("event_id")).drop("k")
    sinks.write(many.coalesce(1).sortWithinPartitions("event_id"), path, format="eventrec", dictionary=chain.dictionary, compression="none", record_events=100, file_bytes=60_000)
    c = EventChain.open(spark, path)
    assert len(c.files) >= 3 and c.num_entries == 3200 and pids(c.arrays(P, ["pid"])) == PIDS * 400
    none = str(tmp_path / "none")
    chain.filtered(event_tag=77).skim(none, format="eventrec")
    assert len(EventChain.open(spark, none)) == 0 and EventChain.open(spark, none).arrays(P).count() == 0


def test_paths(tmp_path):
    for n in ("b.hipo", "a.HIPO", "x.txt"):
        (tmp_path / n).write_bytes(b"")
    (tmp_path / "sub").mkdir()
    assert [os.path.basename(p) for p in resolve(tmp_path)] == ["a.HIPO", "b.hipo"]
    assert resolve(str(tmp_path / "*.none")) == [] and resolve(["z", "y"]) == ["z", "y"]
    with pytest.raises(FileNotFoundError):
        resolve(tmp_path / "none.hipo")


def test_composite_source(spark, tmp_path):
    from tests.test_container import written

    (tmp_path / "c.hipo").write_bytes(written("zstd+percolumn"))
    c = EventChain.open(spark, tmp_path / "c.hipo")
    rows = c.composite("700/5", 2, 5).orderBy("event_id").collect()
    assert [r[0] for r in rows] == [2, 3, 4] and rows[0][1] == [(10, 1.5), (20, 2.5)]
    with pytest.raises(Exception):  # noqa: B017
        c.composite("REC::Event")


def test_chunks_meet_events_by_equality(spark):
    """Chunks of uneven length with holes between them; no plan compares every event with every chunk."""
    cuts = [(0, 3), (3, 4), (4, 40), (60, 61), (61, 1000)]
    chunks = [batches.Chunk(k, a, b, "f") for k, (a, b) in enumerate(cuts)]
    out = batches.chunked(spark.range(0, 1100).withColumnRenamed("id", "event_id"), chunks)
    assert {(r["event_id"], r["chunk"]) for r in out.collect()} == {(e, k) for k, (a, b) in enumerate(cuts) for e in range(a, b)}
    plan = out._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert batches.chunked(spark.range(5).withColumnRenamed("id", "event_id"), []).count() == 0


def test_chunks_in_flight_keep_their_order(spark, chain):
    alone = [(c.start, c.stop, t.column("event_id").to_pylist()) for t, c in chain.iterate(3, P, ["pid"])]
    assert alone == [(c.start, c.stop, t.column("event_id").to_pylist()) for t, c in chain.iterate(3, P, ["pid"], ahead=2)]
    assert [e for _, _, ids in alone for e in ids] == list(range(8))
    assert next(iter(chain.iterate(3, P, ["pid"], ahead=1)))[1].start == 0  # what is in flight is let go


def test_summaries_and_statistics(spark, chain, tmp_path):
    calls = []
    done = chain.skim(str(tmp_path / "c"), format="eventrec", progress=lambda n, of: calls.append((n, of)))
    c = EventChain.open(spark, str(tmp_path / "c"))
    assert (done.events, done.files, done.records) == (8, len(c.files), len(c.records())) and done.bytes == sum(os.path.getsize(f) for f in c.files)
    assert calls and calls[-1][0] == calls[-1][1] > 0
    assert chain.skim(str(tmp_path / "p")).bytes > 0
    stats = c.for_each(lambda e: None, P)
    assert (stats["events_in"], stats["events_yielded"], stats["records"], stats["files"]) == (8, 8, done.records, done.files) and stats["elapsed"] > 0
    sizes = {(r[0], r[1]): r[2] for r in c.record_decompressed_sizes().collect()}
    plain = EventChain.open(spark, str(tmp_path / "c"))
    assert len(sizes) == len(plain.records()) and min(sizes.values()) > 0
    with pytest.raises(ValueError):
        chain.record_decompressed_sizes()


def test_event_accessors(chain):
    e = chain.event(3)
    assert e.tag == e["event_tag"] and e.size(P) == len(e.bank(P)) and e.has(P) and P in e.structures()
    assert e.column(P, "pid") == [r["pid"] for r in e[P]]
    with pytest.raises(KeyError):
        e.bank("No::Bank")
    lacking = next(x for x in chain.events() if any(v is None for v in x.values()))
    none = next(n for n, v in lacking.items() if v is None)
    view = chain.event(lacking["event_id"])
    assert not view.has(none) and view.size(none) == 0
    with pytest.raises(LookupError):
        view.bank(none)
    assert len(chain.show(1).splitlines()) == 2 and "more" in chain.show(1) and "more" not in chain.show(None)


def test_salvage_of_damaged_files(spark, chain, tmp_path):
    """Bytes lost, garbled and put in between records: all records that are whole come back."""
    path = str(tmp_path / "c")
    many = spark.range(50).withColumnRenamed("id", "k").join(chain._df).withColumn("event_id", F.col("k") * 8 + F.col("event_id")).drop("k")
    sinks.write(many.coalesce(1).sortWithinPartitions("event_id"), path, format="eventrec", dictionary=chain.dictionary, record_events=40)
    file = resolve(path)[0]
    spans = EventChain.open(spark, path).infos[0].spans
    assert len(spans) == 10
    raw = bytearray(open(file, "rb").read())
    raw[spans[2].position + 28] ^= 0xFF  # the magic word of the third record
    raw[spans[5].position + 70] ^= 0xFF  # the body of the sixth
    raw[spans[7].position : spans[7].position] = b"\0" * 4 + b"\xff" * 40
    open(file, "wb").write(raw[:-60])
    c = EventChain.open(spark, path, salvage=True)
    assert c.num_entries == 40 * (9 if len(c.infos[0].spans) == 9 else 8)
    assert c.arrays(P, ["pid"]).count() == c.num_entries and pids(c.arrays(P, ["pid"]))[:80] == (PIDS * 10)[:80]

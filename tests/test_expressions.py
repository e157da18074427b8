import math

import pytest
from pyspark.sql import functions as F

from jaglet.functions import kinematics as K
from jaglet.functions import pdg
from jaglet.operators import hist, jagged, link

CALO = "array<struct<pindex:int,layer:int,energy:double>>"


def one(df):
    return df.first().asDict(recursive=True)


def linked(spark):
    rows = [(0, [(1.0,), (2.0,)], [(1, 1, 0.5), (0, 1, 0.3), (0, 4, 0.7)]), (1, [(3.0,)], []), (2, [(4.0,), (5.0,), (6.0,)], [(2, 1, 0.9), (9, 1, 99.0)]), (3, [(7.0,)], None), (4, None, [(0, 1, 1.0)])]
    return spark.createDataFrame(rows, f"event_id long, P array<struct<px:double>>, D {CALO}")


def test_group_by_index(spark):
    df = linked(spark).select("event_id", link.group_by_index(F.col("D"), F.size("P")).alias("g")).orderBy("event_id")
    got = [[[r["energy"] for r in p] for p in row["g"]] for row in df.collect()]
    assert got == [[[0.3, 0.7], [0.5]], [[]], [[], [], [0.9]], [[]], []]


def test_link_both_ways(spark):
    df = link.link(linked(spark), "P", ["D"], {"P": ["px"], "D": ["pindex", "layer", "energy"]}).orderBy("event_id").collect()
    assert [[r["particle"] and r["particle"]["px"] for r in row["D"] or []] for row in df] == [[2.0, 1.0, 1.0], [], [6.0, None], [], [None]]
    assert [[len(p["D"]) for p in row["P"] or []] for row in df] == [[2, 1], [0], [0, 0, 1], [0], []]
    with pytest.raises(ValueError):
        link.link(linked(spark), "P", ["D"], {"P": ["px"], "D": ["pindex"]}, directions="sideways")


def test_nested_equals_flat(spark):
    df = linked(spark)
    nested = df.select("event_id", F.posexplode(link.group_by_index(F.col("D"), F.size("P"))).alias("i", "g")).select("event_id", "i", jagged.total(F.col("g.energy")).alias("e"))
    p = jagged.flat(df, "P", ["px"])
    d = jagged.flat(df, "D", ["pindex", "energy"]).withColumnRenamed("row_idx", "k")
    flat = p.join(d, (p.event_id == d.event_id) & (p.row_idx == d.pindex), "left").groupBy(p.event_id, p.row_idx).agg(F.coalesce(F.sum("energy"), F.lit(0.0)).alias("e"))
    assert sorted(map(tuple, nested.collect())) == sorted((a, b, e) for a, b, e in flat.collect())
    back = jagged.nest(p, "P", ["px"], df).orderBy("event_id").collect()
    assert [[r["px"] for r in x["P"]] for x in back] == [[1.0, 2.0], [3.0], [4.0, 5.0, 6.0], [7.0], []]


def test_reductions(spark):
    df = spark.createDataFrame([([3.0, 1.0, 3.0],), ([],), (None,), ([float("nan"), 2.0],)], "x array<double>")
    s = df.select(jagged.total(F.col("x")).alias("t"), jagged.mean(F.col("x")).alias("m"), jagged.first(F.col("x")).alias("f"), jagged.leading(F.col("x"), lambda v: v).alias("l"), jagged.any_row(F.col("x"), lambda v: v > 2).alias("a"), F.size(jagged.pairs(F.col("x"), lambda a, b: F.struct(a["i"], b["i"]))).alias("n")).collect()
    assert s[0]["t"] == 7 and s[1]["t"] == 0 and s[2]["t"] == 0 and s[1]["m"] is None and s[1]["f"] is None
    assert (s[0]["l"]["i"], s[0]["l"]["key"]) == (0, 3.0) and s[1]["l"] is None and s[2]["l"] is None and s[3]["l"]["key"] == 2.0
    assert [r["a"] for r in s[:3]] == [True, False, False] and s[0]["n"] == 3


def test_pruned_reads(spark, tmp_path):
    linked(spark).write.parquet(str(tmp_path / "p"))
    df = spark.read.parquet(str(tmp_path / "p"))
    plan = df.select(jagged.rows("D", ["energy"]))._jdf.queryExecution().toString()
    assert "ReadSchema: struct<D:array<struct<energy:double>>>" in plan
    plan = df.select(jagged.counts("D", "layer"))._jdf.queryExecution().toString()
    assert "ReadSchema: struct<D:array<struct<layer:int>>>" in plan


def test_pdg(spark):
    df = spark.createDataFrame([(11,), (-211,), (45,), (0,), (None,)], "c int")
    got = [tuple(r) for r in df.select(pdg.pdg_mass(F.col("c")), pdg.pdg_name(F.col("c")), pdg.pdg_mass(F.col("c"), "MeV", -1.0)).collect()]
    assert got[0][0] == pdg.MASS_GEV[11] and got[1][1] == "pi-" and got[2][1] == "D2" and math.isnan(got[3][0]) and got[3][2] == -1 and got[4][1] == "?"
    assert got[1][2] == pytest.approx(139.57039)
    pdg.MASS_GEV[0] = 5.0
    try:
        assert df.where("c = 0").select(pdg.pdg_mass(F.col("c"))).first()[0] == 5.0
    finally:
        del pdg.MASS_GEV[0]
    assert spark.range(1).select(pdg.pdg_masses(F.array(F.lit(22), F.lit(2212)))).first()[0] == [0.0, pdg.MASS_GEV[2212]]
    with pytest.raises(ValueError):
        pdg.pdg_mass(F.lit(1), "keV")


def test_vectors(spark):
    row = spark.range(1).select(F.struct(F.lit(1.0).alias("px"), F.lit(2.0).alias("py"), F.lit(2.0).alias("pz")).alias("r"))
    r = F.col("r")
    v, w = K.to_vector(r, F.lit(4.0)), K.to_vector(r)
    got = row.select(v.p, v.energy, v.mass, v.pt, v.eta, (v + v).mass, K.delta_r(v, v), K.delta_phi(F.lit(3.0), F.lit(-3.0)), v.dot(v)).first()
    assert got[0] == 3 and got[1] == 5 and got[2] == 4 and got[3] == pytest.approx(5**0.5) and got[4] == pytest.approx(math.asinh(2 / 5**0.5)) and got[5] == pytest.approx(8) and got[6] == 0 and got[7] == pytest.approx(6 - 2 * math.pi) and got[8] == pytest.approx(16)
    with pytest.raises(ValueError):
        w.mass  # noqa: B018
    with pytest.raises(ValueError):
        K.to_vector(r, F.lit(1.0), fields=("px", "E"))


def test_histogram_edges(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 0.999, 1.0, 4.0, 4.0001, -0.1, float("nan"), None)], "x double")
    got = {r["bin"]: r["n"] for r in hist.histogram(df, F.col("x"), 4, 0.0, 4.0).collect()}
    assert got == {0: 2, 1: 1, 3: 1}
    assert {(r["xbin"], r["ybin"]): r["n"] for r in hist.histogram2d(df, F.col("x"), F.col("x"), (2, 4), (0.0, 4.0), (0.0, 4.0)).collect()} == {(0, 0): 2, (0, 1): 1, (1, 3): 1}
    flow = hist.cutflow(df, {"in": F.col("x") >= 0, "small": F.col("x") < 1}).orderBy("step").collect()
    assert [(r["name"], r["n"]) for r in flow] == [("in", 6), ("small", 2)]
    with pytest.raises(ValueError):
        hist.bin_index(F.lit(1.0), 0, 0, 1)


def test_fixture_checksums(spark):
    """The published sums of the benchmark fixture, from its generation rules."""
    e = spark.range(200_000).select(F.col("id").alias("e"), F.explode(F.sequence(F.lit(0), (F.col("id") % 5).cast("int"))).alias("k"))
    p = e.select("k", (11 + (F.col("e") + F.col("k")) % 7).alias("pid"), (F.col("e").cast("float") * F.lit(0.001).cast("float") + F.col("k").cast("float")).cast("double").alias("px"))
    got = p.agg(F.sum("pid"), F.sum(F.col("pid") + F.col("px"))).first()
    assert got[0] == 8_400_000 and got[1] == pytest.approx(69200102.851, abs=1e-3)


def test_links_of_a_large_event(spark):
    """As many rows as would show a cost by particles times rows; indices out of order, absent and out of range."""
    n = 3000
    rows = [(0, [(float(i),) for i in range(n)], [((7 * i) % (n + 5) - 2, 1, float(i)) for i in range(n)])]
    df = spark.createDataFrame(rows, f"event_id long, P array<struct<px:double>>, D {CALO}")
    got = one(link.link(df, "P", ["D"], {"P": ["px"], "D": ["pindex", "layer", "energy"]}))
    for p, particle in enumerate(got["P"]):
        assert [r["energy"] for r in particle["D"]] == [d[2] for d in rows[0][2] if d[0] == p]
    assert [r["particle"] and r["particle"]["px"] for r in got["D"]] == [float(d[0]) if 0 <= d[0] < n else None for d in rows[0][2]]


def test_sidis_fiducial_and_corrections(spark):
    df = spark.createDataFrame([((0.3, 0.1, 4.0), (0.2, -0.4, 2.0), [(1, 0.5, 1.0, 2.0), (2, 1.0, 0.0, 0.0)]), ((0.3, 0.1, 4.0), None, [])], "e struct<px:double,py:double,pz:double>, h struct<px:double,py:double,pz:double>, P array<struct<pid:int,px:double,py:double,pz:double>>")
    k = K.sidis(K.to_vector(F.col("e"), F.lit(0.0)), K.to_vector(F.col("h"), F.lit(0.139)), 10.6)
    got = df.select(k["z"].alias("z"), k["pt"].alias("pt")).collect()
    e, h, q = (0.3, 0.1, 4.0), (0.2, -0.4, 2.0), (-0.3, -0.1, 6.6)
    norm = lambda v: math.sqrt(sum(x * x for x in v))
    along = sum(a * b for a, b in zip(h, q, strict=True)) / norm(q)
    assert got[0]["z"] == pytest.approx(math.sqrt(norm(h) ** 2 + 0.139**2) / (10.6 - norm(e))) and got[0]["pt"] == pytest.approx(math.sqrt(norm(h) ** 2 - along**2))
    assert got[1]["z"] is None and got[1]["pt"] is None
    assert [r[0] for r in df.select(K.fiducial(F.col("h"), {"pz": 1.0}, {"px": 0.3})).collect()] == [True, False]
    fixed = df.select(K.corrected(F.col("P"), ["pid", "px", "py", "pz"], lambda r: F.when(r["pid"] == 1, 2.0).otherwise(1.0)).alias("P")).first()["P"]
    assert [tuple(r) for r in fixed] == [(1, 1.0, 2.0, 4.0), (2, 1.0, 0.0, 0.0)]


def test_named_tags():
    from jaglet.tags import tag_flags

    Trigger = tag_flags("Trigger", Fcup=0, Random=1)
    assert (Trigger.Fcup | Trigger.Random) == 3 and Trigger.NAMES == (("Fcup", 0), ("Random", 1)) and Trigger.name_of(1) == "Random" and Trigger.name_of(5) is None
    assert Trigger.registry().mask("Random") == Trigger.Random

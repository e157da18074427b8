"""The registered queries of the engine, one or more for each operator, with the SQL that gives the same rows."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jaglet.functions import kinematics as K
from jaglet.functions.pdg import pdg_mass, pdg_name
from jaglet.frame import EventChain
from jaglet.operators import hist, jagged, link, sinks
from jaglet.operators.batches import chunked
from jaglet.plans import tables
from jaglet.plans.tables import SQL, chain, events, flat, table
from jaglet.schema import Bank
from jaglet.session import prepare, shared_dir
from jaglet.streaming import running
from jaglet.tags import all_bits, any_bit, bit_indices

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
BEAM = 60.0


def query(sql: str | None, model: bool = True):
    """Register a query under its function's name; with model, sql leans on the model's ev and part."""

    def keep(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        QUERIES[fn.__name__] = run
        if sql is not None:
            body = sql.strip()
            ORACLES[fn.__name__] = body if not model else SQL.rstrip() + (",\n" + body[5:] if body.startswith("WITH ") else "\n" + body)
        return fn

    return keep


def temp(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def pt(r: Column) -> Column:
    return F.sqrt(r["px"] * r["px"] + r["py"] * r["py"])


def _longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


# ---- flagship and selections


@query("""SELECT event_id, count(*) AS n_kept, round(sum(sqrt(px * px + py * py)), 4) AS sum_pt, round(max(sqrt(px * px + py * py)), 6) AS lead_pt, arg_max(row_idx, row(sqrt(px * px + py * py), -row_idx)) AS lead_row
FROM part WHERE pid IN (11, 211) GROUP BY 1""")
def leading_particle(spark, d):
    """Per event: how many electrons and pions, their summed and leading transverse momentum, the leading row."""
    df = chain(spark, d, "Particle")._events({"Particle": ["pid", "px", "py"]})
    kept = F.filter(jagged.indexed(jagged.rows("Particle", ["pid", "px", "py"])), lambda s: s["row"]["pid"].isin(11, 211))
    keyed = df.select("event_id", F.transform(kept, lambda s: F.struct(pt(s["row"]).alias("pt"), (-s["i"]).alias("back"))).alias("k")).where(F.size("k") > 0)
    best = F.array_max("k")
    return keyed.select("event_id", F.size("k").cast("long").alias("n_kept"), F.round(jagged.total(F.col("k.pt")), 4).alias("sum_pt"), F.round(best["pt"], 6).alias("lead_pt"), (-best["back"]).cast("long").alias("lead_row"))


@query("SELECT event_id, row_idx, pid, px FROM part")
def proj_columns(spark, d):
    return _longs(chain(spark, d, "Particle").flat("Particle", ["pid", "px"]), "pid")


@query("SELECT event_id FROM ev WHERE event_id IN (SELECT event_id FROM part)")
def filter_require(spark, d):
    return chain(spark, d).filtered(require="Particle").event_tags().select("event_id")


@query("SELECT event_id, record_tag FROM ev WHERE record_tag IN (1, 3, 5)")
def filter_record_tag(spark, d):
    return chain(spark, d, "Particle").filtered(record_tag=[1, 3, 5])._events({}).select("event_id", "record_tag")


@query("SELECT event_id, event_tag FROM ev WHERE event_tag IN (33, 66)")
def filter_event_tag(spark, d):
    return chain(spark, d, "Particle").filtered(event_tag=[33, 66]).event_tags()


@query("SELECT event_id, event_tag FROM ev WHERE (event_tag & 130) <> 0")
def filter_event_tag_any(spark, d):
    return chain(spark, d, "Particle").filtered(event_tag_any=["high", "partial"]).event_tags()


@query("SELECT event_id, event_tag FROM ev WHERE record_tag IN (2, 3) AND (event_tag & 96) <> 0 AND event_id IN (SELECT event_id FROM part)")
def filter_chain_narrow(spark, d):
    c = chain(spark, d).filtered(record_tag=[1, 2, 3]).filtered(record_tag=[2, 3, 9], require="Calo").filtered(event_tag_any=["fulfilled", "open"], require=["Particle"])
    return c.event_tags()


@query("SELECT event_id, row_idx, pid FROM part WHERE event_id >= 100 AND event_id < 900")
def entry_range(spark, d):
    return _longs(chain(spark, d, "Particle").flat("Particle", ["pid"], start=100, stop=900), "pid")


@query("SELECT ev.event_id, count(part.event_id) AS n FROM ev LEFT JOIN part USING (event_id) WHERE ev.event_id BETWEEN 10 AND 59 OR ev.event_id BETWEEN 500 AND 519 GROUP BY 1")
def entry_ranges_merge(spark, d):
    df = chain(spark, d, "Particle").for_ranges([(40, 60), (10, 50), (500, 520), (7, 7)], "Particle", ["pid"])
    return df.select("event_id", F.size("Particle").cast("long").alias("n"))


@query("""WITH e AS (SELECT * FROM (VALUES (0, 5), (1, 3), (2, 5), (3, 100000000), (4, 7)) t(pos, event_id))
SELECT CAST(e.pos AS BIGINT) AS pos, CAST(e.event_id AS BIGINT) AS event_id, count(part.event_id) AS n, coalesce(sum(pid), 0)::BIGINT AS sum_pid FROM e LEFT JOIN part ON part.event_id = e.event_id GROUP BY 1, 2""")
def entries_gather(spark, d):
    df = chain(spark, d, "Particle").arrays("Particle", ["pid"], entries=[5, 3, 5, 100_000_000, 7])
    return df.select("pos", "event_id", F.size("Particle").cast("long").alias("n"), jagged.total(F.col("Particle.pid")).cast("long").alias("sum_pid"))


@query("SELECT ev.event_id, count(part.event_id) AS n, coalesce(sum(px), 0) AS sum_px FROM ev LEFT JOIN part ON part.event_id = ev.event_id AND pid = 11 AND px > 10 GROUP BY 1")
def cut_rows(spark, d):
    df = chain(spark, d, "Particle").arrays("Particle", cut="pid = 11 and px > 10")
    return df.select("event_id", F.size("Particle").cast("long").alias("n"), jagged.total(F.col("Particle.px")).alias("sum_px"))


@query("SELECT event_id, count(*) AS n FROM part GROUP BY 1 HAVING count_if(pid = 11) > 0 AND count(*) >= 3")
def cut_events(spark, d):
    df = chain(spark, d, "Particle").arrays("Particle", ["px"], cut="any(pid = 11) and num() >= 3")
    return df.select("event_id", F.size("Particle").cast("long").alias("n"))


@query("SELECT event_id, px, count(*) AS n FROM part WHERE status < 0 GROUP BY 1, 2")
def cut_then_drop(spark, d):
    df = chain(spark, d, "Particle").arrays("Particle", ["px"], cut="status < 0")
    return df.select("event_id", F.explode("Particle.px").alias("px")).groupBy("event_id", "px").agg(F.count("*").alias("n"))


@query("SELECT event_id, event_tag FROM ev")
def event_tags(spark, d):
    return chain(spark, d, "Particle").event_tags()


@query("SELECT ev.event_id, ev.event_tag, count(part.event_id) AS n FROM ev LEFT JOIN part USING (event_id) WHERE event_id = 123 GROUP BY 1, 2")
def point_lookup(spark, d):
    e = chain(spark, d, "Particle").event(123)
    return spark.createDataFrame([(e["event_id"], e.tag, e.size("Particle"))] if e else [], "event_id long, event_tag long, n long")


@query("SELECT event_id, row_idx, px, energy FROM part")
def filter_name_glob(spark, d):
    """Columns by glob over bank/column; banks of one event line up by place."""
    df = chain(spark, d).arrays(filter_name=["*/px", "Calo/e*"])
    zipped = df.select("event_id", F.posexplode(F.arrays_zip(F.col("Particle.px"), F.col("Calo.energy"))).alias("row_idx", "r"))
    return zipped.select("event_id", F.col("row_idx").cast("long").alias("row_idx"), F.col("r.px").alias("px"), F.col("r.energy").alias("energy"))


# ---- reductions


@query("""SELECT b.bank, count(DISTINCT part.event_id) AS events, count(part.event_id) AS rows, (SELECT max(c) FROM (SELECT count(*) AS c FROM part GROUP BY event_id)) AS max_rows, (SELECT count(*) FROM ev) AS scanned
FROM part CROSS JOIN (VALUES ('Calo'), ('Particle')) b(bank) GROUP BY 1""")
def occupancy(spark, d):
    return _longs(chain(spark, d).occupancy(), "events", "rows", "max_rows")


@query("""WITH f AS (SELECT ev.event_id, count(part.event_id) >= 1 AS a, count_if(pid = 11) >= 1 AS b, sum(px) > 60 AS c FROM ev LEFT JOIN part USING (event_id) GROUP BY 1)
SELECT 0::BIGINT AS step, 'rows' AS name, count_if(a)::BIGINT AS n FROM f UNION ALL SELECT 1, 'electron', count_if(a AND b)::BIGINT FROM f UNION ALL SELECT 2, 'momentum', count_if(a AND b AND coalesce(c, false))::BIGINT FROM f""")
def cutflow(spark, d):
    df = chain(spark, d, "Particle").arrays("Particle", ["pid", "px"])
    p = F.col("Particle")
    return hist.cutflow(df, {"rows": F.size(p) >= 1, "electron": jagged.any_row(p, lambda r: r["pid"] == 11), "momentum": jagged.total(F.col("Particle.px")) > 60})


@query("SELECT ev.event_id, coalesce(min_by(pid, row_idx), -1) AS pid, coalesce(min_by(px, row_idx), -1) AS px FROM ev LEFT JOIN part USING (event_id) GROUP BY 1")
def firsts(spark, d):
    df = chain(spark, d, "Particle").arrays("Particle", ["pid", "px"])
    lead = jagged.first(F.col("Particle"))
    return df.select("event_id", F.coalesce(lead["pid"].cast("long"), F.lit(-1)).alias("pid"), F.coalesce(lead["px"], F.lit(-1.0)).alias("px"))


@query("SELECT event_id, arg_max(row_idx, row(energy, -row_idx)) AS row_idx, max(energy) AS energy, arg_max(layer, row(energy, -row_idx)) AS layer FROM part GROUP BY 1")
def leading_argmax(spark, d):
    df = chain(spark, d, "Calo").arrays("Calo", ["energy", "layer"])
    best = jagged.leading(F.col("Calo"), lambda r: r["energy"])
    return df.select("event_id", best.alias("b")).where("b is not null").select("event_id", F.col("b.i").cast("long").alias("row_idx"), F.col("b.key").alias("energy"), F.col("b.row.layer").cast("long").alias("layer"))


@query("""SELECT ev.event_id, count(part.event_id) AS n, coalesce(sum(px), 0) AS sum_px, max(px) AS max_px, min(pz) AS min_pz, count_if(coalesce(pid = 22, false))::BIGINT AS photons, coalesce(bool_and(px > 5), true) AS all_fast, round(avg(px), 6) AS mean_px
FROM ev LEFT JOIN part USING (event_id) GROUP BY 1""")
def per_event_reductions(spark, d):
    df = chain(spark, d, "Particle").arrays("Particle", ["pid", "px", "pz"])
    p, px = F.col("Particle"), F.col("Particle.px")
    return df.select("event_id", F.size(p).cast("long").alias("n"), jagged.total(px).alias("sum_px"), F.array_max(px).alias("max_px"), F.array_min(F.col("Particle.pz")).alias("min_pz"), F.size(jagged.keep_rows(p, lambda r: r["pid"] == 22)).cast("long").alias("photons"), jagged.all_rows(p, lambda r: r["px"] > 5).alias("all_fast"), F.round(jagged.mean(px), 6).alias("mean_px"))


@query("SELECT pid AS value, count(*) AS n FROM part GROUP BY 1")
def unique_counts(spark, d):
    return _longs(hist.unique_counts(flat(spark, d), F.col("pid")), "value")


@query("SELECT count(*) AS n, sum(px) AS sum_px, round(avg(energy), 4) AS mean_energy, max(energy) AS max_energy FROM part")
def flatten_stats(spark, d):
    return flat(spark, d).agg(F.count("*").alias("n"), F.sum("px").alias("sum_px"), F.round(F.avg("energy"), 4).alias("mean_energy"), F.max("energy").alias("max_energy"))


@query("SELECT CAST(least(floor((px - 0) * (25 / 50.0)), 24) AS BIGINT) AS bin, count(*) AS n FROM part WHERE px >= 0 AND px <= 50 GROUP BY 1")
def hist1d(spark, d):
    return hist.histogram(flat(spark, d), F.col("px"), 25, 0.0, 50.0)


@query("SELECT CAST(least(floor(px * (10 / 50.0)), 9) AS BIGINT) AS xbin, CAST(least(floor(py * (5 / 10.0)), 4) AS BIGINT) AS ybin, count(*) AS n FROM part WHERE px BETWEEN 0 AND 50 AND py BETWEEN 0 AND 10 GROUP BY 1, 2")
def hist2d(spark, d):
    return hist.histogram2d(flat(spark, d), F.col("px"), F.col("py"), (10, 5), (0.0, 50.0), (0.0, 10.0))


@query("SELECT floor(abs(status) / 1000)::BIGINT AS region, count(*) AS n FROM part GROUP BY 1")
def detector_regions(spark, d):
    return flat(spark, d).groupBy(K.region(F.col("status")).alias("region")).agg(F.count("*").alias("n"))


@query("SELECT (SELECT count(*) FROM ev) AS n_events, sum(pid)::BIGINT AS sum_pid, round(sum(pid + px), 3) AS scan2, round(sum(pid + px + py + pz + status + pindex + layer + energy), 2) AS wide FROM part")
def checksum_scan(spark, d):
    sums = flat(spark, d).agg(F.sum("pid").cast("long").alias("sum_pid"), F.round(F.sum(F.col("pid") + F.col("px")), 3).alias("scan2"), F.round(F.sum(sum((F.col(c) for c in ("px", "py", "pz", "status", "pindex", "layer", "energy")), F.col("pid").cast("double"))), 2).alias("wide"))
    return table(spark, d, "orders").agg(F.count("*").alias("n_events")).crossJoin(F.broadcast(sums))


# ---- joins inside events


@query("""SELECT a.event_id, count(*) AS n_pairs, round(sum(sqrt(greatest((sqrt(a.px*a.px+a.py*a.py+a.pz*a.pz+1)+sqrt(b.px*b.px+b.py*b.py+b.pz*b.pz+1))**2 - (a.px+b.px)**2 - (a.py+b.py)**2 - (a.pz+b.pz)**2, 0))), 3) AS sum_mass
FROM part a JOIN part b ON a.event_id = b.event_id AND a.row_idx < b.row_idx GROUP BY 1""")
def combinations_mass(spark, d):
    """All pairs of rows of an event and the sum of their invariant masses at unit rest mass."""
    df = chain(spark, d, "Particle").arrays("Particle", ["px", "py", "pz"])
    one = F.lit(1.0)
    masses = jagged.pairs(F.col("Particle"), lambda a, b: (K.to_vector(a["row"], one) + K.to_vector(b["row"], one)).mass)
    return df.where(F.size("Particle") > 1).select("event_id", masses.alias("m")).select("event_id", F.size("m").cast("long").alias("n_pairs"), F.round(jagged.total(F.col("m")), 3).alias("sum_mass"))


@query("SELECT a.event_id, count(*) AS n_pairs, count_if(b.pindex = a.row_idx)::BIGINT AS n_match FROM part a JOIN part b USING (event_id) GROUP BY 1")
def cartesian_match(spark, d):
    df = chain(spark, d).arrays(["Particle", "Calo"])
    grid = F.flatten(jagged.product(jagged.indexed(F.col("Particle")), F.col("Calo"), lambda p, c: c["pindex"] == p["i"]))
    return df.where((F.size("Particle") > 0) & (F.size("Calo") > 0)).select("event_id", grid.alias("g")).select("event_id", F.size("g").cast("long").alias("n_pairs"), F.size(F.filter("g", lambda x: x)).cast("long").alias("n_match"))


@query("SELECT p.event_id, p.row_idx, count(c.event_id) AS n_rows, round(coalesce(sum(c.energy), 0), 4) AS energy FROM part p LEFT JOIN part c ON c.event_id = p.event_id AND c.pindex = p.row_idx GROUP BY 1, 2")
def group_by_index_sum(spark, d):
    """Detector rows regrouped by particle inside the event; out-of-range indices vanish, particles without rows stay."""
    df = chain(spark, d).arrays(["Particle", "Calo"])
    grouped = link.group_by_index(F.col("Calo"), F.size("Particle"))
    out = jagged.exploded(df, ["event_id"], grouped, "g")
    return out.select("event_id", "row_idx", F.size("g").cast("long").alias("n_rows"), F.round(jagged.total(F.col("g.energy")), 4).alias("energy"))


@query("SELECT c.event_id, c.row_idx, c.pindex, coalesce(p.pid, -1) AS pid, coalesce(p.px, -1) AS px FROM part c LEFT JOIN part p ON p.event_id = c.event_id AND p.row_idx = c.pindex")
def link_to_particle(spark, d):
    df = chain(spark, d).link(["Calo"], "Particle", directions="up")
    out = jagged.exploded(df, ["event_id"], F.col("Calo"), "r")
    return out.select("event_id", "row_idx", F.col("r.pindex").cast("long").alias("pindex"), F.coalesce(F.col("r.particle.pid").cast("long"), F.lit(-1)).alias("pid"), F.coalesce("r.particle.px", F.lit(-1.0)).alias("px"))


@query("SELECT p.event_id, p.row_idx, p.pid, coalesce(max(c.energy), -1) AS max_energy FROM part p LEFT JOIN part c ON c.event_id = p.event_id AND c.pindex = p.row_idx GROUP BY 1, 2, 3")
def link_both_ways(spark, d):
    df = chain(spark, d).link(["Calo"], "Particle")
    out = jagged.exploded(df, ["event_id"], F.col("Particle"), "r")
    return out.select("event_id", "row_idx", F.col("r.pid").cast("long").alias("pid"), F.coalesce(F.array_max("r.Calo.energy"), F.lit(-1.0)).alias("max_energy"))


@query("SELECT ev.event_id, count(part.event_id) AS n, round(coalesce(sum(energy), 0), 4) AS energy FROM ev LEFT JOIN part ON part.event_id = ev.event_id AND pindex = 0 GROUP BY 1")
def rows_for_pindex(spark, d):
    df = chain(spark, d, "Calo").arrays("Calo", ["pindex", "energy"])
    held = link.rows_for_index(F.col("Calo"), 0)
    return df.select("event_id", F.size(held).cast("long").alias("n"), F.round(jagged.total(F.transform(held, lambda r: r["energy"])), 4).alias("energy"))


@query("SELECT event_id, row_idx, pid FROM part")
def local_index(spark, d):
    return _longs(chain(spark, d, "Particle").flat("Particle", ["pid"]), "pid")


@query("SELECT event_id, count(part.row_idx) AS rows, CAST(sum(count(part.row_idx)) OVER (ORDER BY event_id) AS BIGINT) AS offset_end FROM ev LEFT JOIN part USING (event_id) GROUP BY 1")
def offsets(spark, d):
    return chain(spark, d, "Particle").offsets("Particle", "pid")


# ---- scalars and physics


@query("""SELECT event_id, row_idx, round(CASE pid WHEN 11 THEN 0.0005109989506900001 WHEN 22 THEN 0.0 WHEN 211 THEN 0.13957039000000002 WHEN 2212 THEN 0.9382720894300001 ELSE -1 END, 9) AS mass,
CASE pid WHEN 11 THEN 'e-' WHEN 22 THEN 'gamma' WHEN 211 THEN 'pi+' WHEN 2212 THEN 'p' ELSE '?' END AS name FROM part""")
def pdg_mass_energy(spark, d):
    rows = chain(spark, d, "Particle").flat("Particle", ["pid"])
    return rows.select("event_id", "row_idx", F.round(pdg_mass(F.col("pid"), unknown=-1.0), 9).alias("mass"), pdg_name(F.col("pid")).alias("name"))


@query("""SELECT event_id, row_idx, round(sqrt(px*px+py*py), 6) AS pt, round(sqrt(px*px+py*py+pz*pz), 6) AS p, round(atan2(py, px), 6) AS phi, round(atan2(sqrt(px*px+py*py), pz), 6) AS theta, round(asinh(pz / sqrt(px*px+py*py)), 6) AS eta FROM part""")
def vector_kinematics(spark, d):
    rows = chain(spark, d, "Particle").flat("Particle", ["px", "py", "pz"])
    v = K.Vector(F.col("px"), F.col("py"), F.col("pz"))
    return rows.select("event_id", "row_idx", *[F.round(getattr(v, n), 6).alias(n) for n in ("pt", "p", "phi", "theta", "eta")])


@query("""WITH e AS (SELECT event_id, px, py, pz, sqrt(px*px+py*py+pz*pz+0.0005109989506900001*0.0005109989506900001) AS en FROM part WHERE pid = 11 AND row_idx = 0)
SELECT event_id, round(2 * 60.0 * (en - pz), 4) AS q2, round(60.0 - en, 6) AS nu, round((60.0 - en) / 60.0, 6) AS y, round(CASE WHEN 0.9382720894300001*0.9382720894300001 + 2*0.9382720894300001*(60.0-en) - 2*60.0*(en-pz) >= 0 THEN sqrt(0.9382720894300001*0.9382720894300001 + 2*0.9382720894300001*(60.0-en) - 2*60.0*(en-pz)) END, 5) AS w FROM e""")
def dis_kinematics(spark, d):
    df = chain(spark, d, "Particle").arrays("Particle", ["pid", "px", "py", "pz"]).select("event_id", jagged.first(F.col("Particle")).alias("e")).where("e.pid = 11")
    k = K.dis(K.to_vector(F.col("e"), pdg_mass(F.col("e.pid"))), BEAM)
    return df.select("event_id", F.round(k["q2"], 4).alias("q2"), F.round(k["nu"], 6).alias("nu"), F.round(k["y"], 6).alias("y"), F.round(k["w"], 5).alias("w"))


@query("""WITH s AS (SELECT event_id, sum(px) AS px, sum(py) AS py, sum(pz) AS pz, sum(sqrt(px*px+py*py+pz*pz)) AS en FROM part WHERE row_idx < 2 GROUP BY 1 HAVING count(*) = 2)
SELECT event_id, round((60.0 + 0.9382720894300001 - en)**2 - px*px - py*py - (60.0 - pz)**2, 2) AS mm2 FROM s""")
def missing_mass(spark, d):
    df = chain(spark, d, "Particle").arrays("Particle", ["px", "py", "pz"]).where(F.size("Particle") >= 2)
    a, b = (K.to_vector(jagged.first(F.col("Particle"), k), F.lit(0.0)) for k in (0, 1))
    return df.select("event_id", F.round(K.missing_mass2(BEAM, a + b), 2).alias("mm2"))


@query("""SELECT p.event_id, p.row_idx, round(coalesce(sum(c.energy), 0) / nullif(sqrt(p.px*p.px+p.py*p.py+p.pz*p.pz), 0), 4) AS fraction FROM part p LEFT JOIN part c ON c.event_id = p.event_id AND c.pindex = p.row_idx AND c.layer = 1 WHERE p.pid = 11 GROUP BY p.event_id, p.row_idx, p.px, p.py, p.pz""")
def sampling_fraction(spark, d):
    """Energy that an electron leaves in one layer over its momentum."""
    df = chain(spark, d).arrays(["Particle", "Calo"])
    layer = jagged.keep_rows(F.col("Calo"), lambda r: r["layer"] == 1)
    both = F.arrays_zip(F.col("Particle").alias("p"), link.group_by_index(layer, F.size("Particle")).alias("g"))
    out = jagged.exploded(df, ["event_id"], both, "x").where("x.p.pid = 11")
    v = K.to_vector(F.col("x.p"))
    return out.select("event_id", "row_idx", F.round(K.sampling_fraction(jagged.total(F.col("x.g.energy")), v.p), 4).alias("fraction"))


@query("SELECT event_id, bit_count(event_tag)::BIGINT AS n_bits, (event_tag & 33) = 33 AS both, CAST(event_tag | 1024 AS BIGINT) AS with_bit, CASE WHEN (event_tag & 1) <> 0 THEN 0 WHEN (event_tag & 2) <> 0 THEN 1 WHEN (event_tag & 4) <> 0 THEN 2 WHEN (event_tag & 8) <> 0 THEN 3 ELSE 4 END::BIGINT AS lowest FROM ev")
def tag_algebra(spark, d):
    tag = F.col("event_tag")
    return events(spark, d).select("event_id", F.bit_count(tag).cast("long").alias("n_bits"), all_bits(tag, 33).alias("both"), tag.bitwiseOR(F.lit(1024)).cast("long").alias("with_bit"), F.get(bit_indices(tag), F.lit(0)).cast("long").alias("lowest"))


@query("SELECT label, count(*) AS n, round(sum(list_sum(list_transform(embedding, lambda x: x::DOUBLE))), 3) AS total, round(sum(embedding[1]::DOUBLE), 3) AS first FROM embeddings GROUP BY 1", model=False)
def array_column_sum(spark, d):
    """Fixed-length array columns: sums along the inner axis, and one element."""
    e = table(spark, d, "embeddings")
    return e.groupBy(F.col("label").cast("int").alias("label")).agg(F.count("*").alias("n"), F.round(F.sum(jagged.total(F.col("embedding"))), 3).alias("total"), F.round(F.sum(F.get("embedding", F.lit(0)).cast("double")), 3).alias("first"))


@query("""WITH e AS (SELECT event_id, px, py, pz, sqrt(px*px+py*py+pz*pz+0.0005109989506900001*0.0005109989506900001) AS en FROM part WHERE pid = 11 AND row_idx = 0),
h AS (SELECT event_id, arg_max(row(px, py, pz), row(px*px+py*py+pz*pz, -row_idx)) AS r FROM part WHERE pid = 211 GROUP BY 1),
x AS (SELECT e.event_id, r[1] AS px, r[2] AS py, r[3] AS pz, en, -e.px AS qx, -e.py AS qy, 60.0 - e.pz AS qz FROM e JOIN h USING (event_id))
SELECT event_id, round(sqrt(px*px+py*py+pz*pz + 0.13957039000000002*0.13957039000000002) / nullif(60.0 - en, 0), 6) AS z,
round(sqrt(greatest(0, px*px+py*py+pz*pz - ((px*qx+py*qy+pz*qz) / nullif(sqrt(qx*qx+qy*qy+qz*qz), 0))**2)), 4) AS pt FROM x""")
def sidis_kinematics(spark, d):
    """z and pT of the leading pion of events whose first row is an electron."""
    df = chain(spark, d, "Particle").arrays("Particle", ["pid", "px", "py", "pz"])
    pions = jagged.leading(jagged.keep_rows(F.col("Particle"), lambda r: r["pid"] == 211), lambda r: r["px"] * r["px"] + r["py"] * r["py"] + r["pz"] * r["pz"])
    df = df.select("event_id", jagged.first(F.col("Particle")).alias("e"), pions["row"].alias("h")).where("e.pid = 11 and h is not null")
    k = K.sidis(K.to_vector(F.col("e"), pdg_mass(F.col("e.pid"))), K.to_vector(F.col("h"), pdg_mass(F.col("h.pid"))), BEAM)
    return df.select("event_id", F.round(k["z"], 6).alias("z"), F.round(k["pt"], 4).alias("pt"))


@query("""WITH c AS (SELECT event_id, min_by(energy, row_idx) AS energy FROM part WHERE pindex = 0 AND layer = 1 GROUP BY 1)
SELECT p.event_id, round(sqrt(px*px + py*py) * 1.5, 6) AS pt FROM part p JOIN c USING (event_id) WHERE p.row_idx = 0 AND p.pid = 11 AND c.energy > 9000 AND c.energy < 60000""")
def fiducial_electrons(spark, d):
    """Corrected transverse momentum of first electrons whose first cluster of a layer lies within bounds."""
    df = chain(spark, d).arrays(["Particle", "Calo"])
    cluster = jagged.first(jagged.keep_rows(F.col("Calo"), lambda r: (r["pindex"] == 0) & (r["layer"] == 1)))
    names = ["pid", "px", "py", "pz"]
    lead = jagged.first(K.corrected(F.col("Particle"), names, lambda r: F.when(r["pid"] == 11, 1.5).otherwise(1.0)))
    kept = df.select("event_id", lead.alias("e"), cluster.alias("c")).where(K.fiducial(F.col("c"), {"energy": 9000.0}, {"energy": 60000.0}) & (F.col("e.pid") == 11))
    return kept.select("event_id", F.round(K.to_vector(F.col("e")).pt, 6).alias("pt"))


# ---- writing and reading again


@query("SELECT event_id, CASE WHEN (event_tag & 1) <> 0 THEN event_tag | 1024 ELSE event_tag END AS event_tag FROM ev")
def retag_overlay(spark, d):
    updates = events(spark, d).where(any_bit(F.col("event_tag"), 1)).select("event_id", F.col("event_tag").bitwiseOR(F.lit(1024)).alias("event_tag"))
    return chain(spark, d, "Particle").retagged(updates).event_tags()


@query("SELECT ev.event_id, row_idx, round(px * 2, 4) AS double_px FROM ev JOIN part USING (event_id)")
def decorate_join(spark, d):
    """A derived bank joined one to one to every event."""
    c = chain(spark, d, "Particle")
    new = c.arrays("Particle", ["px"]).select("event_id", F.transform("Particle", lambda r: F.struct((r["px"] * 2).alias("double_px"))).alias("Derived"))
    return c.decorated(Bank.parse("{Derived/400/1}{double_px/D}"), new).flat("Derived").select("event_id", "row_idx", F.round("double_px", 4).alias("double_px"))


@query("SELECT event_id, event_tag, 0::BIGINT AS record_tag, count(*) AS n FROM ev JOIN part USING (event_id) WHERE (event_tag & 1) <> 0 GROUP BY 1, 2")
def skim_roundtrip(spark, d):
    path = temp(spark, "skim")
    chain(spark, d).filtered(require="Particle", event_tag_any="urgent").skim(path)
    return sinks.read_frame(spark, path)._df.select("event_id", "event_tag", "record_tag", jagged.counts("Particle", "pid").alias("n"))


@query("SELECT count(*) AS events, (SELECT count(DISTINCT event_id) FROM part) AS dropped, 'Calo' AS kept FROM ev")
def skim_banks_dropped(spark, d):
    path = temp(spark, "banks")
    s = chain(spark, d).skim_banks(path, "Ca*")
    back = sinks.read_frame(spark, path)
    return back._df.agg(F.count("*").alias("events")).withColumns({"dropped": F.lit(s.dropped_structures).cast("long"), "kept": F.lit(",".join(back))})


@query("""WITH n AS (SELECT event_id, count(*) AS n FROM part GROUP BY 1)
SELECT ev.event_id, event_tag, file_index::INTEGER AS file_index, coalesce(n, 0) AS particles, 0::BIGINT AS rows, n IS NOT NULL AS has_particles, false AS has_rows FROM ev LEFT JOIN n USING (event_id) UNION ALL
SELECT ev.event_id + (SELECT max(event_id) + 1 FROM ev), event_tag, (file_index + (SELECT max(file_index) + 1 FROM ev))::INTEGER, 0, coalesce(n, 0), false, n IS NOT NULL FROM ev LEFT JOIN n USING (event_id)""")
def chain_union(spark, d):
    """Two chains of different banks as one: dictionaries united, banks absent where they weren't, ids and files carried on."""
    both = EventChain.concat([chain(spark, d, "Particle"), chain(spark, d, "Calo")])
    there = {"has_particles": F.col("Particle").isNotNull(), "has_rows": F.col("Calo").isNotNull()}
    return both._df.select("event_id", "event_tag", "file_index", jagged.counts("Particle", "pid").alias("particles"), jagged.counts("Calo", "layer").alias("rows"), *[c.alias(n) for n, c in there.items()])


@query("SELECT file_index * 14 + (event_id % 4000) // 300 AS chunk_key, min(event_id) AS start, max(event_id) + 1 AS stop, count(*) AS n FROM ev GROUP BY 1")
def batches_report(spark, d):
    """Chunks of at most 300 events that follow files and records, and what each covers."""
    c = chain(spark, d, "Particle")
    named = chunked(c._df.select("event_id", "file_index"), c.chunks(300)).groupBy("chunk").agg(F.min("event_id").alias("start"), (F.max("event_id") + 1).alias("stop"), F.count("*").alias("n"), F.first("file_index").alias("f"))
    return named.select((F.col("f") * 14 + F.floor((F.col("start") % 4000) / 300)).cast("long").alias("chunk_key"), "start", "stop", "n")


@query("SELECT sum(px) AS total, count(*) AS rows, (SELECT max(event_id) FROM ev) AS last FROM part")
def map_reduce_fold(spark, d):
    """A Python function on each chunk, its results folded in event order."""

    def part(t):
        values = t.column("Particle").combine_chunks()
        px = values.flatten().field("px")
        return sum(px.to_pylist()), len(px), t.column("event_id")[-1].as_py()

    total, rows, last = chain(spark, d, "Particle").map_reduce(part, lambda a, b: (a[0] + b[0], a[1] + b[1], b[2]), 5000, "Particle", ["px"])
    return spark.createDataFrame([(float(total), int(rows), int(last))], "total double, rows long, last long")


@query("SELECT count(*) AS rows, sum(pid)::BIGINT AS sum_pid FROM part")
def par_fold_partial(spark, d):
    rows, total = chain(spark, d, "Particle").par_fold(lambda: (0, 0), lambda a, e: (a[0] + len(e["Particle"]), a[1] + sum(r["pid"] for r in e["Particle"])), lambda a, b: (a[0] + b[0], a[1] + b[1]), "Particle", ["pid"])
    return spark.createDataFrame([(rows, total)], "rows long, sum_pid long")


def _container(spark, d, compression: str, **options) -> tuple[EventChain, str]:
    path = temp(spark, "container")
    chain(spark, d).skim(path, format="eventrec", compression=compression, record_events=500, **options)
    return EventChain.open(spark, path), path


@query("SELECT count(DISTINCT ev.event_id) AS n_events, count(part.event_id) AS n_rows, sum(pid)::BIGINT AS sum_pid, sum(px) AS sum_px, round(sum(energy), 2) AS energy, count(DISTINCT event_tag) AS n_tags FROM ev LEFT JOIN part USING (event_id)")
def container_roundtrip(spark, d):
    """Written as by-column containers, read back through the binary source."""
    return _container_sums(_container(spark, d, "zstd+percolumn")[0])


def _container_sums(c: EventChain) -> DataFrame:
    df = c._events({"Particle": ["pid", "px"], "Calo": ["energy"]})
    per = df.select("event_tag", jagged.counts("Particle", "pid").alias("n"), jagged.total(F.col("Particle.pid")).alias("p"), jagged.total(F.col("Particle.px")).alias("x"), jagged.total(F.col("Calo.energy")).alias("e"))
    return per.agg(F.count("*").alias("n_events"), F.sum("n").alias("n_rows"), F.sum("p").cast("long").alias("sum_pid"), F.sum("x").alias("sum_px"), F.round(F.sum("e"), 2).alias("energy"), F.countDistinct("event_tag").alias("n_tags"))


@query("SELECT count(DISTINCT ev.event_id) AS n_events, count(part.event_id) AS n_rows, sum(pid)::BIGINT AS sum_pid, sum(px) AS sum_px, round(sum(energy), 2) AS energy, count(DISTINCT event_tag) AS n_tags FROM ev LEFT JOIN part USING (event_id)")
def container_salvage(spark, d):
    """The same by-bank containers, opened without their headers' and trailers' word."""
    _, path = _container(spark, d, "lz4hc+perbank")
    return _container_sums(EventChain.open(spark, path, salvage=True))


@query("SELECT count(*) AS n_events, count_if((event_tag & 2) <> 0)::BIGINT AS n_high FROM ev WHERE (event_tag & 3) <> 0 AND event_id IN (SELECT event_id FROM part)")
def container_filtered(spark, d):
    """Filters inside the binary source: presence and tags before banks are decoded."""
    c, _ = _container(spark, d, "gzip+perbank")
    df = c.filtered(require="Calo", event_tag_any=["urgent", "high"]).event_tags()
    return df.agg(F.count("*").alias("n_events"), F.count_if(F.col("event_tag").bitwiseAND(F.lit(2)) != 0).alias("n_high"))


@query("SELECT p_partkey % 10 AS f0, count(*) AS n, sum(p_size)::BIGINT AS f1, round(sum(p_retailprice), 2) AS f2 FROM part GROUP BY 1", model=False)
def composite_fields(spark, d):
    """Composite banks written to containers and read back by place: f0, f1, f2, without a schema in the dictionary."""
    row = F.struct(F.col("p_partkey").cast("int").alias("f0"), F.col("p_size").cast("int").alias("f1"), F.col("p_retailprice").cast("double").alias("f2"))
    df = table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("event_id"), F.lit(0).cast("long").alias("event_tag"), F.array(row).alias("Priced"))
    path = temp(spark, "composites")
    sinks.write(df, path, format="eventrec", composites='{"Priced": [700, 5]}', compression="lz4+perbank")
    rows = EventChain.open(spark, path).composite("700/5").select(F.explode("`700/5`").alias("r"))
    return rows.groupBy((F.col("r.f0") % 10).cast("long").alias("f0")).agg(F.count("*").alias("n"), F.sum("r.f1").cast("long").alias("f1"), F.round(F.sum("r.f2"), 2).alias("f2"))


# ---- streams


def _timed(spark, d) -> DataFrame:
    """The events table as a stream, its times as instants in UTC."""
    stream = running.read_files(spark, f"{d}/events*.parquet", like=table(spark, d, "events"))
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT CAST(least(floor(value * (20 / 500.0)), 19) AS BIGINT) AS bin, event_type, count(*) AS n FROM events WHERE value >= 0 AND value <= 500 GROUP BY 1, 2", model=False)
def stream_histogram(spark, d):
    stream = _timed(spark, d)
    return running.running_histogram(stream, F.col("value"), 20, 0.0, 500.0, by="event_type")


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS w_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2", model=False)
def stream_windows(spark, d):
    stream = _timed(spark, d)
    out = running.windowed(stream, "ts", "1 hour", keys=("event_type",), n=F.count("*"), total=F.sum("value"))
    return out.select("w_start", "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 minute THEN 0 ELSE 1 END AS fresh FROM events), g AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s)
SELECT user_id, min(ts) AS w_start, count(*) AS n FROM g GROUP BY user_id, k""", model=False)
def stream_sessions(spark, d):
    stream = _timed(spark, d)
    return running.sessions(stream, "ts", "30 minutes", "user_id", n=F.count("*")).select("user_id", "w_start", "n")

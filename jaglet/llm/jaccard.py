"""N-gram Jaccard self-join by rare-first prefix filtering, and the near-duplicate classes it gives.

Every text is its set of distinct n-word shingles. Two sets of sizes x <= y can only reach the threshold t if
x >= t*y, and then they share one of the first n - ceil(t*n) + 1 shingles of each under any common order. The
order here is rare first, by a count sketch of all shingles of all documents (a fixed number of counters), so
that the postings of common passages stay short. What is done, in order:

1. sketch: one pass counts every shingle of every text into fixed buckets; Spark adds up the buckets.
2. signatures: a second pass gives each text its set's 128-bit fingerprint, size and prefix. Texts with equal
   sets form one node (named by their smallest id), so copies cost one row each and nothing more.
3. postings: (shingle, node, size, position) dealt by shingle. Shingles in buckets far above the mean, which
   hot passages are in, are dealt in salted parts: no task gets a hot posting list whole, and no row is sent twice.
4. stars: each part links its nodes to its most central node (the least position, i.e. the fewest rarer
   shingles), and the parts' central nodes are linked to the list's, if length and positional filters allow. These
   pairs, each once, go through the suffix filter and exact verification, and give first components. A
   group of copies so costs rows in proportion to its members.
5. rest: all other pairs of a posting list whose ends are in different components, once each, through the
   same filters and verification. Pairs inside one component can't change the components, so the result is
   that of all pairs. Lists are counted for this, exactly; those of one component go, and those of more than
   LIST_ROWS rows are dealt as pairs of blocks, so a task holds two blocks at most.

Verification intersects the whole shingle sets. They are computed from the texts once more, only for nodes
in a Bloom filter of the candidates, sized by their number (false positives cost time, never results).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jaglet.llm import wordhash as wh
from jaglet.llm.common import bloom, in_bloom, materialize, over_batches, session_of, slices, text_view
from jaglet.llm.components import connected_components

SKETCH_BITS = 18
#: A bucket of the sketch is hot from this many times the mean on, and then has a part per such multiple.
HOT = 32
#: Rows of a posting list that a task compares whole; longer ones are blocks of so many, which meet in pairs.
LIST_ROWS = 8192
#: Hash ranges whose shingles a signature counts, up to 255 each, for the suffix filter.
PARTS = 128
CHUNK = 1 << 20


def sets_of(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, text of each, set sizes): the distinct shingles of each text, sorted by text, then hash."""
    h, _, _, first = wh.words(data, offsets, wh.BLANKS)
    s, text = wh.distinct(*wh.shingles(h, first, size))
    return s, text, np.bincount(text, minlength=len(offsets) - 1)


def at_least(percent: int, a, b):
    """The least overlap with which sets of sizes a and b reach the threshold: o >= t/(1+t) * (a+b)."""
    return -(-(percent * (a + b)) // (100 + percent))


def prefix_length(percent: int, n):
    return n - -(-(percent * n) // 100) + 1


class Join:
    """The join of one table; `percent` of 85 means 100*intersection >= 85*union."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, size: int, percent: int):
        self.spark = session_of(docs)
        self.size, self.percent = size, percent
        self.docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))

    def sketch(self) -> np.ndarray:
        size = self.size

        def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(1 << SKETCH_BITS, np.int64)
            for b in batches:
                data, at = text_view(b.column(0))
                for i, j in slices(at, CHUNK):
                    h, _, _ = sets_of(data, at[i : j + 1], size)
                    total += np.bincount((h >> wh.U64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(total))
            some = np.flatnonzero(total)
            for k in range(0, len(some), 1 << 16):
                x = some[k : k + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(total[x])], ["bucket", "n"])

        parts = self.docs.select("text").mapInArrow(count, "bucket long, n long")
        rows = parts.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        total[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
        return total

    def signatures(self, sketch) -> DataFrame:
        """doc_id, n, fp1, fp2, prefix (shingles, rarest first), parts (how many shingles in each hash range)."""
        size, percent = self.size, self.percent

        def kernel(b: pa.RecordBatch) -> pa.RecordBatch:
            data, at = text_view(b.column(1))
            counts = sketch.value
            ns, f1, f2, prefixes, lengths, parts = [], [], [], [], [], []
            for i, j in slices(at, CHUNK):
                h, text, n = sets_of(data, at[i : j + 1], size)
                first = np.concatenate(([0], np.cumsum(n)))
                with np.errstate(over="ignore"):
                    for out, salt in ((f1, 0x1234567), (f2, 0x7654321)):
                        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(wh.mix(h ^ wh.U64(salt)), dtype=np.uint64)))
                        out.append(wh.mix(sums[first[1:]] - sums[first[:-1]] + n.astype(np.uint64)).view(np.int64))
                parts.append(np.bincount(text * PARTS + ((h >> wh.U64(3)) % wh.U64(PARTS)).astype(np.int64), minlength=(j - i) * PARTS))
                order = np.lexsort((h, counts[(h >> wh.U64(64 - SKETCH_BITS)).astype(np.int64)], text))
                take = np.where(n > 0, prefix_length(percent, n), 0)
                rank = np.arange(len(h)) - np.repeat(first[:-1], n)
                prefixes.append(h[order][rank < np.repeat(take, n)].view(np.int64))
                ns.append(n), lengths.append(take)
            join = lambda x: np.concatenate(x)
            ends = np.concatenate(([0], np.cumsum(join(lengths)))).astype(np.int32)
            packed = np.minimum(join(parts), 255).astype(np.uint8).reshape(-1, PARTS)
            return pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(join(ns)), pa.array(join(f1)), pa.array(join(f2)), pa.ListArray.from_arrays(pa.array(ends), pa.array(join(prefixes))), pa.array([x.tobytes() for x in packed], pa.binary())],
                ["doc_id", "n", "fp1", "fp2", "prefix", "parts"],
            )

        return over_batches(self.docs, kernel, "doc_id long, n long, fp1 long, fp2 long, prefix array<long>, parts binary")

    def postings(self, nodes: DataFrame, sketch) -> DataFrame:
        """The posting lists of two nodes and more, each part with its most central node: key, part (-1: the only one), node, n, pos, hub, hub_n, hub_pos."""

        def emit(b: pa.RecordBatch) -> pa.RecordBatch:
            counts = sketch.value
            node, n = b.column(0).to_numpy(), b.column(1).to_numpy()
            col = b.column(2)
            length = np.diff(col.offsets.to_numpy()).astype(np.int64)
            key = col.flatten().to_numpy().view(np.uint64)
            row = np.repeat(np.arange(len(node)), length)
            pos = np.arange(len(key)) - np.repeat(np.cumsum(length) - length, length)
            parts = np.maximum(1, counts[(key >> wh.U64(64 - SKETCH_BITS)).astype(np.int64)] // max(1, int(HOT * max(1.0, counts.mean()))))
            part = np.where(parts > 1, (wh.mix(node.view(np.uint64)) % np.uint64(1 << 30)).astype(np.int64)[row] % parts, -1)
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(part.astype(np.int32)), pa.array(node[row]), pa.array(n[row].astype(np.int32)), pa.array(pos.astype(np.int32))], names)

        names = ["key", "part", "node", "n", "pos"]
        dealt = over_batches(nodes.select("node", "n", "prefix"), emit, "key long, part int, node long, n int, pos int")
        dealt = dealt.repartition(self._parts(), "key", "part").sortWithinPartitions("key", "part", "pos", "node")

        def shared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hub = None  # the first row of the part being read, and whether it was given out
            for b in batches:
                cols = [b.column(i).to_numpy() for i in range(5)]
                if not len(cols[0]):
                    continue
                if hub is not None:
                    cols = [np.concatenate((np.array([h], c.dtype), c)) for h, c in zip(hub[0], cols, strict=True)]
                key, part = cols[:2]
                begins = np.concatenate(([True], (key[1:] != key[:-1]) | (part[1:] != part[:-1])))
                group = np.cumsum(begins) - 1
                at = np.flatnonzero(begins)
                sizes = np.bincount(group)
                keep = (sizes[group] > 1) | (part >= 0)  # a row alone in its part may meet those of others
                if hub is not None and hub[1]:
                    keep[0] = False
                last = at[-1]
                hub = (tuple(c[last] for c in cols), bool(keep[last]) or (hub is not None and hub[1] and last == 0))
                head = at[group]
                yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in cols] + [pa.array(c[head][keep]) for c in cols[2:]], [*names, "hub", "hub_n", "hub_pos"])

        return dealt.mapInArrow(shared, "key long, part int, node long, n int, pos int, hub long, hub_n int, hub_pos int")

    def stars(self, posts: DataFrame) -> DataFrame:
        """Pairs (a, b), each once, of nodes and their part's hub, and of hubs and their list's, that pass the filters."""
        heads = posts.where("part >= 0 and node = hub")
        lead = heads.groupBy("key").agg(F.min(F.struct("pos", "node", "n")).alias("lead")).select("key", F.col("lead.node").alias("hub"), F.col("lead.n").alias("hub_n"), F.col("lead.pos").alias("hub_pos"))
        names = ["node", "n", "pos", "hub", "hub_n", "hub_pos"]
        rows = posts.select(*names).unionByName(heads.select("key", "node", "n", "pos").join(lead, "key").select(*names)).where("node <> hub")
        rows = rows.where(self.passing(F.col("n"), F.col("hub_n"), F.col("pos"), F.col("hub_pos")))
        return rows.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()

    def _parts(self) -> int:
        return int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def passing(self, na, nb, pa_, pb):
        """Length and positional filter of a pair that meets at positions pa_ and pb of its prefixes."""
        small, large = F.least(na, nb).cast("long"), F.greatest(na, nb).cast("long")
        need = F.ceil((na.cast("long") + nb) * self.percent / (100 + self.percent))
        return (small * 100 >= large * self.percent) & (F.least(na - pa_, nb - pb) >= need)

    def crossing(self, posts: DataFrame, component: DataFrame) -> DataFrame:
        """Pairs (a, b), each once, of nodes that share a posting list but no component, and pass the filters."""
        percent = self.percent
        labelled = posts.select("key", "node", "n", "pos").join(component, "node", "left").select("key", "n", "pos", "node", F.coalesce("component", "node").alias("component"))
        sizes = labelled.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count("*").alias("rows")).where("least <> most")
        mixed = materialize(sizes.select("key", F.ceil(F.col("rows") / LIST_ROWS).cast("int").alias("blocks")), "mixed")
        rows = labelled.join(mixed, "key").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        lone = (F.col("blocks") == 1) | (F.col("mine") == F.col("other"))
        key = F.when(F.col("blocks") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")))
        rows = rows.select(key.alias("key"), "n", "pos", "node", "component", F.when(F.col("blocks") == 1, -1).otherwise(F.col("mine")).alias("mine"), lone.alias("lone"))
        mixed = rows.repartition(self._parts(), "key").sortWithinPartitions("key", "component", "pos")

        def pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[np.ndarray] | None = None

            def cross(cols):
                key, n, pos, node, comp, mine, lone = cols
                begins = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
                for s, e in zip(begins[:-1], begins[1:], strict=True):
                    if comp[s] == comp[e - 1]:
                        continue
                    size, at, who, of, side = n[s:e].astype(np.int64), pos[s:e].astype(np.int64), node[s:e], comp[s:e], mine[s:e]
                    apart = not lone[s]  # two blocks meet here; each alone meets itself elsewhere
                    for i in range(0, len(who), 512):
                        meet = of[i : i + 512, None] < of[None, :]
                        if apart:
                            meet &= side[i : i + 512, None] != side[None, :]
                        x, y = np.nonzero(meet)
                        x += i
                        ok = 100 * np.minimum(size[x], size[y]) >= percent * np.maximum(size[x], size[y])
                        ok &= np.minimum(size[x] - at[x], size[y] - at[y]) >= at_least(percent, size[x], size[y])
                        if ok.any():
                            x, y = who[x[ok]], who[y[ok]]
                            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

            for b in batches:
                cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(7)]
                if not len(cols[0]):
                    continue
                if held is not None:
                    cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
                last = int(np.searchsorted(cols[0], cols[0][-1], "left"))  # the last list may go on
                held = [c[last:] for c in cols]
                if last:
                    yield from cross([c[:last] for c in cols])
            if held is not None:
                yield from cross(held)

        return mixed.mapInArrow(pairs, "a long, b long").distinct()

    def verified(self, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
        """The pairs (a, b) that reach the threshold; pairs are distinct and materialized."""
        percent, size = self.percent, self.size
        side = nodes.select("node", "n", "parts")
        a, b = (side.select(*(F.col(c).alias(f"{x}{c}") for c in side.columns)) for x in "ab")
        near = pairs.join(a, F.col("a") == F.col("anode")).join(b, F.col("b") == F.col("bnode"))

        def suffix(batch: pa.RecordBatch) -> pa.RecordBatch:
            # at least as many shingles differ as the counts of the hash ranges do in sum; capped counts differ less
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, PARTS).astype(np.int64) for c in ("aparts", "bparts"))
            na, nb = batch.column("an").to_numpy(), batch.column("bn").to_numpy()
            ok = np.abs(x - y).sum(1) <= na + nb - 2 * at_least(percent, na, nb)
            return pa.RecordBatch.from_arrays([pa.array(batch.column(c).to_numpy()[ok]) for c in ("a", "b")], ["a", "b"])

        near = materialize(over_batches(near.select("a", "b", "an", "bn", "aparts", "bparts"), suffix, "a long, b long"), "near")
        some = near.select("a").union(near.select("b").withColumnRenamed("b", "a")).distinct()
        wanted = self.spark.sparkContext.broadcast(bloom(some))

        def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hit = np.flatnonzero(in_bloom(wanted.value, batch.column(0).fill_null(0).to_numpy()) & np.asarray(batch.column(0).is_valid()))
                if not len(hit):
                    continue
                some = batch.take(pa.array(hit))
                data, at = text_view(some.column(1))
                for i, j in slices(at, CHUNK):
                    s, _, n = sets_of(data, at[i : j + 1], size)
                    cuts = np.concatenate(([0], np.cumsum(n))) * 8
                    raw = s.tobytes()
                    yield pa.RecordBatch.from_arrays([some.column(0).slice(i, j - i), pa.array([raw[cuts[k] : cuts[k + 1]] for k in range(j - i)], pa.binary())], ["node", "items"])

        sets = materialize(self.docs.mapInArrow(whole, "node long, items binary"), "sets")
        a, b = (sets.select(F.col("node").alias(f"{x}node"), F.col("items").alias(f"{x}items")) for x in "ab")
        both = near.join(a, F.col("a") == F.col("anode")).join(b, F.col("b") == F.col("bnode"))

        def check(batch: pa.RecordBatch) -> pa.RecordBatch:
            ok = np.zeros(batch.num_rows, bool)
            before, x = None, None
            for k, (p, q) in enumerate(zip(batch.column("aitems"), batch.column("bitems"), strict=True)):
                p, q = p.as_buffer(), q.as_buffer()
                if before is None or p.size != before.size or not p.equals(before):
                    before, x = p, np.frombuffer(p, np.uint64)
                y = np.frombuffer(q, np.uint64)
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                at = np.searchsorted(large, small)
                at[at == len(large)] = 0
                common = int((large[at] == small).sum()) if len(large) else 0
                ok[k] = 100 * common >= percent * (len(x) + len(y) - common)
            return pa.RecordBatch.from_arrays([pa.array(batch.column(c).to_numpy()[ok]) for c in ("a", "b")], ["a", "b"])

        return materialize(over_batches(both.select("a", "b", "aitems", "bitems"), check, "a long, b long").distinct(), "links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest id that links reach, itself included).

    docs needs an integer id and a text; other columns may be there and are not read. Null, empty and blank
    texts have no shingles and link with nothing. Equal texts link. A row without id is compared with nothing
    and gets a null component. Rows that repeat an id are one document: it links where any of its texts does.
    An empty table gives an empty table. Ids must fit in 64 bits. Texts may be of any length: words are hashed in blocks,
    a text's set is in one task's memory.
    """
    join = Join(docs, id_col, text_col, size, percent)
    sketch = join.spark.sparkContext.broadcast(join.sketch())
    signed = materialize(join.signatures(sketch), "signatures")
    named = signed.where("n > 0 and doc_id is not null")
    classes = materialize(named.groupBy("fp1", "fp2").agg(F.min("doc_id").alias("node")), "classes")
    heads = named.join(classes.withColumnsRenamed({"fp1": "g1", "fp2": "g2"}), (F.col("fp1") == F.col("g1")) & (F.col("fp2") == F.col("g2")) & (F.col("doc_id") == F.col("node")))
    nodes = materialize(heads.select("node", "n", "prefix", "parts"), "nodes")
    posts = materialize(join.postings(nodes, sketch), "postings")
    stars = materialize(join.stars(posts), "stars")
    links = join.verified(stars, nodes)
    component = materialize(connected_components(links), "components")
    rest = join.crossing(posts, component).join(stars, ["a", "b"], "left_anti")
    more = join.verified(materialize(rest, "rest"), nodes)
    component = materialize(connected_components(links.unionByName(more)), "components")
    roots = classes.join(component, "node", "left").select("fp1", "fp2", F.coalesce("component", "node").alias("root"))
    rows = signed.select("doc_id", "n", "fp1", "fp2").join(roots, ["fp1", "fp2"], "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("root")).otherwise(F.col("doc_id"))).alias("component_id"))


def op6_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Classes of documents whose sets of 4-word shingles have a Jaccard similarity of 0.85 or more."""
    from jaglet.llm.common import table

    return near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=85)


OP6_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM g x JOIN g y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n u ON u.doc_id = a JOIN n v ON v.doc_id = b WHERE 100 * o >= 85 * (u.n + v.n - o)),
r AS (
  WITH RECURSIVE reach(a, b) AS (SELECT a, b FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b)
  SELECT a, min(b) AS m FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(r.m, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.a = d.doc_id
"""

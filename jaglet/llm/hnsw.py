"""Near-duplicate embeddings by hierarchical navigable small-world graphs, one per shard.

Vectors are compared within a label only. Equal vectors are one node with a count, so copies cost nothing. The nodes
of a label are dealt by hash into shards of at most about SHARD nodes; each shard gets a graph, and every shard of
the label is searched for every node, in groups of one shard's queries against one shard's graph, so a hot label
is many bounded tasks. Searches run many queries at a time in numpy. A beam that is still above the threshold at
its end has not seen all partners: its query goes on through the graph's neighbours until no new one links, without
a cap. In each group the queries whose id is divisible by 100 (the first few, if there are none) are compared with
brute force. Beams are doubled until recall passes, at the end to the whole shard, which is exact. Recall is the mean
over audited queries that have links, a query's link with itself left out, so that one large group of copies can't
speak for others; and since few queries may have any, as many of the shard's nodes are searched for from a point beside
them whose cosine is just above the threshold, which have to be found as often. Every link is verified by its cosine in double precision. A group gives counts and its own components, not pairs; components are
then joined over all groups.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jaglet.llm.common import materialize, session_of, table
from jaglet.llm.components import connected_components

#: Nodes of a graph at most, in expectation: some 30 MB with links, and a quarter of a minute to build.
SHARD = 32768
LINKS, BEAM, BUILD_BEAM, BATCH = 12, 32, 40, 256
RECALL = 0.99
MARGIN = 0.01  # how far below the threshold the way to further partners may lead
SLACK = 1e-4  # searches run in single precision, this far below the threshold


class Graph:
    """A graph over the unit vectors x; neighbors[l] has -1 where a node has no further neighbour on level l."""

    def __init__(self, x: np.ndarray, neighbors: list[np.ndarray], entry: int):
        self.x, self.neighbors, self.entry = x, neighbors, entry

    @classmethod
    def build(cls, x: np.ndarray, seed: int = 1) -> Graph:
        x = np.ascontiguousarray(x, np.float32)
        n = len(x)
        rng = np.random.default_rng(seed)
        level = np.minimum((-np.log(1 - rng.random(n)) / np.log(LINKS)).astype(int), 6)
        level[0] = level.max(initial=0)
        g = cls(x, [np.full((n, LINKS * (2 if not k else 1)), -1, np.int32) for k in range(int(level[0]) + 1 if n else 1)], 0)
        done = 1
        while done < n:
            new = np.arange(done, min(n, done + min(BATCH, max(1, done // 2))))
            g._insert(new, level)
            done = int(new[-1]) + 1
        g._link_orphans()
        return g

    def _link_orphans(self) -> None:
        """On the lowest level, a way to every node from its nearest neighbour where no neighbour about as near kept one."""
        links, n = self.neighbors[0], len(self.x)
        alone = np.ones(n, bool)
        for i in range(0, n, 1024):
            own = links[i : i + 1024]
            back = links[np.maximum(own, 0)] == np.arange(i, i + len(own))[:, None, None]
            sims = np.einsum("bcd,bd->bc", self.x[np.maximum(own, 0)], self.x[i : i + len(own)])
            near = (own >= 0) & (sims >= sims[:, :1] - 0.05)
            alone[i : i + 1024] = ~(back.any(2) & near).any(1)
        node = np.flatnonzero(alone & (links[:, 0] >= 0))
        near = links[node, 0]
        order = np.argsort(near, kind="stable")
        node, near = node[order], near[order]
        rank = np.arange(len(near)) - np.searchsorted(near, near)
        more = np.full((n, int(rank.max(initial=-1)) + 1), -1, np.int32)
        more[near, rank] = node
        self.neighbors[0] = np.hstack((links, more))

    def _insert(self, new: np.ndarray, level: np.ndarray) -> None:
        q = self.x[new]
        among = q @ q.T
        np.fill_diagonal(among, -2)
        at = np.full((len(new), 1), self.entry)
        for k in range(len(self.neighbors) - 1, -1, -1):
            here = level[new] >= k
            ids, sims = self.layer(q, at, BUILD_BEAM if here.any() else 1, k)
            at = ids[:, :1] if k else ids
            if not here.any():
                continue
            # of the same batch, the nearest that live on this level; one direction is enough, links go both ways
            peers = np.where(here[None, :], among, -2)[here]
            near = np.argsort(-peers, axis=1)[:, :8]
            cand = np.hstack((ids[here], np.where(np.take_along_axis(peers, near, 1) > -2, new[near], -1)))
            own = new[here]
            picked = self.choose(own, cand, self.neighbors[k].shape[1])
            self.neighbors[k][own] = picked
            s, t = np.repeat(own, picked.shape[1]), picked.ravel()
            s, t = s[t >= 0], t[t >= 0]
            self._link_back(s, t, k)

    def _link_back(self, s: np.ndarray, t: np.ndarray, k: int) -> None:
        order = np.lexsort((-np.einsum("ij,ij->i", self.x[s], self.x[t]), t))
        s, t = s[order], t[order]
        target, first, count = np.unique(t, return_index=True, return_counts=True)
        rank = np.arange(len(t)) - np.repeat(first, count)
        fit = rank < 32  # nearest first
        add = np.full((len(target), 32), -1, np.int64)
        add[np.repeat(np.arange(len(target)), count)[fit], rank[fit]] = s[fit]
        width = self.neighbors[k].shape[1]
        for i in range(0, len(target), 512):
            part = target[i : i + 512]
            self.neighbors[k][part] = self.choose(part, np.hstack((self.neighbors[k][part], add[i : i + 512])), width)

    def choose(self, nodes: np.ndarray, cand: np.ndarray, width: int) -> np.ndarray:
        """Up to width neighbours of each node: first those nearer to it than to ones chosen before, then the nearest."""
        cand = np.where(cand == nodes[:, None], -1, cand)
        cand = np.sort(cand, axis=1)
        cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
        v = self.x[np.maximum(cand, 0)]
        sims = np.where(cand >= 0, np.matmul(v, self.x[nodes][:, :, None])[:, :, 0], -3)
        pair = np.matmul(v, v.transpose(0, 2, 1))
        order = np.argsort(-sims, axis=1, kind="stable")
        rows, size = np.arange(len(cand)), cand.shape[1]
        closest, diverse, count = np.full(cand.shape, -2.0, np.float32), np.zeros(cand.shape, bool), np.zeros(len(cand), np.int64)
        for c in range(size):
            k = order[:, c]
            take = np.flatnonzero((cand[rows, k] >= 0) & (sims[rows, k] > closest[rows, k]) & (count < width))
            diverse[take, k[take]] = True
            count[take] += 1
            closest[take] = np.maximum(closest[take], pair[take, k[take]])
        rank = np.argsort(np.where(cand < 0, 9, np.where(diverse, 0, 4) - sims), axis=1, kind="stable")
        best = np.take_along_axis(cand, rank, 1)[:, :width]
        return np.pad(best, ((0, 0), (0, max(0, width - best.shape[1]))), constant_values=-1).astype(np.int32)

    def layer(self, q: np.ndarray, start: np.ndarray, beam: int, k: int, spread: int = 3) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities) of the nearest nodes on level k, best first; -1 where there are fewer."""
        links, rows = self.neighbors[k], len(q)
        seen = np.zeros((rows, len(self.x)), bool)
        ids = np.full((rows, max(beam, start.shape[1])), -1, np.int64)
        ids[:, : start.shape[1]] = start
        sims = np.where(ids >= 0, np.einsum("bcd,bd->bc", self.x[np.maximum(ids, 0)], q), -3).astype(np.float32)
        r, c = np.nonzero(ids >= 0)
        seen[r, ids[r, c]] = True
        fresh = ids >= 0
        active = np.arange(rows)
        while len(active):
            f = fresh[active]
            pick = np.argsort(np.where(f, -sims[active], 4), axis=1)[:, :spread]
            chosen = np.where(np.take_along_axis(f, pick, 1), np.take_along_axis(ids[active], pick, 1), -1)
            rowsel = active[:, None]
            np.put_along_axis(f, pick, False, 1)
            fresh[active] = f
            near = np.where(chosen[:, :, None] >= 0, links[np.maximum(chosen, 0)], -1).reshape(len(active), -1)
            near = np.where((near >= 0) & ~seen[rowsel, np.maximum(near, 0)], near, -1)
            near = np.sort(near, axis=1)[:, ::-1]
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            width = int((near >= 0).sum(1).max(initial=0))
            if width:
                near = np.sort(near, axis=1)[:, ::-1][:, :width]
                s = np.where(near >= 0, np.einsum("bcd,bd->bc", self.x[np.maximum(near, 0)], q[active]), -3).astype(np.float32)
                r, c = np.nonzero(near >= 0)
                seen[active[r], near[r, c]] = True
                all_s, all_i = np.hstack((sims[active], s)), np.hstack((ids[active], near))
                all_f = np.hstack((fresh[active], near >= 0))
                size = ids.shape[1]
                top = np.argpartition(-all_s, size - 1, axis=1)[:, :size]
                sims[active], ids[active], fresh[active] = (np.take_along_axis(a, top, 1) for a in (all_s, all_i, all_f))
            active = active[fresh[active].any(1)]
        order = np.argsort(-sims, axis=1, kind="stable")[:, :beam]
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def links(self, q: np.ndarray, least: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) of the pairs found with a similarity of at least `least`."""
        found_q, found_n = [], []
        beam = min(beam, len(self.x))
        for i in range(0, len(q), BATCH):
            part = np.ascontiguousarray(q[i : i + BATCH], np.float32)
            at = np.full((len(part), 1), self.entry)
            for k in range(len(self.neighbors) - 1, 0, -1):
                at = self.layer(part, at, 1, k)[0]
            ids, sims = self.layer(part, at, beam, 0)
            ok = sims >= least
            full = ok.all(1)
            r, c = np.nonzero(ok & ~full[:, None])
            found_q.append(i + r), found_n.append(ids[r, c])
            for j in np.flatnonzero(full):
                more = self._flood(part[j], ids[j], least)
                found_q.append(np.full(len(more), i + j)), found_n.append(more)
        return np.concatenate(found_q or [np.zeros(0, int)]), np.concatenate(found_n or [np.zeros(0, int)])

    def _flood(self, q: np.ndarray, start: np.ndarray, least: float) -> np.ndarray:
        """All nodes that link with q and that neighbours which link, or nearly do, lead to."""
        seen = np.zeros(len(self.x), bool)
        seen[start] = True
        out, edge = [start], start
        while len(edge):
            near = np.unique(self.neighbors[0][edge])
            near = near[(near >= 0)]
            near = near[~seen[near]]
            seen[near] = True
            sims = self.x[near] @ q
            edge = near[sims >= least - MARGIN]
            out.append(near[sims >= least])
        return np.concatenate(out)


def unit(rows: np.ndarray) -> np.ndarray:
    x = rows / np.abs(rows).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    col = column.combine_chunks()
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(col), -1)


def _pack(**arrays) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def least_labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least number in each component of the graph over 0..n-1 with edges a-b."""
    label = np.arange(n)
    while True:
        old = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if np.array_equal(old, label):
            return label


def _beside(x: np.ndarray, least: float, n: int) -> tuple[np.ndarray, np.ndarray]:
    """n unit vectors, or as many as x has, each of a cosine just above `least` with a row of x, and these rows."""
    rng = np.random.default_rng(len(x))
    known = rng.permutation(len(x))[: max(1, n)]
    z = rng.normal(size=(len(known), x.shape[1]))
    z -= np.einsum("ij,ij->i", z, x[known])[:, None] * x[known]
    size = np.sqrt((z * z).sum(1, keepdims=True))
    cosine = min(1.0, least + 0.25 * (1 - least))
    return np.where(size > 1e-9, cosine * x[known] + np.sqrt(1 - cosine * cosine) * z / np.maximum(size, 1e-9), x[known]), known


def _mean_recall(asked: np.ndarray, got: np.ndarray) -> float:
    """The mean over queries of the share of their links that were found; 1 without links."""
    if not len(asked):
        return 1.0
    _, at = np.unique(asked, return_inverse=True)
    return float((np.bincount(at, got) / np.bincount(at)).mean())


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.98, shard: int = SHARD, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row; links are pairs of equal labels with a cosine >= least.

    Vectors that are null, zero, empty, or hold null or non-finite numbers link with nothing, as do those without a
    label or id (the latter have a null component and aren't kept) and those of different lengths. Ties are links: a
    cosine of just `least` counts, and of equal vectors the least id stands for all. Rows that repeat id, label and vector are one vector; rows that repeat an id alone are one vector in several places, whose
    links add up. An empty table gives an empty table; other columns aren't read.
    """
    spark = session_of(vectors)
    # single precision stays as it is on its way, and is exact in double precision
    given = vectors.select(f"`{vector_col}`").schema[0].dataType
    single = isinstance(given, T.ArrayType) and isinstance(given.elementType, T.FloatType)
    v = F.col(f"`{vector_col}`") if single else F.col(f"`{vector_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").alias("label"), v.alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~F.coalesce(odd, F.lit(True)) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("ok", F.coalesce(sound, F.lit(False)))
    # 128 bits of hash know a vector of a label; 0.0 and -0.0 are alike
    plain = F.transform("v", lambda x: x.cast("double") + F.lit(0.0))
    rows = rows.select("vec_id", "label", "v", "ok", F.when(F.col("ok"), F.xxhash64("label", plain)).alias("h1"), F.when(F.col("ok"), F.xxhash64(F.lit(7), plain, "label")).alias("h2"))
    keyed = materialize(rows.select("vec_id", "ok", "h1", "h2"), "vectors")
    classes = keyed.where("ok").select("vec_id", "h1", "h2").distinct().groupBy("h1", "h2").agg(F.min("vec_id").alias("node"), F.count("*").alias("times"))
    classes = materialize(classes, "classes")
    heads = rows.where("ok").join(classes, ["h1", "h2"]).where("vec_id = node").dropDuplicates(["h1", "h2"])
    heads = materialize(heads.select("node", "times", "h1", "label", F.size("v").alias("dim"), "v"), "nodes")
    # a label's shards are as many as its nodes need, and each node is searched for in all of them
    sizes = heads.groupBy("label", "dim").agg(F.ceil(F.count("*") / F.lit(shard)).cast("int").alias("shards"))
    dealt = heads.join(sizes, ["label", "dim"]).withColumn("own", F.pmod("h1", F.col("shards")).cast("int"))

    def build(key, t):
        order = np.argsort(t.column("node").to_numpy(), kind="stable")
        node, x = t.column("node").to_numpy()[order], unit(matrix(t.column("v"))[order])
        mixed = np.random.default_rng(len(node)).permutation(len(node))
        node, x = node[mixed], x[mixed]
        g = Graph.build(x)
        packed = _pack(node=node, times=t.column("times").to_numpy()[order][mixed], x=x, entry=np.array(g.entry), levels=np.array(len(g.neighbors)), **{f"l{k}": a for k, a in enumerate(g.neighbors)})
        return pa.table({"label": t.column("label").slice(0, 1), "dim": t.column("dim").slice(0, 1), "target": t.column("own").slice(0, 1), "graph": pa.array([packed], pa.binary())})

    kind = rows.schema["label"].dataType.simpleString()
    graphs = materialize(dealt.select("label", "dim", "own", "node", "times", "v").groupBy("label", "dim", "own").applyInArrow(build, f"label {kind}, dim int, target int, graph binary"), "graphs")
    queries = dealt.select("label", "dim", "own", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("target"), "node", "times", "v")
    pairs_of = sizes.select("label", "dim", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("own"))
    spread = graphs.join(pairs_of, ["label", "dim"])

    def search(key, g, q):
        none = {"node": pa.array([], pa.int64()), "n_links": pa.array([], pa.int64()), "leader": pa.array([], pa.int64())}
        if not g.num_rows or not q.num_rows:
            return pa.table(none)
        a = np.load(io.BytesIO(g.column("graph")[0].as_py()))
        x, node, times = a["x"], a["node"], a["times"]
        graph = Graph(x.astype(np.float32), [a[f"l{k}"] for k in range(int(a["levels"]))], int(a["entry"]))
        mine, y = q.column("node").to_numpy(), unit(matrix(q.column("v")))
        audit = np.flatnonzero(mine % 100 == 0)
        audit = audit if len(audit) else np.argsort(mine, kind="stable")[:8]
        hits = [(k + r, c) for k in range(0, len(audit), 256) for r, c in [np.nonzero(y[audit[k : k + 256]] @ x.T >= least)]]
        asked, want = (np.concatenate(z) for z in zip(*hits, strict=True))
        own = mine[audit[asked]] == node[want]
        asked, want = asked[~own], want[~own]
        beside, known = _beside(x, least, len(audit))
        beam = BEAM
        while True:
            if beam >= len(x):
                hits = [(k + r, c) for k in range(0, len(y), 256) for r, c in [np.nonzero(y[k : k + 256] @ x.T >= least)]]
                i, j = (np.concatenate(z) for z in zip(*hits, strict=True))
                break
            p, c = graph.links(beside, least - SLACK, beam)
            reached = np.zeros(len(known), bool)
            reached[p[known[p] == c]] = True
            if reached.mean() < recall:
                beam *= 2
                continue
            i, j = graph.links(y, least - SLACK, beam)
            sure = np.concatenate([np.einsum("ij,ij->i", y[i[k : k + 65536]], x[j[k : k + 65536]]) for k in range(0, len(i), 65536)] or [np.zeros(0)]) >= least
            i, j = i[sure], j[sure]
            got = np.isin(audit[asked] * len(x) + want, i * len(x) + j)
            if _mean_recall(asked, got) >= recall:
                break
            beam *= 2
        other = mine[i] != node[j]
        i, j = i[other], j[other]
        count = np.bincount(i, times[j], len(mine)).astype(np.int64)
        ids, at = np.unique(np.concatenate((mine, node)), return_inverse=True)
        label = least_labels(at[i], at[len(mine) + j], len(ids))
        leader = ids[label]
        touched = np.unique(at[len(mine) + j])
        out_node = np.concatenate((mine[count > 0], ids[touched]))
        out_count = np.concatenate((count[count > 0], np.zeros(len(touched), np.int64)))
        out_leader = np.concatenate((leader[at[: len(mine)]][count > 0], leader[touched]))
        return pa.table({"node": pa.array(out_node), "n_links": pa.array(out_count), "leader": pa.array(out_leader)})

    keys = ["label", "dim", "own", "target"]
    found = spread.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(search, "node long, n_links long, leader long")
    found = materialize(found, "found")
    counts = found.groupBy("node").agg(F.sum("n_links").alias("links"))
    component = connected_components(found.where("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")))
    known = classes.join(counts, "node", "left").join(component, "node", "left")
    known = materialize(known.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("links"), F.coalesce("component", "node").alias("component")), "known")
    out = keyed.join(known, ["h1", "h2"], "left")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"), F.coalesce(F.coalesce("component", "vec_id") == F.col("vec_id"), F.lit(False)).alias("kept"))


def op10_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Classes of embeddings of one label whose cosine is 0.98 or more."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP10_SQL = """
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM e x JOIN e y ON x.label = y.label AND x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.v, y.v) >= 0.98),
n AS (SELECT a, count(*) AS n FROM l GROUP BY 1),
r AS (
  WITH RECURSIVE reach(a, b) AS (SELECT a, b FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b)
  SELECT a, min(b) AS m FROM reach GROUP BY 1)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, least(e.vec_id, coalesce(r.m, e.vec_id)) AS component_id, least(e.vec_id, coalesce(r.m, e.vec_id)) = e.vec_id AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN r ON r.a = e.vec_id
"""

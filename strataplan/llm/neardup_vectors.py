"""Embedding near-duplicates: hierarchical navigable small-world graphs per shard.

Vectors of one label are dealt to shards by a hash; each shard of at most about ``SHARD``
distinct vectors gets its own graph. Every vector of the label queries every shard of it: its own
where the graph is built, the others in blocks of one graph and at most ``PACK`` shards of queries, so
a task's memory is bounded and a graph moves once a pack. In a shard, a search returns all vectors it
can reach with cosine >= threshold: a beam search from the top layer, and then an expansion over the
base layer from what was found. Found pairs are verified in double precision.

Audit: queries likely to have links (some found, or a neighbour at ``LIKELY`` or more) are compared
with an exact scan in seeded order until ``ENOUGH`` true links have been seen or no such query is left,
and so are ``OTHERS`` of the rest. The beam doubles until no audited link is missing; at the width of
the shard the search is the exact scan. Queries of other shards start at the beam that the shard's own
audit reached. :func:`audits` returns what was audited.

Equal vectors are one node with a count, so a common vector costs one search. A task returns
each node's link count and a spanning forest, never the pairs; components are joined globally.

Defined results: rows with a null label, and vectors that are null, empty, zero or hold null or non-finite
components link with nothing; vectors of different length do not link; repeated rows are returned
each and link with each other; different vectors of one id are nodes of their own; rows of null id link like others,
and a component without any id has a null one; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SHARD, PACK, DEGREE, BUILD_BEAM, FIRST_BEAM = 8192, 16, 12, 48, 48
AUDIT, ENOUGH, OTHERS, LIKELY = 256, 500, 64, 0.85
THRESHOLD = 0.93


class Graph:
    """A layered small-world graph over unit vectors; layers are neighbour tables padded by -1.

    Nodes are inserted in blocks: a block searches the graph made so far, and looks at its own
    earlier rows exactly; links are chosen for diversity and linked back."""

    def __init__(self, unit: np.ndarray, seed: int = 3):
        self.x = unit
        n = len(unit)
        rng = np.random.default_rng(seed)
        level = np.minimum((-np.log(rng.random(n) + 1e-12) / np.log(DEGREE)).astype(int), 6)
        order = np.argsort(-level, kind="stable")  # upper layers first: row 0 is the entry
        self.ids = order
        self.v = unit[order].astype(np.float32)
        self.level = level[order]
        self.layers = [np.full((int((self.level >= k).sum()), 2 * DEGREE), -1, dtype=np.int32) for k in range(int(self.level.max(initial=0)) + 1)]
        done, block = 1, 16
        while done < n:
            end = min(n, done + block)
            self._insert(done, end)
            done, block = end, min(512, block * 2)
        self._both_ways()

    @classmethod
    def load(cls, unit: np.ndarray, packed: tuple) -> Graph:
        """The graph of the same vectors from :meth:`pack`."""
        self = cls.__new__(cls)
        self.x = unit
        self.ids, self.level, self.layers = packed
        self.v = unit[self.ids].astype(np.float32)
        self._both_ways()
        return self

    def pack(self) -> tuple:
        return self.ids, self.level, self.layers

    def _both_ways(self) -> None:
        """Base links in both directions, for the expansion of range searches: a node that nobody
        links to any more is still found from those it links to."""
        n, base = len(self.v), self.layers[0]
        a, c = np.nonzero(base >= 0)
        b = base[a, c].astype(np.int64)
        both = np.unique(np.concatenate([a * n + b, b * n + a]))
        self.ends, self.near = np.searchsorted(both // max(n, 1), np.arange(n + 1)), (both % max(n, 1)).astype(np.int32)

    def _around(self, nodes: np.ndarray) -> np.ndarray:
        return np.concatenate([self.near[self.ends[x] : self.ends[x + 1]] for x in nodes.tolist()])

    def _insert(self, low: int, high: int) -> None:
        q = self.v[low:high]
        at = np.zeros((len(q), 1), dtype=np.int64)
        own = np.tril(q @ q.T, -1) - 3 * np.triu(np.ones((len(q), len(q)), dtype=np.float32))
        for k in range(len(self.layers) - 1, -1, -1):
            at, sim = self._beam(q, at, k, BUILD_BEAM, low)
            mine = np.flatnonzero(self.level[low:high] >= k)
            if not len(mine):
                continue
            near = np.argsort(-own[mine], axis=1)[:, :BUILD_BEAM]
            cand = np.concatenate([at[mine], near + low], axis=1)
            score = np.concatenate([sim[mine], np.take_along_axis(own[mine], near, 1)], axis=1)
            best = np.argsort(-score, axis=1)
            cand, score = np.take_along_axis(cand, best, 1), np.take_along_axis(score, best, 1)
            for r, row in enumerate(mine.tolist()):
                node = low + row
                chosen = self._diverse(cand[r][score[r] > -1.5])
                self.layers[k][node, : len(chosen)] = chosen
                for c in chosen:
                    self._link(k, c, node)

    def _diverse(self, cand: np.ndarray) -> list[int]:
        """Nearest first; a candidate closer to a chosen one than to the node is passed over,
        and passed-over ones fill what stays free."""
        cand = cand[: 2 * DEGREE]
        if len(cand) <= DEGREE:
            return cand.tolist()
        v = self.v[cand]
        among = v @ v.T
        picked, rest = [0], []
        for i in range(1, len(cand)):
            if len(picked) == DEGREE:
                break
            (rest if among[i, picked].max() > 0.98 else picked).append(i)
        return cand[[*picked, *rest][:DEGREE]].tolist()

    def _link(self, k: int, a: int, b: int) -> None:
        row = self.layers[k][a]
        free = np.flatnonzero(row < 0)
        if len(free):
            row[free[0]] = b
            return
        # full: keep a spread, the nearest half and of the farther half those linked first
        all_ = np.append(row, b)
        sim = self.v[all_] @ self.v[a]
        keep = np.argsort(-sim, kind="stable")
        drop = keep[-1] if (a + b) % 2 else keep[DEGREE]
        row[:] = np.delete(all_, drop)

    def _beam(self, q: np.ndarray, at: np.ndarray, k: int, beam: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Best ``beam`` rows below ``limit`` for each query by a vectorised beam search."""
        table = self.layers[k]
        size = min(len(table), limit)
        n = len(q)
        seen = np.zeros((n, size + 1), dtype=bool)
        at = np.where((at >= 0) & (at < size), at, size)
        rows = np.arange(n)[:, None]
        sim = np.where(at < size, np.einsum("qd,qbd->qb", q, self.v[np.minimum(at, size - 1)]), -2).astype(np.float32)
        seen[rows, at] = True
        open_ = at < size
        while open_.any():
            score = np.where(open_, sim, -3)
            pick = np.argsort(-score, axis=1)[:, :4]
            active = np.take_along_axis(open_, pick, 1)
            open_[rows, pick] = False
            nodes = np.where(active, np.take_along_axis(at, pick, 1), size)
            nb = np.where(nodes[..., None] < size, table[np.minimum(nodes, len(table) - 1)], -1).reshape(n, -1).astype(np.int64)
            nb = np.where((nb < 0) | (nb >= size), size, nb)
            nb = np.sort(nb, axis=1)
            nb[:, 1:][nb[:, 1:] == nb[:, :-1]] = size
            nb = np.where(seen[rows, nb], size, nb)
            live = np.flatnonzero((nb < size).any(axis=1))
            if not len(live):
                if not open_.any():
                    break
                continue
            sub = nb[live]
            ok = sub < size
            new = np.full(sub.shape, -2, dtype=np.float32)
            r, c = np.nonzero(ok)
            new[r, c] = np.einsum("nd,nd->n", q[live[r]], self.v[sub[r, c]])
            seen[live[r], sub[r, c]] = True
            at_l = np.concatenate([at[live], sub], axis=1)
            sim_l = np.concatenate([sim[live], new], axis=1)
            open_l = np.concatenate([open_[live], ok], axis=1)
            width = min(beam, at_l.shape[1])
            best = np.argpartition(-sim_l, width - 1, axis=1)[:, :width]
            if at.shape[1] < width:
                pad = width - at.shape[1]
                at = np.pad(at, ((0, 0), (0, pad)), constant_values=size)
                sim = np.pad(sim, ((0, 0), (0, pad)), constant_values=-2)
                open_ = np.pad(open_, ((0, 0), (0, pad)))
            at[live, :], sim[live, :], open_[live, :] = size, -2, False
            cols = np.arange(width)
            at[live[:, None], cols] = np.take_along_axis(at_l, best, 1)
            sim[live[:, None], cols] = np.take_along_axis(sim_l, best, 1)
            open_[live[:, None], cols] = np.take_along_axis(open_l, best, 1)
        return np.where(at < size, at, -1), sim  # positions of one layer's padding are rows of the next

    def within(self, q: np.ndarray, threshold: float, beam: int) -> tuple[list[np.ndarray], np.ndarray]:
        """For each unit query the shard positions found with cosine >= threshold, and the second
        best similarity seen."""
        n = len(self.v)
        if beam >= n:
            return [np.flatnonzero(s >= threshold) for b in range(0, len(q), 512) for s in q[b : b + 512] @ self.x.T], np.ones(len(q))
        out, second = [], []
        f = q.astype(np.float32)
        for b in range(0, len(q), 512):
            part = f[b : b + 512]
            at = np.zeros((len(part), 1), dtype=np.int64)
            for k in range(len(self.layers) - 1, 0, -1):
                at, _ = self._beam(part, at, k, 4, n)
            at, sim = self._beam(part, at, 0, beam, n)
            second.append(np.partition(sim, -2, axis=1)[:, -2] if sim.shape[1] > 1 else np.full(len(part), -2.0))
            for i in range(len(part)):
                found = fresh = np.unique(at[i][(sim[i] >= threshold - 1e-4) & (at[i] >= 0)])
                looked = np.zeros(n, dtype=bool)
                looked[found] = True
                while len(fresh):  # everything linked to what was found
                    nb = np.unique(self._around(fresh))
                    nb = nb[~looked[nb]]
                    looked[nb] = True
                    fresh = nb[self.v[nb] @ part[i] >= threshold - 1e-4]
                    found = np.concatenate([found, fresh])
                exact = self.x[self.ids[found]] @ q[b + i]
                out.append(np.sort(self.ids[found[exact >= threshold]]))
        return out, np.concatenate([*second, np.zeros(0)])


def search(graph: Graph, q: np.ndarray, threshold: float, beam: int = FIRST_BEAM, own: int = 0, seed: int = 9) -> tuple[list[np.ndarray], dict]:
    """Range search with audited beams: positions per query, and the last audit. ``own`` is 1 where
    the queries are the graph's vectors, which find themselves."""
    order = np.random.default_rng(seed).permutation(len(q))
    while True:
        found, second = graph.within(q, threshold, beam)
        audit = {"beam": min(beam, len(graph.v)), "queries": 0, "links": 0, "missed": 0}
        if beam >= len(graph.v):
            return found, audit
        hits = np.array([len(f) for f in found], dtype=np.int64) - own
        likely = ((hits > 0) | (second >= LIKELY))[order]
        for queries, enough in ((order[likely], ENOUGH), (order[~likely][:OTHERS], np.inf)):
            seen = audit["links"]
            for low in range(0, len(queries), AUDIT):
                for i, s in zip(part := queries[low : low + AUDIT], q[part] @ graph.x.T):
                    truth = np.flatnonzero(s >= threshold)
                    audit["links"] += len(truth) - own
                    audit["missed"] += len(np.setdiff1d(truth, found[i]))
                audit["queries"] += len(part)
                if audit["missed"] or audit["links"] - seen >= enough:
                    break
        if not audit["missed"]:
            return found, audit
        beam *= 2


def mutual(found: list[np.ndarray], block: int = 8_000_000) -> list[np.ndarray]:
    """Links of a shard with itself hold both ways: add those found from one end only."""
    n = len(found)
    flat = np.concatenate([*found, np.zeros(0, np.int64)]).astype(np.int32)
    src = np.repeat(np.arange(n, dtype=np.int32), [len(f) for f in found])
    out = list(found)
    parts = max(1, -(-len(flat) // block))
    for low in range(0, n, -(-n // parts)):
        high = min(n, low + -(-n // parts))
        a, b = (src >= low) & (src < high), (flat >= low) & (flat < high)
        for key in np.setdiff1d(flat[b].astype(np.int64) * n + src[b], src[a].astype(np.int64) * n + flat[a]).tolist():
            out[key // n] = np.append(out[key // n], key % n)
    return out


def nodes(vectors: DataFrame) -> DataFrame:
    """Distinct usable vectors: ``(label, vec array<double>, first, n)``; first is the smallest id."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    usable = F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall(
        "vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("vec", lambda x: x != 0)
    return vectors.withColumn("vec", v).where(usable).groupBy("label", F.transform("vec", lambda x: x + F.lit(0.0)).alias("vec")).agg(F.min("vec_id").alias("first"), F.count("*").alias("n"))


def numbered(distinct: DataFrame) -> DataFrame:
    """The stored vectors with a number ``node`` of their own: an id may have several, or none."""
    return common.store(distinct.withColumn("node", F.monotonically_increasing_id()))


def _raw(vecs) -> np.ndarray:
    """The vectors; in single precision where that holds them exactly."""
    x = np.array([np.asarray(v, dtype=np.float64) for v in vecs])
    with np.errstate(over="ignore"):
        small = x.astype(np.float32)
    return small if (small == x).all() else x


def _unit(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest position of each position's component under the links a - b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for at in (a, b, label[a], label[b]):
            np.minimum.at(new, at, low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return label
        label = new


def _flat(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Links of queries as two arrays: query and position."""
    return np.repeat(np.arange(len(found)), [len(f) for f in found]), np.concatenate([*found, np.zeros(0, np.int64)]).astype(np.int64)


def _moved(ids: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(label != np.arange(len(label)))
    return ids[at], ids[label[at]]


_SHARD = "dims int, shard int, shards int, vectors binary, graph binary, beam int, audited long, links long, a array<bigint>, b array<bigint>, n array<struct<node:bigint,near:bigint>>"


def shards(distinct: DataFrame, threshold: float = THRESHOLD, shard: int = SHARD) -> DataFrame:
    """One row a shard: its vectors, ids and counts; its graph; the links within it: forest edges
    ``a, b`` and link counts ``n``; and its audit."""
    sizes = distinct.groupBy("label", F.size("vec").alias("dims")).agg(F.ceil(F.count("*") / F.lit(shard)).cast("int").alias("shards"))
    dealt = distinct.withColumn("dims", F.size("vec")).join(sizes, ["label", "dims"]).withColumn("shard", F.pmod(F.xxhash64("vec", F.lit(5)), "shards").cast("int"))

    def build(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("node", ignore_index=True)
        raw, ids, n = _raw(f["vec"]), f["node"].to_numpy(np.int64), f["n"].to_numpy(np.int64)
        x = _unit(raw)
        graph = Graph(x)
        found, audit = search(graph, x, threshold, own=1)
        q, hit = _flat(mutual(found))
        q, hit = q[q != hit], hit[q != hit]
        count = np.bincount(q, weights=n[hit], minlength=len(ids)).astype(np.int64)
        a, b = _moved(ids, _roots(len(ids), q, hit))
        near = [{"node": int(i), "near": int(c)} for i, c in zip(ids[count > 0], count[count > 0])]
        return pd.DataFrame({
            "label": [f["label"].iloc[0]], "dims": [int(key[1])], "shard": [int(key[2])], "shards": [int(f["shards"].iloc[0])], "vectors": [pickle.dumps((raw, ids, n))], "graph": [pickle.dumps(graph.pack())],
            "beam": [audit["beam"]], "audited": [audit["queries"]], "links": [audit["links"]], "a": [a], "b": [b], "n": [near]})

    return dealt.groupBy("label", "dims", "shard").applyInPandas(build, f"label {distinct.schema['label'].dataType.simpleString()}, {_SHARD}")


def across(stored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Links between shards of a label: ``(a, b, near)``, forest edges and, with b null, link counts
    of a. A group is one shard's graph and a pack of later shards' vectors."""
    packs = F.explode(F.sequence(F.lit(0), F.floor((F.col("shards") - 1) / PACK).cast("int")))
    graph = stored.where("shards > 1").select("label", "dims", F.col("shard").alias("target"), packs.alias("pack"), F.lit(-1).alias("source"), "vectors", "graph", "beam")
    targets = F.explode(F.sequence(F.lit(0), F.col("shard") - 1))
    queries = stored.where("shard > 0").select("label", "dims", targets.alias("target"), F.floor(F.col("shard") / PACK).cast("int").alias("pack"), F.col("shard").alias("source"), "vectors", F.lit(None).cast("binary").alias("graph"), "beam")

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"a": [], "b": [], "near": []}).astype("Int64")
        at, asks = f[f["source"] < 0], f[f["source"] >= 0]
        if not len(asks):  # packs of earlier shards only
            return none
        raw, ids, n = pickle.loads(at["vectors"].iloc[0])
        graph = Graph.load(_unit(raw), pickle.loads(at["graph"].iloc[0]))
        out, back = [], np.zeros(len(ids), np.int64)
        for blob in asks["vectors"]:
            qraw, qids, qn = pickle.loads(blob)
            found, _ = search(graph, _unit(qraw), threshold, int(at["beam"].iloc[0]))
            q, hit = _flat(found)
            count = np.bincount(q, weights=n[hit], minlength=len(qids)).astype(np.int64)
            back += np.bincount(hit, weights=qn[q], minlength=len(ids)).astype(np.int64)
            a, b = _moved(np.concatenate([ids, qids]), _roots(len(ids) + len(qids), len(ids) + q, hit))
            out += [pd.DataFrame({"a": a, "b": b, "near": 0}), pd.DataFrame({"a": qids, "b": pd.NA, "near": count})]
        out = pd.concat([*out, pd.DataFrame({"a": ids, "b": pd.NA, "near": back})]).astype("Int64")
        return out[out["b"].notna() | (out["near"] > 0)]

    return graph.unionByName(queries).groupBy("label", "dims", "target", "pack").applyInPandas(run, "a long, b long, near long")


def audits(vectors: DataFrame, threshold: float = THRESHOLD, shard: int = SHARD) -> DataFrame:
    """What the shards' own audits saw: ``label, dims, shard, beam, audited, links``; no audited link
    is missed (a beam of the shard's size is the exact scan and needs no audit)."""
    return shards(numbered(nodes(vectors)), threshold, shard).select("label", "dims", "shard", "beam", "audited", "links")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, shard: int = SHARD) -> DataFrame:
    """``vectors(vec_id, embedding, label)`` with ``n_links``, ``component_id`` and ``kept``."""
    distinct = numbered(nodes(vectors))
    built = common.store(shards(distinct, threshold, shard))
    found = common.store(across(built, threshold))
    within = built.select(F.explode(F.arrays_zip("a", "b")).alias("e")).select("e.a", "e.b")
    counts = built.select(F.explode("n").alias("c")).select(F.col("c.node").alias("a"), "c.near").unionByName(found.where("b IS NULL").select("a", "near"))
    near = counts.groupBy("a").agg(F.sum("near").alias("near"))
    comp = common.components(within.unionByName(found.where("b IS NOT NULL").select("a", "b"))).withColumnRenamed("node", "_node")
    whole = distinct.select("label", "vec", "node", "first", "n").join(near, F.col("node") == F.col("a"), "left").join(comp, F.col("node") == F.col("_node"), "left").withColumn("part", F.coalesce("component", "node"))
    smallest = whole.groupBy("part").agg(F.min("first").alias("component_id"))
    named = whole.join(smallest, "part").select(F.col("label").alias("_label"), F.col("vec").alias("_vec"), (F.coalesce("near", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id", F.lit(True).alias("_linked"))
    mine = vectors.select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0)).alias("_v"))
    out = mine.join(named, (F.col("label") == F.col("_label")) & (F.col("_v") == F.col("_vec")), "left")
    root = F.when(F.col("_linked"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), root.alias("component_id"), root.eqNullSafe(F.col("vec_id")).alias("kept"))


def op1_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(common.load(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))

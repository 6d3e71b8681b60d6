"""Exact top-k search by inner product: KD-trees per shard.

Components become integers ``floor(64 * x)``, so scores are exact. Equal vectors are one point with its
``k + 1`` smallest ids: no other row of the vector can be among the k best of any query (ties go to the smaller
id, and a query loses its own row only).

Points are dealt to at most ``CELLS`` cells by median splits of a bounded sample (``SAMPLE`` points; the split
affects speed alone), and a cell's points by a hash to shards of about ``SHARD``. Each shard builds a tree of
median splits along the widest dimension, with the tight bounding box of every node. The bound of a box for a
query is the largest inner product any of its corners has. A search opens the node of highest bound
first, for all queries of a block at once, and ends when no open node's bound reaches the kth score.

The queries of a shard search their own shard first. The kth score found goes with them: they are sent only to the
cells whose box can still reach it, and start there from it. A task holds one tree and at most ``PACK``
shards' queries.

Defined results: rows whose vector is null or holds null or non-finite components take no part; vectors
of different lengths do not meet; rows of null id are candidates, after all ids of equal score, and no queries; of repeated
rows each is a query and a candidate, a query leaves out one row only, its own; scores beyond a long count
as its bound; fewer than k candidates are all returned; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, vectors

SCALE, EVERY, K = 64, 20, 20
SHARD, LEAF, CELLS, SAMPLE, BLOCK, PACK = 8192, 256, 1024, 16384, 512, 16

_HITS = "q long, score long, none boolean, id long, own boolean"


class Tree:
    """A KD-tree over integer vectors; row 0 is the root, leaves are ranges of the reordered points.
    ``order`` is each point's place by id: of equal scores the smaller place is better."""

    def __init__(self, x: np.ndarray, order: np.ndarray, leaf: int = LEAF):
        place = np.arange(len(x))
        lo, hi, left, right, start, end = [], [], [], [], [], []

        def add(low: int, high: int) -> int:
            own = x[place[low:high]]
            lo.append(own.min(axis=0))
            hi.append(own.max(axis=0))
            for column, v in ((left, -1), (right, -1), (start, low), (end, high)):
                column.append(v)
            return len(lo) - 1

        todo = [add(0, len(x))]
        while todo:
            at = todo.pop()
            low, high = start[at], end[at]
            wide = hi[at].astype(object) - lo[at].astype(object)
            if high - low <= leaf or not max(wide, default=0):
                continue
            axis = int(np.argmax(wide.astype(np.float64)))
            mid = (low + high) // 2
            part = place[low:high]
            place[low:high] = part[np.argpartition(x[part, axis], mid - low)]
            left[at], right[at] = add(low, mid), add(mid, high)
            todo += [left[at], right[at]]
        self.x, self.order, self.place = x[place], order[place], place
        self.lo, self.hi = np.array(lo), np.array(hi)
        self.left, self.right, self.start, self.end = (np.array(c, dtype=np.int64) for c in (left, right, start, end))

    def search(self, q: np.ndarray, kth: list[int], k: int) -> list[list[tuple[int, int]]]:
        """For each query its k best ``(score, point)``, points of scores below its ``kth`` excepted."""
        out: list[list[tuple[int, int]]] = []
        for at in range(0, len(q), BLOCK):
            out += self._block(q[at : at + BLOCK], kth[at : at + BLOCK], k)
        return out

    def _block(self, q: np.ndarray, kth: list[int], k: int) -> list[list[tuple[int, int]]]:
        n, m, d = len(self.x), len(q), q.shape[1]
        most = max(1, d) * vectors.largest(q) * vectors.largest(self.x)
        whole = most >= 2**52 or (most + 1) * n >= 2**60  # beyond double precision and longs: Python integers
        num, key = (object, object) if whole else (np.float32 if most < 2**24 else np.float64, np.int64)
        none = -(most + 1)  # below every score
        x, lo, hi, qs = (a.astype(num) for a in (self.x, self.lo, self.hi, q))
        up, down = np.maximum(qs, 0), np.minimum(qs, 0)
        held = np.frompyfunc(vectors.clipped, 1, 1) if whole else (lambda v: v.astype(key))
        none = vectors.clipped(none) - 1 if whole else none
        least = np.array([max(none, int(v)) for v in kth], dtype=key)
        best = np.full((m, k), none * n, dtype=key)  # score * n + (n - 1 - order): no two are equal
        open_ = np.full((m, len(lo)), none, dtype=key)
        open_[:, 0] = held((up * hi[0] + down * lo[0]).sum(axis=1))
        live = np.arange(m)
        while len(live):
            at = open_[live].argmax(axis=1)
            bound = open_[live, at]
            go = (bound > none) & (bound >= least[live])
            live, at = live[go], at[go]
            open_[live, at] = none
            split = self.left[at] >= 0
            rows = live[split]
            for child in (self.left[at[split]], self.right[at[split]]):
                open_[rows, child] = held((up[rows] * hi[child] + down[rows] * lo[child]).sum(axis=1))
            for leaf in np.unique(at[~split]).tolist():
                rows, low, high = live[~split & (at == leaf)], self.start[leaf], self.end[leaf]
                score = held(qs[rows] @ x[low:high].T)
                keys = np.concatenate([best[rows], score * n + (n - 1 - self.order[low:high])], axis=1)
                keys = np.sort(keys, axis=1)[:, -k:] if whole else np.partition(keys, keys.shape[1] - k, axis=1)[:, -k:]
                best[rows] = keys
                least[rows] = np.maximum(least[rows], keys.min(axis=1) // n)
        by_order = np.empty(n, dtype=np.int64)
        by_order[self.order] = self.place
        found = []
        for row, low in zip(np.sort(best, axis=1)[:, ::-1].tolist(), kth):
            found.append([(v // n, int(by_order[n - 1 - v % n])) for v in row if v > none * n and v // n >= low])
        return found


def points(rows: DataFrame, every: int, k: int) -> DataFrame:
    """Distinct vectors: ``node, x, ids array<struct<none, id>>``, the k + 1 first ids, and ``asks``, whether
    a row of it is a query."""
    first = rows.withColumn("_r", F.row_number().over(Window.partitionBy("x").orderBy(F.col("vec_id").asc_nulls_last()))).where(F.col("_r") <= k + 1)
    ids = first.groupBy("x").agg(F.array_sort(F.collect_list(F.struct(F.col("vec_id").isNull().alias("none"), F.coalesce("vec_id", F.lit(0)).cast("long").alias("id")))).alias("ids"))
    asked = queries(rows, every).groupBy("x").agg(F.lit(True).alias("asks"))
    return common.store(ids.join(asked, "x", "left").select(F.monotonically_increasing_id().alias("node"), "x", "ids", F.coalesce("asks", F.lit(False)).alias("asks")))


def queries(rows: DataFrame, every: int) -> DataFrame:
    return rows.where(F.col("vec_id") % every == 0)


def median_splits(x: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Axis and value of each inner node of a full tree of the depth, in heap order; larger values go right."""
    axis, value = np.zeros(2**depth - 1, dtype=np.int64), np.zeros(2**depth - 1, dtype=np.int64)
    held = {0: x}
    for at in range(len(axis)):
        own = held.pop(at)
        if len(own) and own.shape[1]:
            axis[at] = int(np.argmax(own.max(axis=0).astype(np.float64) - own.min(axis=0)))
            value[at] = int(np.sort(own[:, axis[at]])[(len(own) - 1) // 2])
        right = own[:, axis[at]] > value[at] if own.shape[1] else np.zeros(len(own), dtype=bool)
        held[2 * at + 1], held[2 * at + 2] = own[~right], own[right]
    return axis, value


def dealt(found: DataFrame, d: int, shard: int) -> DataFrame:
    """The points with ``cell`` and ``shard``."""
    n = found.count()
    depth = 0
    while 2**depth < min(CELLS, -(-n // shard)):
        depth += 1
    sample = found.select("x").orderBy(F.xxhash64("node")).limit(SAMPLE).toArrow().column("x").combine_chunks() if depth else None
    axis, value = median_splits(vectors.matrix(sample, d), depth) if depth else (None, None)

    def run(batches):
        for b in batches:
            x, at = vectors.matrix(b.column("x"), d), np.zeros(b.num_rows, dtype=np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[np.arange(len(x)), axis[at]] > value[at]) if d else 2 * at + 1
            yield b.append_column("cell", _array(at - (2**depth - 1)))

    placed = found.mapInArrow(common.lean(run), "node long, x array<long>, ids array<struct<none:boolean,id:long>>, asks boolean, cell int")
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(shard)).cast("int").alias("shards"))  # at most CELLS rows
    return placed.join(F.broadcast(sizes), "cell").withColumn("shard", F.pmod(F.xxhash64("node", F.lit(7)), "shards").cast("int"))


def _array(x: np.ndarray):
    import pyarrow as pa

    return pa.array(x.astype(np.int32))


def _hits(tree: Tree, nodes: np.ndarray, ids: list, asks: np.ndarray, found: list, k: int) -> pd.DataFrame:
    """Found points as rows, ids written out: the k + 1 best rows of each query."""
    out = []
    for q, best in zip(asks.tolist(), found):
        rows = sorted((-score, none, i, nodes[point] != q) for score, point in best for none, i in ids[point])
        out += [(q, -score, none, i, not other) for score, none, i, other in rows[: k + 1]]
    return pd.DataFrame(out, columns=["q", "score", "none", "id", "own"])


def shards(placed: DataFrame, d: int, k: int) -> DataFrame:
    """One row a shard: its box, its tree, the queries among its points with the kth score found at home, and
    what they found there."""

    def build(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        x = vectors.narrow(np.array(f["x"].tolist(), dtype=np.int64).reshape(len(f), d))
        ids = [[(bool(i["none"]), int(i["id"])) for i in own] for own in f["ids"]]
        nodes = f["node"].to_numpy(np.int64)
        first = sorted(range(len(f)), key=lambda i: ids[i][0])
        order = np.empty(len(f), dtype=np.int64)
        order[first] = np.arange(len(f))
        tree = Tree(x, order)
        ask = np.flatnonzero(f["asks"].to_numpy(bool))
        found = tree.search(x[ask], [-(2**200)] * len(ask), k + 1)
        kth = [best[k][0] if len(best) > k else -(2**200) for best in found]
        hits = _hits(tree, nodes, ids, nodes[ask], found, k)
        return pd.DataFrame({
            "cell": [int(key[0])], "shard": [int(key[1])], "shards": [int(f["shards"].iloc[0])], "low": [[int(v) for v in tree.lo[0]]], "high": [[int(v) for v in tree.hi[0]]],
            "tree": [pickle.dumps((tree, nodes, ids))], "asks": [pickle.dumps((nodes[ask], x[ask], kth)) if len(ask) else None], "hits": [hits.to_dict("records")]})

    return placed.groupBy("cell", "shard").applyInPandas(build, f"cell int, shard int, shards int, low array<long>, high array<long>, tree binary, asks binary, hits array<struct<{_HITS.replace(' ', ':').replace(',:', ',')}>>")


def sent(built: DataFrame, d: int) -> DataFrame:
    """The queries of each shard for every cell whose box can reach their kth scores: ``cell, asks, home_cell,
    home_shard``."""
    boxes = built.groupBy("cell").agg(*[F.min(F.col("low")[i]).alias(f"l{i}") for i in range(d)], *[F.max(F.col("high")[i]).alias(f"h{i}") for i in range(d)]).toPandas() if d else built.select("cell").distinct().toPandas()
    cells = boxes["cell"].to_numpy(np.int64)  # at most CELLS rows
    low, high = (boxes[[f"{c}{i}" for i in range(d)]].to_numpy(np.int64).reshape(len(cells), d) for c in "lh")

    def run(frames):
        for f in frames:
            for home_cell, home_shard, blob in zip(f["cell"], f["shard"], f["asks"]):
                nodes, x, kth = pickle.loads(blob)
                most = max(1, d) * vectors.largest(x) * max(vectors.largest(low), vectors.largest(high))
                num = object if most >= 2**52 else np.float64
                q, lo, hi = (a.astype(num) for a in (x, low, high))
                bound = np.maximum(q, 0) @ hi.T + np.minimum(q, 0) @ lo.T
                bound = np.frompyfunc(vectors.clipped, 1, 1)(bound) if num is object else bound
                least = np.array([max(v, -(2**63) if num is object else -most - 1) for v in kth], dtype=num)
                for c, cell in enumerate(cells.tolist()):
                    go = np.flatnonzero(bound[:, c] >= least)
                    if len(go):
                        yield pd.DataFrame({"cell": [cell], "asks": [pickle.dumps((nodes[go], x[go], [kth[i] for i in go.tolist()]))], "home_cell": [home_cell], "home_shard": [home_shard]})

    return built.where("asks IS NOT NULL").select("cell", "shard", "asks").mapInPandas(common.lean(run), "cell int, asks binary, home_cell int, home_shard int")


def elsewhere(built: DataFrame, d: int, k: int) -> DataFrame:
    """What the queries find outside their own shards."""
    packs = -(-built.where("asks IS NOT NULL").count() // PACK)
    sizes = built.groupBy("cell").agg(F.max("shards").alias("shards"))  # at most CELLS rows
    asks = sent(built, d).join(F.broadcast(sizes), "cell").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    asks = asks.where((F.col("cell") != F.col("home_cell")) | (F.col("shard") != F.col("home_shard"))).select(
        "cell", "shard", F.pmod(F.xxhash64("home_cell", "home_shard"), F.lit(max(1, packs))).cast("int").alias("pack"), "asks", F.lit(None).cast("binary").alias("tree"))
    trees = built.select("cell", "shard", F.explode(F.sequence(F.lit(0), F.lit(max(1, packs) - 1))).alias("pack"), F.lit(None).cast("binary").alias("asks"), "tree")

    def run(f: pd.DataFrame) -> pd.DataFrame:
        at, ask = f[f["tree"].notna()], f[f["asks"].notna()]
        out = [pd.DataFrame({"q": [], "score": [], "none": [], "id": [], "own": []})]
        if len(ask):
            tree, nodes, ids = pickle.loads(at["tree"].iloc[0])
            for blob in ask["asks"]:
                own, x, kth = pickle.loads(blob)
                out.append(_hits(tree, nodes, ids, own, tree.search(x, kth, k + 1), k))
        out = [o for o in out if len(o)]
        return pd.concat(out) if out else pd.DataFrame({"q": [], "score": [], "none": [], "id": [], "own": []})

    return trees.unionByName(asks).groupBy("cell", "shard", "pack").applyInPandas(run, _HITS)


def top_k(table: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE, shard: int = SHARD) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best other rows of ``table(vec_id, embedding)`` for each row whose
    id is divisible by ``every``."""
    rows = common.store(vectors.integer_vectors(table, scale, "vec_id"))
    out = rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    for d, part in vectors.by_length(rows):
        found = points(part, every, k)
        built = common.store(shards(dealt(found, d, shard), d, k))
        hits = built.select(F.inline("hits")).unionByName(elsewhere(built, d, k))
        best = Window.partitionBy("q").orderBy(F.desc("score"), "none", "id", F.desc("own"))
        hits = hits.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k + 1)
        top = hits.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("_r", "score", "none", "id", "own"))).alias("top"))
        asked = queries(part, every).select(F.col("vec_id").cast("long").alias("query_id"), "x").join(found.select("node", "x"), "x").select("query_id", F.col("node").alias("q"))
        mine = F.array_position(F.transform("top", lambda t: t.own & ~t.none & (t.id == F.col("query_id"))), True)  # 0: not among the first
        answers = asked.join(top, "q").withColumn("_own", mine).select("query_id", F.posexplode(F.slice(F.filter("top", lambda t, i: i != F.col("_own") - 1), 1, k)).alias("pos", "t"))
        out = out.unionByName(answers.select("query_id", (F.col("pos") + 1).alias("rank"), F.when(~F.col("t.none"), F.col("t.id")).alias("vec_id"), "t.score"))
    return out


def op12_exact_top_k(spark, sf_dir: str) -> DataFrame:
    return top_k(common.load(spark, sf_dir, "embeddings"))


OP12_SQL = f"""
WITH kept AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda c: floor({SCALE} * c::DOUBLE)) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)
, scored AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score FROM kept q, kept c WHERE q.vec_id % {EVERY} = 0 AND q.rid <> c.rid)
SELECT query_id, rank, vec_id, score FROM (SELECT *, (row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id NULLS LAST))::INTEGER AS rank FROM scored) WHERE rank <= {K}
"""

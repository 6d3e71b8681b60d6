"""Whitening, exact top-k search and vector codes against brute force on small fixtures."""

import hashlib
import math

import numpy as np
import pytest

from strataplan.llm import codes, topk, vectors, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, w double, node int, cell string, error string"
EXTRA = ("clash", 1.0, 2, "c", None)


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, *EXTRA) for i, v, label in rows], SCHEMA)


def usable(rows):
    return [r for r in rows if r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1])]


def floors(v, scale):
    return [math.floor(float(np.float32(c)) * scale) for c in v]


@pytest.fixture(scope="module")
def edge_rows():
    """A hot vector, repeated rows, repeated ids of other vectors, null ids and labels, bad vectors."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 16))
    rows = [(i, [float(c) for c in np.float32(centres[i % 6] + 0.3 * rng.normal(size=16))], i % 5) for i in range(300)]
    hot = rows[7][1]
    rows += [(1000 + i, hot, 9) for i in range(150)] + [(20, rows[3][1], 1), (20, rows[20][1], 0), (20, rows[20][1], 0), (None, hot, 2), (None, rows[40][1], None), (400, [0.0] * 16, None), (401, [-0.0] * 16, 3)]
    return rows + [(500, None, 1), (501, [float("nan")] * 16, 1), (502, [float("inf")] + [0.0] * 15, 1), (503, [None] + [0.0] * 15, 1), (None, None, None)]


@pytest.fixture(scope="module")
def short_rows():
    """Vectors of other lengths, the empty one among them."""
    return [(600, [1.0, 2.0, 3.0], 1), (620, [3.0, -1.0, 0.5], 1), (640, [], 1), (641, [], None), (660, [2.0**70], 4), (680, [-(2.0**70)], 4), (700, [1.0], 4)]


def test_integer_vectors(spark):
    rows = table(spark, [(1, [0.5, -0.001, -0.0], 1), (2, [3e38, -3e38, 0.0], 1), (3, None, 1), (4, [], 1)])
    got = {r["vec_id"]: r["x"] for r in vectors.integer_vectors(rows, 256, "vec_id").collect()}
    assert got == {1: [128, -1, 0], 2: [2**63 - 1, -(2**63), 0], 4: []}


# op11 -----------------------------------------------------------------------------------------


def brute_whitening(rows, keep=4):
    """By vec_id: rows of (deviation, explained, whitened), whitened as a matrix; and n."""
    xs = [floors(v, 256) for _, v, _ in rows]
    fit = sorted({tuple(x) for x in xs})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    f = np.array(fit, float)
    mean = np.array(sums) / n
    cov = (f - mean).T @ (f - mean) / n
    e, axes = np.linalg.eigh(cov)
    order = np.argsort(-e)[:keep]
    dev = [sum((n * c - s) ** 2 for c, s in zip(x, sums)) for x in xs]
    return n, dev, e[order] / np.trace(cov), (np.array(xs) - mean) @ axes[:, order] / np.sqrt(e[order])


def test_whitening(spark, edge_rows):
    rows = usable(edge_rows)
    n, dev, explained, white = brute_whitening(rows)
    got = whitening.whiten(table(spark, edge_rows)).collect()
    assert len(got) == 4 * len(rows) and {r["n"] for r in got} == {n}
    assert {r["identity_error"] for r in got}.pop() < 1e-9 and len({r["identity_error"] for r in got}) == 1
    for k in range(4):
        mine = [r for r in got if r["component"] == k + 1]
        assert sorted((r["vec_id"] is None, r["vec_id"] or 0, int(r["deviation"])) for r in mine) == sorted((i is None, i or 0, d) for (i, _, _), d in zip(rows, dev))
        assert all(abs(r["explained"] / explained[k] - 1) < 1e-9 for r in mine)
        a = sorted((r["vec_id"], int(r["deviation"]), r["whitened"]) for r in mine if r["vec_id"] is not None)
        b = sorted((i, d, w) for (i, _, _), d, w in zip(rows, dev, white[:, k]) if i is not None)
        sign = np.sign(a[0][2] * b[0][2])
        assert max(abs(x[2] - sign * y[2]) for x, y in zip(a, b)) < 1e-9


def test_whitening_lengths(spark, short_rows):
    got = whitening.whiten(table(spark, short_rows)).collect()
    # of two vectors one direction varies, of one and of the empty ones none
    assert sorted((r["vec_id"], r["component"], r["n"]) for r in got) == [(600, 1, 2), (620, 1, 2), (660, 1, 3), (680, 1, 3), (700, 1, 3)]
    assert {abs(round(r["whitened"], 9)) for r in got if r["n"] == 2} == {1.0}
    assert {r["vec_id"]: r["deviation"] for r in got if r["n"] == 3} == {660: None, 680: None, 700: (3 * 256 - 255) ** 2}  # more digits than 38


def test_whitening_constant_and_empty(spark):
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)])).collect() == []
    assert whitening.whiten(table(spark, [])).collect() == []


# op12 -----------------------------------------------------------------------------------------


def brute_top(rows, k, every):
    xs = [floors(v, 64) for _, v, _ in rows]
    xs = [[max(-(2**63), min(2**63 - 1, c)) for c in x] for x in xs]
    out = []
    for q, (qid, _, _) in enumerate(rows):
        if qid is None or qid % every:
            continue
        score = lambda c: max(-(2**63) + 1, min(2**63 - 1, sum(a * b for a, b in zip(xs[q], xs[c]))))
        best = sorted((-score(c), rows[c][0] is None, rows[c][0] or 0) for c in range(len(rows)) if c != q and len(xs[c]) == len(xs[q]))[:k]
        out += [(qid, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(best)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard", [8192, 40])
def test_top_k(spark, edge_rows, short_rows, shard):
    rows = edge_rows + short_rows
    got = topk.top_k(table(spark, rows), shard=shard)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_top(usable(rows), 20, 20)


def test_top_k_packs(spark, edge_rows, monkeypatch):
    monkeypatch.setattr(topk, "PACK", 2)
    monkeypatch.setattr(topk, "BLOCK", 5)
    monkeypatch.setattr(topk, "LEAF", 4)
    rows = usable(edge_rows)
    assert sorted((tuple(r) for r in topk.top_k(table(spark, edge_rows), k=3, every=2, shard=60).collect()), key=repr) == brute_top(rows, 3, 2)


def test_top_k_empty(spark):
    assert topk.top_k(table(spark, [])).collect() == []
    assert topk.top_k(table(spark, [(20, [1.0], 0)])).collect() == []


def test_tree_opens_few_leaves():
    """Boxes prune: a query near one cluster leaves the leaves of others closed, and a kth score that is
    brought along closes more."""
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.integers(0, 9, (500, 3)) + c for c in ([0, 0, 0], [300, 0, 0], [0, 300, 0], [300, 300, 300])])
    tree = topk.Tree(x, np.arange(len(x)), leaf=16)
    read = []
    own = tree.x
    tree.x = type("Seen", (np.ndarray,), {"__getitem__": lambda self, at: (read.append(at), np.ndarray.__getitem__(self, at))[1]})(own.shape, own.dtype, own.copy())
    q = np.array([[1, 1, 1]])
    best = tree.search(q, [-(10**9)], 5)[0]
    score = x @ q[0]
    assert best == [(int(score[i]), int(i)) for i in np.lexsort((np.arange(len(x)), -score))[:5]]
    assert tree.search(q, [best[2][0] + 1], 5)[0] == [b for b in best if b[0] > best[2][0]]


# op13 -----------------------------------------------------------------------------------------


def brute_codes(rows, rounds=6):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, floors(r[1], 4096)))
    xs = [floors(v, 4096) for _, v, _ in rows]
    d = len(xs[0])
    cut = [(p * d // 8, (p + 1) * d // 8) for p in range(8)]
    books = [[x[a:b] for x in xs[:16]] for a, b in cut]
    dist = lambda a, b: sum((u - v) ** 2 for u, v in zip(a, b))

    def assigned():
        return [[min(range(len(books[p])), key=lambda e: (dist(x[a:b], books[p][e]), e)) for p, (a, b) in enumerate(cut)] for x in xs]

    for _ in range(rounds):
        at = assigned()
        for p, (a, b) in enumerate(cut):
            for e in range(len(books[p])):
                if mine := [x[a:b] for x, c in zip(xs, at) if c[p] == e]:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    at = assigned()
    errors = [sum(dist(x[a:b], books[p][c[p]]) for p, (a, b) in enumerate(cut)) for x, c in zip(xs, at)]
    sha = hashlib.sha256(",".join(str(v) for book in books for e in book for v in e).encode()).hexdigest()
    by_label = {}
    for (_, _, label), e in zip(rows, errors):
        by_label[label] = by_label.get(label, 0) + e
    return sorted(((i, "".join(f"{e:02x}" for e in c), e, by_label[label], sha) for (i, _, label), c, e in zip(rows, at, errors)), key=repr)


def test_codes(spark, edge_rows):
    got = codes.compress(table(spark, edge_rows).repartition(7))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_codes(usable(edge_rows))


def test_codes_few_rows_and_lengths(spark):
    rows = [(5, [0.1 * i for i in range(11)], 1), (3, [0.3] * 11, None), (4, [-0.2] * 11, None)]  # 8 does not divide 11
    assert sorted((tuple(r) for r in codes.compress(table(spark, rows)).collect()), key=repr) == brute_codes(rows)
    got = {r["vec_id"]: r for r in codes.compress(table(spark, [*rows, (9, [], 7), (10, [2.0**70] * 8, 8), (11, [-(2.0**70)] * 8, 8)])).collect()}
    assert got[9]["error"] == 0 and got[9]["code"] == "00" * 8 and got[10]["code"] == "00" * 8 and got[11]["code"] == "01" * 8
    assert codes.compress(table(spark, [])).collect() == []


def test_nearest_is_exact():
    rng = np.random.default_rng(8)
    for wide in (5, 2**40):  # the second needs Python integers
        book = rng.integers(-wide, wide, (16, 8)).tolist()
        x = np.concatenate([rng.integers(-wide, wide, (400, 8)), np.array(book), np.array(book[::-1])])
        code, error = codes.nearest(x, book)
        for row, c, e in zip(x.tolist(), code.tolist(), error.tolist()):
            assert (int(e), c) == min((sum((a - b) ** 2 for a, b in zip(row, entry)), i) for i, entry in enumerate(book))

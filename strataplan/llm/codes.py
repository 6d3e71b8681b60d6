"""Vector code compression: product quantisation by partial-distance search.

Components become integers ``floor(4096 * x)``, vectors are cut into 8 parts, and each part position has a
codebook of 16 entries. A part looks for its nearest entry by partial distances: the dimensions are taken in
descending variance of the codebook, squared differences are summed one dimension after the other for all rows of
a block at once, and a mask drops a row from an entry as soon as its sum strictly exceeds the row's best
complete distance. Ties go to the entry of lower index.

A round reads the stored integer vectors once; a partition returns one sum for each part, entry and
dimension, which Spark adds up, so that the driver sees 16 x d sums whatever the number of rows.

Defined results: rows whose vector is null or holds null or non-finite components are left out; vectors of
different lengths have codebooks of their own; a length that 8 does not divide is cut at floor(i * d / 8); fewer than
16 rows make as many entries; the first entries are those of the smallest ids, of one id those of the smallest
integer vector, null ids last; repeated rows count each; distances are exact at any magnitude, and an error beyond a long is
returned as the largest long; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, vectors

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6

#: entries of each part position, a row an entry, as Python integers
Codebooks = list[list[list[int]]]


def cuts(d: int, parts: int) -> list[tuple[int, int]]:
    return [(i * d // parts, (i + 1) * d // parts) for i in range(parts)]


def nearest(x: np.ndarray, book: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Index of each row's nearest entry and the squared distance, by partial-distance search."""
    d = x.shape[1]
    wide = (vectors.largest(x) + max((abs(v) for e in book for v in e), default=0)) ** 2 * max(1, d) >= 2**62
    kind = object if wide else np.int64
    c = np.array(book, dtype=kind).reshape(len(book), d)
    spread = [np.var(np.array([float(v) for v in c[:, j]])) for j in range(d)]
    order = sorted(range(d), key=lambda j: -spread[j])
    columns = [np.ascontiguousarray(x[:, j]).astype(kind) for j in order]
    best = np.zeros(len(x), dtype=kind)
    code = np.zeros(len(x), dtype=np.int64)
    for column, j in zip(columns, order):
        best += (column - c[0, j]) ** 2
    for e in range(1, len(book)):
        rows = np.arange(len(x))
        reached = np.zeros(len(x), dtype=kind)
        for column, j in zip(columns, order):
            reached = reached + (column[rows] - c[e, j]) ** 2
            on = reached <= best[rows]
            if not on.all():
                rows, reached = rows[on], reached[on]
            if not len(rows):
                break
        closer = reached < best[rows]
        best[rows[closer]], code[rows[closer]] = reached[closer], e
    return code, best


def first_books(rows: DataFrame, d: int, parts: int = PARTS, entries: int = ENTRIES) -> Codebooks:
    seeds = [r["x"] for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()]
    return [[[int(v) for v in s[low:high]] for s in seeds] for low, high in cuts(d, parts)]


def improved(rows: DataFrame, books: Codebooks, d: int) -> Codebooks:
    """Each entry's parts' componentwise floor(sum / count); entries of no part stay."""
    spans = cuts(d, len(books))

    def run(batches):
        counts, sums = {}, {}
        for b in batches:
            x = vectors.matrix(b.column("x"), d)
            for p, (low, high) in enumerate(spans):
                code, _ = nearest(x[:, low:high], books[p])
                own = x[:, low:high].astype(object if vectors.largest(x) * len(x) >= 2**62 else np.int64)
                for e in np.unique(code).tolist():
                    mine = own[code == e]
                    counts[p, e] = counts.get((p, e), 0) + len(mine)
                    sums[p, e] = [a + int(v) for a, v in zip(sums.get((p, e), [0] * (high - low)), mine.sum(axis=0))]
        keys = sorted(counts)
        out = [(p, e, j, counts[p, e], Decimal(v)) for p, e in keys for j, v in enumerate(sums[p, e])]
        if out:
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0)))], ["part", "entry", "j", "n", "s"])

    made = rows.select("x").mapInArrow(common.lean(run), "part int, entry int, j int, n long, s decimal(38,0)").groupBy("part", "entry", "j").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    out = [[list(e) for e in book] for book in books]
    for r in made.collect():  # a row for each part, entry and dimension
        out[r["part"]][r["entry"]][r["j"]] = int(r["s"]) // r["n"]
    return out


def encoded(rows: DataFrame, books: Codebooks, d: int) -> DataFrame:
    """The rows with ``code array<int>``, an entry a part, and ``error decimal(38,0)``."""
    spans, names = cuts(d, len(books)), [c for c in rows.columns if c != "x"]

    def run(batches):
        for b in batches:
            x = vectors.matrix(b.column("x"), d)
            found = [nearest(x[:, low:high], book) for (low, high), book in zip(spans, books)]
            codes = np.stack([c for c, _ in found], axis=1).astype(np.int32)
            errors = [Decimal(sum(e)) for e in zip(*[e.tolist() for _, e in found])]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(books)), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], lists, pa.array(errors, pa.decimal128(38, 0))], [*names, "code", "error"])

    return rows.mapInArrow(common.lean(run), ", ".join(f"{c} {t}" for c, t in rows.dtypes if c != "x") + ", code array<int>, error decimal(38,0)")


def digest(books: Codebooks) -> str:
    return hashlib.sha256(",".join(str(v) for book in books for e in book for v in e).encode()).hexdigest()


def fit(rows: DataFrame, d: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    books = first_books(rows, d, parts, entries)
    for _ in range(rounds):
        books = improved(rows, books, d)
    return books


def compress(table: DataFrame) -> DataFrame:
    """``vec_id, code string, error, label_error, codebooks_sha256`` of ``table(vec_id, embedding, label)``."""
    rows = common.store(vectors.integer_vectors(table, SCALE, "vec_id", "label"))
    kinds = dict(rows.dtypes)
    out = rows.sparkSession.createDataFrame([], f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error decimal(38,0), codebooks_sha256 string")
    for d, part in vectors.by_length(rows):
        books = fit(part, d)
        text = F.concat_ws("", F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))))
        out = out.unionByName(encoded(part, books, d).select("vec_id", "label", text.alias("code"), "error", F.lit(digest(books)).alias("codebooks_sha256")))
    done = common.store(out)
    sums = done.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    most = F.lit(Decimal(2**63 - 1))
    long = lambda c: F.least(F.col(c), most).cast("long").alias(c)
    return done.join(sums, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", "code", long("error"), long("label_error"), "codebooks_sha256")


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    return compress(common.load(spark, sf_dir, "embeddings"))


def _round_sql(k: int) -> str:
    """Assignments to the codebooks of round k, and the codebooks of round k + 1."""
    return f""", a{k} AS (SELECT p.rid, p.part, arg_min(b.entry, (d, b.entry)) AS entry, min(d) AS d
  FROM parts p JOIN b{k} b USING (part), LATERAL (SELECT list_sum(list_transform(generate_series(1, len(p.x)), lambda i: (p.x[i] - b.c[i]) * (p.x[i] - b.c[i])))::BIGINT AS d) GROUP BY p.rid, p.part)
, s{k} AS (SELECT part, entry, j, sum(v) AS s, count(*) AS n FROM (SELECT a.part, a.entry, unnest(p.x) AS v, unnest(generate_series(1, len(p.x))) AS j FROM a{k} a JOIN parts p USING (rid, part)) GROUP BY ALL)
, b{k + 1} AS (SELECT b.part, b.entry, coalesce(u.c, b.c) AS c FROM b{k} b LEFT JOIN (SELECT part, entry, list(CAST(floor(s::DOUBLE / n) AS BIGINT) ORDER BY j) AS c FROM s{k} GROUP BY ALL) u USING (part, entry))"""


OP13_SQL = f"""
WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rid, vec_id, label, list_transform(embedding, lambda c: CAST(floor({SCALE} * c::DOUBLE) AS BIGINT)) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)
, parts AS MATERIALIZED (SELECT rid, part, list_slice(x, part * (len(x) // {PARTS}) + 1, (part + 1) * (len(x) // {PARTS})) AS x FROM kept, range({PARTS}) t(part))
, b0 AS (SELECT part, rid - 1 AS entry, x AS c FROM parts WHERE rid <= {ENTRIES}){"".join(_round_sql(k) for k in range(ROUNDS + 1))}
, named AS (SELECT rid, string_agg(printf('%02x', entry::INTEGER), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY rid)
, book AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN named USING (rid), book
"""

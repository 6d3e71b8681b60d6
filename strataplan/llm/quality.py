"""Quality classifier: a factorisation machine over hashed words, structure statistics and the
text's own metadata (its lengths), scored in linear time.

    y(x) = w0 + sum_i w_i x_i + 1/2 sum_f [ (sum_i v_if x_i)^2 - sum_i (v_if x_i)^2 ]

The second form of the pair sum (the sum-of-squares identity) needs each feature once, so a
document costs its distinct words times the rank. Labels, language, source and doc_id are no
inputs. Fitting uses at most ``FIT_ROWS`` labelled rows (a bound on rows; their texts are whole),
those of smallest seeded hash, a row an id; scoring reads every whole text.

Defined results: null or empty text gets the score of the all-zero statistics; repeated rows are
scored each; without usable labels of both kinds every score is the smoothed share of good rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, textstats

FIT_ROWS = 6000
BITS, RANK = 16, 8
THRESHOLD = 0.3


@dataclass
class FactorisationMachine:
    w0: float
    w: np.ndarray  # linear weights: hashed words, then statistics
    v: np.ndarray  # factors, a row each
    mean: np.ndarray
    scale: np.ndarray
    bits: int

    def logit(self, at: np.ndarray, x: np.ndarray, stats: np.ndarray) -> float:
        z = np.clip((stats - self.mean) / self.scale, -4, 4) / np.sqrt(len(stats))
        base = 1 << self.bits
        wx = self.w0 + float(self.w[at] @ x) + float(self.w[base:] @ z)
        p = self.v[at] * x[:, None]
        q = self.v[base:] * z[:, None]
        s = p.sum(0) + q.sum(0)
        return wx + 0.5 * float((s * s).sum() - (p * p).sum() - (q * q).sum())

    def score(self, text: str | None) -> float:
        data = (text or "").encode()
        words = data.lower().split()
        at, x = textstats.hashed(words, self.bits)
        return float(1 / (1 + np.exp(-np.clip(self.logit(at, x, textstats.structure(data, words)), -30, 30))))


def fit(texts: list[str], labels: np.ndarray, bits: int = BITS, rank: int = RANK, epochs: int = 12, rate: float = 0.1, l2: float = 1e-5, seed: int = 7) -> FactorisationMachine:
    """Adagrad on the logistic loss, a row at a time in seeded order."""
    share = (float(np.sum(labels)) + 1) / (len(labels) + 2)
    base, m = 1 << bits, len(textstats.STRUCTURE)
    rng = np.random.default_rng(seed)
    model = FactorisationMachine(float(np.log(share / (1 - share))), np.zeros(base + m, np.float32), rng.normal(0, 0.02, (base + m, rank)).astype(np.float32), np.zeros(m, np.float32), np.ones(m, np.float32), bits)
    if len(set(labels.tolist())) < 2:
        model.v[:] = 0
        return model
    rows = []
    for t in texts:
        data = (t or "").encode()
        words = data.lower().split()
        rows.append((*textstats.hashed(words, bits), textstats.structure(data, words)))
    stats = np.stack([r[2] for r in rows])
    model.mean, model.scale = stats.mean(0), np.maximum(stats.std(0), 1e-3)
    z = np.clip((stats - model.mean) / model.scale, -4, 4) / np.sqrt(m)
    tail = np.arange(base, base + m)
    inputs = [(np.concatenate([at, tail]), np.concatenate([x, zi]).astype(np.float32)) for (at, x, _), zi in zip(rows, z)]
    gw, gv = np.full(base + m, 1e-2, np.float32), np.full((base + m, rank), 1e-2, np.float32)
    for _ in range(epochs):
        for i in rng.permutation(len(inputs)).tolist():
            at, x = inputs[i]
            v = model.v[at]
            p = v * x[:, None]
            s = p.sum(0)
            y = model.w0 + float(model.w[at] @ x) + 0.5 * float((s * s).sum() - (p * p).sum())
            g = 1 / (1 + np.exp(-np.clip(y, -30, 30))) - labels[i]
            model.w0 -= 0.01 * g
            dw = g * x + l2 * model.w[at]
            dv = g * x[:, None] * (s - p) + l2 * v
            gw[at] += dw * dw
            gv[at] += dv * dv
            model.w[at] -= rate * dw / np.sqrt(gw[at])
            model.v[at] -= 0.3 * rate * dv / np.sqrt(gv[at])
    return model


def held_out(doc_id, modulus: int, remainder: int):
    """crc32 of the id as text falls on the remainder; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int, rows: int, seed: int = 11) -> tuple[list[str], np.ndarray]:
    """At most ``rows`` labelled texts that are not held out, by seeded hash of the id. Labels
    come first, so only their texts move."""
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), modulus, remainder))
        .groupBy(F.col("doc_id").alias("id")).agg(F.max(label).alias("y"))
        .orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(rows)
    )
    # a row an id: of repeated ones that of smallest text
    got = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("text").alias("text"), F.max("y").alias("y")).orderBy("id").collect()
    return [r["text"] or "" for r in got], np.array([int(r["y"]) for r in got], dtype=np.int64)


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> FactorisationMachine:
    return fit(*labelled_sample(docs, labels, "quality", 5, 0, rows))


def score_texts(docs: DataFrame, model, columns: list[str]) -> DataFrame:
    """``columns`` of every row and its ``score double``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                scores = [shared.value.score(t) for t in b.column("_text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(scores, pa.float64())], [*columns, "score"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns) + ", score double"
    return docs.select(*columns, F.col("text").cast("string").alias("_text")).mapInArrow(common.lean(run), schema)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.load(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, common.load(spark, sf_dir, "labels"))
    return score_texts(docs, model, ["doc_id"]).select(
        "doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not rejected; columns as given."""
    model = train(docs, labels)
    body, restore = common.shield(docs, ["text"])
    return restore(score_texts(body, model, body.columns).where(F.col("score") >= THRESHOLD))

"""Toxicity by weak supervision.

Voters: lexicon voters (whole words and word beginnings whose presence separates the labelled
rows that may be learned from) and pattern voters (fixed rules on form). A generative label
model takes each voter's firing rate given the hidden class (its accuracy) and, by EM, estimates
rates and class share from labelled and unlabelled rows together; while rates are estimated, the
class of a labelled row is its label. Correlations: voters whose firings go together within a class
beyond independence share their evidence, each weighted by one over its summed correlation with the
others; how much the voters that fire, and those that stay silent, still repeat each other is
estimated as a weight for either sum, on the labelled rows. The model's posteriors of all rows, those
with a label included, are the targets of a linear classifier over hashed words and word beginnings,
which scores any text. No label is a target itself.

Labels of held-out rows, language, source and doc_id are no inputs. At most ``FIT_ROWS``
labelled and ``FREE_ROWS`` further rows are used to fit, those of smallest seeded hash; scoring
reads every whole text.

Defined results: null or empty text gets the classifier's intercept; repeated rows are scored
each, and a repeated row among those to fit on counts once; without usable labels every score is the
smoothed class share.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, quality

FIT_ROWS, FREE_ROWS, VOTERS = 8000, 2000, 256
BITS = 18
BEGINNINGS = (4, 5)
THRESHOLD = 0.3

_WORD = re.compile(r"[^\W\d_]+")
_PATTERNS = {  # form-based voters
    "shouting": re.compile(r"\b[A-Z]{4,}(?:\W+[A-Z]{4,}){2,}"),
    "exclaiming": re.compile(r"!{3,}"),
    "you_are": re.compile(r"\byou(?:'re| are| all are)\b", re.I),
    "masked": re.compile(r"\b\w+[*@#$]{2,}\w*\b"),
}


def terms(text: str) -> list[str]:
    """Lower-case words, and their beginnings marked by a star, with repeats."""
    words = _WORD.findall(text.lower())
    return words + [w[:n] + "*" for w in words for n in BEGINNINGS if len(w) > n]


@dataclass
class ToxicityModel:
    bias: float
    weights: np.ndarray
    bits: int = BITS
    voters: list[str] = field(default_factory=list)
    rates: np.ndarray | None = None
    evidence: np.ndarray | None = None

    def score(self, text: str | None) -> float:
        at = buckets(text or "", self.bits)
        return float(1 / (1 + np.exp(-np.clip(self.bias + float(self.weights[at].sum()), -30, 30))))


def buckets(text: str, bits: int) -> np.ndarray:
    """Distinct hashed words and beginnings of a text."""
    found = set(_WORD.findall(text.lower()))
    starts = {w[:n] + "*" for w in found for n in BEGINNINGS if len(w) > n}
    h = np.fromiter((zlib.crc32(t.encode()) for s in (found, starts) for t in s), dtype=np.uint32, count=len(found) + len(starts))
    return np.unique(h & np.uint32((1 << bits) - 1)).astype(np.int64)


def mine_voters(texts: list[str], labels: np.ndarray, limit: int) -> list[str]:
    """Terms ranked by the smoothed log odds of their presence, weighted by support."""
    toxic, clean = Counter(), Counter()
    for t, y in zip(texts, labels.tolist()):
        (toxic if y else clean).update(set(terms(t)))
    n1, n0 = max(1, int(labels.sum())), max(1, int((1 - labels).sum()))
    ranked = []
    for term, k in toxic.items():
        if k >= 3:
            odds = np.log((k + 0.5) / (n1 + 1)) - np.log((clean[term] + 0.5) / (n0 + 1))
            error = np.sqrt(1 / (k + 0.5) + 1 / (clean[term] + 0.5))
            if odds > 2 * error and odds > 2:
                ranked.append((-odds * np.log1p(k), term))
    return [t for _, t in sorted(ranked)[: min(limit, n1)]]  # no more voters than toxic rows to judge them by


def votes(texts: list[str], voters: list[str]) -> np.ndarray:
    """Firings: a row a text, a column a voter; the pattern voters come last."""
    at = {t: i for i, t in enumerate(voters)}
    out = np.zeros((len(texts), len(voters) + len(_PATTERNS)), dtype=bool)
    for r, text in enumerate(texts):
        for t in set(terms(text)) & at.keys():
            out[r, at[t]] = True
        for i, p in enumerate(_PATTERNS.values()):
            out[r, len(voters) + i] = p.search(text) is not None
    return out


def label_model(fired: np.ndarray, known: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """EM. ``known``: 1, 0, or -1 for unlabelled. Returns the model's posteriors of class 1 for every
    row, firing rates by class, each voter's share of evidence after discounting correlations, and
    the weights of fired and silent evidence and the intercept."""
    labelled = known >= 0
    share = (known[labelled].sum() + 1) / (labelled.sum() + 2)
    post = np.where(labelled, known, share).astype(float)
    x = fired.astype(float)
    rates = np.zeros((2, x.shape[1]))
    for _ in range(rounds):
        for c, weight in ((0, 1 - post), (1, post)):
            rates[c] = (weight @ x + 0.1) / (weight.sum() + 0.2)
        centred = x - rates[0] * (1 - post)[:, None] - rates[1] * post[:, None]
        spread = np.sqrt((centred**2).mean(0)) + 1e-9
        together = np.abs(centred.T @ centred / len(x)) / np.outer(spread, spread)
        together[together < 0.1] = 0
        np.fill_diagonal(together, 1)
        evidence = 1 / together.sum(0)
        on, off = np.log(rates[1] / rates[0]), np.log((1 - rates[1]) / (1 - rates[0]))
        sums = np.stack([x @ (on * evidence), (1 - x) @ (off * evidence), np.ones(len(x))], 1)
        prior = np.clip(post.mean(), 1e-3, 1 - 1e-3)
        weights = _weights(sums[labelled], known[labelled], np.array([1.0, 1.0, np.log(prior / (1 - prior))]))
        model = 1 / (1 + np.exp(-np.clip(sums @ weights, -30, 30)))
        new = np.where(labelled, known, model)
        if np.abs(new - post).max() < 1e-4:
            break
        post = new
    return model, rates, evidence, weights


def _weights(sums: np.ndarray, y: np.ndarray, independent: np.ndarray) -> np.ndarray:
    """Weights of the evidence sums by Newton's method, drawn to those of independent voters."""
    w = independent.copy()
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(sums @ w, -30, 30)))
        step = np.linalg.solve((sums * (p * (1 - p))[:, None]).T @ sums + np.eye(3), sums.T @ (p - y) + w - independent)
        w -= np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-6:
            break
    return w


def linear(texts: list[str], target: np.ndarray, bits: int, steps: int = 90_000, rate: float = 0.5, l2: float = 1e-4, seed: int = 5) -> tuple[float, np.ndarray]:
    """Logistic regression on soft targets by Adagrad, over the buckets whose presence is
    significantly (3.3 standard errors of the log odds) tied to toxicity; ordinary words of long
    texts thus carry no weight."""
    rows = [buckets(t, bits) for t in texts]
    share = np.clip(target.mean(), 1e-3, 1 - 1e-3)
    on, off = np.zeros(1 << bits), np.zeros(1 << bits)
    for at, y in zip(rows, target):
        on[at] += y
        off[at] += 1 - y
    odds = np.log((on + 0.5) / (off + 0.5)) - np.log(share / (1 - share))
    error = np.sqrt(1 / (on + 0.5) + 1 / (off + 0.5))
    useful = (on + off >= 3) & (odds > 3.3 * error)
    rows = [at[useful[at]] for at in rows]
    bias, b2, w, g2 = float(np.log(share / (1 - share))), 1.0, np.zeros(1 << bits), np.full(1 << bits, 0.1)
    rng = np.random.default_rng(seed)
    for _ in range(-(-steps // len(rows))):
        for i in rng.permutation(len(rows)).tolist():
            at = rows[i]
            g = 1 / (1 + np.exp(-np.clip(bias + w[at].sum(), -30, 30))) - target[i]
            b2 += g * g
            bias -= rate * g / np.sqrt(b2)
            d = g + l2 * w[at]
            g2[at] += d * d
            w[at] -= rate * d / np.sqrt(g2[at])
    return bias, w


def fit(texts: list[str], labels: np.ndarray, free: list[str] = (), bits: int = BITS) -> ToxicityModel:
    share = (float(np.sum(labels)) + 1) / (len(labels) + 2)
    if len(set(np.asarray(labels).tolist())) < 2:
        return ToxicityModel(float(np.log(share / (1 - share))), np.zeros(1 << bits), bits)
    voters = mine_voters(texts, labels, VOTERS)
    everything = [*texts, *free]
    known = np.concatenate([labels, np.full(len(free), -1)]).astype(int)
    post, rates, evidence, _ = label_model(votes(everything, voters), known)
    bias, w = linear(everything, post, bits)
    return ToxicityModel(bias, w.astype(np.float32), bits, voters, rates, evidence)


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, free_rows: int = FREE_ROWS) -> ToxicityModel:
    texts, y = quality.labelled_sample(docs, labels, "toxic", 4, 2, rows)
    ids = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("id")).distinct()
    some = ids.join(labels.where("toxic IS NOT NULL").select(F.col("doc_id").alias("id")), "id", "left_anti").orderBy(F.xxhash64("id", F.lit(3)), "id").limit(free_rows)
    free = [r["text"] or "" for r in docs.join(F.broadcast(some), docs.doc_id == some.id).groupBy("id").agg(F.min("text").alias("text")).orderBy("id").collect()]
    return fit(texts, y, free)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.load(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, common.load(spark, sf_dir, "labels"))
    return quality.score_texts(docs, model, ["doc_id"]).select(
        "doc_id", quality.held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))

"""The corpus pipeline stage by stage, each held against brute force on its own input."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import corpus_pipeline
import duckdb
import numpy as np
import pytest
from test_operators import CONTRACT, base_of, brute_telling, five

from strataplan.llm import common, mixing, packing, pii, quality


def plain(df):
    """Rows as a multiset, columns in order."""
    return Counter(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def chain(spark, data):
    """Documents with nulls, blanks, repeated rows, near copies and personal data, after each stage."""
    docs = common.load(spark, data, "documents")
    rng = random.Random(4)
    words = [a + b for a in ("ber", "tan", "kol", "mur", "ved", "sip") for b in ("ane", "osk", "uli", "emp", "ard")]
    prose = [" ".join(rng.choice(words) for _ in range(120)).capitalize() + "." for _ in range(6)]
    near = prose[0].split()
    near[60] = "changed"
    more = [(None, prose[1], "en", "src0", 5), (9001, None, "en", "src1", 0), (9002, "", "de", None, 0), (9003, prose[2], None, "src2", 7), (9003, prose[2], None, "src2", 7), (9004, prose[2], "en", "src3", 7), (9005, prose[0], "en", "odd", 9), (9006, " ".join(near), "en", "src1", 9), (9007, prose[3] + " Write to a.b@mail7.example.com or 10.0.0.1, +1 (555) 010-1234.", "en", "src4", 1), (9008, prose[4] * 200, "fr", "src5", 1)]
    docs = common.store(docs.unionByName(spark.createDataFrame(more, docs.schema)))
    seen = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        docs = common.store(stage(spark, docs, data))
        seen.append((name, docs))
    return seen


def test_columns(chain):
    first = chain[0][1].columns
    assert all(df.columns == first for _, df in chain[:-1])
    counts = [df.count() for _, df in chain]
    assert all(0 < b <= a for a, b in zip(counts, counts[1:-1]))


def test_quality_stage(chain, spark, data):
    (_, before), (_, after) = chain[:2]
    model = quality.train(before, common.load(spark, data, "labels"))
    assert plain(after) == Counter({r: n for r, n in plain(before).items() if model.score(r[1]) >= 0.3})


def test_near_dedup_stage(chain):
    (_, before), (_, after) = chain[1:3]
    rows = plain(before)
    texts = sorted({r[1] or "" for r in rows})
    hashes = [five(t) for t in texts]
    sets = [set(h) for h in hashes]
    fps = [sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) for h in hashes]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if group[i] != group[j] and ((fps[i] ^ fps[j]).bit_count() <= 3 or sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    named = dict(zip(texts, group))
    least = {}
    for r in rows:
        if r[0] is not None:
            g = named[r[1] or ""]
            least[g] = min(least.get(g, r[0]), r[0])
    got = plain(after)
    assert sum(n for r, n in got.items() if r[0] is None) == sum(n for r, n in rows.items() if r[0] is None)
    assert sorted(r[0] for r in got.elements() if r[0] is not None) == sorted(least.values())
    assert all(r in rows for r in got)


def secret(value):
    counts = Counter(value)
    bits = sum(n * math.log2(len(value) / n) for n in counts.values())
    return sum(c.isdigit() for c in value) >= 4 and re.search("[A-Za-z]", value) and bits >= max(pii.SECRET_BITS, 2 * len(value))


def spans_of(text):
    kinds = [*CONTRACT, "secret"]
    base = sorted((int(a), int(b), text[int(a) : int(b)], kinds.index(k)) for k, a, b in (x.split(":") for x in base_of(text).split(",") if x))
    found = [(m.start(), m.end(), m.group(), 4) for m in re.finditer("[A-Za-z0-9_-]{20,}", text) if secret(m.group()) and not any(a < m.end() and m.start() < b for a, b, *_ in base)]
    return sorted(base + found, key=lambda s: (s[0], s[3]))


def test_pii_stage(chain):
    (_, before), (_, after) = chain[2:4]
    rows = before.collect()
    telling = brute_telling([r.text or "" for r in rows], spans_of)
    names = [*CONTRACT, "secret", "term"]

    def clean(text):
        spots = spans_of(text)
        spots += [(m.start(), m.end(), m.group(), 5) for m in re.finditer(r"[^\W_]+", text) if m.group().lower() in telling and not any(a < m.end() and m.start() < b for a, b, *_ in spots)]
        out, at = "", 0
        for start, end, _, kind in sorted(spots, key=lambda s: (s[0], s[3])):
            if start >= at:
                out += text[at:start] + f"[{names[kind].upper()}]"
            at = max(at, end)
        return out + text[at:]

    want = Counter()
    for r in rows:
        text = None if r.text is None else clean(r.text)
        want[r.doc_id, text, r.lang, r.source, len(text) if text is not None else r.n_chars] += 1
    assert plain(after.select("doc_id", "text", "lang", "source", "n_chars")) == want
    assert not any("@mail" in (r.text or "") for r in after.collect())


def test_mixing_stage(chain):
    (_, before), (_, after) = chain[3:5]
    con = duckdb.connect()
    con.register("given", before.toPandas().astype({"doc_id": "Int64"}))
    want = con.execute(f"WITH {mixing.mix_sql('given', 4, 5, 1)} SELECT doc_id FROM mixed").fetchall()
    assert Counter(r.doc_id for r in after.collect()) == Counter(r[0] for r in want)
    assert not plain(after) - plain(before)


def test_packing_stage(chain):
    from tokenizers import Tokenizer

    (_, before), (_, after) = chain[4:6]
    tok = Tokenizer.from_file(packing.default_tokenizer())
    tok.encode_special_tokens = True
    want = Counter()
    for r in before.collect():
        ids = np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for s in range(0, len(ids), 1024):
            piece = ids[s : s + 1024]
            want[r.doc_id, s, len(piece), zlib.crc32(piece.tobytes()), len(ids)] += 1
    assert plain(after.select("doc_id", "start", "length", "ids_crc32", "doc_tokens")) == want
    for _, g in after.toPandas().sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == np.concatenate([[0], g.length.cumsum().to_numpy()[:-1]]).tolist() and g.length.sum() <= 1024


def test_empty(spark, data):
    docs = common.load(spark, data, "documents").where("1 = 0")
    for _, stage in corpus_pipeline.STAGES:
        docs = common.store(stage(spark, docs, data))
    assert docs.count() == 0


def test_run_is_the_chain(spark, data, tmp_path):
    """run() gives the last stage's rows, and the same on a second run."""
    digest = lambda df: hashlib.sha256(repr(sorted(map(tuple, df.collect()))).encode()).hexdigest()
    assert digest(corpus_pipeline.run(spark, data)) == digest(corpus_pipeline.run(spark, data))

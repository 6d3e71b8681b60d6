"""The ten operators against brute force on small fixtures."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from strataplan.llm import common, imatch, licenses, mixing, neardup_vectors, packing, pii, quality, simhash, suffix_dedup, toxicity

WORDS = [a + b for a in ("ba", "ce", "di", "fo", "gu", "he", "ji", "ko") for b in ("lan", "mer", "nit", "pos", "ruv", "sta", "tin", "vol")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


EDGE = "doc_id long, text string, lang string, source string, n_chars long, h string, start int, fp double, score string, _k int, spans string, key int"


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, clashing extra columns."""
    rng = random.Random(5)
    same = prose(rng, 120)
    extra = ("x", 1, 2.0, "s", 3, "t", 4)
    rows = [(1, None, None, None, None, *extra), (2, "", "en", "src1", 0, *extra), (3, same, "en", "src1", len(same), *extra), (3, same, "en", "src1", len(same), *extra), (4, same, "de", "src2", len(same), *extra), (None, "one two three", "en", "src1", 13, *extra), (5, "  \n\t ", None, "src3", 5, *extra), (6, prose(rng, 30_000), "fr", "odd", 0, *extra), (7, "héllo ✓ 日本語 \U0001f600 <|endoftext|>", "ja", "src9", 1, *extra), (8, "x", "en", "src1", 1, *([None] * 7))]
    return spark.createDataFrame(rows, EDGE)


@pytest.fixture(scope="module")
def empty(edge):
    return edge.where("1 = 0")


# op1 ------------------------------------------------------------------------------------------


def brute_links(rows, threshold):
    links, usable = defaultdict(set), []
    for i, (vid, v, label) in enumerate(rows):
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            usable.append((i, np.array(v, float) / np.linalg.norm(np.array(v, float)), label))
    for a, (i, x, l) in enumerate(usable):
        for j, y, m in usable[a + 1 :]:
            if l == m and len(x) == len(y) and x @ y >= threshold:
                links[i].add(j)
                links[j].add(i)
    return links


@pytest.mark.parametrize("shard", [8192, 40])
def test_vectors(spark, shard):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + rng.normal(size=16) * (0.1 if i % 3 else 1)).astype(np.float32).tolist(), int(i % 12 % 4)) for i in range(400)]
    rows += [(400 + k, rows[7][1], rows[7][2]) for k in range(30)]
    rows += [(500, None, 1), (501, [0.0] * 16, 1), (502, [float("nan")] * 16, 1), (503, [None] * 16, 1), (504, rows[7][1], None), (505, [], 1), (506, [1.0, 0.0], 1), (507, [2.0, 0.0], 1), (508, [float("inf")] * 16, 1)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, node string, n int")
    got = {r.vec_id: r for r in neardup_vectors.near_duplicates(df, shard=shard).collect()}
    links = brute_links(rows, 0.93)
    assert len(got) == len(rows)
    for i, (vid, *_) in enumerate(rows):
        assert got[vid].n_links == len(links[i]), vid
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        assert got[vid].component_id == min(rows[j][0] for j in seen)
        assert got[vid].kept == (got[vid].component_id == vid)
    assert neardup_vectors.near_duplicates(df.where("1 = 0")).count() == 0
    told = neardup_vectors.audits(df, shard=shard).collect()
    assert {r.label for r in told} == {0, 1, 2, 3} and all(r.beam <= 8192 for r in told)


def test_vectors_of_repeated_and_null_ids(spark):
    """Vectors of one id under one or two labels count their own links, and links run through rows of null id."""
    turn = lambda deg: [float(np.cos(np.radians(deg))), float(np.sin(np.radians(deg)))]
    rows = [(1, turn(0), 0), (1, turn(90), 0), (2, turn(15), 0), (3, turn(100), 0), (4, turn(-10), 0), (1, turn(0), 1), (5, turn(200), 0), (None, turn(220), 0), (6, turn(240), 0), (None, turn(300), 0), (None, turn(300), 0)]
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in neardup_vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()), key=repr)
    assert got == sorted([(1, 2, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 1, 1, False), (1, 0, 1, True), (5, 1, 5, True), (None, 2, 5, False), (6, 1, 5, False), (None, 1, None, True), (None, 1, None, True)], key=repr)


def test_vectors_across_shards(spark):
    """Shards far above the first beam: links across them are searched for by graph, and equal brute force."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(2400, 24))
    x[1200:] = x[:1200] + rng.normal(size=(1200, 24)) * 0.06
    rows = [(i, v, 1) for i, v in enumerate(x.astype(np.float32).tolist())]
    got = {r.vec_id: r.n_links for r in neardup_vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), shard=1200).collect()}
    u = np.array([r[1] for r in rows])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    truth = (u @ u.T >= 0.93).sum(axis=1) - 1
    assert truth.sum() > 2000 and [got[i] for i in range(len(rows))] == truth.tolist()


def test_graph_search_is_no_scan():
    """With beams far below the shard's size the audited search finds all links."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 32))
    x[1500:] = x[:1500] + rng.normal(size=(1500, 32)) * 0.03
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = neardup_vectors.Graph(x)
    found, audit = neardup_vectors.search(graph, x, 0.93, own=1)
    assert audit["beam"] < len(x) and audit["links"] >= 500
    truth = (x @ x.T >= 0.93).sum()
    assert sum(map(len, found)) >= 0.99 * truth and all((x[f] @ x[i] >= 0.93).all() for i, f in enumerate(found))
    again = neardup_vectors.Graph.load(x, graph.pack())
    assert all(np.array_equal(a, b) for a, b in zip(found, again.within(x, 0.93, audit["beam"])[0]))


def test_sparse_links_are_audited_and_found():
    """Few links among many vectors: the audit sees them, although a plain sample would not."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(6000, 64))
    x[5970:] = x[:30] + rng.normal(size=(30, 64)) * 0.03
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found, audit = neardup_vectors.search(neardup_vectors.Graph(x[:5970]), x[5970:], 0.93)
    assert audit["links"] == 30 and [f.tolist() for f in found] == [[i] for i in range(30)]


def test_beam_widens_until_no_link_is_missed(monkeypatch):
    """A search that misses links at its first beam is repeated with wider ones."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 8))
    x[200:] = x[:200] + rng.normal(size=(200, 8)) * 0.02
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = neardup_vectors.Graph(x)
    whole, used = graph.within, []

    def blunt(q, threshold, beam):
        used.append(beam)
        found, second = whole(q, threshold, beam)
        return ([f[:1] for f in found] if beam < 150 else found), second

    monkeypatch.setattr(graph, "within", blunt)
    found, audit = neardup_vectors.search(graph, x, 0.93, own=1)
    assert used == [48, 96, 192] and audit["beam"] == 192 and audit["missed"] == 0
    assert sum(map(len, found)) == (x @ x.T >= 0.93).sum()


# op2 ------------------------------------------------------------------------------------------


def test_packing(spark, edge, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    tok.encode_special_tokens = True
    got = packing.pack_documents(edge).toPandas()
    want = Counter()
    for r in edge.select("doc_id", "text").collect():
        ids = np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for s in range(0, len(ids), 1024):
            want[(r.doc_id, s, len(ids[s : s + 1024]), zlib.crc32(ids[s : s + 1024].tobytes()), len(ids))] += 1
    have = Counter((None if np.isnan(r.doc_id) else int(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got.itertuples())
    assert have == want
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == np.concatenate([[0], g.length.cumsum().to_numpy()[:-1]]).tolist() and g.length.sum() <= 1024
    assert packing.pack_documents(empty).count() == 0
    seqs = packing.sequences(edge.where("doc_id is not null")).collect()
    assert all(len(s.ids) == (s.used if s.used & (s.used - 1) == 0 else 1024) for s in seqs)


def test_both_tokenizers_agree():
    """The faster library gives the ids of ``tokenizers`` on every text that it is used for."""
    import duckdb
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    tok, encode = Tokenizer.from_file(path), packing.encoder(path)
    tok.encode_special_tokens = True
    texts = [t or "" for (t,) in duckdb.execute("SELECT text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()]
    rng = random.Random(12)
    ranges = [(0, 0x7F)] * 6 + [(0x80, 0x24F), (0x2010, 0x2027), (0x20A0, 0x20BF), (0x300, 0x3000), (0x1F600, 0x1F64F)]
    for _ in range(3000):
        low, high = rng.choice(ranges)
        other = rng.choice(ranges)
        texts.append("".join(chr(rng.randint(*(other if rng.random() < 0.2 else (low, high)))) for _ in range(rng.randint(0, 60))))
    texts += ["'s 'S 't've I'll'D", " \n\n  x\t\r\n ", "a" * 3000, "1234567890 " * 50, "<|endoftext|>x<|endoftext|>", "\u00a0\u0085\u2003x", "ǅ ŉ ß İ"]
    plain = [t for t in texts if not packing._PLAIN.search(t)]
    assert len(plain) > 1500
    for t in texts:
        assert encode(t) == tok.encode(t, add_special_tokens=False).ids


def test_first_fit_decreasing_is_first_fit():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 101, 500)
    where, offset = packing.first_fit_decreasing(sizes, 100)
    free = []
    for i in np.argsort(-sizes, kind="stable"):
        k = next((j for j, f in enumerate(free) if f >= sizes[i]), None)
        if k is None:
            free.append(100)
            k = len(free) - 1
        assert (where[i], offset[i]) == (k, 100 - free[k])
        free[k] -= sizes[i]


# op3 ------------------------------------------------------------------------------------------


WRAPPED = {
    "MIT": """MIT License

Copyright (c) 2024 Somebody
Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
""",
    "Apache-2.0": """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
""",
    "BSD-2-Clause,BSD-3-Clause": """ * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions are met:
 *
 * Redistributions of source code must retain the above copyright notice, this
 * list of conditions and the following disclaimer.
 * Redistributions in binary form must reproduce the above copyright notice,
 * this list of conditions and the following disclaimer in the documentation
 * and/or other materials provided with the distribution.
 * Neither the name of the copyright holder nor the names of its contributors
 * may be used to endorse or promote products derived from this software without
 * specific prior written permission.
""",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any\r\npurpose with or without fee is hereby granted, provided that the above\r\ncopyright notice and this permission notice appear in all copies.",
    "GPL-3.0-or-later": """// This program is free software: you can redistribute it and/or modify
// it under the terms of the GNU General Public License as published by
// the Free Software Foundation, either version 3 of the License, or
// (at your option) any later version.
// This program is distributed in the hope that it will be useful,
// but WITHOUT ANY WARRANTY; without even the implied warranty of
// MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
""",
    "MPL-2.0": "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */",
}


def test_licenses(spark, edge, empty):
    mit = licenses._SENTENCES["mit_grant"].capitalize() + ".\n\n" + licenses._SENTENCES["mit_notice"].capitalize() + "."
    texts = ["Released under the MIT License.", mit, licenses._SENTENCES["mit_notice"] + ". " + licenses._SENTENCES["mit_grant"], "Licensed under CC BY-NC 4.0.\nprose here. This work is licensed under the GNU General Public License, version 3!", "a licensed driver", "some prose\nLicensed under the Apache License, Version 2.0\nmore of it"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r._licenses for r in licenses.scan(df).orderBy("doc_id").collect()]
    assert got == [["MIT"], ["MIT"], [], ["CC-BY-NC-4.0", "GPL-3.0"], [], ["Apache-2.0"]]
    assert licenses.scan(edge).where("size(_licenses) > 0").count() == 0 and licenses.scan(edge).count() == edge.count()
    assert licenses.scan(edge).columns == [*edge.columns, "_sentence_ids", "_licenses"]
    assert licenses.scan(empty).count() == 0


def test_licenses_wrapped(spark):
    """The usual notices, wrapped and in comments."""
    df = spark.createDataFrame([(k, t) for k, t in WRAPPED.items()], "k string, text string")
    got = {r.k: ",".join(r._licenses) for r in licenses.scan(df).collect()}
    assert got == {k: k for k in WRAPPED}


def test_licenses_every_sentence(spark):
    """Each known sentence is found, on a line of its own between others, and each has a hint."""
    sentences, _, _ = licenses.tables()
    assert all(any(h in s for h in licenses.HINTS) for s in sentences)
    df = spark.createDataFrame([(i, f"Prose before\n{s}\nand after.") for i, s in enumerate(sentences)], "doc_id long, text string")
    got = {r.doc_id: r._sentence_ids for r in licenses.scan(df).collect()}
    assert [got[i] for i in range(len(sentences))] == [[k] for k in sentences.values()]


def test_licenses_sql(spark):
    """The SQL counterpart on wrapped, adjacent and odd texts."""
    import duckdb

    rng = random.Random(2)
    known = list(licenses.tables()[0])
    parts = [*known[:40], *rng.sample(known, 60), *WRAPPED.values(), "prose", "the license", ""]
    rows = [(i, "".join(rng.choice(parts) + rng.choice([".", ". ", "\n", "\n\n", "!\n", " ", ", "]) for _ in range(rng.randint(0, 9)))) for i in range(200)]
    rows.append((200, None))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    want = sorted(con.execute(licenses.OP3_SQL).fetchall())
    found = licenses.scan(df).collect()
    assert sorted((r.doc_id, len(r._sentence_ids), ",".join(map(str, r._sentence_ids)), ",".join(r._licenses)) for r in found) == want


# op4 ------------------------------------------------------------------------------------------


def brute_imatch(docs):
    """Fingerprints by the rules of the docstring, in plain Python."""
    full = (1 << 64) - 1
    signed = lambda x: x - (1 << 64) * (x >> 63)
    words = lambda b: signed(xxhash.xxh64_intdigest(b, 42))
    chained = lambda v, seed: xxhash.xxh64_intdigest((v & full).to_bytes(8, "little"), seed)
    terms = lambda t: {words(w.encode()) for w in set(re.split(r"[^\w]|_", t.lower())) - {""}}
    df = Counter(u for _, t in docs for u in terms(t))
    ok = lambda u: 2 <= df[u] <= max(2.0, imatch.MAX_SHARE * len(docs))
    depth = lambda u: next((j for j in range(imatch.LEVELS - 1) if (u >> 3) >> j & 1), imatch.LEVELS - 1)

    def parts(t):
        held = sorted(filter(ok, terms(t)))
        level = next((j for j in range(imatch.LEVELS - 1) if sum(depth(u) >= j for u in held) <= imatch.TERMS), imatch.LEVELS - 1)
        whole, subsets = 42, {}
        for u in held:
            whole = chained(u, whole)
        entries = sorted((j * imatch.SLOTS + ((u & full) >> 20) % imatch.SLOTS) << 53 | (u & full) >> 11 for u in held for j in range(level, depth(u) + 1))
        for e in entries:
            subsets[e >> 53] = chained(e, chained(subsets.get(e >> 53, 0), 42))
        return held, level, {s: h >> 11 for s, h in subsets.items()}, whole

    def show(t):
        held, _, subsets, whole = parts(t)
        return f"w{whole:016x}" + "".join(f"{s:03x}{h >> 21:08x}" for s, h in sorted(subsets.items())) if held else f"t{words(t.encode()) & full:016x}"

    def like(a, b):
        if show(a) == show(b):
            return 1.0
        (_, la, sa, _), (_, lb, sb, _) = parts(a), parts(b)
        sa, sb = ({s: h for s, h in x.items() if s // imatch.SLOTS == max(la, lb)} for x in (sa, sb))
        used = sa.keys() | sb.keys()
        return sum(s in sa and s in sb and sa[s] == sb[s] for s in used) / len(used) if used else 0.0

    out = []
    for i, (doc_id, t) in enumerate(docs):
        n = docs[(i + 1) % len(docs)][1]
        half = len(t) // 2
        e = t[: len(t) - half] + n[:half]
        out.append((doc_id, len(t), hashlib.sha256(e.encode()).hexdigest(), show(t), show(e), like(t, e), like(t, n)))
    return out


@pytest.mark.parametrize("ranges", [2 << 20, 3000])
def test_fingerprints(spark, edge, empty, ranges, monkeypatch):
    monkeypatch.setattr(imatch, "RANGE_BYTES", ranges)  # the small one makes many ranges
    rng = random.Random(3)
    docs = [(i * 3, prose(rng, rng.randint(0, 60))) for i in range(150)] + [(1000 + i, " ".join(f"{rng.choice(WORDS)}{rng.choice(WORDS)}" for _ in range(200))) for i in range(40)]
    docs += [(1100, ""), (1101, "b"), (1102, docs[-1][1]), (1103, docs[-1][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in imatch.fingerprint(df).collect())
    want = brute_imatch(docs)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5:] for g in got] == [pytest.approx(w[5:]) for w in want]
    e = imatch.fingerprint(edge).collect()
    assert len(e) == edge.count()
    by = {r.doc_id: r.fingerprint for r in e}
    assert by[3] == by[4] and by[1] == by[2]
    twice = [r for r in e if r.doc_id == 3]
    assert len(twice) == 2 and twice[0] == twice[1] and twice[0].near_next == 1
    assert imatch.fingerprint(empty).count() == 0
    alone = imatch.fingerprint(spark.createDataFrame([(7, "one two three")], "doc_id long, text string")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1 and alone[0].edited_sha256 == hashlib.sha256(b"one twoone tw").hexdigest()


def test_fingerprints_hold_every_word(spark):
    """Each word of the band is in a fingerprint: texts of one word each have a subset of their own."""
    df = spark.createDataFrame([(2 * i + k, w) for i, w in enumerate(WORDS) for k in (0, 1)], "doc_id long, text string")
    got = {r.doc_id: r.fingerprint for r in imatch.fingerprint(df).collect()}
    assert not any(f.startswith("t") for f in got.values()) and len(set(got.values())) == len(WORDS)


# op5, op7 --------------------------------------------------------------------------------------


def auc(score, y):
    r = np.argsort(np.argsort(score)) + 1
    n1 = y.sum()
    return (r[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


def test_toxicity(spark, edge, empty):
    rng = random.Random(8)
    bad = ["vilezz", "grubzz", "slimzz", "muckzz"]
    rows = []
    for i in range(1500):
        y = int(rng.random() < 0.2)
        text = prose(rng, rng.randint(5, 80)).split()
        if y:
            text[rng.randrange(len(text))] = rng.choice(bad) + rng.choice(["", "a", "ob"])
        rows.append((i, " ".join(text), y))
    train = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    test = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    model = toxicity.fit([r[1] for r in train], np.array([r[2] for r in train]))
    s, y = np.array([model.score(r[1]) for r in test]), np.array([r[2] for r in test])
    assert auc(s, y) > 0.97 and ((s >= 0.3) == y).mean() > 0.95
    out = quality.score_texts(edge, model, ["doc_id", "h"])
    assert out.count() == edge.count() and out.where("score between 0 and 1").count() == edge.count()
    assert quality.score_texts(empty, model, ["doc_id"]).count() == 0
    none = toxicity.train(edge, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert none.score("anything") == none.score(None) == pytest.approx(0.5)


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(3)
    y = (rng.random(4000) < 0.3).astype(int)
    votes = np.stack([np.where(y == 1, rng.random(4000) < p, rng.random(4000) < q) for p, q in ((0.8, 0.1), (0.6, 0.05), (0.7, 0.2))], 1)
    votes = np.concatenate([votes, votes[:, :1]], 1)  # a copy of a voter
    known = np.where(rng.random(4000) < 0.1, y, -1)
    post, rates, evidence, _ = toxicity.label_model(votes, known)
    assert np.allclose(rates[1][:3], (0.8, 0.6, 0.7), atol=0.08) and ((post > 0.5) == y).mean() > 0.85
    assert evidence[0] < 0.7 and evidence[3] < 0.7  # the copy shares its evidence


def test_held_out_labels_change_no_score(spark):
    """Flipping every label that is held out leaves each score as it is; ties at the row bound and
    repeated rows are settled the same way on every run."""
    docs, labels = common.load(spark, "/root/testdata/sf0.01", "documents"), common.load(spark, "/root/testdata/sf0.01", "labels")
    docs = docs.unionByName(docs.where("doc_id % 7 = 0")).repartition(5)
    texts = ["trash and scum", "the thing", "", "Der Und. " * 30]
    for train, label, modulus, remainder in ((toxicity.train, "toxic", 4, 2), (quality.train, "quality", 5, 0)):
        held = quality.held_out(F.col("doc_id"), modulus, remainder)
        flipped = labels.withColumn(label, F.when(held, 1 - F.col(label)).otherwise(F.col(label))).repartition(3)
        assert flipped.join(labels, ["doc_id", label], "left_anti").count() > 0
        a, b = train(docs, labels, 150), train(docs.repartition(3), flipped, 150)
        assert [a.score(t) for t in texts] == [b.score(t) for t in texts]


def test_quality(spark, data, edge, empty):
    docs, labels = common.load(spark, "/root/testdata/sf0.01", "documents"), common.load(spark, "/root/testdata/sf0.01", "labels")
    model = quality.train(docs, labels)
    held = docs.join(labels, "doc_id").where(quality.held_out(F.col("doc_id"), 5, 0)).select("text", "quality").collect()
    s, y = np.array([model.score(r.text) for r in held]), np.array([r.quality for r in held])
    assert auc(s, y) > 0.95
    assert set(quality.keep_good(edge, labels).columns) == set(edge.columns) and quality.keep_good(empty, labels).count() == 0


def test_factorisation_identity():
    """The linear-time score equals the sum over all pairs."""
    rng = np.random.default_rng(0)
    m = quality.fit(["a b c", "d e f a", "g h", "a a b"], np.array([1, 0, 0, 1]), bits=6, epochs=3)
    m.v = rng.normal(size=m.v.shape)
    data = b"a b d h"
    from strataplan.llm import textstats

    at, x = textstats.hashed(data.split(), 6)
    st = textstats.structure(data, data.split())
    z = np.clip((st - m.mean) / m.scale, -4, 4) / np.sqrt(len(st))
    i, v = np.concatenate([at, np.arange(64, 64 + len(z))]), np.concatenate([x, z])
    want = m.w0 + (m.w[i] * v).sum() + sum(m.v[i[a]] @ m.v[i[b]] * v[a] * v[b] for a in range(len(i)) for b in range(a))
    assert m.logit(at, x, st) == pytest.approx(want, rel=1e-4)


def test_packing_deals_out_null_ids(spark):
    """Rows of one id, or of none, do not crowd one group."""
    pieces = spark.range(6000).selectExpr("CASE WHEN id < 3000 THEN NULL WHEN id < 4500 THEN 5 ELSE id END AS doc_id", "0L AS start", "10L AS length", "CASE WHEN id < 3000 THEN 7 ELSE id END AS ids_crc32")
    got = packing.place(common.store(pieces), group_pieces=500).selectExpr("pmod(sequence_id, 12) AS grp").groupBy("grp").count().collect()
    assert len(got) == 12 and max(r["count"] for r in got) < 650


# op6 ------------------------------------------------------------------------------------------


def covered(seqs, length):
    """For each sequence which units lie in a string of ``length`` units that starts elsewhere too."""
    seen = Counter(s[i : i + length] for s in seqs for i in range(len(s) - length + 1))
    out = []
    for s in seqs:
        gone = np.zeros(len(s), bool)
        for i in range(len(s) - length + 1):
            if seen[s[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append(gone)
    return out


def brute_removed(texts, length, passage=51):
    words = covered([tuple(t.split()) for t in texts], passage)
    out = []
    for t, gone, w in zip(texts, covered(texts, length), words):
        edge = np.diff(np.pad(gone, 1).astype(int))
        out.append((len(t), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest(), int(w.sum())))
    return out


def removed(r):
    return r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.n_passage_words


@pytest.mark.parametrize("limits", [{}, {"crowd": 1}, {"range_size": 20}, {"range_size": 20, "most_ranges": 3}])
def test_suffix_dedup(spark, limits):
    rng = random.Random(11)
    passages = [prose(rng, n) for n in (40, 70, 90)]
    texts = []
    for i in range(90):
        parts = [prose(rng, rng.randint(0, 60))]
        if i % 3 == 0:
            parts += [passages[i % 7 % 3], prose(rng, rng.randint(0, 30))]
        if i % 10 == 0:
            p = passages[2]
            k = rng.randrange(len(p))
            parts += [p[:k] + "#" + p[k + 1 :]]
        texts.append("".join(parts))
    short = " ".join(rng.choice("abcdefgh") for _ in range(51))  # over 50 words, under 400 bytes
    texts += [prose(rng, 20) + " " + short + " " + prose(rng, 20), prose(rng, 9) + "\n" + short.replace(" ", "\n", 3), short[4:]]
    texts += ["Of " * 300, "é" * 500, "", texts[0], texts[9], "Of " * 200, passages[1][:399], passages[1][:400]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    got = list(map(removed, suffix_dedup.remove(df, **limits).orderBy("doc_id").collect()))
    assert got == brute_removed([t.encode() for t in texts], 400)
    assert [g[4] for g in got[90:93]] == [51, 51, 0]


def test_suffix_dedup_edge(spark, edge, empty):
    want = Counter(brute_removed([(r.text or "").encode() for r in edge.select("text").collect()], 400))
    assert Counter(map(removed, suffix_dedup.remove(edge).collect())) == want
    assert suffix_dedup.remove(empty).count() == 0


def test_planted_passages(spark):
    """Passages of 51 to 60 words, of less and more than 400 bytes, planted in pairs of documents: the columns tell of
    every one of them, and of no document between."""
    rng = random.Random(21)
    planted, texts = set(), [prose(rng, rng.randint(60, 300)) for _ in range(240)]
    word = [lambda: rng.choice(["a", "of", "it", "we"]) + rng.choice("xyz") + str(rng.randrange(9)), lambda: rng.choice(WORDS) + rng.choice(WORDS)]
    for k in range(40):
        passage = " ".join(word[k % 2]() for _ in range(51 + k % 10))
        assert (len(passage) < 400) == (k % 2 == 0)
        for i in (3 * k, 239 - 3 * k):
            at = texts[i].find(" ", len(texts[i]) // 2)
            texts[i] = f"{texts[i][:at]} {passage} {texts[i][at + 1:]}"
            planted.add(i)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in suffix_dedup.remove(df).collect()}
    assert {i for i, r in got.items() if r.n_passage_words > 0} == planted
    assert all(got[i].n_passage_words >= 51 for i in planted)
    assert {i for i, r in got.items() if r.n_removed > 0} <= planted and sum(r.n_removed > 0 for r in got.values()) == 40


def test_loser_tree():
    rng = random.Random(2)
    runs = [sorted("".join(rng.choice("ab") for _ in range(rng.randint(0, 12))).encode() for _ in range(rng.randint(0, 30))) for _ in range(7)]
    out = list(suffix_dedup.LoserTree([suffix_dedup.front_code(r) for r in runs]))
    assert [t for *_, t in out] == sorted(s for r in runs for s in r)
    for (_, _, _, a), (_, _, n, b) in zip(out, out[1:]):
        assert a[:n] == b[:n] and a[n : n + 1] != b[n : n + 1] or n == min(len(a), len(b))


# op8 ------------------------------------------------------------------------------------------

CONTRACT = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum((int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_of(text):
    out = []
    for k, (kind, p) in enumerate(CONTRACT.items()):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m.group())
            ok = kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")) or kind == "card" and 12 <= len(d) <= 19 and luhn(d) or kind == "phone" and 9 <= len(d) <= 15
            if ok:
                out.append((m.start(), k, kind, m.end()))
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(out))


def test_pii_base(spark, edge, empty):
    rng = random.Random(1)
    bits = ["a@b.c", "@", "x.y+z@mail-1.example.com", "a@b.c_x@y.z", "a@@b.c", "1.2.3.4", "1.2.3.4.5.6.7.8", "300.1.1.1", "000.0255.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "5", "49927398716", "+1 (555) 123-4567", "+12", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "é", "😀", " ", ".", "-", "79927398713000000000000", "4222222222222"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " ", "x", "-", "."]) for _ in range(rng.randint(1, 25))) for _ in range(400)]
    texts += ["1" * 30_000, "a" * 30_000 + "@", "a@b" + ".c" * 20_000, "1 " * 20_000, "1.1" * 10_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.s for r in pii.spans(df).select("doc_id", pii.rendered(F.col("_base")).alias("s")).collect()}
    assert [got[i] for i in range(len(texts))] == [base_of(t) for t in texts]
    assert pii.sanitise(edge).count() == edge.count() and pii.sanitise(edge).columns == edge.columns and pii.sanitise(empty).count() == 0


def brute_telling(texts, spans_of, min_contexts=3, min_share=0.5, min_bits=3.0):
    """Revealing terms by the rules of the docstring. ``spans_of``: (start, end, value, kind) by start."""
    h = lambda s: xxhash.xxh64_intdigest(s.encode(), 42)
    code = lambda s: ("E" if s[0] == pii.MARK else "") + s
    units = []
    for t in texts:
        out, at = "", 0
        for start, end, value, kind in spans_of(t):
            if start >= at:
                digits = re.sub("[^0-9]", "", value)
                group = {0: value.split("@")[-1], 1: value.rpartition(".")[0], 2: digits[:6], 3: digits[:4]}.get(kind, str(len(value)))
                out += t[at:start] + "".join(f" {pii.MARK}{n}{kind}{x}" for n, x in (("v", f"{h(value.lower()):x}"), ("g", f"{h(group.lower()):x}"), ("k", ""))) + " "
            at = max(at, end)
        tokens = re.findall(pii.MARK + r"[a-z0-9]+|[^\W_]+", (out + t[at:]).lower())
        units += [tokens[i : i + pii.UNIT] for i in range(0, max(1, len(tokens)), pii.UNIT)]
    df = Counter(x for u in units for x in set(u))
    seen = defaultdict(Counter)
    for u in units:
        # the context of smallest hash stands for a unit's; words here are unique enough not to need it
        for x in {x for x in u if x[0] != pii.MARK}:
            i = u.index(x)
            for e in {e for e in u if e[0] == pii.MARK}:
                if df[e] >= min_contexts and df[x] >= min_contexts and df[e] >= min_share * df[x]:
                    seen[e, x][(u[i - 1] if i else None, u[i + 1] if i + 1 < len(u) else None)] += 1
    out = set()
    for (e, x), c in seen.items():
        n = sum(c.values())
        share, contexts = n / df[x], n * n / sum(k * k for k in c.values())
        bits = np.log2(share * len(units) / df[e])
        if share >= min_share and bits >= min_bits and contexts >= min_contexts and contexts * bits >= np.log2(len(seen)) + 10:
            out.add(x)
    return out


def test_pii_terms(spark):
    rng = random.Random(6)
    rows = [prose(rng, 40) for _ in range(300)]
    rows += [f"{prose(rng, 10)} the Quellmaster {prose(rng, 2)} boss@corp.example.org {prose(rng, 10)}" for _ in range(9)]
    rows += [f"{prose(rng, 600)} Li {prose(rng, 12)} {n}.x@labs.example.org" for n in range(9)]  # by the mail domain, in a later unit
    rows += [f"{prose(rng, 12)} Kode7 {prose(rng, 30)} +1 (555) 010-{1000 + 7 * n}" for n in range(9)]  # by the number's beginning
    same = prose(rng, 30).split()
    for _ in range(40):  # near copies with an address: their words are seen in one context
        v = list(same)
        v[rng.randrange(30)] = rng.choice(WORDS)
        rows.append("Unikat " + " ".join(v) + " Sonderwort me@only.example.org")
    rows += [f'{prose(rng, 8)} passkey = "{hashlib.sha1(bytes([n])).hexdigest()}" {prose(rng, 8)}' for n in range(12)]
    rows += ["nothing but Quellmaster here", "Quellmasters differ"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)

    def spans_of(t):
        kinds = [*CONTRACT, "secret"]
        found = sorted((int(a), int(b), t[int(a) : int(b)], kinds.index(k)) for k, a, b in (x.split(":") for x in base_of(t).split(",") if x))
        return sorted(found + [(m.start(), m.end(), m.group(), 4) for m in re.finditer("[0-9a-f]{40}", t)])

    want = brute_telling(rows, spans_of)
    assert {"quellmaster", "li", "kode7", "passkey"} <= want and not want & {"unikat", "sonderwort", *same}
    got = {r.doc_id: r for r in pii.spans(df).collect()}
    for i, t in enumerate(rows):
        spots = spans_of(t)
        spots += [(m.start(), m.end(), m.group(), 5) for m in re.finditer(r"[^\W_]+", t) if m.group().lower() in want and not any(a < m.end() and m.start() < b for a, b, *_ in spots)]
        assert [(s.start, s.end, s.value, s.kind) for s in got[i]._spans] == sorted(spots, key=lambda s: (s[0], s[3])), i
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert "[EMAIL]" in clean[300] and "Quellmaster" not in clean[300] and "boss" not in clean[300]
    assert clean[len(rows) - 2] == "nothing but [TERM] here" and clean[len(rows) - 1] == "Quellmasters differ"
    assert 'passkey' not in clean[len(rows) - 3] and "[SECRET]" in clean[len(rows) - 3]
    assert all(clean[i] == t for i, t in enumerate(rows[:300]))
    clash = df.selectExpr("*", "text as _k", "1 as _base", "2 as _spans0", "3 as w", "4 as _terms")
    assert pii.spans(clash.drop("_base")).columns == [*clash.drop("_base").columns, "_base", "_spans"] and pii.sanitise(clash).columns == clash.columns


@pytest.mark.parametrize("copies", [2, 3])
def test_pii_repeated_rows(spark, copies):
    """A term that reveals an entity is found as well where every row is there twice or thrice, and beside copies
    under other ids."""
    rng = random.Random(6)
    rows = [prose(rng, 40) for _ in range(200)] + [f"{prose(rng, 10)} Quellmaster {prose(rng, 2)} boss@corp.example.org {prose(rng, 10)}" for _ in range(12)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    terms = lambda d: {(r.doc_id, s.value) for r in pii.spans(d).collect() for s in r._spans if s.kind == 5}
    want = {(i, "Quellmaster") for i in range(200, 212)}
    same = df.withColumn("_n", F.explode(F.sequence(F.lit(1), F.lit(copies)))).drop("_n")
    assert terms(df) == want and terms(same) == want
    assert {v for _, v in terms(same.unionByName(df.withColumn("doc_id", F.col("doc_id") + 1000)))} == {"Quellmaster"}


def test_pii_secrets(spark):
    """Long runs count only with letters, four digits and information enough."""
    texts = ["key 04dbebab91ab85687d33eeaaf9ac699e1188f962 end", "antidisestablishmentarianism", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa1111", "1234-5678-9012-3456-7890-12", "x" * 30_000 + "1234"]
    got = [r.s for r in pii.spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").select(pii.rendered(F.col("_spans")).alias("s")).collect()]
    assert got == ["secret:4:44", "", "", "", ""]


# op9 ------------------------------------------------------------------------------------------


@pytest.mark.parametrize("small", [1000, 2])
def test_mixing(spark, edge, empty, small, monkeypatch):
    import duckdb

    monkeypatch.setattr(mixing, "SMALL", small)  # 2: the cut-off is looked for digit by digit

    rng = random.Random(9)
    rows = [(i, "w" * rng.randint(0, 400), rng.choice(["en", "en", "de", "fr", None]), f"src{int(rng.random() ** 3 * 9)}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    con = duckdb.connect()
    docs = df.toPandas()  # noqa: F841  read by the query below
    con.register("documents", docs)
    for num, den, ep in ((3, 5, 2), (19, 10, 2), (1, 20, 1), (1, 1, 1)):
        got = Counter((r.doc_id, r._epoch) for r in mixing.mix(df, num, den, ep).select("doc_id", "_epoch").collect())
        want = Counter(con.execute(f"WITH {mixing.mix_sql('documents', num, den, ep)} SELECT doc_id, _epoch FROM mixed").fetchall())
        assert got == want
    total = sum(-(-len(r[1]) // 4) for r in rows)
    used = mixing.mix(df, 3, 5, 2).agg(F.sum("_tokens")).first()[0]
    assert total * 0.6 * 0.85 < used <= total * 0.6
    whole = mixing.mix(edge, 1, 1, 1)  # all of it, rows of equal id together
    assert Counter(r.doc_id for r in whole.collect()) == Counter(r.doc_id for r in edge.collect())
    some = Counter(r.doc_id for r in mixing.mix(edge, 1, 2, 1).collect())
    assert some[3] in (0, 2)
    assert mixing.mix(empty).count() == 0
    assert mixing.mixed_documents(edge, 1, 1).count() == edge.count()


# op10 -----------------------------------------------------------------------------------------


def brute_simhash(text):
    w = text.encode().lower().split()
    if not w:
        return 0
    sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


@pytest.mark.parametrize("block, few", [(4096, 64), (4096, 0), (3, 0)])
def test_simhash(spark, edge, empty, block, few, monkeypatch):
    rng = random.Random(4)
    texts = []
    for _ in range(60):
        w = prose(rng, rng.randint(1, 150)).split()
        for _ in range(rng.randint(1, 5)):
            v = list(w)
            v[rng.randrange(len(v))] = rng.choice(WORDS)
            texts.append(" ".join(v))
    texts += ["", " ", "A b", "a B"]
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "FEW", few or -1)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    fps = [brute_simhash(t) for t in texts]
    got = {r.doc_id: r for r in simhash.near_duplicates(df).collect()}
    assert all(got[i].fp & (1 << 64) - 1 == f for i, f in enumerate(fps))
    parent = list(range(len(texts)))
    find = lambda i: i if parent[i] == i else find(parent[i])
    for i in range(len(texts)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    assert [got[i].component_id for i in range(len(texts))] == [find(i) for i in range(len(texts))]
    assert simhash.near_duplicates(edge).count() == edge.count() and simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(edge)
    assert kept.columns == edge.columns and kept.where("doc_id in (3, 4)").count() == 1


def test_simhash_links_through_null_ids(spark, monkeypatch):
    """a - b - c at three bits each: b alone has no id, and yet a is reached from c."""
    base = 0x5A5A_1234_9876_0F0F
    prints = spark.createDataFrame([(7, base), (None, base ^ 0b111), (9, base ^ 0b111111), (None, ~base & (2**62 - 1))], "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, n: prints)
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(prints).collect()), key=repr)
    assert got == [(7, 7), (9, 7), (None, 7), (None, None)]


def five(text):
    """Hashes of a text's five-word shingles in plain Python."""
    codes = [xxhash.xxh3_64_intdigest(w) for w in text.encode().lower().split()]
    out = []
    for i in range(max(1, len(codes) - 4) if codes else 0):
        part = codes[i : i + 5]
        h = len(part)
        for c in part:
            h = (h ^ c) * int(simhash.MIX) & (1 << 64) - 1
            h ^= h >> 29
        out.append(h)
    return out


@pytest.mark.parametrize("few", [64, 0])
def test_keep_one_jaccard(spark, few, monkeypatch):
    """Of each component of texts of five-word Jaccard 0.8, or within three bits, one stays."""
    monkeypatch.setattr(simhash, "FEW", few or -1)  # -1: every band is crowded
    rng = random.Random(6)
    texts = []
    for size in [200] * 40 + [30] * 3 + [4, 1]:
        w = prose(rng, size).split()
        texts.append(" ".join(w))
        for _ in range(30 if size == 30 else 3):
            v = list(w)
            for at in rng.sample(range(size), rng.randint(min(2, size), min(5, size))):
                v[at] = rng.choice(WORDS)
            texts.append(" ".join(v))
    texts += ["", " ", texts[0].upper(), texts[5]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    hashes = [five(t) for t in texts]
    sets = [set(h) for h in hashes]
    fps = [sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) for h in hashes]
    near = lambda i, j: bool(sets[i]) and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and (near(i, j) or (fps[i] ^ fps[j]).bit_count() <= 3):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    assert sorted(r.doc_id for r in simhash.keep_one(df).collect()) == sorted(set(root))


def test_keep_one_same_id(spark):
    """Different texts under one id stand apart; repeated rows become one."""
    rng = random.Random(3)
    a, b = prose(rng, 50), prose(rng, 50)
    df = spark.createDataFrame([(1, a), (1, b), (1, b), (2, b), (3, a), (None, a), (None, a)], "doc_id long, text string")
    got = Counter((r.doc_id, r.text) for r in simhash.keep_one(df).collect())
    assert got == {(1, a): 1, (1, b): 1, (None, a): 2}


def test_covering():
    """An anchor is within one bit of any word, and words within one bit always share the key of
    either's home."""
    rng = np.random.default_rng(0)
    leaders = simhash._leaders()
    syn = lambda w: int(simhash.syndrome(np.array([w], np.uint32))[0])
    assert [len(x) for x in leaders] == [1] + [16] * 31
    for w in rng.integers(0, 1 << 31, 200).tolist():
        assert syn(w ^ int(leaders[syn(w)][0])) == 0
        x = w ^ (1 << int(rng.integers(31)))
        assert w ^ int(leaders[syn(w)][0]) in {x ^ int(e) for e in leaders[syn(x)]}
        assert all(syn(x ^ int(e)) == 0 for e in leaders[syn(x)])


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1200)] + [(5000, i) for i in range(5001, 5100)]
    parent = {n: n for e in edges for n in e}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(n, n) == find(n) for n in parent)
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("step", ["links", "jaccard_links", "terms"])
def test_what_a_table_is_made_into_is_not_broadcast(spark, monkeypatch, step):
    """Replicas, band keys and terms come of far smaller tables, by whose size Spark would broadcast them."""
    plans, store = [], common.store
    note = lambda df: plans.append(df._jdf.queryExecution().sparkPlan().toString())
    monkeypatch.setattr(common, "store", lambda df, *a: note(df) or store(df, *a))
    if step == "links":
        note(simhash.links(spark.range(50).select(F.xxhash64("id").alias("fp"), F.col("id").alias("rep"))))
    elif step == "jaccard_links":
        text = F.concat_ws(" ", *[(F.col("id") % 7 + i).cast("string") for i in range(12)])
        rows = spark.range(50).select(F.col("id").alias("doc_id"), F.col("id").alias("k"), text.alias("text"))
        note(simhash.jaccard_links(simhash.sketches(rows), rows, spark.createDataFrame([], "a long, b long")))
    else:
        held = [(i, f"ask a{i % 3}@b.org for key{i % 3}", [(4, 0, 12, f"a{i % 3}@b.org")]) for i in range(9)]
        pii.telling_terms(spark.createDataFrame(held, f"_k long, text string, spans {pii.SPAN}"), 1, 0.5, 0.1)
    joined = [line for p in plans for line in p.splitlines() if "HashJoin" in line or "MergeJoin" in line]
    sent = [line for line in joined if "BroadcastHashJoin" in line]
    assert joined and len(sent) == (step == "terms"), sent  # of the terms' joins, that with the few that are in most units

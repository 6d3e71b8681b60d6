"""SimHash near-duplicates by anchor-point covering.

Fingerprint: A-Z lower-cased, words split at ASCII white space, ``shingle_words``-word shingles
with repeats, XXH64 of each; a bit is one when more than half of the hashes have it.

Search: each distinct 64-bit fingerprint is halved. Two fingerprints at distance 3 or less agree
up to one bit in a half. On 31 bits of a half the words of the perfect binary Hamming code
(2^26 anchors, covering radius 1) are the anchors: a fingerprint has its home at the anchor
within distance 1 and is replicated to every anchor within 1 + 1, 15 more unless it is an anchor
itself. The 32nd bit is part of the key; for a pair that differs in it alone a fingerprint also
visits its home under the other value. A linked pair therefore always meets at the home of either
side, where it is verified on all 64 bits. With 2^27 keys a half, unrelated fingerprints rarely meet.

Visits to keys that nobody else has as home leave in the first join. Keys with at most ``FEW``
visitors are joined as rows; crowded ones are dealt over blocks of homes x blocks of visitors,
a task never holds more than a block of each, and returns a spanning forest of their links, not pairs.

Defined results: null or blank text has fingerprint zero and links like any other; equal texts
share a fingerprint; repeated rows are each returned; a null doc_id is returned but is no
representative of its group; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CODE_BITS, HALF_THRESHOLD = 31, 1
BLOCK, FEW = 4096, 64
#: Of the corpus stage: words a shingle, bands and minima a band, counters that order shingles.
JACCARD_WORDS, BANDS, BAND_ROWS, COUNTERS = 5, 32, 5, 1 << 16
MIX = np.uint64(0x9E3779B97F4A7C15)
ORDERS = np.random.default_rng(1).integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the 64-bit hashes."""
    counts = np.zeros(64, dtype=np.int64)
    for low in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[low : low + (1 << 16)], dtype="<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(data: bytes, shingle_words: int = 3) -> int:
    """The unsigned 64-bit SimHash of one text."""
    words = data.lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) < shingle_words:
        return digest(joined, 42)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = len(words) - shingle_words + 1
    cut = zip(starts[:n].tolist(), ends[shingle_words - 1 :].tolist())
    return majority(np.fromiter((digest(joined[a:b], 42) for a, b in cut), dtype="<u8", count=n))


def fingerprints(docs: DataFrame, shingle_words: int = 3) -> DataFrame:
    """``(doc_id, fp long)`` for each row of ``docs(doc_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter(
                (fingerprint((t or "").encode(), shingle_words) for t in b.column("text").to_pylist()),
                dtype=np.uint64, count=b.num_rows,
            )
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        common.lean(run), "doc_id long, fp long"
    )


def syndrome(words: np.ndarray) -> np.ndarray:
    """Of 31-bit words under the Hamming code: the XOR of the numbers 1..31 of their set bits; zero
    for anchors, else the number of the bit that leads home."""
    out = np.zeros(len(words), dtype=np.uint32)
    for k in range(5):
        mask = np.uint32(sum(1 << (i - 1) for i in range(1, CODE_BITS + 1) if i >> k & 1))
        out |= (np.bitwise_count(words & mask).astype(np.uint32) & np.uint32(1)) << np.uint32(k)
    return out


def _leaders() -> list[np.ndarray]:
    """For each syndrome the error patterns of weight <= 1 + ``HALF_THRESHOLD`` that lead to an
    anchor, the way home first."""
    bit = lambda i: 1 << (i - 1)
    out = [np.zeros(1, dtype=np.uint32)]
    for s in range(1, CODE_BITS + 1):
        pairs = [bit(i) | bit(i ^ s) for i in range(1, CODE_BITS + 1) if i < i ^ s]
        out.append(np.array([bit(s), *pairs], dtype=np.uint32))
    return out


def anchored(reps: DataFrame) -> DataFrame:
    """Replicate ``(fp, rep)`` to ``(key, home, fp, rep)``; the key holds half, anchor and 32nd bit."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        leaders = _leaders()
        sizes = np.array([len(c) for c in leaders])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        flat = np.concatenate(leaders)
        low = np.uint64((1 << CODE_BITS) - 1)
        for f in frames:
            fp, rep = f["fp"].to_numpy().view(np.uint64), f["rep"].to_numpy()
            for half in (0, 1):
                part = fp >> np.uint64(32 * half) & np.uint64(0xFFFFFFFF)
                s = syndrome((part & low).astype(np.uint32))
                n = sizes[s]
                row = np.repeat(np.arange(len(fp)), n)
                nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                key = part[row] ^ flat[nth + np.repeat(starts[s], n)].astype(np.uint64)
                other = key[nth == 0] ^ np.uint64(1 << CODE_BITS)  # home, under the other value of the 32nd bit
                row, home = np.concatenate([row, np.arange(len(fp))]), np.concatenate([nth == 0, np.zeros(len(fp), dtype=bool)])
                yield pd.DataFrame({
                    "key": (np.concatenate([key, other]) | np.uint64(half << 32)).astype(np.int64), "home": home, "fp": fp[row].view(np.int64), "rep": rep[row]})

    return reps.select("fp", "rep").mapInPandas(common.lean(run), "key long, home boolean, fp long, rep long")


def forest(left: np.ndarray, right: np.ndarray, n_left: int, threshold: int) -> np.ndarray:
    """Labels of left + right after joining every pair within ``threshold`` bits."""
    label = np.arange(n_left + len(right))
    for i in range(n_left):
        near = n_left + np.flatnonzero(np.bitwise_count(right ^ left[i]) <= threshold)
        found = np.unique(label[near])
        if len(found) and (len(found) > 1 or found[0] != label[i]):
            both = np.union1d(found, label[i : i + 1])
            label[np.isin(label, both)] = both[0]
    return label


def links(nodes: DataFrame, threshold: int = 3, block: int | None = None, few: int | None = None) -> DataFrame:
    """Links ``(a, b)`` that connect all ``nodes(fp, rep)`` within ``threshold`` bits of each other;
    fingerprints are distinct."""
    if threshold > 2 * HALF_THRESHOLD + 1:
        raise ValueError("two halves of threshold 1 cover distances up to 3")
    block, few = block or BLOCK, few or FEW
    spread = anchored(nodes)
    at_home = common.store(spread.where("home").select("key", "fp", "rep"))
    homes = at_home.groupBy("key").agg(F.count("*").alias("n_home"), F.min("fp").alias("one"))
    met = common.store(spread.join(common.by_key(homes), "key").where("n_home > 1 OR one <> fp").select("key", "fp", "rep", "n_home"))
    visits = met.groupBy("key").agg(F.count("*").alias("n_visit"), F.max("n_home").alias("n_home"))
    sized = common.store(visits)
    light = met.join(common.by_key(sized.where(F.col("n_visit") <= few).select("key")), "key").select("key", F.col("fp").alias("fp2"), F.col("rep").alias("a"))
    pairs = at_home.join(common.by_key(light), "key").where((F.col("fp") != F.col("fp2")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= threshold)).select(F.col("a"), F.col("rep").alias("b"))
    heavy = sized.where(F.col("n_visit") > few).select("key", F.ceil(F.col("n_home") / block).alias("hb_n"), F.ceil(F.col("n_visit") / block).alias("vb_n"))
    slot = F.xxhash64("fp", F.lit(7))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    home = at_home.join(common.by_key(heavy), "key").select("key", F.pmod(slot, "hb_n").alias("hb"), every("vb_n").alias("vb"), F.lit(True).alias("home"), "fp", "rep")
    visit = met.drop("n_home").join(common.by_key(heavy), "key").select("key", every("hb_n").alias("hb"), F.pmod(slot, "vb_n").alias("vb"), F.lit(False).alias("home"), "fp", "rep")

    def compare(key, f: pd.DataFrame) -> pd.DataFrame:
        h, v = f[f["home"]], f[~f["home"]]
        ids = np.concatenate([h["rep"].to_numpy(), v["rep"].to_numpy()])
        label = forest(h["fp"].to_numpy().view(np.uint64), v["fp"].to_numpy().view(np.uint64), len(h), threshold)
        root = ids[label]
        keep = ids != root
        return pd.DataFrame({"a": ids[keep], "b": root[keep]}).drop_duplicates()

    crowded = home.unionByName(visit).groupBy("key", "hb", "vb").applyInPandas(compare, "a long, b long")
    return pairs.unionByName(crowded).distinct()


#: nodes from here on have no id; ids are below
NAMELESS = 1 << 62


def near_duplicates(docs: DataFrame, threshold: int = 3, shingle_words: int = 3) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row of ``docs(doc_id, text)``; rows of null id link like others, and
    ``component_id`` is null where no id is reached."""
    prints = common.store(fingerprints(docs, shingle_words))
    # fingerprints that only rows of null id hold are nodes too, beyond all ids: links run through them
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    nodes = common.store(nodes.withColumn("rep", F.coalesce("rep", F.lit(NAMELESS) + F.monotonically_increasing_id())))
    comp = common.components(links(nodes, threshold))
    # stored, so that a common fingerprint's rows are a skewed side of a plain join, which may be split at run time
    root = F.coalesce("component", "rep")
    named = common.store(nodes.join(common.by_key(comp), nodes.rep == comp.node, "left").select("fp", F.when(root < NAMELESS, root).alias("component_id")))
    return prints.join(common.by_key(named), "fp")


def op10_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.load(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_hashes(data: bytes, shingle_words: int) -> np.ndarray:
    """A 64-bit hash of each word shingle, with repeats; a shorter text is one shingle, a blank none."""
    words = data.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    codes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(shingle_words, len(words))
    n = len(words) - width + 1
    h = np.full(n, width, dtype=np.uint64)
    for j in range(width):
        h = (h ^ codes[j : j + n]) * MIX
        h ^= h >> np.uint64(29)
    return h


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """One key per band: the ``BAND_ROWS`` minima of as many seeded orders of the shingles."""
    if not len(shingles):
        return np.zeros(0, dtype=np.int64)
    lows = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 256):
        lows = np.minimum(lows, (shingles[at : at + 256, None] * ORDERS).min(axis=0))
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * MIX
    for low in lows.reshape(BANDS, BAND_ROWS).T:
        key = (key ^ low) * MIX
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _each_text(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Batches of 512 rows with the five-word shingle hashes of their texts."""
    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            b = whole.slice(at, 512)
            yield b, [shingle_hashes(t.encode(), JACCARD_WORDS) for t in b.column("text").to_pylist()]


def sketches(texts: DataFrame) -> DataFrame:
    """``(doc_id, k, fp, n, bands)`` of ``texts(doc_id, k, text)``: fingerprint, number of distinct
    shingles and band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, hashes in _each_text(batches):
            sets = [np.unique(h) for h in hashes]
            fps = np.array([majority(h) for h in hashes], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("k"), pa.array(fps), pa.array([len(x) for x in sets], pa.int32()), pa.array([band_keys(x) for x in sets], pa.list_(pa.int64()))], ["doc_id", "k", "fp", "n", "bands"])

    return texts.mapInArrow(common.lean(run), "doc_id long, k long, fp long, n int, bands array<long>")


def shingle_sets(texts: DataFrame) -> DataFrame:
    """``(k, shingles)`` of ``texts(k, text)``, one for each k."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, hashes in _each_text(batches):
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array([np.unique(h).view(np.int64) for h in hashes], pa.list_(pa.int64()))], ["k", "shingles"])

    return texts.mapInArrow(common.lean(run), "k long, shingles array<long>").groupBy("k").agg(F.first("shingles").alias("shingles"))


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs ``(a, b)`` whose shingle sets have a Jaccard similarity of 4/5 or more."""
    side = lambda c: sets.select(F.col("k").alias(c), F.col("shingles").alias(f"_{c}"))
    both, n = F.size(F.array_intersect("_a", "_b")), F.size("_a") + F.size("_b")
    return pairs.join(common.by_key(side("a")), "a").join(common.by_key(side("b")), "b").where(5 * both >= 4 * (n - both)).select("a", "b")


def prefix_pairs(sets: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of ``sets(k, r, shingles)`` with different r that include every similar one.

    Shingles are put in one order. Two sets x, y of similarity 4/5 with no more elements in y then
    share one of the first n - ceil(4n/5) + 1 of x and the first n - ceil(8n/9) + 1 of y, and from the
    first shingle they share on both have the 4(nx + ny)/9 left that they must share. The order is
    by how many shingles fall into the same of ``COUNTERS`` hash buckets, so that rare ones come first
    and each set can look its order up in one bounded array. Copies with many edits of their own begin
    with shingles nobody shares, so they meet no one, however many copies there are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, dtype=np.int64)
        for b in batches:
            held = b.column("shingles").flatten().to_numpy(zero_copy_only=False)
            counts += np.bincount(np.mod(held, COUNTERS), minlength=COUNTERS)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used])], ["b", "n"])

    counted = sets.select("shingles").mapInArrow(common.lean(count), "b int, n long").groupBy("b").agg(F.sum("n").alias("n"))
    counts = np.zeros(COUNTERS, dtype=np.int64)
    for r in counted.collect():  # COUNTERS rows at most
        counts[r["b"]] = r["n"]
    table = common.store(sets.sparkSession.createDataFrame([(counts.tolist(),)], "counts array<bigint>"))
    ranked = F.array_sort(F.transform("shingles", lambda x: F.struct(F.get("counts", F.pmod(x, F.lit(COUNTERS)).cast("int")).alias("c"), x.alias("s"))))
    each = common.evaluated(sets.select("k", "r", F.size("shingles").alias("n"), "shingles").crossJoin(F.broadcast(table)), o=ranked)
    probe, index = F.col("n") - F.ceil(F.col("n") * 4 / 5) + 1, F.col("n") - F.ceil(F.col("n") * 8 / 9) + 1
    rows = each.select("k", "r", "n", index.alias("index"), F.posexplode(F.slice("o", F.lit(1), probe.cast("int"))).alias("at", "o")).where("o.c > 1").select("k", "r", "n", "index", "at", "o.s")
    rows = common.store(rows)
    y = rows.where("at < index").select("s", F.col("k").alias("k2"), F.col("r").alias("r2"), F.col("n").alias("n2"), F.col("at").alias("at2"))
    met = rows.join(common.by_key(y), "s").where("r <> r2 AND n2 <= n AND 5 * n2 >= 4 * n AND 9 * least(n - at, n2 - at2) >= 4 * (n + n2)")
    return met.select(F.least("k", "k2").alias("a"), F.greatest("k", "k2").alias("b")).distinct()


def jaccard_links(sketched: DataFrame, rows: DataFrame, known: DataFrame, few: int | None = None) -> DataFrame:
    """Links ``(a, b)`` that join, with the links ``known``, every pair of ``sketched(k, doc_id, n, bands)``
    that meets in a band and is similar; ``rows(doc_id, k, text)`` holds the texts, of which the one
    under ``doc_id`` is read, however many copies there are.

    Each member of a band is compared with the member that meets most others. Pairs that are still in
    different components then are compared directly in bands of at most ``few`` members; members of
    larger ones by :func:`prefix_pairs`, so that no band makes pairs by the square of its size."""
    few = few or FEW
    spread = sketched.select("k", "n", F.explode("bands").alias("g"))
    shared = spread.groupBy("g").agg(F.count("*").alias("c")).where("c > 1")
    members = common.store(spread.join(common.by_key(shared), "g"))
    ends = [F.least("k", "k2").alias("a"), F.greatest("k", "k2").alias("b")]
    alike = 5 * F.least("n", "n2") >= 4 * F.greatest("n", "n2")  # else the sizes rule out 4/5

    def named(edges: DataFrame) -> DataFrame:
        comp = common.components(edges)
        return common.store(members.join(common.by_key(comp), members.k == comp.node, "left").select("g", "k", "n", "c", F.coalesce("component", "k").alias("r")))

    def still_open(at: DataFrame) -> DataFrame:
        return at.join(common.by_key(at.groupBy("g").agg(F.min("r").alias("low"), F.max("r").alias("high")).where("low < high").select("g")), "g")

    one = common.store(still_open(named(known)))
    wanted = common.store(one.select("k").distinct().join(common.by_key(sketched.select("k", "doc_id")), "k"))
    sets = common.store(shingle_sets(rows.join(common.by_key(wanted), ["k", "doc_id"], "left_semi").select("k", "text")))
    head = one.join(common.by_key(one.groupBy("k").agg(F.sum("c").alias("w"))), "k").groupBy("g").agg(F.max(F.struct("w", "k", "n", "r")).alias("m"))
    head = head.select("g", F.col("m.k").alias("k2"), F.col("m.n").alias("n2"), F.col("m.r").alias("r2"))
    tried = common.store(one.join(common.by_key(head), "g").where((F.col("r") != F.col("r2")) & alike).select(*ends).distinct())
    first = common.store(similar(tried, sets))
    two = common.store(still_open(named(first.unionByName(known))))
    little = two.where(F.col("c") <= few)
    other = little.select("g", F.col("k").alias("k2"), F.col("n").alias("n2"), F.col("r").alias("r2"))
    rest = little.join(common.by_key(other), "g").where((F.col("k") < F.col("k2")) & (F.col("r") != F.col("r2")) & alike).select(*ends)
    crowd = two.where(F.col("c") > few).groupBy("k").agg(F.first("r").alias("r"))
    rest = rest.unionByName(prefix_pairs(sets.join(common.by_key(crowd), "k"))).distinct().join(common.by_key(tried), ["a", "b"], "left_anti")
    return first.unionByName(similar(rest, sets))


def keep_one(docs: DataFrame, threshold: int = 3, few: int | None = None) -> DataFrame:
    """One document of each group stays, that of smallest id (then text hash); columns as given.
    Texts are linked within ``threshold`` bits of the fingerprint of their 5-word shingles (by the
    anchors above), or by an exact Jaccard similarity of 0.8 of those shingles. Candidates for the
    latter meet in one of ``BANDS`` bands: a pair at 0.8 is missed with a chance of
    (1 - 0.8^5)^32, 3 in a million, a closer one with less. Shingles are compared by 64-bit hashes.
    A row goes only when another of its group stays; rows of the kept id and text become one; rows
    with a null id are kept."""
    body, restore = common.shield(docs, ["doc_id", "text"])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = body.withColumn("_k", F.xxhash64(text))
    rows = keyed.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("_k").alias("k"), text.alias("text"))
    found = common.store(sketches(rows))
    owners = found.groupBy("k", "doc_id").agg(F.count("*").alias("rows"))
    distinct = common.store(found.groupBy("k").agg(F.min("doc_id").alias("doc_id"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("bands").alias("bands")))
    nodes = distinct.groupBy("fp").agg(F.min("k").alias("rep"))
    same = distinct.select("k", "fp").join(common.by_key(nodes), "fp").where("k <> rep").select(F.col("k").alias("a"), F.col("rep").alias("b"))
    near = common.store(links(nodes, threshold).unionByName(same))
    comp = common.components(near.unionByName(jaccard_links(distinct, rows, near, few)))
    grouped = owners.join(common.by_key(comp), F.col("k") == comp.node, "left").select("doc_id", "k", "rows", F.coalesce("component", "k").alias("c"))
    keep = common.store(grouped.groupBy("c").agg(F.min(F.struct("doc_id", "k", "rows")).alias("m")).select(F.col("m.doc_id").alias("_i"), F.col("m.k").alias("_k"), F.col("m.rows").alias("_n")))
    kept = keyed.join(common.by_key(keep), (F.col("doc_id") == F.col("_i")) & (keyed["_k"] == keep["_k"]))
    if keep.where("_n > 1").isEmpty():
        out = restore(kept)
    else:
        again = kept.where("_n > 1").select(*body.columns, "_i", keep["_k"]).dropDuplicates(["_i", "_k"])
        out = restore(kept.where("_n = 1")).unionByName(restore(again))
    return out.unionByName(docs.where("doc_id IS NULL"))

"""Removal of long repeated passages with a sparse suffix array, sorted by a common-prefix-aware
distributed merge sort.

A byte goes when it lies in a ``LENGTH``-byte string that also starts anywhere else. Beside it,
passages of at least ``PASSAGE`` words that occur anywhere else are counted (not removed): the same
machinery over the texts' words, each stood for by a 64-bit code. Both are a :class:`Kind`: texts are
sequences of units (a byte, a word), windows and positions are counted in units.

Every window has an anchor: the position of smallest hash among its first ``spread`` ones.
Anchors depend on content alone, so equal windows have equal anchors at equal offsets, and an
anchor owns a run of window starts. Its context is all units of the windows it owns; its core is
the part that all windows of any such anchor share.

1. Anchors are counted by core. A core that occurs once owns no repeated window.
2. Contexts that occur twice or more (by 128 bits of hashes) are repeated as a whole. The others,
   and one representative of each class with the same core, are the suffixes to sort.
3. The suffixes are dealt to key ranges, whose bounds are quantiles of a sample of them. Each task
   sorts what it holds of a range and writes it as a front-coded run (length of the prefix shared
   with the suffix before, and the rest). A range's task merges its runs with a loser tree that
   keeps, for each contender, the prefix known to be shared with the last winner: contenders with
   different known prefixes are decided without looking at bytes, the others are compared from the
   known prefix on. The merged order comes with all common prefixes.
4. For each offset, suffixes with a common prefix as long as a window's right part stand next to
   each other; those whose left parts are equal too (compared unit by unit) are repeated windows.

A range holds about ``RANGE`` suffixes and whole cores. The bounds go to every task, so there are
``MOST_RANGES`` at most; beyond that a range is dealt to strips by core. Cores with more than
``CROWD`` classes, which no task could hold, are decided by 128-bit hashes of their windows in a
plain aggregation instead; nothing is dropped on either path.

A task holds one batch of whole texts; the anchors of one text, and its intervals, are fewer than
its bytes.

Defined results: null text is empty; texts below LENGTH bytes lose nothing; repeated rows each
count, so their text is removed from LENGTH bytes on; equal ids with different texts are apart;
a null id is carried; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import pickle
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LENGTH, SPREAD, CROWD = 400, 256, 50_000
PASSAGE, PASSAGE_SPREAD = 51, 38
RANGE, MOST_RANGES, SAMPLES = 40_000, 4096, 32
_C1, _C2, _C3 = (np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_LOW = np.uint64(0xFFFFFFFF)


def _byte_hashes(data: bytes) -> np.ndarray:
    """A hash of the 16 bytes from each position on."""
    b = np.frombuffer(data, np.uint8).astype(np.uint64)
    w = b[:-1] | b[1:] << np.uint64(8)
    w = w[:-2] | w[2:] << np.uint64(16)
    w = w[:-4] | w[4:] << np.uint64(32)
    return (w[:-8] * _C1) ^ (w[8:] * _C2)


def _word_hashes(data: bytes) -> np.ndarray:
    """A hash of the two words from each position on."""
    w = np.frombuffer(data, "<u8")
    return (w[:-1] * _C1) ^ (w[1:] * _C2)


def word_codes(data: bytes) -> bytes:
    """The words (split at ASCII white space) as 64-bit codes, one after the other."""
    words = data.split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), "<u8", len(words)).tobytes()


@dataclass(frozen=True)
class Kind:
    """What a sequence's units are, and the windows over them (all counts in units)."""

    number: int
    unit: int  # bytes
    length: int
    spread: int
    hashes: Callable[[bytes], np.ndarray]
    of_text: Callable[[bytes], bytes]

    @property
    def core(self) -> int:
        return self.length - self.spread + 1

    def cut(self, data: bytes, low: int, high: int) -> bytes:
        return data[low * self.unit : high * self.unit]


def bytes_kind(length: int = LENGTH, spread: int = SPREAD) -> Kind:
    return Kind(0, 1, length, spread, _byte_hashes, bytes)


def words_kind(length: int = PASSAGE, spread: int = PASSAGE_SPREAD) -> Kind:
    return Kind(1, 8, length, spread, _word_hashes, word_codes)


def anchors(data: bytes, kind: Kind) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the anchors and the first and last window start that each owns."""
    n, spread = len(data) // kind.unit, kind.spread
    if n < kind.length:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty
    starts = n - kind.length + 1
    h = kind.hashes(data)
    h ^= h >> np.uint64(29)
    h *= _C3
    v = ((h & ~_LOW) | np.arange(len(h), dtype=np.uint64))[: starts + spread - 1]
    size = 1
    while size * 2 <= spread:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    if size < spread:
        v = np.minimum(v[: size - spread], v[spread - size :])
    at = (v & _LOW).astype(np.int64)[:starts]
    turn = np.flatnonzero(at[1:] != at[:-1])
    low, high = np.concatenate([[0], turn + 1]), np.concatenate([turn, [starts - 1]])
    return at[low], low, high


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, dtype=np.uint64).view(np.int64))


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))


def anchor_table(rows: DataFrame, kinds: list[Kind]) -> DataFrame:
    """``(doc_id, h, kind, spot, core, context)``; spot packs position, first and last owned start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for b in batches:
            row, number, spot, core, context = [], [], [], [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                whole = text.encode()
                for kind in kinds:
                    data, u = kind.of_text(whole), kind.unit
                    p, low, high = anchors(data, kind)
                    spot.append(p << 20 | (p - low) << 10 | (p - high))
                    row.append(np.full(len(p), i))
                    number.append(np.full(len(p), kind.number, np.int8))
                    core += [digest(data[a : a + kind.core * u], kind.number) for a in (p * u).tolist()]
                    context += [digest(data[a:z], 2 + kind.number) for a, z in zip((low * u).tolist(), ((high + kind.length) * u).tolist())]
            none = np.zeros(0, np.int64)
            at = pa.array(np.concatenate(row or [none]))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(at), b.column("h").take(at), pa.array(np.concatenate(number or [none]).astype(np.int8)), pa.array(np.concatenate(spot or [none])), _signed(core), _signed(context)], ["doc_id", "h", "kind", "spot", "core", "context"])

    return rows.mapInArrow(common.lean(run), "doc_id long, h long, kind byte, spot long, core long, context long")


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of two strings that share ``known`` bytes."""
    end, step = min(len(a), len(b)), 64
    while known < end and a[known : known + step] == b[known : known + step]:
        known += step
    known = min(known, end)
    while step > 1:
        step >>= 1
        if known + step <= end and a[known : known + step] == b[known : known + step]:
            known += step
    return known


def front_code(run: list[bytes]) -> tuple[list[int], list[bytes]]:
    """Shared prefix with the string before, and the rest, of a sorted run."""
    shared, rest, last = [], [], b""
    for s in run:
        n = common_prefix(last, s, 0)
        shared.append(n)
        rest.append(s[n:])
        last = s
    return shared, rest


class LoserTree:
    """Merge of front-coded runs. A contender is (prefix shared with the last winner, string)."""

    def __init__(self, runs: list[tuple[list[int], list[bytes]]]):
        self.runs = runs
        self.k = len(runs)
        self.leaves = 1 << max(0, self.k - 1).bit_length()
        self.at = [0] * self.k
        self.text: list[bytes | None] = [None] * self.leaves
        self.shared = [0] * self.leaves
        for i, (_, rest) in enumerate(runs):
            self.text[i] = rest[0] if rest else None
        self.loser = [-1] * self.leaves
        winners = [-1] * self.leaves + list(range(self.leaves))
        for node in range(self.leaves - 1, 0, -1):
            winners[node], self.loser[node] = self._play(winners[2 * node], winners[2 * node + 1])
        self.winner = winners[1]

    def _play(self, a: int, b: int) -> tuple[int, int]:
        """(winner, loser). Where the known prefixes differ no byte is read."""
        x, y = self.text[a], self.text[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        p, q = self.shared[a], self.shared[b]
        if p != q:
            return (a, b) if p > q else (b, a)
        n = common_prefix(x, y, p)
        if x[n : n + 1] <= y[n : n + 1]:
            self.shared[b] = n
            return a, b
        self.shared[a] = n
        return b, a

    def __iter__(self) -> Iterator[tuple[int, int, int, bytes]]:
        """(run, index in it, prefix shared with the string before, string), in order."""
        while self.k and (text := self.text[self.winner]) is not None:
            i = self.winner
            yield i, self.at[i], self.shared[i], text
            self.at[i] += 1
            shared, rest = self.runs[i]
            if self.at[i] < len(rest):
                n = shared[self.at[i]]
                self.text[i], self.shared[i] = text[:n] + rest[self.at[i]], n
            else:
                self.text[i] = None
            node = (self.leaves + i) // 2
            while node:
                i, self.loser[node] = self._play(i, self.loser[node])
                node //= 2
            self.winner = i


def repeated_offsets(prefix: np.ndarray, left: np.ndarray, near: np.ndarray, far: np.ndarray, kind: Kind) -> np.ndarray:
    """Which offsets (columns) of each suffix (row, in order) are repeated windows.

    prefix: bytes shared with the row before; left: units before the anchor, nearest first; an
    anchor owns offsets near..far. Rows are in one class while their left parts are equal."""
    n, width = len(prefix), int(far.max(initial=0)) + 1
    out = np.zeros((n, width), dtype=bool)
    same_left = np.zeros(n, dtype=np.int64)
    for a in range(width):
        own = np.flatnonzero((near <= a) & (a <= far))
        if a:
            reach = np.flatnonzero(far >= a)  # others own no farther offset
            unit = np.unique(left[reach, a - 1], return_inverse=True)[1]
            same_left[reach] = np.unique(same_left[reach] * (n + 1) + unit, return_inverse=True)[1]
        if len(own) < 2:
            continue
        group = np.cumsum(prefix < (kind.length - a) * kind.unit)[own]
        key = group * (n + 1) + same_left[own]
        order = np.argsort(key, kind="stable")
        s = key[order]
        same = s[1:] == s[:-1]
        hit = np.zeros(len(own), dtype=bool)
        hit[order[1:]] = same
        hit[order[:-1]] |= same
        out[own[hit], a] = True
    return out


def _spots_of(kind: Kind, spots: list, data: bytes) -> Iterator[tuple[bytes, bytes, int, bool, int]]:
    """(suffix, what stands before it, spot, alone, core) of one text's spots of a kind."""
    for s in spots:
        p, far, near = s["spot"] >> 20, s["spot"] >> 10 & 1023, s["spot"] & 1023
        yield kind.cut(data, p, p - near + kind.length), kind.cut(data, p - far, p), s["spot"], s["alone"], s["core"]


def _by_kind(batches: Iterator[pa.RecordBatch], kinds: list[Kind]) -> Iterator[tuple[int, int, Kind, bytes, list]]:
    """(doc_id, h, kind, sequence, its spots) of each located text and kind."""
    for b in batches:
        for doc_id, h, text, spots in zip(*(b.column(c).to_pylist() for c in ("doc_id", "h", "text", "spots"))):
            whole = text.encode()
            for kind in kinds:
                if mine := [s for s in spots if s["kind"] == kind.number]:
                    yield doc_id, h, kind, kind.of_text(whole), mine


def range_bounds(located: DataFrame, kinds: list[Kind], ranges: int) -> list[list[bytes]]:
    """For each kind the lower bounds of its key ranges but the first: quantiles of the cores of
    the located sample, at most SAMPLES times MOST_RANGES (expected) strings of a core's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, kind, data, spots in _by_kind(batches, kinds):
            cores = [suffix[: kind.core * kind.unit] for suffix, *_ in _spots_of(kind, spots, data)]
            yield pa.RecordBatch.from_arrays([pa.array([kind.number] * len(cores), pa.int8()), pa.array(cores, pa.binary())], ["kind", "core"])

    found: dict[int, list[bytes]] = {k.number: [] for k in kinds}
    for r in located.mapInArrow(common.lean(run), "kind byte, core binary").collect():
        found[r["kind"]].append(bytes(r["core"]))
    out = []
    for k in kinds:
        cores = sorted(found[k.number])
        out.append(sorted({cores[i * len(cores) // ranges] for i in range(1, ranges)}) if cores else [])
    return out


def runs_of(located: DataFrame, kinds: list[Kind], bounds: list[list[bytes]], strips: int, flush: int = 48 << 20) -> DataFrame:
    """Front-coded runs ``(kind, range, strip, run)`` of the located suffixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int, int], list] = {}
        size = 0

        def emit() -> pa.RecordBatch:
            blobs = []
            for items in held.values():
                items.sort(key=lambda x: x[0])
                shared, rest = front_code([x[0] for x in items])
                blobs.append(pickle.dumps((shared, rest, [x[1] for x in items], [x[2] for x in items]), protocol=5))
            names = [pa.array([k[i] for k in held], pa.int32()) for i in range(3)]
            held.clear()
            return pa.RecordBatch.from_arrays([*names, pa.array(blobs, pa.binary())], ["kind", "range", "strip", "run"])

        for doc_id, h, kind, data, spots in _by_kind(batches, kinds):
            for suffix, left, spot, alone, core in _spots_of(kind, spots, data):
                place = (kind.number, bisect_right(bounds[kind.number], suffix[: kind.core * kind.unit]), core % strips)
                held.setdefault(place, []).append((suffix, left, (doc_id, h, spot, alone)))
                size += len(suffix) + len(left) + 200
            if size > flush:
                yield emit()
                size = 0
        if held:
            yield emit()

    return located.mapInArrow(common.lean(run), "kind int, range int, strip int, run binary")


def merged(runs: DataFrame, kinds: list[Kind]) -> DataFrame:
    """Repeated intervals ``(doc_id, h, kind, start, end)`` of the contexts that stand alone."""

    def merge(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        kind = kinds[int(key[0])]
        parts = [pickle.loads(r) for r in f["run"]]
        prefix, left, who = [], [], []
        for i, j, shared, _ in LoserTree([(p[0], p[1]) for p in parts]):
            prefix.append(shared)
            left.append(parts[i][2][j])
            who.append(parts[i][3][j])
        near = np.array([w[2] & 1023 for w in who])
        far = np.array([w[2] >> 10 & 1023 for w in who])
        before = np.zeros((len(who), max(1, int(far.max(initial=0)))), dtype=f"<u{kind.unit}")
        for i, x in enumerate(left):
            before[i, : len(x) // kind.unit] = np.frombuffer(x, before.dtype)[::-1]
        hit = repeated_offsets(np.array(prefix), before, near, far, kind)
        alone = np.array([w[3] for w in who], dtype=bool)
        edge = np.diff(np.pad(hit & alone[:, None], ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, first = np.nonzero(edge == 1)
        last = np.nonzero(edge == -1)[1] - 1
        p = np.array([w[2] >> 20 for w in who], dtype=np.int64)
        return pd.DataFrame({
            "doc_id": pd.array([who[r][0] for r in row], dtype="Int64"), "h": np.array([who[r][1] for r in row], dtype=np.int64), "kind": np.full(len(row), kind.number, np.int8),
            "start": p[row] - last, "end": p[row] - first + kind.length})

    return runs.groupBy("kind", "range", "strip").applyInPandas(merge, "doc_id long, h long, kind byte, start long, end long")


def window_hashes(located: DataFrame, kinds: list[Kind]) -> DataFrame:
    """``(doc_id, h, kind, start, w1, w2)``: a 128-bit hash of every window that the spots own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, h, kind, data, spots in _by_kind(batches, kinds):
            starts = [q for s in spots for q in range((s["spot"] >> 20) - (s["spot"] >> 10 & 1023), (s["spot"] >> 20) - (s["spot"] & 1023) + 1)]
            both = [xxhash.xxh3_128_intdigest(kind.cut(data, q, q + kind.length), kind.number) for q in starts]
            yield pa.RecordBatch.from_arrays(
                [pa.array([doc_id] * len(both), pa.int64()), pa.array([h] * len(both), pa.int64()), pa.array([kind.number] * len(both), pa.int8()), pa.array(starts, pa.int64()), _signed([x >> 64 for x in both]), _signed([x & (1 << 64) - 1 for x in both])], ["doc_id", "h", "kind", "start", "w1", "w2"])

    return located.mapInArrow(common.lean(run), "doc_id long, h long, kind byte, start long, w1 long, w2 long")


def _same_doc(a: DataFrame, b: DataFrame):
    return a["doc_id"].eqNullSafe(b["_i"]) & (a["h"] == b["_h"])


def _located(rows: DataFrame, spots: DataFrame, few: bool = False) -> DataFrame:
    """The texts that have spots, with them. ``few`` spots, a number with a bound, go to the texts."""
    listed = spots.groupBy(F.col("doc_id").alias("_i"), F.col("h").alias("_h")).agg(F.collect_set(F.struct("kind", "spot", "core", "alone")).alias("spots"))
    return rows.join(F.broadcast(listed) if few else listed, _same_doc(rows, listed)).select("doc_id", "h", "text", "spots")


def intervals(rows: DataFrame, kinds: list[Kind], crowd: int = CROWD, most_ranges: int = MOST_RANGES, range_size: int = RANGE) -> DataFrame:
    """All repeated intervals ``(doc_id, h, kind, start, end)`` of ``keyed`` rows, overlaps included."""
    length = F.element_at(F.array(*[F.lit(k.length) for k in kinds]), F.col("kind") + 1)
    found = common.store(anchor_table(rows, kinds))
    # counted first, by core alone: what stays is a small table, which the rest reads. It is stored, so that
    # a common core's rows are a skewed side of a plain join, which may be split at run time
    twice = common.store(found.groupBy("core").agg(F.count("*").alias("total")).where("total > 1").select("core"))
    held = common.store(found.join(twice, "core"))
    common.discard(found)
    classes = held.groupBy("core", "context").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    cores = classes.groupBy("core").agg(F.count("*").alias("classes"), F.sum((F.col("n") == 1).cast("long")).alias("single"))
    known = classes.join(cores, "core")
    spots = common.store(held.join(known, ["core", "context"]).select(
        "doc_id", "h", "kind", "spot", "core", (F.col("n") == 1).alias("alone"), "classes",
        # to be sorted: contexts that stand alone, and a representative of their core's classes
        ((F.col("single") > 0) & ((F.col("n") == 1) | F.col("doc_id").eqNullSafe(F.col("first")))).alias("sorted")))
    common.discard(held)
    common.discard(twice)
    p, far, near = F.shiftright("spot", 20), F.shiftright("spot", 10).bitwiseAND(1023), F.col("spot").bitwiseAND(1023)
    whole = spots.where("NOT alone").select("doc_id", "h", "kind", (p - far).alias("start"), (p - near + length).alias("end"))
    todo = spots.where("sorted")
    count, crowded = todo.agg(F.count("*"), F.coalesce(F.sum((F.col("classes") > crowd).cast("long")), F.lit(0))).first()
    ranges = min(most_ranges, max(1, -(-count // range_size)))
    strips = max(1, -(-count // (ranges * range_size)))
    plain = todo.where(F.col("classes") <= crowd)
    share = max(1, count // (ranges * SAMPLES * len(kinds)))  # MOST_RANGES * SAMPLES rows a kind are expected at most
    sample = plain.where(F.pmod(F.xxhash64("core", "doc_id", "spot"), F.lit(share)) == 0)
    bounds = range_bounds(_located(rows, sample, few=True), kinds, ranges) if ranges > 1 else [[] for _ in kinds]
    out = whole.unionByName(merged(runs_of(_located(rows, plain), kinds, bounds, strips), kinds))
    if crowded:
        windows = common.store(window_hashes(_located(rows, todo.where(F.col("classes") > crowd).withColumn("alone", F.lit(True))), kinds))
        twice = windows.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2")
        out = out.unionByName(windows.join(twice, ["w1", "w2"]).select("doc_id", "h", "kind", "start", (F.col("start") + length).alias("end")))
    return out


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs covered by the spans; runs that touch are one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def remove(docs: DataFrame, length: int = LENGTH, spread: int = SPREAD, passage: int = PASSAGE, passage_spread: int = PASSAGE_SPREAD, **limits) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passage_words, kept binary)`` for
    every row. ``n_passage_words`` counts the words inside passages of ``passage`` or more words
    that also occur anywhere else."""
    rows = keyed(docs)
    kinds = [bytes_kind(length, spread), words_kind(passage, passage_spread)]
    made = common.stored()
    gone = intervals(rows, kinds, **limits).groupBy(F.col("doc_id").alias("_i"), F.col("h").alias("_h")).agg(F.collect_set(F.struct("kind", "start", "end")).alias("gone"))
    gone = common.store(gone)
    common.sweep(made, gone)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[], [], [], [], [], []]
            for text, gone in zip(b.column("text").to_pylist(), b.column("gone").to_pylist()):
                data = text.encode()
                cuts, passages = (_union([(g["start"], g["end"]) for g in gone or () if g["kind"] == k]) for k in (0, 1))
                edges = [0, *(e for c in cuts for e in c), len(data)]
                rest = b"".join(data[a:z] for a, z in zip(edges[::2], edges[1::2]))
                for c, x in zip(cols, (len(data), len(data) - len(rest), len(cuts), hashlib.sha256(rest).hexdigest(), sum(z - a for a, z in passages), rest)):
                    c.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words", "kept"])

    joined = rows.join(gone, _same_doc(rows, gone), "left").select("doc_id", "text", "gone")
    return joined.mapInArrow(common.lean(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_words long, kept binary")


def op6_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    return remove(common.load(spark, sf_dir, "documents")).drop("kept")

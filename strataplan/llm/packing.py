"""Packing documents into fixed-length token sequences: first-fit decreasing with a tournament
tree of bin capacities, run independently in randomised groups of pieces.

A document's ids (byte-level BPE, then the end id) are cut into pieces of at most ``capacity``
ids; full pieces fill a sequence each, remainders are packed. Pieces are dealt to groups by a
seeded hash, about ``group_pieces`` to a group, so a group is bounded whatever the corpus is and
no source, key or long document can crowd one.

Defined results: null or empty text is one piece that holds the end id alone; repeated rows are
packed each; null doc_id is carried; extra columns are ignored; an empty table packs to nothing.
The strings of special tokens inside a text are ordinary text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CAPACITY, END_ID = 1024, 0
#: Outside these ranges the two tokenizer libraries may hold different Unicode versions.
_PLAIN = re.compile("[^\u0000-ɏ‐-‧₠-₿]")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=4)
def encoder(path: str):
    """A function text -> ids of the tokenizer file. Where a rank file of the same vocabulary
    stands beside it, texts in plain Latin script take the faster library of equal results."""
    import os

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    exact = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    ranks = re.sub(r"\.json$", ".tiktoken", path)
    if ranks == path or not os.path.exists(ranks):
        return exact
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
    return lambda text: exact(text) if _PLAIN.search(text) else fast(text)


def cut(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens[, ids])``, a row for each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                out: dict[str, list] = {"doc_id": [], "start": [], "length": [], "ids_crc32": [], "doc_tokens": []}
                kept = []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    ids = np.array([*encode(text or ""), END_ID], dtype="<u4")
                    for start in range(0, len(ids), capacity):
                        piece = ids[start : start + capacity]
                        for name, value in zip(out, (doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(ids))):
                            out[name].append(value)
                        if with_ids:
                            kept.append(piece.astype(np.int32))
                arrays = [pa.array(v, pa.int64()) for v in out.values()]
                names = list(out)
                if with_ids:
                    arrays.append(pa.array(kept, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(common.lean(run), schema)


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size. The leaves of the tournament tree are the bins' free
    capacities in order of opening; a node holds the larger of its children, so the first bin
    that fits is found in one descent."""
    order = np.argsort(-sizes, kind="stable").tolist()
    leaves = 1 << max(1, int(len(sizes) - 1).bit_length())
    tree = [capacity] * (2 * leaves)
    where, offset = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
    for item in order:
        size = int(sizes[item])
        node = 1
        while node < leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        where[item], offset[item] = node - leaves, capacity - tree[node]
        tree[node] -= size
        node //= 2
        while node:
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
            node //= 2
    return where, offset


def place(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = 16384, seed: int = 17) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to ``pieces`` (a stored table: it is read twice)."""
    groups = max(1, -(-pieces.count() // group_pieces))

    def pack(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["doc_id", "start", "ids_crc32"], kind="stable", ignore_index=True)
        bins, offset = first_fit_decreasing(f["length"].to_numpy(), capacity)
        f["sequence_id"] = bins * groups + int(key[0])
        f["offset"] = offset
        return f.drop(columns="grp")

    # rows without an id are dealt by their running number; the table is stored, so it does not change
    turn = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    keyed = pieces.withColumn("grp", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", turn, F.lit(seed)), F.lit(groups)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return keyed.groupBy("grp").applyInPandas(pack, schema)


def sequences(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, pad_id: int = 50256) -> DataFrame:
    """The packed sequences themselves: ``(sequence_id, used, ids)``; padded with ``pad_id`` to
    ``capacity``, except where the used length is a power of two."""
    pieces = common.store(cut(docs, tokenizer or default_tokenizer(), capacity))
    spots = place(pieces.drop("ids"), capacity)
    keys = ["doc_id", "start", "ids_crc32"]
    whole = pieces.dropDuplicates(keys).select(*keys, "ids")
    joined = spots.join(whole, [spots[k].eqNullSafe(whole[k]) for k in keys]).select("sequence_id", "offset", "length", "ids")
    packed = joined.groupBy("sequence_id").agg(
        F.sum("length").alias("used"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda s: s["ids"])).alias("ids"))
    exact = F.expr("used = shiftleft(1, cast(floor(log2(used) + 0.5) as int))")
    padding = F.when(exact, F.array().cast("array<int>")).otherwise(F.array_repeat(F.lit(pad_id), (F.lit(capacity) - F.col("used")).cast("int")))
    return packed.select("sequence_id", "used", F.concat("ids", padding).alias("ids"))


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Piece digests with their places: the piece table of a packed corpus."""
    return place(common.store(cut(docs, tokenizer or default_tokenizer(), capacity, with_ids=False)), capacity)


def op2_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(common.load(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")

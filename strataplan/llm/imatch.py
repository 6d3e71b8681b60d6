"""I-Match document fingerprints over randomised lexicon subsets.

Terms are the distinct lower-cased words of a text (runs of letters and digits). All words are
counted, over all documents; those with a document frequency between ``min_df`` and ``max_share`` of
the documents (a band of inverse document frequency) form the lexicon. A seeded hash deals the lexicon
to subsets: at level j = 0 .. ``LEVELS`` - 1 a term in 2^j goes to one of ``SLOTS`` subsets. A text's
fingerprint is the hash of all its distinct lexicon terms in sorted order, and for every subset that it
has terms of, from its own densest level on, the hash of those in sorted order. Its densest level is the
first at which it has at most ``TERMS`` terms, so a fingerprint has a bounded size, short texts use
all their terms and long ones a sample of them. A text without any term has the hash of the text.

Likeness of two fingerprints: at the denser of the levels that both hold, the share of the subsets
either uses that have equal hashes; equal fingerprints have 1.

Native column logic, and no shuffle of words by text: the words are counted (with map-side
combining), and each text gets from the counts only what it cannot see itself. Words above
``max_share`` number at most (mean distinct words of a text) / max_share and are broadcast as one
array. A word below ``min_df`` is known with its only text. The words that an edit makes at its cuts
are looked up in a pass of their own. All this travels to the texts' ranges of doc_id, where a window
gives each text its next one; no task sees all rows.

Defined results: null text is empty; repeated rows (equal id and text) are returned each, have the
same next document and count each; equal ids with different texts follow each other by text hash; a
null id comes first; the only document is its own next; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

LEVELS, SLOTS, TERMS = 9, 64, 32
MIN_DF, MAX_SHARE = 2, 0.05
RANGE_BYTES, MOST_RANGES = 2 << 20, 1 << 14
WORD_BREAK = r"[^\p{L}\p{N}]+"
#: An entry holds its subset's number above this many bits of a term's hash or of a subset's.
BITS = 53
LONGS = "array<bigint>"


def terms(text: Column) -> Column:
    """Hashes of the distinct words."""
    return F.array_distinct(F.transform(F.filter(F.split(F.lower(text), WORD_BREAK), lambda w: w != ""), lambda w: F.xxhash64(w)))


def _depth(u: Column) -> Column:
    """The sparsest level that a term is in: the zeros at the end of its hash."""
    rest = F.shiftright(u, 3)
    return F.least(F.bit_count(rest.bitwiseAND(-rest) - 1), F.lit(LEVELS - 1))


def densest(held: Column) -> Column:
    """The first level with at most TERMS of the terms: one beyond that of the next deepest term."""
    deep = F.sort_array(F.transform(held, _depth), asc=False)
    return F.least(F.when(F.size(held) <= TERMS, 0).otherwise(F.get(deep, F.lit(TERMS)) + 1), F.lit(LEVELS - 1))


def entry(number: Column, h: Column) -> Column:
    return F.shiftleft(number.cast("long"), BITS).bitwiseOR(F.shiftrightunsigned(h, 64 - BITS))


def number(e: Column) -> Column:
    return F.shiftright(e, BITS).cast("int")


def in_subsets(held: Column, level: Column) -> Column:
    """An entry for each term and subset it is in, from ``level`` on, in order of subset and term."""
    slot = lambda u: F.pmod(F.shiftrightunsigned(u, 20), F.lit(SLOTS)).cast("int")
    deep = F.filter(held, lambda u: _depth(u) >= level)
    each = F.transform(deep, lambda u: F.transform(F.sequence(level, _depth(u)), lambda j: entry(j * SLOTS + slot(u), u)))
    return F.sort_array(F.flatten(each))


def subset_hashes(entries: Column) -> Column:
    """An entry for each subset, with the running hash of its terms' entries."""
    zero = F.lit(0).cast("long")
    start = F.struct(F.lit(-1).alias("s"), zero.alias("h"), F.array().cast(LONGS).alias("out"))
    close = lambda a: F.when(a["s"] < 0, a["out"]).otherwise(F.concat(a["out"], F.array(entry(a["s"], a["h"]))))

    def step(a: Column, e: Column) -> Column:
        same = a["s"] == number(e)
        return F.struct(number(e).alias("s"), F.xxhash64(F.when(same, a["h"]).otherwise(zero), e).alias("h"), F.when(same, a["out"]).otherwise(close(a)).alias("out"))

    return F.aggregate(entries, start, step, close)


def rendered(whole: Column, subsets: Column, text_hash: Column) -> Column:
    """``w`` and the hash of all terms, then three hex digits of subset and eight of hash each; or
    ``t`` and the text's hash."""
    hexed = lambda c, n: F.lpad(F.lower(F.hex(c)), n, F.lit("0"))
    each = F.transform(subsets, lambda e: F.concat(hexed(number(e), 3), hexed(F.shiftright(e, BITS - 32).bitwiseAND(F.lit(0xFFFFFFFF)), 8)))
    return F.when(whole.isNotNull(), F.concat(F.lit("w"), hexed(whole, 16), F.array_join(each, ""))).otherwise(F.concat(F.lit("t"), hexed(text_hash, 16)))


def likeness(a: str, b: str) -> Column:
    """0 to 1, by the level rule, of two fingerprint columns ``struct<whole, level, subsets, shown>``."""
    level = F.greatest(F.col(f"{a}.level"), F.col(f"{b}.level"))
    at = lambda c: F.filter(F.col(f"{c}.subsets"), lambda e: F.floor(number(e) / SLOTS) == level)
    used = F.size(F.array_union(F.transform(at(a), number), F.transform(at(b), number)))
    share = F.when(used > 0, F.size(F.array_intersect(at(a), at(b))) / used).otherwise(0.0)
    return F.when(F.col(f"{a}.shown") == F.col(f"{b}.shown"), F.lit(1.0)).otherwise(share)


def with_fingerprint(df: DataFrame, name: str, held: Column, text_hash: Column) -> DataFrame:
    """``df`` with a struct column ``name`` that holds the fingerprint of a text's lexicon terms."""
    part = lambda x: f"_{name}_{x}"
    df = common.evaluated(df, **{part("held"): held})
    df = common.evaluated(df, **{part("level"): densest(F.col(part("held")))})
    df = common.evaluated(df, **{part("subsets"): subset_hashes(in_subsets(F.col(part("held")), F.col(part("level"))))})
    df = df.withColumn(part("whole"), F.when(F.size(part("held")) > 0, F.xxhash64(F.sort_array(part("held")))))
    shown = rendered(F.col(part("whole")), F.col(part("subsets")), text_hash)
    return df.withColumn(name, F.struct(F.col(part("level")).alias("level"), F.col(part("subsets")).alias("subsets"), shown.alias("shown"))).drop(part("level"), part("subsets"), part("whole"))


def range_of(docs: DataFrame, size: int):
    """An expression: the number of the range of ``doc_id`` that a row is in, of about RANGE_BYTES."""
    ranges = max(1, min(MOST_RANGES, -(-size // RANGE_BYTES)))
    edges = docs.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)] or [0.5], 100_000).alias("e")).first()["e"]
    bounds = sorted(set(edges or [])) if ranges > 1 else []
    if not bounds:
        return F.lit(0)
    # binary search: the count of bounds that are not above the id
    table = F.from_json(F.lit(str(bounds)), "array<bigint>")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
    found = F.aggregate(steps, F.lit(0), lambda a, k: F.when((a + k <= len(bounds)) & (F.get(table, a + k - 1) <= F.col("doc_id")), a + k).otherwise(a))
    return F.when(F.col("doc_id").isNull(), 0).otherwise(found)


def in_sequence(rows: DataFrame, at, heads: DataFrame, prepare, carry: list[str]) -> DataFrame:
    """``(doc_id, h, text, side, times, n)``, and what ``prepare`` adds, for the distinct documents of
    ``rows(doc_id, h, text, side)``: how often each occurs, and in ``n`` the columns ``carry`` of the
    next one.

    ``side`` is a struct of what is known about a document beside its text; it comes on rows of its
    own, without text, that travel with the texts. ``heads`` (a row a range) names for each range the
    document that follows its last one; that is sent to the range as well, so every lead is found in
    one task's rows and no text is fetched twice."""
    placed = rows.withColumn("range", at).withColumn("extra", F.lit(False))
    ahead = placed.drop("range", "extra").join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("h") == F.col("_h"))).drop("_i", "_h").withColumn("extra", F.lit(True))
    line = placed.unionByName(ahead)
    place = [F.col("extra"), F.col("doc_id").asc_nulls_first(), F.col("h"), F.col("text").isNotNull()]
    whole = Window.partitionBy("range", "extra", "doc_id", "h").orderBy(F.col("text").isNotNull())
    every = whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    line = line.repartition(F.col("range")).sortWithinPartitions("range", *place)
    own = line.withColumn("side", F.first("side", ignorenulls=True).over(every)).withColumn("times", F.count("text").over(every)).withColumn("later", F.lead(F.lit(1)).over(whole))
    own = prepare(own.where("text IS NOT NULL AND later IS NULL").drop("later"))
    led = own.withColumn("n", F.lead(F.struct(*carry)).over(Window.partitionBy("range").orderBy(*place[:3])))
    return led.where("NOT extra").drop("extra", "range")


def heads_of(rows: DataFrame, at) -> DataFrame:
    """``(range, _i, _h)``: the document that follows the last one of each range; the first follows
    the very last. At most MOST_RANGES rows."""
    first = rows.withColumn("range", at).groupBy("range").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "h")).alias("f"))
    over = Window.orderBy("range")
    key = F.struct("f.doc_id", "f.h")
    every = over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return first.select("range", F.coalesce(F.lead(key).over(over), F.first(key).over(every)).alias("n")).select("range", F.col("n.doc_id").alias("_i"), F.col("n.h").alias("_h"))


def edited(text: Column, next_text: Column) -> Column:
    """The last floor(n/2) code points replaced by the first as many of the next text."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(next_text, F.lit(1), half))


def fingerprint(docs: DataFrame, min_df: int = MIN_DF, max_share: float = MAX_SHARE) -> DataFrame:
    """A row per row of ``docs``: doc_id, h (text hash), n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next. ``min_df`` is 1 or 2."""
    if min_df not in (1, 2):
        raise ValueError("the rows of a word that is too rare are known up to one document: min_df is 1 or 2")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    size, n = whole.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    at = range_of(whole, size)
    heads = common.store(heads_of(whole, at))
    counted = common.store(whole.select("doc_id", "h", F.explode(terms(F.col("text"))).alias("u")).groupBy("u").agg(F.count("*").alias("df"), F.min("doc_id").alias("doc_id"), F.min("h").alias("h")))
    most = max(float(min_df), max_share * n)
    # words above max_share number at most (mean distinct words of a text) / max_share
    common_words = common.store(counted.where(F.col("df") > most).agg(F.collect_list("u").alias("hot")))
    rare = counted.where(F.col("df") < min_df).groupBy("doc_id", "h").agg(F.collect_list("u").alias("rare"))

    def with_side(side: DataFrame) -> DataFrame:
        """The texts, and the side rows, which have none."""
        blank = F.lit(None).cast(side.schema["side"].dataType)
        return whole.withColumn("side", blank).unionByName(side.select("doc_id", "h", F.lit(None).cast("string").alias("text"), "side"))

    # words that only the edited text has: those that were made where it was cut
    nothing = whole.where("1 = 0").select("doc_id", "h", F.struct(F.lit(0).alias("none")).alias("side"))
    cut = in_sequence(with_side(nothing), at, heads, lambda own: common.evaluated(own, a=terms(F.col("text"))), ["text", "a"])
    cut = common.evaluated(cut.select("doc_id", "h", edited(F.col("text"), F.col("n.text")).alias("edited"), F.array_union("a", "n.a").alias("own")), e=terms(F.col("edited")))
    made = common.store(cut.select("doc_id", "h", F.explode(F.array_except("e", "own")).alias("u")))
    band = counted.where(F.col("df").between(min_df, most)).select("u")
    made = made.join(band, "u").groupBy("doc_id", "h").agg(F.collect_list("u").alias("made"))
    none = F.array().cast(LONGS)
    side = rare.select("doc_id", "h", "rare", none.alias("made")).unionByName(made.select("doc_id", "h", none.alias("rare"), "made"))
    side = side.groupBy("doc_id", "h").agg(F.flatten(F.collect_list("rare")).alias("rare"), F.flatten(F.collect_list("made")).alias("made"))
    side = common.store(side.select("doc_id", "h", F.struct("rare", "made").alias("side")))

    def own_fingerprint(own: DataFrame) -> DataFrame:
        own = common.evaluated(own.crossJoin(F.broadcast(common_words)), u=terms(F.col("text")))
        return with_fingerprint(own, "fa", F.array_except(F.array_except("u", "hot"), F.coalesce("side.rare", none)), F.col("h")).drop("u", "hot")

    led = in_sequence(with_side(side), at, heads, own_fingerprint, ["text", "_fa_held", "fa"])
    rows = led.select(
        "doc_id", "h", "times", F.length("text").cast("long").alias("n_chars"), edited(F.col("text"), F.col("n.text")).alias("edited"), "fa", F.col("n.fa").alias("fx"),
        F.concat("_fa_held", "n._fa_held", F.coalesce("side.made", none)).alias("known"))
    rows = common.evaluated(rows, e=F.col("edited")).drop("edited")
    rows = with_fingerprint(rows, "fe", F.array_intersect(terms(F.col("e")), F.col("known")), F.xxhash64("e"))
    out = rows.select(
        "times", "doc_id", "h", "n_chars", F.sha2("e", 256).alias("edited_sha256"), F.col("fa.shown").alias("fingerprint"), F.col("fe.shown").alias("edited_fingerprint"),
        likeness("fa", "fe").alias("near_edited"), likeness("fa", "fx").alias("near_next"))
    return out.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).drop("_row", "times")


def op4_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprint(common.load(spark, sf_dir, "documents")).drop("h")

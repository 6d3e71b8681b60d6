"""Personal data: base patterns, and information-theoretic sanitisation of revealing terms.

Base spans (e-mail, ip, card, phone) are leftmost non-overlapping matches per kind; a match that
fails its test is dropped without a retry. Starts come from the lengths of the pieces between
matches, in code points. The method adds two kinds of spans outside the base ones:

``secret``: runs of 20 or more letters, digits, ``_`` and ``-`` with letters and at least four digits
whose characters have an entropy of two bits or more each and of ``SECRET_BITS`` or more together.

``term``: words that reveal a protected entity. Entities are the spans above, at three levels: the
value, its group (mail domain, the first three parts of an address, first six digits of a card, first
four of a phone number, length of a secret) and its kind. A text, with its spans replaced by entity
tokens, is a sequence of tokens (lower-cased runs of letters, marks and digits, of any length), taken
in units of ``UNIT`` tokens, so that a text with many entities costs no more than its length. With
n(e, t) units that hold entity e and term t, df(t) units that hold t, and N units, t reveals e when

- P(e | t) = n / df is at least ``min_share``,
- the pointwise information log2(P(e | t) / P(e)) is at least ``min_bits``,
- the pair has at least ``min_contexts`` effective contexts: the inverse Simpson index of the words
  on both sides of t (its first in order of hash in a unit), so that copies and near copies of a
  passage, however many, count about one, and
- effective contexts times information exceeds log2(pairs looked at) + 10 bits, so that among all
  pairs a chance finding has a probability of about a thousandth.

Revealing terms are generalised wherever they occur.

Everything is native column logic; tokens are counted by 64-bit hashes. Terms in more than
``HOT_SHARE`` of the units number at most UNIT / HOT_SHARE whatever the corpus is; they are broadcast
and leave before the shuffle by term unless an entity of their unit is frequent enough to be revealed
by them. The last word pass keeps only words in the hash buckets of revealing terms (a broadcast of
at most ``BUCKETS`` rows) and then joins exactly.

Defined results: null text counts as empty; repeated rows are returned each and count as copies; a
null doc_id is carried; ties in start go by kind order; a code point U+E000 in a text counts as a
space; other columns of the input are carried, whatever their names; an empty table gives an empty
result. A term whose lower-case form is not found by case-insensitive search in its own text (a few
letters of special casing) is not located.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ["email", "ip", "card", "phone"]
ALL_KINDS = [*KINDS, "secret", "term"]
#: The contract's patterns with possessive repeats (what follows a repeat never overlaps it, so
#: the matches are the same) and starts bound to a run's begin, so that long runs cost linear time.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){11,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+",
}
HINTS = {"email": "[@]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][ -]?[0-9][ -]?[0-9]", "phone": r"\+[0-9]", "secret": "(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20}"}
SECRET_BITS = 64
MARK = "\ue000"
TOKEN = MARK + r"[a-z0-9]+|[\p{L}\p{M}\p{N}]+"
UNIT = 512
HOT_SHARE = 0.005
BUCKETS = 1 << 16
SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Luhn test of a digit string."""
    each = F.transform(
        F.split(F.reverse(digits), ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") * 2 / 10).cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _passes(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.split(value, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.substring(part(p), 1, 3).cast("int") <= 255))
    n = F.length(_digits(value))
    if kind == "secret":
        return (n >= 4) & value.rlike("[A-Za-z]") & (_information(value) >= F.greatest(F.lit(SECRET_BITS), 2 * F.length(value)))
    if kind == "phone":
        return n.between(9, 15)
    return n.between(12, 19) & _luhn(F.substring(_digits(value), 1, 19))


def _information(value: Column) -> Column:
    """Length times the entropy of the characters, in bits."""
    n = F.length(value)
    times = F.transform(F.filter(F.array_distinct(F.split(value, "")), lambda c: c != ""), lambda c: n - F.length(F.replace(value, c, F.lit(""))))
    return F.aggregate(times, F.lit(0.0), lambda a, k: a + k * F.log2(n / k))


def _test(kind: str):
    return lambda s: _passes(kind, s["value"])


def located(text: Column, pattern: Column, kind: int) -> Column:
    """All matches of a pattern as spans ``(start, kind, end, value)``."""
    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    # aligned: gap i stands before match i; the last gap has none
    pairs = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("gap"), found.alias("value"))
    empty = F.struct(F.lit(0).alias("pos"), F.array().cast(SPAN).alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        start = acc["pos"] + F.length(p["gap"])
        end = start + F.length(p["value"])
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), p["value"].alias("value"))
        return F.struct(end.alias("pos"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    return F.aggregate(pairs, empty, step, lambda acc: acc["spans"])


def base_spans(text: Column) -> Column:
    """Base spans of a text by start, then kind."""
    none = F.array().cast(SPAN)
    parts = [
        F.when(text.rlike(HINTS[k]), F.filter(located(text, F.lit(PATTERNS[k]), i), _test(k))).otherwise(none)
        for i, k in enumerate(KINDS)
    ]
    return F.array_sort(F.concat(*parts))


def added_secrets(text: Column, base: Column) -> Column:
    """Secret spans outside the base spans."""
    found = F.filter(located(text, F.lit(PATTERNS["secret"]), len(KINDS)), _test("secret"))
    return F.when(text.rlike(HINTS["secret"]), outside(found, base)).otherwise(F.array().cast(SPAN))


def outside(spans: Column, taken: Column) -> Column:
    return F.filter(spans, lambda x: ~F.exists(taken, lambda b: (x["start"] < b["end"]) & (b["start"] < x["end"])))


def rendered(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    names = F.array(*[F.lit(k) for k in ALL_KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def replaced(text: Column, spans: Column, by) -> Column:
    """The text with each span replaced by ``by(span)``; one that overlaps an earlier one adds nothing."""

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["pos"]
        out = F.when(fresh, F.concat(acc["out"], F.substring(text, acc["pos"] + 1, s["start"] - acc["pos"]), by(s))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), out.alias("out"))

    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))
    return F.aggregate(spans, start, step, lambda a: F.concat(a["out"], F.substring(text, a["pos"] + 1, F.length(text))))


def entity_tokens(span: Column) -> Column:
    """The three tokens of a span: its value, its group, its kind."""
    kind, value = span["kind"], F.lower(span["value"])
    digits = _digits(value)
    group = F.when(kind == 0, F.regexp_extract(value, "@(.*)$", 1)).when(kind == 1, F.regexp_extract(value, r"^(.*)\.", 1)).when(kind == 2, F.substring(digits, 1, 6)).when(kind == 3, F.substring(digits, 1, 4)).otherwise(F.length(value).cast("string"))
    return F.concat(*[x for name, of in (("v", F.lower(F.hex(F.xxhash64(value)))), ("g", F.lower(F.hex(F.xxhash64(group)))), ("k", F.lit(""))) for x in (F.lit(f" {MARK}{name}"), kind.cast("string"), of)], F.lit(" "))


def _units(spotted: DataFrame) -> DataFrame:
    """``(_k, at, tokens)``: the units of ``spotted(_k, text, spans)``, entity tokens in place of spans."""
    plain = F.when(F.contains("text", F.lit(MARK)), F.translate("text", MARK, " ")).otherwise(F.col("text"))
    masked = F.when(F.size("spans") > 0, replaced(plain, F.col("spans"), entity_tokens)).otherwise(plain)
    each = common.evaluated(spotted.select("_k", F.lower(masked).alias("masked")), tokens=F.regexp_extract_all("masked", F.lit(TOKEN), F.lit(0)))
    starts = F.sequence(F.lit(0), F.greatest(F.size("tokens") - 1, F.lit(0)), F.lit(UNIT))
    return each.select("_k", F.posexplode(F.transform(starts, lambda i: F.slice("tokens", i + 1, F.lit(UNIT)))).alias("at", "tokens"))


def _coded(token: Column) -> Column:
    """A token's hash; odd for entities, even for terms."""
    h = F.xxhash64(token)
    return F.when(F.startswith(token, F.lit(MARK)), h.bitwiseOR(F.lit(1))).otherwise(h.bitwiseAND(F.lit(-2)))


def _is_entity(code: Column) -> Column:
    return code.bitwiseAND(F.lit(1)) == 1


def telling_terms(spotted: DataFrame, min_contexts: float, min_share: float, min_bits: float) -> DataFrame:
    """``t``: the codes of revealing terms; ``spotted(_k, text, spans)`` is read twice."""
    # code 0, in every unit, counts the units
    codes = F.concat(F.array(F.lit(0).cast("long")), F.array_distinct(F.transform("tokens", _coded)))
    counted = _units(spotted).select(F.explode(codes).alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    counted = common.store(counted.where((F.col("df") >= min_contexts) | (F.col("t") == 0)))
    all_units = counted.where("t = 0").agg(F.max("df")).first()[0]
    units = _units(spotted.where(F.size("spans") > 0))
    n_units = float(all_units or 1)
    counted = counted.where("t <> 0")
    entities = counted.where(_is_entity(F.col("t"))).select(F.col("t").alias("e"), F.col("df").alias("ne"))
    # units with entities: their entities, and their terms with one context each
    coded = lambda x, i: F.struct(_coded(x).alias("t"), F.xxhash64(F.get("tokens", i - 1), F.get("tokens", i + 1)).alias("c"))
    mention = units.where(F.exists("tokens", lambda x: F.startswith(x, F.lit(MARK)))).select(F.xxhash64("_k", "at").alias("u"), F.transform("tokens", coded).alias("coded"))
    mention = common.evaluated(mention, all=F.array_sort("coded"))
    mention = common.store(mention.select(
        "u", F.array_distinct(F.transform(F.filter("all", lambda x: _is_entity(x["t"])), lambda x: x["t"])).alias("ents"),
        F.filter("all", lambda x, i: ~_is_entity(x["t"]) & ((i == 0) | (F.get("all", i - 1)["t"] != x["t"]))).alias("terms"))
        # a repeated row's units are one here, with a count: df counts every copy, and so does n
        .groupBy("u", "ents", "terms").agg(F.count("*").alias("copies")))
    recurring = mention.select("u", F.explode("ents").alias("e")).join(common.by_key(entities), "e").groupBy("u").agg(F.collect_list(F.struct("e", "ne")).alias("known"), F.max("ne").alias("top"))
    hot = counted.where((F.col("df") > HOT_SHARE * n_units) & ~_is_entity(F.col("t"))).select("t", F.col("df").alias("hot"))  # at most UNIT / HOT_SHARE rows
    held = mention.join(common.by_key(recurring), "u").select("known", "top", "copies", F.explode("terms").alias("x")).select("known", "top", "copies", "x.t", "x.c")
    held = held.join(F.broadcast(hot), "t", "left").where("hot IS NULL OR top >= {0} * hot".format(float(min_share))).drop("hot")
    both = held.join(common.by_key(counted), "t").where(F.col("top") >= min_share * F.col("df")).select("t", "c", "df", "copies", F.explode("known").alias("k")).select("t", "c", "df", "copies", "k.e", "k.ne").where(F.col("ne") >= min_share * F.col("df"))
    by_context = both.groupBy("e", "t", "c").agg(F.sum("copies").alias("n"), F.first("df").alias("df"), F.first("ne").alias("ne"))
    pairs = common.store(by_context.groupBy("e", "t").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.first("df").alias("df"), F.first("ne").alias("ne")))
    looked = pairs.count()
    share, contexts = F.col("n") / F.col("df"), F.col("n") * F.col("n") / F.col("nn")
    bits = F.log2(share * n_units / F.col("ne"))
    evidence = F.log2(F.lit(float(max(looked, 1)))) + 10
    return pairs.where((share >= min_share) & (bits >= min_bits) & (contexts >= min_contexts) & (contexts * bits >= evidence)).select("t").distinct()


def revealing_terms(spotted: DataFrame, **limits: float) -> DataFrame:
    """``(_k, terms)``: the revealing terms in each document of ``spotted(_k, text, spans)``."""
    telling = common.store(telling_terms(spotted, **limits))
    bucket = lambda c: F.pmod(F.shiftright(c, 1), F.lit(BUCKETS))
    wanted = telling.select(bucket(F.col("t")).alias("b")).distinct()  # at most BUCKETS rows
    words = spotted.select("_k", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TOKEN), F.lit(0)))).alias("w")).withColumn("t", _coded(F.col("w")))
    held = words.join(F.broadcast(wanted), bucket(F.col("t")) == F.col("b"), "left_semi").join(telling, "t")
    return held.groupBy("_k").agg(F.array_sort(F.collect_set("w")).alias("terms"))


def spans(docs: DataFrame, min_contexts: float = 3, min_share: float = 0.5, min_bits: float = 3.0) -> DataFrame:
    """``docs(doc_id, text, ..)`` plus ``_base`` and ``_spans`` (all spans by start, then kind)."""
    body, restore = common.shield(docs, ["doc_id", "text"])
    whole = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = body.withColumn("_k", F.xxhash64("doc_id", whole))
    found = lambda df, text: common.evaluated(common.evaluated(df, _base=base_spans(text)), _found=F.array_sort(F.concat("_base", added_secrets(text, F.col("_base")))))
    spotted = found(keyed.select("_k", whole.alias("text")), F.col("text")).select("_k", "text", F.col("_found").alias("spans"))
    terms = common.store(revealing_terms(spotted, min_contexts=min_contexts, min_share=min_share, min_bits=min_bits))
    joined = found(keyed.join(terms.withColumnRenamed("terms", "_terms"), "_k", "left"), whole)
    # terms are letters, marks and digits, so they stand in a pattern as they are
    word = r"[\p{L}\p{M}\p{N}]"
    pattern = F.concat(F.lit(rf"(?iu)(?<!{word})(?:"), F.array_join("_terms", "|"), F.lit(rf")(?!{word})"))
    extra = F.when(F.col("_terms").isNull(), F.array().cast(SPAN)).otherwise(outside(located(whole, pattern, len(KINDS) + 1), F.col("_found")))
    out = joined.withColumn("_spans", F.array_sort(F.concat("_found", extra)))
    return restore(out, ["_base", "_spans"])


def sanitise(docs: DataFrame, **limits) -> DataFrame:
    """The documents with spans generalised to their kind, columns as given. ``n_chars``, if
    present, follows the new text; null text stays null."""
    body, restore = common.shield(docs, ["doc_id", "text", "n_chars"])
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in ALL_KINDS])
    clean = replaced(F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("_spans"), lambda s: F.element_at(names, s["kind"] + 1))
    done = spans(body, **limits).withColumn("text", F.when(F.col("text").isNull() | (F.size("_spans") == 0), F.col("text")).otherwise(clean))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))
    return restore(done)


def op8_pii(spark, sf_dir: str) -> DataFrame:
    found = spans(common.load(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda i: F.size(F.filter("_base", lambda s: s["kind"] == i)).cast("long")
    return found.select(
        "doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(rendered(F.col("_base")), 256).alias("base_sha256"), rendered(F.col("_spans")).alias("spans"), F.size("_spans").cast("long").alias("n_spans"))

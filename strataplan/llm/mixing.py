"""Mixing sources to target weights by hierarchical budgeting.

A token budget goes down the tree domain > language > source. At each node the children share
the node's budget by weight, none above its capacity (tokens below it times ``max_epochs``);
what a full child leaves goes to its siblings (water filling), and only a node whose children
are all full hands the rest back, since its own capacity bounded what it was given. All shares
are integers; a split may leave fewer tokens than it has children unspent.

A leaf whose budget is b of t tokens gets b div t whole epochs and, of the next epoch, the
prefix in seeded order (md5 of seed, epoch and id) whose tokens add up to at most b mod t.
The prefix ends at a cut-off key found digit by digit: token sums by leaf and the next
``DIGITS`` hex digits of the key tell in which block the budget ends, that block is looked into
with more digits, until it holds ``SMALL`` keys at most. No window is longer than 16^DIGITS or
SMALL rows, however large the leaf, and documents are only filtered against their leaf's cut-off.

Defined results: null or empty text has no tokens; it is in every whole epoch (a leaf without
tokens is taken once) and in a prefix
by its key's place; null language or source is the name ``unknown``; rows of equal id stand or
fall together; null ids share one key; an empty table gives an empty result; columns of the
input keep their names, but one named like a new column (``_domain, _lang, _source, _tokens,
_epoch``) gives way to it in :func:`mix`; :func:`mixed_documents` carries them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

SEED, DIGITS, SMALL = 20, 2, 1000
DOMAIN_WEIGHTS = {"d0": 4, "d1": 3, "d2": 2, "d3": 1}
LANGUAGE_WEIGHTS = {"en": 4, "de": 2, "fr": 2, "es": 2}
LEVELS = ["_domain", "_lang", "_source"]


def domain_of(source: Column) -> Column:
    """The default domain of a source: by its trailing number."""
    number = F.coalesce(F.right(F.regexp_extract(source, "([0-9]+)$", 1), F.lit(9)).try_cast("int"), F.lit(0))
    return F.concat(F.lit("d"), (number % 4).cast("string"))


def _weight(column: Column, table: dict[str, int]) -> Column:
    out = F.lit(1)
    for name, weight in table.items():
        out = F.when(column == name, weight).otherwise(out)
    return out


def placed(docs: DataFrame) -> DataFrame:
    """The documents with their leaf, their tokens (bytes by four, rounded up)."""
    return (
        docs.withColumn("_lang", F.coalesce("lang", F.lit("unknown"))).withColumn("_source", F.coalesce("source", F.lit("unknown")))
        .withColumn("_domain", domain_of(F.col("_source")))
        .withColumn("_tokens", F.floor((F.octet_length(F.coalesce("text", F.lit(""))) + 3) / 4).cast("long"))
    )


def share_out(nodes: DataFrame, parent: list[str], order: list[str]) -> DataFrame:
    """Give each row of ``nodes(.., weight, cap, given)`` its ``budget``: ``given`` is split
    within ``parent`` by weight up to ``cap``. Rows in order of cap / weight fill up first."""
    big = lambda c: c.cast("decimal(38,0)")
    w = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("weight"), *order)
    before, rest = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(0, Window.unboundedFollowing)
    split = (
        nodes.withColumn("left", F.col("given") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("rest", F.sum("weight").over(rest))
        .withColumn("full", big(F.col("cap")) * F.col("rest") <= big(F.col("weight")) * F.col("left"))
    )
    # the first row that does not fill up fixes what is left and the weights that share it
    every = Window.partitionBy(*parent)
    first_open = F.min(F.when(~F.col("full"), F.struct(*[F.col(c) for c in ("_rank", "left", "rest")]))).over(every)
    ranked = split.withColumn("_rank", F.row_number().over(w)).withColumn("open", first_open)
    exact = F.expr("cast((cast(weight as decimal(19,0)) * cast(open.left as decimal(19,0))) div open.rest as long)")
    return ranked.withColumn("budget", F.when(F.col("open").isNull() | (F.col("_rank") < F.col("open._rank")), F.col("cap")).otherwise(exact)).drop("left", "rest", "full", "_rank", "open")


def budgets(leaves: DataFrame, total: Column, max_epochs: int) -> DataFrame:
    """``leaves(_domain, _lang, _source, tokens)`` with each leaf's ``budget`` of ``total``."""
    leaf = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    langs = leaf.groupBy("_domain", "_lang").agg(F.sum("cap").alias("cap"))
    domains = langs.groupBy("_domain").agg(F.sum("cap").alias("cap"))
    all_tokens = leaf.agg(F.sum("tokens").alias("all_tokens"))
    top = domains.crossJoin(F.broadcast(all_tokens)).withColumn("given", total).withColumn("weight", _weight(F.col("_domain"), DOMAIN_WEIGHTS)).withColumn("_root", F.lit(0))
    top = share_out(top, ["_root"], ["_domain"]).select("_domain", F.col("budget").alias("given"))
    mid = langs.join(top, "_domain").withColumn("weight", _weight(F.col("_lang"), LANGUAGE_WEIGHTS))
    mid = share_out(mid, ["_domain"], ["_lang"]).select("_domain", "_lang", F.col("budget").alias("given"))
    low = leaf.join(mid, ["_domain", "_lang"]).withColumn("weight", F.lit(1))
    return share_out(low, ["_domain", "_lang"], ["_source"]).select(*LEVELS, "tokens", "budget")


def _key(epoch: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(SEED)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))


def mix(docs: DataFrame, numerator: int = 3, denominator: int = 5, max_epochs: int = 2) -> DataFrame:
    """The selected rows with ``_domain, _lang, _source, _tokens, _epoch``, a row for each epoch
    a document is in. The budget is numerator / denominator of all tokens."""
    at = placed(docs)
    leaves = at.groupBy(*LEVELS).agg(F.sum("_tokens").alias("tokens"))
    total = F.expr(f"all_tokens * {int(numerator)} div {int(denominator)}")
    # one row a leaf; a leaf without tokens is taken whole, once
    plan = common.store(
        budgets(leaves, total, max_epochs)
        .withColumn("whole", F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(1)))
        .withColumn("part", F.col("budget") - F.col("whole") * F.col("tokens")))
    lined = at.select("doc_id", *LEVELS, "_tokens").join(plan.select(*LEVELS, "whole", "part"), LEVELS)
    lined = common.store(lined.groupBy(*LEVELS, "part", _key(F.col("whole")).alias("key")).agg(F.sum("_tokens").alias("n")))
    ends, digits, most = plan.select(*LEVELS, F.lit("").alias("block"), F.lit(0).cast("long").alias("base")), 0, SMALL + 1
    while most > SMALL and digits < 32:
        digits += DIGITS
        held = lined.join(ends, LEVELS).where(F.startswith("key", "block")).select(*LEVELS, "part", "base", "n", F.substring("key", 1, digits).alias("block"))
        sums = held.groupBy(*LEVELS, "part", "base", "block").agg(F.sum("n").alias("n"), F.count("*").alias("keys"))
        running = Window.partitionBy(*LEVELS).orderBy("block")
        over = sums.withColumn("upto", F.col("base") + F.sum("n").over(running)).where("upto > part").groupBy(*LEVELS).agg(
            F.min(F.struct("block", (F.col("upto") - F.col("n")).alias("base"), "keys")).alias("at"))
        ends = common.store(over.select(*LEVELS, F.col("at.block").alias("block"), F.col("at.base").alias("base"), F.col("at.keys").alias("keys")))
        most = ends.agg(F.max("keys")).first()[0] or 0
        ends = ends.drop("keys")
    edge = lined.join(ends, LEVELS).where(F.startswith("key", "block"))
    within = Window.partitionBy(*LEVELS).orderBy("key")
    over = edge.withColumn("upto", F.col("base") + F.sum("n").over(within)).where("upto > part").groupBy(*LEVELS).agg(F.min("key").alias("stop"))
    cuts = common.store(plan.join(over, LEVELS, "left").select(*LEVELS, "whole", "stop"))
    # prefix: keys before the first that goes over the budget
    chosen = at.join(cuts, LEVELS).withColumn("_in_part", (_key(F.col("whole")) < F.col("stop")) & F.col("stop").isNotNull())
    count = F.col("whole") + F.col("_in_part").cast("long")
    return chosen.withColumn("_n", count).where("_n > 0").withColumn("_epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))).drop("whole", "stop", "_in_part", "_n")


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    picked = mix(common.load(spark, sf_dir, "documents"))
    return picked.select("doc_id", F.col("_domain").alias("domain"), F.col("_lang").alias("lang"), F.col("_source").alias("source"), F.col("_tokens").alias("n_tokens"), F.col("_epoch").alias("epoch"))


def mixed_documents(docs: DataFrame, numerator: int = 4, denominator: int = 5) -> DataFrame:
    """The documents kept by one epoch at most; columns as given."""
    body, restore = common.shield(docs, ["doc_id", "text", "lang", "source"])
    return restore(mix(body, numerator, denominator, 1))


def _case(column: str, table: dict[str, int]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + " ELSE 1 END"


def _share_sql(name: str, source: str, parent: str, order: str) -> str:
    part = f"PARTITION BY {parent}" if parent else ""
    return f"""{name}_a AS (SELECT *, given - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
  sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rst, row_number() OVER w AS rk
  FROM {source} WINDOW w AS ({part} ORDER BY cap / weight, {order})),
{name}_b AS (SELECT *, CAST(cap AS HUGEINT) * rst <= CAST(weight AS HUGEINT) * lft AS is_full FROM {name}_a),
{name}_c AS (SELECT *, min(CASE WHEN NOT is_full THEN rk END) OVER ({part}) AS open_rk FROM {name}_b),
{name}_d AS (SELECT *, max(CASE WHEN rk = open_rk THEN lft END) OVER ({part}) AS open_lft, max(CASE WHEN rk = open_rk THEN rst END) OVER ({part}) AS open_rst FROM {name}_c),
{name} AS (SELECT *, CASE WHEN open_rk IS NULL OR rk < open_rk THEN cap ELSE (CAST(weight AS HUGEINT) * open_lft) // open_rst END AS budget FROM {name}_d)"""


def mix_sql(docs: str, numerator: int, denominator: int, max_epochs: int) -> str:
    """CTEs of DuckDB SQL ending in ``mixed``: columns of ``docs`` with those that mix() adds."""
    key = f"md5('{SEED}:' || p.whole || ':' || coalesce(CAST(d.doc_id AS VARCHAR), 'null'))"
    return f"""at0 AS (SELECT *, coalesce(lang, 'unknown') AS _lang, coalesce(source, 'unknown') AS _source,
  (octet_length(encode(coalesce(text, ''))) + 3) // 4 AS _tokens FROM {docs}),
at1 AS (SELECT *, 'd' || (coalesce(try_cast(right(regexp_extract(_source, '([0-9]+)$', 1), 9) AS INT), 0) % 4) AS _domain FROM at0),
leaf AS (SELECT _domain, _lang, _source, CAST(sum(_tokens) AS BIGINT) AS tokens, CAST(sum(_tokens) * {max_epochs} AS BIGINT) AS cap, 1 AS weight FROM at1 GROUP BY ALL),
lng AS (SELECT _domain, _lang, CAST(sum(cap) AS BIGINT) AS cap, {_case('_lang', LANGUAGE_WEIGHTS)} AS weight FROM leaf GROUP BY _domain, _lang),
dom AS (SELECT _domain, CAST(sum(cap) AS BIGINT) AS cap, {_case('_domain', DOMAIN_WEIGHTS)} AS weight, (SELECT CAST(sum(tokens) AS BIGINT) * {numerator} // {denominator} FROM leaf) AS given FROM lng GROUP BY _domain),
{_share_sql('top', 'dom', '', '_domain')},
lng1 AS (SELECT l.*, t.budget AS given FROM lng l JOIN top t USING (_domain)),
{_share_sql('mid', 'lng1', '_domain', '_lang')},
leaf1 AS (SELECT l.*, m.budget AS given FROM leaf l JOIN mid m USING (_domain, _lang)),
{_share_sql('low', 'leaf1', '_domain, _lang', '_source')},
plan AS (SELECT _domain, _lang, _source, CASE WHEN tokens > 0 THEN CAST(budget // tokens AS BIGINT) ELSE 1 END AS whole, budget, tokens FROM low),
lined AS (SELECT d.*, p.whole, CAST(p.budget - p.whole * p.tokens AS BIGINT) AS part, {key} AS key FROM at1 d JOIN plan p USING (_domain, _lang, _source)),
summed AS (SELECT *, sum(_tokens) OVER (PARTITION BY _domain, _lang, _source ORDER BY key) AS upto FROM lined),
stops AS (SELECT _domain, _lang, _source, min(key) AS stop FROM summed WHERE upto > part GROUP BY ALL),
counted AS (SELECT s.*, s.whole + CASE WHEN t.stop IS NOT NULL AND s.key < t.stop THEN 1 ELSE 0 END AS n FROM summed s LEFT JOIN stops t USING (_domain, _lang, _source)),
mixed AS (SELECT *, unnest(range(n)) AS _epoch FROM counted WHERE n > 0)"""


OP9_SQL = f"""WITH {mix_sql('documents', 3, 5, 2)}
SELECT doc_id, _domain AS domain, _lang AS lang, _source AS source, _tokens AS n_tokens, _epoch AS epoch FROM mixed"""

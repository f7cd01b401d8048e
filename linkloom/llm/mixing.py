"""Mixing sources to target weights: a hierarchical token budget, then seeded token-prefixes.

The tree's levels are columns (domain, language, source). A node can take as many tokens as its
leaves hold times the epochs allowed. From the root down, a node's tokens are shared among its
children by weight; a child that can't take its share is filled up and the rest goes to its
siblings by weight, and so on (water-filling, solved in closed form over children in order of
capacity per weight). As capacities are those of whole subtrees, a shortage is met by siblings
first and reaches an ancestor's other children only if the whole subtree is full.

A leaf with quota q and t tokens gives q div t whole epochs, and of one more epoch the prefix of
q mod t tokens in that epoch's seeded order. The order is by MD5 of (seed, epoch, id), whose first
digits are buckets: sums per leaf and bucket place every bucket, and only the bucket where the
prefix ends is sorted. So a leaf that holds a third of all rows is no window of one task. Leaf tables are
broadcast only up to ``broadcast_leaves`` rows; beyond that the join is a shuffle with salted leaves.

All of it is DataFrame work on integers; results are the same in any order of rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, cut

#: Hexadecimal digits of the order key that make a bucket.
BUCKET_DIGITS = 3
#: Ways a leaf is split where leaves are too many to broadcast.
SALT = 64


@dataclass(frozen=True)
class Mix:
    """``levels``: columns from the root down. ``weights``: by path tuple, 1 where none is given; 0 takes nothing.

    The budget is ``budget_percent`` of all tokens in the table; a leaf is repeated up to ``max_epochs`` times.
    """

    levels: tuple[str, ...] = ("domain", "lang", "source")
    weights: dict[tuple[str, ...], int] = field(default_factory=dict)
    budget_percent: int = 110
    max_epochs: int = 4
    seed: int = 20
    broadcast_leaves: int = 50_000


def n_words(text: Column) -> Column:
    """Tokens as the budget counts them: words; null and empty texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def order_key(mix: Mix, epoch: Column, row_id: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(mix.seed)), epoch, F.coalesce(row_id.cast("string"), F.lit("null"))))


def _shares(children: DataFrame, parent: tuple[str, ...], name: str) -> DataFrame:
    """Adds ``quota`` to children with columns w, cap and total (their parent's tokens)."""
    by = W.partitionBy(*parent) if parent else W.partitionBy(F.lit(0))
    ranked = by.orderBy("fill", name)
    up_to = ranked.rowsBetween(W.unboundedPreceding, W.currentRow)
    before = ranked.rowsBetween(W.unboundedPreceding, -1)
    some = children.withColumn("fill", F.when(F.col("w") > 0, F.col("cap") / F.col("w")).otherwise(F.lit(float("inf"))))
    some = some.select("*", F.sum("w").over(by).alias("all_w"), F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w_before"), F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("cap_before"))
    full = F.expr("w > 0 AND CAST(cap AS DECIMAL(20,0)) * CAST(all_w - w_before AS DECIMAL(17,0)) <= CAST(total - cap_before AS DECIMAL(20,0)) * CAST(w AS DECIMAL(17,0))")
    some = some.withColumn("full", full).withColumn("full", F.min("full").over(up_to))
    some = some.select("*", F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(by), F.lit(0)).alias("spent"), F.sum(F.when(F.col("full"), F.lit(0)).otherwise(F.col("w"))).over(up_to).alias("w_to"), F.sum(F.when(F.col("full"), F.lit(0)).otherwise(F.col("w"))).over(by).alias("w_open"))
    part = "(CAST(total - spent AS DECIMAL(20,0)) * CAST({} AS DECIMAL(17,0))) div CAST(w_open AS DECIMAL(17,0))"
    quota = F.expr(f"CASE WHEN full THEN cap WHEN w = 0 THEN 0 ELSE {part.format('w_to')} - {part.format('(w_to - w)')} END").cast("long")
    return some.withColumn("quota", quota).drop("fill", "all_w", "w_before", "cap_before", "full", "spent", "w_to", "w_open")


def _weighted(nodes: DataFrame, path: tuple[str, ...], weights: dict[tuple[str, ...], int], mix: Mix) -> DataFrame:
    """Adds ``w`` to the nodes of one depth: a join with the weights' table, which may be as long as the tree is wide."""
    if not weights:
        return nodes.withColumn("w", F.lit(1).cast("long"))
    rows = [F.struct(*[F.lit(v).cast("string").alias(c) for c, v in zip(path, p, strict=True)], F.lit(w).cast("long").alias("w")) for p, w in weights.items()]
    table = nodes.sparkSession.range(1).select(F.inline(F.array(*rows)))
    if len(weights) <= mix.broadcast_leaves:
        table = F.broadcast(table)
    return nodes.join(table, list(path), "left").withColumn("w", F.coalesce("w", F.lit(1)).cast("long"))


def budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """(levels, tokens, quota) of every leaf, from rows (levels, tokens) with one row per leaf and tokens > 0."""
    levels = mix.levels
    parent = None
    for depth, name in enumerate(levels, 1):
        path = levels[:depth]
        nodes = leaves.groupBy(*path).agg(F.sum(F.col("tokens") * mix.max_epochs).alias("cap"))
        nodes = _weighted(nodes, path, {p: w for p, w in mix.weights.items() if len(p) == depth}, mix)
        if parent is None:
            every = F.sum("cap").over(W.partitionBy(F.lit(0)))  # a row per top node
            nodes = nodes.withColumn("all_cap", every).withColumn("total", F.expr(f"(all_cap div {mix.max_epochs}) * {mix.budget_percent} div 100")).drop("all_cap")
        else:
            nodes = nodes.join(parent.select(*levels[: depth - 1], F.col("quota").alias("total")), list(levels[: depth - 1]))
        parent = _shares(nodes, levels[: depth - 1], name)
    return leaves.join(parent.select(*levels, "quota"), list(levels))


def _with_leaf(rows: DataFrame, leaf_table: DataFrame, leaves: int, mix: Mix) -> DataFrame:
    """Rows joined with their leaf's row: by broadcast while leaves are few, else by leaf and salt."""
    on = list(mix.levels)
    if leaves <= mix.broadcast_leaves:
        return rows.join(F.broadcast(leaf_table), on)
    salted = leaf_table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("mix_id"), F.lit(SALT)).cast("int")).join(salted, [*on, "salt"]).drop("salt")


def mix_sources(docs: DataFrame, mix: Mix, id_col: str = "doc_id", text_col: str = "text", tokens: Column | None = None) -> DataFrame:
    """The rows selected, once per epoch, with ``epoch`` (0, 1, ..) and ``take_tokens``; sums of the latter are the quotas.

    ``take_tokens`` is less than a row's tokens for the row in which a prefix ends. Null levels count as
    the level '' (and come out as null again); null ids are one id. Rows with one id stand at one place of the order and are
    taken together (the last place of a prefix may then overshoot by them). Rows without tokens
    are kept in whole epochs only. Columns epoch and take_tokens are replaced; all others, whatever their names, pass through.
    An empty table gives none.
    """
    own, levels = mix.levels, tuple(f"mix_level_{i}" for i in range(len(mix.levels)))
    mix = replace(mix, levels=levels)
    docs = docs.drop("epoch", "take_tokens")
    # The caller's columns travel as one struct, so that no name of theirs meets a working column.
    counted = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("mix_row"), *[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(name) for c, name in zip(own, levels, strict=True)],
        F.col(id_col).alias("mix_id"), (tokens if tokens is not None else n_words(F.col(text_col))).alias("mix_tokens"),
    )
    rows = cut(counted.select(*levels, "mix_id", "mix_tokens"), "mix-rows")
    leaves = rows.groupBy(*levels).agg(F.sum("mix_tokens").alias("tokens")).where("tokens > 0")
    plan = cut(budgets(cut(leaves, "mix-leaves"), mix).select(*levels, F.col("quota"), F.expr("CAST(quota div tokens AS INT)").alias("whole"), F.expr("quota % tokens").alias("rest")), "mix-plan")
    n = plan.count()
    # The place where each leaf's prefix ends: its bucket by sums, then the row in that bucket.
    ordered = _with_leaf(rows, plan.where("rest > 0"), n, mix).withColumn("key", order_key(mix, F.col("whole"), F.col("mix_id")))
    ordered = ordered.withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    sums = ordered.groupBy(*levels, "rest", "bucket").agg(F.sum("mix_tokens").alias("tokens"))
    to = F.sum("tokens").over(W.partitionBy(*levels).orderBy("bucket"))
    ends = cut(sums.withColumn("to", to).where((F.col("to") >= F.col("rest")) & (F.col("to") - F.col("tokens") < F.col("rest"))).select(*levels, F.col("bucket").alias("end_bucket"), (F.col("to") - F.col("tokens")).alias("before")), "mix-ends")
    within = _with_leaf(ordered.drop("whole"), ends, n, mix).where("bucket = end_bucket")
    places = within.groupBy(*levels, "rest", "before", "key").agg(F.sum("mix_tokens").alias("tokens"))
    to = F.col("before") + F.sum("tokens").over(W.partitionBy(*levels).orderBy("key"))
    last = places.withColumn("to", to).where("to >= rest AND to - tokens < rest").select(*levels, F.col("key").alias("last_key"), (F.col("rest") - (F.col("to") - F.col("tokens"))).alias("last_take"))
    plan = cut(plan.join(last, list(levels), "left").select(*levels, "whole", "last_key", "last_take"), "mix-ends")
    chosen = _with_leaf(counted, plan, n, mix).withColumn("key", order_key(mix, F.col("whole"), F.col("mix_id")))
    partial = F.coalesce(F.col("key") <= F.col("last_key"), F.lit(False)) & (F.col("mix_tokens") > 0)
    epochs = F.when(partial, F.sequence(F.lit(0), F.col("whole"))).otherwise(F.when(F.col("whole") > 0, F.sequence(F.lit(0), F.col("whole") - 1)))
    take = F.when((F.col("epoch") == F.col("whole")) & (F.col("key") == F.col("last_key")), F.least("last_take", "mix_tokens")).otherwise(F.col("mix_tokens"))
    taken = chosen.withColumn("epoch", F.explode(epochs)).withColumn("take_tokens", take)
    return taken.select("mix_row.*", "epoch", "take_tokens")


#: Sources by domain in the production mix; all others are 'other'.
DOMAINS = {"crawl": ("src0",), "curated": tuple(f"src{i}" for i in range(1, 10)), "forum": tuple(f"src{i}" for i in range(10, 20))}
PRODUCTION = Mix(
    weights={
        ("crawl",): 2, ("curated",): 3, ("forum",): 3, ("other",): 1,
        **{(d, lang): w for d in (*DOMAINS, "other") for lang, w in (("en", 6), ("de", 2), ("fr", 2), ("es", 1))},
    },
)


def domain_of(source: Column) -> Column:
    found = F.lit("other")
    for domain, sources in DOMAINS.items():
        found = F.when(source.isin(*sources), domain).otherwise(found)
    return found


def op1_query(spark, sf_dir: str) -> DataFrame:
    """Which documents the production mix takes, in which epochs and with how many tokens."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    docs = docs.select("doc_id", domain_of(F.col("source")).alias("domain"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")], n_words(F.col("text")).alias("n_tokens"))
    mixed = mix_sources(cut(docs, "mix-docs"), PRODUCTION, tokens=F.col("n_tokens"))
    return mixed.select("doc_id", "domain", "lang", "source", "epoch", "n_tokens", "take_tokens")


def _oracle(mix: Mix) -> str:
    """The same budget and order in DuckDB."""
    domains = " ".join(f"WHEN source IN ({', '.join(repr(s) for s in sources)}) THEN '{d}'" for d, sources in DOMAINS.items())
    langs = "CASE lang WHEN 'en' THEN 6 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END"
    tops = "CASE domain WHEN 'crawl' THEN 2 WHEN 'curated' THEN 3 WHEN 'forum' THEN 3 ELSE 1 END"

    def shares(name: str, source: str, parent: str, child: str) -> str:
        by = f"PARTITION BY {parent}"
        part = "((total - spent)::HUGEINT * {}) // w_open"
        return f"""
{name}1 AS (SELECT *, sum(w) OVER ({by}) AS all_w, coalesce(sum(w) OVER ({by} ORDER BY cap / w, {child} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wb,
  coalesce(sum(cap) OVER ({by} ORDER BY cap / w, {child} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cb FROM {source}),
{name}2 AS (SELECT *, min((cap::HUGEINT * (all_w - wb) <= (total - cb)::HUGEINT * w)::INT) OVER ({by} ORDER BY cap / w, {child} ROWS UNBOUNDED PRECEDING) = 1 AS full_ FROM {name}1),
{name}3 AS (SELECT *, coalesce(sum(CASE WHEN full_ THEN cap END) OVER ({by}), 0) AS spent, sum(CASE WHEN full_ THEN 0 ELSE w END) OVER ({by} ORDER BY cap / w, {child} ROWS UNBOUNDED PRECEDING) AS w_to,
  sum(CASE WHEN full_ THEN 0 ELSE w END) OVER ({by}) AS w_open FROM {name}2),
{name} AS (SELECT *, CASE WHEN full_ THEN cap ELSE {part.format('w_to')} - {part.format('(w_to - w)')} END AS quota FROM {name}3)"""

    key = f"md5('{mix.seed}|' || {{}} || '|' || doc_id)"
    return f"""
WITH d AS (SELECT doc_id, CASE {domains} ELSE 'other' END AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY ALL HAVING sum(n_tokens) > 0),
c1 AS (SELECT domain, sum(tokens * {mix.max_epochs})::BIGINT AS cap, {tops} AS w, (SELECT sum(tokens)::BIGINT * {mix.budget_percent} // 100 FROM leaves) AS total FROM leaves GROUP BY domain),
{shares('q1', 'c1', '1', 'domain')},
c2 AS (SELECT l.domain, lang, sum(tokens * {mix.max_epochs})::BIGINT AS cap, {langs} AS w, any_value(q1.quota) AS total FROM leaves l JOIN q1 USING (domain) GROUP BY l.domain, lang),
{shares('q2', 'c2', 'domain', 'lang')},
c3 AS (SELECT l.domain, l.lang, source, tokens, tokens * {mix.max_epochs} AS cap, 1 AS w, q2.quota AS total FROM leaves l JOIN q2 USING (domain, lang)),
{shares('q3', 'c3', 'domain, lang', 'source')},
p AS (SELECT domain, lang, source, (quota // tokens)::BIGINT AS whole, (quota % tokens)::BIGINT AS rest FROM q3),
o AS (SELECT d.*, whole, rest, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY {key.format('whole')}) - n_tokens AS before FROM d JOIN p USING (domain, lang, source)),
e AS (SELECT *, unnest(range(0, whole + CASE WHEN before < rest AND n_tokens > 0 THEN 1 ELSE 0 END)) AS e FROM o)
SELECT doc_id, domain, lang, source, e::INT AS epoch, n_tokens, (CASE WHEN e = whole THEN least(n_tokens, rest - before) ELSE n_tokens END)::BIGINT AS take_tokens FROM e"""


OP1_SQL = _oracle(PRODUCTION)

"""Mixing sources to target weights by budgets handed down a tree: all, domain, language, source.

Weights are propagated from the root: a node's children share its budget by their weights. A child that has less text than
its share (all epochs counted) gives the rest to its siblings, by their weights again; only what a whole subtree can't use
goes back to the siblings of its ancestors. That is filling each family from the top, with a subtree's text as capacity.
A leaf's budget buys whole epochs and then a prefix, in tokens, of one more epoch in that epoch's own seeded order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnlight.llm.select import cutoffs, small, within
from tarnlight.scratch import materialize, temporary

TREE = ("domain", "lang", "source")
DOMAINS = 4


@dataclass(frozen=True)
class Mix:
    """Target weights by level; names that aren't listed weigh 1. total: tokens wanted, as a share of all that there are."""

    weights: dict[str, dict[str, float]] = field(default_factory=dict)
    total: float = 1.0
    max_epochs: int = 2
    seed: int = 7


#: The mix of the registered query and of the pipeline.
PRODUCTION = Mix({"domain": {"d0": 2.0, "d1": 1.0, "d2": 1.0, "d3": 1.0}, "lang": {"en": 5.0, "de": 2.0, "fr": 2.0, "es": 1.0}})


def domain(source: Column) -> Column:
    """The domain that a source belongs to, by its number."""
    return F.concat(F.lit("d"), (F.coalesce(F.try_to_number(F.regexp_extract(source, "([0-9]{1,9})$", 1), F.lit("999999999")), F.lit(0)) % DOMAINS).cast("int").cast("string"))


def tokens(text: Column) -> Column:
    """Words between ASCII white space; null and empty texts have none."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("bigint")


def _weight(level: str, mix: Mix) -> Column:
    known = mix.weights.get(level, {})
    out = F.lit(1.0)
    for name, w in sorted(known.items()):
        out = F.when(F.col(level) == name, F.lit(float(w))).otherwise(out)
    return out


def _filled(nodes: DataFrame, parent: list[str], level: str, mix: Mix) -> DataFrame:
    """Budgets of a level's nodes from their parent's: in proportion to weight, none above its capacity.

    In the order of capacity by weight, a node is full if its share of what the fuller ones before it leave reaches its
    capacity. Of the first node that isn't, that share gives the rate for it and all after it.
    """
    weighed = nodes.withColumn("w", _weight(level, mix)).withColumn("r", F.when(F.col("w") > 0, F.col("capacity") / F.col("w")))
    order = Window.partitionBy(*[F.col(p) for p in parent]).orderBy(F.col("r").asc_nulls_last(), F.col(level).asc_nulls_first())
    whole = Window.partitionBy(*[F.col(p) for p in parent])
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rated = weighed.withColumn("taken", F.coalesce(F.sum("capacity").over(before), F.lit(0)).cast("double"))
    rated = rated.withColumn("open", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    rated = rated.withColumn("rate", F.when(F.col("open") > 0, (F.col("parent_budget") - F.col("taken")) / F.col("open")).otherwise(F.lit(0.0)))
    rated = rated.withColumn("full", F.coalesce(F.col("r") <= F.col("rate") + F.lit(1e-9), F.lit(False)))
    rated = rated.withColumn("level_rate", F.min(F.when(~F.col("full"), F.struct("r", level, "rate"))).over(whole)["rate"])
    share = F.when(F.col("full"), F.col("capacity").cast("double")).otherwise(F.greatest(F.lit(0.0), F.col("level_rate")) * F.col("w"))
    return rated.withColumn("budget", F.least(share, F.col("capacity").cast("double"))).drop("w", "r", "taken", "open", "rate", "full", "level_rate", "parent_budget")


def leaf_budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """``(domain, lang, source, available, budget)`` from leaves with ``available`` tokens. Null names are names."""
    whole = Window.partitionBy()
    nodes = leaves.withColumn("capacity", F.col("available") * mix.max_epochs)
    budgets = None
    for depth, level in enumerate(TREE):
        own = nodes.groupBy(*TREE[: depth + 1]).agg(F.sum("capacity").alias("capacity"), F.sum("available").alias("available"))
        if budgets is None:
            own = own.withColumn("parent_budget", F.sum("available").over(whole) * F.lit(float(mix.total)))
        else:
            up = budgets.select(*[F.col(p).alias(f"_{p}") for p in TREE[:depth]], F.col("budget").alias("parent_budget"))
            same = F.lit(True)
            for p in TREE[:depth]:
                same = same & F.col(p).eqNullSafe(F.col(f"_{p}"))
            own = own.join(up, same).drop(*[f"_{p}" for p in TREE[:depth]])
        budgets = _filled(own, list(TREE[:depth]), level, mix)
    return budgets.select(*TREE, "available", F.floor(F.col("budget") + F.lit(1e-6)).cast("bigint").alias("budget"))


def _key(doc_id: Column, epoch: Column, seed: int) -> Column:
    """60 bits of an order of its own for each epoch."""
    text = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def mixture(docs: DataFrame, mix: Mix = PRODUCTION, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``domain``, ``n_tokens`` and ``epoch``: a row for each time that a document is taken, from epoch 0.

    ``docs`` needs the columns lang and source. Texts without words cost nothing and are taken as often as their leaf's
    whole epochs, and once more if the prefix reaches them. Rows that repeat a doc_id stand or fall together within an
    epoch. Null languages and sources are names of their own. Columns called domain, n_tokens or epoch are replaced. Only
    sums of leaves, and of ranges of keys in leaves, are shuffled, no texts.
    """
    names = [c for c in docs.columns if c not in ("domain", "n_tokens", "epoch")]
    # the caller's columns travel in a struct, so that no name of theirs meets one of ours
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    rows = docs.select(row, F.col(f"`{doc_id}`").alias("id"), domain(F.col("source")).alias("domain"), "lang", "source", tokens(F.col(f"`{text}`")).alias("n_tokens"))
    leaves = rows.groupBy(*TREE).agg(F.sum("n_tokens").alias("available"))
    plan = leaf_budgets(leaves, mix).withColumn("grp", F.sha2(F.to_json(F.struct(*TREE)), 256))
    plan = plan.withColumn("epochs", F.when(F.col("available") > 0, F.floor(F.col("budget") / F.col("available"))).otherwise(F.lit(0)).cast("int"))
    named = rows.withColumn("grp", F.sha2(F.to_json(F.struct(*TREE)), 256))
    with temporary(docs.sparkSession):
        plan = materialize(plan.select("grp", "epochs", (F.col("budget") - F.col("epochs") * F.col("available")).alias("budget")), "mix")
        slim = named.select("grp", F.col("id").alias("tie"), F.col("n_tokens").alias("weight")).join(small(plan.select("grp", "epochs")), "grp")
        slim = slim.select("grp", _key(F.col("tie"), F.col("epochs"), mix.seed).alias("key"), F.coalesce("tie", F.lit(-1)).alias("tie"), "weight")
        slim = materialize(slim, "keys")
        ends = materialize(plan.select("grp", "epochs").join(cutoffs(slim, plan.select("grp", "budget")), "grp"), "ends", keep=True)
    taken = named.join(small(ends), "grp")
    part = within(_key(F.col("id"), F.col("epochs"), mix.seed), F.coalesce("id", F.lit(-1)), F.col("last_key"), F.col("last_tie"))
    times = F.col("epochs") + part.cast("int")
    taken = taken.where(times > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), times - 1)))
    return taken.select(*[F.col("row")[c].alias(c) for c in names], "domain", "n_tokens", "epoch")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mixture(docs).select("doc_id", "domain", "lang", "source", "n_tokens", "epoch")


def _family(depth: int, mix: Mix) -> str:
    level, keys = TREE[depth], ", ".join(TREE[: depth + 1])
    parent = f"PARTITION BY {', '.join(TREE[:depth])}" if depth else ""
    weight = "CASE " + " ".join(f"WHEN {level} = '{n}' THEN {w:e}" for n, w in sorted(mix.weights.get(level, {}).items())) + " ELSE 1e0 END" if mix.weights.get(level) else "1e0"
    up = f"(SELECT sum(available) * {mix.total:e} FROM leaves)" if not depth else "p.budget"
    join = "" if not depth else f" JOIN b{depth - 1} p ON " + " AND ".join(f"n.{k} IS NOT DISTINCT FROM p.{k}" for k in TREE[:depth])
    return f"""
n{depth} AS (SELECT {keys}, sum(available) AS available, sum(available) * {mix.max_epochs} AS capacity, {weight} AS w FROM leaves GROUP BY ALL),
u{depth} AS (SELECT n.*, {up} AS up, capacity / w AS r FROM n{depth} n{join}),
r{depth} AS (SELECT *, (up - coalesce(sum(capacity) OVER before, 0)) / (sum(w) OVER whole - coalesce(sum(w) OVER before, 0)) AS rate FROM u{depth}
  WINDOW before AS ({parent} ORDER BY r, {level} NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), whole AS ({parent})),
m{depth} AS (SELECT *, first_value(CASE WHEN r > rate + 1e-9 THEN rate END IGNORE NULLS) OVER ({parent} ORDER BY r, {level} NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS level_rate FROM r{depth}),
b{depth} AS (SELECT {keys}, available, least(capacity, CASE WHEN r <= rate + 1e-9 THEN capacity ELSE greatest(0, level_rate) * w END) AS budget FROM m{depth})"""


def sql(mix: Mix = PRODUCTION) -> str:
    """The query in DuckDB SQL, with one ordered window over each leaf."""
    key = f"CAST(concat('0x', substr(md5(concat('{mix.seed}:', epochs, ':', doc_id)), 1, 15)) AS BIGINT)"
    return f"""
WITH rows AS (
  SELECT doc_id, lang, source, 'd' || (coalesce(try_cast(nullif(regexp_extract(source, '([0-9]{{1,9}})$', 1), '') AS BIGINT), 0) % {DOMAINS}) AS domain,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens) AS available FROM rows GROUP BY ALL),{",".join(_family(k, mix) for k in range(len(TREE)))},
plan AS (SELECT domain, lang, source, available, CAST(floor(budget + 1e-6) AS BIGINT) AS budget,
  CASE WHEN available > 0 THEN CAST(floor(budget + 1e-6) AS BIGINT) // CAST(available AS BIGINT) ELSE 0 END AS epochs FROM b{len(TREE) - 1}),
placed AS (
  SELECT rows.*, plan.epochs, plan.budget - plan.epochs * plan.available AS rest, sum(n_tokens) OVER (PARTITION BY rows.domain, rows.lang, rows.source ORDER BY {key}, doc_id) AS upto
  FROM rows JOIN plan ON rows.domain = plan.domain AND rows.lang IS NOT DISTINCT FROM plan.lang AND rows.source IS NOT DISTINCT FROM plan.source)
SELECT doc_id, domain, lang, source, n_tokens, CAST(e AS INT) AS epoch
FROM (SELECT *, unnest(generate_series(0, CAST(epochs - 1 + (upto <= rest)::INT AS BIGINT))) AS e FROM placed) x
"""

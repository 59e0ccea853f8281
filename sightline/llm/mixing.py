"""Mixing sources to target weights: budgets down a tree, and token prefixes of seeded epochs at its leaves."""

from __future__ import annotations

from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed, parts_for, small, table, text_of, unit_hash

LEVELS = ("domain", "lang", "source")


def water_fill(budget: float, weights: list[float], capacities: list[float]) -> list[float]:
    """budget over children by weight; what a child can't take goes to its siblings by their weights, again and again."""
    out, left, open_ = [0.0] * len(weights), min(budget, sum(capacities)), [i for i, w in enumerate(weights) if w > 0]
    while open_ and left > 1e-9:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / total >= capacities[i] - out[i] - 1e-12]
        if not full:
            for i in open_:
                out[i] += left * weights[i] / total
            break
        for i in full:
            left -= capacities[i] - out[i]
            out[i] = capacities[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


def dividing(path: list[str], weights: Mapping[str, float]):
    """A group of siblings, named by the last of path, with the budget of their parent divided."""

    def divide(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(path[-1], ignore_index=True)
        own = [float(weights.get(x, weights.get("*", 1.0))) for x in rows[path[-1]]]
        shares = water_fill(float(rows["budget"].iloc[0]), own, rows["capacity"].astype(float).tolist())
        return rows[path].assign(budget=shares)

    return divide


def takes(name: Column, weights: Mapping[str, float]) -> Column:
    """Whether a name's weight is over 0; null has the weight of others."""
    others = weights.get("*", 1.0) > 0
    listed = [n for n, w in weights.items() if n != "*" and (w > 0) != others]
    return F.coalesce(name.isin(listed) != F.lit(others), F.lit(others)) if listed else F.lit(others)


def able(weights: Mapping[str, Mapping[str, float]]) -> Column:
    """Whether a leaf may give anything: no name above it, or its own, has weight 0."""
    out = F.lit(True)
    for level in LEVELS:
        out = out & takes(F.col(level), dict(weights.get(level, {})))
    return out


def leaf_budgets(leaves: DataFrame, weights: Mapping[str, Mapping[str, float]], budget_share: float, max_epochs: int) -> DataFrame:
    """leaves(domain, lang, source, tokens) with budget, in tokens.

    From the root down, a node's budget goes to its children by weight, but no child gets more than its whole
    subtree has in max_epochs. So a shortage is made up by siblings while they can, and only what a whole subtree
    lacks by the siblings of its ancestors. A leaf below a name of weight 0 can take nothing, so its tokens are no capacity of
    the nodes above it. Each node's children are one group of a Spark job.
    """
    capacity = leaves.withColumn("capacity", F.when(able(weights), F.col("tokens") * float(max_epochs)).otherwise(0.0))
    whole = (leaves.agg(F.sum("tokens")).first()[0] or 0) * float(budget_share)
    nodes = None
    path: list[str] = []
    for level in LEVELS:
        own = dict(weights.get(level, {}))
        parent = [f"p_{c}" for c in path]
        children = capacity.groupBy(*path, level).agg(F.sum("capacity").alias("capacity"))
        on = F.lit(True)
        if path:
            nodes = nodes.select(*(F.col(c).alias(f"p_{c}") for c in path), "budget")
            for c in path:
                on = on & F.col(c).eqNullSafe(F.col(f"p_{c}"))
            children = children.join(nodes, on).drop(*parent)
        else:
            children = children.withColumn("budget", F.lit(whole))
        schema = ", ".join([*(f"{c} string" for c in [*path, level]), "budget double"])
        children = children.withColumn("_parent", F.struct(*path) if path else F.lit(0))
        nodes = children.groupBy("_parent").applyInPandas(dividing([*path, level], own), schema)
        path.append(level)
    budgets = nodes.select(*(F.col(c).alias(f"b_{c}") for c in LEVELS), "budget")
    on = F.lit(True)
    for c in LEVELS:
        on = on & F.col(c).eqNullSafe(F.col(f"b_{c}"))
    return leaves.join(budgets, on).drop(*(f"b_{c}" for c in LEVELS))


def words() -> Column:
    """The number of words of the text; none for a null one."""
    return F.regexp_count(text_of(), F.lit(r"[^\x20\x09-\x0D]+"))


def mix(docs: DataFrame, domain: Column, weights: Mapping[str, Mapping[str, float]] | None = None, budget_share: float = 1.0, max_epochs: int = 4, seed: int = 0, tokens: Column | None = None) -> DataFrame:
    """(doc_id, domain, lang, source, n_tokens, epoch): a row for each time that a document is taken.

    weights: for each level (domain, lang, source) the weight of each name, "*" for others; 1 where none is
    given. budget_share: the mixture's tokens as a share of all tokens; tokens: a document's tokens,
    by default its words. A leaf whose budget holds e epochs takes all its documents in epochs 0 to e - 1, and of
    epoch e the longest prefix of that epoch's seeded order within the rest.

    The order's running totals go over ranges of a hash, so that no leaf, however large, is in one task.
    Null levels are names of their own, of the others' weight; a leaf of weight 0 gives nothing. An empty text has no tokens and comes with the prefix it stands in. Rows
    that repeat are taken each; rows with equal hashes come in the order of doc_id. Without rows the result is empty. Very long texts count whole; one longer than what is left of
    its leaf's budget ends the prefix. Columns of docs other than doc_id, lang and source are left out.
    """
    count = tokens if tokens is not None else words()
    rows = docs.select("doc_id", domain.cast("string").alias("domain"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), count.cast("long").alias("n_tokens"))
    rows = checkpointed(rows)
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    budgets = leaf_budgets(leaves, weights or {}, budget_share, max_epochs)
    epochs = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens") + 1e-9)).otherwise(0).cast("int")
    budgets = checkpointed(budgets.withColumn("epochs", epochs).withColumn("rest", F.floor(F.col("budget") - F.col("epochs") * F.col("tokens") + 1e-6)))
    budgets = budgets.select(*(F.col(c).alias(f"b_{c}") for c in LEVELS), "epochs", "rest")
    on = F.lit(True)
    for c in LEVELS:
        on = on & F.col(c).eqNullSafe(F.col(f"b_{c}"))
    planned = rows.join(small(budgets), on).drop(*(f"b_{c}" for c in LEVELS))
    parts = parts_for(rows.count(), 1024)
    shuffled = planned.withColumn("_u", unit_hash("doc_id", "epochs", seed=seed)).withColumn("_cell", F.least(F.lit(parts - 1), F.floor(F.col("_u") * parts)).cast("long"))
    before = Window.partitionBy(*LEVELS).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = shuffled.groupBy(*LEVELS, "_cell").agg(F.sum("n_tokens").alias("_sum")).withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    cells = cells.select(*(F.col(c).alias(f"c_{c}") for c in LEVELS), F.col("_cell").alias("c_cell"), "_before")
    on = F.col("_cell") == F.col("c_cell")
    for c in LEVELS:
        on = on & F.col(c).eqNullSafe(F.col(f"c_{c}"))
    within = Window.partitionBy(*LEVELS, "_cell").orderBy("_u", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    ended = shuffled.join(cells, on).withColumn("_end", F.col("_before") + F.sum("n_tokens").over(within))
    more = (F.col("_end") <= F.col("rest")) & ((F.col("rest") > 0) | ((F.col("epochs") == 0) & able(weights or {})))
    times = F.col("epochs") + F.when(more & (F.col("epochs") < max_epochs), 1).otherwise(0)
    taken = ended.withColumn("_times", times).where("_times > 0")
    return taken.select("doc_id", *LEVELS, "n_tokens", F.explode(F.sequence(F.lit(0), F.col("_times") - 1)).alias("epoch"))


#: The query's mixture: domains of sources, and weights of domains and languages.
DOMAINS = {"web": tuple(f"src{i}" for i in range(10)), "forum": tuple(f"src{i}" for i in range(10, 15)), "books": tuple(f"src{i}" for i in range(15, 20))}
WEIGHTS = {"domain": {"web": 0.5, "forum": 0.2, "books": 0.3}, "lang": {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15}}


def domain_of(source: str = "source") -> Column:
    out = F.lit("other")
    for name, sources in DOMAINS.items():
        out = F.when(F.col(source).isin(*sources), name).otherwise(out)
    return out


def mixed_documents(docs: DataFrame, budget_share: float = 0.7, seed: int = 0) -> DataFrame:
    """docs cut down to the mixture, each document once at most; all columns stay. Rows with the same doc_id stay or go together."""
    rows = docs.select("doc_id", "lang", "source", words().alias("_n")).groupBy("doc_id").agg(F.min(F.struct("lang", "source", "_n")).alias("_v")).select("doc_id", "_v.*")
    taken = mix(rows, domain_of(), WEIGHTS, budget_share, max_epochs=1, seed=seed, tokens=F.col("_n")).select(F.col("doc_id").alias("_taken"))
    taken = small(checkpointed(taken))
    return docs.join(taken, docs["doc_id"].eqNullSafe(taken["_taken"]), "left_semi")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), domain_of(), WEIGHTS)

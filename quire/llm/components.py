"""Consolidating pairwise matches into groups: connected components by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.plans.ids import dense_ids
from quire.plans.skew import HOT_ROWS, split_hot
from quire.session import checkpoint


def _through(left: DataFrame, parents: DataFrame, key: str, rows: int) -> DataFrame:
    """left with the column __to, the parent of its key (the key itself where it has none); balanced for hot keys."""
    table = parents.select(F.col("node").alias("__k"), F.col("parent").alias("__p"))

    def join(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.join(b, "__k", "left")

    keyed = left.withColumn("__k", F.col(key))
    got = join(keyed, table) if rows < HOT_ROWS else split_hot(keyed, [table], "__k", join)
    return got.withColumn("__to", F.coalesce(F.col("__p"), F.col(key))).drop("__k", "__p")


def component_labels(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, label) for the nodes of edges (u long, v long): label is the smallest node reachable. Self-loops only give their node itself.

    Each round every node takes the smallest of its neighbours and itself as its parent, parents are followed by pointer jumping
    (each jump doubles the distance) until none changes, and the edges are contracted to the roots; the next round works on
    what is left. Every node but the least of its neighbourhood hooks onto a smaller one or is hooked in the next round, so at least half of the nodes that still have
    edges go in two rounds. Every step is checkpointed; the driver receives counts only. Nulls
    are dropped; repeated and mirrored edges change nothing; an empty table gives an empty result.
    """
    clean = edges.where(F.col("u").isNotNull() & F.col("v").isNotNull()).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    own = checkpoint(clean)
    labels = own.select(F.explode(F.array("u", "v")).alias("node")).distinct().select("node", F.col("node").alias("label"))
    left = own.where(F.col("u") != F.col("v"))
    n_left = left.count()
    for _ in range(max_rounds):
        if n_left == 0:
            return labels
        both = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parents = both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("parent"))
        parents = checkpoint(parents)
        n_nodes = parents.count()
        while True:
            jumped = checkpoint(_through(parents, parents, "parent", n_nodes))
            changed = jumped.where(F.col("__to") != F.col("parent")).limit(1).count()
            parents = jumped.select("node", F.col("__to").alias("parent"))
            if not changed:
                break
        labels = checkpoint(_through(labels, parents, "label", n_nodes).select("node", F.col("__to").alias("label")))
        ends = _through(left, parents, "u", n_left).select(F.col("__to").alias("u"), "v")
        ends = _through(ends, parents, "v", n_left).select("u", F.col("__to").alias("v")).where(F.col("u") != F.col("v"))
        left = checkpoint(ends.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
        n_left = left.count()
    raise RuntimeError(f"no fixpoint after {max_rounds} rounds")


def groups(pairs: DataFrame, a: str = "a", b: str = "b", name: str = "rel", group: str = "group_rel") -> DataFrame:
    """One row (name, group) for every value that occurs in a pair: group is the smallest value reachable through pairs.

    Values are compared as Spark compares them (strings by code point). Pairs with a null end are dropped; a pair of a value with itself
    gives that value a group of its own; order and repetition of pairs, and other columns, don't matter.
    Values are replaced by dense ids in the same order, so labels are 8 bytes whatever the values' length.
    """
    p = checkpoint(pairs.select(F.col(a).alias("a"), F.col(b).alias("b")).where(F.col("a").isNotNull() & F.col("b").isNotNull()).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    values = p.select(F.explode(F.array("a", "b")).alias("value")).distinct()
    ids = checkpoint(dense_ids(values, "value"))
    rows = p.count()

    def code(df: DataFrame, column: str, out: str) -> DataFrame:
        table = ids.select(F.col("value").alias("__k"), F.col("id").alias(out))
        keyed = df.withColumnRenamed(column, "__k")
        got = keyed.join(table, "__k") if rows < HOT_ROWS else split_hot(keyed, [table], "__k", lambda x, y: x.join(y, "__k"))
        return got.drop("__k")

    labels = component_labels(code(code(p, "a", "u"), "b", "v"))
    named = labels.join(ids.select(F.col("id").alias("node"), F.col("value").alias(name)), "node")
    roots = ids.select(F.col("id").alias("label"), F.col("value").alias(group))
    if rows >= HOT_ROWS:
        return split_hot(named, [roots], "label", lambda x, y: x.join(y, "label")).select(name, group)
    return named.join(roots, "label").select(name, group)


def candidate_matches(candidates: DataFrame, least: float = 0.6) -> DataFrame:
    """The pairs (a, b) of page paths that match: score at least `least`, two different pages, a leading slash ignored; null scores and ends are no match."""
    path = lambda c: F.regexp_replace(F.col(c), "^/", "")
    return candidates.where(F.col("score") >= least).select(path("a").alias("a"), path("b").alias("b")).where(F.col("a") != F.col("b"))

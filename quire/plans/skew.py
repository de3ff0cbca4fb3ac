"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds at least this share of the rows; so there are at most 1/HOT_SHARE hot keys.
HOT_SHARE = 0.01
#: Below this many rows for the largest possible key a plain shuffle join copes.
HOT_ROWS = 200_000
#: Largest table, in rows of a bounded width, that is ever broadcast.
SMALL_ROWS = 100_000


def is_small(df: DataFrame, rows: int = SMALL_ROWS) -> bool:
    """Whether df has at most `rows` rows; reads no more than it must to tell."""
    return len(df.limit(rows + 1).select(F.lit(1).alias("one")).groupBy().count().where(F.col("count") <= rows).take(1)) == 1


def lookup(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", rows: int = SMALL_ROWS) -> DataFrame:
    """Join with a table that is usually small: broadcast when its counted size is at most `rows`, else shuffle."""
    return left.join(F.broadcast(right) if is_small(right, rows) else right, on, how)


def hot_keys(df: DataFrame, key: str, share: float = HOT_SHARE, least: int = HOT_ROWS) -> DataFrame | None:
    """The values of key that hold at least `share` of df's rows and at least `least` rows, or None.

    At most 1/share values can qualify, whatever the size of df, so the result may be collected and broadcast.
    The counts are partially aggregated before their shuffle.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(key).count()
    top = counts.where(F.col("count") >= least).orderBy(F.desc("count")).limit(int(1 / share)).collect()
    if not top:
        return None
    total = df.count()
    hot = [r[key] for r in top if r["count"] >= share * total]
    return df.sparkSession.createDataFrame([(k,) for k in hot], df.select(key).schema) if hot else None


def split_hot(left: DataFrame, rights: list[DataFrame], key: str, join) -> DataFrame:
    """Run `join(left, *rights)` with the hot values of key taken apart.

    join must keep each left row's fate a function of that row and the right rows of its key. Rows of hot keys meet
    only the right rows of those keys, which are broadcast where they are few enough, so they are never shuffled into one task;
    every other row takes the ordinary shuffle join.
    """
    hot = hot_keys(left, key)
    if hot is None:
        return join(left, *rights)
    few = F.broadcast(hot)
    cold = join(left.join(few, key, "left_anti"), *rights)
    own = [r.join(few, key, "left_semi") for r in rights]
    own = [F.broadcast(r) if is_small(r) else r for r in own]
    return cold.unionByName(join(left.join(few, key, "left_semi"), *own))

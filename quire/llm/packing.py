"""Filling containers of fixed capacity with items of varying length.

Items are spread over partitions of bounded size and packed best-fit-decreasing. Dual-feasible-function lower bounds certify a
partition whose bin count cannot be beaten; partitions with a gap exchange the items of their unfilled bins and are packed again,
as long as that saves bins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import checkpoint

#: Items packed by one task; a partition of this size needs some tens of MB.
GROUP_ITEMS = 100_000
#: Most rounds of exchange.
ROUNDS = 3


#: Elements of the tables that lower_bound holds at a time (8 bytes each, three of them).
TABLE = 1 << 20


def lower_bound(sizes: np.ndarray, capacity: int, counts: np.ndarray | None = None) -> int:
    """Fewest bins any packing needs, by dual feasible functions over the distinct sizes (each `counts` times).

    Threshold functions (sizes above capacity - e count as a whole bin, below e as nothing) are composed with
    rounding functions (multiples of capacity/(k+1) stay, others round down to multiples of capacity/k). The thresholds are
    those at which a function changes on the sizes present, at most 2,048 of them; memory is bounded whatever the capacity.
    """
    sizes = np.asarray(sizes, np.int64)
    x, n = np.unique(sizes, return_counts=True)
    if counts is not None:
        n = np.bincount(np.searchsorted(x, sizes), np.asarray(counts, np.float64), len(x))
    n, x = n[x > 0].astype(np.float64), x[x > 0]
    if not len(x):
        return 0
    best = math.ceil(round(x @ n) / capacity)
    es = np.unique(np.concatenate([[0], x + 1, capacity - x + 1, x, capacity - x]))
    es = es[(es >= 0) & (2 * es <= capacity)]
    es = es[:: max(1, len(es) // 2048)]
    for at in range(0, len(es), max(1, TABLE // len(x))):
        e = es[at : at + max(1, TABLE // len(x)), None]
        cut = np.where(x[None, :] > capacity - e, capacity, np.where(x[None, :] < e, 0, x[None, :]))
        best = max(best, math.ceil((cut @ n).max() / capacity - 1e-9))
        for k in range(1, 11):
            m = (k + 1) * cut
            # in units of capacity/k; an exact multiple of capacity/(k+1) keeps its value
            f = np.where(m % capacity == 0, cut * (k / capacity), m // capacity)
            best = max(best, math.ceil((f @ n).max() / k - 1e-9))
    return int(best)


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin number of each item; bins are numbered from 0. Sizes of 0 go where they fit, into a bin of their own only if there is none."""
    order = np.argsort(-np.asarray(sizes), kind="stable")
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0  # bit r: some bin has room r
    out = np.zeros(len(sizes), np.int64)
    n = 0
    for i, s in zip(order.tolist(), np.asarray(sizes)[order].tolist()):
        m = mask >> s
        if m:
            room = s + ((m & -m).bit_length() - 1)
            stack = by_room[room]
            b = stack.pop()
            if not stack:
                mask &= ~(1 << room)
        else:
            b, room = n, capacity
            n += 1
        out[i] = b
        room -= s
        by_room[room].append(b)
        mask |= 1 << room
    return out


def pack(df: DataFrame, size: str, capacity: int, keep: list[str], group_items: int = GROUP_ITEMS, rounds: int = ROUNDS) -> DataFrame:
    """Assignment of every row of df to containers: keep..., piece, start, n, container.

    An item of at most `capacity` is one piece (piece 0, start 0, n its size). A larger one is cut into pieces of
    `capacity` that fill a container each, and a last piece that is packed like an item. container is a string, unique over the
    result; the n of a container's rows add up to at most capacity. A size of null, 0 or less takes no room (n = 0) and shares a container. Rows are items,
    so repeated rows are packed each for themselves; an empty table gives an empty result.

    Items are spread by row number, so neither a frequent id nor a frequent size makes a large partition. Only ids and sizes are
    shuffled; each round is checkpointed. The driver receives two numbers per round.
    """
    items = df.select(*keep, F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).alias("__size"))
    items = checkpoint(items.withColumn("__row", F.monotonically_increasing_id()))
    whole = F.floor(F.col("__size") / capacity).cast("int")
    large = F.col("__size") > capacity
    cut = items.where(large).select(*keep, "__row", F.explode(F.sequence(F.lit(0), whole - 1)).alias("piece"))
    full = cut.select(*keep, "piece", (F.col("piece").cast("long") * capacity).alias("start"), F.lit(capacity).cast("long").alias("n"), F.concat_ws("-", F.lit("w"), F.col("__row"), F.col("piece")).alias("container"))
    rest = items.select(
        *keep,
        "__row",
        F.when(large, whole).otherwise(F.lit(0)).cast("int").alias("piece"),
        F.when(large, whole.cast("long") * capacity).otherwise(F.lit(0)).cast("long").alias("start"),
        F.when(large, F.col("__size") % capacity).otherwise(F.col("__size")).cast("long").alias("n"),
    ).where((F.col("n") > 0) | (F.col("piece") == 0))

    done: list[DataFrame] = []
    todo, n_todo = rest, rest.count()
    before: DataFrame | None = None  # the packing that the present round tries to beat
    before_bins = 0
    for turn in range(rounds + 1):
        packed = checkpoint(_pack_groups(todo, keep, capacity, max(1, math.ceil(n_todo / group_items)), turn))
        # one row per partition carries its bins and its bound
        bins = packed.where("head").agg(F.sum("bins").alias("b")).first()["b"] or 0
        if before is not None and bins >= before_bins:
            done.append(before)
            break
        closed = (F.col("bins") == F.col("bound")) | (F.col("room") == 0)
        done.append(packed.where(closed))
        open_ = packed.where(~closed)
        stats = open_.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("container").alias("b")).first()
        if not stats["n"] or turn == rounds:
            done.append(open_)
            break
        before, before_bins = open_, stats["b"]
        todo, n_todo = open_.select(*keep, "__row", "piece", "start", "n"), stats["n"]
    out = full
    for part in done:
        out = out.unionByName(part.select(*keep, "piece", "start", "n", "container"))
    return out


def _pack_groups(items: DataFrame, keep: list[str], capacity: int, groups: int, turn: int) -> DataFrame:
    schema = ", ".join([*[f"`{c}` {items.schema[c].dataType.simpleString()}" for c in keep], "__row long, piece int, start long, n long, container string, room long, bins long, bound long, head boolean"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # later rounds visit equal sizes in another order, so that exchanged items meet other partners
        pdf = pdf.sort_values(["n", "__row", "piece"], ascending=[False, turn % 2 == 0, True], ignore_index=True)
        group = int(pdf["__g"].iloc[0])
        sizes = pdf["n"].to_numpy()
        bin_of = best_fit_decreasing(sizes, capacity)
        n_bins = int(bin_of.max()) + 1
        used = np.bincount(bin_of, sizes, n_bins).astype(np.int64)
        out = pdf.drop(columns="__g")
        out["container"] = [f"{turn}-{group}-{b}" for b in bin_of.tolist()]
        out["room"] = capacity - used[bin_of]
        out["bins"], out["bound"] = n_bins, max(lower_bound(sizes, capacity), 1)
        out["head"] = np.arange(len(out)) == 0
        return out

    spread = F.pmod(F.xxhash64("__row", "piece", F.lit(turn)), F.lit(groups)).cast("int")
    return items.withColumn("__g", spread).groupBy("__g").applyInPandas(run, schema)


def container_fill(packed: DataFrame) -> DataFrame:
    """Per container: container, n_pieces, n_tokens."""
    return packed.groupBy("container").agg(F.count(F.lit(1)).alias("n_pieces"), F.sum("n").alias("n_tokens"))


def certificates(packed: DataFrame, capacity: int) -> DataFrame:
    """Per partition of a packing: part, n_items, bins, bound, gap. bound is computed anew from the sizes the partition ended with, so gap says how many
    bins at most a better packing of the partition would save. Pieces that fill a container each are the part `w`, with no gap. Grouped by size first: a
    task gets one row per distinct size of its partition.
    """
    part = F.when(F.col("container").startswith("w-"), F.lit("w")).otherwise(F.regexp_replace("container", "-[0-9]+$", ""))
    rows = packed.withColumn("part", part)
    bins = rows.groupBy("part", "container").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n")).groupBy("part").agg(F.sum("k").alias("n_items"), F.count(F.lit(1)).alias("bins"))
    sizes = rows.where(F.col("part") != "w").groupBy("part", "n").count()

    def bound(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "least": [lower_bound(pdf["n"].to_numpy(), capacity, pdf["count"].to_numpy())]})

    bounds = sizes.groupBy("part").applyInPandas(bound, "part string, least long")
    both = bins.join(bounds, "part", "left").withColumn("bound", F.when(F.col("part") == "w", F.col("bins")).otherwise(F.greatest("least", F.lit(1))))
    return both.select("part", "n_items", "bins", "bound", (F.col("bins") - F.col("bound")).alias("gap"))

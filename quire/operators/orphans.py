"""References to records that do not exist.

Foreign keys of several columns, some of them null, are checked by null mask: the references are grouped by which key
columns are null, and each mask is anti-joined on its non-null columns under a declared match semantics.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.paths import page_path
from quire.plans.skew import split_hot
from quire.session import checkpoint

MATCHES = ("simple", "full", "partial")


#: A key column: the column of the references and the column of the targets it must equal, or the pair of columns (from, until before) it must lie between.
Key = tuple[str, str | tuple[str, str]]


def orphan_references(refs: DataFrame, targets: DataFrame, keys: Sequence[Key], match: str = "simple", facts: dict[str, Column] | None = None, max_keys: int = 6) -> DataFrame:
    """Rows of refs whose key names no row of targets, with their `null_mask`.

    keys pairs a column of refs with the column of targets it refers to, or with two columns of targets between which it must lie (from the first,
    until before the second; a null second has no end; such a target's own first must not be null). A mask is a string with one digit a key column,
    1 where the reference is null. Match semantics, as in SQL's MATCH clause:

    * simple: a reference with any null is satisfied; only mask 00…0 is checked;
    * full: all null is satisfied, some null is always an orphan;
    * partial: all null is satisfied; else some target must agree in every non-null column. Not with an interval as the only non-null column.

    facts are aggregates over targets; each comes as a column: its value over the targets that equal the reference in the first non-null column, null if there are none (and for
    orphans that were not looked up). Nulls in the targets agree with nothing. Repeated references stay repeated, repeated targets change nothing, an
    empty target table makes every checked reference an orphan. Other columns of refs pass through whatever their
    names; only `null_mask` and the facts are added (columns of that name are replaced). Each mask is one anti-join on an equality of
    its non-null columns; the values of the first of them that hold a large share of the rows are split off (see plans.skew), for the facts as well.
    """
    if match not in MATCHES:
        raise ValueError(f"match must be one of {MATCHES}")
    if not 1 <= len(keys) <= max_keys:
        raise ValueError(f"between 1 and {max_keys} key columns")
    facts = facts or {}
    mask = F.concat(*[F.when(F.col(r).isNull(), "1").otherwise("0") for r, _ in keys])
    refs = refs.drop("null_mask", *facts).withColumn("null_mask", mask)
    sides = [t if isinstance(t, tuple) else (t,) for _, t in keys]
    renamed = targets.select(*[F.col(c).alias(f"__t{i}{'_'[:j]}") for i, t in enumerate(sides) for j, c in enumerate(t)])
    nothing = [F.lit(None).cast(t).alias(n) for n, t in targets.agg(*[c.alias(n) for n, c in facts.items()]).dtypes] if facts else []
    out = []
    for bits in range(2 ** len(keys)):
        m = format(bits, f"0{len(keys)}b")
        some, every = "1" in m, "0" not in m
        if every or (some and match == "simple"):
            continue
        own = refs.where(F.col("null_mask") == m)
        if some and match == "full":
            out.append(own.select("*", *nothing))
            continue
        held = [i for i, b in enumerate(m) if b == "0"]
        equal = [i for i in held if len(sides[i]) == 1]
        if not equal:
            raise ValueError("an interval needs a column of equality beside it")
        first, rest = equal[0], [i for i in held if i != equal[0]]
        columns = [c for c in renamed.columns if int(c.strip("_t")) in held]
        pool = renamed.select(*columns).where(" and ".join(f"__t{i} is not null" for i in held)).distinct().withColumn("__k", F.col(f"__t{first}"))
        rights = [pool]
        if facts:
            rights.append(targets.where(F.col(sides[first][0]).isNotNull()).groupBy(F.col(sides[first][0]).alias("__k")).agg(*[c.alias(n) for n, c in facts.items()]))

        def anti(a: DataFrame, b: DataFrame, known: DataFrame | None = None, rest: list[int] = rest) -> DataFrame:
            on: Column = a["__k"] == b["__k"]
            for i in rest:
                if len(sides[i]) == 1:
                    on = on & (a[keys[i][0]] == b[f"__t{i}"])
                else:
                    on = on & (b[f"__t{i}"] <= a[keys[i][0]]) & (b[f"__t{i}_"].isNull() | (a[keys[i][0]] < b[f"__t{i}_"]))
            left = a.join(b, on, "left_anti")
            return left if known is None else left.join(known, "__k", "left")

        out.append(split_hot(own.withColumn("__k", F.col(keys[first][0])), rights, "__k", anti).drop("__k"))
    if not out:
        return refs.where(F.lit(False)).select("*", *nothing)
    result = out[0]
    for df in out[1:]:
        result = result.unionByName(df)
    return result


def orphans_in_time(refs: DataFrame, lives: DataFrame, path: str = "path", at: str = "seen_at") -> DataFrame:
    """References whose path has no target alive at their time, with `state`.

    refs needs the columns path and at; lives has path, added_at and deleted_at, a target being alive from added_at
    until before deleted_at (null: for ever; a null added_at: from the start). The key is the pair (path, time) under
    MATCH SIMPLE, the time matching by interval: a reference with a null path or time is no case. What is dangling is classified by the first time its path was
    ever added: `missing` (never), `deleted` (before the reference), else `late`. Repeated rows stay; empty tables are
    fine: without lives every reference is `missing`.
    """
    start = F.coalesce(F.col("added_at"), F.lit("0001-01-01").cast(lives.schema["added_at"].dataType))
    spans = lives.select("path", start.alias("added_at"), "deleted_at")
    dangling = orphan_references(refs, spans, [(path, "path"), (at, ("added_at", "deleted_at"))], "simple", {"__first": F.min("added_at")})
    state = F.when(F.col("__first").isNull(), "missing").when(F.col("__first") <= F.col(at), "deleted").otherwise("late")
    return dangling.withColumn("state", state).drop("__first", "null_mask")


#: table, id column
REFERENCE_TABLES = (("page_link", "link_id"), ("page_relation", "relation_id"), ("ref_def", "refdef_id"))


def page_references(tables: dict[str, DataFrame]) -> DataFrame:
    """The internal page references of the given reference tables: (ref_table, ref_id, path, seen_at)."""
    out = None
    for name, key in REFERENCE_TABLES:
        if name in tables:
            t = tables[name]
            r = t.select(F.lit(name).alias("ref_table"), F.col(key).alias("ref_id"), page_path(F.col("target"), F.col("rel")).alias("path"), "seen_at")
            r = r.where(F.col("path").isNotNull())
            out = r if out is None else out.unionByName(r)
    return out


def dangling_page_references(tables: dict[str, DataFrame], pages: Sequence[DataFrame]) -> DataFrame:
    """Dangling references per table and month: (ref_table, ref_id, period, state), each once.

    pages are tables with rel, added_at and deleted_at. Rows delivered again (same id) give one row. The references are written once, since the
    search for hot paths reads them before the join does.
    """
    lives = None
    for p in pages:
        q = p.select(F.col("rel").alias("path"), "added_at", "deleted_at")
        lives = q if lives is None else lives.unionByName(q)
    found = orphans_in_time(checkpoint(page_references(tables)), lives)
    return found.select("ref_table", "ref_id", F.date_format("seen_at", "yyyy-MM").alias("period"), "state").distinct()


def dangling_by_period(found: DataFrame) -> DataFrame:
    """Report: dangling references per table, month and state."""
    return found.groupBy("ref_table", "period", "state").agg(F.count(F.lit(1)).alias("n_refs"))

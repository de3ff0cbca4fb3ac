"""Finding pages by their metadata, and the declared views over pages."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.paths import name_of
from quire.operators.catalog import RESERVED
from quire.operators.report import page_facts


def bundle_path(path: str, bundle: str = "") -> str:
    """A path argument as a bundle path: backslashes, `./`, doubled and outer slashes and a leading bundle folder are taken off. Raises ValueError outside the bundle."""
    parts: list[str] = []
    for step in path.replace("\\", "/").split("/"):
        if step == "..":
            if not parts:
                raise ValueError(f"{path} is outside the bundle")
            parts.pop()
        elif step not in ("", "."):
            parts.append(step)
    if bundle and parts[:1] == [bundle]:
        parts = parts[1:]
    return "/".join(parts)


def has_tags(tags: Sequence[str]) -> Column:
    """Whether a page has all the tags."""
    return F.size(F.array_except(F.array(*[F.lit(t) for t in tags]), F.coalesce("tags", F.array().cast("array<string>")))) == 0


def find_pages(p: DataFrame, type: str | None = None, tags: Sequence[str] = (), status: str | None = None, folder: str | None = None, trust: str | None = None) -> DataFrame:
    """Pages that pass every filter given, in no order; p is as pages() gives it, with frontmatter if trust is asked for.

    Untyped and reserved pages never match; a missing status counts as `stable` (see pages()); a folder matches what is below it, by whole
    names. Filters on columns reach the scan; only rows that pass them are read for their trust tier.
    """
    where = F.col("type").isNotNull() & ~name_of(F.col("rel")).isin(*RESERVED)
    if type is not None:
        where = where & (F.col("type") == type)
    if tags:
        where = where & has_tags(tags)
    if status is not None:
        where = where & (F.col("status") == status)
    if folder is not None:
        where = where & F.col("rel").startswith(bundle_path(folder) + "/")
    found = p.where(where)
    if trust is None:
        return found
    return page_facts(found, datetime(1970, 1, 1, tzinfo=UTC)).where(F.col("tier") == trust).drop("tier", "stale", "cited")


def view(p: DataFrame, where: Column, order: Sequence[Column] = (), limit: int | None = None) -> DataFrame:
    """A declared view: pages under a condition, in an order, at most `limit` of them."""
    got = p.where(where)
    got = got.orderBy(*order) if order else got
    return got if limit is None else got.limit(limit)


def in_folder(folder: str) -> Column:
    return F.col("rel").startswith(folder + "/")

"""Following the changes of pages in a stream of snapshots."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_changes(pages: DataFrame, keep_days: float | None = None) -> DataFrame:
    """A stream of rel, change (created, modified, deleted) from a stream of page states: rel, digest (null: gone).

    The digest of each page's last state is kept; a state with the same content is no change, however often it comes, so a page that was touched only gives nothing.
    With keep_days, what was not seen for so long is forgotten and would count as created again; such a stream runs a batch at every trigger, data or not. Within one batch a page's states count in the order of their `at`.
    """

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        out = []
        rows = pd.concat(list(batches)).sort_values("at", kind="stable")
        for digest in rows["digest"]:
            digest = digest if isinstance(digest, str) else None
            if digest != last:
                out.append("created" if last is None else "deleted" if digest is None else "modified")
            last = digest
        if last is None:
            if state.exists:
                state.remove()
        else:
            state.update((last,))
            if keep_days is not None:
                state.setTimeoutDuration(int(keep_days * 86_400_000))
        if out:
            yield pd.DataFrame({"rel": [key[0]] * len(out), "change": out})

    return pages.where(F.col("rel").isNotNull()).select("rel", "digest", "at").groupBy("rel").applyInPandasWithState(follow, "rel string, change string", "digest string", "append", GroupStateTimeout.NoTimeout if keep_days is None else GroupStateTimeout.ProcessingTimeTimeout)


def reuse_digests(listing: DataFrame, known: DataFrame, digest) -> DataFrame:
    """listing (path, mtime, size, content) with its digest: taken from `known` (path, mtime, size, digest) where time and size are the same, computed only for the rest."""
    old = known.select("path", F.col("mtime").alias("__m"), F.col("size").alias("__s"), F.col("digest").alias("__d"))
    same = (F.col("mtime") == F.col("__m")) & (F.col("size") == F.col("__s")) & F.col("__d").isNotNull()
    return listing.join(old, "path", "left").select("path", "mtime", "size", F.when(same, F.col("__d")).otherwise(digest(F.col("content"))).alias("digest"), F.coalesce(same, F.lit(False)).alias("reused"))


def expired(sessions: DataFrame, now, keep_days: float = 7.0) -> DataFrame:
    """Sessions whose last change is longer ago than they are kept."""
    return sessions.where(F.col("changed_at") < F.lit(now) - F.make_dt_interval(F.lit(0), F.lit(int(keep_days * 24)), F.lit(0), F.lit(0)))


def blocking(touched: DataFrame, diagnostics: DataFrame, stale: DataFrame) -> DataFrame:
    """What keeps a session from ending: errors of the pages it touched, and stale indexes of the folders above them: path, code."""
    errors = diagnostics.where(~F.col("code").startswith("W")).join(touched.select(F.col("rel").alias("path")).distinct(), "path", "left_semi")
    from quire.functions.paths import ancestors

    above = touched.select(F.explode(ancestors(F.col("rel"))).alias("folder")).distinct()
    late = stale.select(F.col("folder")).join(above, "folder", "left_semi").select(F.col("folder").alias("path"), F.lit("H040").alias("code"))
    return errors.select("path", "code").unionByName(late).distinct()

"""The health report: coverage, trust, freshness and gaps of the page graph."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.paths import name_of
from quire.operators.catalog import existing, in_scope, linking
from quire.operators.nested import Triple, group_of, record_triples

#: Types whose pages need no sources.
UNSOURCED = ("Source", "Person", "Organization")


def _given(triples: list[Triple], key: str) -> bool:
    """Whether a top-level key has a value other than null, false, 0 or something empty."""
    for path, _, _, kind, value in triples:
        if path == key:
            if kind != "object":
                return float(value) != 0 if kind == "number" else value not in (None, "", "false") if kind == "boolean" else bool(value)
        elif path.startswith((f"{key}.", f"{key}[")):
            return True
    return False


def trust_tier(triples: list[Triple]) -> str:
    """unverified, machine-confirmed or human-reviewed, by who verified the page."""
    if not _given(triples, "verified"):
        return "unverified"
    human = any(kind == "string" and value.startswith("human:") and group_of(path) in ("verified.by", "verified[].by") for path, _, _, kind, value in triples)
    return "human-reviewed" if human else "machine-confirmed"


def is_stale(triples: list[Triple], now: datetime) -> bool:
    """Whether stale_after is over; a time that is no ISO time with an offset never is."""
    value = next((v for path, _, _, kind, v in triples if path == "stale_after" and kind == "string"), None)
    try:
        return value is not None and now >= datetime.fromisoformat(value.replace("Z", "+00:00"))
    except (ValueError, TypeError):
        return False


def page_facts(p: DataFrame, now: datetime) -> DataFrame:
    """The columns of p but frontmatter, and tier, stale and cited, which are read from it. Missing or unreadable frontmatter says nothing."""
    keep = [c for c in p.columns if c != "frontmatter"]
    schema = ", ".join([*[f"`{c}` {p.schema[c].dataType.simpleString()}" for c in keep], "tier string, stale boolean, cited boolean"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_triples = (record_triples(s) or [] for s in batch.column("frontmatter").to_pylist())
            got = [(trust_tier(t), is_stale(t, now), _given(t, "sources")) for t in all_triples]
            own = [pa.array([g[k] for g in got], kind) for k, kind in enumerate((pa.string(), pa.bool_(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *own], names=[*keep, "tier", "stale", "cited"])

    return p.mapInArrow(read, schema)


def health_report(p: DataFrame, body_links: DataFrame, now: datetime | None = None) -> DataFrame:
    """The whole health report as rows (section, item, n), each once, no list cut: type, trust, status, stale, uncited, unused, broken, draft.

    p is as pages() gives it, with frontmatter; body_links as links() with files; now is the time of the report, the present by default. Items of stale,
    uncited, unused and draft are paths, those of broken `source -> target`; n counts pages, of broken links.
    """
    own = p.where(in_scope("all")).select("rel", "type", "status", "frontmatter", in_scope().alias("knowledge"))
    sections = {
        "type": (F.lit(True), "type"),
        "trust": (F.col("knowledge"), "tier"),
        "status": (F.lit(True), "status"),
        "stale": (F.col("stale"), "rel"),
        "uncited": (F.col("knowledge") & ~F.col("type").isin(*UNSOURCED) & ~F.col("cited"), "rel"),
        "draft": (F.col("status") == "draft", "rel"),
    }
    rows = F.array_compact(F.array(*[F.when(when, F.struct(F.lit(s).alias("section"), F.col(item).alias("item"))) for s, (when, item) in sections.items()]))
    pages_rows = page_facts(own, now or datetime.now(UTC)).select(F.explode(rows).alias("r")).select("r.section", "r.item")
    broken = broken_links(p, body_links).select(F.lit("broken").alias("section"), F.concat("src", F.lit(" -> "), "target").alias("item"))
    unused = unused_sources(p, body_links).select(F.lit("unused").alias("section"), F.col("rel").alias("item"))
    return pages_rows.unionByName(broken).unionByName(unused).groupBy("section", "item").agg(F.count(F.lit(1)).alias("n"))


def counting_links(p: DataFrame, body_links: DataFrame) -> DataFrame:
    """The links that count as citations: to an existing page other than their own, from a page whose links count and that is no log."""
    from_page = body_links.where((F.col("src") != F.col("dst")) & (name_of(F.col("src")) != "log.md"))
    return from_page.join(linking(p).withColumnRenamed("rel", "src"), "src", "left_semi")


def inbound_links(p: DataFrame, body_links: DataFrame) -> DataFrame:
    """rel, n_inbound for every page in scope: each link counts, also a repeated one."""
    n = counting_links(p, body_links).groupBy(F.col("dst").alias("rel")).agg(F.count(F.lit(1)).alias("n"))
    return p.where(in_scope("all")).select("rel").distinct().join(n, "rel", "left").select("rel", F.coalesce("n", F.lit(0)).alias("n_inbound"))


def unused_sources(p: DataFrame, body_links: DataFrame) -> DataFrame:
    """Source pages that no counting link reaches: rel."""
    own = p.where(in_scope() & (F.col("type") == "Source")).select("rel").distinct()
    return own.join(counting_links(p, body_links).select(F.col("dst").alias("rel")), "rel", "left_anti")


def broken_links(p: DataFrame, body_links: DataFrame) -> DataFrame:
    """Links of pages whose links count, to files and folders that don't exist: the columns of body_links."""
    alive = body_links.join(linking(p).withColumnRenamed("rel", "src"), "src", "left_semi")
    return alive.join(existing(p), "dst", "left_anti")

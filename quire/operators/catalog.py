"""The page table of a bundle and its references, in the shape every reference operator takes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.paths import ancestors, file_path, folder_of, name_of, page_path, stem_of
from quire.sources import table

#: Top-level folders of personal material, outside the scope `knowledge`.
PERSONAL = ("journal",)
#: Names of generated pages.
RESERVED = ("index.md", "log.md")
#: Types whose pages gather others: they may stand without inbound links.
SYNTHESES = ("Synthesis", "Comparison")


def page_title(title: Column, rel: Column) -> Column:
    """The title with white space collapsed; without one, the file's stem in sentence case."""
    plain = F.trim(F.regexp_replace(title, r"\s+", " "))
    stem = F.replace(stem_of(rel), F.lit("-"), F.lit(" "))
    own = F.concat(F.upper(F.substring(stem, 1, 1)), F.lower(F.substring(stem, 2, 1 << 30)))
    return F.when(F.coalesce(plain, F.lit("")) != "", plain).otherwise(own)


#: Columns of bundle_page that pages() can give, in order.
_COLUMNS = {"rel": "string", "type": "string", "title": "string", "description": "string", "tags": "array<string>", "aliases": "array<string>", "status": "string", "resource": "string", "added_at": "timestamp_ntz", "frontmatter": "string"}
_LIBRARY = ("rel", "type", "title", "resource", "added_at")


def pages(spark: SparkSession, d: str, frontmatter: bool = False, only: Sequence[str] | None = None) -> DataFrame:
    """Pages that exist now: rel, folder, type, title, description, tags, aliases, status, resource, added_at, and on demand frontmatter; with `only`, rel, folder and these of them.

    Pages delivered twice count once; type is NULL if blank; description '' if missing; status `stable` if missing. Repeated deliveries fall
    together as equal rows of the columns asked for, so filters on them reach the scan before that shuffle, and no others are read.
    """
    names = [c for c in _COLUMNS if c == "rel" or (c in only if only is not None else c != "frontmatter" or frontmatter)]
    own = table(spark, d, "bundle_page").where(F.col("deleted_at").isNull()).select("page_id", *names).distinct().select(*names)
    library = table(spark, d, "library_page").where(F.col("deleted_at").isNull()).select(*[F.col(c) if c in _LIBRARY else F.lit(None).cast(_COLUMNS[c]).alias(c) for c in names])
    p = own.unionByName(library)
    kind = F.trim("type")
    shown = {
        "type": lambda: F.when(kind != "", kind),
        "title": lambda: page_title(F.col("title"), F.col("rel")),
        "description": lambda: F.coalesce(F.trim(F.regexp_replace("description", r"\s+", " ")), F.lit("")),
        "status": lambda: F.coalesce("status", F.lit("stable")),
    }
    return p.select("rel", folder_of(F.col("rel")).alias("folder"), *[shown.get(c, lambda c=c: F.col(c))().alias(c) for c in names if c != "rel"])


def is_tooling(folder: Column) -> Column:
    """Whether some folder of the path begins with '_' or '.'."""
    return F.concat(F.lit("/"), folder).rlike(r"/[_.]")


def in_scope(scope: str = "knowledge") -> Column:
    """Predicate over pages(): typed, not generated, no template, not below a tooling folder; `knowledge` also leaves out personal folders."""
    ok = F.col("type").isNotNull() & (F.col("type") != "Template") & ~name_of(F.col("rel")).isin(*RESERVED) & ~is_tooling(F.col("folder"))
    return ok & ~F.substring_index("rel", "/", 1).isin(*PERSONAL) if scope == "knowledge" else ok


def linking(p: DataFrame) -> DataFrame:
    """The pages whose links count: no generated indexes, no templates, nothing below a tooling folder: rel."""
    return p.where((name_of(F.col("rel")) != "index.md") & ~is_tooling(F.col("folder")) & (F.coalesce("type", F.lit("")) != "Template")).select("rel").distinct()


def links(spark: SparkSession, d: str, files: bool = False) -> DataFrame:
    """Body links to pages, once per link id: link_id, src, dst (bundle path), target (as written). With files: links and images to any file or folder."""
    dst = file_path if files else page_path
    t = table(spark, d, "page_link").select("link_id", F.col("rel").alias("src"), dst(F.col("target"), F.col("rel")).alias("dst"), "target")
    return t.where(F.col("dst").isNotNull()).distinct()


def relations(spark: SparkSession, d: str) -> DataFrame:
    """Relations to pages, once per relation id: relation_id, src, key, dst."""
    t = table(spark, d, "page_relation").select("relation_id", F.col("rel").alias("src"), "key", page_path(F.col("target"), F.col("rel")).alias("dst"))
    return t.where(F.col("dst").isNotNull()).distinct()


def existing(p: DataFrame) -> DataFrame:
    """All paths that exist, files and folders, each once: dst."""
    return p.select(F.explode(F.concat(ancestors(F.col("rel")), F.array("rel"))).alias("dst")).distinct()


def folder_closure(rels: DataFrame) -> DataFrame:
    """All ancestor folders of the paths in column rel, the root as ''."""
    return rels.select(F.explode(ancestors(F.col("rel"))).alias("folder")).distinct()


def edges(spark: SparkSession, d: str, scope: str = "knowledge") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The link graph: (nodes: rel and type, edges: src and dst, citations: src and dst).

    Body links and relations between pages in scope, each pair once, no loops. Source pages are no nodes; references to
    them are the citations.
    """
    known = pages(spark, d, only=("type",)).where(in_scope(scope)).select("rel", "type").distinct()
    refs = links(spark, d).select("src", "dst").unionByName(relations(spark, d).select("src", "dst")).where(F.col("src") != F.col("dst")).distinct()
    own = refs.join(known.where(F.col("type") != "Source").select(F.col("rel").alias("src")), "src", "left_semi")
    typed = own.join(known.select(F.col("rel").alias("dst"), F.col("type").alias("dst_type")), "dst")
    nodes = known.where(F.col("type") != "Source")
    return nodes, typed.where(F.col("dst_type") != "Source").select("src", "dst"), typed.where(F.col("dst_type") == "Source").select("src", "dst")

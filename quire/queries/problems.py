"""Queries of the general problems (1, 3, 5) over the bundle tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.nested import group_table, list_table, nested_objects, nested_rows, nested_triples, one_version
from quire.operators.orphans import dangling_by_period, dangling_page_references
from quire.operators.timestamps import normalize_times
from quire.plans.skew import lookup
from quire.sources import table

#: Keys of the page frontmatter whose values are lists, a lone object counting as a list of one.
LIST_KEYS = ("verified", "sources", "rounds", "findings")
#: Fields of the frontmatter that hold a written time, without list indices.
TIME_FIELDS = ("generated.at", "stale_after", "verified[].at", "sources[].last_modified")


def _page_rows(spark: SparkSession, d: str) -> DataFrame:
    return nested_rows(table(spark, d, "bundle_page"), "page_id", "frontmatter", LIST_KEYS, keep=("ingested_at",))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return nested_objects(_page_rows(spark, d)).withColumnRenamed("record", "page_id")


#: The tables of the frontmatter: group, and the keys that have columns of their own.
PAGE_TABLES = {
    "p1_root_table": ("", ("type", "title", "description", "status", "resource", "stale_after")),
    "p1_generated_table": ("generated", ("by", "at")),
    "p1_verified_table": ("verified[]", ("by", "at")),
    "p1_sources_table": ("sources[]", ("id", "resource", "title", "author", "usage_count", "last_modified")),
    "p1_review_table": ("review", ()),
    "p1_rounds_table": ("review.rounds[]", ()),
    "p1_findings_table": ("review.rounds[].findings[]", ("code", "line")),
}


def _page_table(name: str, group: str, columns: tuple[str, ...]):
    def run(spark: SparkSession, d: str) -> DataFrame:
        got = group_table(one_version(_page_rows(spark, d), "ingested_at"), group, columns)
        return got.withColumnRenamed("record", "page_id").withColumn("other", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("other"))), {"ignoreNullFields": "false"}))

    run.__name__ = name
    return run


def p1_all_tables(spark: SparkSession, d: str) -> DataFrame:
    """How many rows each table of the frontmatter has, lists of scalars included."""
    rows = one_version(_page_rows(spark, d), "ingested_at")
    return rows.groupBy("grp", "is_object").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("record").alias("n_records"))


def p1_list_items(spark: SparkSession, d: str) -> DataFrame:
    """The elements of all lists of scalars."""
    return list_table(one_version(_page_rows(spark, d), "ingested_at")).withColumnRenamed("record", "page_id")


def _reference_tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {n: table(spark, d, n) for n in ("page_link", "page_relation", "ref_def")}


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return dangling_page_references(_reference_tables(spark, d), [table(spark, d, "bundle_page"), table(spark, d, "library_page")])


def p3_by_period(spark: SparkSession, d: str) -> DataFrame:
    return dangling_by_period(p3_found(spark, d))


def _times(spark: SparkSession, d: str, stamp: str | None = None) -> DataFrame:
    mapping = table(spark, d, "import_mapping").where(F.col("vault").isNotNull())
    mapping = mapping.select("vault", "zone", "date_order", F.col("timestamp").alias("prop")).dropDuplicates(["vault"])
    leaves = nested_triples(table(spark, d, "bundle_page"), "page_id", "frontmatter", LIST_KEYS, kinds=("string", "number"), groups=TIME_FIELDS, keep=("vault",))
    pages = leaves.select(F.lit("page").alias("holder"), F.col("record").alias("holder_id"), F.col("path").alias("field"), "vault", "value")
    notes = lookup(table(spark, d, "source_note"), mapping, ["vault"], "inner").where(F.col("prop").isNotNull())
    notes = notes.select(F.lit("note").alias("holder"), F.col("note_id").alias("holder_id"), F.lit("props").alias("field"), "vault", F.element_at("props", F.col("prop")).alias("value"))
    both = lookup(pages.unionByName(notes).where(F.col("value").isNotNull()), mapping.drop("prop"), ["vault"])
    return normalize_times(both, "value", "zone", "date_order", ["holder", "holder_id", "field"], stamp).distinct()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _times(spark, d)


def p5_stamped(spark: SparkSession, d: str) -> DataFrame:
    """The instants with the release of the zone data they come from."""
    return _times(spark, d, "zone_release")


_TABLES = {n: _page_table(n, g, c) for n, (g, c) in PAGE_TABLES.items()}
QUERIES = {f.__name__: f for f in (p1_found, p1_all_tables, p1_list_items, p3_found, p3_by_period, p5_found, p5_stamped)} | _TABLES

# every value of every record, read level by level: r(page_id, owner, path, u), u with JSON in strings unwrapped
_UNWRAP = "case when json_type({v}) = 'VARCHAR' and json_valid({v}->>'$') and json_type(({v}->>'$')::json) in ('OBJECT', 'ARRAY') then ({v}->>'$')::json else {v} end"
_LONE = "case when json_type({u}) = 'OBJECT' and {k} in ('verified', 'sources', 'rounds', 'findings') then '[0]' else '' end"
_P1 = f"""with recursive doc as (select distinct page_id, frontmatter::json as j from bundle_page where case when json_valid(frontmatter) then json_type(frontmatter) = 'OBJECT' else false end),
r(page_id, owner, path, u) as (
  select page_id, '', '', j from doc
  union all
  select page_id, owner, case t when 'ARRAY' then path || '[' || key || ']' else (case path when '' then '' else path || '.' end) || key || {_LONE.format(u="v", k="key")} end, v
  from (select page_id, case json_type(r.u) when 'OBJECT' then r.path else r.owner end as owner, r.path, json_type(r.u) as t, e.key, {_UNWRAP.format(v="e.value")} as v
    from r, json_each(case when json_type(r.u) in ('OBJECT', 'ARRAY') then r.u else '[]'::json end) e))
"""
SQL: dict[str, str] = {
    "p1_found": _P1 + "select distinct page_id, owner as parent_path, path as node_path from r where json_type(u) = 'OBJECT' and path <> ''",
    "p1_list_items": _P1 + "select distinct page_id, regexp_replace(path, '\\[[0-9]+\\]', '[]', 'g') as grp, owner as parent_path, path, regexp_extract(path, '\\[([0-9]+)\\]$', 1)::int as ordinal, case when json_type(u) <> 'NULL' then u->>'$' end as value from r where json_type(u) not in ('OBJECT', 'ARRAY') and ends_with(path, ']')",
    "p1_all_tables": _P1 + "select regexp_replace(path, '\\[[0-9]+\\]', '[]', 'g') as grp, json_type(u) = 'OBJECT' as is_object, count(distinct page_id || '/' || path) as n_rows, count(distinct page_id) as n_records from r where json_type(u) = 'OBJECT' or (json_type(u) <> 'ARRAY' and ends_with(path, ']')) group by 1, 2",
    "p1_generated_table": _P1 + "select distinct page_id, path as node_path, owner as parent_path, null::int as ordinal, u->>'by' as \"by\", u->>'at' as \"at\", '{}' as other from r where path = 'generated' and json_type(u) = 'OBJECT'",
}

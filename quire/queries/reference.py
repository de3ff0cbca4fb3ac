"""Queries of the reference operators over the bundle tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from datetime import UTC, datetime

from quire.functions.paths import ancestors, file_path, folder_of, fragment_of, encode_path, is_internal, name_of, page_path, percent_decode, stem_of, without_fragment
from quire.functions.strings import acronym, casefold, fold, fold_text, is_kebab, jaccard, slug, spell_symbols, tokens
from quire.operators import graph as G
from quire.operators.catalog import SYNTHESES, edges, existing, folder_closure, in_scope, is_tooling, links, pages, relations
from quire.operators.find import find_pages, has_tags, in_folder, view
from quire.operators.nested import nested_rows
from quire.operators.report import broken_links, health_report, inbound_links, page_facts, unused_sources
from quire.queries.registry import EDGES_SQL, FILES_SQL, FOLDER_SQL, GRAPH_SQL, LINKS_SQL, P_SQL, PAGE_SQL, query, sql_file, sql_path
from quire.sources import table

#: The moment at which reports are made.
AS_OF = datetime(2026, 1, 1, tzinfo=UTC)

# --- scans, filters --------------------------------------------------------------------------------------------------


@query(P_SQL + "select folder from (select unnest(list_transform(range(0, len(string_split(rel, '/'))), lambda n: array_to_string(string_split(rel, '/')[1:n], '/'))) as folder from page) group by 1")
def src_03_dirs(spark, d):
    return folder_closure(pages(spark, d, only=("type",)))


_FM_SQL = """
fm as (select distinct rel, frontmatter::json as j from bundle_page where deleted_at is null and case when json_valid(frontmatter) then json_type(frontmatter::json) = 'OBJECT' else false end),
ver0 as (select rel, j->'verified' as v from fm),
ver as (select rel, case when json_type(v) = 'VARCHAR' and json_valid(v->>'$') then (v->>'$')::json else v end as v from ver0),
given as (select rel, v, v is not null and json_type(v) not in ('NULL') and v::varchar not in ('[]', '{}', '""', 'false', '0') as given,
  case json_type(v) when 'OBJECT' then [v->>'by'] when 'ARRAY' then (v->>'$[*].by') else [] end as bys from ver),
tier as (select rel, case when not given then 'unverified' when len(list_filter(bys, lambda b: starts_with(b, 'human:'))) > 0 then 'human-reviewed' else 'machine-confirmed' end as tier from given),
trust as (select rel, type, coalesce(tier, 'unverified') as tier from (select distinct rel, type from scoped) left join tier using (rel))
"""


@query(P_SQL + "select rel, type, title, status from page where type = 'Concept' and list_has_all(coalesce(tags, []), ['network']) and status = 'stable' and starts_with(rel, 'systems/')")
def flt_01_find(spark, d):
    """Conjunction of filters: type, all of the tags, status with its default, folder."""
    return find_pages(pages(spark, d), "Concept", ["network"], "stable", "systems").select("rel", "type", "title", "status")


@query(P_SQL + f", {_FM_SQL} select distinct rel, p.type, title, status from page p join trust t using (rel) where p.type = 'Concept' and status = 'stable' and starts_with(rel, 'systems/') and tier = 'machine-confirmed' and regexp_extract(rel, '([^/]*)$', 1) not in ('index.md', 'log.md')")
def flt_01_find_trust(spark, d):
    """Filters on columns, and on the trust tier of what passes them."""
    found = find_pages(pages(spark, d, frontmatter=True), "Concept", (), "stable", "systems", "machine-confirmed")
    return found.where(in_scope("all")).select("rel", "type", "title", "status").distinct()


@query(P_SQL + "select rel, list_sort(tags) as tags from page where list_has_all(coalesce(tags, []), ['survey', 'network'])")
def flt_02_tags_all(spark, d):
    return pages(spark, d, only=("tags",)).where(has_tags(["survey", "network"])).select("rel", F.array_sort("tags").alias("tags"))


@query(P_SQL + f", {_FM_SQL} select rel, tier from trust")
def flt_05_trust(spark, d):
    """The trust tier of each page."""
    return page_facts(pages(spark, d, frontmatter=True).where(in_scope("all")), AS_OF).select("rel", "tier").distinct()


_STALE_SQL = r"""stale0 as (select rel, replace(regexp_replace(j->>'stale_after', '^([0-9]{4})([0-9]{2})([0-9]{2})T([0-9]{2})([0-9]{2})([0-9]{2})', '\1-\2-\3T\4:\5:\6'), ',', '.') as due from fm where json_type(j->'stale_after') = 'VARCHAR'),
stale as (select * from stale0 where regexp_matches(due, '^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?(Z|[+-][0-9]{2}:?[0-9]{2})$'))"""


@query(P_SQL + f", {_FM_SQL}, {_STALE_SQL} select distinct rel from scoped join stale using (rel) where try_cast(due as timestamptz) <= timestamptz '2026-01-01 00:00:00+00'")
def flt_06_stale(spark, d):
    """Pages whose stale_after, a time with an offset, is over."""
    return page_facts(pages(spark, d, frontmatter=True).where(in_scope("all")), AS_OF).where("stale").select("rel").distinct()


@query(P_SQL + "select rel, type, title, status from page where type is not null and regexp_extract(rel, '([^/]*)$', 1) not in ('index.md', 'log.md') and not starts_with(rel, '_templates/') and not starts_with(rel, 'journal/') and not starts_with(rel, 'projects/') order by added_at desc, rel limit 50")
def flt_13_recent_view(spark, d):
    """The declared view of the pages changed last."""
    outside = ~(in_folder("_templates") | in_folder("journal") | in_folder("projects"))
    where = F.col("type").isNotNull() & ~name_of(F.col("rel")).isin("index.md", "log.md") & outside
    return view(pages(spark, d), where, [F.desc("added_at"), F.asc("rel")], 50).select("rel", "type", "title", "status")


@query(P_SQL + f", {_FM_SQL} select rel, title, type, status, folder from page left join given using (rel) where type is not null and type <> 'Template' and regexp_extract(rel, '([^/]*)$', 1) not in ('index.md', 'log.md') and not starts_with(rel, 'journal/') and not coalesce(given, false)")
def flt_13_review_view(spark, d):
    """The declared view of the pages nobody has verified."""
    where = F.col("type").isNotNull() & (F.col("type") != "Template") & ~name_of(F.col("rel")).isin("index.md", "log.md") & ~in_folder("journal")
    return page_facts(view(pages(spark, d, frontmatter=True), where), AS_OF).where("tier = 'unverified'").select("rel", "title", "type", "status", "folder")


@query(P_SQL + "select rel from page where status = 'stable'")
def flt_03_status_default(spark, d):
    return pages(spark, d, only=("status",)).where(F.col("status") == "stable").select("rel")


@query(P_SQL + "select rel, folder from page where starts_with(rel, 'data/')")
def flt_04_folder_prefix(spark, d):
    return pages(spark, d, only=("type",)).where(F.col("rel").startswith("data/")).select("rel", "folder")


@query(P_SQL + "select rel, type from known")
def flt_07_scope(spark, d):
    return pages(spark, d, only=("type",)).where(in_scope()).select("rel", "type").distinct()


@query(P_SQL + "select rel, regexp_matches('/' || folder, '/[_.]') as tooling from page")
def flt_08_tooling(spark, d):
    return pages(spark, d, only=("type",)).select("rel", is_tooling(F.col("folder")).alias("tooling"))


@query("select distinct rel, regexp_matches(regexp_replace(regexp_extract(rel, '([^/]*)$', 1), '\\.[^.]*$', ''), '^[a-z0-9]+(-[a-z0-9]+)*$') as kebab from bundle_page")
def flt_12_kebab(spark, d):
    return table(spark, d, "bundle_page").select("rel", is_kebab(stem_of(F.col("rel"))).alias("kebab")).distinct()


# --- joins -----------------------------------------------------------------------------------------------------------


@query(f"with {PAGE_SQL}, {LINKS_SQL} select l.link_id, l.src, l.dst, k.type as dst_type from link l join (select distinct rel, type from page) k on k.rel = l.dst")
def join_01_resolve(spark, d):
    k = pages(spark, d, only=("type",)).select(F.col("rel").alias("dst"), F.col("type").alias("dst_type")).distinct()
    return links(spark, d).join(k, "dst").select("link_id", "src", "dst", "dst_type")


@query(GRAPH_SQL + f"select rel from node where rel not in (select dst from edge) and type not in {SYNTHESES}")
def join_03_orphans(spark, d):
    nodes, e, _ = edges(spark, d)
    return G.orphans(G.degrees(nodes, e))


@query(GRAPH_SQL + "select rel from node where rel not in (select src from edge)")
def join_03_dead_ends(spark, d):
    nodes, e, _ = edges(spark, d)
    return nodes.join(e.select(F.col("src").alias("rel")), "rel", "left_anti").select("rel")


SORTS = (("journal", "date-desc"), ("systems", "title"), ("systems/network", "name"))


@query(P_SQL + ", sorts(f, s) as (values " + ", ".join(f"('{f}', '{s}')" for f, s in SORTS) + ") select folder, (select s from sorts where folder = f or starts_with(folder, f || '/') order by length(f) desc limit 1) as sort from (select distinct folder from page)")
def join_11_inherited_sort(spark, d):
    """Each folder's sort order, from itself or its nearest ancestor that has one."""
    own = pages(spark, d, only=("type",)).select("folder").distinct()
    sorts = spark.createDataFrame(list(SORTS), "up string, s string")
    parts = F.split("folder", "/")
    ups = own.select("folder", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("depth", "up"))
    got = ups.join(F.broadcast(sorts), "up").groupBy("folder").agg(F.max_by("s", "depth").alias("sort"))
    return own.join(got, "folder", "left")


_SNAP = "select rel, max(md5(coalesce(frontmatter, ''))) as digest from bundle_page where added_at <= timestamp '{t}' and (deleted_at is null or deleted_at > timestamp '{t}') group by rel"
T0, T1 = "2024-01-01 00:00:00", "2025-01-01 00:00:00"


def _snapshot(spark, d, t):
    alive = (F.col("added_at") <= F.lit(t).cast("timestamp_ntz")) & (F.col("deleted_at").isNull() | (F.col("deleted_at") > F.lit(t).cast("timestamp_ntz")))
    return table(spark, d, "bundle_page").where(alive).groupBy("rel").agg(F.max(F.md5(F.coalesce("frontmatter", F.lit("")).cast("binary"))).alias("digest"))


def snapshot_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """rel, change (created, modified, deleted) between two snapshots of (rel, digest); unchanged content is no change."""
    both = before.select("rel", F.col("digest").alias("d0")).join(after.select("rel", F.col("digest").alias("d1")), "rel", "full_outer").where(~F.col("d0").eqNullSafe(F.col("d1")))
    return both.select("rel", F.when(F.col("d0").isNull(), "created").when(F.col("d1").isNull(), "deleted").otherwise("modified").alias("change"))


@query(f"with a as ({_SNAP.format(t=T0)}), b as ({_SNAP.format(t=T1)}) select coalesce(a.rel, b.rel) as rel, case when a.rel is null then 'created' when b.rel is null then 'deleted' else 'modified' end as change from a full join b on a.rel = b.rel where a.digest is distinct from b.digest")
def join_14_snapshot_diff(spark, d):
    return snapshot_changes(_snapshot(spark, d, T0), _snapshot(spark, d, T1))


# --- aggregates ------------------------------------------------------------------------------------------------------


@query(P_SQL + "select type, count(*) as n_pages, min(rel) as first_rel from scoped group by type")
def agg_01_pages_by_type(spark, d):
    return pages(spark, d, only=("type",)).where(in_scope("all")).groupBy("type").agg(F.count(F.lit(1)).alias("n_pages"), F.min("rel").alias("first_rel"))


@query(P_SQL + "select status, count(*) as n_pages from scoped group by status")
def agg_03_status_counts(spark, d):
    return pages(spark, d, only=("type", "status")).where(in_scope("all")).groupBy("status").agg(F.count(F.lit(1)).alias("n_pages"))


@query(GRAPH_SQL + "select rel, type, (select count(*) from edge where dst = rel) as n_in, (select count(*) from edge where src = rel) as n_out from node")
def agg_05_degrees(spark, d):
    nodes, e, _ = edges(spark, d)
    return G.degrees(nodes, e)


@query(GRAPH_SQL + "select dst as rel, count(distinct src) as n_citing from typed where dst_type = 'Source' group by dst")
def agg_07_cited_by(spark, d):
    _, _, cites = edges(spark, d)
    return cites.groupBy(F.col("dst").alias("rel")).agg(F.count_distinct("src").alias("n_citing"))


@query(GRAPH_SQL + ", sets as (select src from edge group by src having count(*) <= 60), few as (select e.* from edge e join sets using (src)) select x.dst as a, y.dst as b, count(*) as n from few x join few y on x.src = y.src and x.dst < y.dst group by 1, 2 having count(*) >= 3")
def agg_10_colinks(spark, d):
    _, e, _ = edges(spark, d)
    return G.colinks(e)


@query("select rel, max(ingested_at) as last_at, arg_max(page_id, (ingested_at, page_id)) as page_id from bundle_page group by rel")
def agg_14_last_delivery(spark, d):
    return table(spark, d, "bundle_page").groupBy("rel").agg(F.max("ingested_at").alias("last_at"), F.max(F.struct("ingested_at", "page_id")).alias("m")).select("rel", "last_at", "m.page_id")


# --- windows, top, sets ----------------------------------------------------------------------------------------------


@query(P_SQL + "select type, rel from (select type, rel, row_number() over (partition by type order by added_at, rel) as n from scoped) where n <= 200")
def top_08_sections_cut(spark, d):
    """A report lists at most 200 items of a section."""
    w = Window.partitionBy("type").orderBy("added_at", "rel")
    return pages(spark, d, only=("type", "added_at")).where(in_scope("all")).withColumn("n", F.row_number().over(w)).where(F.col("n") <= 200).select("type", "rel")


@query(f"with {LINKS_SQL} select src, dst from link union select src, dst from relation")
def set_02_reference_union(spark, d):
    return links(spark, d).select("src", "dst").unionByName(relations(spark, d).select("src", "dst")).distinct()


# --- strings ---------------------------------------------------------------------------------------------------------


@query(f"select distinct link_id, {sql_path('target', 'rel')} as path from page_link")
def str_07_resolve(spark, d):
    return table(spark, d, "page_link").select("link_id", page_path(F.col("target"), F.col("rel")).alias("path")).distinct()


@query("select distinct link_id, url_decode(split_part(target, '#', 1)) as path, regexp_extract(target, '(#.*)$', 1) as fragment from page_link")
def str_09_fragment(spark, d):
    """Path and fragment of a target, decoded (STR-08, STR-09)."""
    return table(spark, d, "page_link").select("link_id", percent_decode(without_fragment(F.col("target"))).alias("path"), fragment_of(F.col("target")).alias("fragment")).distinct()


@query(P_SQL + "select rel, replace(replace(replace(coalesce(title, ''), '\\', '\\\\'), '[', '\\['), ']', '\\]') as entry from (select distinct rel, title from page where title is not null)")
def str_20_escape(spark, d):
    t = pages(spark, d, only=("title",)).select("rel", "title").distinct()
    e = F.replace(F.replace(F.replace("title", F.lit("\\"), F.lit("\\\\")), F.lit("["), F.lit("\\[")), F.lit("]"), F.lit("\\]"))
    return t.select("rel", e.alias("entry"))


# --- graph -----------------------------------------------------------------------------------------------------------


@query(GRAPH_SQL + "select src, dst from edge")
def grf_01_edges(spark, d):
    return edges(spark, d)[1]


@query(GRAPH_SQL + ", tag as (select rel, unnest(tags) as tag from scoped where rel in (select rel from node)), size as (select tag, count(*) as n_pages from tag group by tag), pair as (select distinct least(src, dst) as a, greatest(src, dst) as b from edge), l as (select x.tag, count(*) as linked from pair join tag x on x.rel = a join tag y on y.rel = b and y.tag = x.tag group by 1), r as (select tag, n_pages, coalesce(linked, 0) / (n_pages * (n_pages - 1) / 2) as density from size left join l using (tag) where n_pages >= 5) select tag, n_pages, round(density, 3) as density from r where density < 0.15")
def grf_04_tag_cohesion(spark, d):
    nodes, e, _ = edges(spark, d)
    tags = pages(spark, d, only=("type", "tags")).where(in_scope("all")).join(nodes.select("rel"), "rel", "left_semi").select("rel", F.explode("tags").alias("tag"))
    return G.tag_cohesion(tags, e)


@query(GRAPH_SQL + f", gather as (select rel from node where type in {SYNTHESES}), sets as (select src from edge group by src having count(*) <= 60), few as (select e.* from edge e join sets using (src)), pair as (select x.dst as a, y.dst as b, count(*) as n from few x join few y on x.src = y.src and x.dst < y.dst group by 1, 2 having count(*) >= 3) select a, b, n from pair p where a not in (select rel from gather) and b not in (select rel from gather) and not exists (select 1 from edge x join edge y on x.src = y.src where x.src in (select rel from gather) and x.dst = p.a and y.dst = p.b)")
def grf_05_colink_gaps(spark, d):
    nodes, e, _ = edges(spark, d)
    return G.colink_gaps(nodes, e)


@query(GRAPH_SQL + "select rel, n_in from (select rel, (select count(*) from edge where dst = rel) as n_in, (select count(*) from edge where src = rel) as n_out from node) where n_out = 0 and n_in >= 3")
def grf_06_sinks(spark, d):
    nodes, e, _ = edges(spark, d)
    return G.sinks(G.degrees(nodes, e))


# --- search, names, report, checks -----------------------------------------------------------------------------------


# --- links to files and folders --------------------------------------------------------------------------------------


@query(f"with {PAGE_SQL}, {FILES_SQL} select link_id, dst from flink where dst in (select dst from existing)")
def flt_09_exists(spark, d):
    """Links whose target exists, as a file or as a folder."""
    return links(spark, d, files=True).join(existing(pages(spark, d, only=("type",))), "dst", "left_semi").select("link_id", "dst")


@query(f"with {PAGE_SQL}, {FILES_SQL} select link_id, src, dst from flink where dst not in (select dst from existing)")
def join_02_broken_links(spark, d):
    """Links, images among them, to files and folders that don't exist."""
    return links(spark, d, files=True).join(existing(pages(spark, d, only=("type",))), "dst", "left_anti").select("link_id", "src", "dst")


@query(f"with {PAGE_SQL}, {FILES_SQL} select rel from known where type = 'Source' and rel not in (select dst from counting)")
def join_04_unused_sources(spark, d):
    return unused_sources(pages(spark, d, only=("type",)), links(spark, d, files=True))


_RELATIONS_SQL = f"""frel as (select distinct relation_id, rel as src, key, target, {sql_file("target", "rel")} as dst from page_relation
  where not regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*:') and not starts_with(target, '//') and not starts_with(target, '#') and split_part(target, '#', 1) <> '')"""


def internal_relations(spark, d):
    """Relations to something in the bundle, dst null where they point outside."""
    t = table(spark, d, "page_relation").where(is_internal(F.col("target")) & (without_fragment(F.col("target")) != ""))
    return t.select("relation_id", F.col("rel").alias("src"), "key", "target", file_path(F.col("target"), F.col("rel")).alias("dst")).distinct()


@query(f"with {PAGE_SQL}, {FILES_SQL}, {_RELATIONS_SQL} select relation_id, src, key, target from frel r where dst is null or not exists (select 1 from flink l where l.src = r.src and l.dst = r.dst)")
def join_05_relation_not_linked(spark, d):
    """Relations that their page's body doesn't link, or that lead nowhere."""
    return internal_relations(spark, d).join(links(spark, d, files=True).select("src", "dst"), ["src", "dst"], "left_anti").select("relation_id", "src", "key", "target")


@query(f"with {PAGE_SQL}, {FILES_SQL} select rel, (select count(*) from counting c where c.dst = s.rel) as n_inbound from (select distinct rel from scoped) s")
def agg_04_inbound_links(spark, d):
    """Every body link of a page whose links count, also a repeated one; not a page's links to itself."""
    return inbound_links(pages(spark, d, only=("type",)), links(spark, d, files=True))


@query(GRAPH_SQL + f", {_RELATIONS_SQL} select key, count(*) as n_relations from frel where src in (select rel from node) and dst in (select rel from node) group by key")
def agg_06_relations_by_key(spark, d):
    """Relations between two pages of the graph by key; repeated ones and those to the page itself count."""
    nodes, _, _ = edges(spark, d)
    both = internal_relations(spark, d).join(nodes.select(F.col("rel").alias("src")), "src", "left_semi").join(nodes.select(F.col("rel").alias("dst")), "dst", "left_semi")
    return both.groupBy("key").agg(F.count(F.lit(1)).alias("n_relations"))


@query(P_SQL + f", {_FM_SQL} select tier, count(*) as n_pages from trust where split_part(rel, '/', 1) <> 'journal' group by tier")
def agg_02_trust_tiers(spark, d):
    p = pages(spark, d, frontmatter=True).where(in_scope()).dropDuplicates(["rel"])
    return page_facts(p, AS_OF).groupBy("tier").agg(F.count(F.lit(1)).alias("n_pages"))


@query(
    f"with {PAGE_SQL}, {FILES_SQL} "
    + """select 'type' as section, type as item, count(*) as n from scoped group by type
  union all select 'status', status, count(*) from scoped group by status
  union all select 'draft', rel, count(*) from scoped where status = 'draft' group by rel
  union all select 'unused', rel, count(*) from known where type = 'Source' and rel not in (select dst from counting) group by rel
  union all select 'broken', src || ' -> ' || target, count(*) from flink where dst not in (select dst from existing) and src in (select rel from linking) group by 2"""
)
def rpt_01_report(spark, d):
    """The sections of the health report that need no frontmatter, as rows: section, item, n."""
    return health_report(pages(spark, d, frontmatter=True), links(spark, d, files=True), AS_OF).where(F.col("section").isin("type", "status", "draft", "unused", "broken"))


@query(
    f"with {PAGE_SQL}, {FILES_SQL}, {_FM_SQL}, {_STALE_SQL}, "
    + """src0 as (select rel, j->'sources' as v from fm),
  cited as (select rel from src0 where v is not null and json_type(v) <> 'NULL' and v::varchar not in ('[]', '{}', '""', 'false', '0', '"[]"', '"{}"'))
  select 'type' as section, type as item, count(*) as n from scoped group by type
  union all select 'trust', tier, count(*) from trust where split_part(rel, '/', 1) <> 'journal' group by tier
  union all select 'status', status, count(*) from scoped group by status
  union all select 'stale', rel, count(distinct rel) from scoped join stale using (rel) where try_cast(due as timestamptz) <= timestamptz '2026-01-01 00:00:00+00' group by rel
  union all select 'uncited', rel, count(*) from known where type not in ('Source', 'Person', 'Organization') and rel not in (select rel from cited) group by rel
  union all select 'draft', rel, count(*) from scoped where status = 'draft' group by rel
  union all select 'unused', rel, count(*) from known where type = 'Source' and rel not in (select dst from counting) group by rel
  union all select 'broken', src || ' -> ' || target, count(*) from flink where dst not in (select dst from existing) and src in (select rel from linking) group by 2"""
)
def rpt_01_health(spark, d):
    """The whole health report as rows: section, item, n."""
    return health_report(pages(spark, d, frontmatter=True), links(spark, d, files=True), AS_OF)


# --- names -----------------------------------------------------------------------------------------------------------

def _fold_sql(column: str) -> str:
    """Case folding and the loss of accents as SQL, by rule from the same definition as functions.strings.fold: characters that fold to several are replaced, others translated."""
    kinds = [(c, fold_text(c)) for c in map(chr, range(0x80, 0x3100)) if fold_text(c) != c]
    out = column
    for c, f in kinds:
        if len(f) > 1 and ord(c) < 0x0F00:
            out = f"replace({out}, '{c}', '{f}')"
    one = [(c, f) for c, f in kinds if len(f) == 1 and f not in "'\\"]
    gone = "".join(c for c, f in kinds if not f)
    return f"translate(lower({out}), '{''.join(c for c, _ in one)}{gone}', '{''.join(f for _, f in one)}')"


_FOLDED = _fold_sql("{c}")
_SPELLED = "regexp_replace(regexp_replace({c}, '(\\w)\\+\\+', '\\1pp', 'g'), '(\\w)#', '\\1sharp', 'g')"
_STOP = "('a','an','and','at','by','for','from','in','into','of','on','or','the','to','vs','with','without')"
TOKENS_SQL = f"[case when length(t) > 3 and ends_with(t, 's') and not ends_with(t, 'ss') then left(t, length(t) - 1) else t end for t in regexp_split_to_array(replace({_FOLDED.format(c=_SPELLED)}, '_', ' '), '[^\\p{{{{L}}}}\\p{{{{M}}}}\\p{{{{Nd}}}}\\p{{{{Nl}}}}\\p{{{{Pc}}}}]+') if t <> '' and t not in {_STOP}]"


@query(P_SQL + f"select distinct title, {_FOLDED.format(c='title')} as folded from page")
def str_01_fold(spark, d):
    """Titles without case and accents."""
    return pages(spark, d, only=("title",)).select("title", fold(F.col("title")).alias("folded")).distinct()


@query(P_SQL + f"select distinct title, {_SPELLED.format(c='title')} as spelled from page")
def str_02_symbols(spark, d):
    return pages(spark, d, only=("title",)).select("title", spell_symbols(F.col("title")).alias("spelled")).distinct()


@query(P_SQL + f"select distinct title, trim(regexp_replace({_FOLDED.format(c=_SPELLED.format(c='title'))}, '[^a-z0-9]+', '-', 'g'), '-') as slug from page")
def str_03_slug(spark, d):
    return pages(spark, d, only=("title",)).select("title", slug(F.col("title")).alias("slug")).distinct()


@query(P_SQL + f"select distinct title, {TOKENS_SQL.format(c='title')} as tokens, array_to_string([left(t, 1) for t in {TOKENS_SQL.format(c='title')}], '') as acronym from page")
def str_04_tokens(spark, d):
    """Tokens and acronym of titles (STR-04, STR-05)."""
    t = pages(spark, d, only=("title",)).select("title").distinct().select("title", tokens(F.col("title")).alias("tokens"))
    return t.select("title", "tokens", acronym(F.col("tokens")).alias("acronym"))


@query(P_SQL + "select distinct rel, replace(url_encode(rel), '%2F', '/') as encoded from page")
def str_08_encode_path(spark, d):
    """Paths as link targets."""
    return pages(spark, d, only=("type",)).select("rel", encode_path(F.col("rel")).alias("encoded")).distinct()


@query("select distinct link_id, line, target, case when contains(target, chr(10)) then 1 + len(target) - len(replace(target, chr(10), '')) else 1 end as n_lines from page_link")
def str_10_line_at(spark, d):
    """Lines of a text up to its end: line ends count by line feed alone."""
    t = F.col("target")
    return table(spark, d, "page_link").select("link_id", "line", "target", (F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1).alias("n_lines")).distinct()


_NAMES_SQL = f"""name0 as (select distinct rel, title, aliases, replace(regexp_replace(regexp_extract(rel, '([^/]*)$', 1), '\\.[^.]*$', ''), '-', ' ') as stem from known join page using (rel)),
name1 as (select rel, unnest(list_concat([title], coalesce(aliases, []), [stem])) as name from name0 where title is not null),
name as (select distinct rel, {TOKENS_SQL.format(c='name')} as tokens from name1 where name is not null)"""


@query(P_SQL + f", {_NAMES_SQL} select rel, tokens from name where len(tokens) > 0")
def str_06_page_names(spark, d):
    """The names of each page as tokens, each once: title, aliases, stem."""
    n = G.page_names(pages(spark, d).where(in_scope()))
    return n.select("rel", "tokens").distinct()


@query(P_SQL + f", {_NAMES_SQL} select array_to_string(tokens, ' ') as name, count(*) as n_owners, list_sort(list(rel)) as owners from name where len(tokens) > 0 group by 1 having count(*) > 1")
def agg_12_ambiguous_names(spark, d):
    """Names that several pages bear, with their owners."""
    n = G.page_names(pages(spark, d).where(in_scope()))
    owners = n.select(F.array_join("tokens", " ").alias("name"), "rel").distinct().groupBy("name").agg(F.count(F.lit(1)).alias("n_owners"), F.array_sort(F.collect_list("rel")).alias("owners"))
    return owners.where(F.col("n_owners") > 1)


_PAIRS = "(select distinct least(a, b) as a, greatest(a, b) as b from (select regexp_replace(a, '^/', '') as a, regexp_replace(b, '^/', '') as b from dup_candidate) where a <> b)"


@query(P_SQL + f", pg as (select rel, list_distinct(flatten(list(tags))) as tags from page where tags is not null group by rel) select c.a, c.b, list_sort(list_intersect(x.tags, y.tags)) as shared, round(case when len(x.tags) > 0 and len(y.tags) > 0 then len(list_intersect(x.tags, y.tags))::double / len(list_distinct(list_concat(x.tags, y.tags))) else 0 end, 6) as overlap from {_PAIRS} c join pg x on x.rel = c.a join pg y on y.rel = c.b")
def set_06_tag_overlap(spark, d):
    """Shared tags and Jaccard overlap of candidate pairs in either order (SET-04, SET-06); a path with several live rows has the tags of all."""
    path = lambda c: F.regexp_replace(c, "^/", "").alias(c)
    both = table(spark, d, "dup_candidate").select(path("a"), path("b")).where(F.col("a") != F.col("b"))
    pairs = both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    own = pages(spark, d, only=("tags",)).where(F.col("tags").isNotNull()).select("rel", F.explode_outer("tags").alias("tag")).groupBy("rel").agg(F.collect_set("tag").alias("tags"))
    got = pairs.join(own.select(F.col("rel").alias("a"), F.col("tags").alias("x")), "a").join(own.select(F.col("rel").alias("b"), F.col("tags").alias("y")), "b")
    return got.select("a", "b", F.array_sort(F.array_intersect("x", "y")).alias("shared"), F.round(jaccard(F.col("x"), F.col("y")), 6).alias("overlap"))


@query(
    P_SQL
    + f""", {_FM_SQL}, s0 as (select rel, j->'sources' as v from fm),
  s1 as (select rel, case when json_type(v) = 'VARCHAR' and json_valid(v->>'$') then (v->>'$')::json else v end as v from s0 where v is not null),
  s2 as (select distinct rel, unnest(case json_type(v) when 'OBJECT' then [v->>'id'] when 'ARRAY' then (v->>'$[*].id') else [] end) as id from s1)
  select rel, id from s2 where id is not null and not exists (select 1 from documents d where d.rel = s2.rel and contains(text, '[^' || id || ']'))"""
)
def set_03_uncited_sources(spark, d):
    """Source ids of a page's frontmatter that its body never cites."""
    own = nested_rows(table(spark, d, "bundle_page").where(F.col("deleted_at").isNull()), "rel", "frontmatter", ("sources",))
    ids = own.where(F.col("is_object") & (F.col("grp") == "sources[]") & F.col("fields")["id"].isNotNull()).select(F.col("record").alias("rel"), F.col("fields")["id"].alias("id")).distinct()
    text = table(spark, d, "documents").select("rel", "text")
    cited = ids.join(text, "rel").where(F.contains("text", F.concat(F.lit("[^"), "id", F.lit("]")))).select("rel", "id")
    return ids.join(cited, ["rel", "id"], "left_anti")

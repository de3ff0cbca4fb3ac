"""Queries of texts, checks, duplicates, mentions, indexes and the analysis of the link graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions.paths import file_path, stem_of
from quire.functions.strings import casefold
from quire.operators import graph as G
from quire.operators.blocks import class_pairs, name_classes
from quire.operators.catalog import edges, in_scope, links, pages, relations
from quire.operators.checks import Corpus, check, totals, unordered
from quire.operators.duplicates import duplicate_candidates, name_signals, shingles
from quire.operators.index import expected_indexes, folder_contexts, folders_to_index
from quire.operators.markdown import text_parts
from quire.operators.mentions import name_owners, unlinked_mentions
from quire.operators.profile import HOUSE
from quire.operators.report import page_facts
from quire.queries.reference import _RELATIONS_SQL, AS_OF, TOKENS_SQL, internal_relations
from quire.queries.registry import EDGES_SQL, FILES_SQL, GRAPH_SQL, LINKS_SQL, P_SQL, PAGE_SQL, query, sql_file
from quire.sources import table

# --- texts -----------------------------------------------------------------------------------------------------------


def _texts(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


@query()
def txt_01_mask(spark, d):
    """Texts with code, comments and escapes blanked (TXT-01, TXT-02), as a digest and the count of what is left."""
    got = text_parts(_texts(spark, d), "text", ["doc_id"], ["masked"])
    return got.select("doc_id", F.length("masked").alias("n_chars"), F.length(F.regexp_replace("masked", r"\s", "")).alias("n_left"), F.md5(F.col("masked").cast("binary")).alias("digest"))


@query("select doc_id, coalesce(len(text), 0) as n_chars, coalesce(1 + len(text) - len(replace(text, chr(10), '')), 1) as n_lines from documents")
def txt_01_same_places(spark, d):
    """Blanked texts keep their length and lines."""
    got = text_parts(_texts(spark, d), "text", ["doc_id"], ["masked"])
    m = F.col("masked")
    return got.select("doc_id", F.length(m).alias("n_chars"), (F.length(m) - F.length(F.replace(m, F.lit("\n"), F.lit(""))) + 1).alias("n_lines"))


@query()
def txt_03_links(spark, d):
    """Inline links and images of all texts."""
    got = text_parts(_texts(spark, d), "text", ["doc_id"], ["links"])
    return got.select("doc_id", F.explode("links").alias("x")).select("doc_id", "x.ord", "x.text", "x.target", "x.line", "x.image")


@query()
def txt_04_footnotes(spark, d):
    """Footnote marks of all texts, and whether their text is there."""
    got = text_parts(_texts(spark, d), "text", ["doc_id"], ["footnote_refs", "footnote_defs"])
    return got.select("doc_id", F.explode("footnote_refs").alias("x"), "footnote_defs").select("doc_id", "x.label", "x.line", F.array_contains("footnote_defs", F.col("x.label")).alias("defined"))


@query()
def txt_05_ref_defs(spark, d):
    got = text_parts(_texts(spark, d), "text", ["doc_id"], ["ref_defs"])
    return got.select("doc_id", F.explode("ref_defs").alias("x")).select("doc_id", "x.label", "x.target", "x.line")


@query("select doc_id, len(regexp_extract_all(coalesce(text, ''), '(?m)^# [^\\n]*$')) > 0 as has_mark, text is null as missing from documents")
def txt_11_first_level(spark, d):
    """Whether a text has a line of a first-level heading at all."""
    t = F.coalesce("text", F.lit(""))
    return _texts(spark, d).select("doc_id", t.rlike(r"(?m)^# [^\n]*$").alias("has_mark"), F.col("text").isNull().alias("missing"))


@query()
def txt_11_h1(spark, d):
    """Titles in the first line of texts, and their headings."""
    got = text_parts(_texts(spark, d), "text", ["doc_id"], ["h1", "headings", "tags", "wikilinks", "block_ids"])
    return got.select("doc_id", "h1", F.size("headings").alias("n_headings"), F.size("tags").alias("n_tags"), F.size("wikilinks").alias("n_wikilinks"), F.size("block_ids").alias("n_block_ids"))


@query(
    """with w as (select doc_id, regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\\p{L}\\p{M}\\p{Nd}\\p{Nl}\\p{Pc}\\x{200c}\\x{200d}]+') as w from documents)
  select doc_id, count(distinct s) as n_shingles from (select doc_id, unnest(case when len(w) >= 5 then [array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)] else [null] end) as s from w) group by doc_id"""
)
def txt_10_shingles(spark, d):
    """Distinct runs of five words of each text."""
    words, runs = shingles(F.col("text"))
    return _texts(spark, d).select("doc_id", words.alias("__w")).select("doc_id", F.size(runs).cast("long").alias("n_shingles"))


# --- checks ----------------------------------------------------------------------------------------------------------


def _diagnostics(spark, d):
    return check(Corpus.of_tables(spark, d), HOUSE, AS_OF)


@query()
def chk_diagnostics(spark, d):
    """All diagnostics: path, line, code, message."""
    return _diagnostics(spark, d)


@query()
def agg_17_totals(spark, d):
    """Errors, warnings and exit codes (AGG-17, AGG-18)."""
    return totals(_diagnostics(spark, d))


_DOC_SQL = """doc0 as (select distinct page_id, rel, frontmatter from bundle_page where deleted_at is null),
doc as (select rel, frontmatter, case when json_valid(frontmatter) then json_type(frontmatter::json) = 'OBJECT' else false end as readable from doc0),
valid as (select rel, frontmatter::json as j, trim(frontmatter::json->>'type') as type, case when contains(rel, '/') then regexp_replace(rel, '/[^/]*$', '') else '' end as folder
  from doc where readable and json_type(frontmatter::json->'type') = 'VARCHAR' and trim(frontmatter::json->>'type') <> ''),
prose as (select distinct rel from valid where type <> 'Template'),
there as (select rel as dst from doc union select unnest(list_transform(range(0, len(string_split(rel, '/'))), lambda n: array_to_string(string_split(rel, '/')[1:n], '/'))) from doc),
own as (select distinct rel, target, line from page_link where rel in (select rel from doc))
"""
_INSIDE = "not regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*:') and not starts_with(target, '//') and not starts_with(target, '#') and split_part(target, '#', 1) <> ''"
_OWN = f"l as (select rel, target, line, {sql_file('target', 'rel')} as dst from own where {_INSIDE} and rel in (select rel from prose))"
_REL = f"r as (select rel, key, target, {sql_file('target', 'rel')} as dst from (select distinct rel, key, target from page_relation where rel in (select rel from prose) and key in {HOUSE.relations}) where {_INSIDE})"
_ONE = "with " + _DOC_SQL


def _ISO(name: str, select: str) -> str:
    """SQL for ISO times with an offset: basic forms and decimal commas put in the form that casts."""
    basic = "regexp_replace(x, '^([0-9]{4})([0-9]{2})([0-9]{2})T([0-9]{2})([0-9]{2})([0-9]{2})', '\\1-\\2-\\3T\\4:\\5:\\6')"
    return f"{name}0 as ({select}), {name} as (select rel, replace({basic}, ',', '.') as x from {name}0 where regexp_matches(replace({basic}, ',', '.'), '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[T ][0-9]{{2}}:[0-9]{{2}}(:[0-9]{{2}}([.][0-9]+)?)?(Z|[+-][0-9]{{2}}:?[0-9]{{2}})$'))"


_CODES = {
    "O001": _ONE + "select distinct rel as path, 1 as line from doc where not readable",
    "O002": _ONE + "select distinct rel as path, 1 as line from doc where readable and rel || frontmatter not in (select rel || frontmatter from doc0 where json_valid(frontmatter) and json_type(frontmatter->'type') = 'VARCHAR' and trim(frontmatter->>'type') <> '')",
    "H001": _ONE
    + """, part as (select rel, unnest(string_split(folder, '/')) as p from valid where folder <> '')
  select distinct rel as path, 1 as line from part where not regexp_matches(regexp_replace(p, '^_*[.]*', ''), '^[a-z0-9]+(-[a-z0-9]+)*$')
  union select rel, 1 from valid where not regexp_matches(regexp_replace(regexp_extract(rel, '([^/]*)$', 1), '[.][^.]*$', ''), '^[a-z0-9]+(-[a-z0-9]+)*$')""",
    "H010": None,
    "W010": _ONE + f", k as (select rel, unnest(json_keys(j)) as k from valid) select distinct rel as path, 1 as line from k where k not in {('type', 'title', 'description', 'resource', 'tags', 'aliases', 'status', 'stale_after', 'generated', 'verified', 'sources', 'usage_window', 'author', 'published', 'archived', 'zotero', 'locators', *HOUSE.relations)}",
    "H011": _ONE + f"select distinct rel as path, 1 as line from valid where type not in {tuple(HOUSE.types)}",
    "H012": _ONE
    + f"""select distinct rel as path, 1 as line from valid where case type {" ".join(f"when '{n}' then not (" + " or ".join("split_part(rel, '/', 1) in ('systems', 'data', 'operations', 'methods') and contains(rel, '/')" if f == "*" else f"folder = '{f}' or starts_with(folder, '{f}/')" for f in t.folders) + ")" for n, t in HOUSE.types.items())} else false end""",
    "H013": _ONE + "select distinct rel as path, 1 as line from valid where (type = 'Source' and not list_contains(json_keys(j), 'resource')) or (type = 'Decision Record' and not list_contains(json_keys(j), 'verified'))",
    "H020": None,
    "H021": None,
    "W020": None,
    "W021": _ONE
    + f""", s as (select rel, unnest(j->>'$.sources[*].resource') as target from valid where type <> 'Template' and json_type(j->'sources') = 'ARRAY')
  select distinct rel as path, 1 as line from (select rel, coalesce({sql_file("target", "rel")}, '..') as dst from s where starts_with(target, '/')) where dst not in (select dst from there)""",
    "H030": _ONE + f", {_OWN} select distinct rel as path, line from l where dst is null",
    "W030": _ONE + f", {_OWN} select distinct rel as path, line from l where dst is not null and dst not in (select dst from there)",
    "W031": _ONE + f", {_OWN} select distinct rel as path, line from l where dst is not null and not starts_with(target, '/')",
    "H032": None,
    "W033": _ONE + "select distinct rel as path, line from ref_def where rel in (select rel from prose)",
    "W032": _ONE + f", {_REL} select distinct rel as path, 1 as line from r where dst <> '' and dst not in (select dst from there)",
    "H031": _ONE + f", {_OWN}, {_REL} select distinct rel as path, 1 as line from r where not exists (select 1 from l where l.rel = r.rel and l.dst = r.dst)",
    "W040": _ONE + f", {_ISO('due0', "select rel, j->>'stale_after' as x from valid where type <> 'Template' and json_type(j->'stale_after') = 'VARCHAR'")} select distinct rel as path, 1 as line from due0 where try_cast(x as timestamptz) <= timestamptz '2026-01-01 00:00:00+00'",
    "W041": _ONE
    + f""", ev as (select rel, j->'generated' as e from valid where type <> 'Template' union all select rel, j->'verified' from valid where type <> 'Template' union all select rel, unnest((j->'verified')::json[]) from valid where type <> 'Template' and json_type(j->'verified') = 'ARRAY'),
  {_ISO('due0', "select rel, e->>'at' as x from ev where json_type(e) = 'OBJECT' and json_type(e->'at') = 'VARCHAR'")} select distinct rel as path, 1 as line from due0 where try_cast(x as timestamptz) > timestamptz '2026-01-01 00:00:00+00'""",
    "W060": None,
    "H060": None,
    "O003": None,
    "O004": None,
    "O005": None,
    "W050": None,
    "H040": None,
}
# no page of the tables is an index or a log and none has locators: what these codes say of them is tested on small bundles


def _code(code: str, sql: str | None):
    def run(spark, d):
        return _diagnostics(spark, d).where(F.col("code") == code).select("path", "line").distinct()

    run.__name__ = f"chk_{code.lower()}"
    run.__doc__ = f"The places of diagnostic {code}."
    query(sql)(run)


for _c, _s in _CODES.items():
    _code(_c, _s)


@query("with e as (select user_id, event_id, event_type, lag(event_type) over (partition by user_id order by event_id) as before from events) select event_id from e where event_type >= before")
def win_01_not_ascending(spark, d):
    """Entries of a log whose value is not below that of the entry before."""
    return unordered(table(spark, d, "events"), "user_id", "event_id", "event_type").select("event_id")


# --- duplicates and mentions -----------------------------------------------------------------------------------------

_MEMBER_SQL = f"""inside as (select * from scoped where split_part(rel, '/', 1) <> 'journal'),
nm0 as (select rel, title as name from inside union all select rel, unnest(aliases) from inside union all select rel, replace(regexp_replace(regexp_extract(rel, '([^/]*)$', 1), '\\.[^.]*$', ''), '-', ' ') from inside),
nm1 as (select distinct rel, {TOKENS_SQL.format(c="name")} as t from nm0 where name is not null),
nm as (select rel, t, array_to_string(t, ' ') as name from nm1 where len(t) > 0)"""
_CLASSES_SQL = """classes as (select distinct rel as id, 'n:' || name as class from nm union select rel, 'r:' || regexp_replace(resource, '/+$', '') from inside where resource <> '')"""
_CLASS_PAIRS_SQL = """key as (select distinct class, unnest(list_concat(['t:' || x for x in t], ['p:' || left(x, 4) for x in t], ['a:' || case when len(t) = 1 then t[1] else array_to_string([left(x, 1) for x in t], '') end])) as key
  from (select distinct class, string_split(substr(class, 3), ' ') as t from classes where starts_with(class, 'n:'))),
kept as (select class, key from key where key in (select key from classes join key using (class) group by key having count(distinct id) <= 200))
select distinct x.class as class_a, y.class as class_b from kept x join kept y on x.key = y.key and x.class < y.class"""


def _page_classes(spark, d):
    """Names are the title, the aliases and the file's stem."""
    stem = F.replace(stem_of(F.col("rel")), F.lit("-"), F.lit(" "))
    names = F.array_compact(F.concat(F.array("title", stem), F.coalesce("aliases", F.array().cast("array<string>"))))
    return name_classes(pages(spark, d).where(in_scope()).select(F.col("rel").alias("id"), names.alias("names"), "resource"))


@query(f"with {PAGE_SQL}, {_MEMBER_SQL}, {_CLASSES_SQL} select * from classes")
def dup_01_page_classes(spark, d):
    """Pages of equal name or resource: one row per page and class."""
    return _page_classes(spark, d)


@query(f"with {PAGE_SQL}, {_MEMBER_SQL}, {_CLASSES_SQL}, {_CLASS_PAIRS_SQL}")
def dup_02_page_class_pairs(spark, d):
    """Pairs of names of pages that share a token, prefix or acronym of at most 200 pages."""
    return class_pairs(_page_classes(spark, d))


def _part_classes(spark, d):
    return name_classes(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array("p_name").alias("names"), F.lit(None).cast("string").alias("resource")))


_PART_SQL = f"nm as (select distinct p_partkey as rel, {TOKENS_SQL.format(c='p_name')} as t from part), classes as (select distinct rel as id, 'n:' || array_to_string(t, ' ') as class from nm where len(t) > 0)"


@query(f"with {_PART_SQL} select * from classes")
def dup_01_part_classes(spark, d):
    """Parts of equal name: one row per part, with its class."""
    return _part_classes(spark, d)


@query(f"with {_PART_SQL}, {_CLASS_PAIRS_SQL}")
def dup_02_part_class_pairs(spark, d):
    """Pairs of names of parts that share a token, prefix or acronym of at most 200 parts."""
    return class_pairs(_part_classes(spark, d))


_SIGNALS_SQL = f"""with {PAGE_SQL}, {LINKS_SQL}, {_MEMBER_SQL},
kk as (select distinct rel, unnest(list_concat(['n:' || name], ['t:' || x for x in t], ['p:' || left(x, 4) for x in t], [case when len(t) = 1 then 'a:' || t[1] else 'a:' || array_to_string([left(x, 1) for x in t], '') end])) as k from nm
  union select rel, 'r:' || regexp_replace(resource, '/+$', '') from inside where resource <> ''),
big as (select k, count(*) as n, min(rel) as first from kk group by k having count(*) > 1),
cand as (select distinct x.rel as a, y.rel as b from kk x join kk y on x.k = y.k and x.rel < y.rel where x.k in (select k from big where n <= 200)
  union select first, rel from kk join big using (k) where n > 200 and regexp_matches(k, '^[nr]:') and rel <> first),
apart as (select least(src, dst) as a, greatest(src, dst) as b from relation where key in ('alternative_to', 'supersedes', 'contradicts')),
one as (select rel, any_value(type) as type, max(regexp_replace(resource, '/+$', '')) as resource from inside group by rel),
f as (select rel, list_sort(list(distinct name)) as names, list(distinct name) filter (len(t) = 1) as singles, list(distinct array_to_string([left(x, 1) for x in t], '')) filter (len(t) > 1) as acronyms from nm group by rel),
ov as (select c.a, c.b, max(len(list_intersect(x.t, y.t))::double / len(list_distinct(list_concat(x.t, y.t)))) as overlap from cand c join nm x on x.rel = c.a join nm y on y.rel = c.b group by c.a, c.b)
select c.a, c.b, list_has_any(x.names, y.names) as same_name, coalesce(p.resource <> '' and p.resource = q.resource, false) as same_resource,
  list_has_any(coalesce(x.acronyms, []), coalesce(y.singles, [])) or list_has_any(coalesce(y.acronyms, []), coalesce(x.singles, [])) as by_acronym, round(o.overlap, 6) as overlap
from cand c join f x on x.rel = c.a join f y on y.rel = c.b join one p on p.rel = c.a join one q on q.rel = c.b join ov o on o.a = c.a and o.b = c.b
where (p.type = 'Source') = (q.type = 'Source') and not (p.type = 'Journal Entry' and q.type = 'Journal Entry') and not exists (select 1 from apart z where z.a = c.a and z.b = c.b)
  and (same_name or same_resource or by_acronym or o.overlap >= 0.5)"""


@query(_SIGNALS_SQL)
def dup_04_name_signals(spark, d):
    """Candidate pairs with a signal of their names or resources (DUP-01 to DUP-04, JOIN-07, JOIN-09)."""
    s = name_signals(pages(spark, d).where(in_scope()), relations(spark, d))
    fired = F.col("same_name") | F.col("same_resource") | F.col("by_acronym") | (F.col("overlap") >= 0.5)
    return s.where(fired).select("a", "b", "same_name", "same_resource", "by_acronym", F.round("overlap", 6).alias("overlap"))


@query(_SIGNALS_SQL + " order by overlap desc, a, b limit 20")
def top_10_signals(spark, d):
    """The candidate pairs whose names overlap most."""
    s = dup_04_name_signals(spark, d)
    return s.orderBy(F.desc("overlap"), "a", "b").limit(20)


@query()
def dup_06_scores(spark, d):
    """Scored candidates by names, spelling and metadata."""
    return duplicate_candidates(pages(spark, d).where(in_scope()), relations(spark, d))


@query()
def dup_05_scores_with_text(spark, d):
    """Scored candidates, shared text among the signals."""
    t = table(spark, d, "documents").select("rel", "text").where(F.col("rel").isNotNull())
    bodies = text_parts(t, "text", ["rel"], ["masked"]).select("rel", F.col("masked").alias("text"))
    return duplicate_candidates(pages(spark, d).where(in_scope()), relations(spark, d), bodies, cap=None)


@query()
def men_01_names(spark, d):
    """Names of pages that may be mentioned, with their only page or all their owners."""
    return name_owners(pages(spark, d)).select("key", "spelling", "target", "owners")


@query()
def men_05_mentions(spark, d):
    """The first unlinked mention of each page in each text (MEN-02 to MEN-05, JOIN-10, WIN-03, WIN-04)."""
    p = pages(spark, d)
    inside = p.where(in_scope()).select("rel").distinct()
    docs = table(spark, d, "documents").select("rel", F.col("text").alias("body")).join(inside, "rel", "left_semi")
    linked = links(spark, d, files=True).select("src", "dst").unionByName(internal_relations(spark, d).where("dst is not null").select("src", "dst"))
    defs = table(spark, d, "ref_def").select(F.col("rel").alias("src"), file_path(F.col("target"), F.col("rel")).alias("dst")).where("dst is not null")
    return unlinked_mentions(docs, name_owners(p), linked.unionByName(defs).distinct())


# --- indexes ---------------------------------------------------------------------------------------------------------

_CASE_TITLE = "replace(lower(title), 'ß', 'ss')"


@query(P_SQL + f", up as (select unnest(list_transform(range(0, len(string_split(rel, '/'))), lambda n: array_to_string(string_split(rel, '/')[1:n], '/'))) as folder from page where not regexp_matches('/' || folder, '/[_.]')) select folder from up union select unnest({['', *HOUSE.folders]}) ")
def idx_01_folders(spark, d):
    """Folders that have an index."""
    return folders_to_index(pages(spark, d, only=("type",)), HOUSE)


@query()
def idx_02_render(spark, d):
    """The content of every index (AGG-15, TOP-06, TOP-07)."""
    return expected_indexes(pages(spark, d), HOUSE)


@query(
    P_SQL
    + f"""select folder, string_agg(title || ' (' || regexp_extract(rel, '([^/]*)$', 1) || ')', '; ' order by {_CASE_TITLE}, regexp_extract(rel, '([^/]*)$', 1)) as listing from page where not regexp_matches('/' || folder, '/[_.]') and split_part(folder, '/', 1) <> 'journal' group by folder
  union all select folder, string_agg(title || ' (' || regexp_extract(rel, '([^/]*)$', 1) || ')', '; ' order by regexp_extract(rel, '([^/]*)$', 1) desc) from page where split_part(folder, '/', 1) = 'journal' group by folder"""
)
def agg_15_listing(spark, d):
    """The pages of each folder in the order of its index: by title, or by name, the newest first."""
    from quire.functions.paths import name_of
    from quire.operators.catalog import is_tooling
    from quire.operators.index import newest_first

    p = pages(spark, d).where(~is_tooling(F.col("folder")))
    name = name_of(F.col("rel"))
    down = newest_first(F.col("folder"), HOUSE)
    item = F.struct(F.when(down, "").otherwise(casefold(F.col("title"))).alias("k"), name.alias("name"), F.concat("title", F.lit(" ("), name, F.lit(")")).alias("line"))
    lists = p.select("folder", item.alias("i"), down.alias("down")).groupBy("folder", "down").agg(F.array_sort(F.collect_list("i")).alias("l"))
    return lists.select("folder", F.array_join(F.transform(F.when(F.col("down"), F.reverse("l")).otherwise(F.col("l")), lambda x: x["line"]), "; ").alias("listing"))


@query()
def idx_03_stale(spark, d):
    """Indexes that are missing, out of date or left behind."""
    return _diagnostics(spark, d).where(F.col("code") == "H040").select("path", "message")


@query()
def idx_04_contexts(spark, d):
    """Folders with their titles and descriptions."""
    return folder_contexts(folders_to_index(pages(spark, d, only=("type",)), HOUSE), HOUSE)


# --- link graph ------------------------------------------------------------------------------------------------------


@query(GRAPH_SQL.replace("with ", "with recursive ", 1) + ", both_ways as (select src as a, dst as b from edge union select dst, src from edge), reach(rel, c) as (select rel, rel from node union select b, c from reach join both_ways on a = rel) select rel, min(c) as component from reach group by rel")
def grf_03_components(spark, d):
    """Pages joined by links in either direction, by the smallest path of their component (AGG-08)."""
    nodes, e, _ = edges(spark, d)
    return G.components(nodes, e)


@query(GRAPH_SQL.replace("with ", "with recursive ", 1) + ", both_ways as (select src as a, dst as b from edge union select dst, src from edge), reach(rel, c) as (select rel, rel from node union select b, c from reach join both_ways on a = rel), lab as (select rel, min(c) as component from reach group by rel) select component, count(*) as n_pages, case when count(*) between 2 and 3 then list_sort(list(rel)) end as members from lab group by component order by n_pages desc, component")
def top_05_components(spark, d):
    """Components, the largest first, with the members of small islands."""
    nodes, e, _ = edges(spark, d)
    return G.component_sizes(G.components(nodes, e)).orderBy(F.desc("n_pages"), "component")


@query()
def grf_02_pagerank(spark, d):
    """Top pages by PageRank (TOP-01): the score decides unrounded, then the path."""
    nodes, e, _ = edges(spark, d)
    return G.pagerank(nodes, e).orderBy(F.desc("score"), "rel").limit(15).select("rel", F.round("score", 8).alias("score"))


def _facts(spark, d):
    return page_facts(pages(spark, d, frontmatter=True).where(in_scope()).dropDuplicates(["rel"]), AS_OF).select("rel", "tier", "cited")


@query()
def top_02_review_first(spark, d):
    """Central pages that nobody has verified or that cite nothing."""
    nodes, e, _ = edges(spark, d)
    got = G.pagerank(nodes, e).join(_facts(spark, d), "rel")
    return got.where((F.col("tier") == "unverified") | ~F.col("cited")).orderBy(F.desc("score"), "rel").limit(15).select("rel", F.round("score", 8).alias("score"), "tier", "cited")


@query(GRAPH_SQL + ", sets as (select src from edge group by src having count(*) <= 60), few as (select e.* from edge e join sets using (src)), pair as (select x.dst as a, y.dst as b, count(*) as n from few x join few y on x.src = y.src and x.dst < y.dst group by 1, 2 having count(*) >= 3) select a, b, n from pair order by n desc, a, b limit 15")
def top_04_colinks(spark, d):
    """The pairs linked together most often."""
    _, e, _ = edges(spark, d)
    return G.colinks(e).orderBy(F.desc("n"), "a", "b").limit(15)


@query()
def grf_07_analysis(spark, d):
    """The whole analysis of the link graph."""
    nodes, e, cites = edges(spark, d)
    tags = pages(spark, d, only=("type", "tags")).where(in_scope("all")).join(nodes.select("rel"), "rel", "left_semi").select("rel", F.explode("tags").alias("tag"))
    return G.analysis(nodes, e, cites, _facts(spark, d), tags)

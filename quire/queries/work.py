"""Queries of search and its evaluation, rewrites, import, bibliography and changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions.paths import file_path, folder_of, name_of, percent_decode, relation_parts, without_fragment
from quire.functions.strings import glob_regex
from quire.operators import biblio as B
from quire.operators import importing as I
from quire.operators import rewrite as R
from quire.operators import search as S
from quire.operators.catalog import existing, in_scope, pages
from quire.operators.checks import confined, denied
from quire.operators.index import escape_entry
from quire.queries.reference import T0, T1, _snapshot
from quire.queries.registry import P_SQL, PAGE_SQL, query, sql_file
from quire.sinks import changed_files
from quire.sources import table
from quire.sources.bundle import html_text, parse_texts
from quire.streaming.changes import reuse_digests

# --- search ----------------------------------------------------------------------------------------------------------

QUERY = "throttle, ledger of!"
QUESTIONS = ("Which turbine does the archive describe?", "What about harbour ledgers and the shared network?", "Where is the manifest of snapshots?", "How is a survey of sensors deduplicated?")
FILTERS = ({"type": "Concept", "folder": "systems"}, {"tag": "network"}, {}, {"status": "draft"})
#: Words whose pages the questions expect: the first two by path with the word in their title.
WANTED = ("turbine", "harbour", "manifest", "survey")

_FILES_TEXT = "file as (select d.rel, coalesce(p.frontmatter, '') || chr(10) || coalesce(d.text, '') as text from documents d left join (select page_id, any_value(frontmatter) as frontmatter from bundle_page group by page_id) p on p.page_id = d.doc_id where d.rel is not null)"


def _files(spark, d):
    """Whole files: frontmatter and body."""
    fm = table(spark, d, "bundle_page").select(F.col("page_id").alias("doc_id"), "frontmatter").distinct()
    return table(spark, d, "documents").join(fm, "doc_id", "left").select("rel", F.concat(F.coalesce("frontmatter", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit(""))).alias("text")).where(F.col("rel").isNotNull())


def _rx(words) -> str:
    return "|".join(words)


@query(f"with {_FILES_TEXT} select rel, n from (select rel, len(regexp_extract_all(text, '(?i){_rx(S.search_terms(QUERY))}')) as n from file where regexp_extract(rel, '([^/]*)$', 1) <> 'index.md') where n > 0 order by n desc, rel limit 20")
def srch_01_text_search(spark, d):
    """The pages in which a query's words occur most often, in the whole file, top 20 (TOP-03)."""
    return S.text_search(_files(spark, d), QUERY)


def _index_sql(i: int, q: str) -> str:
    words = S.topic_words(q)
    return f"select {i} as qid, rel, len(list_intersect(list_distinct(regexp_extract_all(lower(coalesce(title, '') || ' ' || description), '[\\p{{L}}\\p{{M}}\\p{{N}}_-]+')), {words})) as n, {2 if len(words) >= 3 else 1} as least from own"


_INDEX_SQL = (
    "own as (select distinct rel, title, description from page where type is not null and regexp_extract(rel, '([^/]*)$', 1) not in ('index.md', 'log.md') and not regexp_matches('/' || folder, '/[_.]')), index0 as ("
    + " union all ".join(_index_sql(i, q) for i, q in enumerate(QUESTIONS, 1))
    + "), indexed as (select qid, rel, max(n) as n from index0 where n >= least group by qid, rel)"
)


@query(P_SQL + f", {_INDEX_SQL} select * from indexed")
def srch_03_index_ranking(spark, d):
    """Distinct words of each question in titles and descriptions; two are needed where there are three or more."""
    return S.index_hits(pages(spark, d), QUESTIONS)


_TEXT_SQL = "texts as (" + " union all ".join(f"select {i} as qid, rel, len(regexp_extract_all(text, '(?i){_rx(S.search_terms(q))}')) as n from file where regexp_extract(rel, '([^/]*)$', 1) <> 'index.md'" for i, q in enumerate(QUESTIONS, 1)) + ")"
_TIER_SQL = "ranked as (select qid, rel, row_number() over (partition by qid order by tier, n desc, rel) as place_no from (select qid, rel, n, 1 as tier from indexed union all select qid, rel, n, 2 from texts where n > 0 and (qid, rel) not in (select (qid, rel) from indexed)))"
_WANT_SQL = "want as (" + " union all ".join(f"select {i} as qid, rel from (select distinct rel from scoped where contains(lower(title), '{w}') order by rel limit 2)" for i, w in enumerate(WANTED, 1)) + ")"
_EVAL_SQL = f"with {PAGE_SQL}, {_FILES_TEXT}, {_INDEX_SQL}, {_TEXT_SQL}, {_TIER_SQL}, {_WANT_SQL}"


def _expected(spark, d):
    p = pages(spark, d).where(in_scope("all"))
    out = None
    for i, w in enumerate(WANTED, 1):
        got = p.where(F.lower("title").contains(w)).select("rel").distinct().orderBy("rel").limit(2).select(F.lit(i).alias("qid"), "rel")
        out = got if out is None else out.unionByName(got)
    return out


@query(_EVAL_SQL + " select qid, place_no, rel from ranked where place_no <= 10")
def srch_04_first_tier(spark, d):
    """The first ten pages for each question: by index, then by text (SET-05)."""
    return S.top_places(S.first_tier(pages(spark, d), _files(spark, d), QUESTIONS), 10)


@query(P_SQL + ", found as (select 1 as qid, rel from page where type = 'Concept' and starts_with(rel, 'systems/') union select 2, rel from page where type is not null and list_contains(tags, 'network') union select 4, rel from page where type is not null and status = 'draft') select qid, count(*) as n_pages, min(rel) as first_rel from found where regexp_extract(rel, '([^/]*)$', 1) not in ('index.md', 'log.md') group by qid")
def srch_05_filter_ranking(spark, d):
    """What the filters of each question find."""
    return S.filter_tier(pages(spark, d), FILTERS).groupBy("qid").agg(F.count(F.lit(1)).alias("n_pages"), F.min("rel").alias("first_rel"))


@query(_EVAL_SQL + " select qid, w.rel, place_no from want w left join ranked r using (qid, rel)")
def win_02_expected_places(spark, d):
    """The place of each expected page in its question's ranking."""
    return S.expected_places(S.first_tier(pages(spark, d), _files(spark, d), QUESTIONS), _expected(spark, d))


@query(_EVAL_SQL + ", pl as (select qid, place_no from want w left join ranked r using (qid, rel)) select qid, min(place_no) as first_place, count(*) filter (place_no <= 10) as n_found, count(*) as n_expected, count(*) filter (place_no <= 10) / count(*) as recall, count(*) filter (place_no <= 10) > 0 as hit from pl group by qid")
def eval_01_scores(spark, d):
    """Recall, hit and first place per question."""
    return S.scores(win_02_expected_places(spark, d), 10)


@query(_EVAL_SQL + ", pl as (select qid, place_no from want w left join ranked r using (qid, rel)), one as (select qid, count(*) filter (place_no <= 10) / count(*) as recall from pl group by qid) select 'index+text' as tier, count(*) as n_questions, count(*) filter (recall > 0) as n_hits, avg(recall) as recall, avg(recall) >= 0.5 as passed from one")
def eval_02_summary(spark, d):
    """Mean recall and hits over the questions, and whether they reach the least recall (EVAL-02, EVAL-03, AGG-11)."""
    return S.summary(eval_01_scores(spark, d), "index+text", 0.5)


# --- rewrites --------------------------------------------------------------------------------------------------------

_REFS_SQL = """refs as (select distinct 'page_link' as tbl, link_id as id, rel, target from page_link union select distinct 'page_relation', relation_id, rel, target from page_relation union select distinct 'ref_def', refdef_id, rel, target from ref_def)"""
_INTERNAL_SQL = "not regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*:') and not starts_with(target, '//') and not starts_with(target, '#') and split_part(target, '#', 1) <> ''"


def _encode_sql(path: str) -> str:
    out = f"url_encode({path})"
    for c in "/~!$&()*,;=:@":
        out = f"replace({out}, '%{ord(c):02X}', '{c}')"
    return f"replace(replace({out}, '%27', ''''), '%2B', '+')"


def _refs(spark, d):
    """All references of the three tables: tbl, id, rel, target."""
    out = None
    for name, key in (("page_link", "link_id"), ("page_relation", "relation_id"), ("ref_def", "refdef_id")):
        t = table(spark, d, name).select(F.lit(name).alias("tbl"), F.col(key).alias("id"), "rel", "target").distinct()
        out = t if out is None else out.unionByName(t)
    return out


@query(
    f"with {PAGE_SQL}, {_REFS_SQL}, o as (select *, {sql_file('target', 'rel')} as near, {sql_file('target', chr(39) + chr(39))} as root from refs where {_INTERNAL_SQL} and not starts_with(url_decode(split_part(target, '#', 1)), '/')),"
    f" n as (select tbl, id, rel, target, case when near <> '' and near in (select dst from existing) then near when root <> '' and root in (select dst from existing) then root end as p from o) select tbl, id, rel, target, '/' || {_encode_sql('p')} || regexp_extract(target, '(#.*)$', 1) as new_target from n where p is not null"
)
def mut_01_fix_links(spark, d):
    """Relative references that name something, made absolute."""
    return R.absolute_targets(_refs(spark, d), existing(pages(spark, d, only=("type",))))


MOVES = (("data/formats", "data/layouts"), ("systems/storage", "storage"))
_MOVES_SQL = "mv as (select distinct rel as old, case when starts_with(rel, 'data/formats/') then 'data/layouts' || substr(rel, 13) else 'storage' || substr(rel, 16) end as new from page where starts_with(rel, 'data/formats/') or starts_with(rel, 'systems/storage/'))"


@query(
    f"with {PAGE_SQL}, {_REFS_SQL}, {_MOVES_SQL}, o as (select *, {sql_file('target', 'rel')} as p from refs where {_INTERNAL_SQL}),"
    f" n as (select tbl, id, rel, target, case when p in (select old from mv) then (select new from mv where old = p) when rel in (select old from mv) and not starts_with(target, '/') then p end as q from o where p is not null),"
    f" t as (select tbl, id, rel, target, '/' || {_encode_sql('q')} || regexp_extract(target, '(#.*)$', 1) as new_target from n where q is not null) select * from t where new_target <> target"
)
def mut_02_move(spark, d):
    """References to retarget when folders move, and the moved pages' own relative ones."""
    return R.retargeted(_refs(spark, d), R.folder_moves(pages(spark, d, only=("type",)), MOVES))


def _merges(spark, d):
    """Pages that a candidate of high score names a copy of another: folded into the smallest such page that is no copy itself."""
    path = lambda c: F.regexp_replace(c, "^/", "")
    c = table(spark, d, "dup_candidate").where("score >= 0.9").select(F.least(path("a"), path("b")).alias("new"), F.greatest(path("a"), path("b")).alias("old")).where("old <> new")
    one = c.groupBy("old").agg(F.min("new").alias("new"))
    return one.join(one.select(F.col("old").alias("new")), "new", "left_anti").select("old", "new")


@query()
def mut_03_merge(spark, d):
    """Tags and aliases of pages into which their copies are folded."""
    p = pages(spark, d).where(in_scope("all")).select("rel", "title", "tags", "aliases").dropDuplicates(["rel"])
    return R.merged_pages(p, _merges(spark, d))


@query("with g as (select page_id, list_distinct([t for t in flatten(list(targets order by built_at, len(targets), targets)) if t is not null]) as u from graph_out where targets is not null and page_id is not null group by page_id) select page_id, list_sort(u) as targets from g")
def mut_03_union_merge(spark, d):
    """Lists of repeated records merged without repetition."""
    g = table(spark, d, "graph_out").where(F.col("targets").isNotNull() & F.col("page_id").isNotNull())
    return g.select("page_id", F.explode_outer("targets").alias("t")).groupBy("page_id").agg(F.array_sort(F.collect_set("t")).alias("targets"))


@query("select doc_id, case when text is null then null else left(text, 2) || '<' || substr(text, 6, 3) || '>' || substr(text, 12) end as text from documents where text is null or len(text) >= 12")
def mut_04_apply_edits(spark, d):
    """Two spans of every text replaced at once."""
    t = table(spark, d, "documents").select("doc_id", "text").where(F.col("text").isNull() | (F.length("text") >= 12))
    edit = lambda a, b, new: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(new).alias("new"))
    return t.select("doc_id", R.apply_edits(F.col("text"), F.array(edit(2, 5, "<"), edit(8, 11, ">"))).alias("text"))


@query(
    P_SQL
    + """, m as (select distinct rel as old, lower(rel) as new from page union select distinct rel, regexp_replace(rel, '[^/]*$', 'index.md') from page union select distinct rel, '../' || rel from page union select distinct rel, regexp_replace(rel, '[.]md$', '.txt') from page),
  t as (select distinct lower(rel) as k, rel from page)
  select distinct old, new, error from (
    select old, new, 'the same path' as error from m where old = new
    union all select old, new, 'another extension' from m where ends_with(new, '.txt') and ends_with(old, '.md')
    union all select old, new, 'a reserved name' from m where regexp_extract(new, '([^/]*)$', 1) in ('index.md', 'log.md')
    union all select old, new, 'outside the bundle' from m where starts_with(new, '../')
    union all select old, new, 'a hidden folder' from m where regexp_matches('/' || new, '/[.][^/.]')
    union all select old, new, 'already there' from m join t on t.k = lower(new) where t.rel <> old
    union all select old, new, 'a reserved file stays where it is' from m where regexp_extract(old, '([^/]*)$', 1) in ('index.md', 'log.md'))"""
)
def mut_06_destinations(spark, d):
    """Why moves of every page to four kinds of places are refused."""
    p = pages(spark, d, only=("type",)).select(F.col("rel").alias("old")).distinct()
    to = [F.lower("old"), F.regexp_replace("old", "[^/]+$", "index.md"), F.concat(F.lit("../"), "old"), F.regexp_replace("old", "[.]md$", ".txt")]
    return R.destination_errors(p.select("old", F.explode(F.array(*to)).alias("new")).distinct(), p.withColumnRenamed("old", "rel"))


@query(P_SQL + f", {_MOVES_SQL} select rel as qid, coalesce(new, rel) as first_rel from (select distinct rel from page) left join mv on old = rel")
def misc_03_expectations(spark, d):
    """Pages that questions expect, under their names after a move."""
    q = pages(spark, d, only=("type",)).select(F.col("rel").alias("qid")).distinct().select("qid", F.array("qid", F.replace("qid", F.lit("data/formats/"), F.lit("data/layouts/"))).alias("expected"))
    return R.renamed_expectations(q, R.folder_moves(pages(spark, d, only=("type",)), MOVES)).select("qid", F.element_at("expected", 1).alias("first_rel"))


# --- import ----------------------------------------------------------------------------------------------------------

RULES = (
    I.Rule("drop", ("**/draft-*",), skip=True),
    I.Rule("journal", ("kiln/**", "*/2024*/**"), "journal/{name}"),
    I.Rule("archive", ("**/*archive*",), "archive/{parent}/{stem}", type="Source"),
    I.Rule("notes", ("**/*.md",), "{dir}/{stem}", kebab=True, type="Concept"),
)


def _glob_sql(c: str, g: str) -> str:
    return f"regexp_matches({c}, '{glob_regex(g)}')"


_RULE_SQL = "case " + " ".join(f"when {' or '.join(_glob_sql('src', g) for g in r.match)} then '{r.name}'" for r in RULES) + " end"


@query(f"select distinct note_id, {_RULE_SQL} as rule from source_note")
def flt_11_rule_globs(spark, d):
    """The first rule whose glob matches the source path (JOIN-13)."""
    names = F.array(*[F.lit(r.name) for r in RULES])
    return table(spark, d, "source_note").select("note_id", F.get(names, I.first_rule(F.col("src"), RULES)).alias("rule")).distinct()


def _sources(spark, d):
    n = table(spark, d, "source_note").select("src", F.octet_length(F.coalesce("body", F.lit(""))).cast("long").alias("size"), "problem").distinct()
    return n


def _plan(spark, d):
    return I.plan(_sources(spark, d), RULES, exclude=("hollow/**",), into="inbox")


@query(
    f"""with s as (select distinct src, problem from source_note where not regexp_matches('/' || src, '/[.]')),
  r as (select src, problem, {_RULE_SQL} as rule from s)
  select src, rule, case when starts_with(src, 'hollow/') then 'excluded' when problem is not null then problem when not ends_with(lower(src), '.md') then 'attachment' when rule is null then 'no rule matches' when rule = 'drop' then 'left out by a rule' else '' end as reason from r"""
)
def imp_01_plan(spark, d):
    """What happens to each note, by which rule and why."""
    return _plan(spark, d).select("src", F.when(F.col("note"), F.col("rule")).alias("rule"), "reason").distinct()


@query(f"select distinct src, 'inbox/journal/' || regexp_extract(src, '([^/]*)$', 1) as dest from source_note where ({_RULE_SQL}) = 'journal' and not starts_with(src, 'hollow/') and problem is null")
def str_14_template(spark, d):
    """Destinations rendered from a template."""
    return _plan(spark, d).where("rule = 'journal' and reason = ''").select("src", "dest").distinct()


@query()
def imp_01_destinations(spark, d):
    """The destination of every imported note."""
    return _plan(spark, d).where("reason = ''").select("src", "type", "dest").distinct()


@query()
def imp_03_destination_errors(spark, d):
    """Why the plan cannot be carried out as it stands (AGG-13)."""
    return I.destination_errors(_plan(spark, d).distinct(), pages(spark, d, only=("type",)).select("rel").distinct())


@query("with f as (select distinct regexp_replace(regexp_extract(src, '([^/]*)$', 1), '-.*$', '.md') as dest, src from source_note), k as (select lower(dest) as k, count(*) as n, count(distinct dest) as kinds from f group by 1 having count(*) > 1) select src, dest, case when kinds = 1 then 'several files map here' else 'differs only in case' end as error from f join k on k = lower(dest)")
def agg_13_collisions(spark, d):
    """Notes that would fall together under the first word of their names."""
    f = table(spark, d, "source_note").select("src", F.regexp_replace(name_of(F.col("src")), "-.*$", ".md").alias("dest")).distinct().select("src", "dest", F.lit(True).alias("note"), F.lit("").alias("reason"))
    none = pages(spark, d, only=("type",)).select("rel").limit(0)
    return I.destination_errors(f, none).where(F.col("error").isin("several files map here", "differs only in case"))


_NAMES = "regexp_replace(regexp_replace(regexp_replace(url_decode(split_part(target, '#', 1)), '^([.]{1,2}/)+', ''), '^/+', ''), '[.]md$', '')"


@query(
    P_SQL
    + f""", w as (select distinct {_NAMES} as name, case when contains(rel, '/') then regexp_replace(rel, '/[^/]*$', '') else '' end as folder from page_link where ends_with(split_part(target, '#', 1), '.md') and not contains(target, ':')),
  fl as (select distinct rel, string_split(replace(lower(rel), 'ß', 'ss'), '/') as p from page),
  fo0 as (select rel, unnest([array_to_string(p[i:], '/') for i in range(1, len(p) + 1)]) as form from fl),
  fo as (select rel, form from fo0 union select rel, regexp_replace(form, '[.]md$', '') from fo0 where ends_with(form, '.md'))
  select name, w.folder, first(rel order by (case when contains(rel, '/') then regexp_replace(rel, '/[^/]*$', '') else '' end) <> w.folder, not ends_with(rel, '.md'), len(string_split(rel, '/')), rel) as rel
  from w join fo on fo.form = replace(lower(trim(name)), 'ß', 'ss') where trim(name) <> '' group by name, w.folder"""
)
def join_12_best_match(spark, d):
    """The file a name means where it stands, by any end of its path."""
    t = table(spark, d, "page_link").where(without_fragment(F.col("target")).endswith(".md") & ~F.col("target").contains(":"))
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace(percent_decode(without_fragment(F.col("target"))), r"^(\.{1,2}/)+", ""), "^/+", ""), r"\.md$", "")
    return I.resolve_names(t.select(name.alias("name"), folder_of(F.col("rel")).alias("folder")), pages(spark, d, only=("type",)).select("rel").distinct())


def _plain_sql(c: str) -> str:
    t = f"regexp_replace(regexp_replace({c}, '(?s)<!--.*?-->', '', 'g'), '(?s)%%.*?%%', '', 'g')"
    t = f"regexp_replace({t}, '!?\\[\\[(?:[^\\]|]*\\|)?([^\\]]*)\\]\\]', '\\1', 'g')"
    t = f"regexp_replace(regexp_replace({t}, '!?\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), '`|\\*\\*|__|~~', '', 'g')"
    return f"trim(regexp_replace({t}, '[\\s\\x{{0b}}\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', ' ', 'g'))"


@query(f"select distinct note_id, coalesce({_plain_sql('case when trim(h1) <> chr(39) || chr(39) then h1 end').replace('chr(39) || chr(39)', chr(39) * 2)}, {_plain_sql('case when trim(props[' + chr(39) + 'title' + chr(39) + ']) <> ' + chr(39) * 2 + ' then props[' + chr(39) + 'title' + chr(39) + '] end')}, replace(regexp_replace(regexp_extract(src, '([^/]*)$', 1), '\\.[^.]*$', ''), '___', '/')) as title from source_note")
def join_17_title_precedence(spark, d):
    """A note's title: its first heading, its property, or its file (STR-12)."""
    return table(spark, d, "source_note").select("note_id", I.title_of(F.col("h1"), F.element_at("props", F.lit("title")), F.col("src")).alias("title")).distinct()


@query()
def str_13_descriptions(spark, d):
    """The first sentence of each note."""
    return table(spark, d, "source_note").select("note_id", I.description(F.col("body")).alias("description")).distinct()


@query("select note_id, k as key, v as value from (select distinct note_id, unnest(map_entries(props), recursive := true) from source_note) t(note_id, k, v) where k not in ('summary', 'place', 'author')  union all select distinct note_id, 'creator', props['author'] from source_note where list_contains(map_keys(props), 'author') and not list_contains(map_keys(props), 'creator')")
def imp_05_properties(spark, d):
    """Properties of notes after dropping and renaming."""
    p = I.mapped_properties(F.col("props"), {"author": "creator"}, ("summary", "place"))
    return table(spark, d, "source_note").select("note_id", F.explode(p).alias("key", "value")).distinct()


@query()
def misc_10_tags(spark, d):
    """Tags of notes in kebab-case, mapped, with the rule's."""
    written = F.split(F.element_at("props", F.lit("tags")), ",")
    return table(spark, d, "source_note").select("note_id", I.page_tags(written, F.array().cast("array<string>"), {"review": "to-review"}, "storage.*", ("imported",)).alias("tags")).distinct()


@query()
def imp_04_bodies(spark, d):
    """Bodies of notes with their wikilinks converted."""
    n = table(spark, d, "source_note").select(F.col("note_id").alias("src"), "body").distinct()
    return I.converted(n, spark.createDataFrame([], "src long, name string, dest string")).select(F.col("src").alias("note_id"), F.md5(F.coalesce("body", F.lit("")).cast("binary")).alias("digest"))


# --- bibliography ----------------------------------------------------------------------------------------------------


def _items(spark, d):
    """The library's pages and the sources of all pages as items kept by entity, attribute and value."""
    lib = table(spark, d, "library_page").select("rel", "type", "title", "resource", "deleted_at").distinct().withColumn("itemID", F.xxhash64("rel"))
    values = lib.select("itemID", F.explode(F.create_map(F.lit("title"), F.col("title"), F.lit("url"), F.col("resource"))).alias("fieldName", "value")).where("value is not null")
    data = values.select("itemID", F.when(F.col("fieldName") == "title", 1).otherwise(2).alias("fieldID"), F.xxhash64("value").alias("valueID"), "value")
    word = F.element_at(F.split("title", " "), -1)
    people = lib.where("title is not null").select("itemID", F.xxhash64(word).alias("creatorID"), word.alias("lastName"))
    return {
        "itemTypes": spark.createDataFrame([(1, "page"), (2, "note")], "itemTypeID int, typeName string"),
        "items": lib.select("itemID", F.when(F.col("type") == "Source", 1).otherwise(2).alias("itemTypeID"), F.col("rel").alias("key")),
        "deletedItems": lib.where("deleted_at is not null").select("itemID"),
        "fields": spark.createDataFrame([(1, "title"), (2, "url")], "fieldID int, fieldName string"),
        "itemDataValues": data.select("valueID", "value").distinct(),
        "itemData": data.select("itemID", "fieldID", "valueID"),
        "creators": people.select("creatorID", F.lit("").alias("firstName"), "lastName").distinct(),
        "itemCreators": people.select("itemID", "creatorID", F.lit(0).alias("orderIndex")).distinct(),
    }


@query("select distinct rel as key from library_page where type = 'Source' and deleted_at is null and (title ilike '%buffer%' or regexp_extract(title, '([^ ]*)$', 1) ilike '%buffer%')")
def bib_01_item_search(spark, d):
    """Items with a text in a field or in a creator's name (SET-01, JOIN-16)."""
    return B.search_items(_items(spark, d), "Buffer")


@query("select distinct rel as key from library_page where type = 'Source' and deleted_at is null and title ilike '%e%' order by rel limit 7")
def top_09_limited_search(spark, d):
    return B.search_items(_items(spark, d), "e", limit=7)


@query("select distinct rel as key, title, resource as url, regexp_extract(title, '([^ ]*)$', 1) as creator from library_page where type = 'Source' and deleted_at is null")
def bib_02_records(spark, d):
    """Items put together from their fields and creators (JOIN-15)."""
    r = B.item_records(_items(spark, d))
    return r.select("key", F.col("fields")["title"].alias("title"), F.col("fields")["url"].alias("url"), F.get("creators", F.lit(0)).alias("creator"))


@query("select distinct rel as key, title, coalesce(case when regexp_matches(resource, '^https?://') then resource end, 'zotero://select/library/items/' || rel) as resource from library_page where type = 'Source' and deleted_at is null")
def bib_03_page_frontmatter(spark, d):
    """The metadata of an item's page."""
    return B.page_frontmatter(B.item_records(_items(spark, d))).select("key", "title", "resource")


@query("select distinct rel, lower(regexp_extract(resource, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) as scheme, regexp_matches(resource, '^https?://[^/ ]+') as web from bundle_page where resource is not null and deleted_at is null")
def misc_08_references(spark, d):
    """Scheme of references, and whether they are usable web addresses."""
    scheme, _, web = B.reference_parts(F.col("resource"))
    return table(spark, d, "bundle_page").where(F.col("resource").isNotNull() & F.col("deleted_at").isNull()).select("rel", scheme.alias("scheme"), web.alias("web")).distinct()


@query("select distinct actor, case when regexp_matches(trim(regexp_replace(actor, '\\[[^\\]]*\\]\\s*$', '')), '^(human:[a-z0-9._-]+|process:[a-z0-9._-]+|[A-Za-z0-9._-]+/[A-Za-z0-9._:-]+)$') then trim(regexp_replace(actor, '\\[[^\\]]*\\]\\s*$', '')) end as valid from import_mapping")
def misc_02_actors(spark, d):
    return table(spark, d, "import_mapping").select("actor", B.actor(F.col("actor")).alias("valid")).distinct()


# --- the smaller functions -------------------------------------------------------------------------------------------

_BLANKS = "\\s\\x{0b}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"


@query(P_SQL + f"select distinct title, regexp_replace(regexp_replace(lower(trim(title)), '[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Nl}}\\p{{Pc}}{_BLANKS}-]', '', 'g'), '[{_BLANKS}]', '-', 'g') as anchor from page")
def str_11_anchors(spark, d):
    """Anchors of titles as headings."""
    return pages(spark, d, only=("title",)).select("title", I.heading_anchor(F.col("title")).alias("anchor")).distinct()


_SPLIT = "regexp_replace(regexp_replace(regexp_replace(k, '([a-z])([A-Z])', '\\1-\\2', 'g'), '([A-Za-z])([0-9])', '\\1-\\2', 'g'), '([0-9])([A-Za-z])', '\\1-\\2', 'g')"


@query(f"with n as (select c_name as k from customer union select s_name from supplier union select p_brand from part union select event_type || event_id from events) select k, trim(regexp_replace(lower({_SPLIT}), '[^a-z0-9]+', '-', 'g'), '-') as slug from n")
def str_15_key_slugs(spark, d):
    """Keys of letters and digits in kebab-case."""
    parts = [("customer", F.col("c_name")), ("supplier", F.col("s_name")), ("part", F.col("p_brand")), ("events", F.concat("event_type", F.col("event_id").cast("string")))]
    out = None
    for name, c in parts:
        k = table(spark, d, name).select(c.alias("k"))
        out = k if out is None else out.unionByName(k)
    return out.distinct().select("k", B.key_slug(F.col("k")).alias("slug"))


@query("select distinct o_orderdate::date::varchar as day, left(o_orderdate::date::varchar, 7) || '-00' as month, left(o_orderdate::date::varchar, 7) as month_out, 'c. ' || year(o_orderdate) as about, year(o_orderdate)::varchar as about_out from orders")
def str_16_published(spark, d):
    """Dates given in full, to the month, and about a year."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    month, about = F.concat(F.substring(day, 1, 7), F.lit("-00")), F.concat(F.lit("c. "), F.substring(day, 1, 4))
    t = table(spark, d, "orders").select(day.alias("day"), month.alias("month"), about.alias("about")).distinct()
    return t.select(B.published(F.col("day")).alias("day"), "month", B.published(F.col("month")).alias("month_out"), "about", B.published(F.col("about")).alias("about_out"))


@query("select distinct page_id, least(coalesce(deleted_at, added_at, ingested_at), timestamp '2024-06-01') as at from bundle_page")
def str_17_page_times(spark, d):
    """The time of a page by the first of three that is there, not after now."""
    now = F.lit("2024-06-01 00:00:00").cast("timestamp_ntz")
    return table(spark, d, "bundle_page").select("page_id", I.page_time(F.col("deleted_at"), F.col("added_at"), F.col("ingested_at"), now).alias("at")).distinct()


@query("select distinct relation_id, case when coalesce(text, '') <> '' and not contains(text, ']') and not regexp_matches(target, '[()\\s]') then text end as text, case when coalesce(text, '') <> '' and not contains(text, ']') and not regexp_matches(target, '[()\\s]') then target end as target from page_relation")
def txt_06_relations(spark, d):
    """Values `[text](target)` taken apart."""
    t = table(spark, d, "page_relation").select("relation_id", F.concat(F.lit(" ["), F.coalesce("text", F.lit("")), F.lit("]("), "target", F.lit(") ")).alias("value")).distinct()
    text, target = relation_parts(F.col("value"))
    return t.select("relation_id", text.alias("text"), target.alias("target"))


DENY = ("systems/NET*", "**/*alert*")


@query(P_SQL + "select distinct rel, regexp_matches(lower(rel), '^systems/net[^/]*(/|$)') or regexp_matches(lower(rel), '(^|/)[^/]*alert[^/]*(/|$)') as denied from page")
def flt_10_denied(spark, d):
    """Pages that deny globs match, themselves or by a folder above, whatever the case."""
    return pages(spark, d, only=("type",)).select("rel", denied(F.col("rel"), DENY).alias("denied")).distinct()


@query(P_SQL + "select distinct rel, case when not regexp_matches(lower(rel), '(^|/)[^/]*alert[^/]*(/|$)') then 'papers/' || rel end as inside, null::varchar as outside from page")
def misc_09_confined(spark, d):
    """Paths below a root, and the same paths led out of it."""
    deny = ("**/*alert*",)
    up = F.concat(F.lit("../"), "rel")
    return pages(spark, d, only=("type",)).select("rel", confined("papers", F.col("rel"), deny).alias("inside"), confined("papers", up, deny).alias("outside")).distinct()


_MERGE_SQL = "c as (select least(regexp_replace(a, '^/', ''), regexp_replace(b, '^/', '')) as new, greatest(regexp_replace(a, '^/', ''), regexp_replace(b, '^/', '')) as old from dup_candidate where score >= 0.9 and a is not null and b is not null), one as (select old, min(new) as new from c where old <> new group by old), mg as (select * from one where new not in (select old from one))"


@query(f"with {_MERGE_SQL}, r as (select distinct rel, key, {sql_file('target', 'rel')} as dst from page_relation where {_INTERNAL_SQL}) select distinct coalesce(x.new, r.rel) as rel, key, coalesce(y.new, r.dst) as dst from r left join mg x on x.old = r.rel left join mg y on y.old = r.dst where coalesce(x.new, r.rel) <> coalesce(y.new, r.dst)")
def misc_04_merged_relations(spark, d):
    """Relations after pages are folded into others, without those from a page to itself."""
    t = table(spark, d, "page_relation").select("rel", "key", file_path(F.col("target"), F.col("rel")).alias("dst")).where("dst is not null").distinct()
    return R.merged_relations(t, _merges(spark, d))


@query("select vault as key, string_agg(coalesce(nullif(h1, ''), problem), chr(10) || chr(10) order by note_id, coalesce(nullif(h1, ''), problem)) as text from (select distinct vault, note_id, h1, problem from source_note) where vault is not null and coalesce(nullif(h1, ''), problem) is not null group by vault")
def misc_06_full_texts(spark, d):
    """Texts put together from parts in order, each from the first place that has it."""
    n = table(spark, d, "source_note").where("vault is not null").select(F.col("vault").alias("key"), F.col("note_id").alias("ord"), F.col("h1").alias("indexed"), F.col("problem").alias("cached")).distinct()
    return B.full_text(n)


@query("select distinct rel, case when contains(rel, 'a') then regexp_extract(title, '([^ ]*)$', 1) else rel end as citekey from library_page where title is not null")
def misc_07_citation_keys(spark, d):
    """Citation keys by their own field, else from a line of another."""
    extra = F.concat(F.lit("x\nCitation Key: "), F.element_at(F.split("title", " "), -1))
    f = F.when(F.col("rel").contains("a"), F.create_map(F.lit("extra"), extra)).otherwise(F.create_map(F.lit("extra"), extra, F.lit("citationKey"), F.col("rel")))
    return table(spark, d, "library_page").where("title is not null").select("rel", f.alias("f")).select("rel", B.citation_key(F.col("f")).alias("citekey")).distinct()


@query(
    """with n as (select distinct note_id, regexp_replace(regexp_extract(src, '([^/]*)$', 1), '\\.[^.]*$', '') as stem, coalesce(props['title'], '') as title, string_split(props['tags'], ',') as own from source_note)
  select note_id, list_sort(list_distinct(list_concat(coalesce(own, []), case when lower(stem) in ('index', 'readme', 'untitled', 'note') or lower(stem) = lower(title) then [] else [stem] end))) as aliases from n"""
)
def misc_11_aliases(spark, d):
    """Aliases of notes: what they have, and the file's stem."""
    own = F.split(F.element_at("props", F.lit("tags")), ",")
    t = table(spark, d, "source_note").select("note_id", "src", "props").withColumn("t", F.coalesce(F.element_at("props", F.lit("title")), F.lit("")))
    return t.select("note_id", F.array_sort(I.page_aliases(own, F.col("src"), F.col("t"))).alias("aliases")).distinct()


@query(
    P_SQL
    + f""", im as (select distinct rel, {sql_file('target', 'rel')} as path from page_link where image and {_INTERNAL_SQL}),
  f as (select path, bool_or(rel in (select rel from page)) as shown, lower(regexp_extract(path, '[.]([^.]*)$', 1)) in {I.IMAGES} as picture from im where path is not null and not ends_with(lower(path), '.md') group by path)
  select path as src, case when shown and picture and len(path) <= 40 then '' when shown and picture then 'too large' when shown then 'linked document' else 'attachment' end as reason from f"""
)
def imp_02_attachments(spark, d):
    """Files that pages show: those that come along, and why others don't; a path's length stands for a file's size."""
    shown = table(spark, d, "page_link").where("image").select(F.col("rel").alias("src"), file_path(F.col("target"), F.col("rel")).alias("target")).where(F.col("target").isNotNull() & ~F.lower("target").endswith(".md")).distinct()
    row = lambda note, reason, size: [size.cast("long").alias("size"), F.lit(note).alias("note"), F.lit("").alias("rule"), F.lit("").alias("type"), F.lit(None).cast("string").alias("dest"), F.lit(reason).alias("reason")]
    files = shown.select(F.col("target").alias("src")).distinct().select("src", *row(False, "attachment", F.length("src")))
    notes = pages(spark, d, only=("type",)).select(F.col("rel").alias("src")).distinct().select("src", *row(True, "", F.lit(1)))
    return I.with_attachments(files.unionByName(notes), shown, 40).where("not note").select("src", "reason")


# --- changes, output -------------------------------------------------------------------------------------------------


@query("with old as (select rel, max(md5(coalesce(frontmatter, ''))) as content from bundle_page where added_at <= timestamp '2024-01-01' and (deleted_at is null or deleted_at > timestamp '2024-01-01') group by rel), new as (select rel, max(md5(coalesce(frontmatter, ''))) as content from bundle_page where added_at <= timestamp '2025-01-01' and (deleted_at is null or deleted_at > timestamp '2025-01-01') group by rel) select coalesce(n.rel, o.rel) as rel, case when n.rel is null then 'delete' else 'write' end as action from new n full join old o on n.rel = o.rel where n.content is distinct from o.content")
def snk_01_changed_files(spark, d):
    """What a writer has to write and delete."""
    at = lambda t: _snapshot(spark, d, t).withColumnRenamed("digest", "content")
    return changed_files(at(T1), at(T0)).select("rel", "action")


@query("select page_id, digest_is_old from (select page_id, bool_and(ingested_at = (select max(b.ingested_at) from bundle_page b where b.page_id = a.page_id) and true) as x, count(*) > 1 as digest_is_old from bundle_page a group by page_id)")
def stm_02_reused_digests(spark, d):
    """Files whose digest of the last listing is taken over: here those that were delivered again."""
    t = table(spark, d, "bundle_page").groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.coalesce("frontmatter", F.lit(""))).alias("content"))
    listing = t.select(F.col("page_id").cast("string").alias("path"), F.lit(1).alias("mtime"), F.length("content").alias("size"), "content")
    known = t.where("n > 1").select(F.col("page_id").cast("string").alias("path"), F.lit(1).alias("mtime"), F.length("content").alias("size"), F.lit("old").alias("digest"))
    return reuse_digests(listing, known, F.md5).select(F.col("path").cast("long").alias("page_id"), F.col("reused").alias("digest_is_old"))


@query("select distinct link_id, '* [' || replace(replace(replace(text, '\\', '\\\\'), '[', '\\['), ']', '\\]') || ']' as entry from page_link where text is not null")
def str_20_entries(spark, d):
    """Texts of links escaped for an index entry."""
    return table(spark, d, "page_link").where("text is not null").select("link_id", F.concat(F.lit("* ["), escape_entry(F.col("text")), F.lit("]")).alias("entry")).distinct()


@query("select distinct page_id, md5(coalesce(frontmatter, '')) as md5, sha256(coalesce(frontmatter, '')) as sha256 from bundle_page")
def str_19_hashes(spark, d):
    """Digests of contents."""
    c = F.coalesce("frontmatter", F.lit("")).cast("binary")
    return table(spark, d, "bundle_page").select("page_id", F.md5(c).alias("md5"), F.sha2(c, 256).alias("sha256")).distinct()


@query(
    """with p as (select page_id, any_value(frontmatter) as fm from bundle_page group by page_id)
  select doc_id, fm is not null as has_frontmatter, case when fm is null then 0 else 3 end as body_line, md5(coalesce(case when fm is null then ltrim(text, chr(65279)) else text end, '')) as body_digest, case when json_valid(fm) then json_type(fm) = 'OBJECT' and not regexp_matches(fm, '\\\\u[dD][89a-fA-F]') else false end as readable
  from documents left join p on page_id = doc_id"""
)
def src_04_documents(spark, d):
    """Whole files put together from frontmatter and body, and read again as YAML, which has no escapes of surrogate pairs: such frontmatter is an error."""
    fm = table(spark, d, "bundle_page").groupBy(F.col("page_id").alias("doc_id")).agg(F.max("frontmatter").alias("fm"))
    t = table(spark, d, "documents").join(fm, "doc_id", "left")
    whole = F.concat(F.when(F.col("fm").isNull(), "").otherwise(F.concat(F.lit("---\n"), "fm", F.lit("\n---\n"))), F.coalesce("text", F.lit("")))
    got = parse_texts(t.select("doc_id", whole.alias("whole")), "whole", ["doc_id"])
    readable = F.coalesce(F.get_json_object("frontmatter", "$").startswith("{") & (F.col("frontmatter") != "{}"), F.lit(False))
    return got.select("doc_id", "has_frontmatter", "body_line", F.md5(F.col("body").cast("binary")).alias("body_digest"), readable.alias("readable"))


@query()
def src_11_html(spark, d):
    """Texts wrapped as HTML and read back."""
    t = table(spark, d, "documents").select("doc_id", F.concat(F.lit("<p>"), F.regexp_replace(F.coalesce("text", F.lit("")), "[<&>]", " "), F.lit("</p><script>no</script>")).alias("html"))
    return t.select("doc_id", F.md5(html_text("html").cast("binary")).alias("digest"))


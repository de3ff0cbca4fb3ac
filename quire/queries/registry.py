"""The registry of the core queries and their SQL, and the building blocks of that SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# --- SQL building blocks ---------------------------------------------------------------------------------------------

FOLDER_SQL = "case when contains({r}, '/') then regexp_replace({r}, '/[^/]*$', '') else '' end"


def sql_path(target: str, rel: str) -> str:
    """The bundle path of an internal page reference, or null."""
    p = f"url_decode(split_part({target}, '#', 1))"
    folder = FOLDER_SQL.format(r=rel)
    whole = f"case when starts_with({p}, '/') then substr({p}, 2) when {folder} = '' then {p} else {folder} || '/' || {p} end"
    n = f"regexp_replace(regexp_replace(regexp_replace({whole}, '/(\\./)+', '/', 'g'), '^(\\./)+', ''), '/+', '/', 'g')"
    for _ in range(8):
        n = f"regexp_replace({n}, '(^|/)([^/.][^/]*|\\.[^/.][^/]*|\\.\\.[^/]+)/\\.\\./', '\\1')"
    inside = f"not regexp_matches({target}, '^[A-Za-z][A-Za-z0-9+.-]*:') and not starts_with({target}, '//') and not starts_with({target}, '#') and ends_with({p}, '.md')"
    return f"case when {inside} and not regexp_matches({n}, '^\\.\\.(/|$)') then {n} end"


def sql_file(target: str, rel: str) -> str:
    """The path of the file or folder an internal reference names, or null."""
    p = f"url_decode(split_part({target}, '#', 1))"
    folder = FOLDER_SQL.format(r=rel)
    whole = f"case when starts_with({p}, '/') then substr({p}, 2) when {folder} = '' then {p} else {folder} || '/' || {p} end || '/'"
    n = f"regexp_replace(regexp_replace(regexp_replace({whole}, '/(\\./)+', '/', 'g'), '^(\\./)+', ''), '/+', '/', 'g')"
    for _ in range(8):
        n = f"regexp_replace({n}, '(^|/)([^/.][^/]*|\\.[^/.][^/]*|\\.\\.[^/]+)/\\.\\./', '\\1')"
    inside = f"not regexp_matches({target}, '^[A-Za-z][A-Za-z0-9+.-]*:') and not starts_with({target}, '//') and not starts_with({target}, '#') and split_part({target}, '#', 1) <> ''"
    return f"case when {inside} and not regexp_matches({n}, '^\\.\\.(/|$)') then trim({n}, '/') end"


_STEM = "replace(regexp_replace(regexp_extract(rel, '([^/]*)$', 1), '\\.[^.]*$', ''), '-', ' ')"
#: A file's stem in sentence case.
STEM_SQL = f"upper(left({_STEM}, 1)) || lower(substr({_STEM}, 2))"
PAGE_SQL = f"""
page0 as (select distinct page_id, rel, type, title, description, tags, aliases, status, resource, added_at from bundle_page where deleted_at is null
  union all select null, rel, type, title, null, null, null, null, resource, added_at from library_page where deleted_at is null),
page as (select rel, {FOLDER_SQL.format(r="rel")} as folder, nullif(trim(type), '') as type, coalesce(nullif(trim(regexp_replace(title, '\\s+', ' ', 'g')), ''), {STEM_SQL}) as title,
  coalesce(trim(regexp_replace(description, '\\s+', ' ', 'g')), '') as description, tags, aliases, coalesce(status, 'stable') as status, resource, added_at from page0),
scoped as (select * from page where type is not null and type <> 'Template' and regexp_extract(rel, '([^/]*)$', 1) not in ('index.md', 'log.md')
  and not regexp_matches('/' || folder, '/[_.]')),
known as (select distinct rel, type from scoped where split_part(rel, '/', 1) <> 'journal'),
linking as (select distinct rel from page where regexp_extract(rel, '([^/]*)$', 1) <> 'index.md' and coalesce(type, '') <> 'Template' and not regexp_matches('/' || folder, '/[_.]')),
existing as (select rel as dst from page union select unnest(list_transform(range(0, len(string_split(rel, '/'))), lambda n: array_to_string(string_split(rel, '/')[1:n], '/'))) from page)
"""
LINKS_SQL = f"""
link as (select * from (select distinct link_id, rel as src, {sql_path("target", "rel")} as dst from page_link) where dst is not null),
relation as (select * from (select distinct relation_id, rel as src, key, {sql_path("target", "rel")} as dst from page_relation) where dst is not null)
"""
FILES_SQL = f"""
flink as (select * from (select distinct link_id, rel as src, {sql_file("target", "rel")} as dst, target from page_link) where dst is not null),
counting as (select * from flink where src <> dst and src in (select rel from linking) and regexp_extract(src, '([^/]*)$', 1) <> 'log.md')
"""
EDGES_SQL = """
ref as (select src, dst from link union select src, dst from relation),
typed as (select r.src, r.dst, d.type as dst_type from ref r join known s on s.rel = r.src and s.type <> 'Source' join known d on d.rel = r.dst where r.src <> r.dst),
edge as (select src, dst from typed where dst_type <> 'Source'),
node as (select * from known where type <> 'Source')
"""
GRAPH_SQL = f"with {PAGE_SQL}, {LINKS_SQL}, {EDGES_SQL} "
P_SQL = f"with {PAGE_SQL} "

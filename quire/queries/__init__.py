"""All core queries and their SQL."""

from quire.queries import problems, reference, registry, site, work  # noqa: F401

FLAGSHIP = "rpt_01_health"
QUERIES = {**problems.QUERIES, **registry.QUERIES}

_P3 = "with " + ", ".join(
    f"r{i} as (select distinct '{t}' as ref_table, {k} as ref_id, seen_at, {registry.sql_path('target', 'rel')} as path from {t})"
    for i, (t, k) in enumerate((("page_link", "link_id"), ("page_relation", "relation_id"), ("ref_def", "refdef_id")))
)
_P3 += """, ref as (from r0 union all from r1 union all from r2),
life as (select rel, added_at, deleted_at from bundle_page union select rel, added_at, deleted_at from library_page),
found as (select ref_table, ref_id, strftime(seen_at, '%Y-%m') as period,
  case when not exists (select 1 from life where rel = path) then 'missing' when exists (select 1 from life where rel = path and added_at <= seen_at) then 'deleted' else 'late' end as state
  from ref where path is not null and not exists (select 1 from life where rel = path and added_at <= seen_at and (deleted_at is null or seen_at < deleted_at)))
"""
SQL = {
    **registry.SQL,
    **problems.SQL,
    "p3_found": _P3 + "select * from found",
    "p3_by_period": _P3 + "select ref_table, period, state, count(*) as n_refs from found group by all",
}

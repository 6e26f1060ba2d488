"""Problem 3: references to records that do not exist."""

from __future__ import annotations

from graphloom.functions.keys import SPACE
from graphloom.operators.references import missing_references, orphan_report
from graphloom.plans.registry import CORE
from graphloom.session import table

_FAILED = """
with rec as (
  select nullif(lower(trim(guid, '@WS')), '') as guid, nullif(lower(trim(id_self, '@WS')), '') as id, status, recorded_at from item
  union all
  select nullif(lower(trim(guid, '@WS')), ''), nullif(lower(trim(id_self, '@WS')), ''), status, recorded_at from register_entry),
ranked as (
  select *, row_number() over (partition by guid order by recorded_at desc nulls last, status desc nulls last, id desc nulls last) as n,
         min(recorded_at) over (partition by guid) as since
  from rec where guid is not null),
held as (select guid, id, coalesce(lower(trim(status, '@WS')) = 'deleted', false) as deleted, since from ranked where n = 1),
keys as (select 'g' as kind, guid as key, deleted, since from held union all select 'i', id, deleted, since from held where id is not null),
known as (select kind, key, bool_and(deleted) as deleted, min(case when not deleted then since end) as since from keys group by 1, 2),
ref as (
  select ord, 'guid_source' as field, 'g' as kind, nullif(lower(trim(guid_source, '@WS')), '') as key, recorded_at as seen from edge
  union all select ord, 'guid_target', 'g', nullif(lower(trim(guid_target, '@WS')), ''), recorded_at from edge
  union all select ord, 'id_target', 'i', nullif(lower(trim(id_target, '@WS')), ''), recorded_at from edge),
failed as (
  select ord, field, ref.key, seen,
         case when known.key is null then 'missing' when deleted then 'deleted' when since > seen then 'late' end as reason
  from ref left join known on ref.kind = known.kind and ref.key = known.key where ref.key is not null)
""".replace("@WS", SPACE)


def _failed(spark, folder):
    return missing_references(table(spark, folder, "edge"), table(spark, folder, "item"), table(spark, folder, "register_entry"))


@CORE.add("p3_found", _FAILED + "select ord, field, reason from failed where reason is not null")
def p3_found(spark, folder):
    return _failed(spark, folder).select("ord", "field", "reason")


@CORE.add(
    "p3_report",
    _FAILED
    + """select split_part(key, '_', 1) as "table", field, strftime(seen, '%Y-%m') as month, reason,
         count(*) as n_reference, count(distinct key) as n_key
         from failed where reason is not null group by 1, 2, 3, 4""",
)
def p3_report(spark, folder):
    return orphan_report(_failed(spark, folder))

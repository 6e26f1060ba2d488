"""Assurance queries: requirements of the fact tables, their gaps and what they rest on."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions.keys import key
from graphloom.operators import assurance as A
from graphloom.plans.facts import database, over_facts
from graphloom.plans.registry import CORE
from graphloom.session import table

_PROJECTED = """r as (select i.guid, i.id_self, i.status, coalesce(p.description, '') <> '' as has_criteria, case when coalesce(p.brief, '') <> '' then 'test' end as verification,
    case when i.ord % 5 = 0 then 'evidential' else 'design' end as claim, i.ord % 11 = 0 as demands_verdict
    from item_f i join (select guid, brief, description, row_number() over (partition by guid order by recorded_at desc nulls last, status desc nulls last, id_self desc nulls last, location desc nulls last, ord desc) as n from item) p on p.guid = i.guid and p.n = 1 where i.prefix = 'req'),
  up as (select guid_source as guid, count(distinct guid_target) as n from edge_f where id_relation = 'r_derives_from' group by 1),
  down as (select guid_target as guid, count(distinct guid_source) as n from edge_f where id_relation = 'r_derives_from' and guid_source in (select guid from r) group by 1),
  impl as (select guid_target as guid, count(distinct guid_source) as n from edge_f where id_relation = 'r_implements' group by 1),
  v as (select distinct guid_target as guid, guid_source as other from edge_f where id_relation = 'r_verifies' and guid_target in (select guid from r)),
  busy as (select other, count(*) > 1 as busy from v group by 1),
  ver as (select v.guid, count(*) as n, bool_and(busy) as shared from v join busy using (other) group by 1),
  p as (select r.*, coalesce(up.n, 0) as n_derives, coalesce(down.n, 0) as n_child, coalesce(impl.n, 0) as n_implemented, coalesce(ver.n, 0) as n_verified, coalesce(shared, false) as shared, coalesce(down.n, 0) = 0 as is_leaf
    from r left join up on up.guid = r.guid left join down on down.guid = r.guid left join impl on impl.guid = r.guid left join ver on ver.guid = r.guid)"""
_GAPS = """g as (
  select guid, id_self, 'derives_from_nothing' as rule, case when status = 'accepted' then 'critical' else 'advisory' end as severity from p where coalesce(status, '') <> 'deprecated' and n_derives = 0
  union all select guid, id_self, 'no_criteria', 'critical' from p where status = 'accepted' and not has_criteria
  union all select guid, id_self, 'no_method', 'critical' from p where status = 'accepted' and verification is null
  union all select guid, id_self, 'not_implemented', case when status = 'accepted' and @W then 'critical' else 'advisory' end from p where coalesce(status, '') <> 'deprecated' and is_leaf and n_implemented = 0
  union all select guid, id_self, 'not_verified', case when status = 'accepted' and @W then 'critical' else 'advisory' end from p where coalesce(status, '') <> 'deprecated' and verification is not null and n_verified = 0
  union all select guid, id_self, 'shared_verdict', case when demands_verdict or claim = 'evidential' then 'critical' else 'advisory' end from p where coalesce(status, '') <> 'deprecated' and shared)"""
_HEAD = over_facts("select 1").rsplit("select 1", 1)[0]


def _sql(rest: str) -> str:
    return f"{_HEAD}, {_PROJECTED}{rest}"


def projected(spark, folder):
    """Requirements with attributes taken from their prose: a description is the criteria, a brief names a test."""
    db = database(spark, folder)
    rows = table(spark, folder, "item")
    last = F.max(F.struct("recorded_at", "status", "id_self", "location", "ord", "brief", "description")).alias("x")
    text = rows.groupBy(key("guid").alias("guid")).agg(last).select("guid", "x.brief", "x.description")
    r = db.item.where("prefix = 'req'").join(text, "guid")
    attributes = r.select(
        "guid",
        "id_self",
        "status",
        (F.coalesce("description", F.lit("")) != "").alias("has_criteria"),
        F.when(F.coalesce("brief", F.lit("")) != "", "test").alias("verification"),
        F.when(F.col("ord") % 5 == 0, "evidential").otherwise("design").alias("claim"),
        (F.col("ord") % 11 == 0).alias("demands_verdict"),
    )
    return A.requirements(attributes, db.edge)


@CORE.add("prj01_requirements", _sql(" select guid, id_self, status, n_derives, n_child, n_implemented, n_verified, shared, is_leaf from p"))
def prj01_requirements(spark, folder):
    return projected(spark, folder).select("guid", "id_self", "status", "n_derives", "n_child", "n_implemented", "n_verified", "shared", "is_leaf")


@CORE.add("prj02_gaps", _sql(", " + _GAPS.replace("@W", "false") + " select * from g"))
def prj02_gaps(spark, folder):
    return A.gaps(projected(spark, folder))


@CORE.add("prj02_gaps_closed_world", _sql(", " + _GAPS.replace("@W", "true") + " select * from g"))
def prj02_gaps_closed_world(spark, folder):
    return A.gaps(projected(spark, folder), closed_world=True)


@CORE.add("prj08_accept_gate", _sql(" select guid, n_derives > 0 and has_criteria and verification is not null and not (is_leaf and n_implemented = 0) and n_verified > 0 and not shared as may_accept from p"))
def prj08_accept_gate(spark, folder):
    return A.accept_gate(projected(spark, folder))


@CORE.add("grf08_impact_lists", over_facts("""select guid_source as guid, array_to_string(list_sort(list(distinct guid_target) filter (id_relation = 'r_implements')), ',') as implements, array_to_string(list_sort(list(distinct guid_target) filter (id_relation = 'r_verifies')), ',') as verifies
  from edge where id_relation in ('r_implements', 'r_verifies') and guid_target in (select guid from item where prefix = 'req') group by 1"""))
def grf08_impact_lists(spark, folder):
    """Requirements each item implements and verifies; SQL gives null for none."""
    db = database(spark, folder)
    out = A.impact(db.edge, db.item.where("prefix = 'req'"))
    return out.select("guid", *[F.when(F.size(c) > 0, F.concat_ws(",", c)).alias(c) for c in ("implements", "verifies")])


@CORE.add(
    "fn27_drifted",
    """with f as (select guid, arg_min(description, struct_pack(a := recorded_at, b := coalesce(description, ''))) as d from item where recorded_at is not null group by 1),
       l as (select guid, arg_max(description, struct_pack(a := recorded_at, b := coalesce(description, ''))) as d from item where recorded_at is not null group by 1),
       s as (select distinct lower(trim(guid_source)) as record, guid_target as subject from edge where id_relation = 'r_decides' and guid_target in (select guid from item))
       select s.record, case when bool_and(coalesce(f.d, '') = coalesce(l.d, '')) then 'holds' else 'stale' end as state from s join f on f.guid = s.subject join l on l.guid = s.subject group by 1""",
)
def fn27_drifted(spark, folder):
    """Decisions whose subjects' prose has changed since its first delivery."""
    rows = table(spark, folder, "item").where("recorded_at is not null")
    text = F.coalesce("description", F.lit(""))
    digest = lambda c: F.substring(F.sha2(c, 256), 1, 8)
    first = rows.groupBy("guid").agg(F.min(F.struct("recorded_at", text.alias("d"))).alias("x")).select(F.col("guid").alias("subject"), digest("x.d").alias("digest"))
    last = rows.groupBy("guid").agg(F.max(F.struct("recorded_at", text.alias("d"))).alias("x")).select(F.col("guid").alias("subject"), digest("x.d").alias("digest"))
    noted = table(spark, folder, "edge").where("id_relation = 'r_decides'").select(F.lower(F.trim("guid_source")).alias("record"), F.col("guid_target").alias("subject")).distinct().join(first, "subject")
    return A.drifted(noted.where("record is not null"), last)

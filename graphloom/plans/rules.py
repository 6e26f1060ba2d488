"""Integrity rules over the fact tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import rules as U
from graphloom.plans.assurance import _GAPS, _HEAD, _PROJECTED, projected
from graphloom.plans.facts import database, over_facts
from graphloom.plans.registry import CORE
from graphloom.session import table

RELATIONS = (
    U.Relation("r_decides", domain=("ddr", "ann", "req", "need", "obs"), range=("req", "need", "term", "ann", "obs", "icd", "evi"), least=0, most=4),
    U.Relation("r_derives_from", acyclic=True, transitive=True),
    U.Relation("r_supports", incompatible=("r_challenges",)),
)
CONSUMES = {"ddr": ("req",), "req": ("need",), "ann": ("ddr",), "need": ("obs",), "obs": ()}


def _context(spark, folder, trace: bool = False) -> U.Context:
    return U.Context(database(spark, folder), table(spark, folder, "item"), table(spark, folder, "register_entry"), RELATIONS, CONSUMES, projected(spark, folder) if trace else None)


def _cut(df):
    return df.select("guid", "path", "severity", "message")


@CORE.add(
    "chk02_identity",
    """with p as (select guid, concat_ws(' ', location, status) as location, min(ord) as ord from item where guid is not null group by 1, 2),
       q as (select *, row_number() over w as n, first_value(location) over w as f from p window w as (partition by guid order by ord, location nulls first))
       select guid, 'guid_self' as path, 'critical' as severity, concat_ws(' ', 'declared first at', f) as message from q where n > 1""",
)
def chk02_identity(spark, folder):
    """A guid's status counts with its location, since redelivered rows keep theirs."""
    c = _context(spark, folder)
    c.deliveries = c.deliveries.withColumn("location", F.concat_ws(" ", "location", "status"))
    return _cut(U.identity(c))


@CORE.add(
    "chk03_identifier",
    over_facts(
        """with form as (select guid, id_self, unnest([
             case when id_self is not null and not regexp_matches(id_self, '^[a-z]{1,8}_[a-z0-9][a-z0-9_]*(\\.[a-z0-9][a-z0-9_]*)*$') then 'id_form' end,
             case when not regexp_matches(guid, '^[a-z]{1,8}_[0-9a-f]{32}$') then 'guid_form' end,
             case when id_self is not null and split_part(id_self, '_', 1) <> split_part(guid, '_', 1) then 'prefix_pair' end]) as fault from item),
        again as (select guid, first_value(guid) over w as f, row_number() over w as n from item where id_self is not null window w as (partition by id_self order by ord, guid))
        select guid, 'id_self' as path, 'critical' as severity, fault || ' ' || coalesce(id_self, '') as message from form where fault is not null
        union all select guid, 'id_self', 'critical', 'readable id of ' || f from again where n > 1"""
    ),
)
def chk03_identifier(spark, folder):
    return _cut(U.identifier(_context(spark, folder)))


_REFERENCE = """names as (select guid as guid_target, max(id) as id from (select guid, lower(trim(id_self)) as id from item_f union all select lower(trim(guid)), lower(trim(id_self)) from register_entry) group by 1),
  e as (select edge_f.*, names.guid_target is not null as there, names.id from edge_f left join names using (guid_target))"""


@CORE.add(
    "chk05_reference",
    f"""{_HEAD}, {_REFERENCE}
    select guid_source as guid, 'relation.' || ord as path, 'advisory' as severity, 'no record ' || guid_target as message from e where not there
    union all select guid_source, 'relation.' || ord, 'advisory', 'stale id ' || id_target || ' for ' || id from e where there and id is not null and id_target is not null and id_target <> id""",
)
def chk05_reference(spark, folder):
    return _cut(U.reference(_context(spark, folder)))


@CORE.add(
    "chk06_segment",
    over_facts(
        """with consumes(a, b) as (values ('ddr', 'req'), ('req', 'need'), ('ann', 'ddr'), ('need', 'obs')), known(k) as (values ('ddr'), ('req'), ('ann'), ('need'), ('obs')),
        seen(root, node) as (select k, k from known union select seen.root, b from seen join consumes on a = node),
        own as (select guid, split_part(location, '/', 1) as seg from item where split_part(location, '/', 1) in (select k from known))
        select s.guid, 'relation.' || ord as path, 'critical' as severity, s.seg || ' does not consume ' || t.seg as message
        from edge e join own s on s.guid = e.guid_source join own t on t.guid = e.guid_target where not exists (select 1 from seen where root = s.seg and node = t.seg)""",
        True,
    ),
)
def chk06_segment(spark, folder):
    return _cut(U.segment(_context(spark, folder)))


@CORE.add(
    "chk07_rights",
    over_facts(
        """with r as (select guid, status, split_part(location, '/', 1) as seg from item), c as (select seg, status, count(*) as c from r group by 1, 2),
        m as (select seg, max(case when 2 * c > n then status end) as majority from c join (select seg, sum(c) as n from c group by 1) using (seg) group by 1)
        select guid, 'status' as path, 'critical' as severity, coalesce(status, 'none') || ' among ' || majority as message from r join m using (seg) where majority is not null and (status is null or status <> majority)"""
    ),
)
def chk07_rights(spark, folder):
    return _cut(U.rights(_context(spark, folder)))


@CORE.add("chk08_relation")
def chk08_relation(spark, folder):
    """Domain, range, cycles, redundancy, incompatibility and counts; each has a query of its own with SQL."""
    return _cut(U.relation(_context(spark, folder)))


@CORE.add("chk17_trace", f"{_HEAD}, {_PROJECTED}, {_GAPS.replace('@W', 'false')} select guid, 'requirement' as path, severity, rule as message from g")
def chk17_trace(spark, folder):
    return _cut(U.trace(_context(spark, folder, True)))


@CORE.add("agg13_report")
def agg13_report(spark, folder):
    """All rules run, summed by check."""
    found, errors = U.run(_context(spark, folder, True))
    return U.report(found, list(U.RULES), errors)

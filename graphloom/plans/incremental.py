"""Documents flattened, selected from and edited; code bodies; a small dataflow."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import nested as N
from graphloom.functions.text import path_matches, selects
from graphloom.operators import dataflow as W
from graphloom.operators import edits as E
from graphloom.plans.facts import database, over_facts
from graphloom.plans.registry import CORE
from graphloom.session import table
from graphloom.sources import tree as T


def _whole(spark, folder):
    """Whole documents, the last readable row of each location."""
    return T.last_readable(table(spark, folder, "held").where("coalesce(path, '') = ''"))


@CORE.add("fact12_leaves")
def fact12_leaves(spark, folder):
    return T.leaves(table(spark, folder, "held"))


@CORE.add("fact06_declarations")
def fact06_declarations(spark, folder):
    return T.declarations(T.leaves(table(spark, folder, "held")))


@CORE.add("fact08_references")
def fact08_references(spark, folder):
    return T.references(T.leaves(table(spark, folder, "held")))


@CORE.add("fact04_register_entries", "select guid, id_self from register_entry where prefix = 'r'")
def fact04_register_entries(spark, folder):
    return table(spark, folder, "register_entry").where("prefix = 'r'").select("guid", "id_self")


@CORE.add("fact03_index", "select id_self, guid from (select *, row_number() over (partition by id_self order by recorded_at desc nulls last, ord desc) as n from item where id_self is not null) where n = 1")
def fact03_index(spark, folder):
    rows = table(spark, folder, "item").withColumn("t", F.coalesce("recorded_at", F.lit("0001-01-01").cast("timestamp")))
    return T.indexed(rows, "id_self", "t", "ord").select("id_self", "guid")


@CORE.add("fact02_tree_facts")
def fact02_tree_facts(spark, folder):
    """Items, edges and containment of all whole documents that hold, told apart by ``fact``."""
    f = T.facts(_whole(spark, folder))
    parts = [df.withColumn("fact", F.lit(name)) for name, df in (("item", f.item), ("edge", f.edge), ("containment", f.containment))]
    return parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)


@CORE.add("fact02_tree_refused")
def fact02_tree_refused(spark, folder):
    """Items of those documents that are refused for want of a guid."""
    return T.facts(_whole(spark, folder)).refused


@CORE.add("flt01_path_match", "select location, path from held where regexp_matches(path, '^[^.]+\\.[^.]+(\\..+)?$')")
def flt01_path_match(spark, folder):
    return table(spark, folder, "held").where(path_matches("path", "*.*.**")).select("location", "path")


@CORE.add("flt02_selected")
def flt02_selected(spark, folder):
    h = table(spark, folder, "held").where("document is not null")
    return h.select("location", "path", N.selected("document", ("title", "**.guid_self"), ("**.relation",)).alias("part"))


@CORE.add("flt03_with_value")
def flt03_with_value(spark, folder):
    h = table(spark, folder, "held").where("document is not null")
    return h.select("location", "path", N.with_value("document", "status", F.lit("accepted")).alias("document"))


@CORE.add("flt05_selector", "select ord, guid from item where regexp_full_match(id_self, 'ddr_.*|req_m.*') and status in ('accepted', 'proposed')")
def flt05_selector(spark, folder):
    rows = table(spark, folder, "item").where("status in ('accepted', 'proposed')")
    return rows.where(selects("id_self", "guid", ("ddr_.*", "req_m.*"))).select("ord", "guid")


@CORE.add("sim02_bodies")
def sim02_bodies(spark, folder):
    """Function bodies of the sources at hand, as windows of four tokens."""
    return T.bodies(table(spark, folder, "definition").where("filepath like '%.py'"))


@CORE.add("src11_definitions")
def src11_definitions(spark, folder):
    return T.code(table(spark, folder, "definition").where("filepath like '%.py'"))


@CORE.add("dml05_rename", over_facts("select guid, case when id_self like 'ddr\\_binding\\_%' escape '\\' and id_self = (select min(id_self) from item where id_self like 'ddr\\_binding\\_%' escape '\\') then 'ddr_zz_renamed' else id_self end as id_self from item"))
def dml05_rename(spark, folder):
    db = database(spark, folder)
    old = db.item.where("startswith(id_self, 'ddr_binding_')").agg(F.min("id_self")).first()[0]
    f = E.Facts(db.item, db.edge, db.containment)
    return (E.rename(f, old, "ddr_zz_renamed") if old else f).item.select("guid", "id_self")


@CORE.add("dml04_unlink", over_facts("with x as (select guid_source, guid_target, id_relation from edge e where guid_source in (select guid from item) and id_relation is not null order by e.ord limit 1) select ord from edge e where not exists (select 1 from x where x.guid_source = e.guid_source and x.guid_target = e.guid_target and x.id_relation = e.id_relation)"))
def dml04_unlink(spark, folder):
    db = database(spark, folder)
    first = db.edge.where("id_relation is not null").join(db.item.select(F.col("guid").alias("guid_source")), "guid_source", "left_semi").orderBy("ord").first()
    return E.unlink(E.Facts(db.item, db.edge, db.containment), first["guid_source"], first["id_relation"], first["guid_target"]).edge.select("ord")


@CORE.add("wfl01_flow", over_facts("select prefix, count(*) as n from item where status = 'accepted' group by 1 having count(*) > 10"))
def wfl01_flow(spark, folder):
    """Filter, count, and drop small groups again until a judge is content."""
    flow = W.Flow(
        {
            "keep": W.Node(lambda x: {"rows": x["item"].where("status = 'accepted'")}, {"item": False}),
            "count": W.Node(lambda x: {"counts": x["rows"].groupBy("prefix").agg(F.count(F.lit(1)).alias("n"))}, {"rows": False}),
            "trim": W.Node(lambda x: {"counts": (x.get("again") or x["counts"]).where("n > 10")}, {"counts": False, "again": True}, {"counts": lambda d: ["unmet" if not d.where("n <= 10").isEmpty() else "met"]}),
            "end": W.Node(lambda x: {"out": x["counts"]}, {"counts": False}),
        },
        [
            W.Link("keep", "rows", "count", "rows"),
            W.Link("count", "counts", "trim", "counts"),
            W.Link("trim", "counts", "end", "counts", guard="met"),
            W.Link("trim", "counts", "trim", "again", guard="unmet", back=True),
        ],
    )
    return W.run(flow, {("keep", "item"): database(spark, folder).item}, budget=3).bound[("end", "out")]

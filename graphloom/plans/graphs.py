"""Graph queries over the fact tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions.keys import key, prefix_of
from graphloom.operators import graph as G
from graphloom.operators.facts import edge_facts, item_facts
from graphloom.plans.facts import database, over_facts
from graphloom.plans.registry import CORE
from graphloom.session import table, written

#: Relations whose target a source depends on, is responsible for, or describes; a register would flag them.
DEPENDENCY = ("r_derives_from", "r_implements")
RESPONSIBILITY = ("r_implements", "r_satisfies")
DESCRIBES = ("r_decides", "r_is_about")


def _in(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


_HUB = "(select guid_target from edge group by 1 order by count(*) desc, 1 limit 1)"
_START = "(select guid_source from edge where id_relation = 'r_decides' order by ord limit 1)"


def _hub(db):
    return db.edge.groupBy("guid_target").count().orderBy(F.desc("count"), "guid_target").first()[0]


def _start(db):
    return db.edge.where("id_relation = 'r_decides'").orderBy("ord").first()["guid_source"]


_STEPS = """select 'out' as direction, 0 as side, guid_source as a, guid_target as b, id_relation, ord from edge
            union all select 'in', 1, guid_target, guid_source, id_relation, ord from edge"""


@CORE.add(
    "grf01_walk",
    over_facts(
        f"""with step as ({_STEPS}),
        w(guid, depth) as (select {_START}, 0 union select step.b, w.depth + 1 from w join step on step.a = w.guid where w.depth < 3 and step.id_relation in ('r_decides', 'r_derives_from', 'r_satisfies')),
        best as (select guid, min(depth) as depth from w group by 1)
        select best.guid, coalesce(i.id_self, best.guid) as id_self, best.depth::int as depth from best left join item i on i.guid = best.guid""",
        True,
    ),
)
def grf01_walk(spark, folder):
    db = database(spark, folder)
    start = _start(db)
    if db.guid_of(start) is None:
        db = db.with_items(db.item.unionByName(spark.createDataFrame([(start, None, "", None, None, None)], db.item.schema)))
    return G.walk(db, start, 3, ("r_decides", "r_derives_from", "r_satisfies")).select("guid", "id_self", "depth")


@CORE.add(
    "grf01_walk_all",
    over_facts(
        f"""with step as ({_STEPS}),
        w(guid, depth) as (select {_START}, 0 union select step.b, w.depth + 1 from w join step on step.a = w.guid where w.depth < 2)
        select guid, min(depth)::int as depth from w group by 1""",
        True,
    ),
)
def grf01_walk_all(spark, folder):
    db = database(spark, folder)
    levels = G.Levels(db, _start(db))
    for _ in range(2):
        levels.grow()
    return levels.steps().select("guid", "depth")


@CORE.add("grf01_walk_steps")
def grf01_walk_steps(spark, folder):
    """A walk with the edge that reaches each item; which of several edges is fixed by order, tested apart."""
    db = database(spark, folder)
    levels = G.Levels(db, _start(db), directions=("out",))
    for _ in range(4):
        if not levels.grow():
            break
    return levels.steps()


@CORE.add(
    "grf02_path",
    over_facts(
        f"""with step as ({_STEPS}), ends as (select min(guid) as a, max(guid) as b from item),
        w(guid, depth) as (select a, 0 from ends union select step.b, w.depth + 1 from w join step on step.a = w.guid where w.depth < 6),
        hit as (select min(depth) as n from w, ends where w.guid = ends.b)
        select unnest(range(0, n + 1))::int as depth, n::int as length from hit where n is not null""",
        True,
    ),
)
def grf02_path(spark, folder):
    """Depth and length of a shortest path; several shortest ones may exist, so their items aren't compared."""
    db = database(spark, folder)
    a, b = db.item.agg(F.min("guid"), F.max("guid")).first()
    steps = written(G.path(db, a, b))
    return steps.select("depth", F.lit(steps.count() - 1).alias("length"))


@CORE.add(
    "grf03_orphan_items",
    over_facts("select guid, id_self from item i where not exists (select 1 from edge e where e.guid_target = i.guid) and not exists (select 1 from containment c where c.guid_held = i.guid)"),
)
def grf03_orphan_items(spark, folder):
    return G.orphans(database(spark, folder))[0]


@CORE.add("grf03_unused_relations", "with " + over_facts("select 1")[5:-8] + "select id_self from register_entry where prefix = 'r' and id_self not in (select distinct id_relation from edge_f)")
def grf03_unused_relations(spark, folder):
    """Register relations no edge uses, null relations and all: NOT IN against a null gives nothing."""
    db = database(spark, folder)
    return G.orphans(db.with_items(table(spark, folder, "register_entry").select("guid", "id_self", "prefix")))[1]


@CORE.add("grf03_unused_relations_stated", "with " + over_facts("select 1")[5:-8] + "select id_self from register_entry where prefix = 'r' and id_self not in (select id_relation from edge_f where id_relation is not null)")
def grf03_unused_relations_stated(spark, folder):
    """The same with nulls set aside, as a set difference [SET-02]."""
    used = database(spark, folder).edge.select(F.col("id_relation").alias("id_self"))
    return table(spark, folder, "register_entry").where("prefix = 'r'").select("id_self").subtract(used)


@CORE.add(
    "grf04_edges_among",
    over_facts(
        """with g as (select guid from item where prefix in ('ddr', 'req'))
        select coalesce(s.id_self, e.guid_source) as id_source, coalesce(t.id_self, e.guid_target) as id_target, e.id_relation
        from edge e left join item s on s.guid = e.guid_source left join item t on t.guid = e.guid_target
        where e.guid_source in (select guid from g) and e.guid_target in (select guid from g)"""
    ),
)
def grf04_edges_among(spark, folder):
    db = database(spark, folder)
    return G.edges_among(db, db.item.where("prefix in ('ddr', 'req')").select("guid"))


@CORE.add(
    "grf05_neighbourhood",
    over_facts(
        f"""with hub as (select {_HUB} as guid)
        select 'out' as side, coalesce(i.id_self, e.guid_target) as id_other, id_relation from edge e left join item i on i.guid = e.guid_target where guid_source = (select guid from hub)
        union all select 'in', coalesce(i.id_self, e.guid_source), id_relation from edge e left join item i on i.guid = e.guid_source where guid_target = (select guid from hub)"""
    ),
)
def grf05_neighbourhood(spark, folder):
    db = database(spark, folder)
    hub = _hub(db)
    if db.guid_of(hub) is None:
        db = db.with_items(db.item.unionByName(spark.createDataFrame([(hub, None, "", None, None, None)], db.item.schema)))
    out, into = G.neighbourhood(db, hub)
    a = out.select(F.lit("out").alias("side"), F.col("id_target").alias("id_other"), "id_relation")
    return a.unionByName(into.select(F.lit("in").alias("side"), F.col("id_source").alias("id_other"), "id_relation"))


@CORE.add(
    "grf06_dependency_closure",
    over_facts(
        f"""with link as (select distinct i.id_self as a, e.id_target as b from edge e join item i on i.guid = e.guid_source where e.id_relation in {_in(DEPENDENCY)} and i.id_self is not null and e.id_target is not null),
        seed as (select distinct id_self from item where prefix = 'evi' and id_self is not null),
        w(root, node) as (select id_self, id_self from seed union select w.root, link.b from w join link on link.a = w.node)
        select root, node from w""",
        True,
    ),
)
def grf06_dependency_closure(spark, folder):
    """Forward closure by readable id, unknown names kept."""
    db = database(spark, folder)
    names = db.item.select(F.col("guid").alias("guid_source"), F.col("id_self").alias("a")).where("a is not null")
    links = db.edge.where(F.col("id_relation").isin(*DEPENDENCY)).join(names, "guid_source").select("a", F.col("id_target").alias("b"))
    seeds = db.item.where("prefix = 'evi' and id_self is not null").select(F.col("id_self").alias("root"), F.col("id_self").alias("node"))
    return G.reach(links, seeds).select("root", "node")


@CORE.add(
    "grf07_changed_dependents",
    over_facts(
        f"""with link as (select distinct guid_target as a, guid_source as b from edge where id_relation in {_in(DEPENDENCY)}),
        seed as (select guid from item where status = 'deprecated'),
        w(root, node, depth) as (select guid, guid, 0 from seed union select w.root, link.b, w.depth + 1 from w join link on link.a = w.node where w.depth < 40),
        d as (select node, min(depth) as depth from w group by 1)
        select node as guid, depth::int as depth from d where depth > 0""",
        True,
    ),
)
def grf07_changed_dependents(spark, folder):
    """What depends on changed items, each once at its least distance; the changed ones themselves left out [SET-03]."""
    db = database(spark, folder)
    links = db.edge.where(F.col("id_relation").isin(*DEPENDENCY)).select(F.col("guid_target").alias("a"), F.col("guid_source").alias("b"))
    changed = db.item.where("status = 'deprecated'").select(F.lit("changed").alias("root"), F.col("guid").alias("node"))
    return G.reach(links, changed).where("depth > 0").select(F.col("node").alias("guid"), "depth")


@CORE.add(
    "grf08_impact",
    over_facts(
        """select c.guid, e.id_relation, count(distinct e.guid_target) as n_requirement from item c join edge e on e.guid_source = c.guid join item r on r.guid = e.guid_target and r.prefix = 'req'
        where e.id_relation in ('r_implements', 'r_verifies') group by 1, 2"""
    ),
)
def grf08_impact(spark, folder):
    """For each item, the requirements it implements and verifies."""
    db = database(spark, folder)
    requirement = db.item.where("prefix = 'req'").select(F.col("guid").alias("guid_target"))
    e = db.edge.where("id_relation in ('r_implements', 'r_verifies')").join(requirement, "guid_target", "left_semi")
    return e.join(db.item.select(F.col("guid").alias("guid_source")), "guid_source", "left_semi").groupBy(F.col("guid_source").alias("guid"), "id_relation").agg(F.countDistinct("guid_target").alias("n_requirement"))


_LEVELS = "select guid, 'safety' as dimension, (ord % 4)::int as level from item where prefix = 'req' union all select guid, 'effort', (ord % 3)::int from item where prefix in ('req', 'need')"


@CORE.add(
    "grf09_criticality",
    over_facts(
        f"""with lev as ({_LEVELS}), link as (select distinct guid_source as a, guid_target as b from edge where id_relation in {_in(RESPONSIBILITY)}),
        w(node, dimension, level) as (select link.b, dimension, level from lev join link on link.a = lev.guid union select link.b, w.dimension, w.level from w join link on link.a = w.node)
        select node as guid, dimension, max(level) as level from w group by 1, 2""",
        True,
    ),
)
def grf09_criticality(spark, folder):
    db = database(spark, folder)
    safety = db.item.where("prefix = 'req'").select(F.col("guid").alias("node"), F.lit("safety").alias("dimension"), (F.col("ord") % 4).cast("int").alias("level"))
    effort = db.item.where("prefix in ('req', 'need')").select(F.col("guid").alias("node"), F.lit("effort").alias("dimension"), (F.col("ord") % 3).cast("int").alias("level"))
    links = db.edge.where(F.col("id_relation").isin(*RESPONSIBILITY)).select(F.col("guid_source").alias("a"), F.col("guid_target").alias("b"))
    return G.propagate(links, safety.unionByName(effort)).withColumnRenamed("node", "guid")


@CORE.add(
    "grf10_cycle_members",
    over_facts(
        """with link as (select distinct guid_holder as a, guid_held as b from containment),
        w(root, node) as (select a, b from link union select w.root, link.b from w join link on link.a = w.node)
        select distinct root as guid from w where root = node""",
        True,
    ),
)
def grf10_cycle_members(spark, folder):
    """Items of containment on a cycle; each has one holder, so what peeling leaves is the cycles alone."""
    c = database(spark, folder).containment
    return G.on_cycles(c.select(F.col("guid_holder").alias("a"), F.col("guid_held").alias("b"))).select(F.col("a").alias("guid")).distinct()


@CORE.add("grf10_relation_cycles")
def grf10_relation_cycles(spark, folder):
    """Links of acyclic relations on or between cycles."""
    e = database(spark, folder).edge.where(F.col("id_relation").isin(*DEPENDENCY))
    return G.on_cycles(e.select(F.col("guid_source").alias("a"), F.col("guid_target").alias("b")))


@CORE.add(
    "grf11_redundant",
    over_facts(
        """with link as (select distinct guid_source as a, guid_target as b from edge where id_relation in ('r_derives_from', 'r_satisfies', 'r_implements') and guid_source <> guid_target),
        w(a, via, node) as (select a, b, b from link union select w.a, w.via, link.b from w join link on link.a = w.node)
        select distinct link.a, link.b from link join w on w.a = link.a and w.node = link.b and w.via <> link.b""",
        True,
    ),
)
def grf11_redundant(spark, folder):
    e = database(spark, folder).edge.where("id_relation in ('r_derives_from', 'r_satisfies', 'r_implements')")
    return G.redundant(e.select(F.col("guid_source").alias("a"), F.col("guid_target").alias("b")))


@CORE.add(
    "grf12_prefix_reach",
    over_facts(
        """with link as (select distinct s.prefix as a, split_part(e.id_target, '_', 1) as b from edge e join item s on s.guid = e.guid_source where e.id_relation = 'r_replaces' and e.id_target is not null),
        w(root, node) as (select prefix, prefix from (select distinct prefix from item) union select w.root, link.b from w join link on link.a = w.node)
        select root, node from w""",
        True,
    ),
)
def grf12_prefix_reach(spark, folder):
    """Reflexive reach between types over one relation, as segments reach what they consume [GRF-12, GRF-13]."""
    db = database(spark, folder)
    names = db.item.select(F.col("guid").alias("guid_source"), F.col("prefix").alias("a"))
    links = db.edge.where("id_relation = 'r_replaces' and id_target is not null").join(names, "guid_source").select("a", prefix_of("id_target").alias("b"))
    return G.reach(links, db.item.select(F.col("prefix").alias("root"), F.col("prefix").alias("node"))).select("root", "node")


@CORE.add(
    "grf14_levels",
    over_facts(
        """with link as (select distinct guid_source as a, guid_target as b from edge where id_relation = 'r_derives_from'),
        node as (select a as n from link union select b from link),
        bad(n) as (select a from link where a = b union select distinct l.b from link l join bad on bad.n = l.a),
        w(n, level) as (select n, 0 from node where n not in (select b from link) union select link.b, w.level + 1 from w join link on link.a = w.n where w.level < 60)
        select n as node, max(level)::int as level from w group by 1 having max(level) < 60""",
        True,
    ),
)
def grf14_levels(spark, folder):
    """Longest chain that ends at each item; items on or behind cycles have none."""
    e = database(spark, folder).edge.where("id_relation = 'r_derives_from'")
    links = e.select(F.col("guid_source").alias("a"), F.col("guid_target").alias("b"))
    return G.topological_levels(links.select(F.explode(F.array("a", "b")).alias("node")), links)


@CORE.add(
    "grf16_opened_view",
    over_facts(
        """with link as (select distinct guid_holder as a, guid_held as b from containment),
        top as (select distinct a from link where a not in (select b from link)),
        w(path, node, depth) as (select [a], a, 0 from top union all select list_append(w.path, link.b), link.b, w.depth + 1 from w join link on link.a = w.node where w.depth < 3 and not list_contains(w.path, link.b))
        select array_to_string(path, '/') as path, node, depth::int as depth, exists (select 1 from link l where l.a = w.node and not list_contains(w.path, l.b)) as has_child from w""",
        True,
    ),
)
def grf16_opened_view(spark, folder):
    c = database(spark, folder).containment.select(F.col("guid_holder").alias("a"), F.col("guid_held").alias("b"))
    top = c.select(F.col("a").alias("node")).distinct().join(c.select(F.col("b").alias("node")), "node", "left_anti")
    return G.expanded(c, top, 3).withColumn("path", F.concat_ws("/", "path"))


@CORE.add(
    "grf17_describers",
    over_facts(f"select guid_target as guid, array_to_string(list_sort(list(distinct guid_source)), ',') as records from edge where id_relation in {_in(DESCRIBES)} group by 1"),
)
def grf17_describers(spark, folder):
    return G.describers(database(spark, folder).edge, list(DESCRIBES)).withColumn("records", F.concat_ws(",", "records"))


@CORE.add(
    "grf20_rename_cascade",
    over_facts(
        """select id_self, split_part(id_self, '_', 1) || '_zz_moved' || substr(id_self, length(split_part(id_self, '_', 1)) + 2 + length('mark_open_reading') - length('mark_')) as id_new
        from (select distinct id_target as id_self from edge where id_target is not null) where id_self = 'mark_open_reading' or substr(id_self, length(split_part(id_self, '_', 1)) + 2) like 'open\\_reading.%' escape '\\'"""
    ),
)
def grf20_rename_cascade(spark, folder):
    names = database(spark, folder).edge.select(F.col("id_target").alias("id_self")).where("id_self is not null")
    return G.renamed(names, "mark_open_reading", "mark_zz_moved")


@CORE.add(
    "grf_components",
    over_facts(
        """with link as (select guid_holder as a, guid_held as b from containment where guid_holder <> guid_held),
        step as (select a, b from link union select b, a from link),
        w(node, other) as (select a, a from step union select w.node, step.b from w join step on step.a = w.other)
        select node, min(other) as component from w group by 1""",
        True,
    ),
)
def grf_components(spark, folder):
    c = database(spark, folder).containment
    return G.components(c.select(F.col("guid_holder").alias("a"), F.col("guid_held").alias("b")))

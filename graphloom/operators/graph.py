"""Graph operators: bounded walks, paths, closures, propagation, cycles.

Each is a loop of joins over DataFrames. What a round adds is written to
the shared folder, so plans stay short and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.facts import FactDatabase, labelled
from graphloom.operators.order import numbered
from graphloom.session import forget, rows_in, written

#: Levels of up to so many items are put in order by one task; larger ones by range.
SMALL = 200_000


def adjacency(edge: DataFrame, relations: tuple[str, ...] = (), directions: tuple[str, ...] = ("out", "in")) -> DataFrame:
    """(guid_from, guid, id_relation, side, ord): edges as seen from either end; no relations means all."""
    if relations:
        edge = edge.where(F.col("id_relation").isin(*relations))
    sides = {"out": ("guid_source", "guid_target", 0), "in": ("guid_target", "guid_source", 1)}
    out = None
    for d in directions:
        a, b, k = sides[d]
        part = edge.select(F.col(a).alias("guid_from"), F.col(b).alias("guid"), "id_relation", F.lit(k).alias("side"), "ord")
        out = part if out is None else out.unionByName(part)
    return out


class Levels:
    """Breadth-first levels from one item; each a written table (guid, pos, guid_from, id_relation, side, ord)."""

    def __init__(self, db: FactDatabase, start: str, relations: tuple[str, ...] = (), directions: tuple[str, ...] = ("out", "in"), adjacent: DataFrame | None = None) -> None:
        spark = db.spark
        first = spark.createDataFrame([(start, 0, None, None, None, None)], "guid string, pos bigint, guid_from string, id_relation string, side int, ord bigint")
        self.levels = [first]
        self.seen = first.select("guid")
        self.adjacent = written(adjacency(db.edge, relations, directions)) if adjacent is None else adjacent

    def grow(self, only: DataFrame | None = None) -> bool:
        """Add the next level, of the items ``only`` (guid) if given; false when there is none.

        A new item keeps the edge that reaches it first: by its
        predecessor's place, then out before in, then edge order.
        """
        front = self.levels[-1].select(F.col("guid").alias("guid_from"), F.col("pos").alias("from_pos"))
        met = self.adjacent.join(front, "guid_from").join(self.seen, "guid", "left_anti")
        met = met if only is None else met.join(only, "guid", "left_semi")
        best = met.groupBy("guid").agg(F.min(F.struct("from_pos", "side", "ord", "guid_from", "id_relation")).alias("x"))
        rows = best.select("guid", "x.from_pos", "x.guid_from", "x.id_relation", "x.side", "x.ord")
        order = ("from_pos", "side", "ord", "guid")
        rows = written(rows)
        if not rows_in(rows):
            forget(rows)
            return False
        if rows_in(rows) <= SMALL:
            level = rows.withColumn("pos", F.row_number().over(Window.orderBy(*order)) - 1)
        else:
            level = numbered(rows, *order)
        level = level.select("guid", F.col("pos").cast("long").alias("pos"), "guid_from", "id_relation", "side", "ord")
        self.levels.append(level)
        self.seen = self.seen.unionByName(level.select("guid"))
        return True

    def steps(self) -> DataFrame:
        """(depth, guid, guid_from, id_relation, direction, pos) of every item reached."""
        out = None
        for d, level in enumerate(self.levels):
            side = F.when(F.col("side") == 0, "out").when(F.col("side") == 1, "in")
            part = level.select(F.lit(d).alias("depth"), "guid", "guid_from", "id_relation", side.alias("direction"), "pos")
            out = part if out is None else out.unionByName(part)
        return out


def walk(db: FactDatabase, name: str, depth: int = 1, relations: tuple[str, ...] = (), directions: tuple[str, ...] = ("out", "in")) -> DataFrame | None:
    """Items within ``depth`` edges of the named one, each once at its least depth [GRF-01].

    Columns depth, id_self, guid, id_from, id_relation, direction, pos; the
    item itself comes first with nulls. Targets that are no items are shown
    by guid. An unknown name gives None, which is not an empty walk.
    """
    start = db.guid_of(name)
    if start is None:
        return None
    levels = Levels(db, start, relations, directions)
    for _ in range(depth):
        if not levels.grow():
            break
    steps = labelled(levels.steps(), db.item, "guid", "id_self")
    return labelled(steps, db.item, "guid_from", "id_from").select("depth", "id_self", "guid", "id_from", "id_relation", "direction", "pos")


def _between(adjacent: DataFrame, a: str, b: str) -> list[DataFrame] | None:
    """Of two items, for each distance from the first, the items on shortest paths between them; None when they aren't connected.

    Searches from both ends at once, each time from the end whose outermost
    level is smaller, until the two meet; then keeps only what lies between.
    """
    spark = adjacent.sparkSession
    rings = [[spark.createDataFrame([(x,)], "guid string")] for x in (a, b)]
    size = [1, 1]
    beside = lambda nodes: adjacent.join(nodes.withColumnRenamed("guid", "guid_from"), "guid_from").select("guid").distinct()
    meeting = rings[0][0].join(rings[1][0], "guid", "left_semi")
    while meeting.isEmpty():
        k = 0 if size[0] <= size[1] else 1
        new = beside(rings[k][-1])
        for old in rings[k]:
            new = new.join(old, "guid", "left_anti")
        new = written(new)
        size[k] = rows_in(new)
        if not size[k]:
            return None
        rings[k].append(new)
        meeting = new.join(rings[1 - k][-1], "guid", "left_semi")
    i = len(rings[0]) - 1
    kept = {i: written(meeting)}
    for d in range(i - 1, -1, -1):
        kept[d] = written(rings[0][d].join(beside(kept[d + 1]), "guid", "left_semi"))
    length = i + len(rings[1]) - 1
    for d in range(i + 1, length + 1):
        kept[d] = written(rings[1][length - d].join(beside(kept[d - 1]), "guid", "left_semi"))
    for ring in (*rings[0], *rings[1]):
        forget(ring)
    return [kept[d] for d in range(length + 1)]


def path(db: FactDatabase, source: str, target: str) -> DataFrame | None:
    """The steps of a shortest path, either direction of edges counting [GRF-02].

    Depth numbers the steps from 0 [WIN-08]. No rows when the two aren't
    connected; None when either name is unknown; one row when they are the
    same. Of several shortest paths it is the one that a breadth-first walk
    from the source finds: every predecessor of an item on a shortest path
    is on one too, so walking only those changes no choice.
    """
    a, b = db.guid_of(source), db.guid_of(target)
    if a is None or b is None:
        return None
    adjacent = written(adjacency(db.edge))
    between = _between(adjacent, a, b)
    levels = Levels(db, a, adjacent=adjacent)
    rows, at = [], b
    if between is not None:
        for only in between[1:]:
            levels.grow(only)
        for d in range(len(levels.levels) - 1, -1, -1):  # one looked-up row a level
            r = levels.levels[d].where(F.col("guid") == at).first()
            rows.append((d, at, r["guid_from"], r["id_relation"], {0: "out", 1: "in"}.get(r["side"])))
            at = r["guid_from"]
    steps = db.spark.createDataFrame(rows, "depth int, guid string, guid_from string, id_relation string, direction string")
    return labelled(labelled(steps, db.item, "guid", "id_self"), db.item, "guid_from", "id_from").select("depth", "id_self", "guid", "id_from", "id_relation", "direction")


def orphans(db: FactDatabase) -> tuple[DataFrame, DataFrame]:
    """Items that no edge targets and nothing holds; relation entries that no edge uses [GRF-03, JOIN-05, SET-02].

    The second keeps the semantics of NOT IN: one edge without a relation
    makes it empty.
    """
    alone = db.item.join(db.edge.select(F.col("guid_target").alias("guid")), "guid", "left_anti").join(db.containment.select(F.col("guid_held").alias("guid")), "guid", "left_anti")
    unused = db.run("select id_self from item where prefix = 'r' and id_self not in (select distinct id_relation from edge)")
    return alone.select("guid", "id_self"), unused


def edges_among(db: FactDatabase, steps: DataFrame) -> DataFrame:
    """(id_source, id_target, id_relation) of edges with both ends among the steps, repeats kept [GRF-04, JOIN-06]."""
    guids = steps.select("guid").distinct()
    inner = db.edge.join(guids, db.edge["guid_source"] == guids["guid"], "left_semi")
    inner = inner.join(guids, inner["guid_target"] == guids["guid"], "left_semi").select("guid_source", "guid_target", "id_relation")
    return labelled(labelled(inner, db.item, "guid_source", "id_source"), db.item, "guid_target", "id_end").select("id_source", F.col("id_end").alias("id_target"), "id_relation")


def neighbourhood(db: FactDatabase, name: str) -> tuple[DataFrame, DataFrame] | None:
    """Outgoing (id_relation, id_target, ord) and incoming (id_source, id_relation) of one item [GRF-05]."""
    guid = db.guid_of(name)
    if guid is None:
        return None
    out = labelled(db.edge.where(F.col("guid_source") == guid).select("ord", "id_relation", "guid_target"), db.item, "guid_target", "id_target").select("id_relation", "id_target", "ord")
    into = labelled(db.edge.where(F.col("guid_target") == guid).select("guid_source", "id_relation"), db.item, "guid_source", "id_source").select("id_source", "id_relation")
    return out, into


def reach(links: DataFrame, seeds: DataFrame, limit: int | None = None) -> DataFrame:
    """(root, node, depth) for every node that a seed (root, node) reaches over links (a, b), itself at depth 0.

    Each (root, node) once at its least depth; cycles end by themselves
    [GRF-06, GRF-07, GRF-12, GRF-13].
    """
    links = written(links.select("a", "b").where("a is not null and b is not null").distinct())
    front = written(seeds.select("root", "node").distinct().withColumn("depth", F.lit(0)))
    levels, depth = [front], 0
    while limit is None or depth < limit:
        depth += 1
        seen = levels[0].select("root", "node")
        for x in levels[1:]:
            seen = seen.unionByName(x.select("root", "node"))
        step = front.select("root", F.col("node").alias("a")).join(links, "a").select("root", F.col("b").alias("node")).distinct()
        new = written(step.join(seen, ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if not rows_in(new):
            forget(new)
            break
        levels.append(new)
        front = new
        if len(levels) > 16:  # keep the union's plan short on deep graphs
            merged = levels[0]
            for x in levels[1:]:
                merged = merged.unionByName(x)
            old, levels = levels, [written(merged)]
            for x in old:
                forget(x)
            front = levels[0].where(F.col("depth") == depth)
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out


def propagate(links: DataFrame, levels: DataFrame) -> DataFrame:
    """(node, dimension, level): the greatest level of each dimension that reaches a node over links (a, b) [GRF-09, AGG-04].

    ``levels`` gives (node, dimension, level) of the declaring nodes; what a
    node declares itself isn't derived for it unless another, or a cycle,
    brings it back.
    """
    links = written(links.select("a", "b").where("a is not null and b is not null").distinct())
    kept = None
    front = written(levels.groupBy("node", "dimension").agg(F.max("level").alias("level")))
    known = None
    while True:
        step = front.select(F.col("node").alias("a"), "dimension", "level").join(links, "a").groupBy(F.col("b").alias("node"), "dimension").agg(F.max("level").alias("level"))
        if known is None:
            known = front = written(step)
            better = rows_in(known)
        else:
            both = known.withColumnRenamed("level", "old").join(step, ["node", "dimension"], "full")
            merged = written(both.select("node", "dimension", F.greatest("old", "level").alias("level"), F.coalesce(F.col("level") > F.col("old"), F.col("old").isNull()).alias("better")))
            front = merged.where("better").select("node", "dimension", "level")
            known = merged.select("node", "dimension", "level")
            forget(kept)
            kept = merged
            better = front.limit(1).count()
        if not better:
            return known


def peeled(links: DataFrame) -> DataFrame:
    """Links (a, b) that lie on a cycle or between cycles: what is left after taking off sources and sinks, round by round."""
    left = written(links.select("a", "b").where("a is not null and b is not null").distinct())
    size = rows_in(left)
    while size:
        nodes = left.select(F.col("a").alias("n")).intersect(left.select(F.col("b").alias("n")))
        kept = left.join(nodes.withColumnRenamed("n", "a"), "a", "left_semi").join(nodes.withColumnRenamed("n", "b"), "b", "left_semi").select("a", "b")
        kept = written(kept)
        now = rows_in(kept)
        forget(left)
        left = kept
        if now == size:
            break
        size = now
    return left


def _greatest_reaching(links: DataFrame) -> DataFrame:
    """(node, color): the greatest node that reaches each node of the links, itself included."""
    color = written(links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct().withColumn("color", F.col("node")))
    while True:
        step = color.join(links, F.col("node") == F.col("a")).groupBy(F.col("b").alias("node")).agg(F.max("color").alias("met"))
        new = written(color.join(step, "node", "left").select("node", F.greatest("color", "met").alias("color"), F.coalesce(F.col("met") > F.col("color"), F.lit(False)).alias("moved")))
        moved = not new.where("moved").isEmpty()
        forget(color)
        color = new
        if not moved:
            return color.select("node", "color")


def on_cycles(links: DataFrame) -> DataFrame:
    """Links (a, b) that lie on a cycle, a link from a node to itself included [GRF-10, GRF-15].

    What peeling leaves is coloured by the greatest node that reaches each
    node; the nodes that lead back to the one that gave the colour are
    strongly connected with it, and are taken out before the rest is peeled
    and coloured again. A link with both ends in one such set is on a cycle.
    """
    left, found = peeled(links), []
    while rows_in(left):
        color = written(_greatest_reaching(left))
        same = written(left.join(color.withColumnsRenamed({"node": "a", "color": "c"}), "a").join(color.withColumnsRenamed({"node": "b", "color": "d"}), "b").where("c = d").select("a", "b", "c"))
        back = reach(same.select(F.col("b").alias("a"), F.col("a").alias("b")), color.where("node = color").select(F.col("color").alias("root"), "node"))
        member = written(back.select("node").distinct())
        ends = lambda df, how: df.join(member.withColumnRenamed("node", "a"), "a", how).join(member.withColumnRenamed("node", "b"), "b", how)  # noqa: B023, E731
        found.append(written(ends(same, "left_semi").select("a", "b")))
        rest = peeled(ends(left, "left_anti").select("a", "b"))
        for x in (left, color, same, member):
            forget(x)
        left = rest
    out = found[0] if found else left
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def redundant(links: DataFrame) -> DataFrame:
    """Links (a, b) whose target a longer chain from the same source reaches too; the first step must not be the target itself [GRF-11].

    A chain may come through the source again. Only sources with several
    targets are searched from. Of the first steps that lead from a source to a
    node two are kept at most, which is enough to know whether any of them
    differs from the target, so there are two rows a source and node
    whatever the number of ways.
    """
    links = written(links.select("a", "b").where("a is not null and b is not null and a <> b").distinct())
    forks = links.groupBy("a").count().where("count > 1").select("a")
    wanted = written(links.join(forks, "a", "left_semi").select("a", "b"))
    front = written(wanted.select("a", F.col("b").alias("node"), F.col("b").alias("via")))
    known = [front]
    while rows_in(front):
        step = front.join(links.withColumnsRenamed({"a": "node", "b": "to"}), "node").groupBy("a", F.col("to").alias("node")).agg(F.min("via").alias("low"), F.max("via").alias("high"))
        had = known[0]
        for x in known[1:]:
            had = had.unionByName(x)
        had = had.groupBy("a", "node").agg(F.collect_set("via").alias("had"))
        none = F.array().cast("array<string>")
        both = step.join(had, ["a", "node"], "left").withColumn("had", F.coalesce("had", none))
        fresh = F.slice(F.array_except(F.array("low", "high"), F.col("had")), F.lit(1), F.lit(2) - F.least(F.size("had"), F.lit(2)))
        front = written(both.where(F.size("had") < 2).select("a", "node", F.explode(fresh).alias("via")))
        known.append(front)
        if len(known) > 16:  # keep plans short on deep graphs
            merged = known[0]
            for x in known[1:]:
                merged = merged.unionByName(x)
            old, known = known[:-1], [written(merged)]
            for x in old:
                forget(x)
    every = known[0]
    for x in known[1:]:
        every = every.unionByName(x)
    other = every.where("node <> via").select("a", F.col("node").alias("b")).distinct()
    return wanted.join(other, ["a", "b"], "left_semi").select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node connected with each node of links (a, b).

    Alternates joining every node's larger neighbours, then its smaller
    ones, with the least of them, until nothing changes; a hub's neighbours
    are aggregated before they are shuffled.
    """
    edges = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        large = written(large)
        small_min = large.groupBy("b").agg(F.min("a").alias("m"))
        pairs = large.join(small_min, "b")
        star = written(pairs.select(F.col("m").alias("a"), "b").unionByName(pairs.select(F.col("m").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
        forget(large)
        same = rows_in(star) == rows_in(edges) and star.join(edges, ["a", "b"], "left_anti").isEmpty()
        forget(edges)
        edges = star
        if same:
            break
    roots = edges.groupBy("b").agg(F.min("a").alias("component")).select(F.col("b").alias("node"), "component")
    return roots.unionByName(edges.select("a").distinct().join(roots.select(F.col("node").alias("a")), "a", "left_anti").select(F.col("a").alias("node"), F.col("a").alias("component")))


def topological_levels(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, level): the longest chain of links (a, b) that ends in a node; nodes on or behind cycles have none [GRF-14].

    A round takes off what nothing is left before, and reads only the links
    and nodes that remain.
    """
    left = written(links.select("a", "b").distinct())
    rest = written(nodes.select("node").distinct())
    level, out = 0, None
    while True:
        free = written(rest.join(left.select(F.col("b").alias("node")), "node", "left_anti").withColumn("level", F.lit(level)))
        if not rows_in(free):
            return out if out is not None else free
        if level % 16 == 15:  # keep the union's plan short on long chains
            out = written(out.unionByName(free))
        else:
            out = free if out is None else out.unionByName(free)
        old = rest, left
        rest = written(rest.join(free, "node", "left_anti"))
        left = written(left.join(free.select(F.col("node").alias("a")), "a", "left_anti"))
        for x in old:
            forget(x)
        level += 1


def expanded(links: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(path, node, depth, has_child) of a view opened to a depth; a path never enters a node twice [GRF-16]."""
    links = written(links.select("a", "b").distinct())
    front = written(roots.select(F.array("node").alias("path"), "node", F.lit(0).alias("depth")))
    out = front
    for d in range(1, depth + 1):
        step = front.join(links, front["node"] == links["a"]).where(~F.array_contains("path", F.col("b")))
        front = written(step.select(F.concat("path", F.array("b")).alias("path"), F.col("b").alias("node"), F.lit(d).alias("depth")))
        if not rows_in(front):
            break
        out = out.unionByName(front)
    parents = links.groupBy(F.col("a").alias("node")).agg(F.collect_set("b").alias("next"))
    return out.join(parents, "node", "left").select("path", "node", "depth", F.coalesce(F.size(F.array_except("next", "path")) > 0, F.lit(False)).alias("has_child"))


def drawing(steps: DataFrame, form: str = "dot") -> str:
    """A walk as dot or mermaid text, one node an item and one arrow a reaching edge [SNK-04]."""
    rows = steps.orderBy("depth", "pos" if "pos" in steps.columns else "id_self").select("id_self", "id_from", "id_relation", "direction").collect()
    names = list(dict.fromkeys(r["id_self"] for r in rows))
    arrows = [(r["id_from"], r["id_self"]) if r["direction"] == "out" else (r["id_self"], r["id_from"]) for r in rows if r["id_from"] is not None]
    label = [r["id_relation"] for r in rows if r["id_from"] is not None]
    if form == "dot":
        body = [f'  "{n}";' for n in names] + [f'  "{a}" -> "{b}" [label="{t}"];' for (a, b), t in zip(arrows, label)]
        return "\n".join(["digraph {", "  rankdir=LR;", *body, "}"]) + "\n"
    if form == "mermaid":
        at = {n: f"n{i}" for i, n in enumerate(names)}
        body = [f'  {at[n]}["{n}"]' for n in names] + [f"  {at[a]} -->|{t}| {at[b]}" for (a, b), t in zip(arrows, label)]
        return "\n".join(["graph LR", *body]) + "\n"
    raise ValueError(f"no drawing in the form {form}")


def describers(edge: DataFrame, relations: list[str]) -> DataFrame:
    """(guid, records): the sorted sources that describe each target [GRF-17]."""
    return edge.where(F.col("id_relation").isin(relations)).groupBy(F.col("guid_target").alias("guid")).agg(F.sort_array(F.collect_set("guid_source")).alias("records"))


def flagged(register: DataFrame, flag: Column | str) -> list[str]:
    """Relations whose register entry sets a flag [GRF-18]; a register of more than 10,000 relations is refused."""
    rows = register.where(F.col(flag) if isinstance(flag, str) else flag).select("id_relation").distinct().orderBy("id_relation").limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("more than 10,000 relations are flagged")
    return [r[0] for r in rows]


def renamed(items: DataFrame, old: str, new: str) -> DataFrame:
    """(id_self, id_new) of an id and of every id below it, for a rename [GRF-20].

    Ids below are those whose body continues the old body after a dot; the
    prefix before the first underscore may differ.
    """
    body = F.expr("substring(id_self, instr(id_self, '_') + 1)")
    stem, fresh = old.partition("_")[2], new.partition("_")[2]
    mine = items.where(F.col("id_self") == old).select("id_self", F.lit(new).alias("id_new"))
    below = items.where(body.startswith(stem + ".")).select("id_self", F.concat(F.expr("substring(id_self, 1, instr(id_self, '_'))"), F.lit(fresh), F.substring(body, F.lit(len(stem) + 1), F.length(body))).alias("id_new"))
    return mine.unionByName(below).distinct()

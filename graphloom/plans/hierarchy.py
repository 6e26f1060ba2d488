"""Problem 7: parent-child links to full hierarchies."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators.hierarchy import descendants, hierarchy, paths
from graphloom.plans.registry import CORE
from graphloom.session import table, written

_TREE = """
with recursive last as (
  select guid_held as node, guid_holder as parent from (
    select *, row_number() over (partition by guid_held order by ord desc) as n from containment where guid_held is not null)
  where n = 1),
named as (select guid_held as node from containment where guid_held is not null union select guid_holder from containment where guid_holder is not null),
down(node, root, depth, path) as (
  select node, node, 0, [node] from named where node not in (select node from last where parent is not null)
  union all
  select last.node, down.root, down.depth + 1, list_append(down.path, last.node) from down join last on last.parent = down.node)
"""


def _tree(spark, folder):
    return hierarchy(table(spark, folder, "containment"))


@CORE.add(
    "p7_found",
    _TREE
    + """select named.node as guid_node, coalesce(root, 'cycle') as guid_root, coalesce(depth, -1)::int as depth
         from named left join down on named.node = down.node""",
)
def p7_found(spark, folder):
    return _tree(spark, folder).select("guid_node", "guid_root", "depth")


@CORE.add(
    "p7_paths",
    _TREE
    + """, below as (select a as guid_node, count(*) - 1 as n from (select unnest(path) as a from down) group by 1)
         select node as guid_node, root as guid_root, depth::int as depth, array_to_string(path, '/') as path, n as n_descendant
         from down join below on node = guid_node""",
)
def p7_paths(spark, folder):
    tree = written(_tree(spark, folder))
    path = written(paths(tree))
    below = descendants(path).groupBy("guid_node").agg(F.count(F.lit(1)).alias("n"))
    return (
        tree.drop("guid_parent")
        .join(path, "guid_node")
        .join(below, "guid_node", "left")
        .select("guid_node", "guid_root", "depth", F.concat_ws("/", "path").alias("path"), F.coalesce("n", F.lit(0).cast("long")).alias("n_descendant"))
    )


@CORE.add(
    "p7_descendants",
    _TREE
    + """select path[i] as guid_node, node as guid_descendant, (depth + 1 - i)::int as distance
         from (select *, unnest(range(1, depth + 1)) as i from down)""",
)
def p7_descendants(spark, folder):
    return descendants(paths(written(_tree(spark, folder))))

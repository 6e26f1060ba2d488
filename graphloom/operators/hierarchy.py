"""Parent-child links to full hierarchies."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import forget, rows_in, written

#: Links that one task may merge in memory.
TASK_LINKS = 2_000_000
CYCLE = "cycle"
_STATE = "node string, top string, off int, state int"
#: States of a link: its top may have a parent elsewhere; its top is a root; it leads into a cycle.
OPEN, DONE, LOOP = 0, 1, 2


def forest(node: np.ndarray, top: np.ndarray, off: np.ndarray, final: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weighted disjoint-set forest over links node -> top at distance off.

    Each node has one link. Paths are compressed by halving over all links at
    once; (top, off, state) after compression. With ``final`` a top without
    a link is a root.
    """
    known = pd.Index(node)
    up = known.get_indexer(top)
    n = len(node)
    at, dist = np.arange(n), np.zeros(n, np.int64)
    # step[i]: link reached by the compressed jump of i; a link whose top has none here stays
    step, cost = np.where(up >= 0, up, np.arange(n)), np.where(up >= 0, off.astype(np.int64), 0)
    for _ in range(max(1, math.ceil(math.log2(n + 1)) + 1)):
        cost = cost + cost[step]
        step = step[step]
    at, dist = step, cost
    ends = up[at] < 0
    state = np.where(ends, DONE if final else OPEN, LOOP)
    return np.where(ends, top[at], None), np.where(ends, dist + off[at], -1), state


def _forests(final: bool):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [p for p in parts if len(p)]
        if not rows:
            return
        links = pd.concat(rows, ignore_index=True)
        top, off, state = forest(links["node"].to_numpy(object), links["top"].to_numpy(object), links["off"].to_numpy(), final)
        yield pd.DataFrame({"node": links["node"], "top": top, "off": off.astype(np.int32), "state": state.astype(np.int32)})

    return run


def holding_links(rows: DataFrame, held: str = "guid_held", holder: str = "guid_holder", order: str = "ord") -> DataFrame:
    """(node, parent): of the rows of one held node the one with the greatest order; ties to the greatest holder."""
    return (
        rows.where(F.col(held).isNotNull())
        .groupBy(F.col(held).alias("node"))
        .agg(F.max(F.struct(F.col(order), F.col(holder).alias("parent"))).alias("last"))
        .select("node", "last.parent")
    )


def resolve(links: DataFrame, task_links: int = TASK_LINKS) -> DataFrame:
    """(node, top, off, state) of each link (node, parent): its root at distance off, or state LOOP.

    Tasks first compress the links they hold. While more links stay open
    than one task may merge, forests are merged pairwise by joining each
    open top with its own link, which halves every remaining path; what
    never ends within the logarithm of the links leads into a cycle. The
    rest, of bounded size, is merged in one task.
    """
    local = written(links.where("parent is not null").select("node", F.col("parent").alias("top"), F.lit(1).alias("off")).mapInPandas(_forests(False), _STATE))
    state, total, rounds = local, rows_in(local), 0
    if not total:
        return state
    done = state.where(F.col("state") != OPEN)
    open_ = state.where(F.col("state") == OPEN)
    left = open_.count()
    old: list[DataFrame] = []
    while left > task_links and rounds <= math.ceil(math.log2(total + 1)) + 1:
        b = state.select(F.col("node").alias("top"), F.col("top").alias("top2"), F.col("off").alias("off2"), F.col("state").alias("state2"))
        joined = open_.join(b, "top", "left")
        none = F.col("state2").isNull()
        state = written(
            done.unionByName(
                joined.select(
                    "node",
                    F.when(none, F.col("top")).when(F.col("state2") == LOOP, None).otherwise(F.col("top2")).alias("top"),
                    F.when(none, F.col("off")).when(F.col("state2") == LOOP, -1).otherwise(F.col("off") + F.col("off2")).cast("int").alias("off"),
                    F.coalesce("state2", F.lit(DONE)).alias("state"),
                )
            )
        )
        for x in old:
            forget(x)
        old = [state]
        rounds += 1
        done, open_ = state.where(F.col("state") != OPEN), state.where(F.col("state") == OPEN)
        left = open_.count()
    if left > task_links:
        return done.unionByName(open_.select("node", F.lit(None).cast("string").alias("top"), F.lit(-1).alias("off"), F.lit(LOOP).alias("state")))
    # the open links and the links their tops have: a top that is done or has no link ends there
    tops = open_.select(F.col("top").alias("node")).distinct()
    closed = done.join(tops, "node", "left_semi")
    merged = open_.select("node", "top", "off").coalesce(1).mapInPandas(_forests(True), _STATE)
    after = closed.select(F.col("node").alias("top"), F.col("top").alias("top2"), F.col("off").alias("off2"), F.col("state").alias("state2"))
    # a merged top may itself be a done link of another task (a cycle found there, or a root)
    merged = merged.join(after, "top", "left").select(
        "node",
        F.when(F.col("state2") == LOOP, None).otherwise(F.coalesce("top2", "top")).alias("top"),
        F.when((F.col("state2") == LOOP) | (F.col("off") < 0), -1).otherwise(F.col("off") + F.coalesce("off2", F.lit(0))).cast("int").alias("off"),
        F.coalesce("state2", "state").alias("state"),
    )
    return done.unionByName(merged)


def hierarchy(rows: DataFrame, held: str = "guid_held", holder: str = "guid_holder", order: str = "ord", task_links: int = TASK_LINKS) -> DataFrame:
    """(guid_node, guid_root, depth, guid_parent) of every node that the rows name.

    A null holder makes its held node a root; so does having no row. On or
    below a cycle guid_root is ``cycle`` and depth -1. Rows without a held
    node only name their holder. Repeats and empty tables are fine.
    """
    links = written(holding_links(rows, held, holder, order))
    state = resolve(links, task_links)
    named = rows.select(F.explode(F.array(held, holder)).alias("node")).where("node is not null").distinct()
    parents = links.where("parent is not null")
    loop = F.col("state") == LOOP
    return (
        named.join(state.join(parents, "node"), "node", "left")
        .select(
            F.col("node").alias("guid_node"),
            F.when(loop, CYCLE).otherwise(F.coalesce("top", "node")).alias("guid_root"),
            F.when(loop, -1).otherwise(F.coalesce("off", F.lit(0))).cast("int").alias("depth"),
            F.col("parent").alias("guid_parent"),
        )
    )


def paths(tree: DataFrame) -> DataFrame:
    """(guid_node, path): each node's ancestors from its root down to itself, for nodes off cycles.

    Runs of ancestors are doubled: each round joins a node's run with the
    run of the ancestor it ends at, looked up by node, so a tree of depth d
    takes log2(d) rounds.
    """
    rooted = tree.where("depth >= 0")
    deepest = rooted.agg(F.max("depth")).first()[0] or 0
    run = written(rooted.select(F.col("guid_node").alias("node"), F.col("guid_parent").alias("next"), F.array("guid_node").alias("run")))
    for _ in range(math.ceil(math.log2(deepest + 1))):
        other = run.select(F.col("node").alias("next"), F.col("next").alias("next2"), F.col("run").alias("run2"))
        open_ = run.where("next is not null").join(other, "next").select("node", F.col("next2").alias("next"), F.concat("run", "run2").alias("run"))
        longer = written(run.where("next is null").unionByName(open_))
        forget(run)
        run = longer
    return run.select(F.col("node").alias("guid_node"), F.reverse("run").alias("path"))


def descendants(path: DataFrame) -> DataFrame:
    """(guid_node, guid_descendant, distance) for every ancestor of every node, itself aside."""
    size = F.size("path")
    return (
        path.select(F.col("guid_node").alias("guid_descendant"), size.alias("n"), F.posexplode("path").alias("pos", "guid_node"))
        .select("guid_node", "guid_descendant", (F.col("n") - 1 - F.col("pos")).alias("distance"))
        .where("distance > 0")
    )

"""Edits of the fact tables, as functions from facts to facts.

DataFrames don't change, so undoing an edit is keeping the facts before it
[DML-07].
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.graph import renamed


class Refused(ValueError):
    """An edit that would break a rule of the facts."""


@dataclass(frozen=True)
class Facts:
    item: DataFrame
    edge: DataFrame
    containment: DataFrame

    def resolve(self, name: str) -> str:
        """The guid of the one item of that id or guid; none or several are refused [DML-08]."""
        rows = self.item.where((F.col("guid") == name) | (F.col("id_self") == name)).select("guid").distinct().limit(2).collect()
        if len(rows) != 1:
            raise Refused(f"{name} names {'several items' if rows else 'no item'}")
        return rows[0][0]


def _row(df: DataFrame, **values) -> DataFrame:
    """One row with the columns of ``df``; columns not given are null."""
    one = df.sparkSession.range(1)
    return one.select(*[F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in df.schema.fields])


def add_item(f: Facts, guid: str, id_self: str, status: str | None = None, location: str = "", holder: str | None = None) -> Facts:
    """A new item, inside a holder if one is named [DML-01, DML-02]."""
    if not f.item.where((F.col("guid") == guid) | (F.col("id_self") == id_self)).isEmpty():
        raise Refused(f"{id_self} or its guid is taken")
    item = f.item.unionByName(_row(f.item, guid=guid, id_self=id_self, prefix=id_self.partition("_")[0], status=status, location=location))
    if holder is None:
        return replace(f, item=item)
    return replace(f, item=item, containment=f.containment.unionByName(_row(f.containment, guid_holder=f.resolve(holder), guid_held=guid)))


def set_field(f: Facts, name: str, column: str, value: str | None) -> Facts:
    """An item with one field set, or unset with None [DML-03, DML-06]."""
    if column not in f.item.columns or column in ("guid", "id_self", "prefix"):
        raise Refused(f"{column} is not to be set")
    guid = f.resolve(name)
    return replace(f, item=f.item.withColumn(column, F.when(F.col("guid") == guid, F.lit(value)).otherwise(F.col(column))))


def link(f: Facts, source: str, relation: str, target: str, known: tuple[str, ...] = ()) -> Facts:
    """A new edge at the end; unregistered relations and repeats are refused [DML-04]."""
    if known and relation not in known:
        raise Refused(f"{relation} is not registered")
    a, b = f.resolve(source), f.resolve(target)
    if not f.edge.where((F.col("guid_source") == a) & (F.col("id_relation") == relation) & (F.col("guid_target") == b)).isEmpty():
        raise Refused("the edge is there")
    last = f.edge.agg(F.max("ord")).first()[0]
    id_target = f.item.where(F.col("guid") == b).select("id_self").first()[0]
    return replace(f, edge=f.edge.unionByName(_row(f.edge, ord=(last if last is not None else -1) + 1, guid_source=a, id_relation=relation, guid_target=b, id_target=id_target)))


def unlink(f: Facts, source: str, relation: str, target: str) -> Facts:
    """Without the edge, repeats included; refused when there is none [DML-04]."""
    a = f.resolve(source)
    b = f.item.where((F.col("guid") == target) | (F.col("id_self") == target)).select("guid").first()
    b = b[0] if b else target
    hit = F.coalesce((F.col("guid_source") == a) & (F.col("id_relation") == relation) & (F.col("guid_target") == b), F.lit(False))
    if f.edge.where(hit).isEmpty():
        raise Refused("no such edge")
    return replace(f, edge=f.edge.where(~hit))


def rename(f: Facts, old: str, new: str) -> Facts:
    """An id and all below it renamed, ids beside edges repointed; guids stay [DML-05, SUP-41]."""
    f.resolve(old)
    names = renamed(f.item.where("id_self is not null").select("id_self"), old, new)
    taken = names.select(F.col("id_new").alias("id_self")).join(f.item.select("id_self"), "id_self", "left_semi")
    if not taken.join(names.select("id_self"), "id_self", "left_anti").isEmpty():
        raise Refused(f"{new} is taken")
    item = f.item.join(names, "id_self", "left").withColumn("id_self", F.coalesce("id_new", "id_self")).withColumn("prefix", F.substring_index(F.coalesce("id_self", F.lit("")), "_", 1)).select(*f.item.columns)
    beside = names.select(F.col("id_self").alias("id_target"), F.col("id_new"))
    edge = f.edge.join(beside, "id_target", "left").withColumn("id_target", F.coalesce("id_new", "id_target")).select(*f.edge.columns)
    return replace(f, item=item, edge=edge)


def gathered(f: Facts, holder: str, members: DataFrame) -> Facts:
    """A holder that holds the members (guid) beside what it holds; those there already stay once [DML-06]."""
    guid = f.resolve(holder)
    rows = members.select(F.lit(guid).alias("guid_holder"), F.col("guid").alias("guid_held")).distinct()
    return replace(f, containment=f.containment.unionByName(rows.join(f.containment, ["guid_holder", "guid_held"], "left_anti")))


def refreshed(f: Facts, location: str, fresh: Facts) -> Facts:
    """The facts with one location's items, and the edges and holdings of those, replaced by fresh ones [STR-07]."""
    gone = f.item.where(F.col("location") == location).select("guid")
    drop = lambda df, c: df.join(gone.select(F.col("guid").alias(c)), c, "left_anti").select(*df.columns)
    item = f.item.where(~F.coalesce(F.col("location") == location, F.lit(False))).unionByName(fresh.item)
    return Facts(item, drop(f.edge, "guid_source").unionByName(fresh.edge), drop(f.containment, "guid_held").unionByName(fresh.containment))

"""Pairs out of equivalence classes whose size has no bound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Members of a class from which copies may be given as a star, and of one slice of a class whose pairs are all given.
EXPAND = 200


def within(members: DataFrame, apart: bool, expand: int | None = EXPAND) -> DataFrame:
    """(a, b) with a < b from (class, variant, id); with ``apart`` only pairs of different variants.

    Without a bound (``expand`` null) every pair is given. Else a class of
    more than ``expand`` members gives its copies, the members of a variant
    beyond its least id, one row each: the copy with the least id of the
    class or, with ``apart``, of another variant. Pairs of different
    variants' least ids are always all given with ``apart``.
    """
    first = members.groupBy("class", "variant").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
    size = first.groupBy("class").agg(F.sum("n").alias("size"), F.min(F.struct("variant", "rep")).alias("r1"), F.count(F.lit(1)).alias("n_variant"))
    size = size.where("n_variant > 1") if apart else size.where("size > 1")
    every = _apart if apart else _alike
    if expand is None:
        return every(members, first, size)
    full, large = every(members, first, size.where(F.col("size") <= expand)), size.where(F.col("size") > expand)
    if not apart:
        star = members.join(large, "class").select("id", F.col("r1.rep").alias("hub")).where("id <> hub")
        return full.unionByName(_ordered(star, "id", "hub"))
    reps = first.select("class", "variant", F.col("rep").alias("id"), F.lit(1).cast("long").alias("n")).join(large, "class")
    second = reps.where("variant <> r1.variant").groupBy("class").agg(F.min(F.struct("variant", F.col("id").alias("rep"))).alias("r2"))
    hub = F.when(F.col("variant") == F.col("r1.variant"), F.col("r2.rep")).otherwise(F.col("r1.rep"))
    copies = members.join(reps.select("id"), "id", "left_anti").join(large, "class").join(second, "class").select("id", hub.alias("hub"))
    pairs = _every(reps.select("class", "id", F.col("n_variant").alias("size")))
    return full.unionByName(pairs.select("a", "b")).unionByName(_ordered(copies, "id", "hub"))


def _ordered(pairs: DataFrame, x: str, y: str) -> DataFrame:
    return pairs.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))


def _slices(n: str) -> Column:
    return F.ceil(F.col(n) / EXPAND).cast("int")


def _slice(n: str) -> Column:
    return F.pmod(F.xxhash64("id"), _slices(n)).cast("int").alias("slice")


def _every(members: DataFrame) -> DataFrame:
    """(class, a, b) with a < b: all pairs of each class of (class, id, size).

    One side of a class is dealt out to slices of about EXPAND members and
    the other copied to each, so no task joins a large class with itself.
    """
    one = members.select("class", _slice("size"), F.col("id").alias("a"))
    two = members.select("class", F.explode(F.sequence(F.lit(0), _slices("size") - 1)).alias("slice"), F.col("id").alias("b"))
    return one.join(two, ["class", "slice"]).where("a < b").select("class", "a", "b")


def _alike(members: DataFrame, first: DataFrame, size: DataFrame) -> DataFrame:
    return _every(members.select("class", "id").join(size.select("class", "size"), "class")).select("a", "b")


def _apart(members: DataFrame, first: DataFrame, size: DataFrame) -> DataFrame:
    """Pairs of variants first, then of their members, so copies of one variant are never compared."""
    sized = first.select("class", "variant", "n").join(size.select("class", "n_variant"), "class")
    pair = _every(sized.select("class", F.struct("variant", "n").alias("id"), F.col("n_variant").alias("size")))
    pair = pair.select("class", F.col("a.variant").alias("v"), F.col("b.variant").alias("w"), F.explode(F.sequence(F.lit(0), _slices("b.n") - 1)).alias("slice"))
    one = members.select("class", F.col("variant").alias("v"), F.col("id").alias("x"))
    two = members.join(sized, ["class", "variant"]).select("class", F.col("variant").alias("w"), _slice("n"), F.col("id").alias("y"))
    return _ordered(pair.join(one, ["class", "v"]).join(two, ["class", "w", "slice"]), "x", "y")


def across(links: DataFrame, members: DataFrame, expand: int = EXPAND) -> DataFrame:
    """(a, b) with a < b for linked classes: links (c1, c2), members (class, id).

    All pairs of members where there are at most ``expand`` squared; else
    the pair of least ids, the members being given by ``within``.
    """
    size = members.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("rep"))
    one = size.select(F.col("class").alias("c1"), F.col("n").alias("n1"), F.col("rep").alias("r1"))
    two = size.select(F.col("class").alias("c2"), F.col("n").alias("n2"), F.col("rep").alias("r2"))
    sized = links.join(one, "c1").join(two, "c2")
    fits = F.col("n1") * F.col("n2") <= expand * expand
    plain = sized.where(~fits | (F.col("n1") * F.col("n2") == 1)).select(F.col("r1").alias("x"), F.col("r2").alias("y"))
    full = (
        sized.where(fits & (F.col("n1") * F.col("n2") > 1))
        .select("c1", "c2")
        .join(members.select(F.col("class").alias("c1"), F.col("id").alias("x")), "c1")
        .join(members.select(F.col("class").alias("c2"), F.col("id").alias("y")), "c2")
        .select("x", "y")
    )
    return plain.unionByName(full).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))

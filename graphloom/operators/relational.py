"""Join, aggregate, window and set forms that the rest is built from."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def not_in(left: DataFrame, column: str, right: DataFrame, other: str) -> DataFrame:
    """Rows whose value isn't among the other's, as SQL's NOT IN: a null among those empties the result [JOIN-05]."""
    return left.sparkSession.sql(f"select * from {{left}} where `{column}` not in (select _v from {{right}})", left=left, right=right.select(F.col(other).alias("_v")))


def both_ends_in(edge: DataFrame, ids: DataFrame, a: str = "guid_source", b: str = "guid_target", key: str = "guid") -> DataFrame:
    """Edges with both ends among the ids: two semi joins [JOIN-06]."""
    one = ids.select(F.col(key).alias("_k")).distinct()
    return edge.join(one, edge[a] == one["_k"], "left_semi").join(one, edge[b] == one["_k"], "left_semi")


def item_pairs(edge: DataFrame, item: DataFrame, wanted: Column) -> DataFrame:
    """(source, target, id_relation) of edges between items, kept if either end is wanted; dangling ones dropped [JOIN-08, JOIN-16].

    ``wanted`` is a condition on an item's columns.
    """
    flag = item.select("guid", F.coalesce(wanted, F.lit(False)).alias("w"))
    s = flag.select(F.col("guid").alias("guid_source"), F.col("w").alias("w1"))
    t = flag.select(F.col("guid").alias("guid_target"), F.col("w").alias("w2"))
    return edge.join(s, "guid_source").join(t, "guid_target").where("w1 or w2").select("guid_source", "guid_target", "id_relation")


def longest_prefix(paths: DataFrame, roots: DataFrame, path: str = "path", root: str = "root", order: str = "ord", sep: str = "/") -> DataFrame:
    """Each distinct path with the deepest root directory above it; null without one [JOIN-10].

    Every directory above a path is looked up by equality, so it is a hash
    join; of equal roots the first declared stands.
    """
    first = roots.groupBy(F.col(root).alias("_dir")).agg(F.min(order).alias("_ord"))
    up = paths.select(F.col(path).alias("_path")).distinct().select("_path", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("_path", sep))), lambda i: F.struct(i.alias("d"), F.array_join(F.slice(F.split("_path", sep), 1, i), sep).alias("dir")))).alias("x"))
    best = up.select("_path", F.col("x.d").alias("_d"), F.col("x.dir").alias("_dir")).join(first, "_dir").groupBy("_path").agg(F.max_by("_dir", "_d").alias(root))
    return paths.select(F.col(path)).distinct().join(best.withColumnRenamed("_path", path), path, "left")


def latest(rows: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The last row of each key in the given order [JOIN-15, WIN-06]."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def shared_verifiers(verifies: DataFrame) -> DataFrame:
    """(requirement, n_verifier, shared): ``shared`` says that each of its verifiers verifies another requirement too [JOIN-11].

    From (verifier, requirement).
    """
    v = verifies.select("verifier", "requirement").distinct()
    load = v.groupBy("verifier").agg(F.count(F.lit(1)).alias("n"))
    return v.join(load, "verifier").groupBy("requirement").agg(F.count(F.lit(1)).alias("n_verifier"), F.min("n").alias("least")).select("requirement", "n_verifier", (F.col("least") > 1).alias("shared"))


def undirected_both(edge: DataFrame, one: str, two: str) -> DataFrame:
    """(a, b) with a <= b joined by both relations, whichever way each points [JOIN-22]."""
    e = edge.select(F.least("guid_source", "guid_target").alias("a"), F.greatest("guid_source", "guid_target").alias("b"), "id_relation")
    return e.where(F.col("id_relation") == one).select("a", "b").distinct().intersect(e.where(F.col("id_relation") == two).select("a", "b"))


def majority(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, majority, n): the value more than half of the rows have, null if none does; null is a value too [AGG-06]."""
    per = rows.groupBy(*group, value).agg(F.count(F.lit(1)).alias("c"))
    top = per.groupBy(*group).agg(F.sum("c").alias("n"), F.max(F.struct("c", value)).alias("x"))
    return top.select(*group, F.when(2 * F.col("x.c") > F.col("n"), F.col(f"x.{value}")).alias("majority"), "n")


def bound_breaks(edge: DataFrame, domain: DataFrame, relation: str, least: int, most: int) -> DataFrame:
    """(guid, n, ord, kind): items with fewer than ``least`` edges of a relation, items of the domain without any counted, and the first edge beyond ``most`` [AGG-14, WIN-04]."""
    mine = edge.where(F.col("id_relation") == relation)
    counts = domain.select(F.col("guid")).join(mine.groupBy(F.col("guid_source").alias("guid")).agg(F.count(F.lit(1)).alias("n")), "guid", "left")
    under = counts.where(F.coalesce("n", F.lit(0)) < least).select("guid", F.coalesce("n", F.lit(0)).alias("n"), F.lit(None).cast("bigint").alias("ord"), F.lit("under").alias("kind"))
    w = Window.partitionBy("guid_source").orderBy("ord")
    over = mine.withColumn("k", F.row_number().over(w)).where(F.col("k") == most + 1)
    over = over.join(mine.groupBy("guid_source").agg(F.count(F.lit(1)).alias("n")), "guid_source").select(F.col("guid_source").alias("guid"), "n", "ord", F.lit("over").alias("kind"))
    return under.unionByName(over)


def claimed_twice(rows: DataFrame, owner: str, words: str) -> DataFrame:
    """(word, n, owners): words that several owners claim; an owner counts once for a word [AGG-15]."""
    each = rows.select(owner, F.explode(F.array_distinct(words)).alias("word"))
    return each.groupBy("word").agg(F.countDistinct(owner).alias("n"), F.sort_array(F.collect_set(owner)).alias("owners")).where("n > 1")


def repeats(rows: DataFrame, keys: list[str], *order: Column | str, keep: list[str]) -> DataFrame:
    """The second and later rows of a key, each with the first one's ``keep`` columns as first_* [WIN-01, WIN-02, WIN-09, WIN-14]."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = rows.withColumn("nth", F.row_number().over(w))
    for c in keep:
        out = out.withColumn(f"first_{c}", F.first_value(c).over(w))
    return out.where("nth > 1")


def runs(rows: DataFrame, part: list[str], order: str, flag: Column, least: int) -> DataFrame:
    """(part, start, n): runs of at least ``least`` neighbouring rows for which the flag holds [WIN-13]."""
    w = Window.partitionBy(*part).orderBy(order)
    numbered = rows.withColumn("_f", F.coalesce(flag, F.lit(False))).withColumn("_i", F.row_number().over(w))
    only = numbered.where("_f").withColumn("_g", F.col("_i") - F.row_number().over(w))
    return only.groupBy(*part, "_g").agg(F.min(order).alias("start"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).drop("_g")


def worst_outcome(rows: DataFrame, keys: list[str], outcome: str, ranks: list[str]) -> DataFrame:
    """(keys, outcome, n): the outcome that stands first in ``ranks``; unknown ones rank last [AGG-11]."""
    rank = F.coalesce(F.array_position(F.array(*[F.lit(r) for r in ranks]), F.col(outcome)), F.lit(0))
    rank = F.when(rank == 0, len(ranks) + 1).otherwise(rank)
    return rows.groupBy(*keys).agg(F.min(F.struct(rank.alias("r"), F.col(outcome).alias("o"))).alias("x"), F.count(F.lit(1)).alias("n")).select(*keys, F.col("x.o").alias("outcome"), "n")


def first_per_group(rows: DataFrame, keys: list[str], n: int, *order: Column | str) -> DataFrame:
    """The first n rows of each group, numbered [WIN-07, SRT-07]."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("nth") <= n)


def upserted(old: DataFrame, new: DataFrame, key: str, ignore: tuple[str, ...] = ()) -> DataFrame:
    """Old rows with new ones of the same key in their place; a new row that differs in ignored columns only changes nothing [SNK-09, SET-09, STR-02, SUP-06]."""
    seen = [c for c in old.columns if c != key and c not in ignore]
    n = new.select(F.col(key), F.struct(*[c for c in old.columns if c != key]).alias("_new"))
    o = old.select(F.col(key), F.struct(*[c for c in old.columns if c != key]).alias("_old"))
    both = o.join(n, key, "full")
    same = reduce(lambda a, b: a & b, [F.col(f"_old.{c}").eqNullSafe(F.col(f"_new.{c}")) for c in seen], F.col("_old").isNotNull() & F.col("_new").isNotNull())
    pick = F.when(F.col("_new").isNull() | same, F.col("_old")).otherwise(F.col("_new"))
    return both.select(key, pick.alias("_x")).select(key, *[F.col(f"_x.{c}").alias(c) for c in old.columns if c != key])

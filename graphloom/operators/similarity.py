"""Exact set-similarity join over shingle sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.graph import components
from graphloom.session import written


class Similar:
    """``member``: (class, id) with one class for each distinct set; ``link``: (first, second, score) of classes."""

    def __init__(self, member: DataFrame, link: DataFrame) -> None:
        self.member, self.link = member, link

    def classes(self) -> DataFrame:
        """(id, class, n_copy, n_link): each record's class of equal sets, its size and the links its class has."""
        ends = self.link.select(F.explode(F.array("first", "second")).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("n_link"))
        size = self.member.groupBy("class").agg(F.count(F.lit(1)).alias("n_copy"))
        return self.member.join(size, "class").join(ends, "class", "left").select("id", "class", "n_copy", F.coalesce("n_link", F.lit(0)).alias("n_link"))

    def groups(self) -> DataFrame:
        """(id, group): records joined by equality or links, through others too; the group is its least class."""
        found = components(self.link.select(F.col("first").alias("a"), F.col("second").alias("b")))
        return self.member.join(found.select(F.col("node").alias("class"), F.col("component").alias("group")), "class", "left").select("id", F.coalesce("group", "class").alias("group"))


def similar(sets: DataFrame, id: str, items: str, threshold: float = 0.8) -> Similar:
    """Sets whose shared part is at least ``threshold`` of what either holds [SIM-01, JOIN-09, SET-04].

    Equal sets are one class, so copies cost nothing. Of each class only its
    rarest items, one more than may differ at the threshold, are joined;
    two sets alike enough share one of them. Common items therefore never
    meet, and each candidate is compared exactly. Null and empty sets are
    in no class.
    """
    rows = sets.select(F.col(id).alias("id"), F.array_sort(F.array_distinct(F.filter(F.col(items), lambda x: x.isNotNull()))).alias("set")).where(F.size("set") > 0)
    rows = rows.withColumns({"h1": F.xxhash64("set"), "h2": F.xxhash64(F.lit(3), "set")})
    first = rows.groupBy("h1", "h2").agg(F.min("id").alias("class"))
    member = written(rows.select("h1", "h2", "id").join(first, ["h1", "h2"]).select("class", "id"))
    heads = written(rows.join(member.where("class = id").select("id"), "id").select(F.col("id").alias("class"), F.transform("set", lambda x: F.xxhash64(x)).alias("set")))
    each = heads.select("class", F.size("set").alias("n"), F.explode("set").alias("x"))
    often = each.groupBy("x").agg(F.count(F.lit(1)).alias("df"))
    ranked = each.join(often, "x").groupBy("class").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "x"))).alias("by"))
    keep = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9).cast("int") + 1
    rare = ranked.select("class", "n", F.explode(F.slice("by", F.lit(1), keep)).alias("e")).select("class", "n", F.col("e.x").alias("x"))
    other = rare.select(F.col("class").alias("second"), F.col("n").alias("m"), "x")
    close = (F.col("n") >= threshold * F.col("m") - 1e-9) & (F.col("m") >= threshold * F.col("n") - 1e-9)
    pairs = rare.join(other, "x").where((F.col("class") < F.col("second")) & close).select(F.col("class").alias("first"), "second").distinct()
    a, b = heads.select(F.col("class").alias("first"), F.col("set").alias("s")), heads.select(F.col("class").alias("second"), F.col("set").alias("t"))
    common = F.size(F.array_intersect("s", "t"))
    scored = pairs.join(a, "first").join(b, "second").select("first", "second", (common / (F.size("s") + F.size("t") - common)).alias("score"))
    return Similar(member, written(scored.where(F.col("score") >= threshold - 1e-9)))

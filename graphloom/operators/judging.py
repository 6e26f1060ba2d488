"""What judges are asked: selection and rendering of tasks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.facts import FactDatabase


@dataclass(frozen=True)
class Eval:
    """One eval: which types it judges, and which pairs joined by a relation."""

    id: str
    types: tuple[str, ...] = ()
    relation: str | None = None
    include: tuple[str, ...] = ()


def tasks(db: FactDatabase, evals: list[Eval], wanted: DataFrame | None = None) -> DataFrame:
    """(id_eval, guid, guid_other): every item, or pair of items, that an eval is asked about [EVL-01, EVL-02, FLT-06, JOIN-08].

    A pair's dangling ends are dropped; with ``include`` both ends must be
    of those types; with ``wanted`` (guid), either end of a pair must be wanted.
    """
    out = None
    items = db.item.select("guid", "prefix")
    for e in evals:
        parts = []
        if e.types:
            parts.append(items.where(F.col("prefix").isin(*e.types)).select("guid", F.lit(None).cast("string").alias("guid_other")))
        if e.relation:
            a = items.select(F.col("guid").alias("guid_source"), F.col("prefix").alias("p1"))
            b = items.select(F.col("guid").alias("guid_target"), F.col("prefix").alias("p2"))
            pair = db.edge.where(F.col("id_relation") == e.relation).join(a, "guid_source").join(b, "guid_target")
            if e.include:
                pair = pair.where(F.col("p1").isin(*e.include) & F.col("p2").isin(*e.include))
            parts.append(pair.select(F.col("guid_source").alias("guid"), F.col("guid_target").alias("guid_other")).distinct())
        for p in parts:
            row = p.select(F.lit(e.id).alias("id_eval"), "guid", "guid_other")
            out = row if out is None else out.unionByName(row)
    if out is None:
        return items.limit(0).select(F.lit("").alias("id_eval"), "guid", F.lit(None).cast("string").alias("guid_other"))
    if wanted is None:
        return out
    w = wanted.select("guid").distinct()
    one = out.join(w, "guid", "left_semi").select(*out.columns)
    two = out.join(w.select(F.col("guid").alias("guid_other")), "guid_other", "left_semi").select(*out.columns)
    return one.unionByName(two).distinct()


def rendered(task: DataFrame, text: DataFrame) -> DataFrame:
    """``task`` with the text a judge reads: each item under a line with its id; tasks without text are dropped [EVL-03].

    ``text`` has (guid, id_self, said), one row an item.
    """
    block = F.when(F.trim(F.coalesce("said", F.lit(""))) != "", F.concat(F.lit("--- "), F.coalesce("id_self", "guid"), F.lit("\n"), F.trim("said"), F.lit("\n"))).otherwise("")
    blocks = text.select("guid", block.alias("b"))
    two = blocks.select(F.col("guid").alias("guid_other"), F.col("b").alias("b2"))
    return task.join(blocks, "guid", "left").join(two, "guid_other", "left").withColumn("text", F.concat(F.coalesce("b", F.lit("")), F.coalesce("b2", F.lit("")))).where("text <> ''").select("id_eval", "guid", "guid_other", "text")


def cost(task: DataFrame, confirm: int) -> DataFrame:
    """(id_eval, calls, calls_most, characters) of asking the tasks [AGG-17, UDF-04]."""
    return task.groupBy("id_eval").agg(F.count(F.lit(1)).alias("calls"), (F.count(F.lit(1)) * confirm).alias("calls_most"), F.sum(F.length("text")).alias("characters"))


def covered_classes(sets: DataFrame, classes: tuple[str, ...]) -> DataFrame:
    """(guid, class, state) of every set and class: 'not reviewed' without any table, 'silent' without the class, 'uncovered' or 'covered' [SUP-14].

    ``sets`` has (guid, coverage), coverage a map from class to whether it is covered.
    """
    each = sets.select("guid", "coverage", F.explode(F.array(*[F.lit(c) for c in classes])).alias("class"))
    got = F.expr("coverage[class]")
    return each.select("guid", "class", F.when(F.col("coverage").isNull(), "not reviewed").when(got.isNull(), "silent").when(got, "covered").otherwise("uncovered").alias("state"))


def reports(findings: DataFrame, executions: DataFrame) -> DataFrame:
    """Findings of completed or failed executions as records, null fields left out [PRJ-07, SUP-39].

    findings: (id_execution, id_check, guid, message); executions: (id_execution, status).
    """
    kept = executions.where("status in ('completed', 'failed')").select("id_execution")
    return findings.join(kept, "id_execution", "left_semi").select("id_execution", "id_check", F.to_json(F.struct("id_check", "guid", "message"), {"ignoreNullFields": "true"}).alias("record"))

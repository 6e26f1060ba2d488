"""Assurance: requirements, their gaps, impact and staleness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.graph import propagate

CRITICAL, ADVISORY = "critical", "advisory"


def gap_list(closed_world: bool) -> Column:
    """What a requirement lacks, as an array of (rule, severity) in rule order [PRJ-02].

    Reads status, n_derives, has_criteria, verification, is_leaf,
    n_implemented, n_verified, shared, demands_verdict and claim. A
    deprecated requirement lacks nothing. What an accepted one claims
    itself is critical when missing; what may stand elsewhere is so in a
    closed world only; a shared verdict is so where a verdict is demanded
    or the claim is evidential.
    """
    accepted = F.coalesce(F.col("status") == "accepted", F.lit(False))
    claimed = F.when(accepted, CRITICAL).otherwise(ADVISORY)
    elsewhere = F.when(accepted & F.lit(closed_world), CRITICAL).otherwise(ADVISORY)
    shared = F.when(F.col("demands_verdict") | F.coalesce(F.col("claim") == "evidential", F.lit(False)), CRITICAL).otherwise(ADVISORY)
    gap = lambda test, rule, severity: F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(rule).alias("rule"), severity.alias("severity")))
    rules = F.array_compact(
        F.array(
            gap(F.col("n_derives") == 0, "derives_from_nothing", claimed),
            gap(accepted & ~F.col("has_criteria"), "no_criteria", claimed),
            gap(accepted & F.col("verification").isNull(), "no_method", claimed),
            gap(F.col("is_leaf") & (F.col("n_implemented") == 0), "not_implemented", elsewhere),
            gap(F.col("verification").isNotNull() & (F.col("n_verified") == 0), "not_verified", elsewhere),
            gap(F.col("shared"), "shared_verdict", shared),
        )
    )
    return F.when(F.coalesce(F.col("status") == "deprecated", F.lit(False)), F.slice(rules, 1, 0)).otherwise(rules)


def requirements(attributes: DataFrame, edge: DataFrame, derives: str = "r_derives_from", implements: str = "r_implements", verifies: str = "r_verifies") -> DataFrame:
    """One row a requirement with counts of its links [PRJ-01].

    attributes: (guid, id_self, status, has_criteria, verification, claim,
    demands_verdict), one row a requirement. Implementers and verifiers point at it; it points at
    what it derives from. ``shared`` says that it is verified, and only by
    what verifies another requirement too.
    """
    mine = attributes.select("guid")
    end = lambda relation, at, to: edge.where(F.col("id_relation") == relation).select(F.col(at).alias("guid"), F.col(to).alias("other")).distinct()
    count = lambda df, name: df.groupBy("guid").agg(F.count(F.lit(1)).alias(name))
    up = count(end(derives, "guid_source", "guid_target"), "n_derives")
    children = count(end(derives, "guid_target", "guid_source").join(mine.select(F.col("guid").alias("other")), "other", "left_semi"), "n_child")
    done = count(end(implements, "guid_target", "guid_source"), "n_implemented")
    seen = end(verifies, "guid_target", "guid_source").join(mine, "guid", "left_semi")
    load = seen.groupBy("other").agg((F.count(F.lit(1)) > 1).alias("busy"))
    checks = seen.join(load, "other").groupBy("guid").agg(F.count(F.lit(1)).alias("n_verified"), F.bool_and("busy").alias("shared"))
    out = attributes
    for part in (up, children, done, checks):
        out = out.join(part, "guid", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n_derives", "n_child", "n_implemented", "n_verified")}
    return out.withColumns(zero).withColumns({"shared": F.coalesce("shared", F.lit(False)), "is_leaf": F.col("n_child") == 0})


def gaps(projected: DataFrame, closed_world: bool = False) -> DataFrame:
    """(guid, id_self, rule, severity), one row a gap [CHK-17, SRT-02]."""
    return projected.select("guid", "id_self", F.inline(gap_list(closed_world)))


def accept_gate(projected: DataFrame) -> DataFrame:
    """(guid, may_accept): whether a requirement would have no gap were it accepted in a closed world [PRJ-08]."""
    as_if = projected.withColumn("status", F.lit("accepted"))
    return as_if.select("guid", (F.size(gap_list(True)) == 0).alias("may_accept"))


def impact(edge: DataFrame, requirement: DataFrame) -> DataFrame:
    """(guid, implements, verifies): sorted requirements that each item implements or verifies [GRF-08]."""
    e = edge.where("id_relation in ('r_implements', 'r_verifies')").join(requirement.select(F.col("guid").alias("guid_target")), "guid_target", "left_semi")
    pick = lambda r: F.sort_array(F.collect_set(F.when(F.col("id_relation") == r, F.col("guid_target"))))
    return e.groupBy(F.col("guid_source").alias("guid")).agg(pick("r_implements").alias("implements"), pick("r_verifies").alias("verifies"))


def demanded(edge: DataFrame, declared: DataFrame, demands: DataFrame, relations: list[str]) -> DataFrame:
    """(guid, id_objective): objectives that the criticality reaching an item demands [PRJ-03, SUP-12].

    declared: (node, dimension, level); demands: (dimension, level, id_objective).
    """
    links = edge.where(F.col("id_relation").isin(relations)).select(F.col("guid_source").alias("a"), F.col("guid_target").alias("b"))
    return propagate(links, declared).join(demands, ["dimension", "level"]).select(F.col("node").alias("guid"), "id_objective").distinct()


def drifted(subjects: DataFrame, current: DataFrame) -> DataFrame:
    """(record, state): 'holds' where every subject is there with the digest noted, else 'stale' [FN-27, CHK-12, CHK-19, STR-03].

    subjects: (record, subject, digest); current: (subject, digest), unique.
    """
    now = current.select("subject", F.col("digest").alias("now"))
    same = F.coalesce(F.col("digest") == F.col("now"), F.lit(False))
    return subjects.join(now, "subject", "left").groupBy("record").agg(F.when(F.bool_and(same), "holds").otherwise("stale").alias("state"))


def evidence_state(required: DataFrame, evidence: DataFrame) -> DataFrame:
    """required (method, case, requirement, digest) with state: absent, failed, stale or held [CHK-18, JOIN-12].

    evidence: (method, case, requirement, outcome, digest); a null case
    matches a null case; of several rows any passed and current one holds.
    """
    e = evidence.select(F.col("method").alias("m"), F.col("case").alias("c"), F.col("requirement").alias("r"), "outcome", F.col("digest").alias("had"))
    on = (F.col("method") == F.col("m")) & F.col("case").eqNullSafe(F.col("c")) & (F.col("requirement") == F.col("r"))
    rank = F.when(F.col("r").isNull(), 3).when(F.coalesce(F.col("outcome"), F.lit("")) != "passed", 2).when(F.col("had").eqNullSafe(F.col("digest")), 0).otherwise(1)
    best = required.join(e, on, "left").groupBy("method", "case", "requirement", "digest").agg(F.min(rank).alias("k"))
    names = F.element_at(F.array(F.lit("held"), F.lit("stale"), F.lit("failed"), F.lit("absent")), F.col("k") + 1)
    return best.withColumn("state", names).drop("k")

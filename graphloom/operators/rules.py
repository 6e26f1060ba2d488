"""Integrity rules: each is a function from a context to findings.

A finding is (id_check, guid, path, severity, message). A rule that raises
is reported as an error of its own, apart from findings.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.keys import key, prefix_of
from graphloom.functions.text import well_formed
from graphloom.operators.assurance import ADVISORY, CRITICAL, gaps
from graphloom.operators.facts import FactDatabase
from graphloom.operators.graph import on_cycles, reach, redundant
from graphloom.operators.relational import bound_breaks, majority, repeats, undirected_both
from graphloom.session import written

FINDING = "id_check string, guid string, path string, severity string, message string"


@dataclass
class Relation:
    """What a register says of one relation."""

    id: str
    domain: tuple[str, ...] = ()
    range: tuple[str, ...] = ()
    acyclic: bool = False
    transitive: bool = False
    incompatible: tuple[str, ...] = ()
    least: int = 0
    most: int | None = None


@dataclass
class Context:
    """What rules read."""

    db: FactDatabase
    deliveries: DataFrame
    register: DataFrame
    relations: tuple[Relation, ...] = ()
    consumes: dict[str, tuple[str, ...]] = field(default_factory=dict)
    requirements: DataFrame | None = None
    closed_world: bool = False

    @property
    def spark(self) -> SparkSession:
        return self.db.spark


Rule = Callable[[Context], DataFrame]
RULES: dict[str, Rule] = {}


def rule(name: str) -> Callable[[Rule], Rule]:
    def add(f: Rule) -> Rule:
        RULES[name] = f
        return f

    return add


def finding(rows: DataFrame, check: str, guid: Column | str, path: Column | str, severity: Column | str, message: Column) -> DataFrame:
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    return rows.select(F.lit(check).alias("id_check"), as_col(guid).alias("guid"), as_col(path).alias("path"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), message.alias("message"))


@rule("identity")
def identity(c: Context) -> DataFrame:
    """A guid declared at a second place, with the first [CHK-02, WIN-01]."""
    places = c.deliveries.where("guid is not null").groupBy("guid", "location").agg(F.min("ord").alias("ord"))
    twice = repeats(places, ["guid"], "ord", "location", keep=["location"])
    return finding(twice, "identity", "guid", F.lit("guid_self"), CRITICAL, F.concat_ws(" ", F.lit("declared first at"), "first_location"))


@rule("identifier")
def identifier(c: Context) -> DataFrame:
    """Ids and guids of the wrong form, and a readable id of a second guid [CHK-03, WIN-02, FN-24]."""
    form = c.db.item.select("guid", "id_self", F.explode(well_formed("id_self", "guid")).alias("fault"))
    out = finding(form, "identifier", "guid", F.lit("id_self"), CRITICAL, F.concat_ws(" ", "fault", F.coalesce("id_self", F.lit(""))))
    again = repeats(c.db.item.where("id_self is not null"), ["id_self"], "ord", "guid", keep=["guid"])
    return out.unionByName(finding(again, "identifier", "guid", F.lit("id_self"), CRITICAL, F.concat_ws(" ", F.lit("readable id of"), "first_guid")))


@rule("reference")
def reference(c: Context) -> DataFrame:
    """Targets that are no record; readable ids that aren't the target's [CHK-05]."""
    names = c.db.item.select("guid", key("id_self").alias("id")).unionByName(c.register.select(key("guid").alias("guid"), key("id_self").alias("id")))
    names = names.groupBy(F.col("guid").alias("guid_target")).agg(F.max("id").alias("id"), F.lit(True).alias("there"))
    e = c.db.edge.join(names, "guid_target", "left")
    lost = e.where("there is null")
    worn = e.where("there and id is not null and id_target is not null and id_target <> id")
    path = F.concat(F.lit("relation."), F.col("ord").cast("string"))
    a = finding(lost, "reference", "guid_source", path, CRITICAL if c.closed_world else ADVISORY, F.concat_ws(" ", F.lit("no record"), "guid_target"))
    return a.unionByName(finding(worn, "reference", "guid_source", path, ADVISORY, F.concat_ws(" ", F.lit("stale id"), "id_target", F.lit("for"), "id")))


@rule("segment")
def segment(c: Context) -> DataFrame:
    """References out of a segment into one it doesn't consume, at any distance [CHK-06, GRF-12]; a type's directory is its segment."""
    pairs = [(a, b) for a, bs in c.consumes.items() for b in bs]
    known = sorted({*c.consumes, *(b for _, b in pairs)})
    links = c.spark.createDataFrame(pairs, "a string, b string")
    seen = reach(links, c.spark.createDataFrame([(k, k) for k in known], "root string, node string")).select(F.col("root").alias("from"), F.col("node").alias("to"))
    own = c.db.item.select("guid", F.substring_index("location", "/", 1).alias("seg")).where(F.col("seg").isin(known))
    e = c.db.edge.join(own.select(F.col("guid").alias("guid_source"), F.col("seg").alias("from")), "guid_source").join(own.select(F.col("guid").alias("guid_target"), F.col("seg").alias("to")), "guid_target")
    out = e.join(seen, ["from", "to"], "left_anti")
    return finding(out, "segment", "guid_source", F.concat(F.lit("relation."), F.col("ord").cast("string")), CRITICAL, F.concat_ws(" ", "from", F.lit("does not consume"), "to"))


@rule("rights")
def rights(c: Context) -> DataFrame:
    """Items whose status differs from the strict majority of their directory [CHK-07, AGG-06]."""
    rows = c.db.item.select("guid", "status", F.substring_index("location", "/", 1).alias("seg"))
    most = majority(rows, ["seg"], "status").where("majority is not null")
    off = rows.join(most, "seg").where("status is null or status <> majority")
    return finding(off, "rights", "guid", F.lit("status"), CRITICAL, F.concat_ws(" ", F.coalesce("status", F.lit("none")), F.lit("among"), "majority"))


@rule("relation")
def relation(c: Context) -> DataFrame:
    """Ends outside domain or range, cycles, redundant and incompatible edges, and too few or too many [CHK-08, JOIN-21, JOIN-22, AGG-14]."""
    types = c.db.item.select("guid", "prefix")
    e = c.db.edge.join(types.select(F.col("guid").alias("guid_source"), F.col("prefix").alias("from")), "guid_source", "left").withColumn("to", prefix_of("guid_target"))
    path = F.concat(F.lit("relation."), F.col("ord").cast("string"))
    out = c.spark.createDataFrame([], FINDING)
    for r in c.relations:
        mine = e.where(F.col("id_relation") == r.id)
        links = mine.select(F.col("guid_source").alias("a"), F.col("guid_target").alias("b"))
        say = lambda text, r=r: F.lit(f"{r.id} {text}")
        if r.domain:
            out = out.unionByName(finding(mine.where(~F.col("from").isin(*r.domain)), "relation", "guid_source", path, CRITICAL, say("from outside its domain")))
        if r.range:
            out = out.unionByName(finding(mine.where(~F.col("to").isin(*r.range)), "relation", "guid_source", path, CRITICAL, say("to outside its range")))
        if r.acyclic:
            out = out.unionByName(finding(on_cycles(links), "relation", "a", F.lit("relation"), CRITICAL, F.concat_ws(" ", say("leads round to"), "b")))
        if r.transitive:
            out = out.unionByName(finding(redundant(links), "relation", "a", F.lit("relation"), ADVISORY, F.concat_ws(" ", say("is implied to"), "b")))
        for other in r.incompatible:
            out = out.unionByName(finding(undirected_both(c.db.edge, r.id, other), "relation", "a", F.lit("relation"), CRITICAL, F.concat_ws(" ", say(f"beside {other} with"), "b")))
        if r.least or r.most is not None:
            domain = c.db.item.where(F.col("prefix").isin(*r.domain)) if r.domain else c.db.item.limit(0)
            out = out.unionByName(finding(bound_breaks(c.db.edge, domain, r.id, r.least, r.most if r.most is not None else 2**31 - 2), "relation", "guid", F.lit("relation"), CRITICAL, F.concat_ws(" ", say("count"), "kind", F.col("n").cast("string"))))
    return out


@rule("trace")
def trace(c: Context) -> DataFrame:
    """Gaps of the requirements [CHK-17]."""
    if c.requirements is None:
        return c.spark.createDataFrame([], FINDING)
    return finding(gaps(c.requirements, c.closed_world), "trace", "guid", F.lit("requirement"), F.col("severity"), F.col("rule"))


def run(c: Context, skip: tuple[str, ...] = (), only: tuple[str, ...] = ()) -> tuple[DataFrame, dict[str, str]]:
    """All findings in rule order, and the errors of rules that raised [SET-07, FLT-09].

    Each rule's findings are written as it runs, so what fails only when
    rows are read is that rule's error too, and no finding of the others.
    """
    out, errors = c.spark.createDataFrame([], FINDING), {}
    for name, f in RULES.items():
        if name in skip or (only and name not in only):
            continue
        try:
            out = out.unionByName(written(f(c)))
        except Exception as problem:  # a rule's own failure is no finding
            errors[name] = f"{type(problem).__name__}: {problem}"
    return out, errors


def report(findings: DataFrame, checks: list[str], errors: dict[str, str] | None = None) -> DataFrame:
    """(id_check, n_critical, n_advisory, status) of every check run [AGG-13]."""
    errors = errors or {}
    all_ = findings.sparkSession.createDataFrame([(k, k in errors) for k in checks], "id_check string, failed boolean")
    n = findings.groupBy("id_check").agg(F.count_if(F.col("severity") == CRITICAL).alias("n_critical"), F.count_if(F.col("severity") == ADVISORY).alias("n_advisory"))
    r = all_.join(n, "id_check", "left").withColumns({k: F.coalesce(k, F.lit(0)) for k in ("n_critical", "n_advisory")})
    status = F.when(F.col("failed"), "error").when(F.col("n_critical") > 0, "nonconformity").when(F.col("n_advisory") > 0, "advisory").otherwise("ok")
    return r.select("id_check", "n_critical", "n_advisory", status.alias("status"))


def refused(summary: DataFrame, checkpoint: bool = False) -> bool:
    """Whether a report forbids going on: any error does, any critical finding unless at a checkpoint."""
    bad = "status = 'error'" if checkpoint else "status in ('error', 'nonconformity')"
    return not summary.where(bad).isEmpty()

"""Judgement: screening, confirmation and the measured quality of a judge."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MET, UNMET, UNKNOWN = "met", "unmet", "unknown"


def majority(samples: Column) -> Column:
    """'unmet' where more than half of an odd number of samples say so, else 'met' [AGG-07]; unknown counts for neither."""
    return F.when(2 * F.size(F.filter(samples, lambda v: v == UNMET)) > F.size(samples), UNMET).otherwise(MET)


def odd(n: int) -> int:
    """The number of samples, refused unless odd and positive [SUP-28]."""
    if n < 1 or n % 2 == 0:
        raise ValueError(f"{n} samples can tie")
    return n


def rates(cases: DataFrame) -> DataFrame:
    """(origin, cases, samples, false_positive, false_negative, unanimous) per origin, and of all [AGG-08, EVL-06].

    ``cases`` has origin, verdict and an array of samples. A rate over no
    cases is null; no cases at all is an error of the caller's, and gives
    no rows but the pooled one with zero.
    """
    voted = majority(F.col("samples"))
    rows = cases.select(
        "origin",
        F.size("samples").alias("k"),
        F.when(F.col("verdict") == MET, (voted == UNMET).cast("int")).alias("fp"),
        F.when(F.col("verdict") == UNMET, (voted == MET).cast("int")).alias("fn"),
        (F.size(F.array_distinct("samples")) == 1).cast("int").alias("u"),
    )
    return cases.sparkSession.sql(
        """select case when grouping(origin) = 1 then 'all' else origin end as origin, count(*) as cases, max(k) as samples,
           round(avg(fp), 3) as false_positive, round(avg(fn), 3) as false_negative, round(avg(u), 3) as unanimous
           from {judged} group by grouping sets ((origin), ())""",
        judged=rows,
    )


def screened(tasks: DataFrame, screen: Callable[[Column], Column], again: Callable[[Column, int], Column], text: str, confirm: int = 5) -> DataFrame:
    """``tasks`` with verdict and asked: a task that the screen passes is met; the rest is asked again and the majority decides [EVL-05].

    The screening vote counts among the ``confirm`` samples.
    """
    odd(confirm)
    word = lambda c: F.when(c, MET).otherwise(UNMET)
    passed = F.coalesce(screen(F.col(text)), F.lit(False))
    samples = F.array(F.lit(UNMET), *[word(again(F.col(text), i)) for i in range(1, confirm)])
    return tasks.withColumn("asked", ~passed).withColumn("verdict", F.when(passed, MET).otherwise(majority(samples)))


def stale(measured: DataFrame, current: DataFrame, model: str) -> DataFrame:
    """Evals with cases but without a row of the model, or with any row whose digest isn't the current one [EVL-07, STR-03].

    measured: (id_eval, model, digest); current: (id_eval, digest, n_case).
    """
    rows = measured.where(F.col("model") == model).select("id_eval", F.col("digest").alias("old"))
    joined = current.where("n_case > 0").join(rows, "id_eval", "left")
    fresh = F.coalesce(F.bool_and(F.col("old") == F.col("digest")), F.lit(False))
    return joined.groupBy("id_eval").agg(fresh.alias("fresh")).where("not fresh").select("id_eval")


def sweep(findings: DataFrame, disowned: list[str]) -> DataFrame:
    """(id_eval, rule, n, n_item, messages) from (id_eval, item, message): findings grouped by eval and the first rule named that isn't disowned, largest first [AGG-12, EVL-10]."""
    rules = F.array_except(F.regexp_extract_all("message", F.lit(r"(rule_[a-z0-9_]+)"), F.lit(1)), F.array(*[F.lit(x) for x in disowned]).cast("array<string>"))
    rows = findings.select("id_eval", "item", "message", F.element_at(F.when(F.size(rules) > 0, rules), 1).alias("rule"))
    out = rows.groupBy("id_eval", "rule").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("item").alias("n_item"))
    first = F.slice(F.sort_array(F.collect_set("message")), 1, 3)
    return out.join(rows.groupBy("id_eval", "rule").agg(first.alias("messages")).withColumnsRenamed({"id_eval": "e", "rule": "r"}), F.col("id_eval").eqNullSafe(F.col("e")) & F.col("rule").eqNullSafe(F.col("r"))).drop("e", "r").orderBy(F.desc("n"), "id_eval", "rule")

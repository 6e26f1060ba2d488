"""Problem 5: deeply nested records as flat, linked tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators.nesting import nested
from graphloom.plans.registry import CORE
from graphloom.session import table


def _hex(df):
    return df.withColumn("hash", F.lower(F.hex("hash")))


@CORE.add("p5_found")
def p5_found(spark, folder):
    return nested(table(spark, folder, "held")).items().where("guid_holder is not null").select("location", "path", "guid_holder")


@CORE.add("p5_objects")
def p5_objects(spark, folder):
    return _hex(nested(table(spark, folder, "held")).object)


@CORE.add("p5_bridge")
def p5_bridge(spark, folder):
    return _hex(nested(table(spark, folder, "held")).bridge)


@CORE.add("p5_sharing")
def p5_sharing(spark, folder):
    """How often each distinct object occurs, and in how many documents."""
    n = nested(table(spark, folder, "held"))
    counts = n.bridge.groupBy("hash").agg(F.count(F.lit(1)).alias("n_occurrence"), F.countDistinct("location").alias("n_location"))
    return _hex(counts.join(n.object.select("hash", "is_item", "n_child"), "hash"))

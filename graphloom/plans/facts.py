"""The fact tables of a data folder, and the SQL that derives the same facts."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

from graphloom.functions.keys import SPACE
from graphloom.operators.facts import FactDatabase
from graphloom.session import still_there, table

FACTS = f"""item_f as (
  select guid, id_self, split_part(coalesce(id_self, ''), '_', 1) as prefix, status, location, ord from (
    select *, row_number() over (partition by lower(trim(guid, '{SPACE}')) order by recorded_at desc nulls last, status desc nulls last, id_self desc nulls last, location desc nulls last, ord desc) as n
    from item where guid is not null) where n = 1),
edge_f as (
  select ord, nullif(lower(trim(guid_source, '{SPACE}')), '') as guid_source, id_relation, nullif(lower(trim(guid_target, '{SPACE}')), '') as guid_target, nullif(lower(trim(id_target, '{SPACE}')), '') as id_target
  from edge where nullif(trim(guid_source, '{SPACE}'), '') is not null and nullif(trim(guid_target, '{SPACE}'), '') is not null),
containment_f as (
  select guid_holder, guid_held from (
    select *, row_number() over (partition by guid_held order by ord desc) as n from containment where guid_held is not null)
  where n = 1 and guid_holder is not null)
"""


def over_facts(sql: str, recursive: bool = False) -> str:
    """Comparison SQL over the derived facts: item, edge and containment after FROM or JOIN mean those."""
    body = re.sub(r"\b(from|join)\s+(item|edge|containment)\b", r"\1 \2_f", sql, flags=re.IGNORECASE).strip()
    head = "with recursive " if recursive else "with "
    return head + FACTS + (", " + body[5:] if body[:5].lower() == "with " else body)


_STORED: dict[tuple, FactDatabase] = {}


def _stamp(spark: SparkSession, path: str) -> tuple:
    """What changes when a table's files do."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return path, system.getFileStatus(where).getModificationTime(), system.getContentSummary(where).getLength()


def database(spark: SparkSession, folder: str) -> FactDatabase:
    """The fact database of a data folder, derived and stored once while the application lasts and its tables stay as they are."""
    names = ("item", "edge", "containment")
    stamp = (spark.sparkContext.applicationId, *(_stamp(spark, f"{folder}/{n}.parquet") for n in names))
    if stamp not in _STORED or not all(still_there(df) for df in (_STORED[stamp].item, _STORED[stamp].edge, _STORED[stamp].containment)):
        _STORED[stamp] = FactDatabase.of(*(table(spark, folder, n) for n in names))
    return _STORED[stamp]

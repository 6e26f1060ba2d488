"""Streams run to the end of their input, held against the same result in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions.keys import SPACE
from graphloom.plans.registry import CORE
from graphloom.session import table
from graphloom.streaming import incremental as S


@CORE.add("str01_first_captures", "select distinct content_digest from observation where content_digest is not null")
def str01_first_captures(spark, folder):
    return S.first_captures(spark, f"{folder}/observation.parquet", ["content_digest"]).where("content_digest is not null")


@CORE.add("str02_upserting", "select guid, status, recorded_at from (select *, row_number() over (partition by guid order by recorded_at desc nulls last, status desc nulls last) as n from item) where n = 1")
def str02_upserting(spark, folder):
    return S.upserting(spark, f"{folder}/item.parquet", "guid", "recorded_at", ["status"])


@CORE.add("str03_stale_captures", "with l as (select source_kind, max(content_digest) as now from observation where source_kind is not null group by 1) select o.source_kind, o.content_digest from observation o join l using (source_kind) where content_digest is distinct from now")
def str03_stale_captures(spark, folder):
    """Captures whose digest isn't the greatest of their kind, which stands for the current one."""
    now = table(spark, folder, "observation").where("source_kind is not null").groupBy("source_kind").agg(F.max("content_digest").alias("content_digest"))
    return S.stale_captures(spark, f"{folder}/observation.parquet", now, "source_kind", "content_digest")


@CORE.add("str_windowed_counts", "select time_bucket(interval 1 day, ts, timestamp '1970-01-01') as start, event_type, count(*) as n from events where ts is not null group by 1, 2")
def str_windowed_counts(spark, folder):
    return S.windowed_counts(spark, f"{folder}/events.parquet", "ts", "event_type")


@CORE.add("str06_capped", f"select nullif(lower(trim(guid_source, '{SPACE}')), '') as key, least(count(*), 3) as n, count(*) > 3 as exhausted from edge where guid_source is not null group by 1")
def str06_capped(spark, folder):
    return S.capped(spark, f"{folder}/edge.parquet", "guid_source", 3, "ord")

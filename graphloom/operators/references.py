"""References to records that do not exist."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.bitmap import BITS, EMPTY, Container
from graphloom.functions.keys import is_deleted, key
from graphloom.session import written

#: Period of a reference without a time: later than any month.
UNDATED = 1 << 30
#: Month from which a record without any time counts as there: before any month.
ALWAYS = -(1 << 30)


def month_of(when: Column | str) -> Column:
    """Months since year 0."""
    return F.year(when) * 12 + F.month(when) - 1


def parents(*tables: DataFrame) -> DataFrame:
    """(kind, key, alive, since) of every guid ('g') and readable id ('i') that the tables hold.

    Each table has guid, id_self, status and recorded_at. The row of a guid
    with the greatest recorded_at holds (null times are least; ties go to the
    greatest status, then id); its least recorded_at is when it arrived. Keys
    are compared in normal form. A key of several records is alive if any of
    them isn't deleted, since the first such arrived.
    """
    rows = None
    for t in tables:
        part = t.select(key("guid").alias("guid"), key("id_self").alias("id"), "status", "recorded_at")
        rows = part if rows is None else rows.unionByName(part)
    held = (
        rows.where("guid is not null")
        .groupBy("guid")
        .agg(F.max(F.struct("recorded_at", "status", "id")).alias("last"), F.min("recorded_at").alias("since"))
        .select("guid", F.col("last.id").alias("id"), is_deleted("last.status").alias("deleted"), "since")
    )
    since = F.when(~F.col("deleted"), F.coalesce("since", F.lit("0001-01-01").cast(held.schema["since"].dataType)))
    pair = F.explode(F.array(F.struct(F.lit("g").alias("kind"), F.col("guid").alias("key")), F.struct(F.lit("i").alias("kind"), F.col("id").alias("key"))))
    return (
        held.select(pair.alias("k"), since.alias("since"))
        .where("k.key is not null")
        .groupBy("k.kind", "k.key")
        .agg(F.min("since").alias("since"))
    )


def references(edges: DataFrame, order: str = "ord", when: str = "recorded_at") -> DataFrame:
    """(ord, field, kind, key, at, period): one row for each non-blank reference of an edge row."""
    one = lambda kind, name: F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("field"), key(name).alias("key"))
    return (
        edges.select(F.col(order).alias("ord"), F.col(when).alias("at"), F.explode(F.array(one("g", "guid_source"), one("g", "guid_target"), one("i", "id_target"))).alias("r"))
        .where("r.key is not null")
        .select("ord", "r.field", "r.kind", "r.key", "at", F.coalesce(month_of("at"), F.lit(UNDATED)).alias("period"))
    )


def _survivors(group: pd.DataFrame) -> pd.DataFrame:
    """Reference AND NOT parent for one key range, period by period."""
    low = (group["id"].to_numpy() & ((1 << BITS) - 1)).astype(np.int64)
    base = int(group["id"].iloc[0]) >> BITS << BITS
    count = group["periods"].map(len).to_numpy()
    flat = np.concatenate([np.asarray(p, np.int64) for p in group["periods"]]) if count.sum() else np.zeros(0, np.int64)
    place = np.repeat(low, count)
    month = group["month"].to_numpy(dtype=float, na_value=np.nan)
    there = {int(m): Container.of(low[month == m]) for m in np.unique(month[~np.isnan(month)])}
    waiting, known, out = sorted(there), EMPTY, []
    for period in np.unique(flat):
        while waiting and waiting[0] < period:
            known = known.union(there[waiting.pop(0)])
        left = Container.of(place[flat == period]).minus(known).members()
        out.append(pd.DataFrame({"id": base + left.astype(np.int64), "period": np.full(len(left), period, np.int32)}))
    return pd.concat(out) if out else pd.DataFrame({"id": np.zeros(0, np.int64), "period": np.zeros(0, np.int32)})


def dictionary(refs: DataFrame, known: DataFrame) -> DataFrame:
    """(id, kind, key, periods, present, since): every key as an integer, written to the shared folder.

    Keys are aggregated before the shuffle, so a hot key costs one row a
    task. An id is a task's number and the row's place in its output; ids
    are stable because they are read back from the written table.
    """
    none = lambda kind: F.lit(None).cast(kind)
    both = refs.select("kind", "key", "period", none(known.schema["since"].dataType).alias("since"), F.lit(False).alias("present")).unionByName(
        known.select("kind", "key", none("int").alias("period"), "since", F.lit(True).alias("present"))
    )
    keys = both.groupBy("kind", "key").agg(F.collect_set("period").alias("periods"), F.max("present").alias("present"), F.max("since").alias("since"))
    return written(keys.withColumn("id", F.monotonically_increasing_id()))


def failing_keys(words: DataFrame) -> DataFrame:
    """(kind, key, period, present, since) of the keys that bitmaps leave as not known before a period began.

    Key ranges of 2**15 ids are grouped; of each, compressed bitmaps of the
    referred keys per period and of the records there per month are
    subtracted and the bits left decoded. Keys of records that arrive within
    the period itself are among the result; the exact time decides later.
    """
    month = F.when(F.col("since").isNotNull(), F.when(F.year("since") < 2, F.lit(ALWAYS)).otherwise(month_of("since")))
    left = (
        words.select("id", "periods", month.alias("month"), F.shiftright("id", BITS).alias("range"))
        .groupBy("range")
        .applyInPandas(lambda g: _survivors(g), "id bigint, period int")
    )
    return left.join(words.select("id", "kind", "key", "present", "since"), "id").drop("id")


def missing_references(edges: DataFrame, *tables: DataFrame) -> DataFrame:
    """(ord, field, reason, key, at) for every reference that fails.

    reason is ``missing`` (no record has the key), else ``deleted`` (every
    record with it is deleted), else ``late`` (the record arrived after the
    edge's time; an edge without a time is never late). Null and blank keys
    are no references; every edge row counts by itself, repeats included.
    Empty tables give an empty result; other columns are ignored.
    """
    refs = references(edges)
    bad = failing_keys(dictionary(refs, parents(*tables)))
    reason = F.when(~F.col("present"), "missing").when(F.col("since").isNull(), "deleted").when(F.col("since") > F.col("at"), "late")
    return (
        refs.join(bad, ["kind", "key", "period"])
        .select("ord", "field", reason.alias("reason"), "key", "at")
        .where("reason is not null")
    )


def orphan_report(failed: DataFrame) -> DataFrame:
    """References that fail, counted by referred table (key prefix), field, month and reason."""
    return failed.groupBy(
        F.substring_index("key", "_", 1).alias("table"), "field", F.date_format("at", "yyyy-MM").alias("month"), "reason"
    ).agg(F.count(F.lit(1)).alias("n_reference"), F.countDistinct("key").alias("n_key"))

"""Incremental ingestion: streams that end when their input is read, with a batch view of what they made."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.keys import key
from graphloom.session import forget, shared_folder, written


def _places(spark: SparkSession) -> tuple[str, str]:
    base = f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    return f"{base}/out", f"{base}/checkpoint"


def source(spark: SparkSession, path: str) -> DataFrame:
    """A parquet file, or a folder of them, as a stream; written as a pattern, since a stream's plain path must be a folder."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def drained(stream: DataFrame, out: str, checkpoint: str, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> None:
    """Run a stream over all that is there, then end [STR-04]."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = (writer.foreachBatch(each) if each else writer.format("parquet").option("path", out)).start()
    query.awaitTermination()


#: Parts of a merged table; a batch writes only those that it touches.
BUCKETS = 32


class Merged:
    """A table of one row a key that batches merge into, kept with its versions in a folder.

    Batch n writes the parts that it touches to ``b<n>/bucket=<k>``; of a
    part the greatest complete version holds. Nothing is kept in the driver,
    so a later run over the same folder goes on where the last one ended,
    and a batch that runs twice reads only what was there before it.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], best: Callable[[DataFrame], DataFrame]) -> None:
        self.spark, self.folder, self.keys, self.best = spark, folder.rstrip("/"), keys, best

    def _list(self, path: str) -> list[str]:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        system = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return [x.getPath().getName() for x in system.listStatus(where)] if system.exists(where) else []

    def _parts(self, before: int | None = None) -> dict[int, str]:
        """The folder that holds each part."""
        found: dict[int, str] = {}
        for n in sorted(int(x[1:]) for x in self._list(self.folder) if x[0] == "b" and x[1:].isdigit()):
            names = self._list(f"{self.folder}/b{n}")
            if "_SUCCESS" in names and (before is None or n < before):
                found |= {int(x.partition("=")[2]): f"{self.folder}/b{n}/{x}" for x in names if x.startswith("bucket=")}
        return found

    def merge(self, batch: DataFrame, n: int) -> None:
        batch = written(batch)
        rows = batch.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(BUCKETS)).cast("int"))
        touched = {r[0] for r in rows.select("bucket").distinct().collect()}
        old = [path for k, path in self._parts(n).items() if k in touched]
        now = batch.unionByName(self.spark.read.schema(batch.schema).parquet(*old)) if old else batch
        kept = self.best(now).withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(BUCKETS)).cast("int"))
        kept.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/b{n}")
        forget(batch)

    def table(self, schema: str) -> DataFrame:
        """The table as it is now; without any batch it is empty."""
        parts = list(self._parts().values())
        return self.spark.read.schema(schema).parquet(*parts) if parts else self.spark.createDataFrame([], schema)


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{n}` {k}" for n, k in df.dtypes)


def first_captures(spark: SparkSession, path: str, keys: list[str], out: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Each key once, however often it is captured; a later run over the same folders adds only new ones [STR-01].

    What was seen is a merged table, so the stream itself holds no state.
    """
    o, c = _places(spark)
    out, checkpoint = out or o, checkpoint or c
    stream = source(spark, path).select(*keys)
    seen = Merged(spark, out, keys, lambda rows: rows.distinct())
    drained(stream, out, checkpoint, "append", seen.merge)
    return seen.table(_schema(stream))


def upserting(spark: SparkSession, path: str, id: str, order: str, columns: list[str], out: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """The last row of each key as batches arrive: each batch merges with the parts of the table that it touches [STR-02]."""
    o, c = _places(spark)
    out, checkpoint = out or o, checkpoint or c
    stream = source(spark, path).select(id, order, *columns)
    last = F.max(F.struct(order, *columns)).alias("x")
    merged = Merged(spark, out, [id], lambda rows: rows.groupBy(id).agg(last).select(id, f"x.{order}", *[f"x.{k}" for k in columns]))
    drained(stream, out, checkpoint, "append", merged.merge)
    return merged.table(_schema(stream))


def _updated(stream: DataFrame, keys: list[str], out: str, checkpoint: str) -> DataFrame:
    """The last state of each key of an aggregating stream, which sends only what a batch changes."""
    spark = stream.sparkSession
    rest = [c for c in stream.columns if c not in keys]
    newest = F.max(F.struct("_batch", *rest)).alias("x")
    merged = Merged(spark, out, keys, lambda rows: rows.groupBy(*keys).agg(newest).select(*keys, "x._batch", *[f"x.{c}" for c in rest]))
    drained(stream, out, checkpoint, "update", lambda batch, n: merged.merge(batch.withColumn("_batch", F.lit(n).cast("long")), n))
    return merged.table(_schema(stream) + ", _batch bigint").drop("_batch")


def windowed_counts(spark: SparkSession, path: str, when: str, by: str, width: str = "1 day", late: str = "2 days", out: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """(start, by, n): events of each window and kind; rows without a time are in no window.

    Only the windows that a batch changes are written, and the watermark
    lets go of those it has passed; rows later than that are dropped.
    """
    o, c = _places(spark)
    counts = source(spark, path).where(F.col(when).isNotNull()).withColumn(when, F.col(when).cast("timestamp")).withWatermark(when, late).groupBy(F.window(when, width).alias("w"), by).agg(F.count(F.lit(1)).alias("n"))
    return _updated(counts.select(F.col("w.start").alias("start"), by, "n"), ["start", by], out or o, checkpoint or c)


def stale_captures(spark: SparkSession, path: str, current: DataFrame, id: str, digest: str) -> DataFrame:
    """Stream rows whose digest isn't the current one of their key; a stream-static join [STR-03]."""
    out, checkpoint = _places(spark)
    now = current.select(F.col(id).alias("_id"), F.col(digest).alias("_now"))
    s = source(spark, path).select(id, digest)
    joined = s.join(now, s[id] == now["_id"]).where(~F.col(digest).eqNullSafe(F.col("_now"))).select(id, digest)
    drained(joined, out, checkpoint)
    return spark.read.parquet(out)


def capped(spark: SparkSession, path: str, keys: str, most: int, order: str, out: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """(key, n, exhausted): passes of each key as batches arrive, held to a budget; only keys that a batch touches are written [STR-06]."""
    o, c = _places(spark)
    flat = source(spark, path).where(F.col(keys).isNotNull()).groupBy(key(keys).alias("key")).agg(F.count(F.lit(1)).alias("seen"))
    done = flat.select("key", F.least("seen", F.lit(most)).alias("n"), (F.col("seen") > most).alias("exhausted"))
    return _updated(done, ["key"], out or o, checkpoint or c)

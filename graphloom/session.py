"""Session settings, input tables and tables written to the shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def session(master: str = "local[8]", name: str = "graphloom", **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for; ``conf`` overrides, with ``__`` for dots."""
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.cteRecursionRowLimit": "50000000",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    base |= {k.replace("__", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.master(master).appName(name)
    for key, value in base.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor sees: the session's spark.checkpoint.dir; a local one only where that is unset and the master is local."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="graphloom-")
    atexit.register(shutil.rmtree, own, True)
    sc.setCheckpointDir(own)
    return own


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back.

    Rows are counted on the way (see ``rows_in``). The copy survives the loss of any executor and is removed when the
    driver ends, or earlier by ``forget``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/graphloom-{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._graphloom_path, out._graphloom_rows = path, seen.get["n"]
    return out


def rows_in(df: DataFrame) -> int:
    """Number of rows: known for a written table, else counted."""
    known = getattr(df, "_graphloom_rows", None)
    return df.count() if known is None else known


def still_there(df: DataFrame) -> bool:
    """Whether a table that ``written`` made is still in the shared folder."""
    sc = df.sparkSession.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(df._graphloom_path)
    return where.getFileSystem(sc._jsc.hadoopConfiguration()).exists(where)


def forget(df: DataFrame | None) -> None:
    """Remove a table that ``written`` made, once nothing reads it any more."""
    path = getattr(df, "_graphloom_path", None)
    if path:
        _remove(df.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        sc = spark.sparkContext
        if sc._jsc is None:
            return
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may have ended already
        pass


def task_count(rows: int, each: int, least: int = 1) -> int:
    """Tasks so that none holds more than ``each`` rows."""
    return max(least, -(-rows // each))

"""Mixing sources to target weights."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import written

TOKENIZER = "byte_bpe_50k.tiktoken"
#: Documents of one source that one task orders at once, about.
BUCKET_DOCS = 50_000
#: Targets that are read at most; more are refused, not dropped.
TARGET_BOUND = 100_000


@cache
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counter(path: str | None = None):
    """A function over batches (…, text last) that puts the number of tokens in the text's place.

    ``path`` is a file of byte-pair ranks; by default the installed one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        enc = _encoding(path or public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)
        for batch in batches:
            n = [len(enc.encode_ordinary(t)) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())], names=[*batch.schema.names[:-1], "n_token"])

    return run


def source_name(c: str) -> Column:
    """A source's name as targets write it: trimmed, lower case; null when blank."""
    name = F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))
    return F.when(name != "", name)


@dataclass
class Plan:
    """What each source is to give: wanted share, tokens at hand, tilt of its schedule; and the size of the whole mix."""

    total: float
    share: dict[str, float]
    have: dict[str, int]
    repeat: dict[str, int]
    tilt: dict[str, float] = field(default_factory=dict)


def plan_mix(have: dict[str, tuple[int, int]], targets: list[tuple[str, float, int]], tilts: dict[str, float] | None = None, total: int | None = None) -> Plan:
    """Shares scaled to one over the sources at hand, and the greatest mix in which no source exceeds its repeats.

    ``have`` maps a source to (tokens, documents). ``tilts`` in [-1, 1]
    say how a source's weight changes from the start (1 - tilt of its mean)
    to the end (1 + tilt) of training; they are shifted so that weights
    always add up to one, and kept within the bounds by one factor. By
    default sources whose documents are longer gain weight, by rank.
    """
    wanted: dict[str, float] = {}
    repeat: dict[str, int] = {}
    for source, weight, most in targets:
        if source is not None and weight is not None and weight > 0 and (most or 0) > 0 and have.get(source, (0, 0))[0] > 0:
            wanted[source] = wanted.get(source, 0.0) + weight
            repeat[source] = max(repeat.get(source, 0), int(most))
    mass = sum(wanted.values())
    share = {s: w / mass for s, w in sorted(wanted.items())}
    if not share:
        return Plan(0.0, {}, {}, {})
    limit = min(have[s][0] * repeat[s] / share[s] for s in share)
    if tilts is None:
        by_length = sorted(share, key=lambda s: (have[s][0] / max(1, have[s][1]), s))
        tilts = {s: (2 * i / (len(by_length) - 1) - 1) / 2 if len(by_length) > 1 else 0.0 for i, s in enumerate(by_length)}
    mean = sum(share[s] * tilts.get(s, 0.0) for s in share)
    moved = {s: tilts.get(s, 0.0) - mean for s in share}
    most = max([1.0, *(abs(t) for t in moved.values())])
    return Plan(min(limit, total) if total else limit, share, {s: have[s][0] for s in share}, repeat, {s: t / most for s, t in moved.items()})


def _position(demand: Column, share: Column, tilt: Column, total: float) -> Column:
    """When a source's cumulative demand is reached: the inverse of the integral of its weight.

    With weight share (1 - tilt + 2 tilt t), demand by time t is
    total share ((1 - tilt) t + tilt t^2).
    """
    y = F.least(demand / (F.lit(total) * share), F.lit(1.0))
    b = 1 - tilt
    root = 2 * y / (b + F.sqrt(F.greatest(b * b + 4 * tilt * y, F.lit(0.0))))
    return F.when(y <= 0, F.lit(0.0)).otherwise(F.least(root, F.lit(1.0)))


def sized(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, source, n_token) of every document with tokens and a source, written to the shared folder."""
    rows = documents.select("doc_id", source_name("source").alias("source"), "text").where("source is not null and text is not null and text <> ''")
    return written(rows.mapInArrow(token_counter(path), "doc_id bigint, source string, n_token bigint").where("n_token > 0"))


def mix(documents: DataFrame, targets: DataFrame, tilts: dict[str, float] | None = None, total: int | None = None, path: str | None = None) -> DataFrame:
    """(position, doc_id, source, copy, n_token, at), one row for each time a document is trained on.

    Each source's documents are put in a fixed random order, anew for each
    copy; a document's place in its source's cumulative tokens is the
    demand at which it is due, and the inverse of the integrated weight
    schedule gives the time ``at`` in [0, 1] to train on it. Documents are
    range-sorted by that time; ``position`` numbers them from 0 without
    gaps. A source gives documents while their start lies before its share
    of the mix, so it misses that by less than one document.

    Sources of documents and targets are compared trimmed and in lower case; documents without
    source, text or tokens, and targets without documents, weight or
    repeats take no part. Nothing in common gives an empty mix. Running
    sums are taken over buckets of each source, so no task holds a source.
    """
    docs = sized(documents, path)
    facts = docs.groupBy("source").agg(F.sum("n_token").alias("n"), F.count(F.lit(1)).alias("d"))
    wanted = targets.select(source_name("source").alias("source"), "weight", "max_repeat").limit(TARGET_BOUND + 1).collect()
    if len(wanted) > TARGET_BOUND:
        raise ValueError(f"more than {TARGET_BOUND} targets")
    names = sorted({r[0] for r in wanted if r[0] is not None})
    listed = F.broadcast(documents.sparkSession.createDataFrame([(n,) for n in names], "source string"))
    have = {r["source"]: (r["n"], r["d"]) for r in facts.join(listed, "source", "left_semi").collect()}
    plan = plan_mix(have, [tuple(r) for r in wanted], tilts, total)
    spark = documents.sparkSession
    if not plan.share:
        return spark.createDataFrame([], "position bigint, doc_id bigint, source string, copy int, n_token bigint, at double")
    buckets = 1 + max(have[s][1] for s in plan.share) // BUCKET_DOCS
    wide = F.broadcast(
        spark.createDataFrame(
            [(s, plan.share[s], plan.tilt[s], plan.have[s], int(min(plan.repeat[s], -(-plan.total * plan.share[s] // plan.have[s])))) for s in plan.share],
            "source string, share double, tilt double, have bigint, copies int",
        )
    )
    each = docs.join(wide, "source").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    each = each.withColumn("h", F.xxhash64("doc_id", "copy")).withColumn("bucket", F.pmod(F.shiftright("h", 20), F.lit(buckets)))
    sums = each.groupBy("source", "copy", "bucket").agg(F.sum("n_token").alias("n"))
    before = Window.partitionBy("source").orderBy("copy", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    offset = sums.select("source", "copy", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "copy", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    run = each.withColumn("within", F.coalesce(F.sum("n_token").over(inside), F.lit(0))).join(offset, ["source", "copy", "bucket"])
    start = F.col("base") + F.col("within")
    due = run.withColumn("start", start).where(F.col("start") < F.lit(plan.total) * F.col("share") - 0.5)
    timed = written(due.select("doc_id", "source", "copy", "n_token", _position(F.col("start") + F.col("n_token") / 2, F.col("share"), F.col("tilt"), plan.total).alias("at")))
    ordered = written(timed.repartitionByRange("at", "source", "copy", "doc_id").sortWithinPartitions("at", "source", "copy", "doc_id").withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()))
    parts = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first"))
    shift = parts.select("part", "first", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return ordered.join(F.broadcast(shift), "part").select((F.col("base") + F.col("row") - F.col("first")).alias("position"), "doc_id", "source", "copy", "n_token", "at")


def shares(mixed: DataFrame, targets: DataFrame, quarters: int = 4) -> DataFrame:
    """(source, wanted, reached, n_token, n_row, max_copy, phase) for every target, over each quarter of training and, with phase null, the whole.

    ``wanted`` is scaled to one over all targets; a source that gave nothing has zeros.
    """
    scaled = targets.withColumn("source", source_name("source")).where("source is not null and weight > 0").groupBy("source").agg(F.sum("weight").alias("w"))
    scaled = scaled.select("source", (F.col("w") / F.sum("w").over(Window.partitionBy(F.lit(0)))).alias("wanted"))
    phase = F.least(F.floor(F.col("at") * quarters), F.lit(quarters - 1)).cast("int")
    cells = mixed.groupBy("source", phase.alias("phase")).agg(F.sum("n_token").alias("n_token"), F.count(F.lit(1)).alias("n_row"), F.max("copy").alias("max_copy"))
    per = written(cells)
    whole = per.groupBy("source").agg(F.sum("n_token").alias("n_token"), F.sum("n_row").alias("n_row"), F.max("max_copy").alias("max_copy")).withColumn("phase", F.lit(None).cast("int"))
    every = per.unionByName(whole)
    size = every.groupBy("phase").agg(F.sum("n_token").alias("all"))
    slots = scaled.withColumn("phase", F.explode(F.array(*[F.lit(i) for i in range(quarters)], F.lit(None).cast("int"))))
    e = every.withColumnsRenamed({"source": "s", "phase": "p"})
    z = size.withColumnRenamed("phase", "q")
    out = slots.join(e, (F.col("source") == F.col("s")) & F.col("phase").eqNullSafe(F.col("p")), "left").join(F.broadcast(z), F.col("phase").eqNullSafe(F.col("q")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select("source", "wanted", zero(F.col("n_token") / F.col("all")).alias("reached"), zero("n_token").alias("n_token"), zero("n_row").alias("n_row"), zero("max_copy").alias("max_copy"), "phase")

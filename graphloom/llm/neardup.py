"""Near-duplicate records with small edits."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.pairs import EXPAND, across, within
from graphloom.session import forget, written

#: Shared pieces as a fraction of the pieces that either holds.
THRESHOLD = 0.8
#: Chunks that either side leaves out of the index: its lightest, which say least. Twice so many are made beyond what pigeonhole needs.
LIGHT = 1
#: Fewer tokens than this are too few to tell.
LEAST = 24


def _mixed(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit numbers."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def band_of(size: int, threshold: float) -> int:
    """Index of the size band that holds ``size``; sets alike enough lie in one band or in neighbours."""
    band = math.floor(math.log(size) / -math.log(threshold))
    while threshold**-(band + 1) <= size:
        band += 1
    while threshold**-band > size:
        band -= 1
    return band


def chunks_of(band: int, threshold: float) -> int:
    """Chunks for a window, the sets of a band and of the next: half the greatest signature distance, one, and twice LIGHT.

    The smaller of two alike sets lies in the band, so it holds r pieces at
    most and the other r / t; they differ in at most r (1 - t) / t pieces,
    and so do their signatures in bits. Two bits or more can differ in half
    as many chunks at most, so at least 1 + 2 LIGHT chunks agree but for one
    bit, of which each side leaves out LIGHT: one at least is left.
    """
    most = math.floor(threshold ** -(band + 1) + 1e-9)
    return math.floor(most * (1 - threshold) / threshold + 1e-9) // 2 + 1 + 2 * LIGHT


def signatures(flat: np.ndarray, owner: np.ndarray, n: int, chunks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(value, kept, chunk, bit) of the signatures of ``n`` sets; ``flat`` are their pieces and ``owner`` the set of each.

    Each piece sets one bit of one chunk. Chunks are so wide that no two
    pieces of a set meet in a bit, and a chunk's value stands for its bits:
    the exclusive or of a 64-bit word for each, so a bit is cleared by its
    word. ``kept`` is false for the LIGHT chunks with the fewest bits.
    """
    h = _mixed(flat + np.uint64(7919 * chunks))
    chunk, bit = owner * chunks + (h % np.uint64(chunks)).astype(np.int64), _mixed(h)
    value = np.zeros(n * chunks, np.uint64)
    np.bitwise_xor.at(value, chunk, bit)
    filled = np.bincount(chunk, minlength=n * chunks).reshape(n, chunks)
    kept = np.ones((n, chunks), bool)
    np.put_along_axis(kept, np.argsort(filled, axis=1, kind="stable")[:, :LIGHT], False, 1)
    return value, kept.ravel(), chunk, bit


def _keys(threshold: float, index: bool):
    """(key, class, whole): chunk values of both windows a set belongs to; the probing side also with each bit cleared.

    Of the chunks that agree but for one bit, those that are equal meet as
    they are; else the one with the extra bit meets the other with that bit
    cleared.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            lists = batch.column(1)
            flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            size = lists.value_lengths().to_numpy(zero_copy_only=False)
            band = np.array([band_of(int(k), threshold) for k in size], np.int64)
            keys, owner, full = [], [], []
            for b in np.unique(np.concatenate((band, band - 1))):
                here = (band == b) | (band == b + 1)
                n, m = int(here.sum()), chunks_of(int(b), threshold)
                value, kept, chunk, bit = signatures(flat[np.repeat(here, size)], np.repeat(np.arange(n), size[here]), n, m)
                key = lambda x, at: _mixed(_mixed(x) + _mixed((at % m).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(b + 1000)))  # noqa: B023, E731
                whole = np.flatnonzero(kept)
                parts = [(key(value[whole], whole), whole, True)]
                if not index:
                    of = np.flatnonzero(kept[chunk])
                    parts.append((key(value[chunk[of]] ^ bit[of], chunk[of]), chunk[of], False))
                for k, at, flag in parts:
                    keys.append(k)
                    owner.append(ids[here][at // m])
                    full.append(np.full(len(k), flag))
            join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
            yield pa.RecordBatch.from_arrays([pa.array(join(keys, np.uint64).view(np.int64)), pa.array(join(owner, np.int64), pa.int64()), pa.array(join(full, bool))], names=["key", "class", "whole"])

    return run


def piece_numbers(piece: Column | str) -> Column:
    """Distinct non-null pieces as sorted 64-bit numbers; null gives null."""
    piece = F.col(piece) if isinstance(piece, str) else piece
    return F.array_sort(F.array_distinct(F.transform(F.filter(piece, lambda x: x.isNotNull()), lambda x: F.xxhash64(x))))


class Alike:
    """Classes of equal sets and the links between classes.

    ``member``: (class, id) of every record that counts; ``link``: (c1, c2,
    common, n1, n2) with c1 < c2 for each two classes at or above the
    threshold.
    """

    def __init__(self, member: DataFrame, link: DataFrame) -> None:
        self.member, self.link = member, link

    def pairs(self, expand: int = EXPAND) -> DataFrame:
        """(a, b) of records; copies beyond ``expand`` as stars (see ``within`` and ``across``)."""
        copies = within(self.member.select("class", F.lit(0).alias("variant"), "id"), False, expand)
        return copies.unionByName(across(self.link.select("c1", "c2"), self.member, expand))

    def classes(self) -> DataFrame:
        """(id, class, n_copy, n_link) of every record that counts: its class, the class's size, and how many other classes are alike."""
        ends = self.link.select(F.explode(F.array("c1", "c2")).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("n_link"))
        size = self.member.groupBy("class").agg(F.count(F.lit(1)).alias("n_copy"))
        return self.member.join(size.join(ends, "class", "left"), "class").select("id", "class", "n_copy", F.coalesce("n_link", F.lit(0)).alias("n_link"))


def alike(rows: DataFrame, id: str = "body_id", piece: str = "piece", length: str = "length", threshold: float = THRESHOLD, least: int = LEAST) -> Alike:
    """Records whose sets of distinct pieces share at least ``threshold`` of what either holds.

    Records of less than ``least`` tokens, or without pieces, never count;
    a null length is long enough. Null pieces are ignored. Equal sets form
    one class, named by its least id; classes are joined by a multi-index
    Hamming join over signatures, which finds every pair within the
    signature distance that the threshold allows, and each candidate is
    compared exactly. Empty tables give empty results.
    """
    sets = written(
        rows.where(F.col(length).isNull() | (F.col(length) >= least))
        .select(F.col(id).alias("id"), piece_numbers(piece).alias("set"))
        .where(F.size("set") > 0)
        .withColumns({"h1": F.xxhash64("set"), "h2": F.xxhash64(F.lit(17), "set")})
    )
    first = sets.groupBy("h1", "h2").agg(F.min("id").alias("class"))
    member = written(sets.select("h1", "h2", "id").join(first, ["h1", "h2"]).select("class", "id"))
    heads = written(sets.select("id", "set").join(member.where("class = id").select("id"), "id").select(F.col("id").alias("class"), "set"))
    forget(sets)
    kinds = "key bigint, class bigint, whole boolean"
    index = heads.mapInArrow(_keys(threshold, True), kinds).select("key", F.col("class").alias("c1"))
    probe = heads.mapInArrow(_keys(threshold, False), kinds).select("key", F.col("class").alias("c2"), "whole")
    met = index.join(probe, "key").where("c1 < c2 or (c1 > c2 and not whole)")
    candidate = met.select(F.least("c1", "c2").alias("c1"), F.greatest("c1", "c2").alias("c2")).distinct()
    one, two = heads.select(F.col("class").alias("c1"), F.col("set").alias("s1")), heads.select(F.col("class").alias("c2"), F.col("set").alias("s2"))
    counted = candidate.join(one, "c1").join(two, "c2").select("c1", "c2", F.size(F.array_intersect("s1", "s2")).alias("common"), F.size("s1").alias("n1"), F.size("s2").alias("n2"))
    either = F.col("n1") + F.col("n2") - F.col("common")
    return Alike(member, written(counted.where(F.col("common") >= F.lit(threshold) * either - 1e-9)))

"""Evaluation texts leaking into training text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.words import word_numbers
from graphloom.session import written

#: Spaced seeds over a window of 12 words: 1 is hashed, 0 ignored. Any one substitution misses some seed.
MASKS = ("111111110000", "111100001111", "000011111111")
SPAN = 12
#: Up to so many seed hashes of the evaluation side are sent to every task (24 bytes each); of more, a bit filter is sent.
BROADCAST_SEEDS = 2_000_000
#: Bits of that filter at most (128 MB), bits for each seed at best and at least, and bits that a seed sets in its word; what has more seeds than fit is passed in shards.
FILTER_BITS, BITS_EACH, BITS_LEAST, BITS_SET = 1 << 30, 64, 32, 4
_FACTOR = (np.arange(1, SPAN + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_FOUND = "doc_id bigint, case_id bigint, longest int, covered int"


def seed_hashes(words: np.ndarray, masks: tuple[str, ...] = MASKS) -> list[np.ndarray]:
    """For each mask the hash of every window of SPAN words, by start."""
    n = len(words) - SPAN + 1
    if n <= 0:
        return [np.zeros(0, np.uint64) for _ in masks]
    out = []
    for k, mask in enumerate(masks):
        total = np.full(n, k + 1, np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        for j, bit in enumerate(mask):
            if bit == "1":
                w = words[j : j + n] * _FACTOR[j]
                total += w ^ (w >> np.uint64(31))
        out.append(total)
    return out


def overlap(doc: np.ndarray, case: np.ndarray, shift: int) -> tuple[int, int]:
    """(longest run of equal words, equal words in windows with at most one substitution) on one diagonal.

    ``shift`` is the place in the document minus the place in the case.
    """
    a, b = max(0, shift), min(len(doc), len(case) + shift)
    if b - a < SPAN:
        return 0, 0
    same = doc[a:b] == case[a - shift : b - shift]
    edge = np.flatnonzero(np.diff(np.concatenate(([0], same.view(np.int8), [0]))))
    longest = int((edge[1::2] - edge[::2]).max()) if len(edge) else 0
    total = np.concatenate(([0], np.cumsum(same)))
    good = np.flatnonzero(total[SPAN:] - total[:-SPAN] >= SPAN - 1)
    mark = np.zeros(len(same) + 1, np.int64)
    np.add.at(mark, good, 1)
    np.add.at(mark, good + SPAN, -1)
    return longest, int(((np.cumsum(mark)[:-1] > 0) & same).sum())


@dataclass
class Cases:
    """The evaluation side of one join: seeds sorted by hash, and every case's words."""

    seed: np.ndarray
    place: np.ndarray
    row: np.ndarray
    words: list[np.ndarray]
    ids: np.ndarray

    @classmethod
    def of(cls, ids: list[int], words: list[np.ndarray]) -> Cases:
        seed, place, row = [], [], []
        for r, w in enumerate(words):
            for h in seed_hashes(w):
                seed.append(h)
                place.append(np.arange(len(h), dtype=np.int32))
                row.append(np.full(len(h), r, np.int32))
        none = np.zeros(0, np.int32)
        s = np.concatenate(seed) if seed else np.zeros(0, np.uint64)
        order = np.argsort(s, kind="stable")
        return cls(s[order], (np.concatenate(place) if place else none)[order], (np.concatenate(row) if row else none)[order], words, np.asarray(ids, np.int64))

    def hits(self, words: np.ndarray) -> set[tuple[int, int]]:
        """(case row, shift) of every seed that a text shares with a case."""
        found: set[tuple[int, int]] = set()
        for h in seed_hashes(words):
            low = np.searchsorted(self.seed, h)
            at = np.flatnonzero(self.seed[np.minimum(low, len(self.seed) - 1)] == h) if len(self.seed) else []
            for i in at:
                j = low[i]
                while j < len(self.seed) and self.seed[j] == h[i]:
                    found.add((int(self.row[j]), int(i) - int(self.place[j])))
                    j += 1
        return found


def _best(doc: np.ndarray, case: np.ndarray, shifts: Iterator[int]) -> tuple[int, int]:
    both = [overlap(doc, case, s) for s in shifts]
    return max(a for a, _ in both), max(b for _, b in both)


def _scan(cases):
    """Against a broadcast evaluation side: seeds, hits and their verification in one pass over the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Cases = cases.value
        for batch in batches:
            out: list[tuple] = []
            lists = batch.column(1)
            flat, start = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))))
            maybe = np.zeros(len(flat) + 1, bool)
            for h in seed_hashes(flat):
                low = np.minimum(np.searchsorted(known.seed, h), max(0, len(known.seed) - 1))
                if len(known.seed):
                    maybe[: len(h)] |= known.seed[low] == h
            any_hit = np.concatenate(([0], np.cumsum(maybe)))
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                a, b = int(start[i]), int(start[i + 1])
                if b - a < SPAN or any_hit[b - SPAN + 1] == any_hit[a]:
                    continue
                words = flat[a:b]
                by_case: dict[int, list[int]] = {}
                for row, shift in known.hits(words):
                    by_case.setdefault(row, []).append(shift)
                for row, shifts in by_case.items():
                    longest, covered = _best(words, known.words[row], shifts)
                    if covered:
                        out.append((doc_id, int(known.ids[row]), longest, covered))
            cols = list(zip(*out)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())], names=["doc_id", "case_id", "longest", "covered"])

    return run


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, seed, place = [], [], []
        for i, w in zip(batch.column(0).to_pylist(), batch.column(1)):
            for h in seed_hashes(w.values.to_numpy(zero_copy_only=False).view(np.uint64)):
                ids.append(np.full(len(h), i, np.int64))
                seed.append(h.view(np.int64))
                place.append(np.arange(len(h), dtype=np.int32))
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        yield pa.RecordBatch.from_arrays([pa.array(join(ids, np.int64)), pa.array(join(seed, np.int64)), pa.array(join(place, np.int32))], names=["id", "seed", "place"])


def _filtered(state):
    """(doc_id, words, seeds) of the documents with a seed that the filter lets through, with those seeds and their places."""
    kind = pa.list_(pa.struct([("seed", pa.int64()), ("place", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, shard, shards = state.value
        for batch in batches:
            lists = batch.column(1)
            flat, start = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))))
            seed, at = [], []
            for h in seed_hashes(flat):
                here = np.flatnonzero(_let_through(bits, h) & ((h >> np.uint64(32)) & np.uint64(shards - 1) == np.uint64(shard)))
                seed.append(h[here])
                at.append(here)
            seed, at = np.concatenate(seed), np.concatenate(at)
            doc = np.searchsorted(start, at, side="right") - 1
            inside = at + SPAN <= start[doc + 1]  # a window that runs into the next text is none
            seed, at, doc = seed[inside], at[inside], doc[inside]
            order = np.argsort(doc, kind="stable")
            seed, at, doc = seed[order], at[order], doc[order]
            kept, n = np.unique(doc, return_counts=True)
            pairs = pa.StructArray.from_arrays([pa.array(seed.view(np.int64)), pa.array((at - start[doc]).astype(np.int32))], fields=list(kind.value_type))
            seeds = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pairs, type=kind)
            take = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), lists.take(take), seeds], names=["doc_id", "words", "seeds"])

    return run


def _let_through(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    word = bits[(h & np.uint64(len(bits) - 1)).astype(np.int64)]
    mask = np.zeros(len(h), np.uint64)
    for k in range(BITS_SET):
        mask |= np.uint64(1) << ((h >> np.uint64(40 + 6 * k)) & np.uint64(63))
    return word & mask == mask


def _filter(seeds: DataFrame, n: int) -> np.ndarray:
    """Each seed sets some bits of one word; put together in tasks, so at most FILTER_BITS / 64 words reach the driver."""
    size = 64
    while size < min(FILTER_BITS, n * BITS_EACH):
        size *= 2
    mask = " | ".join(f"shiftleft(1L, cast(shiftrightunsigned(seed, {40 + 6 * k}) & 63 as int))" for k in range(BITS_SET))
    words = seeds.groupBy(F.col("seed").bitwiseAND(F.lit(size // 64 - 1)).alias("word")).agg(F.bit_or(F.expr(mask)).alias("bits")).toArrow()
    out = np.zeros(size // 64, np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc_id, case_id, shifts, doc, case in zip(*(batch.column(i) for i in range(5))):
            longest, covered = _best(doc.values.to_numpy(zero_copy_only=False), case.values.to_numpy(zero_copy_only=False), shifts.as_py())
            if covered:
                out.append((doc_id.as_py(), case_id.as_py(), longest, covered))
        cols = list(zip(*out)) if out else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())], names=["doc_id", "case_id", "longest", "covered"])


def leaks(documents: DataFrame, cases: DataFrame, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """(doc_id, case_id, longest, covered) for each document that shares a passage with a case.

    Words are runs of letters or digits in lower case. Every window of
    twelve words is hashed under each spaced seed, so a window with at most
    one substituted word is hit whatever stands there; around each hit the
    texts are compared word by word. ``longest`` is the longest run of equal
    words, ``covered`` the number of equal words in windows with at most one
    substitution. The evaluation side goes to every task while its
    seeds are few. Else a bit filter of them does, shard by shard, and only
    the documents and seeds that it lets through are shuffled and joined;
    the result is the same. Null, blank or shorter texts share nothing.
    """
    spark = documents.sparkSession
    docs = documents.select("doc_id", word_numbers("text").alias("words")).where(F.size("words") >= SPAN)
    held = cases.select("case_id", word_numbers("text").alias("words")).where(F.size("words") >= SPAN)
    n = (held.agg(F.sum(F.size("words") - SPAN + 1)).first()[0] or 0) * len(MASKS)
    if n <= broadcast_seeds:
        rows = held.orderBy("case_id").collect()
        known = Cases.of([r[0] for r in rows], [np.asarray(r[1], np.int64).view(np.uint64) for r in rows])
        return docs.mapInArrow(_scan(spark.sparkContext.broadcast(known)), _FOUND)
    theirs = written(held.mapInArrow(_seeds, "id bigint, seed bigint, place int").select(F.col("id").alias("case_id"), "seed", F.col("place").alias("at")))
    shards = 1
    while shards * FILTER_BITS < n * BITS_LEAST:
        shards *= 2
    passed = None
    for k in range(shards):
        mine = theirs.where(F.shiftrightunsigned("seed", 32).bitwiseAND(F.lit(shards - 1)) == k)
        state = spark.sparkContext.broadcast((_filter(mine, -(-n // shards)), k, shards))
        part = written(docs.mapInArrow(_filtered(state), "doc_id bigint, words array<bigint>, seeds array<struct<seed: bigint, place: int>>"))
        passed = part if passed is None else passed.unionByName(part)
    hits = passed.select("doc_id", F.inline("seeds")).join(theirs, "seed").groupBy("doc_id", "case_id").agg(F.collect_set(F.col("place") - F.col("at")).alias("shift"))
    texts = passed.select("doc_id", "words") if shards == 1 else passed.select("doc_id", "words").dropDuplicates(["doc_id"])
    both = hits.join(texts, "doc_id").join(held.withColumnRenamed("words", "case_words"), "case_id")
    return both.select("doc_id", "case_id", "shift", "words", "case_words").mapInArrow(_verify, _FOUND)

"""Reading level of each document."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import written

#: Words are numbered by hash below this bound, which is the size of all that is sent to tasks or the driver.
BUCKETS = 1 << 20
LEAST_WORDS = 20
#: Difficulty of each graded level.
LEVEL = {"plain": 0.0, "working": 0.5, "specialist": 1.0}
#: Graded examples that are read at most; any beyond are refused, not dropped.
GRADED_BOUND = 100_000
#: Words may move so far in a settled round. More rounds than ROUNDS are an error, never a result; steps are drawn from the last MEMORY rounds.
ROUNDS, TOLERANCE, MEMORY = 500, 2e-4, 5
_BINS = 4000


def prose(items: DataFrame) -> DataFrame:
    """(guid, words, n_word) of the row that holds of each guid.

    That is the one with the greatest recorded_at; null times are least and
    ties go to the greatest text hash. Missing prose counts as empty.
    """
    text = F.concat_ws(" ", "brief", "description")
    numbers = F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0)), lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))
    tokens = F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w.rlike(r"[\p{L}\p{N}]")))
    rows = items.where("guid is not null").select("guid", "recorded_at", F.array_distinct(numbers).alias("words"), tokens.alias("n_word"))
    last = F.max_by(F.struct("words", "n_word"), F.struct(F.col("recorded_at").isNotNull(), "recorded_at", F.xxhash64("words")))
    return rows.groupBy("guid").agg(last.alias("x")).select("guid", "x.words", "x.n_word")


@dataclass
class Scale:
    """Scores of graded documents, as read off by interpolation, and the breaks between levels."""

    at: list[float]
    level: list[float]
    breaks: tuple[float, float]


def _start(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lists = batch.column(0)
    n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return lists.flatten().to_numpy(zero_copy_only=False), n, np.concatenate(([0], np.cumsum(n)))[:-1]


def _mean(flat: np.ndarray, n: np.ndarray, start: np.ndarray, word: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted mean of word scores over each document; NaN where no word has one."""
    w = weight[flat]
    known = ~np.isnan(word[flat])
    total = np.concatenate(([0.0], np.cumsum(np.where(known, word[flat] * w, 0.0))))
    mass = np.concatenate(([0.0], np.cumsum(np.where(known, w, 0.0))))
    with np.errstate(invalid="ignore", divide="ignore"):
        return (total[start + n] - total[start]) / (mass[start + n] - mass[start])


def _push(state):
    """One half-step from documents to words: sums of document scores by word, after the half-step from words to documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, weight = state.value
        total, count, freq = np.zeros(BUCKETS), np.zeros(BUCKETS), np.zeros(BUCKETS)
        for batch in batches:
            flat, n, start = _start(batch)
            fixed = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            score = fixed if word is None else np.where(np.isnan(fixed), _mean(flat, n, start, word, weight), fixed)
            each = np.repeat(score, n)
            known = ~np.isnan(each)
            total += np.bincount(flat[known], each[known], BUCKETS)
            count += np.bincount(flat[known], minlength=BUCKETS)
            freq += np.bincount(flat, minlength=BUCKETS)
        at = np.flatnonzero(freq)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at]), pa.array(count[at]), pa.array(freq[at])], names=["word", "total", "count", "freq"])

    return run


def _read(state):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, weight = state.value
        for batch in batches:
            flat, n, start = _start(batch)
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), batch.column(3), pa.array(_mean(flat, n, start, word, weight))], names=["fixed", "guid", "n_word", "score"])

    return run


def _next(known: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Where to go on from the last (scores, scores after a round): the combination of them whose rounds move least (Anderson's acceleration)."""
    moved = [y - x for x, y in known]
    if len(known) == 1:
        return known[0][1]
    steps = np.stack([b - a for a, b in zip(moved, moved[1:])])
    share = np.linalg.lstsq(steps @ steps.T, steps @ moved[-1], rcond=1e-12)[0]
    return known[-1][1] - sum(c * (b[1] - a[1]) for c, a, b in zip(share, known, known[1:]))


def propagate(docs: DataFrame, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """(fixed, guid, n_word, score): the words' final scores averaged over each document.

    docs: (words, fixed, guid, n_word), fixed being the clamped difficulty
    of graded documents and null elsewhere. On the document-word graph each
    word is the mean of its documents and each ungraded document the mean
    of its words, rarer words weighing more; rounds go on until no word
    moves by more than the tolerance, and if any still does after ``rounds``
    rounds an error is raised. Once no more words are reached, each round
    starts from a combination of the last ones. Words reach the driver as at
    most BUCKETS partial sums, documents never.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    n_doc = docs.count()
    word = weight = None
    last: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        state = sc.broadcast((word, weight))
        sums = docs.select("words", "fixed").mapInArrow(_push(state), "word int, total double, count double, freq double")
        got = sums.groupBy("word").agg(F.sum("total").alias("total"), F.sum("count").alias("count"), F.sum("freq").alias("freq")).toArrow()
        at = got["word"].to_numpy()
        count, freq = got["count"].to_numpy(), got["freq"].to_numpy()
        new = np.full(BUCKETS, np.nan)
        known = count > 0
        new[at[known]] = got["total"].to_numpy()[known] / count[known]
        weight = np.zeros(BUCKETS)
        weight[at] = np.log1p(n_doc / freq)
        state.destroy()
        reached = ~np.isnan(new)
        if word is None or not np.array_equal(~np.isnan(word), reached):
            word, last, moves = new, [], float("inf")
            continue
        moves = np.max(np.abs(new - word)[reached], initial=0.0)
        if moves <= tolerance:
            word = new
            break
        last = [*last, (word[reached], new[reached])][-MEMORY:]
        word = np.full(BUCKETS, np.nan)
        word[reached] = _next(last)
    else:
        raise RuntimeError(f"after {rounds} rounds words still move by {moves:.2g}, more than {tolerance:g}" if rounds else "no rounds")
    return docs.select("words", "fixed", "guid", "n_word").mapInArrow(_read(sc.broadcast((word, weight))), "fixed double, guid string, n_word int, score double")


def _break(low: np.ndarray, high: np.ndarray, edge: np.ndarray, hist: np.ndarray) -> float:
    """Where one level ends and the next begins: the middle of the widest empty stretch of scores between their examples.

    Without examples on a side, or where examples overlap, the middle of
    the two means.
    """
    if not len(low) or not len(high):
        return float("inf") if not len(high) else -float("inf")
    a, b = low.max(), high.min()
    if a >= b:
        return float(low.mean() + high.mean()) / 2
    filled = edge[np.flatnonzero(hist)]
    step = edge[1] - edge[0]
    stops = np.concatenate(([a], filled[(filled >= a) & (filled + step <= b)], [b]))
    k = int(np.argmax(np.diff(stops)))
    return float(stops[k] + stops[k + 1]) / 2


def reading_levels(items: DataFrame, graded: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """(guid, n_word, difficulty, level) of every item.

    difficulty is continuous, 0 at the mean of plain examples, 0.5 at
    working and 1 at specialist ones; level is the level it falls in. Both
    are null for an item with fewer than ``least`` words of prose, with no
    word that any example reaches, or where no item is graded at all.
    Examples of unknown level, or of items that aren't there, are ignored;
    an item graded twice takes the mean.
    """
    value = F.coalesce(*[F.when(F.lower(F.trim("level")) == k, F.lit(v)) for k, v in LEVEL.items()])
    known = graded.select("guid", value.alias("v")).where("guid is not null and v is not null").groupBy("guid").agg(F.avg("v").alias("fixed"))
    if known.limit(GRADED_BOUND + 1).count() > GRADED_BOUND:
        raise ValueError(f"more than {GRADED_BOUND} graded items")
    docs = prose(items).join(F.broadcast(known), "guid", "left")
    long = F.col("n_word") >= least
    docs = written(docs.select("guid", "n_word", "words", "fixed", long.alias("long")))
    scored = written(propagate(docs.where("long and size(words) > 0")))
    ends = scored.where("not isnan(score)").agg(F.min("score"), F.max("score")).first()
    examples = scored.where("fixed is not null and not isnan(score)").select("fixed", "score").orderBy("fixed", "score").toPandas()
    by = {v: examples.loc[np.isclose(examples["fixed"], v), "score"].to_numpy() for v in LEVEL.values()}
    short = docs.where("not long or size(words) = 0").select("guid", "n_word", F.lit(None).cast("double").alias("difficulty"), F.lit(None).cast("string").alias("level"))
    if ends[0] is None or not len(examples):
        return short.unionByName(scored.select("guid", "n_word", F.lit(None).cast("double").alias("difficulty"), F.lit(None).cast("string").alias("level")))
    width = max((ends[1] - ends[0]) / _BINS, 1e-12)
    bins = scored.where("not isnan(score)").groupBy(F.least(F.floor((F.col("score") - ends[0]) / width), F.lit(_BINS - 1)).cast("int").alias("b")).count().collect()
    hist = np.zeros(_BINS)
    for b, n in bins:
        hist[b] = n
    edge = ends[0] + width * np.arange(_BINS)
    first, second = _break(by[0.0], by[0.5], edge, hist), _break(by[0.5], by[1.0], edge, hist)
    means = [(float(s.mean()), v) for v, s in by.items() if len(s)]
    x = F.col("score")
    if len(means) == 1:
        difficulty = F.lit(means[0][1])
    else:
        lines = []
        for (a, u), (b, v) in zip(means, means[1:]):
            lines.append((b, F.lit(u) + (x - a) * ((v - u) / (b - a if b != a else 1e-12))))
        difficulty = lines[-1][1]
        for b, line in reversed(lines[:-1]):
            difficulty = F.when(x <= b, line).otherwise(difficulty)
    level = F.when(x > second, "specialist").when(x > first, "working").otherwise("plain")
    there = ~F.isnan("score")
    full = scored.select("guid", "n_word", F.when(there, difficulty).alias("difficulty"), F.when(there, level).alias("level"))
    return short.unionByName(full)

"""Per-document text quality statistics."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABELS = ("prose", "list", "table", "junk")
#: Labelled documents that the model is fitted on at most: those with the least hash of their id.
LABELLED_BOUND = 2000
#: Probability that the next line has the same label, before any are counted.
STAY = 0.9

# Common function words of English, German and French.
COMMON = (
    "the a an of is are was were be been it its that this these those one each every another and or nor not but if then when what which who where how "
    "to in on for from by with without at as so no do does can could should would will may we you i they he she our your their his her there than "
    "into under over after before until only also just very more most any all both neither either "
    "der die das den dem des ein eine einer eines und oder nicht ist sind war es zu im in von mit auf für dass wenn so nur auch als wie bei aus noch nach "
    "le la les un une du des de et ou ne pas est sont il elle que qui dans sur pour par avec ce cette quand si en au aux plus"
).split()
_COMMON = frozenset(COMMON)

# What lines of each label look like, in words of no text; they stand in for layouts that no labelled document shows.
PROTOTYPES = {
    "prose": (
        "She said that the river was too high to cross before the end of the week.",
        "and the men who had come with him went back to the house as soon as they could",
        "If it rains, we stay at home; if it does not, we walk to the old bridge and back.",
        "> The answer that he gave was not the one that they had hoped for.",
        "Der Mann ist nicht zu Hause, weil er auf die Kinder wartet und das Wetter gut ist.",
        "La maison est grande, mais elle n'est pas dans la ville et il ne faut pas y aller.",
        "# A short walk by the sea",
        "reason:  |",
    ),
    "list": (
        "- red apple", "* green pear", "+ small plum", "• yellow melon", "    - ripe fig of spring", "1. Red apple", "12) Green pear", "3. Small plum;", "[ ] buy bread", "[x] wash blue cup",
        "1.1 Apple trees ........ 12", "Contents", "Yellow melon", "Fig of spring", "Plum", "Sweet cherry harvest",
        "apple, red pear, small plum, fig of spring, melon, sweet cherry, quince, wild grape",
        "red_apple; green_pear_of_autumn; small_plum; sweet_cherry; quince_jam", "apple: fruit", "apple; pear; plum; cherry; quince; grape",
    ),
    "table": (
        "| apple | pear | plum |", "| --- | --- | --- |", "| 12.50 | 2024-01-03 | yes |", "| 7 |  | n/a |", "+------+------+------+", "|  apple  |  12.4  |  no   |",
        "apple,pear,plum,cherry", "12.50,red,2024-01-03,7", "7,n/a,2024-02-09,", '"apple";"pear";"plum"', '"12.5";"";"no"', "apple\tpear\tplum", "12\t2024-01-03\t7.5", "\t4.5\tred",
        "apple           pear            plum", "12.50           red             2024-01-03", "name;amount;day", "red;12;2024-01-03",
    ),
    "junk": (
        "kQ9x/TzR3+vbNw0aLmE7yPq2HsJd5cUi8oXfGg41", "]{_<+#~ ^%$ @|\\/ *=}{ >>&& [~_", '<div class="a-1"></div><td class="b-2">&nbsp;</td>', "0x3fa91c20: 4f1a 99c0 7e2b 0d11  ..x@.~.x", "........ ??? !!! xX $$$ lol >> 1111 :::",
        "xqzvkj wrtpl bnmgh qwxz fjkdls zzpqr vbtrk hhgwq", "Ã¤ â€™ Ã¼ ï»¿ Ð° � Ã©", "spam spam spam spam spam spam spam spam", "buy! buy! buy! buy! buy! buy! buy!", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa", "click here click here click here click here",
        "\n".join(["spam offer"] * 9), "\n".join(["spam!"] * 9), "\n".join(["spam"] * 9), "\n".join(["of the spam and the offer"] * 6), "\n".join(["of"] * 9), "the the the the the the the the the the the the",
    ),
}

_BULLET = re.compile(r"\s*(?:[-*+•·‣◦]|\d+[.)]|\d+(?:\.\d+)+|\[[ xX]\]|[a-z][.)])\s")
_WORD = re.compile(r"[^\W\d_]+")
_NUMBER = re.compile(r"[\"'|]*[\d][\d.,:/%-]*[\"'|;]*$")
_MIX = re.compile(r"[a-z][A-Z]|[A-Za-z]\d|\d[A-Za-z]")
_HEX = re.compile(r"(?:0x)?[0-9a-f]{4,}:?$")
_GAP = re.compile(r"\S {2,}(?=\S)")
_TAG = re.compile(r"</?\w+[^>]*>|&\w+;")
_MOJIBAKE = re.compile("[ÃÂâ€�Ð][\u0080-ÿ€™œ“”°]?|ï»¿")
_END = re.compile(r"[.!?][\"')\]]*$")
_FIELD = re.compile(r"\S+:\s+[|>]$")
_LEADER = re.compile(r"\.{4,}\s*\d+$")
_N = 30


def line_words(line: str) -> int:
    """Pieces between spaces that have a letter or digit; all pieces of a line without any."""
    pieces = line.split()
    return len([p for p in pieces if p[0].isalnum() or any(map(str.isalnum, p))]) or len(pieces)


def _shape(line: str) -> tuple[int, int, int, int, int]:
    return line.count("|"), line.count("\t"), line.count(";"), line.count(","), len(_GAP.findall(line)) if "  " in line else 0


_CODE = np.array([c - 96 if 97 <= c <= 122 else 27 if c == 63 else 0 for c in range(256)])


def letter_codes(words: list[str]) -> np.ndarray:
    """0 between words, 1 to 26 for a to z, 27 for any other letter."""
    return _CODE[np.frombuffer(f" {' '.join(words)} ".encode("ascii", "replace"), np.uint8)]


_DIGITS, _UPPER, _BLANKS = b"0123456789", bytes(range(65, 91)), b" \t\x0b\x0c\r\n"
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 else 32 for c in range(256))
_PLAIN_BYTES = bytes(range(48, 58)) + bytes(range(65, 91)) + bytes(range(97, 123)) + b"_ \t\x0b\x0c\r\n.,;:!?'\"()-"


def line_features(lines: list[str], letter: np.ndarray) -> np.ndarray:
    """One row of statistics for each line, given its neighbours; ``letter`` scores letter pairs."""
    shapes = [_shape(x) for x in lines]
    stripped = [x.strip() for x in lines]
    again = Counter(stripped)
    out, lows = [], []
    for i, bare in enumerate(stripped):
        raw = bare.encode("ascii", "replace")
        digit = len(raw) - len(raw.translate(None, _DIGITS))
        upper = len(raw) - len(raw.translate(None, _UPPER))
        solid = max(1, len(raw.translate(None, _BLANKS)))
        pieces = bare.split()
        n = max(1, len(pieces))
        low = raw.translate(_LETTERS).decode().split() if bare.isascii() else _WORD.findall(bare.lower())
        letters = sum(map(len, low))
        nw = max(1, len(low))
        pipe, tab, semi, comma, gap = shapes[i]
        ends = _END.search(bare) is not None
        repeat = min(1, (again[bare] - 1) / 4) if letters or digit else 0
        common = len([w for w in low if w in _COMMON]) / nw * (1 - repeat)  # a line said over and over has no common words of its own
        mixed = len([p for p in pieces if _MIX.search(p)]) / n if (digit or upper > 1) and _MIX.search(bare) else 0
        near = 0
        for j in (i - 1, i + 1):
            if 0 <= j < len(lines) and any(x == y and x > 0 for x, y in zip(shapes[i], shapes[j])):
                near += 1
        chunks = len([c for c in re.split(r"[;,]", bare) if c and not c.isspace()]) if semi or comma else 1
        lows.append(" ".join(low))
        out.append((
            letters / solid,
            digit / solid,
            len(raw.translate(None, _PLAIN_BYTES)) / max(1, len(raw)),
            common,
            _BULLET.match(lines[i]) is not None,
            ends,
            min(n, 24) / 24,
            min(1, pipe / n),
            min(1, tab / n),
            min(1, gap / n) if gap and not _FIELD.match(bare) else 0,
            min(1, comma / n),
            min(1, semi / n),
            min(1, bare.count('"') / (2 * n)),
            min(1, 2 * len(_TAG.findall(bare)) / n) if "<" in bare or "&" in bare else 0,
            min(max(map(len, pieces), default=0), 60) / 60,
            mixed,
            0,
            upper / solid,
            0 if bare.isascii() else min(1, 2 * len(_MOJIBAKE.findall(bare)) / n),
            1 - len(set(zip(low, low[1:], low[2:]))) / (len(low) - 2) if len(low) > 4 else 0,
            repeat,
            len([p for p in pieces if _NUMBER.match(p)]) / n if digit else 0,
            near / 2,
            ".." in bare and _LEADER.search(bare) is not None,
            max(0.0, 1 - (len(low) / chunks) / 6) if chunks > 2 else 0,
            min(letters / nw, 16) / 16,
            bare[:1].islower(),
            len([p for p in pieces if "_" in p]) / n if "_" in bare else 0,
            len([p for p in pieces if _HEX.match(p)]) / n if digit else 0,
            n <= 6 and common <= 0.34 and not ends,
        ))
    table = np.array(out, float).reshape(len(lines), _N)
    # mean letter-pair score of each line, all lines at once; a line end is a gap between words
    codes = _CODE[np.frombuffer(("\n".join(f" {x} " if x else "" for x in lows) + "\n").encode("ascii", "replace"), np.uint8)]
    size = np.array([len(x) + 2 if x else 0 for x in lows])
    score = np.concatenate(([0.0], np.cumsum(letter[codes[:-1], codes[1:]])))
    first = np.concatenate(([0], np.cumsum(size + 1)))[:-1]
    there = size > 1
    table[there, 16] = (score[first[there] + size[there] - 1] - score[first[there]]) / (size[there] - 1)
    return table


@dataclass
class Model:
    """A hidden Markov model over lines: label scores from line statistics, and label steps."""

    letter: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    step: np.ndarray
    start: np.ndarray

    def emission(self, features: np.ndarray) -> np.ndarray:
        """log P(label | line) under equal priors, which is the line's likelihood up to a constant."""
        x = (features - self.mean) / self.scale
        z = np.column_stack([x, np.ones(len(x))]) @ self.weight
        z -= z.max(1, keepdims=True)
        return np.maximum(z - np.log(np.exp(z).sum(1, keepdims=True)), np.log(1e-4))

    def posterior(self, emission: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Forward-backward over many documents at once; rows of ``emission`` are their lines in order."""
        first = np.concatenate(([0], np.cumsum(count)))[:-1]
        e = np.exp(emission)
        forward, backward = np.zeros_like(e), np.ones_like(e)
        order = np.argsort(-count, kind="stable")
        live = order[count[order] > 0]
        t, prior = 0, None
        while len(live):
            at = first[live] + t
            a = (self.start if t == 0 else forward[at - 1] @ self.step) * e[at]
            forward[at] = a / a.sum(1, keepdims=True)
            t += 1
            live = live[count[live] > t]
        for t in range(t - 2, -1, -1):
            live = order[: np.searchsorted(-count[order], -(t + 1), side="left")]
            at = first[live] + t
            b = (backward[at + 1] * e[at + 1]) @ self.step.T
            backward[at] = b / b.sum(1, keepdims=True)
        p = forward * backward
        return p / p.sum(1, keepdims=True)


def document_lines(text: str) -> list[str]:
    """Lines that aren't blank."""
    return [x for x in re.split(r"\r\n|\r|\n", text) if x.strip()]


def _softmax_fit(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 2e-3, rounds: int = 1500) -> np.ndarray:
    """Weights of a regularised softmax regression, by gradient steps with momentum."""
    x = np.column_stack([x, np.ones(len(x))])
    target = np.eye(len(LABELS))[y]
    b, v = np.zeros((x.shape[1], len(LABELS))), 0.0
    w = w / w.sum()
    for _ in range(rounds):
        z = x @ b
        z = np.exp(z - z.max(1, keepdims=True))
        grad = x.T @ ((z / z.sum(1, keepdims=True) - target) * w[:, None]) + ridge * np.vstack([b[:-1], np.zeros((1, len(LABELS)))])
        v = 0.9 * v - 0.3 * grad
        b = b + v
    return b


def fit(labelled: list[tuple[str, str]]) -> Model:
    """Fit on (text, label) of documents: every line starts with its document's label.

    Lines are then labelled again by the model, those whose label changes
    within a document that keeps its own for most words, and the model is
    fitted anew; label steps are counted over the last labels.
    """
    docs = [(document_lines(t), LABELS.index(k)) for t, k in labelled if t and k in LABELS]
    docs = [d for d in docs if d[0]]
    protos = [(list(PROTOTYPES[k]), LABELS.index(k)) for k in LABELS]
    pairs = np.ones((28, 28)) * 0.5
    for lines, k in [*docs, *protos]:
        if k != LABELS.index("junk"):
            for w in set(_WORD.findall(" ".join(lines))):
                codes = letter_codes([w.lower()])
                np.add.at(pairs, (codes[:-1], codes[1:]), 1)
    for w in COMMON:
        codes = letter_codes([w])
        np.add.at(pairs, (codes[:-1], codes[1:]), 1)
    letter = np.log2(pairs / pairs.sum(1, keepdims=True))
    # each prototype is a document of its own
    docs = docs + [(document_lines(x), k) for lines, k in protos for x in lines]
    feats = [line_features(lines, letter) for lines, _ in docs]
    count = np.array([len(f) for f in feats])
    size = [np.array([line_words(x) for x in lines]) for lines, _ in docs]
    x = np.concatenate(feats)
    own = np.repeat([k for _, k in docs], count)
    mean, scale = x.mean(0), x.std(0) + 0.05
    per_doc = np.array([np.sqrt(c) for c in count])
    y = own.copy()
    model = None
    for _ in range(3):
        w = np.repeat(per_doc / count, count)
        for k in range(len(LABELS)):
            if (y == k).any():
                w[y == k] /= w[y == k].sum()
        weight = _softmax_fit((x - mean) / scale, y, w)
        same = sum((a == b).sum() for a, b in ((p[:-1], p[1:]) for p in np.split(y, np.cumsum(count)[:-1])))
        steps = max(1, sum(c - 1 for c in count))
        stay = (same + STAY * 50) / (steps + 50)
        step = np.full((4, 4), (1 - stay) / 3)
        np.fill_diagonal(step, stay)
        model = Model(letter, mean, scale, weight, step, np.full(4, 0.25))
        p = model.posterior(model.emission(x), count)
        best = p.argmax(1)
        y = own.copy()
        for j, (a, c) in enumerate(zip(np.cumsum(count) - count, count)):
            got = best[a : a + c]
            if size[j][got == own[a]].sum() * 2 > size[j].sum():
                y[a : a + c] = got
    return model


def labelled_sample(documents: DataFrame, labels: DataFrame, bound: int = LABELLED_BOUND) -> list[tuple[str, str]]:
    """(text, label) of at most ``bound`` labelled documents, in a fixed order."""
    known = labels.select("doc_id", F.lower(F.trim("label")).alias("label")).where(F.col("label").isin(*LABELS)).distinct()
    known = known.orderBy(F.xxhash64("doc_id", "label")).limit(bound)
    rows = documents.select("doc_id", "text").where("text is not null").join(F.broadcast(known), "doc_id").orderBy(F.xxhash64("doc_id"), "label", "text").limit(bound).collect()
    return [(r["text"], r["label"]) for r in rows]


_SHARES = "doc_id bigint, n_line int, n_word bigint, prose double, list double, table double, junk double"


def _label(state):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = state.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            lines = [document_lines(t) if t else [] for t in batch.column(1).to_pylist()]
            count = np.array([len(x) for x in lines], np.int64)
            shares = np.full((len(ids), 4), np.nan)
            total = np.zeros(len(ids), np.int64)
            if count.sum():
                feats = np.concatenate([line_features(x, model.letter) for x in lines if x])
                p = model.posterior(model.emission(feats), count)
                n = np.array([line_words(x) for doc in lines for x in doc], float)
                owner = np.repeat(np.arange(len(ids)), count)
                for k in range(4):
                    shares[:, k] = np.bincount(owner, p[:, k] * n, len(ids))
                total = np.bincount(owner, n, len(ids)).astype(np.int64)
                with np.errstate(invalid="ignore", divide="ignore"):
                    shares /= total[:, None]
            cols = [pa.array(np.where(np.isnan(shares[:, k]), 0, shares[:, k]), mask=count == 0) for k in range(4)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(count.astype(np.int32)), pa.array(total), *cols], names=["doc_id", "n_line", "n_word", *LABELS])

    return run


def label_shares(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, n_line, n_word, prose, list, table, junk, kind) of every document.

    Each line that isn't blank has a probability of each label under a
    hidden Markov model fitted on the labelled documents; a document's share
    of a label is the mean over its words, and ``kind`` the label with the
    largest share. Shares and kind are null for null and blank texts.
    """
    state = documents.sparkSession.sparkContext.broadcast(fit(labelled_sample(documents, labels)))
    shares = documents.select("doc_id", "text").mapInArrow(_label(state), _SHARES)
    top = F.greatest(*LABELS)
    return shares.withColumn("kind", F.coalesce(*[F.when(F.col(k) == top, k) for k in LABELS]))


def text_statistics(documents: DataFrame) -> DataFrame:
    """(doc_id, n_char, n_word, mean_word_length, symbol_ratio, digit_ratio, n_line, end_share, bullet_share, common_share, distinct_share) of every document.

    Words are what stands between white space; the common share is of runs
    of letters, in lower case, that are common function words. Ratios are
    of characters, shares of lines that aren't blank or of words. A null or
    blank text has zero counts and null ratios. Everything is built in.
    """
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, r"[ \t\n\r]+"), lambda w: w != "")
    lines = F.filter(F.split(text, r"[\n\r]+"), lambda x: F.trim(F.replace(x, F.lit("\t"), F.lit(" "))) != "")
    letters = F.regexp_extract_all(F.lower(text), F.lit("[a-zäöüßéèêàçù]+"), F.lit(0))
    d = documents.select("doc_id", text.alias("t"), words.alias("w"), lines.alias("l"), letters.alias("a"))
    n_char, n_word, n_line = F.length("t"), F.size("w"), F.size("l")
    left = lambda pattern: F.length(F.regexp_replace("t", pattern, ""))
    share = lambda part, whole: F.round(F.when(whole > 0, part / whole), 6)
    count = lambda test: F.size(F.filter("l", lambda x: x.rlike(test)))
    return d.select(
        "doc_id",
        n_char.cast("long").alias("n_char"),
        n_word.cast("long").alias("n_word"),
        share(F.aggregate("w", F.lit(0), lambda s, w: s + F.length(w)), n_word).alias("mean_word_length"),
        share(left(r"[\p{L}\p{N}\s]"), n_char).alias("symbol_ratio"),
        share(n_char - left("[0-9]"), n_char).alias("digit_ratio"),
        n_line.cast("long").alias("n_line"),
        share(count(r"[.!?][\"')\]]*[ \t]*$"), n_line).alias("end_share"),
        share(count(r"^[ \t]*([-*+•]|[0-9]+[.)])[ \t]"), n_line).alias("bullet_share"),
        share(F.size(F.filter("a", lambda w: w.isin(COMMON))), F.size("a")).alias("common_share"),
        share(F.size(F.array_distinct("w")), n_word).alias("distinct_share"),
    )

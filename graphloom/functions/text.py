"""Scalar functions over text: normal forms, digests, phrases, quantities, sentences."""

from __future__ import annotations

import hashlib
import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words that carry no concept.
STOP = (
    "a about above after again against all also an and another any anything are as at be because been before being below between both but by came can cannot could "
    "did do does doing done down during each either else enough even ever every everything few for from further had has have having her here hers him his how however "
    "if in into is it its itself just least less like made make makes many may me might more most much must my neither never no nor not nothing now of off on once one only "
    "onto or other others ought our out over own per rather said same say says several shall she should since so some something still such than that the their theirs them "
    "then there these they thing things this those though three through thus to too two under until up upon us use used uses using very was way we were what when where whether "
    "which while who whom whose why will with within without would yet you your"
).split()
# How a condition of each kind opens, and the templates of the two sentences.
CONDITION = {"logic": "If", "event": "As soon as", "time": "As long as"}
LIGHT_NOUN_ENDS = ("ation", "ion", "ment", "ing", "al", "ance", "ence")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def squeezed(c: Column | str) -> Column:
    """White space of any kind as single spaces, none outside [FN-01]."""
    return F.trim(F.regexp_replace(_col(c), r"(?U)\s+", " "))


def content_key(c: Column | str) -> Column:
    """'c' and the first 8 hex digits of the digest of the squeezed text [FN-02]."""
    return F.concat(F.lit("c"), F.substring(F.sha2(squeezed(c), 256), 1, 8))


def evidence_key(case: Column | str, requirement: Column | str) -> Column:
    """Key of a case's evidence for a requirement; a missing case counts as empty [FN-07]."""
    return F.concat(F.lit("c"), F.substring(F.sha2(F.concat_ws("|", F.coalesce(_col(case), F.lit("")), _col(requirement)), 256), 1, 8))


def capture_digest(version: Column, uri: Column, author: Column, published: Column, text: Column) -> Column:
    """'sha256:' and the whole digest of the parts, one a line; missing parts are empty [FN-09]."""
    parts = [F.coalesce(x.cast("string"), F.lit("")) for x in (version, uri, author, published, text)]
    return F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("\n", *parts), 256))


@F.pandas_udf(StringType())
def canonical_capture(text: pd.Series) -> pd.Series:
    """Composed characters, one kind of line end, paragraphs kept, other white space single [FN-08]."""

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        lines = unicodedata.normalize("NFC", t).replace("\r\n", "\n").replace("\r", "\n")
        paragraphs = [" ".join(p.split()) for p in lines.split("\n\n")]
        return "\n\n".join(p for p in paragraphs if p)

    return text.map(one)


def _digest_of(text: str | None, separators: tuple[str, str]) -> str | None:
    try:
        return hashlib.sha256(json.dumps(json.loads(text), sort_keys=True, separators=separators).encode()).hexdigest()[:8]
    except (TypeError, ValueError, RecursionError):
        return None


@F.pandas_udf(StringType())
def document_digest(document: pd.Series) -> pd.Series:
    """First 8 hex digits of the digest of a JSON document with its keys in order; null if it doesn't parse [FN-03]."""
    return document.map(lambda t: _digest_of(t, (", ", ": ")))


@F.pandas_udf(StringType())
def compact_digest(document: pd.Series) -> pd.Series:
    """The same over JSON without spaces between its parts."""
    return document.map(lambda t: _digest_of(t, (",", ":")))


def slug(c: Column | str, prefix: str = "") -> Column:
    """Lower case, runs of anything but letters and digits as one underscore, none outside [FN-10]; a type prefix given twice is dropped [FN-11]."""
    out = F.regexp_replace(F.regexp_replace(F.lower(_col(c)), "[^a-z0-9]+", "_"), "^_|_$", "")
    return F.regexp_replace(out, f"^{prefix}_", "") if prefix else out


def capture_title(kind: Column | str, author: Column | str, published: Column | str) -> Column:
    """Default title of a capture: its kind, its author and, if known, the day it was published, as in "Web page by Ann, 3 May 2024" [FN-10, SUP-45]."""
    name = F.replace(F.lower(_col(kind)), F.lit("_"), F.lit(" "))
    name = F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, F.lit(2), F.length(name)))
    day = F.coalesce(F.concat(F.lit(", "), F.date_format(_col(published), "d MMMM yyyy")), F.lit(""))
    return F.concat(name, F.lit(" by "), _col(author), day)


def capture_faults(version: Column, required: dict[str, Column], authors: list[Column]) -> Column:
    """What is wrong with a capture, in this order: missing or empty keys by name, a version other than 1, no author [SRC-16]."""
    empty = lambda c: F.coalesce(c.cast("string"), F.lit("")) == ""
    missing = [F.when(empty(c), F.lit(f"lacks {k}")) for k, c in required.items()]
    nobody = F.lit(True)
    for a in authors:
        nobody = nobody & empty(a)
    return F.array_compact(F.array(*missing, F.when(~F.coalesce(version == 1, F.lit(False)), "version"), F.when(nobody, "author")))


def words(c: Column | str) -> Column:
    """Lower-case words without identifiers, in order [FN-21]."""
    bare = F.regexp_replace(F.lower(_col(c)), r"\b[a-z][a-z0-9]*[_.][a-z0-9_.]+\b", " ")
    return F.regexp_extract_all(bare, F.lit("([a-z]+(?:'[a-z]+)?)"), F.lit(1))


def phrases(c: Column | str, least: int = 3) -> Column:
    """Words of at least ``least`` letters and pairs of neighbouring words, stop words aside [FN-21, WIN-11]."""
    w = words(c)
    single = F.filter(w, lambda x: (F.length(x) >= least) & ~x.isin(STOP))
    pair = F.transform(F.arrays_zip(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))).alias("a"), F.slice(w, 2, F.size(w)).alias("b")), lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b")))
    kept = F.filter(pair, lambda p: p["a"].isNotNull() & p["b"].isNotNull() & ~p["a"].isin(STOP) & ~p["b"].isin(STOP))
    return F.concat(single, F.transform(kept, lambda p: F.concat_ws(" ", p["a"], p["b"])))


def singulars(phrase: Column | str) -> Column:
    """The phrase and its last word's possible singulars [FN-22]."""
    p = _col(phrase)
    rules = (("ies", "y"), ("sses", "ss"), ("es", ""), ("s", ""))
    return F.array_compact(F.array(p, *[F.when(p.endswith(a), F.concat(F.substring(p, F.lit(1), F.length(p) - len(a)), F.lit(b))) for a, b in rules]))


def inner_runs(term: Column | str) -> Column:
    """Every run of words inside a term [FN-22]."""
    w = F.split(_col(term), " ")
    n = F.size(w)
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.array_join(F.slice(w, i, k), " ")))))


def shingles(tokens: Column, n: int = 4) -> Column:
    """The set of runs of n tokens; none where there are fewer [SIM-04, WIN-12]."""
    size = F.size(tokens)
    return F.when(size < n, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(size - n, F.lit(0))), lambda i: F.array_join(F.slice(tokens, i + 1, n), " "))))


def quantity_tokens(c: Column | str) -> Column:
    """Numbers, words and marks, thousands joined and glued forms kept whole [FN-17]."""
    joined = F.regexp_replace(_col(c), r"(?<!\d\.\d{1,18})(?<=\d)[ ,](?=\d{3})", "")
    pattern = r"([±+-]?\d+(?:\.\d+)?/\d+|\d+[A-Za-z][A-Za-z0-9°%/()_-]*|[±+-]?\d+(?:\.\d+)?(?![A-Za-z0-9/])|[A-Za-z°%][A-Za-z0-9°%/()_-]*|[^\sA-Za-z0-9])"
    return F.regexp_extract_all(joined, F.lit(pattern), F.lit(1))


def acronyms(c: Column | str) -> Column:
    """Distinct runs of two to six capitals between which and the text around stands no letter, digit or hyphen of ASCII, sorted [FN-19]."""
    whole = F.regexp_extract_all(_col(c), F.lit("([A-Za-z0-9-]+)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.filter(whole, lambda x: x.rlike("^[A-Z]{2,6}$"))))


def unit_shaped(token: Column) -> Column:
    """Whether a token looks like a unit: short, a letter in it, and a slash, a degree sign or a capital after a small first letter [FN-18]."""
    return (F.length(token) <= 6) & token.rlike("[A-Za-z]") & (token.contains("/") | token.contains("°") | token.rlike("^[a-z].*[A-Z]"))


def noun_forms(verb: Column | str) -> Column:
    """Nouns that a verb is commonly turned into [FN-20]."""
    stem = F.element_at(F.split(_col(verb), " "), -1)
    root = F.regexp_replace(stem, "e$", "")
    ends = [F.concat(stem, F.lit(e)) for e in ("ation", "ment", "al", "ance")] + [F.concat(root, F.lit(e)) for e in LIGHT_NOUN_ENDS]
    return F.array_distinct(F.array(*ends))


def _slot(c: str) -> Column:
    return F.regexp_replace(F.coalesce(squeezed(c), F.lit("")), r"\.+$", "")


def requirement_sentence(
    condition_kind: str = "condition_kind", condition: str = "condition", entity: str = "entity", obligation: str = "obligation", activity: str = "activity",
    actor: str = "actor", process: str = "process", object: str = "object", qualifier: str = "qualifier",
) -> Column:
    """The sentence of a requirement's slots; null where they don't compose [FN-13].

    Entity, obligation, process and object are always needed; an
    interaction names its actor and nothing else does; a condition comes
    with its kind.
    """
    act, who, cond, kind = _slot(activity), _slot(actor), _slot(condition), _slot(condition_kind)
    opening = F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in CONDITION.items()])
    head = F.when(cond != "", F.concat(opening, F.lit(" "), cond, F.lit(", the "), _slot(entity))).otherwise(F.concat(F.lit("The "), _slot(entity)))
    bare = F.concat(_slot(process), F.lit(" "), _slot(object))
    action = F.when(act == "interaction", F.concat(F.lit("provide the "), who, F.lit(" with the ability to "), bare)).when(act == "interface", F.concat(F.lit("be able to "), bare)).otherwise(bare)
    tail = F.when(_slot(qualifier) != "", F.concat(F.lit(" "), _slot(qualifier))).otherwise(F.lit(""))
    whole = F.concat(head, F.lit(" "), _slot(obligation), F.lit(" "), action, tail, F.lit("."))
    there = (_slot(entity) != "") & (_slot(obligation) != "") & (_slot(process) != "") & (_slot(object) != "")
    return F.when(there & ((act == "interaction") == (who != "")) & ((cond != "") == (kind != "")), whole)


def need_sentence(context: str = "context", subject: str = "subject", outcome: str = "outcome", purpose: str = "purpose", entity: str = "entity") -> Column:
    """The sentence of a need's slots; null where one but the entity is missing [FN-14]."""
    source = F.when(_slot(entity) != "", F.concat(F.lit(" from the "), _slot(entity))).otherwise(F.lit(""))
    there = (_slot(context) != "") & (_slot(subject) != "") & (_slot(outcome) != "") & (_slot(purpose) != "")
    return F.when(there, F.concat(F.lit("In "), _slot(context), F.lit(", "), _slot(subject), F.lit(" need "), _slot(outcome), source, F.lit(", in order to "), _slot(purpose), F.lit(".")))


def object_form(c: Column | str) -> Column:
    """Lower-case words of an object without articles [FN-16]."""
    w = F.regexp_extract_all(F.lower(_col(c)), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.array_join(F.filter(w, lambda x: ~x.isin("a", "an", "the")), " ")


def expired(on: Column | str, today: Column | str) -> Column:
    """Whether a date lies strictly before today; unreadable dates don't [FN-26]."""
    return F.coalesce(F.try_to_date(_col(on), "yyyy-MM-dd") < F.to_date(_col(today)), F.lit(False)) if hasattr(F, "try_to_date") else F.coalesce(F.expr(f"try_cast({on} as date)") < F.to_date(_col(today)), F.lit(False))


def first_difference(a: Column, b: Column) -> Column:
    """Number of the first line that differs, from 1; where one text ends first, the line after; null when equal [FN-30]."""
    x, y = F.split(a, "\n"), F.split(b, "\n")
    n = F.least(F.size(x), F.size(y))
    hit = F.array_min(F.filter(F.transform(F.sequence(F.lit(1), n), lambda i: F.when(F.element_at(x, i) != F.element_at(y, i), i)), lambda v: v.isNotNull()))
    return F.coalesce(hit, F.when(F.size(x) != F.size(y), n + 1))


def path_pattern(pattern: str) -> str:
    """A dot-path pattern as a regular expression over ``path_text``: * is one step, ** any number [FLT-01]."""
    import re

    steps = pattern.split(".") if pattern else []
    return "^" + "".join({"*": "[^.]+[.]", "**": "(?:[^.]+[.])*"}.get(s) or re.escape(s) + "[.]" for s in steps) + "$"


def path_matches(path: Column | str, *patterns: str) -> Column:
    """Whether a dot path matches any of the patterns; no pattern matches nothing [FLT-01]."""
    p = _col(path)
    text = F.when(p == "", "").otherwise(F.concat(p, F.lit(".")))
    out = F.lit(False)
    for x in patterns:
        out = out | text.rlike(path_pattern(x))
    return out


def selects(id_: Column | str, guid: Column | str, ids: tuple[str, ...] = (), guids: tuple[str, ...] = ()) -> Column:
    """An identifier selector: id patterns match in full, any of them; guids exactly; both must hold; none given holds [FLT-05]."""
    out = F.lit(True)
    if ids:
        out = out & F.coalesce(_col(id_).rlike("^(?:" + "|".join(f"(?:{p})" for p in ids) + ")$"), F.lit(False))
    if guids:
        out = out & F.coalesce(_col(guid).isin(*guids), F.lit(False))
    return out


def holds_words(text: Column, query: str) -> Column:
    """Whether every word of a query is part of the text, case aside [FLT-07]."""
    return F.forall(F.array(*[F.lit(w) for w in query.lower().split()]).cast("array<string>"), lambda w: F.contains(F.lower(text), w))


def well_formed(id_: Column | str, guid: Column | str) -> Column:
    """What is wrong with the forms of an id and its guid, as an array in this order; empty when nothing is [FN-24].

    Also the prefix pair: an id and its guid start alike.
    """
    i, g = _col(id_), _col(guid)
    return F.array_compact(
        F.array(
            F.when(i.isNotNull() & ~i.rlike(r"^[a-z]{1,8}_[a-z0-9][a-z0-9_]*(\.[a-z0-9][a-z0-9_]*)*$"), "id_form"),
            F.when(g.isNotNull() & ~g.rlike(r"^[a-z]{1,8}_[0-9a-f]{32}$"), "guid_form"),
            F.when(i.isNotNull() & g.isNotNull() & (F.substring_index(i, "_", 1) != F.substring_index(g, "_", 1)), "prefix_pair"),
        )
    )


# Words that point at something said before, and how nouns made from verbs and adjectives end.
POINTERS = ("it", "its", "they", "them", "their", "this", "that", "these", "those", "such", "former", "latter")
NOMINAL_ENDS = ("tion", "sion", "ment", "ance", "ence", "ity", "ness", "ism", "age")
#: A nominal is longer than this.
NOMINAL_LENGTH = 6


def load_metrics(text: Column) -> dict[str, Column]:
    """Words, sentences, words a sentence, nominals per 100 words, pointers a sentence, and grade: what needs no tagger [FN-32].

    Without a tagger every word of the pointer list counts, and every long
    word with a nominal's ending. The grade is 0 up to three words.
    """
    w = F.regexp_extract_all(text, F.lit(r"([A-Za-z]+(?:'[a-z]+)?)"), F.lit(1))
    n = F.greatest(F.size(w), F.lit(1))
    s = F.greatest(F.size(F.filter(F.split(text, r"[.!?]+"), lambda x: x.rlike("[A-Za-z]"))), F.lit(1))
    count = lambda test: F.size(F.filter(w, test))
    syllables = F.aggregate(w, F.lit(0), lambda a, x: a + F.greatest(F.size(F.regexp_extract_all(F.lower(x), F.lit("([aeiouy]+)"), F.lit(1))), F.lit(1)))
    return {
        "words": F.size(w).cast("long"),
        "sentences": s.cast("long"),
        "length": F.round(n / s, 6),
        "nominal": F.round(100.0 * count(lambda x: (F.length(x) > NOMINAL_LENGTH) & F.lower(x).rlike(f"({'|'.join(NOMINAL_ENDS)})s?$")) / n, 6),
        "pointers": F.round(count(lambda x: F.lower(x).isin(*POINTERS)) / s, 6),
        "grade": F.round(F.when(F.size(w) > 3, 0.39 * (n / s) + 11.8 * (syllables / n) - 15.59).otherwise(0.0), 6),
    }


# Words that a cut text must not end in.
DANGLING = ("and", "or", "with", "of", "for", "to", "the", "a", "an", "by", "in", "on", "at", "from", "as", "but", "nor")


def cut(c: Column | str, width: int) -> Column:
    """A text of more than ``width`` characters cut at its last space within them, without small words and marks at its end; a shorter one as it is [FN-12].

    Where nothing would be left, the first ``width`` characters.
    """
    text = _col(c)
    head = F.substring(text, 1, width)
    whole = F.regexp_replace(head, " [^ ]*$", "")
    kept = F.regexp_replace(F.regexp_replace(whole, rf"(?i)(?:(?:^| )(?:{'|'.join(DANGLING)})[,;:]*)+$", ""), "[ ,;:]+$", "")
    return F.when(F.length(text) <= width, text).when(kept == "", head).otherwise(kept)


def id_tail(c: Column | str) -> Column:
    """The last segment of a schema's address without its suffix [FN-25]."""
    return F.regexp_replace(F.element_at(F.split(_col(c), "/"), -1), r"\.yaml$", "")


def test_outcome(phase: Column, outcome: Column, expected_failure: Column, timed_out: Column) -> Column:
    """Outcome of one event of a test session [FN-28].

    A failure outside the call itself, or a timeout, is an error; an
    expected failure passes when it fails; what was skipped is skipped.
    """
    failed = outcome == "failed"
    return (
        F.when(F.coalesce(timed_out, F.lit(False)), "error")
        .when(outcome == "skipped", F.when(F.coalesce(expected_failure, F.lit(False)), "passed").otherwise("skipped"))
        .when(failed & (phase != "call"), "error")
        .when(failed, "failed")
        .otherwise(F.when(F.coalesce(expected_failure, F.lit(False)), "failed").otherwise("passed"))
    )


def verbatim(c: Column | str, head: str) -> Column:
    """A text quoted under a head line, each of its lines indented by two spaces [FN-29]."""
    return F.concat(F.lit(head + "\n"), F.array_join(F.transform(F.split(_col(c), "\n"), lambda x: F.concat(F.lit("  "), x)), "\n"))


def unknown_rules(c: Column | str, known: Column) -> Column:
    """Rules that a text names and the register doesn't have, in order [FN-33]."""
    return F.array_except(F.regexp_extract_all(_col(c), F.lit(r"\b(rule_[a-z0-9_]+)\b"), F.lit(1)), known)


def identifiers_in(c: Column | str, prefixes: list[str]) -> Column:
    """Readable ids in prose, by type prefixes; names of files and dotted paths aren't ids [FN-23]."""
    body = "|".join(sorted(prefixes, key=len, reverse=True))
    return F.array_distinct(F.regexp_extract_all(_col(c), F.lit(rf"(?<![\w./])((?:{body})_[a-z0-9][a-z0-9_]*)(?![\w/]|\.[a-z])"), F.lit(1)))


def mentions(c: Column | str, names: list[str]) -> Column:
    """Which of the names a text mentions as whole words, a longer one before one it contains [PRJ-11]."""
    import re

    body = "|".join(re.escape(n) for n in sorted(names, key=len, reverse=True))
    return F.array_distinct(F.regexp_extract_all(_col(c), F.lit(rf"(?<![\w.])({body})(?![\w]|\.\w)"), F.lit(1)))


# Words of the four before a number that make it a bound, and those of the three after it that do.
BOUND_BEFORE = (
    "least most more less than exceeding exceed within below above under over up to between minimum maximum from or fewer greater beyond "
    "until after before per every each of by not no about plus minus"
).split()
BOUND_AFTER = "or maximum minimum at".split()


def quantity_faults(tokens: Column | str, units: list[str]) -> Column:
    """(token, fault) of quantity tokens: numbers without a unit or counted thing and of point values no bound word precedes [FN-18, WIN-10].

    A number that names something, after capitals or before a hyphen, is no
    quantity; what follows may be a unit of one or two words, or else a word
    that is counted. A token shaped like a unit that is none is a fault too.
    Without tokens the result is null. The tokens should be a column of their own, or they are found anew for
    each of them.
    """
    t = _col(tokens)
    n = F.size(t)
    known = F.array(*[F.lit(u.lower()) for u in units]).cast("array<string>")
    at = lambda i: F.get(t, i)
    low = lambda x: F.lower(F.coalesce(x, F.lit("")))

    def fault(i: Column) -> Column:
        token, before, one = at(i), F.coalesce(at(i - 1), F.lit("")), at(i + 1)
        number = token.rlike(r"^[±+-]?\d+(\.\d+)?$")
        names = ((F.length(before) >= 2) & (before == F.upper(before)) & before.rlike("[A-Z]")) | F.coalesce(one == "-", F.lit(False))
        unit = F.array_contains(known, low(one)) | F.array_contains(known, F.concat_ws(" ", low(one), low(at(i + 2))))
        counted = F.coalesce(one.rlike(r"^[A-Za-z°%]"), F.lit(False))
        near = F.transform(F.slice(t, F.greatest(i - 3, F.lit(1)), F.least(i, F.lit(4))), low)
        after = F.transform(F.slice(t, i + 2, F.lit(3)), low)
        bounded = F.arrays_overlap(near, F.array(*[F.lit(w) for w in BOUND_BEFORE])) | F.arrays_overlap(after, F.array(*[F.lit(w) for w in BOUND_AFTER])) | token.rlike("^[±+-]")
        what = F.when(number & ~names & ~unit & ~counted, "no_unit").when(number & ~names & unit & ~F.coalesce(bounded, F.lit(False)), "no_bound").when(unit_shaped(token) & ~F.array_contains(known, F.lower(token)) & ~number, "unknown_unit")
        return F.struct(token.alias("token"), what.alias("fault"))

    every = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), fault))
    return F.filter(every, lambda x: x["fault"].isNotNull())

"""Statements made of slots: what defines their words, what is wrong with them, and digests of what they rest on."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from graphloom.functions.text import acronyms, compact_digest, document_digest, noun_forms, object_form, quantity_faults, quantity_tokens, squeezed
from graphloom.operators.assurance import ADVISORY, CRITICAL
from graphloom.operators.graph import reach
from graphloom.operators.relational import repeats

# Verbs that leave the process to the noun after them, and words that an object may open with.
LIGHT_VERBS = ("perform", "carry out", "undertake", "conduct", "do", "make", "effect")
OPENING = ("the", "a", "an", "each", "every", "all", "any", "its", "no", "at", "in", "on", "of", "to", "from", "with", "for", "and", "or")
#: Entries of a register of verbs, units or known words that may be sent to every task; more are joined.
REGISTER_BOUND = 100_000


def claimed_severity(status: Column | str) -> Column:
    """Critical once accepted, advisory before."""
    return F.when(F.coalesce((F.col(status) if isinstance(status, str) else status) == "accepted", F.lit(False)), CRITICAL).otherwise(ADVISORY)


def defining(register: DataFrame) -> DataFrame:
    """(term, segments): the sorted segments whose registers define each term; a null segment is '' [SUP-13]. From (term, segment)."""
    return register.where("term is not null").groupBy("term").agg(F.sort_array(F.collect_set(F.coalesce("segment", F.lit("")))).alias("segments"))


def undefined(subjects: DataFrame, register: DataFrame, visible: DataFrame) -> DataFrame:
    """Subjects (guid, segment, term) whose term no register defines that their segment can see [CHK-10, JOIN-17].

    register: (term, segment), visible: (root, node), the segments that a
    segment reaches, itself included. An entry under no segment is seen by
    all, and a subject under no segment sees every entry. Two anti joins on
    equality; a hot term has one row a segment on the register's side.
    """
    entries = register.where("term is not null").select("term", F.col("segment").alias("node")).distinct()
    everywhere = entries.where("node is null").select("term")
    seen = entries.join(visible, "node").select("term", F.col("root").alias("segment")).distinct()
    left = subjects.join(everywhere, "term", "left_anti")
    free = left.where("segment is null").join(entries.select("term").distinct(), "term", "left_anti")
    return left.where("segment is not null").join(seen, ["term", "segment"], "left_anti").select("guid", "segment", "term").unionByName(free.select("guid", "segment", "term"))


def same_obligation(members: DataFrame) -> DataFrame:
    """(set, guid, first_guid): members of a set with the process and object of an earlier one [WIN-05, WIN-09, CHK-10].

    members: (set, ord, guid, process, object); objects compare without
    case, articles and marks. Members of no set are left out.
    """
    rows = members.where("set is not null").withColumns({"process": squeezed(F.coalesce("process", F.lit(""))), "object": object_form(F.coalesce("object", F.lit("")))})
    return repeats(rows, ["set", "process", "object"], "ord", "guid", keep=["guid"]).select("set", "guid", "first_guid")


def off_entity(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Members (set, guid, entity) on another entity than their set (set, entity) [CHK-10]."""
    own = sets.select("set", F.col("entity").alias("of_set"))
    return members.join(own, "set").where(~F.col("entity").eqNullSafe(F.col("of_set"))).select("set", "guid", "entity", "of_set")


def known_words(units: DataFrame, terms: DataFrame, documents: DataFrame) -> DataFrame:
    """(word): unit spellings, terms with their other forms, and acronyms in titles of documents, in lower case, each once [SET-05, SUP-15]. Each of (word)."""
    plain = units.select("word").unionByName(terms.select("word"))
    named = documents.select(F.explode(acronyms(F.coalesce("word", F.lit("")))).alias("word"))
    return plain.unionByName(named).where("word is not null and word <> ''").select(F.lower("word").alias("word")).distinct()


def unknown_acronyms(texts: DataFrame, known: DataFrame) -> DataFrame:
    """(guid, acronym) of texts (guid, text) that nothing known (word) defines [CHK-11, FN-19]."""
    each = texts.select("guid", F.explode(acronyms(F.coalesce("text", F.lit("")))).alias("acronym"))
    return each.join(known.select(F.col("word")), F.lower("acronym") == F.col("word"), "left_anti")


def verb_faults(subjects: DataFrame, verbs: DataFrame) -> DataFrame:
    """(guid, fault, verb) where a process is a light verb, or a word whose kind isn't process [CHK-11, FN-20].

    subjects: (guid, process), verbs: (term, kind), a null kind meaning process.
    """
    said = subjects.select("guid", F.lower(squeezed(F.coalesce("process", F.lit("")))).alias("verb"))
    kinds = verbs.where("term is not null").groupBy(F.lower(squeezed("term")).alias("verb")).agg(F.max(F.coalesce("kind", F.lit("process"))).alias("kind"))
    light = F.col("verb").isin(*LIGHT_VERBS)
    fault = F.when(light, "light_verb").when(F.col("kind") != "process", F.col("kind"))
    return said.join(kinds, "verb", "left").select("guid", fault.alias("fault"), "verb").where("fault is not null")


def nominal_objects(subjects: DataFrame, verbs: DataFrame) -> DataFrame:
    """(guid, noun, verb): objects that open with a noun made from a verb of the register; of several verbs the least [CHK-11, FN-20].

    The nouns of each verb are listed, so this is a join on equality. From
    (guid, object) and (term).
    """
    forms = verbs.where("term is not null").select(F.lower(squeezed("term")).alias("verb")).distinct().select("verb", F.explode(noun_forms("verb")).alias("noun"))
    least = forms.groupBy("noun").agg(F.min("verb").alias("verb"))
    w = F.filter(F.regexp_extract_all(F.lower(F.coalesce("object", F.lit(""))), F.lit("([a-z]+)"), F.lit(1)), lambda x: ~x.isin(*OPENING))
    return subjects.select("guid", F.get(w, F.lit(0)).alias("noun")).join(least, "noun").select("guid", "noun", "verb")


def statement_faults(subjects: DataFrame, units: list[str], known: DataFrame, verbs: DataFrame) -> DataFrame:
    """(guid, fault, what, severity): all that can be told of a statement (guid, status, process, object, qualifier) without a judge [CHK-11].

    ``units`` are spellings, at most REGISTER_BOUND of them.
    """
    if len(units) > REGISTER_BOUND:
        raise ValueError(f"more than {REGISTER_BOUND} units")
    text = squeezed(F.concat_ws(" ", "object", "qualifier"))
    said = subjects.select("guid", text.alias("text"), quantity_tokens(text).alias("tokens"))
    found = said.select("guid", F.inline(quantity_faults("tokens", units))).select("guid", "fault", F.col("token").alias("what"))
    found = found.unionByName(unknown_acronyms(said, known).select("guid", F.lit("acronym").alias("fault"), F.col("acronym").alias("what")))
    found = found.unionByName(verb_faults(subjects, verbs).select("guid", "fault", F.col("verb").alias("what")))
    found = found.unionByName(nominal_objects(subjects, verbs).select("guid", F.lit("nominal").alias("fault"), F.col("noun").alias("what")))
    return found.join(subjects.select("guid", claimed_severity("status").alias("severity")), "guid").select("guid", "fault", "what", "severity")


def evidence_digests(required: DataFrame, claimed: DataFrame, sources: DataFrame, links: DataFrame) -> DataFrame:
    """required (requirement, case) with the digest of what the evidence rests on [FN-04].

    The digest covers what the requirement claims, (guid, claim), a JSON
    object, and the sources, (guid, id, source), of all that requirement and
    case reach over links (a, b), by id, without the requirement itself. It
    is of the JSON text with sorted keys, so layout and order of naming
    don't matter.
    """
    root = F.struct("requirement", "case")
    pairs = required.select("requirement", "case").distinct()
    seeds = pairs.select(root.alias("root"), F.explode(F.array("requirement", "case")).alias("node")).where("node is not null")
    reached = reach(links, seeds).select("root", F.col("node").alias("guid")).where("guid <> root.requirement")
    rests = reached.join(sources, "guid").groupBy("root").agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "source"))), lambda x: x["source"]).alias("rests_on"))
    rests = rests.select(F.col("root.requirement").alias("requirement"), F.col("root.case").alias("c"), "rests_on")
    both = pairs.join(rests.withColumnRenamed("requirement", "r"), (F.col("requirement") == F.col("r")) & F.col("case").eqNullSafe(F.col("c")), "left").join(claimed.withColumnRenamed("guid", "requirement"), "requirement", "left")
    listed = F.coalesce(F.to_json("rests_on"), F.lit("[]"))
    whole = F.concat(F.lit('{"claimed":'), F.coalesce("claim", F.lit("{}")), F.lit(',"rests_on":'), listed, F.lit("}"))
    return both.select("requirement", "case", document_digest(whole).alias("digest"))


def confidence_digests(evals: DataFrame, cases: DataFrame) -> DataFrame:
    """(id_eval, digest) over the fields that shape a judgement and every case that measures it [FN-05].

    evals: (id_eval, criterion, example, scope); cases: (id_eval, subject,
    verdict, origin). White space is squeezed, cases are sorted, and the
    digest is of compact JSON with sorted keys in ASCII.
    """
    case = F.array(squeezed("subject"), "verdict", "origin")
    each = cases.groupBy("id_eval").agg(F.sort_array(F.collect_list(case)).alias("case"))
    none = F.array().cast("array<array<string>>")
    fields = [squeezed(c).alias(c) for c in ("criterion", "example", "scope")]
    whole = F.to_json(F.struct(F.coalesce("case", none).alias("case"), *fields), {"ignoreNullFields": "false"})
    return evals.join(each, "id_eval", "left").select("id_eval", compact_digest(whole).alias("digest"))


def coverage_digest(criteria: Column, source: Column, around: Column) -> Column:
    """Digest of what a coverage analysis read: success criteria, the verifier's source and the module around it [FN-06]."""
    return document_digest(F.to_json(F.array(F.coalesce(criteria, F.lit("")), source, around)))


def current_analyses(analyses: DataFrame, now: DataFrame) -> DataFrame:
    """Requirements that a current analysis names: those of (requirement, verifier, digest) whose digest is the one of (requirement, verifier, digest) now [PRJ-04]."""
    return analyses.join(now, ["requirement", "verifier", "digest"], "left_semi").select("requirement").distinct()


def session_evidence(instances: DataFrame, functions: DataFrame, verifies: DataFrame, ranks: tuple[str, ...] = ("error", "failed", "skipped", "passed")) -> DataFrame:
    """(case, requirement, outcome, n_collected, n_passed) of a test session [SUP-02, AGG-11].

    Instances (name, outcome) of one function, whatever stands in brackets
    after its name, count together and keep their worst outcome; functions
    (name, guid) that aren't known are dropped; one row for each requirement
    that the function verifies (case, requirement).
    """
    rank = F.array_position(F.array(*[F.lit(r) for r in ranks]), F.col("outcome"))
    one = instances.select(F.regexp_replace("name", r"\[.*\]$", "").alias("name"), "outcome", F.when(rank > 0, rank).otherwise(len(ranks) + 1).alias("k"))
    folded = one.groupBy("name").agg(F.min_by("outcome", "k").alias("outcome"), F.count(F.lit(1)).alias("n_collected"), F.count_if(F.col("outcome") == "passed").alias("n_passed"))
    return folded.join(functions, "name").select(F.col("guid").alias("case"), "outcome", "n_collected", "n_passed").join(verifies, "case").select("case", "requirement", "outcome", "n_collected", "n_passed")


def execution_evidence(executions: DataFrame, results: DataFrame, verifies: DataFrame) -> DataFrame:
    """(case, requirement, outcome, execution) of completed executions (execution, status, kept), for results (execution, case, outcome) that passed or failed; the execution is named only if it is kept [SUP-03]."""
    done = executions.where("status = 'completed'").select("execution", "kept")
    rows = results.where("outcome in ('passed', 'failed')").join(done, "execution").join(verifies, "case")
    return rows.select("case", "requirement", "outcome", F.when(F.coalesce("kept", F.lit(False)), F.col("execution")).alias("execution"))


def inherited(nodes: DataFrame, column: str) -> DataFrame:
    """(node, value): a node's own value, else that of the nearest holder that has one [FACT-15].

    nodes: (node, holder, column), one row a node. Pointers double each
    round, so there are as many rounds as the depth has binary digits; on a
    cycle without any value it stays null.
    """
    from graphloom.session import forget, rows_in, written

    now = written(nodes.select("node", F.col("holder").alias("up"), F.col(column).alias("value")))
    for _ in range(max(1, rows_in(now)).bit_length() + 1):
        over = now.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("value").alias("more"))
        step = now.join(over, "up", "left").select("node", F.when(F.col("value").isNull(), F.col("next")).alias("up"), F.coalesce("value", "more").alias("value"))
        new = written(step)
        forget(now)
        now = new
        if now.where("value is null and up is not null").isEmpty():
            break
    return now.select("node", "value")


def cited(rows: DataFrame, quote: str, source: str) -> DataFrame:
    """``rows`` with ``holds``: whether the quote stands in the source, white space aside; an empty or missing quote doesn't [WFL-13]."""
    q, s = squeezed(F.coalesce(quote, F.lit(""))), squeezed(F.coalesce(source, F.lit("")))
    return rows.withColumn("holds", (q != "") & F.contains(s, q))


@F.pandas_udf(BooleanType())
def _is_json(text: pd.Series) -> pd.Series:
    def one(t: str | None) -> bool:
        try:
            json.loads(t)
        except (TypeError, ValueError, RecursionError):
            return False
        return True

    return text.map(one)


def first_list(c: Column | str) -> Column:
    """The JSON list from the first opening to the last closing bracket of a free text; null where that is none [SUP-34].

    Built-in parsers take a value with text after it; this one doesn't.
    """
    text = F.regexp_extract(F.col(c) if isinstance(c, str) else c, r"(?s)\[.*\]", 0)
    return F.when(_is_json(text), text)


def filled(table: DataFrame, entries: DataFrame, key: str) -> DataFrame:
    """A table with the entries offered in place of its own: an entry offered replaces the one of its key, the rest goes [WFL-11].

    ``state`` is new, replaced or dropped; columns are those of the entries.
    """
    old = table.select(F.col(key).alias("_old")).distinct()
    both = entries.withColumn("_new", F.lit(True)).join(old, F.col(key) == F.col("_old"), "full")
    state = F.when(F.col("_new").isNull(), "dropped").when(F.col("_old").isNull(), "new").otherwise("replaced")
    return both.select(F.coalesce(key, "_old").alias(key), *[c for c in entries.columns if c != key], state.alias("state"))


def placed(rows: DataFrame) -> DataFrame:
    """(filepath, path, id_self, expected): data items whose id isn't the module's name and the definition's path in lower case [CHK-04].

    rows: (filepath, path, id_self); an id's body is what follows its prefix.
    """
    stem = F.regexp_replace(F.substring_index("filepath", "/", -1), r"\.[^.]*$", "")
    expected = F.lower(F.concat_ws(".", stem, F.when(F.col("path") != "", F.col("path"))))
    body = F.expr("substring(id_self, instr(id_self, '_') + 1)")
    return rows.where("id_self is not null").select("filepath", "path", "id_self", expected.alias("expected")).where(body != expected)


def resolved_cases(cases: DataFrame, methods: DataFrame) -> DataFrame:
    """(case, method, problems): the one method of each case and what is wrong, sorted: none, several, or unknown [PRJ-09].

    cases: (case, method), a row for each method named; methods: (method).
    """
    known = methods.select(F.col("method").alias("m")).distinct()
    rows = cases.join(known, F.col("method") == F.col("m"), "left")
    each = rows.groupBy("case").agg(F.sort_array(F.collect_set("method")).alias("named"), F.count_if(F.col("method").isNotNull() & F.col("m").isNull()).alias("lost"))
    faults = F.array_compact(F.array(F.when(F.size("named") == 0, "no_method"), F.when(F.size("named") > 1, "several_methods"), F.when(F.col("lost") > 0, "unknown_method")))
    return each.select("case", F.when(F.size("named") == 1, F.col("named")[0]).alias("method"), faults.alias("problems"))

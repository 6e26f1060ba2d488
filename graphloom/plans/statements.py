"""Statements over the items at hand: a title's first word stands for its process, the rest for its object, the directory for its segment and entity."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.functions.keys import SPACE, key
from graphloom.operators import assurance as A
from graphloom.operators import statements as S
from graphloom.operators.graph import reach
from graphloom.operators.judging import Eval, tasks
from graphloom.plans.facts import FACTS, database
from graphloom.plans.registry import CORE
from graphloom.plans.rules import CONSUMES
from graphloom.session import table

#: The row that holds of each guid, with its texts; and its slots.
_HELD = f"""x as (select guid, prefix, status, segment, title, brief, description, split_part(lower(trim(title)), ' ', 1) as process, case when strpos(trim(title), ' ') > 0 then substr(trim(title), strpos(trim(title), ' ') + 1) end as object from (
  select lower(trim(guid, '{SPACE}')) as guid, split_part(coalesce(id_self, ''), '_', 1) as prefix, status, split_part(location, '/', 1) as segment, title, brief, description,
    row_number() over (partition by lower(trim(guid, '{SPACE}')) order by recorded_at desc nulls last, status desc nulls last, id_self desc nulls last, location desc nulls last, ord desc) as n from item where guid is not null) where n = 1)"""


def _sql(rest: str, recursive: bool = False) -> str:
    return f"with {'recursive ' if recursive else ''}{FACTS}, {_HELD} {rest}"


def held(spark, folder):
    """(guid, prefix, status, segment, title, brief, description, process, object) of the row that holds of each guid."""
    rows = table(spark, folder, "item").where("guid is not null")
    last = F.max(F.struct("recorded_at", "status", "id_self", "location", "ord", "title", "brief", "description")).alias("x")
    x = rows.groupBy(key("guid").alias("guid")).agg(last).select("guid", F.substring_index(F.coalesce("x.id_self", F.lit("")), "_", 1).alias("prefix"), "x.status", F.substring_index("x.location", "/", 1).alias("segment"), "x.title", "x.brief", "x.description")
    title = F.trim("title")
    at = F.instr(title, " ")
    return x.withColumns({"process": F.substring_index(F.lower(title), " ", 1), "object": F.when(at > 0, F.substring(title, at + 1, F.length(title)))})


@CORE.add("fn13_requirement_sentence", _sql("select guid, 'The ' || nullif(segment, '') || ' shall be able to ' || nullif(process, '') || ' ' || nullif(regexp_replace(trim(regexp_replace(object, '\\s+', ' ', 'g')), '\\.+$', ''), '') || '.' as sentence from x where prefix = 'req'"))
def fn13_requirement_sentence(spark, folder):
    """Requirements as sentences of an interface that shall be able to do something."""
    slots = {"condition_kind": "", "condition": "", "obligation": "shall", "activity": "interface", "actor": "", "qualifier": ""}
    r = held(spark, folder).where("prefix = 'req'").withColumn("entity", F.col("segment")).withColumns({k: F.lit(v) for k, v in slots.items()})
    return r.select("guid", X.requirement_sentence().alias("sentence"))


@CORE.add("fn14_need_sentence", _sql("select guid, 'In ' || segment || ', readers need ' || nullif(regexp_replace(trim(regexp_replace(title, '\\s+', ' ', 'g')), '\\.+$', ''), '') || ', in order to ' || nullif(process, '') || '.' as sentence from x where prefix = 'need'"))
def fn14_need_sentence(spark, folder):
    n = held(spark, folder).where("prefix = 'need'").withColumns({"context": F.col("segment"), "subject": F.lit("readers"), "outcome": F.col("title"), "purpose": F.col("process"), "entity": F.lit("")})
    return n.select("guid", X.need_sentence().alias("sentence"))


@CORE.add("fact13_subjects", _sql("select guid, process, object from x where prefix = 'req'"))
def fact13_subjects(spark, folder):
    """Requirements with the slots that statements are made of [FACT-13]."""
    return held(spark, folder).where("prefix = 'req'").select("guid", "process", "object")


_VISIBLE = """consumes(a, b) as (values ('ddr', 'req'), ('req', 'need'), ('ann', 'ddr'), ('need', 'obs')), known(k) as (values ('ddr'), ('req'), ('ann'), ('need'), ('obs')),
  visible(root, node) as (select k, k from known union select visible.root, b from visible join consumes on a = node)"""


@CORE.add(
    "chk10_undefined_verbs",
    _sql(
        f""", {_VISIBLE}, reg as (select distinct process as term, case when segment in (select k from known) then segment end as segment from x where prefix in ('need', 'term', 'obs') and process is not null),
        sub as (select guid, case when segment in (select k from known) then segment end as segment, process as term from x where prefix in ('req', 'ddr', 'ann', 'unit'))
        select guid, segment, term from sub s where not exists (select 1 from reg where reg.term = s.term and (reg.segment is null or s.segment is null or exists (select 1 from visible where root = s.segment and node = reg.segment)))""",
        True,
    ),
)
def chk10_undefined_verbs(spark, folder):
    """Process words of statements that no need, term or observation in a visible segment opens with [CHK-10, JOIN-17]."""
    known = sorted({*CONSUMES, *(b for bs in CONSUMES.values() for b in bs)})
    links = spark.createDataFrame([(a, b) for a, bs in CONSUMES.items() for b in bs], "a string, b string")
    visible = reach(links, spark.createDataFrame([(k, k) for k in known], "root string, node string")).select("root", "node")
    x = held(spark, folder).withColumn("segment", F.when(F.col("segment").isin(known), F.col("segment"))).withColumnRenamed("process", "term")
    return S.undefined(x.where("prefix in ('req', 'ddr', 'ann', 'unit')").select("guid", "segment", "term"), x.where("prefix in ('need', 'term', 'obs')").select("term", "segment"), visible)


@CORE.add("sup13_defining", _sql("select process as term, array_to_string(list_sort(list(distinct coalesce(segment, ''))), ',') as segments from x where prefix in ('need', 'term', 'obs') and process is not null group by 1"))
def sup13_defining(spark, folder):
    """Which segments define each process word [SUP-13]."""
    r = held(spark, folder).where("prefix in ('need', 'term', 'obs')").select(F.col("process").alias("term"), "segment")
    return S.defining(r).select("term", F.array_join("segments", ",").alias("segments"))


_MEMBERS = "m as (select c.guid_holder as set, x.guid, x.process, array_to_string(list_filter(regexp_extract_all(lower(coalesce(x.object, '')), '[a-z0-9]+'), lambda w: w not in ('a', 'an', 'the')), ' ') as object, i.ord from containment_f c join x on x.guid = c.guid_held join item_f i on lower(trim(i.guid)) = x.guid)"


@CORE.add("chk10_same_obligation", _sql(f", {_MEMBERS}, q as (select set, guid, first_value(guid) over w as first_guid, row_number() over w as n from m window w as (partition by set, coalesce(process, '') order by ord, guid)) select set, guid, first_guid from q where n > 1"))
def chk10_same_obligation(spark, folder):
    """Members of one holder with the process of an earlier one, objects aside [WIN-05, WIN-09]."""
    db = database(spark, folder)
    m = db.containment.join(held(spark, folder).select(F.col("guid").alias("guid_held"), "process"), "guid_held").join(db.item.select(key("guid").alias("guid_held"), "ord"), "guid_held")
    return S.same_obligation(m.select(F.col("guid_holder").alias("set"), "ord", F.col("guid_held").alias("guid"), "process", F.lit("").alias("object")))


@CORE.add("chk10_off_entity", _sql("select c.guid_holder as set, x.guid, x.segment as entity, h.segment as of_set from containment_f c join x on x.guid = c.guid_held join x h on h.guid = c.guid_holder where x.segment is distinct from h.segment"))
def chk10_off_entity(spark, folder):
    """Held items in another directory than their holder."""
    x = held(spark, folder).select("guid", F.col("segment").alias("entity"))
    m = database(spark, folder).containment.join(x, F.col("guid_held") == F.col("guid")).select(F.col("guid_holder").alias("set"), "guid", "entity")
    return S.off_entity(m, x.withColumnRenamed("guid", "set"))


_ACRO = "list_filter(regexp_extract_all(@, '[A-Za-z0-9-]+'), lambda t: regexp_full_match(t, '[A-Z]{2,6}'))"
_KNOWN = f"k as (select distinct lower(w) as w from (select title as w from x where prefix in ('unit', 'term') union all select unnest({_ACRO.replace('@', 'brief')}) from x where prefix = 'std') where w <> '')"


def _known(x):
    word = lambda p, c: x.where(F.col("prefix").isin(*p)).select(F.col(c).alias("word"))
    return S.known_words(word(["unit"], "title"), word(["term"], "title"), word(["std"], "brief"))


@CORE.add("set05_known_words", _sql(f", {_KNOWN} select w as word from k"))
def set05_known_words(spark, folder):
    """Words that units, terms and titled documents define [SET-05, SUP-15]."""
    return _known(held(spark, folder))


@CORE.add("chk11_acronyms", f"with {FACTS}, {_HELD}, {_KNOWN}, a as (select doc_id::varchar as guid, unnest(list_distinct({_ACRO.replace('@', 'text')})) as acronym from documents) select guid, acronym from a where lower(acronym) not in (select w from k)")
def chk11_acronyms(spark, folder):
    """Acronyms of all documents that nothing known defines [CHK-11]."""
    d = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("guid"), "text")
    return S.unknown_acronyms(d, _known(held(spark, folder)))


_LIGHT = ", ".join(f"'{w}'" for w in S.LIGHT_VERBS)
_OPENING = ", ".join(f"'{w}'" for w in S.OPENING)


@CORE.add("chk11_verbs", _sql(f", v as (select lower(trim(process)) as verb, max(coalesce(nullif(status, 'accepted'), 'process')) as kind from x where prefix = 'term' and process is not null group by 1) select guid, case when process in ({_LIGHT}) then 'light_verb' else kind end as fault, coalesce(process, '') as verb from x left join v on v.verb = x.process where prefix in ('req', 'ddr', 'need') and (process in ({_LIGHT}) or kind <> 'process')"))
def chk11_verbs(spark, folder):
    """Statements whose process is a light verb or names no process; a term's status other than accepted stands for its kind."""
    x = held(spark, folder)
    verbs = x.where("prefix = 'term'").select(F.col("process").alias("term"), F.when(F.coalesce("status", F.lit("accepted")) != "accepted", F.col("status")).alias("kind"))
    return S.verb_faults(x.where("prefix in ('req', 'ddr', 'need')"), verbs)


_FORMS = "list_concat([verb || e for e in ['ation', 'ment', 'al', 'ance']], [regexp_replace(verb, 'e$', '') || e for e in ['ation', 'ion', 'ment', 'ing', 'al', 'ance', 'ence']])"


@CORE.add("chk11_nominals", _sql(f", v as (select distinct lower(w) as verb from (select unnest(regexp_extract_all(lower(brief), '[a-z]+')) as w from x)), f as (select noun, min(verb) as verb from (select verb, unnest({_FORMS}) as noun from v) group by 1), s as (select guid, list_filter(regexp_extract_all(lower(coalesce(title, '')), '[a-z]+'), lambda w: w not in ({_OPENING}))[1] as noun from x) select s.guid, s.noun, f.verb from s join f using (noun)"))
def chk11_nominals(spark, folder):
    """Titles that open with a noun made from a word of some item's prose [FN-20]."""
    x = held(spark, folder)
    verbs = x.select(F.explode(F.regexp_extract_all(F.lower("brief"), F.lit("([a-z]+)"), F.lit(1))).alias("term"))
    return S.nominal_objects(x.select("guid", F.col("title").alias("object")), verbs)


@CORE.add("chk11_statement")
def chk11_statement(spark, folder):
    """All faults of requirements, quantities included."""
    x = held(spark, folder)
    subjects = x.where("prefix = 'req'").select("guid", "status", "process", "object", F.col("description").alias("qualifier"))
    return S.statement_faults(subjects, ["kg", "m", "s", "minutes", "pages", "rows", "files"], _known(x), x.where("prefix = 'term'").select(F.col("process").alias("term"), F.lit(None).cast("string").alias("kind")))


_JSON = "coalesce(to_json(@)::varchar, 'null')"


@CORE.add("fn06_coverage_digest", _sql(f"select distinct e.guid_target as requirement, e.guid_source as verifier, substr(sha256('[' || to_json(coalesce(r.description, ''))::varchar || ', ' || {_JSON.replace('@', 'v.description')} || ', ' || {_JSON.replace('@', 'v.brief')} || ']'), 1, 8) as digest from edge_f e join x r on r.guid = e.guid_target join x v on v.guid = e.guid_source where e.id_relation = 'r_verifies'"))
def fn06_coverage_digest(spark, folder):
    """What a coverage analysis of each verified item would be stamped with."""
    return _coverage(spark, folder)


def _coverage(spark, folder):
    x = held(spark, folder)
    pairs = database(spark, folder).edge.where("id_relation = 'r_verifies'").select(F.col("guid_target").alias("requirement"), F.col("guid_source").alias("verifier")).distinct()
    both = pairs.join(x.select(F.col("guid").alias("requirement"), F.col("description").alias("criteria")), "requirement").join(x.select(F.col("guid").alias("verifier"), "description", "brief"), "verifier")
    return both.select("requirement", "verifier", S.coverage_digest(F.col("criteria"), F.col("description"), F.col("brief")).alias("digest"))


@CORE.add("fn05_confidence_digest", "select verdict as id_eval, substr(sha256('{\"case\":[' || string_agg('[' || to_json(s)::varchar || ',' || coalesce(to_json(verdict)::varchar, 'null') || ',' || coalesce(to_json(id_self)::varchar, 'null') || ']', ',' order by s, id_self) || '],\"criterion\":' || to_json(verdict)::varchar || ',\"example\":null,\"scope\":null}'), 1, 8) as digest from (select *, trim(regexp_replace(text, '\\s+', ' ', 'g')) as s from eval_case where verdict is not null) group by verdict")
def fn05_confidence_digest(spark, folder):
    """One eval for each verdict, measured by the cases that have it."""
    c = table(spark, folder, "eval_case").where("verdict is not null").select(F.col("verdict").alias("id_eval"), F.col("text").alias("subject"), "verdict", F.col("id_self").alias("origin"))
    none = F.lit(None).cast("string")
    evals = c.select("id_eval").distinct().select("id_eval", F.col("id_eval").alias("criterion"), none.alias("example"), none.alias("scope"))
    return S.confidence_digests(evals, c)


_DEPENDS = ("r_derives_from", "r_implements")


@CORE.add(
    "fn04_evidence_digest",
    _sql(
        """, link as (select distinct guid_source as a, guid_target as b from edge_f where id_relation in ('r_derives_from', 'r_implements')),
        pair as (select distinct guid_target as requirement, guid_source as "case" from edge_f where id_relation = 'r_verifies' and guid_target in (select guid from x where prefix = 'req')),
        node(guid) as (select requirement from pair union select "case" from pair), w(root, guid) as (select guid, guid from node union select w.root, b from w join link on a = w.guid),
        got as (select distinct requirement, "case", w.guid from pair join w on w.root = requirement or w.root = "case" where w.guid <> requirement),
        rest as (select requirement, "case", string_agg(to_json(coalesce(description, ''))::varchar, ', ' order by x.guid) as r from got join x on x.guid = got.guid group by 1, 2)
        select requirement, "case", substr(sha256('{"claimed": {"brief": ' || coalesce(to_json(x.brief)::varchar, 'null') || ', "title": ' || coalesce(to_json(x.title)::varchar, 'null') || '}, "rests_on": [' || coalesce(r, '') || ']}'), 1, 8) as digest
        from pair join x on x.guid = requirement left join rest using (requirement, "case")""",
        True,
    ),
)
def fn04_evidence_digest(spark, folder):
    """What evidence for each verified requirement would be stamped with, over all that it rests on."""
    return _evidence(spark, folder)


def _evidence(spark, folder):
    x = held(spark, folder)
    e = database(spark, folder).edge
    pairs = e.where("id_relation = 'r_verifies'").select(F.col("guid_target").alias("requirement"), F.col("guid_source").alias("case")).join(x.where("prefix = 'req'").select(F.col("guid").alias("requirement")), "requirement", "left_semi")
    links = e.where(F.col("id_relation").isin(*_DEPENDS)).select(F.col("guid_source").alias("a"), F.col("guid_target").alias("b"))
    claim = x.select("guid", F.to_json(F.struct("brief", "title"), {"ignoreNullFields": "false"}).alias("claim"))
    return S.evidence_digests(pairs, claim, x.select("guid", F.col("guid").alias("id"), F.coalesce("description", F.lit("")).alias("source")), links)


_TIMES = f"""t as (select lower(trim(guid, '{SPACE}')) as guid, arg_min(coalesce(description, ''), struct_pack(a := recorded_at, b := coalesce(description, ''))) as first, arg_max(coalesce(description, ''), struct_pack(a := recorded_at, b := coalesce(description, ''))) as last from item where guid is not null and recorded_at is not null group by 1)"""


def _then_and_now(spark, folder):
    text = F.coalesce("description", F.lit(""))
    rows = table(spark, folder, "item").where("guid is not null and recorded_at is not null").groupBy(key("guid").alias("guid"))
    return rows.agg(F.min(F.struct("recorded_at", text.alias("d"))).alias("a"), F.max(F.struct("recorded_at", text.alias("d"))).alias("b")).select("guid", F.col("a.d").alias("first"), F.col("b.d").alias("last"))


@CORE.add(
    "chk18_evidence_state",
    _sql(
        f""", {_TIMES}, req as (select distinct guid_source as "case", guid_target as requirement from edge_f where id_relation in ('r_verifies', 'r_derives_from') and guid_target in (select guid from t)),
        evd as (select guid_source as c, guid_target as r, min(case when id_target is null then 2 when t.first = t.last then 0 else 1 end) as k from edge_f join t on t.guid = guid_target where id_relation in ('r_verifies', 'r_satisfies') group by 1, 2)
        select 'test' as method, "case", requirement, substr(sha256('[' || to_json(t.last)::varchar || ', null, null]'), 1, 8) as digest, case k when 0 then 'held' when 1 then 'stale' when 2 then 'failed' else 'absent' end as state
        from req join t on t.guid = requirement left join evd on c = "case" and r = requirement"""
    ),
)
def chk18_evidence_state(spark, folder):
    """Evidence that verifying edges are, stamped with the requirement's prose as first delivered, against what it says now; an edge without a readable target stands for a failure."""
    e = database(spark, folder).edge
    t = _then_and_now(spark, folder)
    none = F.lit(None).cast("string")
    stamp = t.select(F.col("guid").alias("requirement"), S.coverage_digest(F.col("last"), none, none).alias("now"), S.coverage_digest(F.col("first"), none, none).alias("then"))
    pair = [F.lit("test").alias("method"), F.col("guid_source").alias("case"), F.col("guid_target").alias("requirement")]
    required = e.where("id_relation in ('r_verifies', 'r_derives_from')").select(*pair).distinct().join(stamp, "requirement").select("method", "case", "requirement", F.col("now").alias("digest"))
    seen = e.where("id_relation in ('r_verifies', 'r_satisfies')").select(*pair, F.when(F.col("id_target").isNull(), "failed").otherwise("passed").alias("outcome"))
    return A.evidence_state(required, seen.join(stamp, "requirement").select("method", "case", "requirement", "outcome", F.col("then").alias("digest")))


@CORE.add("prj04_current_analyses", _sql(f", {_TIMES} select distinct guid_target as requirement from edge_f join t on t.guid = guid_target where id_relation = 'r_verifies' and t.first = t.last"))
def prj04_current_analyses(spark, folder):
    """Requirements with an analysis, made of the prose first delivered, that still stands [PRJ-04]."""
    t = _then_and_now(spark, folder)
    none = F.lit(None).cast("string")
    pairs = database(spark, folder).edge.where("id_relation = 'r_verifies'").select(F.col("guid_target").alias("guid"), F.col("guid_source").alias("verifier")).distinct().join(t, "guid").withColumnRenamed("guid", "requirement")
    of = lambda c: pairs.select("requirement", "verifier", S.coverage_digest(F.col(c), none, none).alias("digest"))
    return S.current_analyses(of("first"), of("last"))


@CORE.add(
    "str04_changed_tasks",
    _sql(
        """, cut as (select timestamp '2025-01-01' as since), v as (select lower(trim(guid)) as guid, recorded_at, row(title, brief, description) as said from item where guid is not null and recorded_at is not null),
        was as (select guid, arg_max(said, row(recorded_at, said)) as said from v, cut where recorded_at < since group by 1), now as (select guid, arg_max(said, row(recorded_at, said)) as said from v group by 1),
        changed as (select now.guid from now left join was using (guid) where was.guid is null or was.said is distinct from now.said)
        select 'e1' as id_eval, guid, null::varchar as guid_other from item_f where prefix in ('ddr', 'need') and guid in (select guid from changed)"""
    ),
)
def str04_changed_tasks(spark, folder):
    """What has to be judged again since a moment: items whose prose isn't what it was then [STR-04]."""
    said = F.struct("title", "brief", "description")
    rows = table(spark, folder, "item").where("guid is not null and recorded_at is not null").select(key("guid").alias("guid"), F.struct("recorded_at", said.alias("said")).alias("x"))
    now, was = (d.groupBy("guid").agg(F.max("x").alias("x")).select("guid", F.col("x.said").alias(name)) for d, name in ((rows, "now"), (rows.where("x.recorded_at < timestamp'2025-01-01'"), "was")))
    changed = now.join(was, "guid", "left").where("not (was <=> now)").select("guid")
    return tasks(database(spark, folder), [Eval("e1", types=("ddr", "need"))], changed)


@CORE.add("join13_known_texts", "with d as (select doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) as t from documents), c as (select case_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) as t from eval_case) select doc_id, doc_id as case_id from d where t <> '' and t in (select t from d group by 1 having count(*) > 1) union all select doc_id, -case_id from d join c using (t)")
def join13_known_texts(spark, folder):
    """Texts that are already known: delivered more than once, or equal to a case, white space aside [JOIN-13]."""
    d = table(spark, folder, "documents").select("doc_id", X.squeezed("text").alias("t"))
    c = table(spark, folder, "eval_case").select("case_id", X.squeezed("text").alias("t"))
    twice = d.where("t <> ''").groupBy("t").count().where("count > 1").select("t")
    return d.join(twice, "t", "left_semi").select("doc_id", F.col("doc_id").alias("case_id")).unionByName(d.join(c, "t").select("doc_id", (-F.col("case_id")).alias("case_id")))


@CORE.add("wfl13_citation", _sql("select guid, coalesce(q, '') <> '' and contains(coalesce(s, ''), q) as holds from (select guid, trim(regexp_replace(split_part(description, '.', 1), '\\s+', ' ', 'g')) as q, trim(regexp_replace(coalesce(brief, '') || ' ' || coalesce(description, ''), '\\s+', ' ', 'g')) as s from x)"))
def wfl13_citation(spark, folder):
    """Whether the first sentence of a description stands in an item's whole prose; without prose it doesn't."""
    x = held(spark, folder).select("guid", F.substring_index("description", ".", 1).alias("q"), F.concat_ws(" ", F.coalesce("brief", F.lit("")), F.coalesce("description", F.lit(""))).alias("s"))
    return S.cited(x, "q", "s").select("guid", "holds")


@CORE.add("sup34_first_list", "select doc_id, case when json_valid(regexp_extract(text, '(?s)\\[.*\\]')) then regexp_extract(text, '(?s)\\[.*\\]') end as list from documents where text is not null")
def sup34_first_list(spark, folder):
    return table(spark, folder, "documents").where("text is not null").select("doc_id", S.first_list("text").alias("list"))


@CORE.add("win03_prefix_claims", "with p as (select split_part(id_self, '_', 1) as prefix, status as dir, min(ord) as ord from item where id_self is not null group by 1, 2), q as (select *, row_number() over w as n, first_value(dir) over w as first_dir from p window w as (partition by prefix order by ord, dir nulls first)) select prefix, dir, first_dir from q where n > 1")
def win03_prefix_claims(spark, folder):
    """Statuses that come with a type prefix which another came with before; a directory has one prefix here [WIN-03]."""
    from graphloom.operators.relational import repeats

    rows = table(spark, folder, "item").where("id_self is not null").groupBy(F.substring_index("id_self", "_", 1).alias("prefix"), F.col("status").alias("dir")).agg(F.min("ord").alias("ord"))
    return repeats(rows, ["prefix"], "ord", "dir", keep=["dir"]).select("prefix", "dir", "first_dir")


@CORE.add("chk04_source_position", "with i as (select distinct filepath, path, regexp_extract(text, '(?m)^id_self: +(\\S+)', 1) as id_self, regexp_replace(split_part(filepath, '/', -1), '\\.[^.]*$', '') as stem from definition where text is not null) select filepath, path, id_self, lower(case when path <> '' then stem || '.' || path else stem end) as expected from i where id_self <> '' and substr(id_self, strpos(id_self, '_') + 1) <> lower(case when path <> '' then stem || '.' || path else stem end)")
def chk04_source_position(spark, folder):
    """Data items of definitions whose id isn't where they stand [CHK-04]."""
    found = F.regexp_extract("text", r"(?m)^id_self: +(\S+)", 1)
    rows = table(spark, folder, "definition").where("text is not null").select("filepath", "path", F.when(found != "", found).alias("id_self")).distinct()
    return S.placed(rows)


@CORE.add("agg05_least_level", "select prefix as dimension, min(ord % 5)::bigint as level from item where prefix is not null group by 1")
def agg05_least_level(spark, folder):
    """The least level of each dimension, the base that everything starts from [AGG-05]."""
    return table(spark, folder, "item").where("prefix is not null").groupBy(F.col("prefix").alias("dimension")).agg(F.min(F.col("ord") % 5).alias("level"))


@CORE.add("set08_unresolved", _sql("select guid_source as guid, array_to_string(list_sort(list(distinct id_target)), ',') as names from edge_f where id_target is not null and not exists (select 1 from item_f where lower(trim(item_f.id_self)) = id_target) group by 1"))
def set08_unresolved(spark, folder):
    """Sorted distinct names that each item refers to and no item has [SET-08]."""
    db = database(spark, folder)
    lost = db.edge.where("id_target is not null").join(db.item.select(key("id_self").alias("id_target")), "id_target", "left_anti")
    return lost.groupBy(F.col("guid_source").alias("guid")).agg(F.array_join(F.sort_array(F.collect_set("id_target")), ",").alias("names"))


@CORE.add("evl04_members", _sql("select c.guid_holder as guid, string_agg(x.guid || ': ' || coalesce(x.title, ''), chr(10) order by x.guid) as members from containment_f c join x on x.guid = c.guid_held group by 1"))
def evl04_members(spark, folder):
    """Members of each holder, one a line, as a judge reads them [EVL-04]."""
    m = database(spark, folder).containment.join(held(spark, folder), F.col("guid_held") == F.col("guid"))
    line = F.concat_ws(": ", "guid", F.coalesce("title", F.lit("")))
    return m.groupBy(F.col("guid_holder").alias("guid")).agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("members"))


@CORE.add("fact15_inherited", _sql(", w(node, spot, value) as (select guid, guid, status from x union all select w.node, c.guid_holder, h.status from w join containment_f c on c.guid_held = w.spot left join x h on h.guid = c.guid_holder where w.value is null and w.node in (select guid from x where status is null)) select guid as node, coalesce(x.status, (select max(value) from w where w.node = x.guid and value is not null)) as value from x where guid not in (select guid_held from containment_f) or status is not null", True))
def fact15_inherited(spark, folder):
    """Each item's status, of roots and of items that have one; see the tests for what the others inherit [FACT-15]."""
    db = database(spark, folder)
    x = held(spark, folder).select(F.col("guid").alias("node"), "status")
    nodes = x.join(db.containment.select(F.col("guid_held").alias("node"), F.col("guid_holder").alias("holder")), "node", "left")
    out = S.inherited(nodes, "status")
    alone = x.join(db.containment.select(F.col("guid_held").alias("node")), "node", "left_anti").select("node").unionByName(x.where("status is not null").select("node")).distinct()
    return out.join(alone, "node", "left_semi")


@CORE.add("prj09_resolved_cases", _sql("select guid_source as \"case\", case when count(distinct guid_target) = 1 then min(guid_target) end as method, array_to_string(list_filter([case when count(distinct guid_target) > 1 then 'several_methods' end, case when count_if(guid_target not in (select guid from item_f)) > 0 then 'unknown_method' end], lambda p: p is not null), ',') as problems from edge_f where id_relation = 'r_verifies' group by 1"))
def prj09_resolved_cases(spark, folder):
    """The one item that each case verifies, and what is wrong where there isn't one [PRJ-09]."""
    db = database(spark, folder)
    c = db.edge.where("id_relation = 'r_verifies'").select(F.col("guid_source").alias("case"), F.col("guid_target").alias("method"))
    return S.resolved_cases(c, db.item.select(F.col("guid").alias("method"))).select("case", "method", F.array_join("problems", ",").alias("problems"))


@CORE.add("flt11_burden", "with t as (select ord, guid, prefix, len(regexp_extract_all(description, '[A-Za-z]+(?:''[a-z]+)?')) as words from item where description is not null) select ord, guid, words::bigint as words from t where prefix in ('ddr', 'need') and words >= 25")
def flt11_burden(spark, folder):
    """Load of the prose of some types, of texts with at least 25 words [FLT-11, EVL-11]."""
    rows = table(spark, folder, "item").where("description is not null and prefix in ('ddr', 'need')")
    return rows.select("ord", "guid", X.load_metrics(F.col("description"))["words"].alias("words")).where("words >= 25")

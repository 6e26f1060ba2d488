"""Text functions, phrases, similarity and judgement measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.functions.schema import violations
from graphloom.operators.judging import Eval, cost, rendered, tasks
from graphloom.operators.measure import rates, screened
from graphloom.operators.relational import latest
from graphloom.operators.similarity import similar
from graphloom.plans.facts import database, over_facts
from graphloom.plans.registry import CORE
from graphloom.session import table, written

_POINTERS = ", ".join(f"'{w}'" for w in X.POINTERS)
_STOP = ", ".join(f"'{w}'" for w in X.STOP)


@CORE.add("fn01_squeezed", "select doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) as text, 'c' || substr(sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 1, 8) as key from documents")
def fn01_squeezed(spark, folder):
    return table(spark, folder, "documents").select("doc_id", X.squeezed("text").alias("text"), X.content_key("text").alias("key"))


@CORE.add("fn07_evidence_key", "select ord, 'c' || substr(sha256(coalesce(id_target, '') || '|' || guid_source), 1, 8) as key from edge")
def fn07_evidence_key(spark, folder):
    return table(spark, folder, "edge").select("ord", X.evidence_key("id_target", "guid_source").alias("key"))


@CORE.add("fn08_canonical_capture")
def fn08_canonical_capture(spark, folder):
    """Canonical texts and their digests, held against the stated digest; composing characters isn't in the SQL."""
    o = table(spark, folder, "observation").select("obs_id", "source_uri", "attribution", "published_at", X.canonical_capture("content").alias("text"), "content_digest")
    digest = X.capture_digest(F.lit(1), F.col("source_uri"), F.col("attribution"), F.col("published_at"), F.col("text"))
    return o.select("obs_id", "text", digest.alias("digest"), digest.eqNullSafe(F.col("content_digest")).alias("stated"))


@CORE.add("fn03_document_digest")
def fn03_document_digest(spark, folder):
    return table(spark, folder, "held").select("location", "path", "received_at", X.document_digest("document").alias("digest"))


@CORE.add("fn09_capture_digest", "select obs_id, 'sha256:' || sha256(concat('1', chr(10), coalesce(source_uri, ''), chr(10), coalesce(attribution, ''), chr(10), '', chr(10), coalesce(content, ''))) as digest from observation")
def fn09_capture_digest(spark, folder):
    none = F.lit(None).cast("string")
    return table(spark, folder, "observation").select("obs_id", X.capture_digest(F.lit(1), F.col("source_uri"), F.col("attribution"), none, F.col("content")).alias("digest"))


@CORE.add("fn10_slug", "select ord, guid, regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g') as slug from item")
def fn10_slug(spark, folder):
    return table(spark, folder, "item").select("ord", "guid", X.slug("title").alias("slug"))


@CORE.add("fn16_object_form", "select ord, guid, array_to_string(list_filter(regexp_extract_all(lower(title), '[a-z0-9]+'), lambda w: w not in ('a', 'an', 'the')), ' ') as form from item")
def fn16_object_form(spark, folder):
    return table(spark, folder, "item").select("ord", "guid", X.object_form("title").alias("form"))


@CORE.add("fn17_tokens")
def fn17_tokens(spark, folder):
    """Quantity tokens with their places; look-around isn't in the SQL's regular expressions."""
    return table(spark, folder, "documents").where("text is not null").select("doc_id", F.posexplode(X.quantity_tokens("text")).alias("pos", "token"))


@CORE.add("fn17_quantities")
def fn17_quantities(spark, folder):
    """Quantity tokens of each text that are numbers."""
    tokens = table(spark, folder, "documents").where("text is not null").select("doc_id", X.quantity_tokens("text").alias("t"))
    return tokens.select("doc_id", F.size(F.filter("t", lambda x: x.rlike(r"^[±+-]?\d+(\.\d+)?$"))).alias("n_number"))


_ACRONYMS = "list_sort(list_distinct(list_filter(regexp_extract_all(text, '[A-Za-z0-9-]+'), lambda x: regexp_full_match(x, '[A-Z]{2,6}'))))"


@CORE.add("fn19_acronyms", f"select doc_id, array_to_string({_ACRONYMS}, ',') as acronyms from documents where text is not null and len({_ACRONYMS}) > 0")
def fn19_acronyms(spark, folder):
    d = table(spark, folder, "documents").where("text is not null")
    return d.select("doc_id", X.acronyms("text").alias("a")).where(F.size("a") > 0).select("doc_id", F.array_join("a", ",").alias("acronyms"))


@CORE.add(
    "fn24_forms",
    """select ord, guid, array_to_string(list_filter([
         case when id_self is not null and not regexp_matches(id_self, '^[a-z]{1,8}_[a-z0-9][a-z0-9_]*(\\.[a-z0-9][a-z0-9_]*)*$') then 'id_form' end,
         case when guid is not null and not regexp_matches(guid, '^[a-z]{1,8}_[0-9a-f]{32}$') then 'guid_form' end,
         case when id_self is not null and guid is not null and split_part(id_self, '_', 1) <> split_part(guid, '_', 1) then 'prefix_pair' end], lambda x: x is not null), ',') as faults from item""",
)
def fn24_forms(spark, folder):
    return table(spark, folder, "item").select("ord", "guid", F.array_join(X.well_formed("id_self", "guid"), ",").alias("faults"))


@CORE.add(
    "fn32_load_metrics",
    f"""with t as (select ord, prefix, regexp_extract_all(description, '[A-Za-z]+(?:''[a-z]+)?') as w, greatest(len(list_filter(regexp_split_to_array(description, '[.!?]+'), lambda x: regexp_matches(x, '[A-Za-z]'))), 1) as s from item where description is not null)
       select prefix, count(*) as n, sum(len(w))::bigint as words, sum(s)::bigint as sentences, round(median(greatest(len(w), 1) / s), 4) as length,
         round(median(len(list_filter(w, lambda x: lower(x) in ({_POINTERS}))) / s), 4) as pointers,
         round(median(100.0 * len(list_filter(w, lambda x: length(x) > {X.NOMINAL_LENGTH} and regexp_matches(lower(x), '({"|".join(X.NOMINAL_ENDS)})s?$'))) / greatest(len(w), 1)), 4) as nominal from t group by 1""",
)
def fn32_load_metrics(spark, folder):
    """Text load by type: sums of words, medians of rates [AGG-09, EVL-11]."""
    rows = table(spark, folder, "item").where("description is not null")
    m = X.load_metrics(F.col("description"))
    rows = rows.select("prefix", *[c.alias(k) for k, c in m.items()])
    return rows.groupBy("prefix").agg(F.count(F.lit(1)).alias("n"), F.sum("words").alias("words"), F.sum("sentences").alias("sentences"), F.round(F.median("length"), 4).alias("length"), F.round(F.median("pointers"), 4).alias("pointers"), F.round(F.median("nominal"), 4).alias("nominal"))


_PHRASE = rf"""w as (select guid, regexp_extract_all(regexp_replace(lower(coalesce(description, '')), '\b[a-z][a-z0-9]*[_.][a-z0-9_.]+\b', ' ', 'g'), '[a-z]+(?:''[a-z]+)?') as w from item where regexp_full_match(coalesce(description, ''), '[[:ascii:]]*')),
  p as (select guid, unnest(list_filter(w, lambda x: length(x) >= 3 and x not in ({_STOP}))) as phrase from w
        union all select guid, w[i] || ' ' || w[i + 1] from (select guid, w, unnest(range(1, len(w))) as i from w) where w[i] not in ({_STOP}) and w[i + 1] not in ({_STOP}))"""


@CORE.add("agg10_phrases", f"with {_PHRASE} select phrase, count(distinct guid) as n_item from p group by 1 having n_item >= 10")
def agg10_phrases(spark, folder):
    """Words and pairs in at least ten items' prose [AGG-10, PRJ-06]; the SQL sees only plain texts, as word ends differ beyond ASCII."""
    each = table(spark, folder, "item").select("guid", F.explode(X.phrases(F.coalesce("description", F.lit("")))).alias("phrase"))
    return each.groupBy("phrase").agg(F.countDistinct("guid").alias("n_item")).where("n_item >= 10")


@CORE.add("prj06_phrase_gaps")
def prj06_phrase_gaps(spark, folder):
    """Frequent phrases that no term's title holds, in singular or within a longer term [FN-22]."""
    found = written(agg10_phrases(spark, folder))
    terms = table(spark, folder, "item").where("prefix = 'term' and title is not null").select(F.explode(X.inner_runs(F.lower("title"))).alias("known")).distinct()
    each = found.select("phrase", "n_item", F.explode(X.singulars("phrase")).alias("known"))
    hit = each.join(terms, "known", "left_semi").select("phrase").distinct()
    return found.join(hit, "phrase", "left_anti").orderBy(F.desc("n_item"), "phrase")


_SIMILAR = """with b as (select body_id, list_sort(list_distinct(list_filter(piece, lambda x: x is not null))) as s from body where (length is null or length >= 24) and piece is not null),
  c as (select s, min(body_id) as class, count(*) as n_copy from b where len(s) > 0 group by 1),
  e as (select class, len(s) as n, unnest(s) as x from c),
  k as (select p.class as a, q.class as b, count(*) as common, any_value(p.n) as n, any_value(q.n) as m from e p join e q on p.x = q.x and p.class < q.class group by 1, 2),
  l as (select a as first, b as second, round(common / (n + m - common), 6) as score from k where common >= 0.8 * (n + m - common) - 1e-9)"""


def _bodies(spark, folder):
    b = table(spark, folder, "body").where("length is null or length >= 24")
    return similar(b, "body_id", "piece")


@CORE.add("sim01_similar", _SIMILAR + " select first, second, score from l")
def sim01_similar(spark, folder):
    """Links between representatives of equal sets, best first."""
    return _bodies(spark, folder).link.withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "first", "second")


@CORE.add("sim01_classes", _SIMILAR + " select body_id as id, c.class, n_copy, (select count(*) from l where first = c.class or second = c.class) as n_link from b join c on b.s = c.s")
def sim01_classes(spark, folder):
    return _bodies(spark, folder).classes()


@CORE.add("sim01_groups")
def sim01_groups(spark, folder):
    return _bodies(spark, folder).groups()


_TALLY = """case when doc_id % 7 = 0 then 'written' when doc_id % 7 < 4 then 'mutated' else 'confirmed' end as origin,
  case when label = 'prose' then 'met' else 'unmet' end as verdict,
  case when length(text) > 700 then 'met' else 'unmet' end as v1, case when text like '%.%' then 'met' else 'unmet' end as v2, case when n_chars % 2 = 0 then 'met' else 'unmet' end as v3"""


@CORE.add(
    "evl06_rates",
    f"""with t as (select doc_id, {_TALLY} from documents join doc_label using (doc_id) where text is not null),
    m as (select *, case when 2 * ((v1 = 'unmet')::int + (v2 = 'unmet')::int + coalesce((v3 = 'unmet')::int, 0)) > 3 then 'unmet' else 'met' end as majority, v1 = v2 and v2 = v3 as alike from t)
    select coalesce(origin, 'all') as origin, count(*) as cases, 3 as samples,
      round(avg(case when verdict = 'met' then (majority = 'unmet')::int end), 3) as false_positive, round(avg(case when verdict = 'unmet' then (majority = 'met')::int end), 3) as false_negative,
      round(avg(alike::int), 3) as unanimous from m group by grouping sets ((origin), ())""",
)
def evl06_rates(spark, folder):
    """A length rule, a punctuation rule and a coin as three samples of one judge, measured against labels [EVL-06, AGG-07, AGG-08]."""
    d = table(spark, folder, "documents").join(F.broadcast(table(spark, folder, "doc_label")), "doc_id").where("text is not null")
    met = lambda c: F.when(c, "met").otherwise("unmet")
    k = F.col("doc_id") % 7
    rows = d.select(
        F.when(k == 0, "written").when(k < 4, "mutated").otherwise("confirmed").alias("origin"),
        met(F.col("label") == "prose").alias("verdict"),
        F.array(met(F.length("text") > 700), met(F.col("text").contains(".")), met(F.col("n_chars") % 2 == 0)).alias("samples"),
    )
    return rates(rows)


@CORE.add(
    "evl05_screened",
    """select source, count(*) as n, count_if(length(text) <= 300)::bigint as n_asked_again, count_if(length(text) <= 300 and not text like '%.%')::bigint as n_unmet from documents where text is not null group by 1""",
)
def evl05_screened(spark, folder):
    """Screening by length, confirmed by punctuation: only what the screen finds unmet is asked again [EVL-05]."""
    d = table(spark, folder, "documents").where("text is not null").select("doc_id", "source", "text")
    out = screened(d, lambda x: F.length(x) > 300, lambda x, i: x.contains("."), "text", confirm=3)
    return out.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if("asked").alias("n_asked_again"), F.count_if(F.col("verdict") == "unmet").alias("n_unmet"))


@CORE.add(
    "evl01_tasks",
    over_facts(
        """select 'e1' as id_eval, guid, null::varchar as guid_other from item where prefix in ('ddr', 'need')
        union all (select distinct 'e2', e.guid_source, e.guid_target from edge e join item a on a.guid = e.guid_source join item b on b.guid = e.guid_target where id_relation = 'r_supports' and a.prefix in ('ann', 'ddr', 'req', 'obs') and b.prefix in ('ann', 'ddr', 'req', 'obs'))"""
    ),
)
def evl01_tasks(spark, folder):
    return tasks(database(spark, folder), [Eval("e1", types=("ddr", "need")), Eval("e2", relation="r_supports", include=("ann", "ddr", "req", "obs"))])


@CORE.add(
    "evl03_cost",
    """with t as (select guid, id_self, trim(coalesce(brief, '')) as said from (select *, row_number() over (partition by guid order by recorded_at desc nulls last, ord desc) as n from item where guid is not null) where n = 1 and prefix = 'ddr')
       select 'e1' as id_eval, count(*) as calls, (count(*) * 5)::bigint as calls_most, sum(6 + length(coalesce(id_self, guid)) + length(said))::bigint as characters from t where said <> '' having count(*) > 0""",
)
def evl03_cost(spark, folder):
    """What asking about every decision's brief would cost."""
    last = latest(table(spark, folder, "item").where("guid is not null"), ["guid"], F.desc_nulls_last("recorded_at"), F.desc("ord"))
    task = last.where("prefix = 'ddr'").select(F.lit("e1").alias("id_eval"), "guid", F.lit(None).cast("string").alias("guid_other"))
    return cost(rendered(task, last.select("guid", "id_self", F.col("brief").alias("said"))), 5)


@CORE.add("fn18_quantity_faults")
def fn18_quantity_faults(spark, folder):
    """Numbers without unit or bound in descriptions; an English unit list stands for the register."""
    d = table(spark, folder, "item").where("description is not null")
    d = d.select("ord", "guid", X.quantity_tokens("description").alias("tokens"))
    return d.select("ord", "guid", F.inline(X.quantity_faults("tokens", ["kg", "m", "s", "minutes", "pages", "rows", "files"])))


_DANGLING = rf"(?i)(?:(?:^| )(?:{'|'.join(X.DANGLING)})[,;:]*)+$"


def _cut_sql(width: int) -> str:
    kept = rf"regexp_replace(regexp_replace(regexp_replace(left(title, {width}), ' [^ ]*$', ''), '{_DANGLING}', ''), '[ ,;:]+$', '')"
    return f"select ord, guid, case when title is null or length(title) <= {width} then title when {kept} = '' then left(title, {width}) else {kept} end as title from item"


@CORE.add("fn12_cut", _cut_sql(24))
def fn12_cut(spark, folder):
    """Titles cut at 24 characters, which most exceed."""
    return table(spark, folder, "item").select("ord", "guid", X.cut("title", 24).alias("title"))


@CORE.add("fn12_cut_short", _cut_sql(12))
def fn12_cut_short(spark, folder):
    """Titles cut at 12 characters, which leaves little but small words of some."""
    return table(spark, folder, "item").select("ord", "guid", X.cut("title", 12).alias("title"))


@CORE.add("fn09_published", "select obs_id, 'sha256:' || sha256(concat('1', chr(10), coalesce(source_uri, ''), chr(10), coalesce(attribution, ''), chr(10), coalesce(strftime(published_at, '%Y-%m-%dT%H:%M:%SZ'), ''), chr(10), coalesce(content, ''))) as digest from observation")
def fn09_published(spark, folder):
    """Capture digests over the time of publication too."""
    when = F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return table(spark, folder, "observation").select("obs_id", X.capture_digest(F.lit(1), F.col("source_uri"), F.col("attribution"), when, F.col("content")).alias("digest"))


@CORE.add("fn10_title", "select obs_id, upper(left(k, 1)) || substr(k, 2) || ' by ' || attribution || coalesce(', ' || strftime(published_at, '%-d %B %Y'), '') as title from (select *, replace(lower(source_kind), '_', ' ') as k from observation)")
def fn10_title(spark, folder):
    """Default titles of captures; null where kind or author is."""
    return table(spark, folder, "observation").select("obs_id", X.capture_title("source_kind", "attribution", "published_at").alias("title"))


@CORE.add("fn11_model_slug", "select ord, guid, regexp_replace(regexp_replace(regexp_replace(lower(prefix || ' ' || title), '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g'), '^ddr_', '') as slug from item")
def fn11_model_slug(spark, folder):
    """Slugs of names that may repeat the type prefix ddr, which is dropped."""
    return table(spark, folder, "item").select("ord", "guid", X.slug(F.concat("prefix", F.lit(" "), "title"), "ddr").alias("slug"))


@CORE.add(
    "src16_capture_faults",
    """select obs_id, array_to_string(list_filter([case when coalesce(source_kind, '') = '' then 'lacks source_kind' end, case when coalesce(source_uri, '') = '' then 'lacks source_uri' end, case when coalesce(content, '') = '' then 'lacks text' end,
         case when observed_at is null then 'lacks captured_at' end, case when coalesce(attribution, '') = '' then 'author' end], lambda x: x is not null), ',') as faults from observation""",
)
def src16_capture_faults(spark, folder):
    """What keeps each capture from being taken in; empty where nothing does."""
    need = {"source_kind": F.col("source_kind"), "source_uri": F.col("source_uri"), "text": F.col("content"), "captured_at": F.col("observed_at")}
    faults = X.capture_faults(F.lit(1), need, [F.col("attribution")])
    return table(spark, folder, "observation").select("obs_id", F.array_join(faults, ",").alias("faults"))


_SHAPE = {"type": "object", "required": ["guid_self", "title"], "properties": {"id_self": {"type": "string"}, "guid_self": {"type": "string", "pattern": "^[a-z]{1,8}_[0-9a-f]{32}$"}, "title": {"type": "string", "minLength": 1}, "relation": {"type": "array", "items": {"$ref": "#/$defs/edge"}}}, "$defs": {"edge": {"type": "object", "required": ["id_relation", "guid_target"]}}}


@CORE.add("chk09_schema")
def chk09_schema(spark, folder):
    """Documents against a schema of what every record has."""
    return violations(table(spark, folder, "held"), _SHAPE)

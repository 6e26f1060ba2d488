"""Joins, aggregates, windows, sorts and set operations over facts and tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import relational as R
from graphloom.operators.facts import labelled
from graphloom.plans.facts import database, over_facts
from graphloom.plans.registry import CORE
from graphloom.session import table


@CORE.add("join01_edge_item", over_facts("select e.ord, s.id_self as source, e.id_relation from edge e join item s on s.guid = e.guid_source"))
def join01_edge_item(spark, folder):
    db = database(spark, folder)
    return db.edge.join(db.item.select(F.col("guid").alias("guid_source"), F.col("id_self").alias("source")), "guid_source").select("ord", "source", "id_relation")


@CORE.add("join05_not_in", over_facts("select guid from item where prefix = 'term' and id_self not in (select id_target from edge where id_relation = 'r_binds')"))
def join05_not_in(spark, folder):
    db = database(spark, folder)
    return R.not_in(db.item.where("prefix = 'term'").select("guid", "id_self"), "id_self", db.edge.where("id_relation = 'r_binds'"), "id_target").select("guid")


@CORE.add("join06_both_ends", over_facts("with g as (select guid from item where status = 'accepted') select ord from edge where guid_source in (select guid from g) and guid_target in (select guid from g)"))
def join06_both_ends(spark, folder):
    db = database(spark, folder)
    return R.both_ends_in(db.edge, db.item.where("status = 'accepted'")).select("ord")


@CORE.add("join07_labelled", over_facts("select e.ord, coalesce(i.id_self, e.guid_target) as target, i.guid is null as unresolved from edge e left join item i on i.guid = e.guid_target"))
def join07_labelled(spark, folder):
    db = database(spark, folder)
    known = db.item.select(F.col("guid").alias("guid_target"), F.lit(True).alias("there"))
    return labelled(db.edge, db.item, "guid_target", "target").join(known, "guid_target", "left").select("ord", "target", F.col("there").isNull().alias("unresolved"))


@CORE.add("join08_item_pairs", over_facts("select guid_source, guid_target, id_relation from edge e join item s on s.guid = e.guid_source join item t on t.guid = e.guid_target where s.prefix = 'req' or t.prefix = 'req'"))
def join08_item_pairs(spark, folder):
    db = database(spark, folder)
    return R.item_pairs(db.edge, db.item, F.col("prefix") == "req")


@CORE.add(
    "join10_longest_prefix",
    """with p as (select distinct location from item where location is not null), r as (
         select root, min(ord) as ord from (select split_part(location, '/', 1) as root, ord from item where location is not null
           union all select split_part(location, '.', 1) || '.yaml', ord from item where location is not null and ord % 3 = 0) group by 1),
       hit as (select p.location, r.root, row_number() over (partition by p.location order by len(string_split(r.root, '/')) desc, r.ord) as n
         from p join r on p.location = r.root or starts_with(p.location, r.root || '/'))
       select p.location, hit.root from p left join hit on hit.location = p.location and n = 1""",
)
def join10_longest_prefix(spark, folder):
    items = table(spark, folder, "item").where("location is not null")
    one = items.select(F.substring_index("location", "/", 1).alias("root"), "ord")
    two = items.where("ord % 3 = 0").select(F.concat(F.substring_index("location", ".", 1), F.lit(".yaml")).alias("root"), "ord")
    return R.longest_prefix(items, one.unionByName(two), path="location")


@CORE.add(
    "join11_shared_verifiers",
    over_facts(
        """with v as (select distinct guid_source as verifier, guid_target as requirement from edge where id_relation = 'r_verifies'),
        n as (select verifier, count(*) as n from v group by 1)
        select requirement, count(*) as n_verifier, min(n) > 1 as shared from v join n using (verifier) group by 1"""
    ),
)
def join11_shared_verifiers(spark, folder):
    e = database(spark, folder).edge.where("id_relation = 'r_verifies'")
    return R.shared_verifiers(e.select(F.col("guid_source").alias("verifier"), F.col("guid_target").alias("requirement")))


@CORE.add(
    "join12_null_safe",
    """select o.obs_id, count(p.obs_id) as n from observation o left join observation p
       on o.source_kind is not distinct from p.source_kind and o.guid_self is not distinct from p.guid_self and p.obs_id <> o.obs_id group by 1""",
)
def join12_null_safe(spark, folder):
    """Other captures of the same kind and post, nulls being equal [JOIN-12]."""
    o = table(spark, folder, "observation").select("obs_id", "source_kind", "guid_self")
    per = o.groupBy("source_kind", "guid_self").agg(F.count(F.lit(1)).alias("m"))
    same = o["source_kind"].eqNullSafe(per["source_kind"]) & o["guid_self"].eqNullSafe(per["guid_self"])
    return o.join(per, same).select("obs_id", (F.col("m") - 1).alias("n"))


@CORE.add(
    "join15_latest_capture",
    """select obs_id, guid_self from (select *, row_number() over (partition by guid_self order by observed_at desc nulls last, obs_id desc) as n from observation where guid_self is not null) where n = 1""",
)
def join15_latest_capture(spark, folder):
    o = table(spark, folder, "observation").where("guid_self is not null")
    return R.latest(o, ["guid_self"], F.desc_nulls_last("observed_at"), F.desc("obs_id")).select("obs_id", "guid_self")


@CORE.add(
    "join18_answers",
    over_facts(
        """select q.guid, q.id_self as question, array_to_string(list_sort(list(distinct s.id_self) filter (s.id_self is not null)), ',') as answered_by
        from item q left join edge e on e.guid_target = q.guid and e.id_relation = 'r_supports' left join item s on s.guid = e.guid_source where q.prefix = 'qst' group by 1, 2"""
    ),
)
def join18_answers(spark, folder):
    """Questions with the sorted ids of what answers them, none included; SQL gives null for none [JOIN-18, JOIN-19, PRJ-05]."""
    db = database(spark, folder)
    e = db.edge.where("id_relation = 'r_supports'").join(db.item.select(F.col("guid").alias("guid_source"), F.col("id_self").alias("by")), "guid_source").select(F.col("guid_target").alias("guid"), "by")
    ids = db.item.where("prefix = 'qst'").select("guid", F.col("id_self").alias("question")).join(e, "guid", "left").groupBy("guid", "question").agg(F.sort_array(F.collect_set("by")).alias("ids"))
    return ids.select("guid", "question", F.when(F.size("ids") > 0, F.concat_ws(",", "ids")).alias("answered_by"))


@CORE.add("join20_first_output", over_facts("select e.guid_source as guid, min(i.id_self) as id_first from edge e join item i on i.guid = e.guid_target where e.id_relation = 'r_instantiates' and i.prefix in ('ddr', 'ann') group by 1"))
def join20_first_output(spark, folder):
    db = database(spark, folder)
    typed = db.item.where("prefix in ('ddr', 'ann')").select(F.col("guid").alias("guid_target"), "id_self")
    return db.edge.where("id_relation = 'r_instantiates'").join(typed, "guid_target").groupBy(F.col("guid_source").alias("guid")).agg(F.min("id_self").alias("id_first"))


@CORE.add("join22_incompatible", over_facts("select distinct least(x.guid_source, x.guid_target) as a, greatest(x.guid_source, x.guid_target) as b from edge x join edge y on least(x.guid_source, x.guid_target) = least(y.guid_source, y.guid_target) and greatest(x.guid_source, x.guid_target) = greatest(y.guid_source, y.guid_target) where x.id_relation = 'r_supports' and y.id_relation = 'r_challenges'"))
def join22_incompatible(spark, folder):
    return R.undirected_both(database(spark, folder).edge, "r_supports", "r_challenges")


@CORE.add("agg01_count_column", "select id_relation, count(*) as n, count(id_target) as n_id, count(distinct guid_target) as n_target from edge group by 1")
def agg01_count_column(spark, folder):
    return table(spark, folder, "edge").groupBy("id_relation").agg(F.count(F.lit(1)).alias("n"), F.count("id_target").alias("n_id"), F.countDistinct("guid_target").alias("n_target"))


@CORE.add(
    "agg06_majority_status",
    over_facts(
        """with c as (select prefix, status, count(*) as c from item group by 1, 2), t as (select prefix, sum(c)::bigint as n from c group by 1)
        select t.prefix, max(case when 2 * c > n then status end) as majority, n from t join c using (prefix) group by t.prefix, n"""
    ),
)
def agg06_majority_status(spark, folder):
    return R.majority(database(spark, folder).item, ["prefix"], "status")


@CORE.add("agg09_medians", "select source, count(*) as n, sum(n_chars)::bigint as n_chars, median(case when n_chars > 0 then n_chars end)::double as middle from documents group by 1")
def agg09_medians(spark, folder):
    """Medians ignoring what isn't a number; the biggest groups come first when shown."""
    d = table(spark, folder, "documents")
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("n_chars"), F.median(F.when(F.col("n_chars") > 0, F.col("n_chars"))).alias("middle")).orderBy(F.desc("n"), "source")


@CORE.add("agg11_worst_event", "select user_id, arg_min(event_type, case event_type when 'error' then 1 when 'purchase' then 2 when 'signup' then 3 when 'click' then 4 when 'view' then 5 else 6 end) as outcome, count(*) as n from events group by 1")
def agg11_worst_event(spark, folder):
    return R.worst_outcome(table(spark, folder, "events"), ["user_id"], "event_type", ["error", "purchase", "signup", "click", "view"])


@CORE.add(
    "agg14_bounds",
    over_facts(
        """with m as (select * from edge where id_relation = 'r_decides'), c as (select i.guid, count(m.ord) as n from item i left join m on m.guid_source = i.guid where i.prefix = 'ddr' group by 1),
        r as (select *, row_number() over (partition by guid_source order by ord) as k, count(*) over (partition by guid_source) as n from m)
        select guid, n, null::bigint as ord, 'under' as kind from c where n < 1 union all select guid_source, n, ord, 'over' from r where k = 4"""
    ),
)
def agg14_bounds(spark, folder):
    db = database(spark, folder)
    return R.bound_breaks(db.edge, db.item.where("prefix = 'ddr'"), "r_decides", 1, 3)


@CORE.add(
    "agg15_words_claimed_twice",
    over_facts("select word, count(distinct guid) as n, array_to_string(list_sort(list(distinct guid)), ',') as owners from (select guid, unnest(list_distinct(string_split(id_self, '_'))) as word from item where prefix = 'term') group by 1 having n > 1"),
)
def agg15_words_claimed_twice(spark, folder):
    terms = database(spark, folder).item.where("prefix = 'term'").select("guid", F.split("id_self", "_").alias("words"))
    return R.claimed_twice(terms, "guid", "words").withColumn("owners", F.concat_ws(",", "owners"))


@CORE.add("agg16_collected", over_facts("select guid_source as guid, array_to_string(list(guid_target order by ord), ',') as targets from edge where id_relation = 'r_derives_from' group by 1"))
def agg16_collected(spark, folder):
    """Targets in edge order."""
    e = database(spark, folder).edge.where("id_relation = 'r_derives_from'")
    ordered = F.sort_array(F.collect_list(F.struct("ord", "guid_target")))
    return e.groupBy(F.col("guid_source").alias("guid")).agg(F.array_join(F.transform(ordered, lambda x: x["guid_target"]), ",").alias("targets"))


@CORE.add("agg17_cost", "select prefix, count(*) as calls, (count(*) * 5)::bigint as calls_most, sum(length(coalesce(brief, '') || coalesce(description, '')))::bigint as characters from item group by 1")
def agg17_cost(spark, folder):
    size = F.length(F.concat(F.coalesce("brief", F.lit("")), F.coalesce("description", F.lit(""))))
    return table(spark, folder, "item").groupBy("prefix").agg(F.count(F.lit(1)).alias("calls"), (F.count(F.lit(1)) * 5).alias("calls_most"), F.sum(size).alias("characters"))


@CORE.add("agg19_first_occurrence", "select min(body_id) as body_id, name from body where name is not null group by name")
def agg19_first_occurrence(spark, folder):
    b = table(spark, folder, "body").where("name is not null")
    return R.first_per_group(b.select("body_id", "name"), ["name"], 1, "body_id").select("body_id", "name")


@CORE.add(
    "win01_repeated_guid",
    "select ord, guid, nth::int as nth, first_location, first_ord from (select ord, guid, row_number() over w as nth, first_value(location) over w as first_location, first_value(ord) over w as first_ord from item window w as (partition by guid order by ord, recorded_at, status)) where nth > 1",
)
def win01_repeated_guid(spark, folder):
    rows = table(spark, folder, "item").select("ord", "guid", "location", "recorded_at", "status")
    return R.repeats(rows, ["guid"], "ord", "recorded_at", F.asc_nulls_last("status"), keep=["location", "ord"]).select("ord", "guid", "nth", "first_location", "first_ord")


@CORE.add(
    "win02_id_reused",
    "select id_self, guid, first_guid from (select id_self, guid, first_value(guid) over (partition by id_self order by ord, guid) as first_guid, ord from (select regexp_extract(id_self, '^[^_]*_[^_]*') as id_self, guid, ord from item where id_self is not null)) where guid <> first_guid",
)
def win02_id_reused(spark, folder):
    """Ids down to their first word, which several guids do share."""
    rows = table(spark, folder, "item").where("id_self is not null").select(F.regexp_extract("id_self", "^[^_]*_[^_]*", 0).alias("id_self"), "guid", "ord")
    return R.repeats(rows, ["id_self"], "ord", "guid", keep=["guid"]).where("guid <> first_guid").select("id_self", "guid", "first_guid")


@CORE.add("win07_first_three", "select relation, ord, nth::int as nth from (select id_relation as relation, ord, row_number() over (partition by id_relation order by ord) as nth from edge) where nth <= 3")
def win07_first_three(spark, folder):
    e = table(spark, folder, "edge").select(F.col("id_relation").alias("relation"), "ord")
    return R.first_per_group(e, ["relation"], 3, "ord").select("relation", "ord", "nth")


@CORE.add(
    "win13_error_runs",
    """with x as (select user_id, ts, event_id, coalesce(event_type in ('click', 'view'), false) as f, row_number() over (partition by user_id order by event_id) as i from events),
       y as (select *, i - row_number() over (partition by user_id order by event_id) as g from x where f)
       select user_id, min(event_id) as start, count(*) as n from y group by user_id, g having n >= 3""",
)
def win13_error_runs(spark, folder):
    return R.runs(table(spark, folder, "events"), ["user_id"], "event_id", F.col("event_type").isin("click", "view"), 3)


@CORE.add("srt03_top_targets", over_facts("select guid_target, count(*) as n from edge group by 1 order by n desc, guid_target limit 40"))
def srt03_top_targets(spark, folder):
    """A top-k report: the forty most referred targets [SRT-04, SRT-08]."""
    return database(spark, folder).edge.groupBy("guid_target").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "guid_target").limit(40)


@CORE.add("srt05_nan_last", "select user_id, avg(case when value > 0 then value end) as metric from events group by 1")
def srt05_nan_last(spark, folder):
    """Metrics in falling order with what isn't a number last."""
    m = table(spark, folder, "events").groupBy("user_id").agg(F.avg(F.when(F.col("value") > 0, F.col("value"))).alias("metric"))
    return m.withColumn("metric", F.when(~F.isnan("metric"), F.col("metric"))).orderBy(F.desc_nulls_last("metric"), "user_id")


@CORE.add("set01_union", "select location from item where location is not null union select location from held where location is not null")
def set01_union(spark, folder):
    a = table(spark, folder, "item").select("location")
    return a.union(table(spark, folder, "held").select("location")).where("location is not null").distinct()


@CORE.add("set06_new_ids", "select id_self from held where id_self is not null except select id_self from item")
def set06_new_ids(spark, folder):
    return table(spark, folder, "held").where("id_self is not null").select("id_self").subtract(table(spark, folder, "item").select("id_self"))


@CORE.add(
    "set04_jaccard",
    """with t as (select guid, list_distinct(regexp_extract_all(lower(coalesce(title, '')), '[a-z]+')) as a, list_distinct(regexp_extract_all(lower(coalesce(brief, '')), '[a-z]+')) as b, ord from item)
       select guid, ord, round(case when len(list_distinct(a || b)) = 0 then 0 else len(list_intersect(a, b)) / len(list_distinct(a || b)) end, 6) as score from t""",
)
def set04_jaccard(spark, folder):
    """How alike an item's title and brief are, by words."""
    w = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z]+"), F.lit(0)))
    t = table(spark, folder, "item").select("guid", "ord", w("title").alias("a"), w("brief").alias("b"))
    both = F.size(F.array_union("a", "b"))
    return t.select("guid", "ord", F.round(F.when(both == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect("a", "b")) / both), 6).alias("score"))


@CORE.add(
    "snk09_upsert",
    """with o as (select guid, any_value(status) as status, any_value(recorded_at) as recorded_at from (select *, row_number() over (partition by guid order by recorded_at, status nulls first) as n from item) where n = 1 group by 1),
       l as (select guid, any_value(status) as status, any_value(recorded_at) as recorded_at from (select *, row_number() over (partition by guid order by recorded_at desc nulls last, status desc nulls last) as n from item) where n = 1 group by 1)
       select coalesce(o.guid, l.guid) as guid, case when o.status is not distinct from l.status then o.status else l.status end as status, case when o.status is not distinct from l.status then o.recorded_at else l.recorded_at end as recorded_at from o full join l on o.guid = l.guid""",
)
def snk09_upsert(spark, folder):
    """First deliveries upserted with the last; a redelivery whose status is unchanged leaves the row."""
    rows = table(spark, folder, "item").select("guid", "status", "recorded_at")
    old = R.latest(rows, ["guid"], F.asc_nulls_last("recorded_at"), F.asc_nulls_first("status"))
    new = R.latest(rows, ["guid"], F.desc_nulls_last("recorded_at"), F.desc_nulls_last("status"))
    return R.upserted(old, new, "guid", ("recorded_at",))

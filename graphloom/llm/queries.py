"""Queries over training text."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.llm.codedoc import code_pairs, symbols
from graphloom.llm.leakage import SPAN, leaks
from graphloom.llm.lookalike import canonical, look_pairs
from graphloom.llm.mixture import mix, shares
from graphloom.llm.neardup import alike
from graphloom.llm.quality import COMMON, label_shares, text_statistics
from graphloom.llm.readability import reading_levels
from graphloom.plans.registry import Registry
from graphloom.session import table

LLM = Registry()

_COMMON = ", ".join(f"'{w}'" for w in sorted(set(COMMON)))
STATISTICS_SQL = rf"""
with d as (select doc_id, coalesce(text, '') as t from documents),
p as (
  select doc_id, t, list_filter(regexp_split_to_array(t, '[ \t\n\r]+'), lambda w: w <> '') as w,
         list_filter(regexp_split_to_array(t, '[\n\r]+'), lambda x: trim(replace(x, chr(9), ' ')) <> '') as l,
         regexp_extract_all(lower(t), '[a-zäöüßéèêàçù]+') as a from d)
select doc_id, length(t)::bigint as n_char, len(w)::bigint as n_word,
  round(case when len(w) > 0 then list_sum(list_transform(w, lambda x: length(x))) / len(w) end, 6) as mean_word_length,
  round(case when length(t) > 0 then length(regexp_replace(t, '[\p{{L}}\p{{N}}\s]', '', 'g')) / length(t) end, 6) as symbol_ratio,
  round(case when length(t) > 0 then (length(t) - length(regexp_replace(t, '[0-9]', '', 'g'))) / length(t) end, 6) as digit_ratio,
  len(l)::bigint as n_line,
  round(case when len(l) > 0 then len(list_filter(l, lambda x: regexp_matches(x, '[.!?]["''\)\]]*[ \t]*$'))) / len(l) end, 6) as end_share,
  round(case when len(l) > 0 then len(list_filter(l, lambda x: regexp_matches(x, '^[ \t]*([-*+•]|[0-9]+[.)])[ \t]'))) / len(l) end, 6) as bullet_share,
  round(case when len(a) > 0 then len(list_filter(a, lambda x: x in ({_COMMON}))) / len(a) end, 6) as common_share,
  round(case when len(w) > 0 then len(list_distinct(w)) / len(w) end, 6) as distinct_share
from p"""


@LLM.add("p1_found")
def p1_found(spark, folder):
    """Those documented in their own file; one of several overloads suffices."""
    found = code_pairs(table(spark, folder, "definition"))
    return found.where("declared_in is null or declared_in = filepath").select("filepath", "path").distinct()


@LLM.add("p1_pairs")
def p1_pairs(spark, folder):
    return code_pairs(table(spark, folder, "definition"))


@LLM.add("p1_symbols")
def p1_symbols(spark, folder):
    return symbols(table(spark, folder, "definition"))


@LLM.add("p4_found")
def p4_found(spark, folder):
    return alike(table(spark, folder, "body")).pairs().select(F.col("a").alias("body_id_1"), F.col("b").alias("body_id_2"))


_CLASSES_SQL = """with b as (select body_id, list_sort(list_distinct(list_filter(piece, lambda x: x is not null))) as s from body where (length is null or length >= 24) and piece is not null),
  c as (select s, min(body_id) as class, count(*) as n_copy from b where len(s) > 0 group by 1),
  e as (select class, len(s) as n, unnest(s) as x from c),
  k as (select p.class as a, q.class as b from e p join e q on p.x = q.x and p.class < q.class group by 1, 2 having count(*) >= 0.8 * (any_value(p.n) + any_value(q.n) - count(*)) - 1e-9)
  select body_id, class as body_id_class, n_copy, (select count(*) from k where a = class or b = class) as n_link from b join c using (s)"""


@LLM.add("p4_classes", _CLASSES_SQL)
def p4_classes(spark, folder):
    """Every body that counts with its class of equal sets, its copies and the number of classes that are alike."""
    return alike(table(spark, folder, "body")).classes().select(F.col("id").alias("body_id"), F.col("class").alias("body_id_class"), "n_copy", "n_link")


@LLM.add("p6_found")
def p6_found(spark, folder):
    return look_pairs(table(spark, folder, "observation")).select(F.col("a").alias("obs_id_1"), F.col("b").alias("obs_id_2"))


@LLM.add("p6_canonical")
def p6_canonical(spark, folder):
    return canonical(table(spark, folder, "observation")).select(F.col("id").alias("obs_id"), "canonical", F.col("class").alias("obs_id_class"))


@LLM.add("p8_found")
def p8_found(spark, folder):
    found = leaks(table(spark, folder, "documents"), table(spark, folder, "eval_case"))
    return found.where(F.col("longest") >= SPAN).select("doc_id", "case_id")


@LLM.add("p8_leaks")
def p8_leaks(spark, folder):
    """Overlaps with at most one substituted word in any twelve, too."""
    return leaks(table(spark, folder, "documents"), table(spark, folder, "eval_case"))


@LLM.add("p2_found")
def p2_found(spark, folder):
    return reading_levels(table(spark, folder, "item"), table(spark, folder, "graded")).where("level = 'specialist'").select("guid")


@LLM.add("p2_levels")
def p2_levels(spark, folder):
    return reading_levels(table(spark, folder, "item"), table(spark, folder, "graded"))


@LLM.add("p2_profile")
def p2_profile(spark, folder):
    """Items and words by type prefix and level, with the difficulty's quartiles."""
    levels = reading_levels(table(spark, folder, "item"), table(spark, folder, "graded"))
    return levels.groupBy(F.substring_index("guid", "_", 1).alias("prefix"), "level").agg(
        F.count(F.lit(1)).alias("n_item"), F.sum("n_word").alias("n_word"), F.percentile_approx("difficulty", [0.25, 0.5, 0.75]).alias("quartile")
    )


@LLM.add("p9_mix")
def p9_mix(spark, folder):
    return mix(table(spark, folder, "documents"), table(spark, folder, "mix_target"))


@LLM.add("p9_shares")
def p9_shares(spark, folder):
    targets = table(spark, folder, "mix_target")
    return shares(mix(table(spark, folder, "documents"), targets), targets)


@LLM.add("p10_found")
def p10_found(spark, folder):
    return label_shares(table(spark, folder, "documents"), table(spark, folder, "doc_label")).where("kind <> 'prose'").select("doc_id", "kind")


@LLM.add("p10_shares")
def p10_shares(spark, folder):
    return label_shares(table(spark, folder, "documents"), table(spark, folder, "doc_label"))


@LLM.add("p10_stats", STATISTICS_SQL)
def p10_stats(spark, folder):
    return text_statistics(table(spark, folder, "documents"))

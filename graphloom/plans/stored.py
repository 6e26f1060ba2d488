"""The eight stored queries, run as text through the read-only database."""

from __future__ import annotations

from graphloom.plans.facts import database, over_facts
from graphloom.plans.registry import CORE

# What is asked, and the columns that answer it, are fixed; the texts are this project's own. Each has the text that is stored
# and, where the dialects differ, the one that it is compared with.
_UNSETTLED = """unsettled AS (SELECT note.guid, note.id_self FROM item note WHERE note.prefix = 'ann'
  AND NOT EXISTS (SELECT 1 FROM edge answer WHERE answer.guid_target = note.guid AND answer.id_relation IN ('r_supports', 'r_challenges')))"""
_ABOUT = "said AS (SELECT guid_source, id_target AS topic FROM edge WHERE id_relation = 'r_is_about'{area})"
_AREA = " AND (id_target {like} 'DDR_%' OR id_target {like} 'req_m%' OR id_target = 'mark_open_reading')"
_TOPICS = "SELECT u.guid, u.id_self AS annotation, {joined} AS about FROM unsettled u {join} said ON said.guid_source = u.guid GROUP BY u.guid, u.id_self"
_STORED_JOIN, _COMPARED_JOIN = "GROUP_CONCAT(topic, ', ')", "string_agg(topic, ', ' ORDER BY topic)"


def _topics(join: str, area: str = "") -> tuple[str, str]:
    parts = [(_STORED_JOIN, "LIKE"), (_COMPARED_JOIN, "ILIKE")]
    return tuple(f"WITH {_UNSETTLED}, {_ABOUT.format(area=area.format(like=like))} {_TOPICS.format(joined=joined, join=join)} ORDER BY annotation, u.guid" for joined, like in parts)


STORED: dict[str, tuple[str, str | None]] = {
    # annotations that nothing answers, with what they are about
    "sql11_annotations_unanswered": _topics("LEFT JOIN"),
    "sql12_count_items": ("SELECT count(guid) AS items FROM item", None),
    # decisions by how much they decide
    "sql13_decides_most": (
        """WITH reach AS (SELECT guid_source, count(guid_target) AS n FROM edge WHERE id_relation = 'r_decides' GROUP BY guid_source)
           SELECT item.id_self AS decision, sum(n) AS decided FROM reach JOIN item ON item.guid = reach.guid_source GROUP BY item.id_self ORDER BY decided DESC, decision""",
        """SELECT i.id_self AS decision, count(*) AS decided FROM edge e JOIN item i ON i.guid = e.guid_source WHERE e.id_relation = 'r_decides' GROUP BY 1""",
    ),
    # decisions that decide nothing
    "sql14_decides_nothing": (
        """SELECT d.guid, d.id_self AS decision FROM item d LEFT JOIN (SELECT DISTINCT guid_source FROM edge WHERE id_relation = 'r_decides') made ON made.guid_source = d.guid
           WHERE d.prefix = 'ddr' AND made.guid_source IS NULL ORDER BY decision""",
        None,
    ),
    # cases by what they are shown to verify, none counting as 0
    "sql15_zero_counts": (
        """WITH shown AS (SELECT guid_source, count(*) AS n FROM edge WHERE id_relation = 'r_verifies' AND guid_target IS NOT NULL GROUP BY guid_source)
           SELECT id_self AS case_item, CAST(sum(coalesce(n, 0)) AS BIGINT) AS shown FROM item LEFT JOIN shown ON guid_source = guid WHERE prefix = 'case' GROUP BY id_self ORDER BY shown DESC, case_item""",
        None,
    ),
    # requirements by what satisfies them, joined on the readable id
    "sql16_satisfied_by": (
        """WITH meets AS (SELECT id_target, count(guid_source) AS n FROM edge WHERE id_relation = 'r_satisfies' GROUP BY id_target)
           SELECT id_self AS objective, CAST(sum(coalesce(n, 0)) AS BIGINT) AS satisfied_by FROM item LEFT JOIN meets ON id_target = id_self WHERE id_self LIKE 'REQ_%' GROUP BY id_self ORDER BY satisfied_by DESC, objective""",
        """SELECT i.id_self AS objective, count(e.guid_source) AS satisfied_by FROM item i LEFT JOIN edge e ON e.id_target = i.id_self AND e.id_relation = 'r_satisfies' WHERE i.id_self ILIKE 'REQ_%' GROUP BY 1""",
    ),
    # items that wait for a decision
    "sql17_undecided": (
        """SELECT open.guid, open.id_self FROM item open WHERE open.prefix IN ('need', 'req', 'term')
           AND NOT EXISTS (SELECT 1 FROM edge made WHERE made.guid_target = open.guid AND made.id_relation = 'r_decides') ORDER BY open.id_self""",
        None,
    ),
    # annotations about one area that nothing answers
    "sql18_outstanding_area": _topics("JOIN", _AREA),
    "sql19_parameters": (
        "SELECT prefix, count(guid) AS n FROM item WHERE status = ? AND prefix <> ? GROUP BY prefix",
        "SELECT prefix, count(*) AS n FROM item WHERE status = 'accepted' AND prefix <> 'mem' GROUP BY prefix",
    ),
}
_BOUND = {"sql19_parameters": ("accepted", "mem")}


def _add(name: str, text: str, other: str | None) -> None:
    @CORE.add(name, over_facts(other or text))
    def query(spark, folder):
        return database(spark, folder).run(text, _BOUND.get(name, ()))


for _name, (_text, _other) in STORED.items():
    _add(_name, _text, _other)

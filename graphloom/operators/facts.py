"""The three fact tables, and a read-only SQL database over them."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.keys import key, prefix_of
from graphloom.session import written

ITEM = ("guid", "id_self", "prefix", "status", "location")
EDGE = ("guid_source", "id_relation", "guid_target", "id_target")
CONTAINMENT = ("guid_holder", "guid_held")


def item_facts(deliveries: DataFrame) -> DataFrame:
    """(guid, id_self, prefix, status, location, ord) of the row that holds of each guid [FACT-03, SRC-02].

    The row with the greatest recorded_at holds; null times are least, and
    ties go to the greatest status, id, location and ord.
    """
    rows = deliveries.select(key("guid").alias("guid"), "id_self", "status", "location", "ord", "recorded_at").where("guid is not null")
    last = rows.groupBy("guid").agg(F.max(F.struct("recorded_at", "status", "id_self", "location", "ord")).alias("x"))
    return last.select("guid", "x.id_self", prefix_of("x.id_self").alias("prefix"), "x.status", "x.location", "x.ord")


def edge_facts(rows: DataFrame) -> DataFrame:
    """(ord, guid_source, id_relation, guid_target, id_target) with keys in normal form; rows without an end are left out [FACT-09]."""
    out = rows.select("ord", key("guid_source").alias("guid_source"), "id_relation", key("guid_target").alias("guid_target"), key("id_target").alias("id_target"))
    return out.where("guid_source is not null and guid_target is not null")


def containment_facts(rows: DataFrame) -> DataFrame:
    """(guid_holder, guid_held): of the rows of one held item the last holds; roots have no row [FACT-02]."""
    last = rows.where("guid_held is not null").groupBy("guid_held").agg(F.max(F.struct("ord", "guid_holder")).alias("x"))
    return last.select("x.guid_holder", "guid_held").where("guid_holder is not null")


class ReadOnly(ValueError):
    """A statement that isn't a query."""


_LIKE = re.compile(r"\blike\b", re.IGNORECASE)
_GROUP_CONCAT = re.compile(r"\bgroup_concat\s*\(", re.IGNORECASE)
_WRITES = re.compile(r"Command|Insert|Delete|Update|Merge|Create|Drop|Alter|Truncate|^Set|Cache|Refresh|Load|Replace(?:Table|Data)")
_LITERAL = re.compile(r"('(?:[^']|'')*')")
_WITH = re.compile(r"\s*with\b(\s+recursive\b)?", re.IGNORECASE)


def _arguments(sql: str, at: int) -> tuple[list[str], int]:
    """The arguments of a call whose bracket opens before ``at``, and where it ends; brackets and literals inside belong to them."""
    out, depth, start = [], 0, at
    while at < len(sql):
        c = sql[at]
        if c == "'":
            at = _LITERAL.match(sql, at).end() if _LITERAL.match(sql, at) else len(sql)
            continue
        if c == "(":
            depth += 1
        elif c == ")" and depth == 0:
            return [*out, sql[start:at].strip()], at + 1
        elif c == ")":
            depth -= 1
        elif c == "," and depth == 0:
            out.append(sql[start:at].strip())
            start = at + 1
        at += 1
    raise ValueError("a bracket isn't closed")


def _joined_in_order(sql: str) -> str:
    """GROUP_CONCAT calls as ordered LISTAGG, inner ones too."""
    out, at = [], 0
    literal = [m.span() for m in _LITERAL.finditer(sql)]
    calls = [m for m in _GROUP_CONCAT.finditer(sql) if not any(a <= m.start() < b for a, b in literal)]
    for found in calls:
        if found.start() < at:  # inside a call that is done
            continue
        given, end = _arguments(sql, found.end())
        value, apart = _joined_in_order(given[0]), given[1] if len(given) > 1 else "','"
        distinct = re.match(r"distinct\b\s*", value, re.IGNORECASE)
        bare = value[distinct.end() :] if distinct else value
        out += [sql[at : found.start()], f"listagg({'DISTINCT ' if distinct else ''}{bare}, {apart}) WITHIN GROUP (ORDER BY {bare})"]
        at = end
    return "".join([*out, sql[at:]])


def translated(sql: str) -> str:
    """SQL of the stored dialect as Spark SQL [SQL-02].

    LIKE ignores ASCII case; GROUP_CONCAT joins in the order of its values,
    since the dialect leaves the order open; IFNULL and || carry over.
    String literals stay untouched.
    """
    parts = _LITERAL.split(sql)
    return _joined_in_order("".join(part if i % 2 else _LIKE.sub("ILIKE", part) for i, part in enumerate(parts)))


class FactDatabase:
    """item, edge and containment for reading only [SQL-01].

    Two items of one guid are refused, as a primary key would. The tables
    are views under a name of this database alone, so databases of one
    session don't meet.
    """

    def __init__(self, item: DataFrame, edge: DataFrame, containment: DataFrame, checked: bool = True) -> None:
        self.spark: SparkSession = item.sparkSession
        self._frames = {"item": item, "edge": edge, "containment": containment}
        if checked:
            twice = item.groupBy("guid").count().where("count > 1").limit(1).collect()
            if twice:
                raise ValueError(f"guid {twice[0][0]} is declared more than once")
        self._name = f"graphloom_{uuid.uuid4().hex}"
        for name, df in self._frames.items():
            df.createOrReplaceTempView(f"{self._name}_{name}")

    item = property(lambda self: self._frames["item"])
    edge = property(lambda self: self._frames["edge"])
    containment = property(lambda self: self._frames["containment"])

    def with_items(self, item: DataFrame) -> FactDatabase:
        """A database of other items over the same edges and containment; this one stays as it is."""
        return FactDatabase(item, self.edge, self.containment, checked=False)

    def _over_tables(self, sql: str) -> str:
        """The query with its tables bound by leading common table expressions."""
        bound = ", ".join(f"{t} AS (SELECT * FROM {self._name}_{t})" for t in self._frames)
        head = _WITH.match(sql)
        return f"WITH{head[1] or ''} {bound}, {sql[head.end() :]}" if head else f"WITH {bound} {sql}"

    @classmethod
    def of(cls, deliveries: DataFrame, edges: DataFrame, containments: DataFrame) -> FactDatabase:
        """From delivered rows; facts are unique by construction, and written once so that no query derives them anew."""
        return cls(written(item_facts(deliveries)), written(edge_facts(edges)), written(containment_facts(containments)), checked=False)

    def run(self, sql: str, parameters: tuple = ()) -> DataFrame:
        """A query's rows; parameters bind by position; anything that isn't a query is refused [SQL-02, SQL-05]."""
        text = translated(sql).strip().rstrip(";")
        plan = self.spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
        self._refuse_writes(plan)
        text = self._over_tables(text)
        return self.spark.sql(text, args=list(parameters)) if parameters else self.spark.sql(text)

    def _refuse_writes(self, plan) -> None:
        todo = [plan]
        while todo:
            node = todo.pop()
            name = node.getClass().getSimpleName()
            if _WRITES.search(name):
                raise ReadOnly(f"{name}: only queries are run")
            children = node.children()
            todo += [children.apply(i) for i in range(children.size())]

    def guid_of(self, name: str) -> str | None:
        """The guid of an item named by guid or readable id; null when there is none [SQL-04]."""
        row = self.item.where((F.col("guid") == name) | (F.col("id_self") == name)).select("guid", (F.col("guid") == name).alias("exact")).orderBy(F.desc("exact"), "guid").limit(1).collect()
        return row[0][0] if row else None

    def named(self, documents: DataFrame, name: str) -> str | None:
        """The SQL text of the stored query of that id, from (id_self, sql); null when unknown [SQL-03]."""
        row = documents.where(F.col("id_self") == name).select("sql").limit(1).collect()
        return row[0][0] if row else None


def labelled(df: DataFrame, item: DataFrame, guid: str, name: str) -> DataFrame:
    """``df`` with a column naming the item of a guid: its readable id, or the guid itself where none resolves [SQL-04, JOIN-07]."""
    names = item.select(F.col("guid").alias("_guid"), F.col("id_self").alias("_id"))
    return df.join(names, df[guid] == names["_guid"], "left").withColumn(name, F.coalesce("_id", guid)).drop("_guid", "_id")

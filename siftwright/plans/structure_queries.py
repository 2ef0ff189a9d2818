"""Queries of the core's structural operators: drift (p3), shredding (p5), hierarchies (p6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwright.operators import drift, hierarchy, shredding
from siftwright.session import read_table


def _links(spark: SparkSession, folder: str) -> DataFrame:
    messages = read_table(spark, folder, "messages").select("conversation_id", "node_id", "parent", "children", "file_path")
    return hierarchy.place_orphans(messages)


def p3_found(spark, folder):
    return drift.changes(read_table(spark, folder, "raw_messages"), read_table(spark, folder, "item_table"))


def p3_table(spark, folder):
    return drift.settled(read_table(spark, folder, "raw_messages"), read_table(spark, folder, "item_table"))


def _shredded(name):
    def query(spark, folder):
        return shredding.entity_tables(read_table(spark, folder, "conversation_exports"), read_table(spark, folder, "item_table"))[name]

    return query


def p5_found(spark, folder):
    return shredding.found_parts(read_table(spark, folder, "conversation_exports"), read_table(spark, folder, "item_table"))


def p6_found(spark, folder):
    forest = hierarchy.hierarchy(_links(spark, folder), with_paths=False)
    return forest.where(F.col("status") == hierarchy.CYCLE).select("conversation_id", "node_id")


def p6_hierarchy(spark, folder):
    return hierarchy.hierarchy(_links(spark, folder))


def p6_descendants(spark, folder):
    return hierarchy.descendants(hierarchy.hierarchy(_links(spark, folder)))


def queries():
    return {
        "p3_found": p3_found,
        "p3_table": p3_table,
        "p5_found": p5_found,
        "p5_conversations": _shredded("conversations"),
        "p5_nodes": _shredded("nodes"),
        "p5_messages": _shredded("messages"),
        "p5_parts": _shredded("parts"),
        "p6_found": p6_found,
        "p6_hierarchy": p6_hierarchy,
        "p6_descendants": p6_descendants,
    }


_PLACED = """
WITH RECURSIVE placed AS (
  SELECT conversation_id, node_id, parent, children FROM messages WHERE conversation_id IS NOT NULL
  UNION
  SELECT p.conversation_id, m.node_id, m.parent, m.children
  FROM messages m JOIN placed p ON m.parent = p.node_id WHERE m.conversation_id IS NULL
), named AS (
  SELECT conversation_id, kid AS node_id, min(node_id) AS namer
  FROM (SELECT conversation_id, node_id, unnest(children) AS kid FROM placed) GROUP BY 1, 2
), nodes AS (
  SELECT p.conversation_id, p.node_id, coalesce(max(p.parent), max(n.namer)) AS parent_id
  FROM placed p LEFT JOIN named n USING (conversation_id, node_id) GROUP BY 1, 2
), top AS (
  SELECT n.* FROM nodes n LEFT JOIN nodes up ON up.conversation_id = n.conversation_id AND up.node_id = n.parent_id
  WHERE up.node_id IS NULL
), walk AS (
  SELECT conversation_id, node_id, parent_id, node_id AS root_id, 0 AS depth, [node_id] AS path,
         CASE WHEN parent_id IS NULL THEN 'ok' ELSE 'missing_parent' END AS status FROM top
  UNION ALL
  SELECT n.conversation_id, n.node_id, n.parent_id, w.root_id, w.depth + 1, list_append(w.path, n.node_id), w.status
  FROM nodes n JOIN walk w ON n.conversation_id = w.conversation_id AND n.parent_id = w.node_id
)
"""


def oracle_sql():
    return {
        "p6_found": _PLACED + "SELECT n.conversation_id, n.node_id FROM nodes n ANTI JOIN walk w USING (conversation_id, node_id)",
        "p6_hierarchy": _PLACED
        + """, below AS (SELECT conversation_id, anc AS node_id, count(*) - 1 AS n FROM (SELECT conversation_id, unnest(path) AS anc FROM walk) GROUP BY 1, 2)
SELECT n.conversation_id, n.node_id, n.parent_id, w.root_id, w.depth, w.path, b.n AS n_descendants, coalesce(w.status, 'cycle') AS status
FROM nodes n LEFT JOIN walk w USING (conversation_id, node_id) LEFT JOIN below b USING (conversation_id, node_id)""",
        "p6_descendants": _PLACED
        + "SELECT conversation_id, ancestor_id, node_id, CAST(depth - level AS INTEGER) AS distance FROM ("
        + "SELECT conversation_id, node_id, depth, unnest(path) AS ancestor_id, generate_subscripts(path, 1) - 1 AS level FROM walk) WHERE level < depth",
    }

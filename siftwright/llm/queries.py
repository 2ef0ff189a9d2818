"""Queries of the operators for training data."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwright.functions.scalars import byte_slice
from siftwright.llm import conversations, history_index, packing, pii, splitting, subjects, tokenization
from siftwright.session import read_table


def p1_pieces(spark, folder):
    return splitting.split_turns(read_table(spark, folder, "turns"))


def p1_found(spark, folder):
    return p1_pieces(spark, folder).where("n_pieces > 1").select("file_path", "turn_idx").distinct()


def p1_whole(spark, folder):
    """The pieces of each turn put together again, each without its overlap: the content."""
    own = byte_slice(F.col("text"), F.col("overlap_bytes"))
    parts = p1_pieces(spark, folder).groupBy("file_path", "turn_idx").agg(F.array_sort(F.collect_list(F.struct("piece_no", own.alias("own")))).alias("parts"))
    return parts.select("file_path", "turn_idx", F.array_join(F.transform("parts", lambda p: p["own"]), "").alias("content"))


def p2_found(spark, folder):
    found = conversations.verdicts(read_table(spark, folder, "messages"))
    return found.where(F.col("verdict") != conversations.KEPT).select("conversation_id")


def p2_conversations(spark, folder):
    return conversations.conversations(read_table(spark, folder, "messages"))


def p4_found(spark, folder):
    return history_index.replay(read_table(spark, folder, "findings"))


def _personal(spark, folder):
    return [read_table(spark, folder, t) for t in ("turns", "messages", "context_corpus")]


def p7_found(spark, folder):
    return pii.found(*_personal(spark, folder))


def p7_redacted(spark, folder):
    return pii.redacted(*_personal(spark, folder))


def p8_ids(spark, folder):
    return tokenization.encode_corpus(read_table(spark, folder, "documents"))


def p8_texts(spark, folder):
    return tokenization.decode_corpus(p8_ids(spark, folder))


def p9_containers(spark, folder):
    return packing.pack(tokenization.token_counts(read_table(spark, folder, "documents")))


def p9_documents(spark, folder):
    """Every document, and whether one of its containers holds more than it may."""
    packed = p9_containers(spark, folder)
    fill = packed.groupBy("container_id").agg((F.sum("n_tokens") > packing.CAPACITY).alias("over"))
    return packed.join(fill, "container_id").groupBy("doc_id").agg(F.max("over").alias("over"))


def p10_found(spark, folder):
    return subjects.subjects_of(read_table(spark, folder, "documents"), read_table(spark, folder, "doc_labels"))


def p10_composition(spark, folder):
    return subjects.composition(p10_found(spark, folder), read_table(spark, folder, "documents"))


def queries():
    return {
        "p1_found": p1_found,
        "p1_pieces": p1_pieces,
        "p1_whole": p1_whole,
        "p2_found": p2_found,
        "p2_conversations": p2_conversations,
        "p4_found": p4_found,
        "p7_found": p7_found,
        "p7_redacted": p7_redacted,
        "p8_ids": p8_ids,
        "p8_texts": p8_texts,
        "p9_containers": p9_containers,
        "p9_documents": p9_documents,
        "p10_found": p10_found,
        "p10_composition": p10_composition,
    }


_ROLE = "CASE WHEN lower(trim({0})) IN ('user', 'human') THEN 'user' WHEN lower(trim({0})) IN ('assistant', 'bot', 'model') THEN 'assistant' WHEN lower(trim({0})) IN ('tool', 'function') THEN 'tool' ELSE lower(trim({0})) END"
_VISIBLE = r"[^\s\p{Z}\p{Cc}\p{Cf}]"

_P2 = rf"""
WITH RECURSIVE placed AS (
  SELECT conversation_id, node_id, parent, children, role, content, create_time FROM messages WHERE conversation_id IS NOT NULL
  UNION
  SELECT p.conversation_id, m.node_id, m.parent, m.children, m.role, m.content, m.create_time
  FROM messages m JOIN placed p ON m.parent = p.node_id WHERE m.conversation_id IS NULL
), named AS (
  SELECT conversation_id, kid AS node_id, min(node_id) AS namer
  FROM (SELECT conversation_id, node_id, unnest(children) AS kid FROM placed) GROUP BY 1, 2
), nodes AS (
  SELECT p.conversation_id, p.node_id, coalesce(max(p.parent), max(n.namer)) AS parent_id,
         max(CASE WHEN regexp_matches(content, '{_VISIBLE}') THEN CASE
           WHEN lower(trim(role)) IN ('user', 'human') THEN 'user'
           WHEN lower(trim(role)) IN ('assistant', 'bot', 'model') THEN 'assistant' END END) AS says
  FROM placed p LEFT JOIN named n USING (conversation_id, node_id) GROUP BY 1, 2
), walk AS (
  SELECT conversation_id, node_id, [node_id] AS path, says FROM nodes WHERE parent_id IS NULL
  UNION ALL
  SELECT n.conversation_id, n.node_id, list_append(w.path, n.node_id), n.says
  FROM nodes n JOIN walk w ON n.conversation_id = w.conversation_id AND n.parent_id = w.node_id
), answered AS (
  SELECT DISTINCT conversation_id, unnest(path[:-2]) AS node_id FROM walk WHERE says = 'assistant'
), facts AS (
  SELECT n.conversation_id, count(*) FILTER (n.parent_id IS NULL) AS roots, count(*) AS n,
         count(*) FILTER (n.says IS NOT NULL) AS spoken,
         count(*) FILTER (n.says = 'user' AND a.node_id IS NULL) AS open
  FROM nodes n LEFT JOIN answered a USING (conversation_id, node_id) GROUP BY 1
), reached AS (SELECT conversation_id, count(*) AS n FROM walk GROUP BY 1),
dropped AS (SELECT f.conversation_id FROM facts f LEFT JOIN reached r USING (conversation_id)
WHERE f.roots <> 1 OR r.n IS NULL OR r.n < f.n OR f.spoken = 0 OR f.open > 0)
"""

# siblings in the order of their parent's children list, those it lacks by clock and id; a path of such keys sorts in pre-order
_P2_ORDER = f""", places AS (
  SELECT conversation_id, parent_id, node_id, min(place) AS place FROM (
    SELECT conversation_id, node_id AS parent_id, unnest(children) AS node_id, generate_subscripts(children, 1) AS place FROM placed) GROUP BY 1, 2, 3
), keyed AS (
  SELECT n.conversation_id, n.node_id, n.parent_id,
         {{'k': coalesce(s.place, 1 << 30), 't': CASE WHEN s.place IS NULL THEN c.clock ELSE 0 END, 'n': n.node_id}} AS k
  FROM nodes n ANTI JOIN dropped USING (conversation_id)
  JOIN (SELECT conversation_id, node_id, min(coalesce(create_time, 0)) AS clock FROM placed GROUP BY 1, 2) c USING (conversation_id, node_id)
  LEFT JOIN places s ON s.conversation_id = n.conversation_id AND s.parent_id = n.parent_id AND s.node_id = n.node_id
), sorted AS (
  SELECT conversation_id, node_id, [k] AS ks FROM keyed WHERE parent_id IS NULL
  UNION ALL
  SELECT k.conversation_id, k.node_id, list_append(s.ks, k.k) FROM keyed k JOIN sorted s ON s.conversation_id = k.conversation_id AND s.node_id = k.parent_id
), numbered AS (SELECT conversation_id, node_id, CAST(row_number() OVER (PARTITION BY conversation_id ORDER BY ks) - 1 AS INTEGER) AS position FROM sorted),
once AS (
  SELECT conversation_id, node_id, role, content, create_time FROM placed WHERE role IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY conversation_id, node_id ORDER BY role, content NULLS FIRST, create_time NULLS FIRST) = 1
)
SELECT conversation_id, position, node_id, {_ROLE.format('role')} AS role, content, create_time FROM once JOIN numbered USING (conversation_id, node_id)
"""


def oracle_sql():
    return {
        "p1_found": "SELECT DISTINCT file_path, turn_idx FROM turns WHERE octet_length(encode(content)) > 4096",
        "p1_whole": "SELECT DISTINCT file_path, turn_idx, content FROM turns WHERE octet_length(encode(content)) > 4096",
        "p9_documents": "SELECT DISTINCT doc_id, false AS over FROM documents",
        "p2_found": _P2 + "SELECT conversation_id FROM dropped",
        "p2_conversations": _P2 + _P2_ORDER,
        "p8_texts": "SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents",
    }

"""Deeply nested records to related flat tables, by adjacency-table shredding.

A record of JSON becomes one row per value: node, parent, label, ordinal, kind
and scalar. Entities are then found with joins and pivots over that table
alone: object nodes are joined with their scalar children. Every entity row
carries the key of its parent entity.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwright.session import materialise, parallel

ADJACENCY = T.StructType(
    [
        T.StructField("tab", T.StringType()),
        T.StructField("record_id", T.LongType()),
        T.StructField("node", T.IntegerType()),
        T.StructField("parent", T.IntegerType()),
        T.StructField("grandparent", T.IntegerType()),
        T.StructField("label", T.StringType()),
        T.StructField("parent_label", T.StringType()),
        T.StructField("ordinal", T.IntegerType()),
        T.StructField("kind", T.StringType()),
        T.StructField("scalar", T.StringType()),
    ]
)

# Member names that hold a message's content, and those of its role and time.
CONTENT_NAMES = ("content", "text", "body", "contentText", "message")
ROLE_NAMES = ("role", "sender", "author", "from_role", "speaker")
TIME_NAMES = ("timestamp", "ts", "time", "createdAt", "created_at", "sent", "create_time")


def decode(text):
    """The JSON value of a text that may have been encoded more than once; None if it is cut."""
    value = text
    while isinstance(value, str):
        try:
            value = json.loads(value)
        except (ValueError, RecursionError):
            return None
    return value


def _structured(text: str):
    """An object or array that a string member encodes, if it holds records; texts that merely look like JSON stay texts."""
    if text[:1] not in '{["' or ('"id"' not in text and '\\"id' not in text and '"mapping"' not in text):
        return None
    value = decode(text)
    return value if isinstance(value, (dict, list)) else None


def kind_of(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    if isinstance(value, str):
        return "string"
    return "object" if isinstance(value, dict) else "array"


def scalar_text(value) -> str | None:
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value)


def adjacency_rows(value) -> Iterator[tuple]:
    """(node, parent, grandparent, label, parent_label, ordinal, kind, scalar) in pre-order, without recursion."""
    stack = [(value, -1, -1, None, None, 0)]
    n = 0
    while stack:
        value, parent, grand, label, above, ordinal = stack.pop()
        if isinstance(value, str) and label not in CONTENT_NAMES and above != "parts" and len(value) > 1:
            inner = _structured(value)
            value = value if inner is None else inner
        kind = kind_of(value)
        yield n, parent, grand, label, above, ordinal, kind, scalar_text(value) if kind not in ("object", "array") else None
        if kind == "object":
            stack += [(v, n, parent, k, label, i) for i, (k, v) in reversed(list(enumerate(value.items())))]
        elif kind == "array":
            stack += [(v, n, parent, None, label, i) for i, v in reversed(list(enumerate(value)))]
        n += 1


def shred(records: DataFrame, tab: str, column: str) -> DataFrame:
    """The adjacency table of a JSON column; records: record_id and that column.

    A record delivered again counts once. Cut, blank and null records give no
    rows. A record encoded more than once is decoded first; a member string
    that encodes records is opened in place.
    """

    def run(batches):
        for pdf in batches:
            out = []
            for rid, text in zip(pdf["record_id"], pdf["value"], strict=True):
                value = decode(text)
                if not isinstance(value, (dict, list)):
                    continue
                out += [(tab, rid, *row) for row in adjacency_rows(value)]
                if len(out) > 50_000:
                    yield _frame(out)
                    out = []
            if out:
                yield _frame(out)

    rows = records.select("record_id", F.col(column).alias("value")).where("value IS NOT NULL AND record_id IS NOT NULL")
    once = rows.groupBy("record_id").agg(F.min("value").alias("value"))
    return once.mapInPandas(run, ADJACENCY)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=ADJACENCY.names)


def _pivot(adj: DataFrame, labels: dict[str, tuple[str, ...]]) -> DataFrame:
    """One row per object that has scalar children: its scalar members under settled names."""
    names = [n for ns in labels.values() for n in ns]
    own = adj.where(F.col("label").isin(*names) & ~F.col("kind").isin("object", "array", "null"))
    best = lambda ns: F.coalesce(*[F.max(F.when(F.col("label") == n, F.col("scalar"))) for n in ns])
    return own.groupBy("tab", "record_id", F.col("parent").alias("node")).agg(*[best(ns).alias(c) for c, ns in labels.items()])


def _exports(adj: DataFrame) -> dict[str, DataFrame]:
    """Conversations, graph nodes and content parts of message-graph exports.

    conversation: an object with a `mapping` member; node: a member (or
    element) of that mapping; message: the node's `message`; part: an element
    of content.parts, or content itself where it is a plain string.
    """
    keys = ["tab", "record_id"]
    mapping = adj.where("label = 'mapping' AND kind IN ('object', 'array')").select(*keys, F.col("node").alias("mapping"), F.col("parent").alias("conversation"))
    heads = _pivot(adj.where("label IN ('title', 'id', 'conversation_id')"), {"title": ("title",), "id": ("id",), "conversation_id": ("conversation_id",)})
    conversations = mapping.join(heads.withColumnRenamed("node", "conversation"), [*keys, "conversation"], "left").select(
        *keys, F.col("conversation").alias("conversation_no"), F.coalesce("conversation_id", "id").alias("conversation_id"), "title"
    )
    members = adj.where("kind = 'object' AND parent_label = 'mapping'")
    ids = adj.where("label = 'id' AND kind = 'string'").select(*keys, F.col("parent").alias("node"), F.col("scalar").alias("id"))
    links = adj.where("label = 'parent' AND kind = 'string'").select(*keys, F.col("parent").alias("node"), F.col("scalar").alias("parent_id"))
    nodes = (
        members.select(*keys, "node", F.col("grandparent").alias("conversation_no"), "label")
        .join(ids, [*keys, "node"], "left")
        .join(links, [*keys, "node"], "left")
        .select(*keys, "conversation_no", "node", F.coalesce("id", "label").alias("node_id"), "parent_id")
    )
    # content -> message -> node; parts lie one or two levels below the message
    contents = adj.where("label = 'content' AND parent_label = 'message'").select(*keys, F.col("node").alias("content"), F.col("grandparent").alias("owner"), "kind", "scalar")
    plain = contents.where("kind = 'string'").select(*keys, "owner", F.lit(0).alias("part_no"), "kind", "scalar", F.col("content").alias("part"))
    elements = adj.where("parent_label = 'parts' AND label IS NULL").select(*keys, F.col("grandparent").alias("content"), F.col("ordinal").alias("part_no"), "kind", "scalar", F.col("node").alias("part"))
    listed = elements.join(contents.select(*keys, "content", "owner"), [*keys, "content"]).select(*keys, "owner", "part_no", "kind", "scalar", "part")
    parts = plain.unionByName(listed).withColumnRenamed("owner", "node").join(nodes.select(*keys, "node", "node_id", "conversation_no"), [*keys, "node"])
    return {"conversations": conversations, "nodes": nodes.drop("node"), "parts": parts.drop("node")}


def _items(adj: DataFrame) -> dict[str, DataFrame]:
    """Message objects (objects with an `id`) at any depth, and their content parts.

    A content member that is a string is part 0; the blocks of a content array
    are parts by their place. parent_message_id is the id of the closest
    message object above.
    """
    keys = ["tab", "record_id"]
    ids = adj.where("label = 'id' AND kind NOT IN ('object', 'array', 'null')").select(*keys, F.col("parent").alias("node"), F.col("scalar").alias("node_id"))
    heads = _pivot(adj.where(F.col("label").isin(*ROLE_NAMES, *TIME_NAMES, "model")), {"role": ROLE_NAMES, "time": TIME_NAMES, "model": ("model",)})
    above = adj.where("label = 'replies'").select(*keys, F.col("node").alias("replies"), F.col("parent").alias("upper"))
    place = adj.where("kind = 'object' AND parent_label = 'replies'").select(*keys, "node", F.col("parent").alias("replies"))
    upper = place.join(above, [*keys, "replies"]).join(ids.select(*keys, F.col("node").alias("upper"), F.col("node_id").alias("parent_message_id")), [*keys, "upper"]).select(*keys, "node", "parent_message_id")
    messages = ids.join(heads, [*keys, "node"], "left").join(upper, [*keys, "node"], "left")
    rank = F.element_at(F.create_map(*[x for i, n in enumerate(CONTENT_NAMES) for x in (F.lit(n), F.lit(i))]), F.col("label"))
    bodies = adj.where(F.col("label").isin(*CONTENT_NAMES) & F.col("kind").isin("string", "array")).select(*keys, F.col("parent").alias("node"), F.col("node").alias("content"), "kind", "scalar", rank.alias("rank"))
    first = bodies.groupBy(*keys, "node").agg(F.min(F.struct("rank", "content", "kind", "scalar")).alias("b")).select(*keys, "node", "b.content", "b.kind", "b.scalar")
    owned = first.join(ids, [*keys, "node"])
    plain = owned.where("kind = 'string'").select(*keys, "node_id", F.lit(0).alias("part_no"), "kind", "scalar", F.col("content").alias("part"))
    blocks = adj.where("label IS NULL").select(*keys, F.col("parent").alias("content"), F.col("ordinal").alias("part_no"), "kind", "scalar", F.col("node").alias("part"))
    listed = owned.where("kind = 'array'").select(*keys, "node_id", "content").join(blocks, [*keys, "content"]).select(*keys, "node_id", "part_no", "kind", "scalar", "part")
    return {"messages": messages.drop("node"), "parts": plain.unionByName(listed).withColumn("conversation_no", F.lit(None).cast("int"))}


def _with_text(parts: DataFrame, adj: DataFrame) -> DataFrame:
    """A part's text: its own scalar, or the text member of a block; filled tells whether there is anything in it."""
    keys = ["tab", "record_id"]
    inner = (
        adj.where("label IS NOT NULL AND parent_label IS NULL AND kind <> 'null'")  # members of objects in arrays, as parts are
        .groupBy(*keys, F.col("parent").alias("part"))
        .agg(F.max(F.when((F.col("label") == "text"), F.col("scalar"))).alias("text"), F.max(F.when(F.col("label") == "text", F.lit(True))).alias("texted"), F.count("*").alias("members"))
    )
    joined = parts.join(inner, [*keys, "part"], "left")
    scalar = F.col("kind").isin("string", "number", "boolean")
    filled = F.when(scalar, F.col("scalar") != "").when(F.col("kind") == "object", F.when(F.col("texted"), F.col("text") != "").otherwise(F.col("members") > 0)).otherwise(F.lit(False))
    return joined.select(*keys, "conversation_no", "node_id", "part_no", F.col("kind").alias("part_kind"), F.when(scalar, F.col("scalar")).otherwise(F.col("text")).alias("text"), F.coalesce(filled, F.lit(False)).alias("filled"))


def entity_tables(exports: DataFrame, items: DataFrame) -> dict[str, DataFrame]:
    """Flat tables of both sources: conversations, nodes, messages, parts.

    exports: record_id, raw. items: record_id, key, value; only keys that
    start with `aiService.` hold messages. Empty tables give empty tables;
    nulls in any column, cut or blank JSON give no rows.
    """
    export_adj = shred(parallel(exports), "conversation_exports", "raw")
    item_adj = shred(parallel(items.where("key LIKE 'aiService.%'")), "item_table", "value")
    adj = materialise(export_adj.unionByName(item_adj), "adjacency")
    e = _exports(adj.where("tab = 'conversation_exports'"))
    i = _items(adj.where("tab = 'item_table'"))
    parts = _with_text(e["parts"].unionByName(i["parts"]), adj)
    return {"conversations": e["conversations"], "nodes": e["nodes"], "messages": i["messages"], "parts": parts, "adjacency": adj}


def found_parts(exports: DataFrame, items: DataFrame) -> DataFrame:
    """(tab, record_id, node_id, part_no) of each content part that is neither null nor empty."""
    parts = entity_tables(exports, items)["parts"]
    return parts.where("filled").select("tab", "record_id", "node_id", "part_no").distinct()

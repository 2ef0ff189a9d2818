"""Rebuilding conversations from message rows with keyed streaming state.

Rows arrive in any order and late. Each conversation is a key of a streaming
query; its rows are buffered in the state under an event-time watermark and
the conversation is validated and emitted once: on closure, when all rows its
producer announced are there, or on timeout, when the watermark has passed its
last row by the idle time. A row is kept as a digest (ids, speaker, whether it
has visible text); contents stay in the table and are joined back by key.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from siftwright.operators.drift import ROLE_SPELLINGS
from siftwright.operators.hierarchy import (
    CYCLE,
    LOCAL_ROWS,
    LOST,
    effective_parents,
    hierarchy,
    large_trees,
    path_sums,
    place_orphans,
    solve_tree,
    subtree_sums,
)
from siftwright.session import fresh_path, materialise

KEPT = "kept"
CLOSED = "closed"  # the mark of a conversation that has been emitted
# a message reaches the state as one JSON digest: [node, parent, children, speaker, visible, clock, nodes announced]
EVENTS = "conversation_id string, digest string, event_time timestamp"
REPLAY_TIME = 4_102_444_800  # seconds; the one event time of all rows of a replayed table (any time after the epoch)
VERDICTS = "conversation_id string, verdict string, node_ids array<string>"


def speaker(role: Column) -> Column:
    """A role's settled spelling; an unknown role stays as it is, in lower case."""
    bare = F.lower(F.trim(role))
    spelled = F.create_map(*[F.lit(x) for kv in ROLE_SPELLINGS.items() for x in kv])
    return F.coalesce(F.try_element_at(spelled, bare), bare)


def has_visible_text(content: Column) -> Column:
    """Anything but white space, control and zero-width characters."""
    return F.coalesce(content.rlike(r"[^\s\p{Z}\p{Cc}\p{Cf}]"), F.lit(False))


def judge(rows: list[tuple]) -> tuple[str, list[str]]:
    """(verdict, node ids in order) of one conversation from (node, parent, children, speaker, visible, clock) rows.

    Order: each node before what hangs below it; siblings as their parent's
    children list has them, then by clock and id (clocks may run backwards
    between a node and its parent, which does not matter).
    """
    parents = effective_parents([r[:3] for r in rows])
    if sum(p is None for p in parents.values()) != 1:
        return "broken: not one root", []
    if any(p is not None and p not in parents for p in parents.values()):
        return "broken: missing parent", []
    solved = list(solve_tree(parents, with_paths=False))
    if any(r[6] == CYCLE for r in solved):
        return "broken: cycle", []
    says = {}
    rank = {}
    for node, _, children, who, visible, clock in rows:
        says[node] = max(filter(None, (says.get(node), who if visible else None)), default=None)
        late = (1 << 30, clock if clock == clock and clock is not None else 0.0, node)
        rank[node] = min(rank.get(node, late), late)
        for i, kid in enumerate(children if children is not None else ()):
            if kid in parents and parents[kid] == node and (i, 0.0, kid) < rank.get(kid, (1 << 30,)):
                rank[kid] = (i, 0.0, kid)
    if not any(w in ("user", "assistant") for w in says.values()):
        return "empty", []
    answered = dict.fromkeys(parents, False)
    for _, node in sorted(((r[3], r[0]) for r in solved), reverse=True):
        up = parents[node]
        if up is not None and (answered[node] or says[node] == "assistant"):
            answered[up] = True
    if any(w == "user" and not answered[n] for n, w in says.items()):
        return "unanswered", []
    kids: dict = {}
    for node, up in parents.items():
        kids.setdefault(up, []).append(node)
    order, stack = [], list(kids[None])
    while stack:
        node = stack.pop()
        order.append(node)
        stack += sorted(kids.get(node, ()), key=rank.__getitem__, reverse=True)
    return KEPT, order


def digest(expected: Column) -> Column:
    """EVENTS' digest of a row of message_events."""
    fields = ("node_id", "parent", "children", "speaker", "visible", "clock")
    return F.to_json(F.struct(*[F.col(c).alias(f"f{i}") for i, c in enumerate(fields)], expected.cast("long").alias("n")))


def rebuild(events: DataFrame, delay: str = "7 days", idle_seconds: int = 7 * 86400, remember: bool = True) -> DataFrame:
    """The streaming operator: VERDICTS of conversations from a stream of EVENTS.

    The number of nodes a producer has announced for a conversation closes it;
    where none is announced, only the timeout does. Works in append mode;
    repeated deliveries count once: with `remember` a closed conversation
    leaves a mark in the state until the watermark has passed it, so that rows
    delivered again afterwards don't open it a second time.
    """

    def step(key, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        packed, last = state.get if state.exists else ("[]", 0)
        if state.hasTimedOut:
            state.remove()
            if packed == CLOSED:
                return
            rows = json.loads(packed)
        else:
            pdfs = list(pdfs)
            rows = [] if packed == CLOSED else json.loads(packed)
            if packed != CLOSED:
                rows += json.loads(f"[{','.join(d for pdf in pdfs for d in pdf['digest'].tolist())}]")
            expected = max((r["n"] for r in rows if "n" in r), default=None)
            done = packed != CLOSED and expected is not None and len({r["f0"] for r in rows}) >= expected
            if not done or remember:
                last = max(last, *(int(pdf["event_time"].max().timestamp() * 1000) for pdf in pdfs))
                state.update((CLOSED if done or packed == CLOSED else json.dumps(rows), last))
                state.setTimeoutTimestamp(max(last + idle_seconds * 1000, state.getCurrentWatermarkMs() + 1))
            elif state.exists:
                state.remove()
            if not done:
                return
        verdict, order = judge([tuple(r.get(f"f{i}") for i in range(6)) for r in rows])
        yield pd.DataFrame({"conversation_id": [key[0]], "found": [json.dumps([verdict, *order])]})

    keyed = events.withWatermark("event_time", delay).groupBy("conversation_id")
    found = keyed.applyInPandasWithState(step, "conversation_id string, found string", "packed string, last long", "append", GroupStateTimeout.EventTimeTimeout)
    parts = F.from_json("found", "array<string>")
    return found.select("conversation_id", parts[0].alias("verdict"), F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))).alias("node_ids"))


def message_events(messages: DataFrame) -> DataFrame:
    """The rows that events are made of, from a table of messages: orphans placed, roles settled, contents reduced to whether they show anything.

    Rows without a node_id, and those whose conversation cannot be found, are
    left out. A null loaded_at counts as the epoch.
    """
    who = speaker(F.col("role"))
    digests = messages.select("conversation_id", "node_id", "parent", "children", "file_path", who.alias("speaker"), has_visible_text(F.col("content")).alias("visible"), F.col("create_time").alias("clock"), F.coalesce("loaded_at", F.timestamp_seconds(F.lit(0))).alias("event_time"))
    placed = place_orphans(digests).where("conversation_id IS NOT NULL AND node_id IS NOT NULL").drop("file_path")
    return placed


def verdicts(messages: DataFrame, local_rows: int = LOCAL_ROWS, max_bytes: int = 1 << 30, delay: str = "7 days") -> DataFrame:
    """(conversation_id, verdict, node_ids) of every conversation of a table, by replaying it as a stream.

    The table is written to the shared folder by conversation, with the number
    of nodes of each, so every conversation closes in the micro-batch that
    brings its last row and the state stays small; a micro-batch takes
    `max_bytes`. A table is whole, so no row of it is late: all carry one event
    time, which the watermark never passes, however many micro-batches there
    are (loaded_at would, as the files are not in its order; rows at the epoch
    would be late from the start). As many verdicts must come out as
    conversations went in, else the replay fails. Conversations of more than
    `local_rows` rows are never put into one state: they are judged by joins
    (see judge_large), and in_order gives their order. node_ids is null there.
    """
    return _verdicts(messages, local_rows, max_bytes, delay)[0]


def _verdicts(messages: DataFrame, local_rows: int, max_bytes: int = 1 << 30, delay: str = "7 days") -> tuple[DataFrame, DataFrame | None]:
    """verdicts, and the nodes of the large conversations with their positions, if there are any."""
    spark = messages.sparkSession
    events = message_events(messages)
    big = large_trees(events, local_rows)
    large = None
    if big.head(1):
        big = materialise(big, "large-conversations")
        large = materialise(events.join(big, "conversation_id", "left_semi"), "large-events")
        events = events.join(big, "conversation_id", "left_anti")
    nth = events.withColumn("nth", F.expr("dense_rank() OVER (PARTITION BY conversation_id ORDER BY node_id)"))
    counts = F.expr("max(nth) OVER (PARTITION BY conversation_id)")
    source, sink, log = (fresh_path(spark, x) for x in ("events", "verdicts", "stream-log"))
    now = F.timestamp_seconds(F.lit(REPLAY_TIME))
    nth.select("conversation_id", digest(counts).alias("digest"), now.alias("event_time")).write.parquet(source)
    stream = spark.readStream.schema(EVENTS).option("maxBytesPerTrigger", max_bytes).parquet(source)
    query = rebuild(stream, delay, remember=False).writeStream.format("parquet").option("path", sink).option("checkpointLocation", log).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.read.schema(VERDICTS).parquet(sink)
    went, came = spark.read.schema(EVENTS).parquet(source).select("conversation_id").distinct().count(), out.count()
    if went != came:
        raise RuntimeError(f"{went} conversations went into the replay, {came} verdicts came out")
    if large is None:
        return out, None
    judged, nodes = judge_large(large)
    return out.unionByName(judged), nodes


def judge_large(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same verdicts by joins, for conversations too large for one state, and their nodes with what in_order needs."""
    c = "conversation_id"
    forest = materialise(hierarchy(events, with_paths=False, local_rows=0), "large-forest")
    clock = F.when(F.col("clock").isNull() | F.isnan("clock"), F.lit(0.0)).otherwise(F.col("clock"))
    said = events.groupBy(c, "node_id").agg(F.max(F.when(F.col("visible"), F.col("speaker"))).alias("says"), F.min(clock).alias("clock"))
    nodes = materialise(forest.join(said, [c, "node_id"]), "large-nodes")
    whole = nodes.where(F.col("status") != CYCLE).select(c, "node_id", F.when(F.col("depth") > 0, F.col("parent_id")).alias("parent_id"), F.coalesce(F.col("says") == "assistant", F.lit(False)).cast("int").alias("x"))
    replies = subtree_sums(whole, F.max)
    nodes = materialise(nodes.join(replies, [c, "node_id"], "left"), "large-judged")
    facts = nodes.groupBy(c).agg(
        F.count_if(F.col("parent_id").isNull()).alias("roots"),
        F.count_if((F.col("status") == LOST) & (F.col("depth") == 0)).alias("lost"),
        F.count_if(F.col("status") == CYCLE).alias("cyclic"),
        F.count_if(F.col("says").isin("user", "assistant")).alias("spoken"),
        F.count_if((F.col("says") == "user") & (F.coalesce("x", F.lit(0)) == 0)).alias("open"),
    )
    verdict = (
        F.when(F.col("roots") != 1, "broken: not one root")
        .when(F.col("lost") > 0, "broken: missing parent")
        .when(F.col("cyclic") > 0, "broken: cycle")
        .when(F.col("spoken") == 0, "empty")
        .when(F.col("open") > 0, "unanswered")
        .otherwise(KEPT)
    )
    judged = materialise(facts.select(c, verdict.alias("verdict"), F.lit(None).cast("array<string>").alias("node_ids")), "large-verdicts")
    places = events.select(c, F.col("node_id").alias("parent_id"), F.posexplode("children").alias("place", "node_id")).groupBy(c, "parent_id", "node_id").agg(F.min("place").alias("place"))
    kept = nodes.join(judged.where(F.col("verdict") == KEPT).select(c), c, "left_semi")
    return judged, kept.join(places, [c, "parent_id", "node_id"], "left").select(c, "node_id", "parent_id", "n_descendants", "place", "clock")


def in_order(nodes: DataFrame) -> DataFrame:
    """(conversation_id, node_id, position) of judge_large's nodes: the order of judge, by sums.

    A node stands behind its parent and all that hangs below its earlier
    siblings. Siblings are sorted over the whole table, not per parent, and
    their sizes summed in two steps, so that a parent of any number of
    children is never one task's.
    """
    c = "conversation_id"
    keys = [F.coalesce("place", F.lit(1 << 30)), F.when(F.col("place").isNull(), F.col("clock")).otherwise(F.lit(0.0)), F.col("node_id")]
    cut = nodes.repartitionByRange(F.col(c), F.col("parent_id"), *keys).withColumn("part", F.spark_partition_id())
    cut = materialise(cut.select(c, "node_id", "parent_id", "part", (F.col("n_descendants") + 1).alias("size"), *[k.alias(f"k{i}") for i, k in enumerate(keys)]), "siblings")
    own = Window.partitionBy(c, "parent_id", "part").orderBy("k0", "k1", "k2").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(c, "parent_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = cut.where("parent_id IS NOT NULL").groupBy(c, "parent_id", "part").agg(F.sum("size").alias("total")).withColumn("ahead", F.coalesce(F.sum("total").over(before), F.lit(0))).drop("total")
    here = cut.withColumn("mine", F.coalesce(F.sum("size").over(own), F.lit(0))).join(whole, [c, "parent_id", "part"], "left")
    steps = here.select(c, "node_id", "parent_id", F.when(F.col("parent_id").isNull(), F.lit(0)).otherwise(F.col("mine") + F.col("ahead") + 1).cast("long").alias("x"))
    return path_sums(steps).select(c, "node_id", F.col("x").cast("int").alias("position"))


def conversations(messages: DataFrame, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """The kept conversations: (conversation_id, position, node_id, role, content, create_time), one row per node with a message.

    position counts the conversation's nodes from 0, each node before those
    below it. Repeated deliveries come out once; where they differ, the
    smallest by role, content and time.
    """
    found, large = _verdicts(messages, local_rows)
    kept = materialise(found.where(F.col("verdict") == KEPT), "kept")
    ordered = kept.select("conversation_id", F.posexplode("node_ids").alias("position", "node_id"))
    if large is not None:
        ordered = ordered.select("conversation_id", "node_id", "position").unionByName(in_order(materialise(large, "large-kept")))
    placed = place_orphans(messages.select("conversation_id", "node_id", "parent", "children", "file_path", "role", "content", "create_time"))
    once = placed.where("node_id IS NOT NULL AND role IS NOT NULL").groupBy("conversation_id", "node_id").agg(F.min(F.struct("role", "content", "create_time")).alias("m"))
    rows = once.join(ordered, ["conversation_id", "node_id"])
    return rows.select("conversation_id", "position", "node_id", speaker(F.col("m.role")).alias("role"), "m.content", "m.create_time")

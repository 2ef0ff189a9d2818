import datetime

from siftwright.llm import conversations as C

SCHEMA = "conversation_id string, node_id string, parent string, children array<string>, role string, content string, create_time double, file_path string, loaded_at timestamp, extra string"
T0 = datetime.datetime(2025, 1, 1)


def chain(c, *turns, root=True):
    rows = [(c, f"{c}0", None, [f"{c}1"], None, None, None, "f", T0, "")] if root else []
    for i, (role, text) in enumerate(turns, 1):
        rows.append((c, f"{c}{i}", f"{c}{i - 1}", [f"{c}{i + 1}"] if i < len(turns) else [], role, text, 100.0 - i, "f", T0 + datetime.timedelta(days=i), ""))
    return rows


ROWS = (
    chain("good", ("human", "q"), ("Bot", "a"), ("tool", "{}"), ("USER ", "q2"), ("assistant", "a2"))
    + chain("mute", ("user", "\u200b "), ("assistant", ""))
    + chain("open", ("user", "q"), ("assistant", "a"), ("user", "q2"))
    + chain("lost", ("user", "q"), ("assistant", "a"), root=False)
    + [("twin", "x", None, [], None, None, None, "f", T0, ""), ("twin", "y", None, [], "user", "q", None, "f", T0, "")]
    + [("ring", "r", None, ["s"], None, None, None, "f", T0, ""), ("ring", "a", "b", [], "user", "q", 0.0, "f", T0, ""), ("ring", "b", "a", [], "assistant", "a", 0.0, "f", T0, "")]
    + [(None, "late", "good2", [], "assistant", "aside", 1.0, "f", T0, ""), (None, "stray", "nowhere", [], "user", "q", 1.0, "f", T0, "")]
)
WANT = {"good": "kept", "mute": "empty", "open": "unanswered", "lost": "broken: missing parent", "twin": "broken: not one root", "ring": "broken: cycle"}


def table(spark):
    return spark.createDataFrame(ROWS + ROWS[:4], SCHEMA)


def test_verdicts_small_and_large(spark):
    want = dict(WANT, lost="broken: not one root")
    for limit in (C.LOCAL_ROWS, 1):
        got = {r.conversation_id: r.verdict for r in C.verdicts(table(spark), local_rows=limit).collect()}
        # a node whose parent is missing is no root, so the conversation has none
        assert {k: v.split(":")[0] for k, v in got.items()} == {k: v.split(":")[0] for k, v in want.items()}


def test_order_roles_and_orphans(spark):
    got = C.conversations(table(spark)).orderBy("position").collect()
    assert [(r.node_id, r.role) for r in got] == [("good1", "user"), ("good2", "assistant"), ("good3", "tool"), ("good4", "user"), ("good5", "assistant"), ("late", "assistant")]
    assert C.verdicts(spark.createDataFrame([], SCHEMA)).count() == 0


def test_stream_buffers_late_rows_and_times_out(spark, tmp_path):
    """No announced counts: a conversation stays open over micro-batches until the watermark has passed it."""
    from pyspark.sql import functions as F

    events = C.message_events(table(spark)).where("conversation_id IN ('good', 'open')")
    digests = events.select("conversation_id", C.digest(F.lit(None)).alias("digest"), "event_time")
    src = str(tmp_path / "in")
    digests.where("event_time < '2025-01-03'").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(C.EVENTS).parquet(src)
    query = lambda: C.rebuild(stream, "1 day", 86400).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    query().awaitTermination()
    assert spark.read.schema(C.VERDICTS).parquet(str(tmp_path / "out")).count() == 0
    digests.where("event_time >= '2025-01-03'").coalesce(1).write.mode("append").parquet(src)
    later = spark.createDataFrame([("far", '{"f0":"z"}', datetime.datetime(2025, 3, 1))], C.EVENTS)
    later.write.mode("append").parquet(src)
    query().awaitTermination()
    got = {r.conversation_id: r.verdict for r in spark.read.schema(C.VERDICTS).parquet(str(tmp_path / "out")).collect()}
    assert got == {"good": "kept", "open": "unanswered"}


def test_replay_in_several_micro_batches_loses_no_row(spark):
    """Load times spread over a year, in no order of the files, and one without: each conversation gets its verdict."""
    rows = []
    for i in range(48):
        at = T0 + datetime.timedelta(days=8 * i) if i else None
        rows += [(*r[:8], at, r[9]) for r in chain(f"c{i}", ("user", "q"), ("assistant", "a"))]
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "6")  # six files, a micro-batch each
        got = {r.conversation_id: r.verdict for r in C.verdicts(spark.createDataFrame(rows, SCHEMA), max_bytes=1).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {f"c{i}": "kept" for i in range(48)}


def test_order_of_large_conversations(spark):
    """Joins give the same order as the state, with branches, children lists in another order, and many siblings."""
    import random

    rng, rows = random.Random(5), []
    for c in ("a", "b"):
        up = {f"{c}{k}": f"{c}{rng.randrange(max(0, k - 6), k)}" if k % 9 else f"{c}0" for k in range(1, 80)}
        for k in range(80):
            kids = [x for x, p in up.items() if p == f"{c}{k}" and rng.random() < 0.6]
            rng.shuffle(kids)
            role = "assistant" if k % 3 == 0 or f"{c}{k}" not in up.values() else "user"
            rows.append((c, f"{c}{k}", up.get(f"{c}{k}"), kids, role, "t", float(rng.randrange(5)), "f", T0, ""))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    small, large = ({(r.node_id, r.position) for r in C.conversations(df, local_rows=n).collect()} for n in (C.LOCAL_ROWS, 3))
    assert len(small) == 160 and small == large


def test_repeated_rows_do_not_close_early_nor_reopen(spark, tmp_path):
    events = C.message_events(spark.createDataFrame(chain("good", ("user", "q"), ("assistant", "a")), SCHEMA))
    from pyspark.sql import functions as F

    rows = events.select("conversation_id", C.digest(F.lit(3)).alias("digest"), F.lit(T0).alias("event_time")).collect()
    src, out, log = (str(tmp_path / x) for x in ("in", "out", "log"))
    parts = [[rows[0], rows[0], rows[0]], rows, rows[:2]]  # the first file repeats a row as often as rows are announced
    for i, part in enumerate(parts):
        spark.createDataFrame(part, C.EVENTS).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(C.EVENTS).parquet(src)
        C.rebuild(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
        assert [r.verdict for r in spark.read.schema(C.VERDICTS).parquet(out).collect()] == ["kept"][: i]  # noqa: E203

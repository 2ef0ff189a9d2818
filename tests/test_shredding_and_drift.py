import json

from siftwright.operators import drift, shredding

EXPORT = "record_id long, file_path string, raw string, title string"
ITEM = "record_id long, series string, file_seq int, file_path string, key string, value string"
RAW = "series string, file_seq int, file_path string, line_no int, raw string, source string"


def test_parts_of_exports_and_items(spark):
    def message(content):
        return {"author": {"role": "user"}, "content": content, "create_time": 1.5}

    conversation = {
        "id": "c1",
        "title": "t",
        "mapping": {
            "root": {"id": "root", "parent": None, "children": ["a"], "message": None},
            "a": {"id": "a", "parent": "root", "message": message({"content_type": "text", "parts": ["x", "", None, {"text": ""}, {"text": "y"}, {"asset_pointer": "f"}, {}]})},
            "b": {"parent": "a", "message": message("plain")},
            "c": {"id": "c", "parent": "a", "message": message({"content_type": "text", "parts": ['{"id": 1}']})},
        },
    }
    encoded = {**conversation, "mapping": json.dumps(conversation["mapping"])}
    raws = [json.dumps([conversation]), json.dumps(json.dumps({"data": {"conversations": [encoded]}})), json.dumps(conversation)[:-9], "", None]
    exports = spark.createDataFrame([(i, "f", r, "clash") for i, r in enumerate(raws)] + [(0, "f", raws[0], "clash")], EXPORT)
    value = {"threads": {"w": {"items": [{"id": "m1", "role": "user", "body": "hi", "replies": [{"id": "m2", "content": [{"type": "text", "text": "q"}, {"type": "text", "text": ""}]}]}, {"id": "m3", "content": ""}]}}}
    items = spark.createDataFrame([(9, "s", 1, "f", "aiService.x", json.dumps(value)), (8, "s", 1, "f", "other", json.dumps(value)), (7, "s", 1, "f", "aiService.y", None)], ITEM)
    got = {tuple(r) for r in shredding.found_parts(exports, items).collect()}
    per_conversation = {("a", 0), ("a", 4), ("a", 5), ("b", 0), ("c", 0)}
    assert got == {("conversation_exports", r, *p) for r in (0, 1) for p in per_conversation} | {("item_table", 9, "m1", 0), ("item_table", 9, "m2", 0)}
    messages = {r.node_id: r.parent_message_id for r in shredding.entity_tables(exports, items)["messages"].collect()}
    assert messages == {"m1": None, "m2": "m1", "m3": None}
    nodes = {(r.record_id, r.node_id, r.parent_id) for r in shredding.entity_tables(exports, items)["nodes"].collect()}
    assert {(0, "root", None), (0, "a", "root"), (0, "b", "a"), (0, "c", "a")} <= nodes


def test_empty_tables(spark):
    exports, items, raw = (spark.createDataFrame([], s) for s in (EXPORT, ITEM, RAW))
    assert shredding.found_parts(exports, items).count() == 0
    assert drift.changes(raw, items).count() == 0
    assert drift.settled(raw, items).count() == 0


def test_changes(spark):
    def lines(seq, *records):
        return [("s", seq, f"f{seq}", i, r if isinstance(r, str) else json.dumps(r), "clash") for i, r in enumerate(records)]

    rows = (
        lines(1, {"role": "user", "timestamp": 1700000000, "content": "a", "lang": None})
        + lines(2, {"role": {"name": "Human"}, "timestamp": "2025-01-01T00:00:00Z", "body": "b", "lang": "en"}, "{cut", "", '{"role": 1')
        + lines(2, {"role": {"name": "Human"}, "timestamp": "2025-01-01T00:00:00Z", "body": "b", "lang": "en"})
        + lines(3, {"role": {"name": "Human"}, "sent": 1700000000123, "body": [{"type": "text", "text": "c"}, {"type": "text", "text": "d"}]})
        + [("s", 4, "f4", 1, None, "clash"), (None, 1, "g", 1, "{}", "clash"), ("s", None, "g", 1, "{}", "clash")]
    )
    raw, items = spark.createDataFrame(rows, RAW), spark.createDataFrame([], ITEM)
    got = {tuple(r) for r in drift.changes(raw, items).collect()}
    assert got == {
        ("f2", "role", "retyped"), ("f2", "timestamp", "retyped"), ("f2", "body", "renamed"), ("f2", "lang", "added"),
        ("f3", "lang", "removed"), ("f3", "sent", "renamed"), ("f3", "sent", "retyped"), ("f3", "body", "retyped"),
        ("f4", "role", "removed"), ("f4", "sent", "removed"), ("f4", "body", "removed"),
    }
    table = drift.settled(raw, items).where("series = 's' and file_seq < 4").orderBy("file_seq").collect()
    assert [(r.role, r.content, r.time.isoformat()) for r in table] == [("user", "a", "2023-11-14T22:13:20"), ("user", "b", "2025-01-01T00:00:00"), ("user", "c\nd", "2023-11-14T22:13:20.123000")]


def _raw(spark, *files):
    rows = [("s", n, f"f{n}", i, json.dumps(r), "clash") for n, records in enumerate(files, 1) for i, r in enumerate(records)]
    return spark.createDataFrame(rows, RAW), spark.createDataFrame([], ITEM)


def test_main_type_is_that_of_most_values(spark):
    """Eight strings of different outlines outweigh three numbers of one."""
    raw, items = _raw(spark, [{"x": "a"}], [{"x": "a-" * k} for k in range(8)] + [{"x": 5}] * 3)
    assert drift.changes(raw, items).count() == 0


def test_unknown_fields_are_matched_by_whole_values(spark):
    """Outlines that differ after the first forty characters differ; values count exactly, however many there are."""
    long = ["w" * 50 + "-" + str(k) for k in range(300)]
    raw, items = _raw(
        spark,
        [{"p": v, "q": "z" * 45 + "=" + chr(97 + k % 26) * (k + 1)} for k, v in enumerate(long)],
        [{"pp": v.replace("-", "+") if k >= 150 else v, "qq": "z" * 45 + "/" + str(k)} for k, v in enumerate(long)],
    )
    assert {tuple(r) for r in drift.changes(raw, items).collect()} == {("f2", "pp", "renamed"), ("f2", "q", "removed"), ("f2", "qq", "added")}


def test_settled_table_loses_no_member(spark):
    raw, items = _raw(spark, [{"role": "user", "sender": "bot", "weird": {"a": 1}, "tokens": "many", "rating": 3, "message": {"role": "human", "odd": [1]}, "message.odd": 2}])
    (row,) = drift.settled(raw, items).collect()
    assert (row.role, row.rating, row.tokens) == ("user", 3, None)
    assert row.other == {"role": "user", "sender": "bot", "weird": '{"a": 1}', "tokens": "many", "message.odd": "[1]"}


def test_adjacency_is_whole(spark):
    value = {"a": {"image_url": "u"}, "list": [[1, None], {"dims": {"w": 1}}], "s": "x"}
    part = {"id": "c", "mapping": {"n": {"id": "n", "message": {"content": {"parts": [{"image_url": "u"}, {"dims": None}]}}}}}
    exports = spark.createDataFrame([(1, "f", json.dumps(value), ""), (2, "f", json.dumps(part), "")], EXPORT)
    items = spark.createDataFrame([], ITEM)
    adj = shredding.entity_tables(exports, items)["adjacency"]
    assert adj.where("record_id = 1").count() == 11
    assert {tuple(r) for r in shredding.found_parts(exports, items).collect()} == {("conversation_exports", 2, "n", 0)}

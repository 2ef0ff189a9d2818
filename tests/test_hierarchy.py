import random

import pytest

from siftwright.operators import hierarchy as H

SCHEMA = "conversation_id string, node_id string, parent string, children array<string>, file_path string, extra string"


def brute(rows):
    by = {}
    for c, n, p, kids, *_ in rows:
        if c is not None and n is not None:
            by.setdefault(c, {}).setdefault(n, p)
    for c, nodes in by.items():
        for n in nodes:
            if nodes[n] is None:
                namers = [r[1] for r in rows if r[0] == c and r[3] and n in r[3]]
                nodes[n] = min(namers) if namers else None
    out = {}
    for c, nodes in by.items():
        for n in nodes:
            path, seen = [n], {n}
            while nodes[path[-1]] is not None and nodes[path[-1]] in nodes and nodes[path[-1]] not in seen:
                path.append(nodes[path[-1]])
                seen.add(path[-1])
            end = nodes[path[-1]]
            if end in seen:
                out[c, n] = (None, None, None, "cycle")
            else:
                out[c, n] = (path[-1], len(path) - 1, path[::-1], "ok" if end is None else "missing_parent")
    return out


def make(seed, sizes):
    rng = random.Random(seed)
    rows = []
    for i, size in enumerate(sizes):
        c = f"c{i}"
        for k in range(size):
            parent = None if k == 0 else f"n{rng.randrange(max(0, k - 4), k)}"
            if rng.random() < 0.04:
                parent = rng.choice([f"n{rng.randrange(size)}", "gone", None])
            kids = [f"n{rng.randrange(size)}"] if rng.random() < 0.05 else []
            rows.append((c, f"n{k}", parent, kids, "f", "x"))
    rows += rows[:5]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("limit", [H.LOCAL_ROWS, 30])
def test_matches_brute_force(spark, limit):
    rows = make(3, [1, 2, 25, 160, 90])
    got = H.hierarchy(spark.createDataFrame(rows, SCHEMA), local_rows=limit).collect()
    want = brute(rows)
    assert {(r.conversation_id, r.node_id): (r.root_id, r.depth, r.path, r.status) for r in got} == want
    assert len(got) == len(want)
    below = {}
    for (c, _), (_, _, path, _) in want.items():
        for a in (path or [])[:-1]:
            below[c, a] = below.get((c, a), 0) + 1
    assert {(r.conversation_id, r.node_id): r.n_descendants for r in got if r.status != "cycle"} == {k: below.get(k, 0) for k, v in want.items() if v[3] != "cycle"}


def test_deep_chain_across_buckets(spark):
    rows = [("c", str(k), str(k - 1) if k else None, [], "f", "") for k in range(500)]
    rows += [("c", "a", "b", [], "f", ""), ("c", "b", "d", [], "f", ""), ("c", "d", "a", [], "f", ""), ("c", "below", "a", [], "f", "")]
    got = {r.node_id: r for r in H.hierarchy(spark.createDataFrame(rows, SCHEMA), local_rows=10).collect()}
    assert got["499"].depth == 499 and got["499"].root_id == "0" and len(got["499"].path) == 500
    assert got["0"].n_descendants == 499
    assert {n for n, r in got.items() if r.status == "cycle"} == {"a", "b", "d", "below"}


def test_nulls_and_empty(spark):
    rows = [(None, "a", None, None, None, None), ("c", None, None, None, None, None), ("c", "x", None, [None, "y"], None, None), ("c", "y", None, None, None, None)]
    got = {r.node_id: r.depth for r in H.hierarchy(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {"x": 0, "y": 1}
    assert H.hierarchy(spark.createDataFrame([], SCHEMA)).count() == 0


def test_descendants(spark):
    rows = [("c", "a", None, [], "f", ""), ("c", "b", "a", [], "f", ""), ("c", "d", "b", [], "f", "")]
    got = {tuple(r) for r in H.descendants(H.hierarchy(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert got == {("c", "a", "b", 1), ("c", "a", "d", 2), ("c", "b", "d", 1)}


def test_orphans_follow_their_parents(spark):
    rows = [
        ("c1", "r", None, ["k", "byname"], "f1", ""),
        ("c2", "r", None, [], "f2", ""),
        (None, "k", "r", [], "f1", ""),
        (None, "kk", "k", [], "f1", ""),
        (None, "k2", "r", [], "f2", ""),
        (None, "byname", None, [], "f1", ""),
        (None, "lost", "nowhere", [], "f1", ""),
    ]
    got = {r.node_id: r.conversation_id for r in H.place_orphans(spark.createDataFrame(rows, SCHEMA)).collect() if r.node_id != "r"}
    assert got == {"k": "c1", "kk": "c1", "k2": "c2", "byname": "c1", "lost": None}


def test_long_chains_of_orphans(spark):
    """Chains of any length, orphans named by orphans, cycles of orphans, the same short id in another file."""
    rows = [("c1", "0", None, [], "f1", ""), ("c0", "0", None, [], "f2", "")]
    rows += [(None, str(k), str(k - 1), [], "f1", "") for k in range(1, 150)]
    rows += [(None, "x", "149", ["y"], "f1", ""), (None, "y", None, ["z"], "f1", ""), (None, "z", None, None, "f1", "")]
    rows += [(None, "p", "q", [], "f1", ""), (None, "q", "p", [], "f1", ""), (None, "s", "s", [], None, "")]
    got = {r.node_id: r.conversation_id for r in H.place_orphans(spark.createDataFrame(rows * 2, SCHEMA)).collect() if r.node_id != "0"}
    assert {n for n, c in got.items() if c == "c1"} == {*map(str, range(1, 150)), "x", "y", "z"}
    assert {n for n, c in got.items() if c is None} == {"p", "q", "s"}

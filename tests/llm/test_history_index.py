import random

import numpy as np

from siftwright.llm import history_index as H

SCHEMA = "id long, scan_id string, detector_id string, file_path string, turn_idx long, excerpt string, text string"
WORDS = "amber basin cedar delta ember fjord grove hazel inlet jetty knoll larch maple nectar ochre pylon quill ridge saddle thicket umber vessel willow yarrow".split()
PATHS = ["/home/u1/.a/p-q/{}.jsonl", "file:///home/u1/.a/p%2Dq/{}.jsonl", "~/.a/p-q/{}.jsonl", "/HOME/U1/.A/P-Q/{}.JSONL", "C:\\Users\\u1\\.a\\p-q\\{}.jsonl", "/mnt/backup/home/u1/.a/p-q/{}.jsonl.gz", "/home/./u1/.a//p-q/{}.jsonl ", "/home/u1/.a/tmp/../p-q/{}.jsonl.bak"]
DETECTORS = ["card_number", "card-number", "CardNumber", "CARD_NUMBER", "card.number@2", "card_number.v2", "regex:card_number"]


def make(n, seed, hot):
    rng = random.Random(seed)
    rows, truth, seen = [], set(), []
    for i in range(n):
        scan = f"s{i // 20}"
        old = [s for s in seen if s[1] != scan]
        if old and rng.random() < 0.3:
            first, _, f, turn, words = rng.choice(old)
            w = list(words)
            if rng.random() < 0.5:
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            turn += rng.randrange(0, 3)
            truth.add((first, i))
        else:
            f, turn, w = rng.randrange(1 if hot else 30), rng.randrange(40), rng.choices(WORDS, k=10)
            seen.append((i, scan, f, turn, tuple(w)))
        text = " ".join(w[:5]) + rng.choice([": ", "=", " "]) + f"[FP:{rng.randrange(16**8):08x}] " + " ".join(w[5:])
        rows.append((i, scan, rng.choice(DETECTORS), rng.choice(PATHS).format(f), turn, text, "clash"))
    return rows, truth


def test_replay(spark, monkeypatch):
    for hot, chunk in ((False, 20_000), (True, 60)):
        monkeypatch.setattr(H, "CHUNK_ROWS", chunk)
        rows, truth = make(600, 4, hot)
        dirty = [(None, "s", "d", "f", 1, "x", ""), (9001, "s", None, "f", 1, "x", ""), (9002, "s", "d", "f", 1, None, "")] + rows[:3]
        got = {(r.id_a, r.id_b) for r in H.replay(spark.createDataFrame(rows + dirty, SCHEMA)).collect()}
        assert len(truth & got) >= 0.97 * len(truth) and len(got - truth) <= 0.02 * len(truth)
    assert H.replay(spark.createDataFrame([], SCHEMA)).count() == 0


def test_index_by_batches(spark):
    rows, truth = make(200, 5, False)
    index = H.HistoryIndex(spark)
    got = set()
    for k in range(0, 200, 50):
        batch = spark.createDataFrame([(i, f"b{i // 50}", *r) for i, _, *r in rows[k : k + 50]], SCHEMA)
        fresh, repeats = index.add(batch)
        got |= {(r.id_a, r.id_b) for r in repeats.collect()}
        assert fresh.count() == 50 - repeats.count()
    across = {(a, b) for a, b in truth if a // 50 != b // 50}
    assert len(across & got) >= 0.9 * len(across) and len(index.shards) <= 3  # log2 of the batches, and the last


def test_graph_recall_against_brute_force():
    rng = random.Random(6)
    texts = [" ".join(rng.choices(WORDS, k=10)) for _ in range(3000)]
    for i in range(300):
        w = texts[i].split()
        w[rng.randrange(10)] = rng.choice(WORDS)
        texts[1000 + i] = " ".join(w)
    x = H.embed(texts)
    graph = H.SmallWorld(x, np.zeros(len(x), int))
    assert graph.tune() >= 0.95
    q = np.arange(0, 3000, 20)
    ids, _ = graph.search(x[q], np.zeros(len(q), int), np.full(len(q), 3000), graph.beam)
    exact = np.argsort(-(x[q] @ x.T), axis=1, kind="stable")[:, :2]
    assert np.mean([e in set(r) for r, es in zip(ids, exact, strict=True) for e in es]) >= 0.9


def test_hot_window_with_more_neighbours_than_the_beam(spark):
    """Sightings of another user, nearer than the one that is repeated, fill the whole beam."""
    words = WORDS[:10]
    row = lambda i, scan, user, w: (i, scan, "card_number", f"/home/{user}/.a/p-q/1.jsonl", 3, " ".join(w[:5]) + ": [FP:00000000] " + " ".join(w[5:]), "")
    rows = [row(0, "s0", "u1", [*words[:8], "yarrow", "willow"])]
    rows += [row(i, f"s{i}", "u2", [*words[:9], f"{words[9]}{chr(97 + i % 26)}{chr(97 + i // 26)}"]) for i in range(1, 400)]
    rows.append(row(400, "s400", "u1", words))
    got = {(r.id_a, r.id_b) for r in H.replay(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (0, 400) in got
    assert got == {(0, 400)} | {(1, i) for i in range(2, 400)}


def _sighting(i, scan, words, turn=3, file=1):
    return (i, scan, "card_number", f"/home/u1/.a/p-q/{file}.jsonl", turn, " ".join(words[:5]) + ": [FP:00000000] " + " ".join(words[5:]), "")


def test_hot_sighting_reported_again_and_again(spark):
    """3,000 lightly edited repeats of one sighting, each naming the first; in one load or in three."""
    words = WORDS[:10]
    rows = [_sighting(0, "s0", words)] + [_sighting(i, f"s{i}", [*words[: i % 10], f"{words[i % 10]}{chr(97 + i % 26)}{i}", *words[i % 10 + 1 :]]) for i in range(1, 3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    for loads in ((), (0.1, 0.5)):
        got = {(r.id_a, r.id_b) for r in H.replay(df, loads).collect()}
        assert len(got & {(0, i) for i in range(1, 3000)}) >= 0.98 * 2999 and len(got) <= 2999


def test_equals_exhaustive_comparison_however_it_is_loaded(spark):
    """The rule, row by row: a repeat names the first accepted row it is like; a row like repeats only is accepted."""
    rows, _ = make(400, 11, True)
    df = spark.createDataFrame(rows, SCHEMA)
    prepared = sorted(H.prepare(df).collect())
    scan, accepted, want = {r[0]: r[1] for r in rows}, [], set()
    for b in prepared:
        like = [a.id for a in accepted if a.key == b.key and (None in (a.user, b.user) or a.user == b.user) and abs(a.turn_idx - b.turn_idx) <= H.SHIFT and H.similar(a.text, b.text) >= H.LIKE and float(np.dot(*H.embed([a.text, b.text]))) > H.FLOOR]
        if not like:
            accepted.append(b)
        elif scan[like[0]] != scan[b.id]:
            want.add((like[0], b.id))
    for loads in ((), (0.3, 0.6)):
        assert {(r.id_a, r.id_b) for r in H.replay(df, loads).collect()} == want


def test_a_batch_reads_only_the_routes_it_touches(spark):
    """Ten times the history, elsewhere: the points that a batch meets stay the same, and recall is written out."""
    batch = H.routed(H.prepare(spark.createDataFrame([_sighting(90_000, "new", WORDS[:10])], SCHEMA))).drop("key")
    met = []
    for n in (50, 500):
        index = H.HistoryIndex(spark)
        index.add(spark.createDataFrame([_sighting(i, "old", WORDS[2:12], file=i % n) for i in range(4 * n)], SCHEMA))
        met.append(sum(index.touched(batch, s)[1].count() for s in index.shards))
        assert all(r.recall >= H.TARGET for r in index.recalls().collect())
    assert met[0] == met[1] == 1

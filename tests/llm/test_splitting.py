import random

from siftwright.llm.splitting import cohesion, depths, split_text, split_turns, units

SCHEMA = "file_path string, turn_idx long, content string, byte_start long, byte_end long, source string, extra string"


def check(text, limit, overlap):
    data, pieces = text.encode(), split_text(text, limit, overlap)
    joined = b""
    for i, (a, b, lap) in enumerate(pieces):
        assert b - a <= limit and b > a
        data[a:b].decode()  # cuts lie between characters
        assert lap <= overlap and (lap == 0) == (i == 0 or overlap == 0) or lap < b - a
        assert a + lap == (pieces[i - 1][1] if i else 0)
        joined += data[a + lap : b]
    assert joined == data
    return pieces


def test_pieces_join_to_the_text():
    rng = random.Random(1)
    alphabet = ["a", "word ", "é", "漢字", "。", ". ", "\n", "\n\n", "👩‍🔬", " ", "x" * 300, "3.14 "]
    for limit, overlap in ((64, 16), (256, 32), (4096, 256), (100, 0)):
        for _ in range(25):
            check("".join(rng.choices(alphabet, k=400)), limit, overlap)
    assert split_text("", 10, 2) == [(0, 0, 0)]
    check("y" * 50_000, 4096, 256)


def test_cut_lies_at_the_change_of_topic():
    a = "The pastry dough rests in the cold oven tray. " * 30
    b = "The compiler links every module of the kernel. " * 30
    pieces = check(a + b, 1800, 100)
    assert any(abs(end - len(a)) < 60 for _, end, _ in pieces)


def test_units_and_valleys():
    assert [u for u, _ in units("One. Two 3.5!\nFour", 100)] == ["One. ", "Two 3.5!", "\n", "Four"]
    assert depths([0.9, 0.1, 0.8])[1] > 1.4 and cohesion([]) == []


def test_turns(spark):
    long = "Sentence one is here. " * 400
    rows = [("f", 1, long, 10, 10 + len(long), "cursor", ""), ("f", 1, long, 10, 10 + len(long), "cursor", ""), ("f", 2, "short", 0, 5, "cursor", ""), ("f", 3, None, None, None, None, None), ("f", 4, "", 0, 0, "cursor", ""), ("g", 1, long, 0, 2 * len(long), "claude_code", "")]
    got = split_turns(spark.createDataFrame(rows, SCHEMA)).orderBy("file_path", "piece_no").collect()
    assert {(r.file_path, r.turn_idx) for r in got} == {("f", 1), ("g", 1)}
    f = [r for r in got if r.file_path == "f"]
    assert [r.piece_no for r in f] == list(range(f[0].n_pieces)) and all(r.file_start == r.byte_start + 10 for r in f)
    assert all(r.file_start is None for r in got if r.file_path == "g")
    assert split_turns(spark.createDataFrame([], SCHEMA)).count() == 0

import random

import numpy as np
from tokenizers import Tokenizer

from siftwright.llm import packing, tokenization

SCHEMA = "doc_id long, text string, ids string"
TEXTS = ["Hello  world's\n\n  end", "", None, "<|endoftext|> is text", "漢字とかな 👩‍🔬", "  ", "the the the", "\u200b\xa0x\t \t", "a" * 5000]


def test_ids_and_round_trip(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(6, TEXTS[6], "again"), (None, "no id", "")]
    encoded = tokenization.encode_corpus(spark.createDataFrame(rows, SCHEMA)).cache()
    got = {r.doc_id: list(r.ids) for r in encoded.collect()}
    assert encoded.count() == len(TEXTS) + 1
    reference = Tokenizer.from_file(f"{tokenization.TOKENIZERS}/byte_bpe_50k.json")
    reference.encode_special_tokens = True
    for i, t in enumerate(TEXTS):
        assert got[i] == (reference.encode(t, add_special_tokens=False).ids if t else [])
    back = {r.doc_id: r.text for r in tokenization.decode_corpus(encoded).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)} | {None: "no id"}
    sizes = {r.doc_id: r.n_tokens for r in tokenization.token_counts(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sizes == {k: len(v) for k, v in got.items()}
    assert tokenization.encode_corpus(spark.createDataFrame([], SCHEMA)).count() == 0


def test_plan_uses_every_item_once():
    rng = random.Random(2)
    for capacity in (10, 64, 300):
        h = np.zeros(capacity + 1, int)
        for _ in range(2000):
            h[rng.randrange(1, capacity + 1)] += 1
        plan = packing.plan(h, capacity)
        used = np.zeros_like(h)
        for count, parts in plan:
            assert sum(parts) <= capacity and count > 0
            for p in parts:
                used[p] += count
        assert (used == h).all()
        fill = (np.arange(capacity + 1) * h).sum() / (capacity * sum(c for c, _ in plan))
        assert fill > 0.9


def test_pack(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([0, 3, 3, 3, 5, 9, 40, 41, 100, 235])) for i in range(600)] + [(601, None)]
    got = packing.pack(spark.createDataFrame(rows + rows[:9], "doc_id long, n_tokens long"), capacity=100).collect()
    fill, total, pieces = {}, {}, {}
    for r in got:
        fill[r.container_id] = fill.get(r.container_id, 0) + r.n_tokens
        total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
        pieces.setdefault(r.doc_id, []).append((r.first_token, r.n_tokens))
    sizes = {d: n or 0 for d, n in rows}
    assert max(fill.values()) <= 100 and total == sizes
    assert all(len(p) == max(1, -(-sizes[d] // 100)) for d, p in pieces.items())
    assert sum(fill.values()) / (100 * len(fill)) > 0.95
    assert packing.pack(spark.createDataFrame([], "doc_id long, n_tokens long")).count() == 0

"""Filling containers of fixed capacity with items of varying length.

Items are counted by length. Combinations of up to three lengths that fill a
container to within a window are enumerated; how often each is repeated is the
non-negative least-squares fit of the combinations to the histogram; the
counts are rounded down and what is left is packed greedily. Only the
histogram (at most `capacity` numbers) comes to the driver. Items then find
their containers by their rank among the items of their length.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwright.session import materialise

CAPACITY, WINDOW = 2048, 4  # tokens a container takes; room that an enumerated combination may leave
BUCKETS = 256  # ranks are counted per length and bucket, so that a frequent length is no single group


def combinations(lengths: np.ndarray, capacity: int, window: int) -> np.ndarray:
    """Rows of three lengths (0 for none), not increasing, whose sum lies within window of the capacity."""
    lengths = np.sort(np.unique(lengths))[::-1]
    out = []
    full = lengths[lengths > capacity - window - 1]
    out.append(np.column_stack([full, np.zeros_like(full), np.zeros_like(full)]))
    present = np.zeros(capacity + 1, bool)
    present[lengths] = True
    for gap in range(window + 1):
        target = capacity - gap
        for a in lengths:
            if a >= target:
                continue
            rest = target - a
            if rest <= a and present[rest]:
                out.append(np.array([[a, rest, 0]]))
            b = lengths[(lengths <= a) & (lengths < rest)]
            c = rest - b
            fits = (c <= b) & (c > 0)
            b, c = b[fits], c[fits]
            fits = present[c]
            b, c = b[fits], c[fits]
            if len(b):
                out.append(np.column_stack([np.full(len(b), a), b, c]))
    return np.concatenate(out).astype(np.int64) if out else np.zeros((0, 3), np.int64)


def repeat_counts(combos: np.ndarray, histogram: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Non-negative least squares min |A x - h| by accelerated projected gradient; A is never built."""
    if not len(combos):
        return np.zeros(0)
    h = histogram.astype(float)
    h[0] = 0.0
    weight = np.arange(len(h)) / len(h) + 0.05  # a long item left over costs more than a short one

    def forward(x):
        y = np.zeros(len(h))
        for k in range(3):
            y += np.bincount(combos[:, k], x, len(h))
        y[0] = 0.0
        return y * weight

    def back(r):
        r = r * weight
        r[0] = 0.0
        return r[combos[:, 0]] + r[combos[:, 1]] + r[combos[:, 2]]

    v = np.random.default_rng(0).random(len(combos))
    for _ in range(20):
        v = back(forward(v))
        size = np.linalg.norm(v)
        v /= size
    step = 1.0 / (1.05 * size)
    x = np.zeros(len(combos))
    z, t = x, 1.0
    for _ in range(rounds):
        new = np.maximum(0, z - step * back(forward(z) - h * weight))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x


def greedy(histogram: np.ndarray, capacity: int) -> list[tuple[int, list[int]]]:
    """Best fit over counts, longest items first: (how many containers, their lengths)."""
    room: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)
    done = []
    for length in range(capacity, 0, -1):
        n = int(histogram[length])
        for space in sorted(s for s in room if s >= length):
            while n and room[space]:
                count, held = room[space].pop()
                each = space // length
                use = min(count, -(-n // each))
                if use < count:
                    room[space].append((count - use, held))
                whole, rest = divmod(n, each)
                whole = min(whole, use)
                if whole:
                    (room[space - each * length] if space > each * length else done).append((whole, held + [length] * each))
                    n -= whole * each
                if use > whole and n:
                    k = min(rest, n)
                    room[space - k * length].append((1, held + [length] * k))
                    n -= k
            if not room[space]:
                del room[space]
            if not n:
                break
        if n:
            each = capacity // length
            whole, rest = divmod(n, each)
            if whole:
                (room[capacity - each * length] if capacity > each * length else done).append((whole, [length] * each))
            if rest:
                room[capacity - rest * length].append((1, [length] * rest))
    return done + [x for xs in room.values() for x in xs]


def plan(histogram: np.ndarray, capacity: int, window: int = 0) -> list[tuple[int, list[int]]]:
    """(how many containers, the lengths in each) using every item of the histogram exactly once."""
    histogram = histogram.astype(np.int64).copy()
    combos = combinations(np.nonzero(histogram)[0], capacity, window)
    counts = np.floor(repeat_counts(combos, histogram) + 1e-6).astype(np.int64)
    out, left = [], histogram.copy()
    for i in np.argsort(-counts, kind="stable"):
        if counts[i] <= 0:
            break
        parts = [int(x) for x in combos[i] if x]
        need = {p: parts.count(p) for p in parts}
        times = min(int(counts[i]), *(int(left[p]) // k for p, k in need.items()))
        if times > 0:
            for p, k in need.items():
                left[p] -= times * k
            out.append((times, parts))
    return out + greedy(left, capacity)


def slots(strategies: list[tuple[int, list[int]]], capacity: int) -> tuple[dict, int]:
    """length -> (first rank, first container, items of the length per container) in rank order; number of containers."""
    table, used, base = defaultdict(list), defaultdict(int), 0
    for count, parts in strategies:
        for length in sorted(set(parts)):
            k = parts.count(length)
            table[length].append((used[length], base, k))
            used[length] += count * k
        base += count
    return {n: tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) for n, rows in table.items()}, base


def pack(sizes: DataFrame, capacity: int = CAPACITY, window: int = WINDOW) -> DataFrame:
    """Assign items to containers: (doc_id, piece_no, first_token, n_tokens, container_id).

    sizes: doc_id, n_tokens. An item larger than the capacity is cut into full
    pieces and a rest; no other item is divided. Items of size 0 (or null) take
    no room and are spread over the containers. Repeated rows of a doc_id with
    the same size are one item. An empty table gives an empty table.
    """
    c = F.lit(capacity)
    n = F.coalesce(F.col("n_tokens"), F.lit(0)).cast("long")
    items = sizes.select("doc_id", n.alias("size")).distinct()
    pieces = items.select("doc_id", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("size") / c) - 1, F.lit(0)).cast("long"))).alias("piece_no"))
    pieces = pieces.select("doc_id", F.col("piece_no").cast("int").alias("piece_no"), (F.col("piece_no") * c).alias("first_token"), F.least(c, F.col("size") - F.col("piece_no") * c).cast("int").alias("n_tokens"))
    pieces = materialise(pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(BUCKETS)).cast("int")), "pieces")
    counts = materialise(pieces.groupBy("n_tokens", "bucket").agg(F.count("*").alias("n")), "lengths")
    histogram = np.zeros(capacity + 1, np.int64)
    for length, k in counts.groupBy("n_tokens").agg(F.sum("n")).collect():  # at most capacity + 1 rows
        histogram[length] = k
    table, containers = slots(plan(histogram, capacity, window), capacity)
    before = Window.partitionBy("n_tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("n_tokens", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    ranked = pieces.withColumn("r", F.row_number().over(Window.partitionBy("n_tokens", "bucket").orderBy("doc_id", "piece_no")) - 1)
    ranked = ranked.join(offsets, ["n_tokens", "bucket"]).select("doc_id", "piece_no", "first_token", "n_tokens", (F.col("r") + F.col("offset")).alias("rank"))

    def place(batches):
        for pdf in batches:
            where = np.zeros(len(pdf), np.int64)
            length, rank = pdf["n_tokens"].to_numpy(), pdf["rank"].to_numpy()
            for n in np.unique(length):
                at = length == n
                if n == 0:
                    where[at] = rank[at] % max(containers, 1)
                    continue
                first, base, each = table[int(n)]
                i = np.searchsorted(first, rank[at], "right") - 1
                where[at] = base[i] + (rank[at] - first[i]) // each[i]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "piece_no": pdf["piece_no"], "first_token": pdf["first_token"], "n_tokens": length, "container_id": where})

    return ranked.mapInPandas(place, "doc_id long, piece_no int, first_token long, n_tokens int, container_id long")

"""Cutting oversized items at natural boundaries, by lexical cohesion.

A text is read as units (sentences and lines). The vocabularies of the blocks
of units on both sides of each gap are compared; a gap where the similarity
lies deep below the peaks around it is a topic boundary. Within each size
window the cut goes to the deepest valley, and the next piece begins a little
earlier, so that consecutive pieces overlap.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP, BLOCK = 4096, 256, 6
EXACT_SOURCES = ("chat_gpt", "cursor", "gemini_cli")  # byte ranges of these are the content's own bytes

_UNIT = regex.compile(r"(?:[^\n.!?。！？]++|[.!?]++(?!\s|$))*+(?:[.!?]++(?=\s|$)[^\S\n]*+|[。！？]++|\n++|$)", regex.V1)
_WORD = regex.compile(r"[\p{Han}\p{Katakana}\p{Hiragana}]{2}|\p{L}{3,}|\d+")
_SOFT = regex.compile(r"\s+|(?<=[,;:、，)}\]])")


def units(text: str, most: int) -> list[tuple[str, int]]:
    """(unit, bytes) that join to the text; a unit longer than `most` bytes is cut at white space, else between grapheme clusters."""
    out = []
    for m in _UNIT.finditer(text):
        unit = m.group()
        if not unit:
            continue
        size = len(unit.encode())
        if size <= most:
            out.append((unit, size))
            continue
        piece, held = [], 0
        for word in _pieces(unit, most):
            n = len(word.encode())
            if held + n > most and piece:
                out.append(("".join(piece), held))
                piece, held = [], 0
            piece.append(word)
            held += n
        if piece:
            out.append(("".join(piece), held))
    return out


def _pieces(unit: str, most: int):
    last = 0
    for m in _SOFT.finditer(unit):
        if m.end() > last:
            yield from _clusters(unit[last : m.end()], most)
            last = m.end()
    if last < len(unit):
        yield from _clusters(unit[last:], most)


def _clusters(word: str, most: int):
    if len(word.encode()) <= most:
        yield word
        return
    for m in regex.finditer(r"\X", word):
        cluster = m.group()
        if len(cluster.encode()) <= most:
            yield cluster
        else:
            yield from cluster  # a cluster longer than a piece: between its characters


def cohesion(bags: list[Counter], block: int = BLOCK) -> list[float]:
    """Cosine of the blocks before and after each gap; gap i lies before unit i + 1."""
    n = len(bags)
    left, right = Counter(), Counter()
    for b in bags[1 : block + 1]:
        right.update(b)
    left.update(bags[0]) if n else None
    out = []
    for i in range(n - 1):
        small, large = (left, right) if len(left) < len(right) else (right, left)
        dot = sum(v * large[w] for w, v in small.items() if w in large)
        norm = sum(v * v for v in left.values()) * sum(v * v for v in right.values())
        out.append(dot / norm**0.5 if norm else 0.0)
        if i + 1 < n - 1:
            _move(left, bags[i + 1], bags[i + 1 - block] if i + 1 >= block else None)
            _move(right, bags[i + 1 + block] if i + 1 + block < n else None, bags[i + 1])
    return out


def _move(bag: Counter, add: Counter | None, drop: Counter | None) -> None:
    if add:
        bag.update(add)
    if drop:
        for w, v in drop.items():
            bag[w] -= v
            if bag[w] <= 0:
                del bag[w]


def depths(similarity: list[float]) -> list[float]:
    """How far each gap lies below the nearest peaks on both sides."""
    n = len(similarity)
    left, right = [0.0] * n, [0.0] * n
    for i in range(1, n):
        left[i] = max(similarity[i - 1], left[i - 1]) if similarity[i - 1] >= similarity[i] else 0.0
        if similarity[i - 1] > similarity[i] and similarity[i - 1] < left[i - 1]:
            left[i] = left[i - 1]
    for i in range(n - 2, -1, -1):
        right[i] = max(similarity[i + 1], right[i + 1]) if similarity[i + 1] >= similarity[i] else 0.0
    return [max(0.0, left[i] - s) + max(0.0, right[i] - s) for i, s in enumerate(similarity)]


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start, end, overlap) in bytes of each piece; the pieces without their overlaps join to the text."""
    if len(text.encode()) <= limit:
        return [(0, len(text.encode()), 0)]
    parts = units(text, max(4, min(limit // 4, limit - overlap)))
    ends, at = [], 0
    for _, n in parts:
        at += n
        ends.append(at)
    valley = depths(cohesion([Counter(w.lower() for w in _WORD.findall(u)) for u, _ in parts]))
    # an end of a line, and a blank line more so, is a better place than the middle of a paragraph
    score = [v + (0.15 if parts[i][0].endswith("\n") else 0.0) + (0.15 if parts[i][0].endswith("\n\n") else 0.0) for i, v in enumerate(valley)]
    out, first, begin, lap = [], 0, 0, 0
    while True:
        start = begin - lap
        if at - start <= limit:
            out.append((start, at, lap))
            return out
        last = first
        while last + 1 < len(ends) and ends[last + 1] - start <= limit:
            last += 1
        window = [i for i in range(first, last + 1) if ends[i] - start >= limit // 2] or [last]
        best = max(window, key=lambda i: (score[i], i))
        out.append((start, ends[best], lap))
        begin, first = ends[best], best + 1
        lap, k = 0, best
        while k >= 0 and lap + parts[k][1] <= overlap and ends[k] - parts[k][1] > start:
            lap += parts[k][1]
            k -= 1
        if not lap and overlap:  # the last unit is longer than the overlap: take its end
            lap = _tail(parts[best][0], overlap)


def _tail(unit: str, overlap: int) -> int:
    """Bytes of the longest end of the unit within the overlap, from a word's start where there is one."""
    data = unit.encode()[-overlap:]
    while data and data[0] & 0xC0 == 0x80:
        data = data[1:]
    text = data.decode()
    m = _SOFT.search(text)
    if m and m.end() < len(text) and len(data) < len(unit.encode()):
        text = text[m.end() :]
    return len(text.encode())


def split_turns(turns: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Ordered pieces of at most `limit` UTF-8 bytes of each longer content.

    turns: file_path, turn_idx, content, byte_start, byte_end, source (others
    are ignored). Columns: file_path, turn_idx, piece_no, n_pieces, text,
    byte_start and byte_end within content, overlap_bytes shared with the piece
    before, file_start and file_end. The place in the file is given where the
    turn's range is exactly its content's bytes, else null (a raw line's
    escapes move the content's bytes). Contents within the limit, null and
    empty ones give no pieces; repeated rows count once.
    """
    size = F.octet_length("content")
    sound = F.col("source").isin(*EXACT_SOURCES) & (F.col("byte_end") - F.col("byte_start") == size) & (F.col("byte_start") >= 0)
    large = turns.where(size > limit).select("file_path", "turn_idx", "content", F.when(sound, F.col("byte_start")).alias("base"))
    large = large.groupBy("file_path", "turn_idx", "content").agg(F.min("base").alias("base"))
    schema = "file_path string, turn_idx long, piece_no int, n_pieces int, text string, byte_start long, byte_end long, overlap_bytes int, file_start long, file_end long"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for pdf in batches:
            out, held = [], 0
            for path, idx, content, base in zip(*(pdf[c] for c in ("file_path", "turn_idx", "content", "base")), strict=True):
                data, cuts = content.encode(), split_text(content, limit, overlap)
                offset = None if pd.isna(base) else int(base)
                for k, (a, b, lap) in enumerate(cuts):
                    out.append((path, idx, k, len(cuts), data[a:b].decode(), a, b, lap, None if offset is None else offset + a, None if offset is None else offset + b))
                held += len(data)
                if held > 8_000_000:
                    yield _frame(out, names)
                    out, held = [], 0
            if out:
                yield _frame(out, names)

    return large.mapInPandas(run, schema)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names).astype({"turn_idx": "Int64", "file_start": "Int64", "file_end": "Int64"})

"""Deduplicating new batches against all history with navigable small-world graphs.

History is held in shards, one per batch. A sighting can only repeat one of
the same detector and file, so the settled spellings of both, with a window of
turns, route a row to its cell of a shard; a cell holds a graph over its rows,
which links every sighting to its nearest ones by the text around it. A batch
is looked up, in the cells its rows route to, with a beam search, and what the
beam brings is reranked exactly. The beam was widened, when the shard was
made, until its recall against exhaustive search sufficed. Only accepted rows
are indexed, in a shard of their own; shards of like size are merged on a
schedule, so that there are few.
"""

from __future__ import annotations

from dataclasses import dataclass
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwright.session import discard, fresh_path, materialise

DIM, LINKS, EARLY, LANDMARKS = 64, 24, 8, 32
SEGMENT_ROWS, CHUNK_ROWS = 20_000, 20_000
BEAMS, TARGET, TUNING_QUERIES = (32, 64, 128, 256), 0.98, 300
LIKE, SHIFT = 0.75, 6  # least similarity of the texts around; how far a turn may have moved
FLOOR = 0.5  # cosine above which what the beam brings is reranked
CLOSE = 0.55  # cosine above which a neighbour may be the same sighting; the beam must not miss these
WINDOW = 32  # turns in a route; a row near a window's edge is also looked up in the next one


def settled_detector(name: Column) -> Column:
    """A detector's id in snake case, without the kind before a colon and the version after it."""
    bare = F.regexp_replace(F.regexp_replace(name, r"^\w+:", ""), r"(@\d+|[._]v\d+)$", "")
    return F.regexp_replace(F.lower(F.regexp_replace(bare, r"(?<=[a-z0-9])(?=[A-Z])", "_")), r"[-.\s]+", "_")


def settled_path(path: Column) -> tuple[Column, Column]:
    """(user, path below the user's folder) of a file however it was written, mounted, copied or archived."""
    p = F.trim(path)
    p = F.when(p.startswith("file:"), F.coalesce(F.try_url_decode(F.regexp_replace(p, r"\+", "%2B")), p)).otherwise(p)
    p = F.lower(F.regexp_replace(F.regexp_replace(p, r"^file:/*", "/"), r"\\", "/"))
    p = F.regexp_replace(p, r"/(\./)+", "/")
    p = F.regexp_replace(p, r"/[^/]+/\.\./", "/")
    p = F.regexp_replace(p, r"/{2,}", "/")
    p = F.regexp_replace(p, r"(\.(bak|old|orig|gz|bz2|xz|zst|zip|\d{1,2})|~)+$", "")
    inside = F.regexp_extract(p, r"(?:^|/)(?:home|users)/([^/]+)/(.+)$", 2)
    user = F.regexp_extract(p, r"(?:^|/)(?:home|users)/([^/]+)/(.+)$", 1)
    rest = F.regexp_replace(p, r"^(~|/mnt/[^/]+|/archive|/private|/backup)+/", "/")
    return F.nullif(user, F.lit("")), F.regexp_replace(F.when(inside != "", inside).otherwise(rest), "^/+", "")


def settled_excerpt(excerpt: Column) -> Column:
    """The words around the finding, lower case, ` | ` where the finding stood."""
    words = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))
    cut = F.split(excerpt, r"\[FP:[0-9a-fA-F]*\]", 2)
    return F.concat(words(cut[0]), F.lit(" | "), words(F.coalesce(F.get(cut, F.lit(1)), F.lit(""))))


def embed(texts: list[str]) -> np.ndarray:
    """Unit vectors of hashed character trigrams."""
    data = [(" " + t + " ").encode() for t in texts]
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    b = np.frombuffer(b"".join(data), np.uint8).astype(np.uint64)
    row = np.repeat(np.arange(len(data)), sizes)
    out = np.zeros((len(data), DIM), np.float32)
    if len(b) >= 3:
        code = (b[:-2] << np.uint64(16)) | (b[1:-1] << np.uint64(8)) | b[2:]
        inside = row[:-2] == row[2:]
        h = (code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
        where = row[:-2] * DIM + (h % np.uint64(DIM)).astype(np.int64)
        sign = np.where((h >> np.uint64(16)) & np.uint64(1), 1.0, -1.0)
        out = np.bincount(where[inside], sign[inside], len(data) * DIM).reshape(-1, DIM).astype(np.float32)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


class SmallWorld:
    """A navigable small-world graph over one segment. Points are grouped by route and arrive in order within it."""

    def __init__(self, x: np.ndarray, route: np.ndarray, stored: list | None = None):
        """route must be sorted; stored are the links of a shard's rows within their route (None where all know each other), else the graph is built by insertion."""
        self.x, n = x, len(x)
        self.start = np.r_[0, np.flatnonzero(np.diff(route)) + 1] if n else np.zeros(0, np.int64)
        self.size = np.diff(np.r_[self.start, n])
        self.group = np.repeat(np.arange(len(self.start)), self.size)
        self.rank = np.arange(n) - self.start[self.group] if n else np.zeros(0, np.int64)
        self.routes = route[self.start] if n else route
        self.beam, self.recall = BEAMS[0], 1.0
        self.links = np.full((n, LINKS), -1, np.int32)
        if n:
            self._acquaint()
            if stored is None:
                self._build()
            else:
                for i, own in enumerate(stored):
                    if own is not None:
                        own = np.asarray(own, np.int32)
                        self.links[i] = np.where(own >= 0, own + self.start[self.group[i]], -1)

    def stored_links(self) -> list:
        """The links within each row's route; None where they follow from the route's size."""
        large = self.size[self.group] > LINKS + 1 if len(self.x) else np.zeros(0, bool)
        return [np.where(row >= 0, row - self.start[g], -1).astype(np.int32).tolist() if big else None for row, g, big in zip(self.links, self.group, large, strict=True)]

    def _acquaint(self) -> None:
        """The first points of a route all know each other."""
        seed = LINKS + 1
        first = np.flatnonzero(self.rank < seed)
        other = np.arange(LINKS)[None, :] + (np.arange(LINKS)[None, :] >= self.rank[first, None])
        have = np.minimum(self.size[self.group[first]], seed)[:, None]
        self.links[first] = np.where(other < have, self.start[self.group[first], None] + other, -1)

    def _build(self) -> None:
        done, largest = LINKS + 1, int(self.size.max())
        while done < largest:
            upto = int(done * 1.3) + 1
            new = np.flatnonzero((self.rank >= done) & (self.rank < upto))
            ids, sims = self.search(self.x[new], self.group[new], np.full(len(new), done), BEAMS[0])
            half = ids[:, : LINKS // 2]
            self.links[new, : half.shape[1]] = half
            self._link_back(np.repeat(new, half.shape[1]), half.ravel(), sims[:, : half.shape[1]].ravel())
            done = upto

    def _link_back(self, new: np.ndarray, old: np.ndarray, sim: np.ndarray) -> None:
        """Link old points to new ones; beyond the early links a point keeps its nearest."""
        ok = old >= 0
        new, old, sim = new[ok], old[ok], sim[ok]
        order = np.lexsort((-sim, old))
        new, old = new[order], old[order]
        begin = np.r_[0, np.flatnonzero(np.diff(old)) + 1] if len(old) else np.zeros(0, np.int64)
        nth = np.arange(len(old)) - np.repeat(begin, np.diff(np.r_[begin, len(old)]))
        keep = nth < LINKS
        new, old, nth = new[keep], old[keep], nth[keep]
        who = old[nth == 0]
        at = np.cumsum(nth == 0) - 1
        cand = np.full((len(who), 2 * LINKS), -1, np.int32)
        cand[:, :LINKS] = self.links[who]
        cand[at, LINKS + nth] = new
        s = np.einsum("qd,qmd->qm", self.x[who], self.x[cand])
        s[cand < 0] = -np.inf
        s[:, :EARLY] = np.where(cand[:, :EARLY] >= 0, np.inf, -np.inf)
        best = np.argsort(-s, axis=1, kind="stable")[:, :LINKS]
        self.links[who] = np.take_along_axis(cand, best, 1)

    def search(self, q: np.ndarray, group: np.ndarray, known: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(points, similarities) nearest to each query among the first `known` points of its group; -1 where there are fewer.

        The beam starts at landmarks of the route: all points where there are few.
        """
        n = len(q)
        known = np.minimum(known, self.size[group])
        start = self.start[group]
        ids = np.full((n, beam), -1, np.int64)
        sims = np.full((n, beam), -np.inf, np.float32)
        k = min(LANDMARKS, beam)
        nth = np.arange(k)[None, :]
        marks = np.where(known[:, None] <= k, nth, nth * known[:, None] // k)
        entry = np.where(nth < known[:, None], start[:, None] + marks, -1)
        ids[:, :k] = entry
        s = np.einsum("qd,qmd->qm", q, self.x[ids[:, :k]])
        sims[:, :k] = np.where(entry >= 0, s, -np.inf)
        fresh = ids >= 0
        live = np.flatnonzero(known > 0)
        while len(live):
            reached = (ids[live] >= 0).sum(1)
            live = live[(reached < known[live]) & fresh[live].any(1)]
            if not len(live):
                break
            open_sims = np.where(fresh[live], sims[live], -np.inf)
            pick = open_sims.argmax(1)
            best = open_sims[np.arange(len(live)), pick]
            going = (best >= sims[live].min(1)) | (ids[live] < 0).any(1)
            live, pick = live[going], pick[going]
            if not len(live):
                break
            fresh[live, pick] = False
            near = self.links[ids[live, pick]].astype(np.int64)
            ok = (near >= 0) & (near - start[live, None] < known[live, None])
            ok &= ~(near[:, :, None] == ids[live][:, None, :]).any(2)
            s = np.einsum("qd,qmd->qm", q[live], self.x[near])
            # only what betters the beam enters it: what was put out, ties too, never comes back, so the walk ends
            ok &= s > sims[live].min(1, keepdims=True)
            s[~ok] = -np.inf
            all_ids = np.concatenate([ids[live], np.where(ok, near, -1)], 1)
            all_sims = np.concatenate([sims[live], s], 1)
            all_fresh = np.concatenate([fresh[live], ok], 1)
            top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            ids[live] = np.take_along_axis(all_ids, top, 1)
            sims[live] = np.take_along_axis(all_sims, top, 1)
            fresh[live] = np.take_along_axis(all_fresh, top, 1)
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def tune(self) -> float:
        """Widen the beam until it finds the close neighbours that exhaustive search finds; the recall reached.

        At most TUNING_QUERIES queries, spread over all routes that are larger
        than the links of a point. Those whose whole beam is above FLOOR are
        left out: they are compared exhaustively anyway (see _matches).
        """
        inside = np.flatnonzero(self.size[self.group] > LINKS + 1) if len(self.start) else np.zeros(0, np.int64)
        self.recall = 1.0
        if not len(inside):
            return self.recall
        at = inside[np.linspace(0, len(inside) - 1, min(len(inside), TUNING_QUERIES)).astype(np.int64)]
        group = self.group[at]
        close = np.array([(self.x[self.start[g] : self.start[g] + self.size[g]] @ self.x[i] >= CLOSE).sum() for i, g in zip(at, group, strict=True)])
        for self.beam in BEAMS:
            _, sims = self.search(self.x[at], group, self.size[group], self.beam)
            left = sims[:, -1] <= FLOOR
            self.recall = float(np.minimum((sims >= CLOSE).sum(1), close)[left].sum() / max(1, close[left].sum())) if close[left].any() else 1.0
            if self.recall >= TARGET:
                break
        return self.recall


def similar(a: str, b: str) -> float:
    """Share of matching characters of two settled excerpts."""
    m = SequenceMatcher(None, a, b, autojunk=False)
    return m.ratio() if m.quick_ratio() >= LIKE else 0.0


def prepare(findings: DataFrame) -> DataFrame:
    """(id, scan_id, route, user, turn_idx, text) of a table of findings; the settled keys of P4.

    A null detector, file, turn or excerpt makes no sighting comparable, so
    such rows are never duplicates and are left out here; rows that repeat an
    id count once.
    """
    user, path = settled_path(F.col("file_path"))
    rows = findings.where("id IS NOT NULL AND detector_id IS NOT NULL AND file_path IS NOT NULL AND turn_idx IS NOT NULL AND excerpt IS NOT NULL")
    return rows.select("id", "scan_id", F.xxhash64(settled_detector(F.col("detector_id")), path).alias("key"), user.alias("user"), "turn_idx", settled_excerpt(F.col("excerpt")).alias("text"))


def routed(rows: DataFrame) -> DataFrame:
    """Prepared rows with the routes they belong to: one they are held in, and the neighbours they are only looked up in."""
    window = F.floor(F.col("turn_idx") / WINDOW)
    beside = F.array_distinct(F.array(window, F.floor((F.col("turn_idx") - SHIFT) / WINDOW), F.floor((F.col("turn_idx") + SHIFT) / WINDOW)))
    spread = rows.withColumn("at", F.explode(beside))
    return spread.select(*rows.columns, F.xxhash64("key", "at").alias("route"), (F.col("at") == window).alias("held"))


def _codes(users: np.ndarray, seen: dict) -> np.ndarray:
    return np.array([-1 if u is None or u != u else seen.setdefault(u, len(seen)) for u in users], np.int64)


def _matches(graph: SmallWorld, base: pd.DataFrame, queries: pd.DataFrame, x: np.ndarray) -> list[tuple]:
    """(id_b, id_a) of queries and the first of the indexed sightings before them that they repeat, after exact reranking.

    base is sorted by route and id, so a query sees the points before its own
    id. A query whose whole beam is above FLOOR may have more such neighbours
    than places, and others than it may repeat can hold them; it is compared
    with all it sees of its route, as is every query where the graph's recall
    is too low.
    """
    if not len(base) or not len(queries):
        return []
    route, q_id, q_turn, q_text = (queries[c].to_numpy() for c in ("route", "id", "turn_idx", "text"))
    b_id, b_turn, b_text = (base[c].to_numpy() for c in ("id", "turn_idx", "text"))
    seen: dict = {}
    q_user, b_user = _codes(queries["user"].to_numpy(), seen), _codes(base["user"].to_numpy(), seen)
    group = np.minimum(np.searchsorted(graph.routes, route), len(graph.routes) - 1)
    hit = np.flatnonzero(graph.routes[group] == route)
    known = np.zeros(len(queries), np.int64)
    for i in hit:
        lo = graph.start[group[i]]
        known[i] = np.searchsorted(b_id[lo : lo + graph.size[group[i]]], q_id[i])
    hit = hit[known[hit] > 0]

    def may(a, b):
        users = (q_user[b] < 0) | (b_user[a] < 0) | (q_user[b] == b_user[a])
        return users & (np.abs(b_turn[a] - q_turn[b]) <= SHIFT)

    out = []
    for part in np.array_split(hit, max(1, -(-len(hit) // 20_000))):
        if not len(part):
            continue
        ids, sims = graph.search(x[part], group[part], known[part], graph.beam)
        full = (known[part] > graph.beam) & ((sims[:, -1] > FLOOR) | (graph.recall < TARGET))
        near = (ids >= 0) & (sims > FLOOR) & ~full[:, None] & may(np.maximum(ids, 0), part[:, None])
        i, j = np.nonzero(near)
        b, a = part[i], ids[i, j]
        order = np.lexsort((b_id[a], b))
        done = -1
        for b, a in zip(b[order], a[order], strict=True):
            if b != done and (q_text[b] == b_text[a] or similar(q_text[b], b_text[a]) >= LIKE):
                out.append((int(q_id[b]), int(b_id[a])))
                done = b
        for b in part[full]:
            own = np.arange(graph.start[group[b]], graph.start[group[b]] + known[b])
            own = own[may(own, b)]
            for a in own[graph.x[own] @ x[b] > FLOOR]:
                if q_text[b] == b_text[a] or similar(q_text[b], b_text[a]) >= LIKE:
                    out.append((int(q_id[b]), int(b_id[a])))
                    break
    return out


LINK = "id_b long, id_a long"
POINT = "cell long, id long, route long, user string, turn_idx long, text string, vector binary, links array<int>, beam int, recall double"
COLUMNS = ["id", "route", "user", "turn_idx", "text"]
FEW_CELLS = 1000  # a batch that touches at most so many cells of a shard names them in its read


@dataclass
class Shard:
    """Where a shard lies, its rows and segments, and its hot routes (route, lo, hi, chunks), if any."""

    path: str
    rows: int
    segments: int
    hot: DataFrame | None


def _layout(rows: DataFrame) -> tuple[int, int, DataFrame | None]:
    """(rows, segments, hot routes): a segment is the cell of many routes; a route of more than CHUNK_ROWS rows has cells of its own, by age."""
    n = rows.count()
    routes = rows.groupBy("route").agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi")).where(F.col("n") > CHUNK_ROWS)
    hot = None
    if n > CHUNK_ROWS and routes.head(1):  # at most rows / CHUNK_ROWS of them
        hot = materialise(routes.select("route", "lo", "hi", F.ceil(F.col("n") / CHUNK_ROWS).cast("long").alias("chunks")), "hot-routes")
    return n, max(1, -(-n // SEGMENT_ROWS)), hot


def _in_cells(rows: DataFrame, segments: int, hot: DataFrame | None, held: bool) -> DataFrame:
    """rows with the cell they are held in, or (not held) with each cell that can hold something before them."""
    cell = F.pmod("route", F.lit(segments)).cast("long")
    if hot is None:
        return rows.withColumn("cell", cell)
    own = F.floor((F.col("id") - F.col("lo")) * F.col("chunks") / (F.col("hi") - F.col("lo") + 1)).cast("long")
    own = F.greatest(F.lit(0).cast("long"), F.least(F.col("chunks") - 1, own))
    cut = rows.join(hot, "route").withColumn("chunk", own if held else F.explode(F.sequence(F.lit(0).cast("long"), own)))
    cut = cut.withColumn("cell", F.xxhash64("route", "chunk"))
    return rows.join(hot, "route", "left_anti").withColumn("cell", cell).unionByName(cut.select(*rows.columns, "cell"))


def _sorted(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.sort_values(["route", "id"], kind="stable").reset_index(drop=True)


def _vectors(pdf: pd.DataFrame) -> np.ndarray:
    """The stored vectors; those of small routes, and of new rows, are made from the texts."""
    stored = pdf["vector"].tolist() if "vector" in pdf else [None] * len(pdf)
    x = np.zeros((len(pdf), DIM), np.float32)
    have = np.array([v is not None for v in stored], bool)
    if have.any():
        x[have] = np.frombuffer(b"".join(v for v in stored if v is not None), np.float16).reshape(-1, DIM)
    if not have.all():
        x[~have] = embed(pdf["text"][~have].tolist()).astype(np.float16)
    return x


def _graph_of(base: pd.DataFrame) -> SmallWorld:
    """The graph of a shard's cell, or of whole routes of it, as stored."""
    graph = SmallWorld(_vectors(base), base["route"].to_numpy(), base["links"].tolist())
    graph.beam, graph.recall = int(base["beam"].max()), float(base["recall"].min())
    return graph


class HistoryIndex:
    """Shards of accepted sightings in the shared folder: one per batch, merged on a schedule.

    A row of a batch is a repeat if it is the same sighting as an accepted row
    of a smaller id, in an earlier batch or in its own, and the first of these
    is the one it repeats; other rows are accepted and indexed. The history is
    read only in the cells, and of these in the routes, that the batch routes
    to. Before a batch, shards are merged while the last is at least half as
    large as the one before it, so n batches leave some log2(n) shards and a
    row is rewritten as often.
    """

    def __init__(self, spark, path: str | None = None):
        self.spark = spark
        self.path = path or fresh_path(spark, "history")
        self.shards: list[Shard] = []
        self.made = 0

    def _write(self, rows: DataFrame) -> Shard:
        """Build a shard's graphs, one per cell, tune them, and store points with links, beam and recall, and with vectors in routes of more than LINKS + 1 rows (at most so many others are made anew where a batch touches a route)."""
        n, segments, hot = _layout(rows)

        def build(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = _sorted(pdf)
            x = _vectors(pdf)
            graph = SmallWorld(x, pdf["route"].to_numpy())
            graph.tune()
            large = graph.size[graph.group] > LINKS + 1
            pdf["vector"] = [v.tobytes() if big else None for v, big in zip(x.astype(np.float16), large, strict=True)]
            pdf["links"], pdf["beam"], pdf["recall"] = graph.stored_links(), graph.beam, graph.recall
            return pdf[[c.split()[0] for c in POINT.split(", ")]]

        path = f"{self.path}/shard-{self.made:06d}"
        self.made += 1
        _in_cells(rows, segments, hot, held=True).groupBy("cell").applyInPandas(build, POINT).write.parquet(path)
        return Shard(path, n, segments, hot)

    def read(self, shard: Shard) -> DataFrame:
        return self.spark.read.schema(POINT).parquet(shard.path)

    def recalls(self) -> DataFrame:
        """(path, cell, rows, beam, recall) of every cell: the beam it is searched with and the part of close neighbours that beam finds.

        Cells below TARGET are searched exhaustively.
        """
        out = self.spark.createDataFrame([], "path string, cell long, rows long, beam int, recall double")
        for s in self.shards:
            out = out.unionByName(self.read(s).groupBy("cell").agg(F.count("*").alias("rows"), F.max("beam").alias("beam"), F.min("recall").alias("recall")).withColumn("path", F.lit(s.path)))
        return out

    def touched(self, batch: DataFrame, shard: Shard) -> tuple[DataFrame, DataFrame]:
        """(routed rows of the batch, points of the shard) that can meet, with their cells."""
        asked = _in_cells(batch, shard.segments, shard.hot, held=False)
        points = self.read(shard)
        if shard.segments > FEW_CELLS:
            cells = [r.cell for r in asked.select("cell").distinct().limit(FEW_CELLS + 1).collect()]
            if len(cells) <= FEW_CELLS:
                points = points.where(F.col("cell").isin(cells))
        return asked, points.join(batch.select("route").distinct(), "route", "left_semi")

    def lookup(self, batch: DataFrame) -> DataFrame:
        """(id_b, id_a): the first sighting in any shard that a row of a routed batch repeats; each cell meets the rows that route to it."""

        def find(asked: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(asked) and len(points):
                base = _sorted(points)
                out = _matches(_graph_of(base), base, asked, embed(asked["text"].tolist()))
            return pd.DataFrame(out, columns=["id_b", "id_a"], dtype="int64")

        both = [(k, *self.touched(batch, s)) for k, s in enumerate(self.shards)]
        asked, points = (None, None)
        for k, q, p in both:
            q, p = (df.withColumn("shard", F.lit(k)) for df in (q.select("cell", *COLUMNS), p))
            asked, points = (q, p) if asked is None else (asked.unionByName(q), points.unionByName(p))
        met = asked.groupBy("shard", "cell").cogroup(points.groupBy("shard", "cell")).applyInPandas(find, LINK)
        return met.groupBy("id_b").agg(F.min("id_a").alias("id_a"))

    def _within(self, batch: DataFrame) -> DataFrame:
        """(id_b, id_a): the first row of the same batch that a row repeats."""
        held = batch.where("held")
        _, segments, hot = _layout(held)

        def find(pdf: pd.DataFrame) -> pd.DataFrame:
            base = _sorted(pdf[pdf["held"]])
            asked = pdf[~pdf["held"]]
            x = embed(base["text"].tolist())
            graph = SmallWorld(x, base["route"].to_numpy())
            graph.tune()
            alone = graph.size[graph.group] == 1
            out = [] if alone.all() else _matches(graph, base, base[~alone], x[~alone])
            if len(asked) and len(base):
                out += _matches(graph, base, asked, embed(asked["text"].tolist()))
            return pd.DataFrame(out, columns=["id_b", "id_a"], dtype="int64")

        # a held row is asked in its own chunk as a point of it, and in the chunks before
        own = _in_cells(held, segments, hot, held=True)
        asked = _in_cells(batch if hot is not None else batch.where("NOT held"), segments, hot, held=False).withColumn("held", F.lit(False))
        met = own.unionByName(asked.select(*own.columns)).groupBy("cell").applyInPandas(find, LINK)
        return met.groupBy("id_b").agg(F.min("id_a").alias("id_a"))

    def load(self, rows: DataFrame) -> DataFrame:
        """(id_b, id_a) of prepared rows (id, key, user, turn_idx, text), each id once; the others are accepted and indexed."""
        self.compact()
        batch = whole = materialise(routed(rows).drop("key"), "batch")
        found = None
        if self.shards:
            found = materialise(self.lookup(batch), "repeats")
            batch = batch.join(found.select(F.col("id_b").alias("id")), "id", "left_anti")
        own = materialise(self._within(batch), "within")
        linked = own.select(F.col("id_b").alias("id"))
        accepted = materialise(batch.where("held").select(*COLUMNS).join(linked, "id", "left_anti"), "accepted")
        self.shards.append(self._write(accepted))
        discard(accepted, whole)
        # a row is a repeat if the first row it is like was accepted; else it is looked up again, among what was
        up = own.select(F.col("id_b").alias("id_a"))
        repeats = own.join(up, "id_a", "left_anti").select("id_b", "id_a")
        repeats = repeats if found is None else repeats.unionByName(found.select("id_b", "id_a"))
        doubtful = materialise(own.join(up, "id_a", "left_semi").select(F.col("id_b").alias("id")), "doubtful")
        if doubtful.head(1):
            repeats = repeats.unionByName(self.load(rows.join(doubtful, "id", "left_semi")))
        return repeats

    def add(self, findings: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(accepted rows of a batch, repeats (id_b, id_a)). Rows without comparable keys are accepted but not indexed; a batch's ids are above those before."""
        repeats = materialise(_ingest(self, prepare(findings), [])[0], "repeats")
        return findings.join(repeats.select(F.col("id_b").alias("id")), "id", "left_anti"), repeats

    def compact(self) -> None:
        """The schedule: merge the last two shards while the later is at least half as large; vectors are kept, links made anew."""
        while len(self.shards) > 1 and 2 * self.shards[-1].rows >= self.shards[-2].rows:
            last, before = self.shards.pop(), self.shards.pop()
            rows = self.read(before).unionByName(self.read(last)).select(*COLUMNS, "vector")
            self.shards.append(self._write(rows))
            discard(self.read(last), self.read(before))


def _ingest(index: HistoryIndex, prepared: DataFrame, bounds: list[int]) -> tuple[DataFrame, DataFrame]:
    """(repeats (id_b, id_a), materialised prepared rows) of rows loaded in order of their ids, a load up to each bound.

    Exact copies are collapsed to the first of them before, and follow it after.
    """
    exact = ["key", "user", "turn_idx", "text"]
    prepared = materialise(prepared.select("id", *exact), "prepared")
    rows = prepared.groupBy(*exact).agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    rows = materialise(rows, "sightings")
    parts, low = [], None
    for high in [*bounds, None]:
        part = rows
        part = part if low is None else part.where(F.col("id") > low)
        part = part if high is None else part.where(F.col("id") <= high)
        parts.append(index.load(part.select("id", *exact)))
        low = high
    first = parts[0]
    for p in parts[1:]:
        first = first.unionByName(p)
    first = materialise(first, "first")
    copied = rows.where("copies > 1").select("id", *exact)
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in exact]
    again = prepared.alias("a").join(copied.alias("b"), same).where("a.id <> b.id").select(F.col("a.id").alias("id_b"), F.col("b.id").alias("id_a"))
    again = again.distinct().join(first.select(F.col("id_b").alias("id_a"), F.col("id_a").alias("first")), "id_a", "left").select("id_b", F.coalesce("first", "id_a").alias("id_a"))
    return first.select("id_b", "id_a").unionByName(again), prepared


def replay(findings: DataFrame, loads: tuple[float, ...] = (0.25, 0.5)) -> DataFrame:
    """(id_a, id_b): each finding that repeats a sighting accepted in an earlier batch, with the accepted one.

    The table's batches go through a HistoryIndex in the order of their ids.
    As there are tens of thousands of them, neighbouring batches share a load
    and its shard, up to each of the given parts of the ids (see HistoryIndex:
    what comes out does not depend on how the rows are cut into batches).
    Findings that repeat one of their own batch don't come out.
    """
    ids = findings.where("id IS NOT NULL")
    bounds = sorted({int(x) for x in ids.approxQuantile("id", list(loads), 0.01)}) if loads else []
    pairs, _ = _ingest(HistoryIndex(findings.sparkSession), prepare(findings), bounds)
    batch = ids.select("id", "scan_id").distinct()
    named = pairs.join(batch.select(F.col("id").alias("id_a"), F.col("scan_id").alias("scan_a")), "id_a").join(batch.select(F.col("id").alias("id_b"), F.col("scan_id").alias("scan_b")), "id_b")
    return named.where(~F.col("scan_a").eqNullSafe(F.col("scan_b"))).select("id_a", "id_b").distinct()

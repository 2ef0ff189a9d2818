"""Parent-child rows to full hierarchies.

Weighted disjoint-set forests: every link "child hangs below parent" unites
two sets and stores the distance to the set's root. Rows are placed by tree
(conversation), so one task sees every link of an ordinary tree and its forest
is final. A tree with more rows than ``local_rows`` is never put into one
task: it is cut into buckets, each bucket builds its own forest, and the roots
of the bucket forests are merged by doubling the links between them until
every node knows its root, or is found to hang on a cycle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwright.session import materialise

LOCAL_ROWS = 200_000
BUCKET_ROWS = 100_000  # rows of a large tree that one task holds

OK, CYCLE, LOST = "ok", "cycle", "missing_parent"

FOREST = T.StructType(
    [
        T.StructField("conversation_id", T.StringType()),
        T.StructField("node_id", T.StringType()),
        T.StructField("parent_id", T.StringType()),
        T.StructField("root_id", T.StringType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("path", T.ArrayType(T.StringType())),
        T.StructField("n_descendants", T.LongType()),
        T.StructField("status", T.StringType()),
    ]
)


class WeightedForest:
    """Disjoint sets over hashable keys; each key knows its distance to the set's root."""

    def __init__(self) -> None:
        self.up: dict = {}
        self.dist: dict = {}
        self.looped: set = set()

    def add(self, key) -> None:
        if key not in self.up:
            self.up[key] = key
            self.dist[key] = 0

    def find(self, key):
        """(root, distance), compressing the way that was walked."""
        up, dist = self.up, self.dist
        trail = []
        while up[key] != key:
            trail.append(key)
            key = up[key]
        root, total = key, 0
        for k in reversed(trail):
            total += dist[k]
            up[k], dist[k] = root, total
        return root, total

    def hang(self, child, parent) -> None:
        """Hang the set rooted at child below parent; a link into its own set is a cycle."""
        root, d = self.find(parent)
        if root == child:
            self.looped.add(child)
        else:
            self.up[child], self.dist[child] = root, d + 1


def effective_parents(rows: list[tuple]) -> dict:
    """node -> parent for one tree from (node, parent, children) rows.

    Repeated rows of a node count once, the largest parent where they differ;
    a node without a parent takes the node whose children name it (the
    smallest id where several do).
    """
    parents: dict = {}
    named: dict = {}
    for node, parent, children in rows:
        have = parents.get(node)
        parents[node] = parent if have is None or (parent is not None and parent > have) else have
        for kid in children if children is not None else ():
            if kid is not None and (kid not in named or node < named[kid]):
                named[kid] = node
    for node, parent in parents.items():
        if parent is None:
            parents[node] = named.get(node)
    return parents


def solve_tree(parents: dict, with_paths: bool = True) -> Iterator[tuple]:
    """Rows (node, parent, root, depth, path, n_descendants, status) of one whole tree.

    Roots, depths and cycles come from the forest; the paths from one walk down
    the parent index, so that only the path to the present node is held.
    """
    forest = WeightedForest()
    for node in parents:
        forest.add(node)
    lost, kids = set(), {}
    for node, parent in parents.items():
        if parent is None:
            continue
        if parent not in parents:
            lost.add(node)
        else:
            forest.hang(node, parent)
            kids.setdefault(parent, []).append(node)
    found = {node: forest.find(node) for node in parents}
    bad = forest.looped
    below = dict.fromkeys(parents, 0)
    for d, node in sorted(((d, node) for node, (root, d) in found.items() if root not in bad), reverse=True):
        if d:
            below[parents[node]] += below[node] + 1
    trail: list = []
    for top, (root, d) in found.items():
        if root in bad:
            yield top, parents[top], None, None, None, None, CYCLE
        if d or root in bad:
            continue
        status, stack = LOST if top in lost else OK, [(top, 0)]
        while stack:
            node, d = stack.pop()
            del trail[d:]
            trail.append(node)
            yield node, parents[node], top, d, list(trail) if with_paths else None, below[node], status
            stack += [(k, d + 1) for k in kids.get(node, ())]


def per_tree(batches: Iterator[pd.DataFrame], key: str = "conversation_id") -> Iterator[tuple]:
    """(key, rows) for each tree of a partition sorted by the key; at most one tree is held."""
    held, current = [], None
    for pdf in batches:
        for row in zip(*(pdf[c] for c in pdf.columns), strict=True):
            if row[0] != current:
                if held:
                    yield current, held
                held, current = [], row[0]
            held.append(row[1:])
    if held:
        yield current, held


def _forest_frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=FOREST.names).astype({"depth": "Int32", "n_descendants": "Int64"})


def _local(links: DataFrame, with_paths: bool) -> DataFrame:
    def run(batches):
        out, held = [], 0
        for conversation, rows in per_tree(batches):
            for row in solve_tree(effective_parents(rows), with_paths):
                out.append((conversation, *row))
                held += 1 + (row[3] or 0) * with_paths
                if held >= 100_000:  # path elements, not rows: deep trees make long paths
                    yield _forest_frame(out)
                    out, held = [], 0
        if out:
            yield _forest_frame(out)

    placed = links.repartition("conversation_id").sortWithinPartitions("conversation_id")
    return placed.mapInPandas(run, FOREST)


def _bucket_forest(links: DataFrame, buckets: int) -> DataFrame:
    """First merge level of a large tree: in each bucket, each node's local root and distance."""
    schema = "conversation_id string, node_id string, parent_id string, top string, hops long, looped boolean"

    def run(batches):
        rows = [r for pdf in batches for r in zip(*(pdf[c] for c in pdf.columns), strict=True)]
        forest = WeightedForest()
        for c, n, _ in rows:
            forest.add((c, n))
        for c, n, p in rows:
            if p is not None and (c, p) in forest.up:
                forest.hang((c, n), (c, p))
        out = []
        for c, n, p in rows:
            (_, top), d = forest.find((c, n))
            out.append((c, n, p, top, d, (c, top) in forest.looped))
        if out:
            yield pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")])

    return links.repartition(buckets, "conversation_id", F.xxhash64("node_id")).mapInPandas(run, schema)


def _distributed(links: DataFrame, with_paths: bool) -> DataFrame:
    """Trees too large for one task: bucket forests, then doubling over the links between their roots."""
    c = "conversation_id"
    kids = (
        links.select(c, F.explode("children").alias("kid"), F.col("node_id").alias("namer"))
        .where("kid IS NOT NULL")
        .groupBy(c, F.col("kid").alias("node_id"))
        .agg(F.min("namer").alias("namer"))
    )
    nodes = links.groupBy(c, "node_id").agg(F.max("parent").alias("parent"))
    nodes = nodes.join(kids, [c, "node_id"], "left").select(c, "node_id", F.coalesce("parent", "namer").alias("parent_id"))
    present = nodes.select(c, F.col("node_id").alias("parent_id"), F.lit(True).alias("known"))
    nodes = materialise(nodes.join(present, [c, "parent_id"], "left"), "forest-nodes")
    inside = nodes.select(c, "node_id", F.when(F.col("known"), F.col("parent_id")).alias("parent_id"))
    buckets = max(2, links.sparkSession.sparkContext.defaultParallelism, -(-nodes.count() // BUCKET_ROWS))
    local = materialise(_bucket_forest(inside, buckets), "forest-local")

    tops = local.where("node_id = top").select(c, "top", "parent_id", "looped")
    over = local.select(c, F.col("node_id").alias("parent_id"), F.col("top").alias("next"), F.col("hops").alias("far"))
    # a top of a bucket forest hangs below the top of the bucket that holds its parent;
    # `at` is where its chain has been followed to, `gone` how far that is, `end` what was found there
    state = tops.join(over, [c, "parent_id"], "left").select(
        c,
        "top",
        F.when(F.col("looped") | F.col("next").isNull(), F.col("top")).otherwise(F.col("next")).alias("at"),
        F.when(F.col("looped") | F.col("next").isNull(), F.lit(0)).otherwise(F.col("far") + 1).alias("gone"),
        F.when(F.col("looped"), F.lit("loop")).when(F.col("next").isNull(), F.lit("root")).alias("end"),
    )
    state, left = materialise(state, "forest-merge"), None
    while True:
        open_now = state.where("end IS NULL").count()
        if open_now in (0, left):  # depths have no gaps: if no chain ended in a round, the open ones are endless
            break
        left = open_now
        ahead = state.select(c, F.col("top").alias("at"), F.col("at").alias("at2"), F.col("gone").alias("gone2"), F.col("end").alias("end2"))
        walked = state.where("end IS NULL").join(ahead, [c, "at"]).select(c, "top", F.col("at2").alias("at"), (F.col("gone") + F.col("gone2")).alias("gone"), F.col("end2").alias("end"))
        state = materialise(state.where("end IS NOT NULL").unionByName(walked), "forest-merge")
    tops = state.select(c, "top", F.col("at").alias("root"), "gone", F.coalesce("end", F.lit("loop")).alias("end"))
    solved = local.join(tops, [c, "top"]).join(nodes.select(c, "node_id", "known"), [c, "node_id"])
    ok = F.col("end") == "root"
    lost = nodes.where("parent_id IS NOT NULL AND known IS NULL").select(c, F.col("node_id").alias("root"), F.lit(True).alias("lost"))
    real = nodes.select(c, "node_id", F.col("parent_id").alias("own_parent"))
    solved = solved.join(lost, [c, "root"], "left").join(real, [c, "node_id"])
    out = solved.select(
        c,
        "node_id",
        F.col("own_parent").alias("parent_id"),
        F.when(ok, F.col("root")).alias("root_id"),
        F.when(ok, (F.col("hops") + F.col("gone")).cast("int")).alias("depth"),
        F.when(~ok, F.lit(CYCLE)).when(F.col("lost"), F.lit(LOST)).otherwise(F.lit(OK)).alias("status"),
    )
    out = materialise(out, "forest-depth")
    counts = subtree_sums(out.select(c, "node_id", F.when(F.col("depth") > 0, F.col("parent_id")).alias("parent_id"), F.lit(1).cast("long").alias("x"), (F.col("status") != CYCLE).alias("fine")).where("fine"))
    out = out.join(counts.select(c, "node_id", (F.col("x") - 1).alias("n_descendants")), [c, "node_id"], "left")
    if with_paths:
        out = out.join(_paths(out), [c, "node_id"], "left")
    else:
        out = out.withColumn("path", F.lit(None).cast("array<string>"))
    return out.select(*FOREST.names)


def _doubling(nodes: DataFrame, extra: Column, fold) -> Iterator[DataFrame]:
    """Rounds of (node_id, up, value) where up is the ancestor 2^k links away."""
    state = nodes.select("conversation_id", "node_id", F.col("parent_id").alias("up"), extra.alias("x"))
    state = materialise(state, "double")
    while True:
        yield state
        if not state.where("up IS NOT NULL").head(1):
            return
        state = materialise(fold(state), "double")


def subtree_sums(nodes: DataFrame, combine=F.sum) -> DataFrame:
    """x of a node and all below it, combined; nodes(conversation_id, node_id, parent_id, x) without cycles.

    After k rounds x covers what lies less than 2^k links below, and up is the
    ancestor 2^k links above, so each round adds every node's x to its up.
    """
    c = "conversation_id"

    def fold(state):
        given = state.where("up IS NOT NULL").groupBy(c, F.col("up").alias("node_id")).agg(combine("x").alias("y"))
        ahead = state.select(c, F.col("node_id").alias("up"), F.col("up").alias("up2"))
        total = F.col("x") + F.coalesce("y", F.lit(0)) if combine is F.sum else F.greatest("x", "y")
        return state.join(given, [c, "node_id"], "left").join(ahead, [c, "up"], "left").select(c, "node_id", F.col("up2").alias("up"), total.alias("x"))

    last = None
    for state in _doubling(nodes, F.col("x"), fold):
        last = state
    return last.select(c, "node_id", "x")


def path_sums(nodes: DataFrame) -> DataFrame:
    """x of a node and all above it, summed; nodes(conversation_id, node_id, parent_id, x) without cycles."""
    c = "conversation_id"

    def fold(state):
        ahead = state.select(c, F.col("node_id").alias("up"), F.col("up").alias("up2"), F.col("x").alias("y"))
        return state.join(ahead, [c, "up"], "left").select(c, "node_id", F.col("up2").alias("up"), (F.col("x") + F.coalesce("y", F.lit(0))).alias("x"))

    last = None
    for state in _doubling(nodes, F.col("x"), fold):
        last = state
    return last.select(c, "node_id", "x")


def _paths(nodes: DataFrame) -> DataFrame:
    """Root-to-node paths by doubling: each round joins a node's piece of path to that of the ancestor above it."""
    c = "conversation_id"
    fine = nodes.where(F.col("status") != CYCLE).select(c, "node_id", F.when(F.col("depth") > 0, F.col("parent_id")).alias("parent_id"))

    def fold(state):
        ahead = state.select(c, F.col("node_id").alias("up"), F.col("up").alias("up2"), F.col("x").alias("y"))
        return state.join(ahead, [c, "up"], "left").select(c, "node_id", F.col("up2").alias("up"), F.when(F.col("y").isNull(), F.col("x")).otherwise(F.concat("y", "x")).alias("x"))

    last = None
    for state in _doubling(fine, F.array("node_id"), fold):
        last = state
    return last.select(c, "node_id", F.col("x").alias("path"))


def large_trees(links: DataFrame, local_rows: int) -> DataFrame:
    return links.groupBy("conversation_id").count().where(F.col("count") > local_rows).select("conversation_id")


def hierarchy(links: DataFrame, with_paths: bool = True, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """Full path, depth, root and number of descendants of every node; cycles marked.

    links: conversation_id, node_id, parent, children (other columns are
    ignored). One row per (conversation_id, node_id) comes out:

    * status 'ok' - the chain of parents ends in a node without parent;
    * status 'missing_parent' - it ends in a node whose parent is not in the
      conversation; that node counts as the root;
    * status 'cycle' - it never ends (nodes on a cycle and all below one);
      root, depth, path and n_descendants are null.

    Rows with a null conversation_id or node_id belong to no tree and give no
    row; repeated rows count once (of several parents, the largest). An empty
    table gives an empty table.
    """
    rows = links.select("conversation_id", "node_id", "parent", "children").where("conversation_id IS NOT NULL AND node_id IS NOT NULL")
    big = large_trees(rows, local_rows)
    if not big.head(1):
        return _local(rows, with_paths)
    big = materialise(big, "large-trees")
    small = _local(rows.join(big, "conversation_id", "left_anti"), with_paths)
    return small.unionByName(_distributed(rows.join(big, "conversation_id", "left_semi"), with_paths))


def descendants(forest: DataFrame) -> DataFrame:
    """All pairs (ancestor_id, node_id, distance) of a hierarchy with paths; the root row of each path included once per ancestor."""
    walked = forest.where("path IS NOT NULL").select("conversation_id", "node_id", "depth", F.posexplode("path").alias("level", "ancestor_id"))
    return walked.where("level < depth").select("conversation_id", "ancestor_id", "node_id", (F.col("depth") - F.col("level")).alias("distance"))


def place_orphans(messages: DataFrame) -> DataFrame:
    """Give rows without a conversation_id the one their parent belongs to.

    The parent is `parent` or, where null, the node whose children name the
    row. It is looked for in the row's own file first, then anywhere, each
    time among the rows that have a conversation, then among the other
    orphans; of several the smallest is taken. Both sides of every join hold
    one row a key. Chains of orphans of any length are followed by doubling.
    Rows whose parent cannot be found, and orphans on a cycle of orphans, keep
    a null conversation_id.
    """
    c, cols = "conversation_id", ["node_id", "parent", "file_path"]
    key = F.to_json(F.struct(*cols))
    lone = messages.where(F.col(c).isNull() & F.col("node_id").isNotNull()).select(*cols, "children", key.alias("orphan"))
    if not lone.head(1):
        return messages
    known = messages.where(F.col(c).isNotNull())
    named = lone.select("orphan", "file_path", F.explode("children").alias("seek"), F.lit("name").alias("how"))
    lone = materialise(lone.select("orphan", *cols).distinct(), "orphans")
    how = F.when(F.col("parent").isNull(), "name").otherwise("parent")
    wanted = lone.select("orphan", "file_path", how.alias("how"), F.coalesce("parent", "node_id").alias("seek"))
    sought = wanted.select("how", "seek").distinct()
    holds = lambda df, who: df.select(F.lit("parent").alias("how"), F.col("node_id").alias("seek"), "file_path", F.col(who).alias("holder"))
    kids = known.where(F.size("children") > 0).select(F.lit("name").alias("how"), F.explode("children").alias("seek"), "file_path", F.col(c).alias("holder"))
    # the names are few next to the rows, so each side of the union is cut down before it is grouped
    homes = holds(known, c).join(sought, ["how", "seek"], "left_semi").unionByName(kids.join(sought, ["how", "seek"], "left_semi"))
    homes = materialise(homes.groupBy("how", "seek", "file_path").agg(F.min("holder").alias("holder")), "homes")
    others = holds(lone, "orphan").unionByName(named.select("how", "seek", "file_path", F.col("orphan").alias("holder")))
    others = others.groupBy("how", "seek", "file_path").agg(F.min("holder").alias("holder"))
    for name, held in (("home", homes), ("other", others)):
        near = held.select("how", "seek", F.coalesce("file_path", F.lit("")).alias("f"), F.col("holder").alias(f"{name}_near")).groupBy("how", "seek", "f").agg(F.min(f"{name}_near").alias(f"{name}_near"))
        far = held.groupBy("how", "seek").agg(F.min("holder").alias(f"{name}_far"))
        wanted = wanted.withColumn("f", F.coalesce("file_path", F.lit(""))).join(near, ["how", "seek", "f"], "left").join(far, ["how", "seek"], "left")
    here = F.col("home_near").isNotNull()
    beside = ~here & F.col("other_near").isNotNull()
    away = ~here & ~beside & F.col("home_far").isNotNull()
    state = wanted.select("orphan", F.when(here, F.col("home_near")).when(away, F.col("home_far")).alias("home"), F.when(beside, F.col("other_near")).when(~here & ~away, F.col("other_far")).alias("up"))
    state, left = materialise(state, "placed"), None
    while True:
        waiting = state.where("up IS NOT NULL").count()
        if waiting in (0, left):  # chains have no gaps: if none ended in a round, the waiting ones are cycles
            break
        left = waiting
        ahead = state.select(F.col("orphan").alias("up"), F.col("home").alias("home2"), F.col("up").alias("up2"))
        state = materialise(state.join(ahead, "up", "left").select("orphan", F.coalesce("home", "home2").alias("home"), F.col("up2").alias("up")), "placed")
    homes = state.where("home IS NOT NULL").select(F.col("orphan").alias("__orphan"), F.col("home").alias("__home"))
    rest = messages.where(F.col(c).isNull()).withColumn("__orphan", key).join(homes, "__orphan", "left")
    return known.unionByName(rest.withColumn(c, F.col("__home")).select(*messages.columns))

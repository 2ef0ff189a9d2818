"""Windows and numbers over groups of any size, whose rows are never all one task's."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwright.session import materialise

GROUP_ROWS = 1_000_000  # a group of more rows is cut into blocks


def _cut(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """df sorted over all partitions, with the number of the partition a row lies in; written, so that the cut stays as it is."""
    return materialise(df.repartitionByRange(*group, *order).withColumn("block", F.spark_partition_id().cast("long")), "blocks")


def large_groups(df: DataFrame, group: list[str], most: int | None = None) -> bool:
    """Some group has more than `most` rows (GROUP_ROWS)."""
    return bool(df.groupBy(*group).count().where(F.col("count") > (GROUP_ROWS if most is None else most)).head(1))


def blocks(df: DataFrame, group: list[str], order: list[str], before: int, after: int, large: bool | None = None) -> DataFrame:
    """df with block and own: windows of `before` and `after` rows may be taken per (group, block), and kept where own.

    Where no group is large (told by the caller, or looked up), a group is one
    block. Else the rows are sorted over all tasks and each is in the block it
    falls into; the rows around a block's ends are added to it, not own.
    """
    if not (large_groups(df, group) if large is None else large):
        return df.withColumns({"block": F.lit(0).cast("long"), "own": F.lit(True)})
    cut = _cut(df, group, order)
    spread = cut.groupBy(*group).agg(F.min("block").alias("b0"), F.max("block").alias("b1")).where("b0 < b1").drop("b0", "b1")
    out = cut.withColumn("own", F.lit(True))
    over = cut.join(F.broadcast(spread), group, "left_semi")  # at most one group a partition ends in the next
    for n, ascending in ((before, False), (after, True)):
        if not n:
            continue
        sort = [F.col(c).asc() if ascending else F.col(c).desc() for c in order]
        edge = over.withColumn("__r", F.row_number().over(Window.partitionBy(*group, "block").orderBy(*sort))).where(F.col("__r") <= n).drop("__r")
        # only the edges of blocks are numbered per group: some rows a block
        edge = edge.withColumn("__at", F.row_number().over(Window.partitionBy(*group).orderBy("block", *order)))
        ends = edge.groupBy(*group, "block").agg(F.min("__at").alias("lo"), F.max("__at").alias("hi"))
        wanted = F.sequence(F.col("hi") + 1, F.col("hi") + n) if ascending else F.sequence(F.greatest(F.col("lo") - n, F.lit(1)), F.greatest(F.col("lo") - 1, F.lit(1)))
        reach = ends if ascending else ends.where("lo > 1")
        reach = reach.select(*group, F.col("block").alias("__to"), F.explode(wanted).alias("__at"))
        more = edge.join(reach, [*group, "__at"]).withColumn("block", F.col("__to")).withColumn("own", F.lit(False))
        out = out.unionByName(more.select(*out.columns))
    return out


def numbered(df: DataFrame, group: list[str], order: list[str], name: str, most: int | None = None) -> DataFrame:
    """df with `name`: a row's number in its group, from 1, by `order`; a large group is numbered in blocks."""
    if not large_groups(df, group, most):
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    cut = _cut(df, group, order)
    sizes = cut.groupBy(*group, "block").agg(F.count("*").alias("__n"))
    ahead = Window.partitionBy(*group).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__ahead", F.coalesce(F.sum("__n").over(ahead), F.lit(0))).drop("__n")
    own = F.row_number().over(Window.partitionBy(*group, "block").orderBy(*order))
    placed = cut.withColumn("__own", own).join(sizes, [*group, "block"])
    return placed.withColumn(name, F.col("__own") + F.col("__ahead")).drop("__own", "__ahead", "block")

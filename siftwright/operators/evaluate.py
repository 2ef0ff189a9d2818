"""Scoring findings against labelled spans."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlap_match(labels: DataFrame, predictions: DataFrame) -> DataFrame:
    """One-to-one matches of overlapping spans of one entry and class: entry, class, label_no, pred_no.

    labels: entry, class, label_no, start, end; predictions: entry, class,
    pred_no, start, end. Labels choose in their order, each the first
    prediction left. One sweep over the sorted spans: only a run of spans that
    hang together is held, never an entry.
    """
    a = labels.select("entry", "class", "start", "end", F.lit(0).alias("side"), F.col("label_no").cast("long").alias("no"))
    b = predictions.select("entry", "class", "start", "end", F.lit(1).alias("side"), F.col("pred_no").cast("long").alias("no"))
    spans = a.unionByName(b).where("entry IS NOT NULL AND class IS NOT NULL AND start IS NOT NULL AND end IS NOT NULL")
    placed = spans.repartition("entry", "class").sortWithinPartitions("entry", "class", "start", "end")

    def choose(run: list[tuple]):
        guesses = sorted((r for r in run if r[4]), key=lambda r: r[5])
        if not guesses or len(guesses) == len(run):
            return
        for entry, kind, start, end, side, no in sorted(run, key=lambda r: r[5]):
            if not side:
                for i, g in enumerate(guesses):
                    if start < g[3] and g[2] < end:
                        yield entry, kind, no, g[5]
                        del guesses[i]
                        break

    def sweep(batches):
        run, reach, key, out = [], 0, None, []
        for pdf in batches:
            for r in pdf.itertuples(index=False, name=None):
                if r[:2] != key or r[2] >= reach:
                    out += choose(run)
                    run, reach, key = [], r[3], r[:2]
                run.append(r)
                reach = max(reach, r[3])
            yield pd.DataFrame(out, columns=["entry", "class", "label_no", "pred_no"])
            out = []
        yield pd.DataFrame(list(choose(run)), columns=["entry", "class", "label_no", "pred_no"])

    return placed.mapInPandas(sweep, "entry string, class string, label_no long, pred_no long")


def precision_recall(labels: DataFrame, predictions: DataFrame) -> DataFrame:
    """class, tp, fp, fn, precision, recall, f1; class null: all. Without predictions precision is 1, without labels recall is 1."""
    hit = overlap_match(labels, predictions)
    parts = [labels.select("class", F.lit("l").alias("k")), predictions.select("class", F.lit("p").alias("k")), hit.select("class", F.lit("m").alias("k"))]
    rows = parts[0].unionAll(parts[1]).unionAll(parts[2])
    n = rows.rollup("class").agg(*[F.count_if(F.col("k") == k).alias(k) for k in "lpm"])
    p = F.when(F.col("p") > 0, F.col("m") / F.col("p")).otherwise(1.0)
    r = F.when(F.col("l") > 0, F.col("m") / F.col("l")).otherwise(1.0)
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return n.select("class", F.col("m").alias("tp"), (F.col("p") - F.col("m")).alias("fp"), (F.col("l") - F.col("m")).alias("fn"), p.alias("precision"), r.alias("recall"), f1.alias("f1"))


def binary_scores(classified: DataFrame, positive: str = "real_paste") -> DataFrame:
    """One row: precision and recall of one class of a context corpus (expected_class, context_class), and whether the gates 0.90 / 0.85 hold."""
    want, got = F.col("expected_class") == positive, F.col("context_class") == positive
    n = classified.agg(F.count_if(want & got).alias("tp"), F.count_if(~want & got).alias("fp"), F.count_if(want & ~got).alias("fn"))
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(1.0)
    r = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(1.0)
    return n.select("tp", "fp", "fn", p.alias("precision"), r.alias("recall"), ((p >= 0.90) & (r >= 0.85)).alias("passed"))


def markdown(scores: DataFrame) -> DataFrame:
    """`line`: a row of a Markdown table per class, sorted, the total last; numbers with four decimals."""
    n = lambda c: F.format_string("%.4f", c)
    name = F.coalesce("class", F.lit("all"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", name, "tp", "fp", "fn", n("precision"), n("recall"), n("f1")), F.lit(" |"))
    return scores.orderBy(F.col("class").asc_nulls_last()).select(line.alias("line"))

"""The same scan as a stream: findings, deduplication within a watermark, matches across turns with state."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from siftwright.functions.rules import RULES
from siftwright.operators.detect import detect, find_in, texts_of


def detect_stream(turns: DataFrame) -> DataFrame:
    """Findings of a stream of turns; every expression is stateless."""
    return detect(turns)


def dedupe_stream(findings: DataFrame, time_column: str, delay: str = "1 hour") -> DataFrame:
    """A match of a rule in a turn once within the watermark's delay."""
    digest = findings.withColumn("__digest", F.sha2("matched_raw", 256)).withWatermark(time_column, delay)
    return digest.dropDuplicatesWithinWatermark(["file_path", "turn_idx", "detector_id", "__digest"]).drop("__digest")


def throughput(turns: DataFrame, time_column: str, every: str = "10 seconds", delay: str = "1 minute") -> DataFrame:
    """(start, end, turns, per_second) of a stream or table of turns, by windows of event time."""
    w = turns.withWatermark(time_column, delay).groupBy(F.window(time_column, every)).agg(F.count("*").alias("turns"))
    seconds = F.col("window.end").cast("double") - F.col("window.start").cast("double")
    return w.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "turns", (F.col("turns") / seconds).alias("per_second"))


def across_stream(turns: DataFrame, lookback: int = 3, least: int = 8, tail: int = 128) -> DataFrame:
    """Cross-turn findings of a stream: the last tails of each file are its state. Turns of a file must arrive in order of batches."""
    schema = "file_path string, turn_idx long, role string, joined string, border int, contributing_turns array<bigint>"

    def step(key, pdfs, state):
        tails = json.loads(state.get[0]) if state.exists else []
        rows = pd.concat(list(pdfs)).sort_values("turn_idx", kind="stable")
        out = []
        for idx, role, text in zip(rows["turn_idx"], rows["role"], rows["content"], strict=True):
            data = text.encode()
            start, last = data[:tail].decode(errors="ignore"), data[-tail:].decode(errors="ignore")
            if len(start.encode()) >= least:
                out += [(key[0], int(idx), role, end + start, len(end.encode()), [prev, int(idx)]) for prev, end in tails if len(end.encode()) >= least]
            tails = [*tails, [int(idx), last]][-lookback:]
        state.update((json.dumps(tails),))
        yield pd.DataFrame(out, columns=["file_path", "turn_idx", "role", "joined", "border", "contributing_turns"])

    base = turns.where("content IS NOT NULL").select("file_path", "turn_idx", "role", "content")
    joined = base.groupBy("file_path").applyInPandasWithState(step, schema, "tails string", "append", GroupStateTimeout.NoTimeout)
    return find_in(texts_of(joined, "joined", kind="cross_turn", turns=F.col("contributing_turns"), border=F.col("border")), RULES)


def commit_stream(findings: DataFrame, store, scan_id: str, log: str):
    """Write a stream of findings to a history store; a file is committed once, whatever is delivered again."""
    return findings.writeStream.option("checkpointLocation", log).foreachBatch(lambda df, _: store.commit(scan_id, df)).start()

"""Scan history: totals, recent scans, filters, suppressions; and a store of append-only tables."""

from __future__ import annotations

import secrets
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwright.functions.scalars import bucket, confidence_rank
from siftwright.session import materialise


def _count_if(confidence: str) -> Column:
    return F.count_if(F.col("confidence") == confidence)


def scan_totals(scans: DataFrame, findings: DataFrame) -> DataFrame:
    """scan_id, high, medium, low of every scan; a scan without findings has zeros."""
    per = findings.groupBy("scan_id").agg(*[_count_if(c).alias(c) for c in ("high", "medium", "low")])
    zero = F.lit(0).cast("long")
    return scans.select("scan_id").distinct().join(per, "scan_id", "left").select("scan_id", *[F.coalesce(c, zero).alias(c) for c in ("high", "medium", "low")])


def global_totals(scans: DataFrame) -> DataFrame:
    """One row: scans, clean scans, and sums of the findings; zeros where there are none."""
    n = lambda c: F.coalesce(F.col(f"findings_{c}"), F.lit(0))
    zero = F.lit(0).cast("long")
    return scans.agg(
        F.count("*").alias("scans"),
        F.count_if(n("high") + n("medium") + n("low") == 0).alias("clean"),
        *[F.coalesce(F.sum(n(c)), zero).alias(c) for c in ("high", "medium", "low")],
    )


def recent_scans(scans: DataFrame, n: int) -> DataFrame:
    """The n scans that started last, newest first (ties by scan_id); n = 0 gives none."""
    return scans.orderBy(F.col("started_at_ns").desc_nulls_last(), "scan_id").limit(n)


def findings_for_scan(findings: DataFrame, scan_id: str) -> DataFrame:
    return findings.where(F.col("scan_id") == scan_id).orderBy("detector_id", "turn_idx", "id")


def filter_history(scans: DataFrame, text: str) -> DataFrame:
    """Scans whose id, project or account holds the text, whatever its case; an empty text keeps all."""
    low = text.lower()
    test = F.lit(False)
    for c in ("scan_id", "project_name", "claude_account"):
        test = test | F.coalesce(F.lower(F.col(c)).contains(low), F.lit(False))
    return scans if not low else scans.where(test)


def with_suppression(findings: DataFrame, suppressed: DataFrame) -> DataFrame:
    """findings with `suppressed`: whether their fingerprint is in the list; none is dropped."""
    marks = suppressed.select("fingerprint").distinct().withColumn("__s", F.lit(True))
    return findings.join(marks, "fingerprint", "left").withColumn("suppressed", F.coalesce("__s", F.lit(False))).drop("__s")


def results_view(findings: DataFrame, show_all: bool = False, least: str | float = "low") -> DataFrame:
    """Findings to display: educational and quoted ones hidden unless show_all, and none below a confidence, given by name or as a number (see scalars.bucket)."""
    floor = F.lit(least) if isinstance(least, str) else bucket(F.lit(float(least)))
    rows = findings.where(confidence_rank(F.col("confidence")) >= confidence_rank(floor))
    return rows if show_all else rows.where(~F.coalesce(F.col("context_class").isin("educational", "documentation_quote"), F.lit(False)))


def by_severity(findings: DataFrame) -> DataFrame:
    """High, medium, low; within each in the order of arrival."""
    return findings.orderBy(confidence_rank(F.col("confidence")).desc(), "id")


def started_label(ns: Column) -> Column:
    """A start in nanoseconds as `YYYY-MM-DD HH:MM` UTC; what lies before the epoch shows the epoch."""
    return F.date_format(F.timestamp_micros(F.greatest(F.call_function("div", ns, F.lit(1000).cast("long")), F.lit(0))), "yyyy-MM-dd HH:mm")


def recovered(scans: DataFrame, now_ns: int) -> DataFrame:
    """Scans that never finished, closed: cancelled, with the time that has passed as their duration where it is longer."""
    lost = ~F.coalesce("complete", F.lit(False)) & ~F.coalesce("cancelled", F.lit(False))
    passed = F.floor((F.lit(now_ns) - F.col("started_at_ns")) / 1_000_000).cast("long")
    return scans.withColumns({"duration_ms": F.when(lost, F.greatest(F.coalesce("duration_ms", F.lit(0)), passed)).otherwise(F.col("duration_ms")), "cancelled": F.when(lost, True).otherwise(F.col("cancelled"))})


_SCAN_CODE = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"  # Crockford's base 32


def new_scan_id(now_ms: int | None = None) -> str:
    """A ULID: 48 bits of milliseconds, 80 random bits; 26 characters that sort by time."""
    value = ((time.time_ns() // 1_000_000 if now_ms is None else now_ms) << 80) | secrets.randbits(80)
    return "".join(_SCAN_CODE[(value >> shift) & 31] for shift in range(125, -5, -5))


class Store:
    """History as append-only Parquet: begin, commit per file (each path once), finalize, delete, clear.

    Facts are only appended; a scan's row is its begin joined with its
    finalize, so a lost writer leaves an unfinished scan. A commit writes its
    findings first and then its paths: findings whose commit has no paths were
    left by a writer that died, and are not seen. Findings are stored without
    their matched text. Deleting a scan takes its findings and paths with it.
    """

    VERSION = 2
    STARTED = "scan_id string, started_at_ns long, project_name string, format string"
    ENDED = "scan_id string, duration_ms long, exit_code int, cancelled boolean"
    FILES = "scan_id string, path string, turns long, commit_id string"
    GONE = "scan_id string"
    META = "version int"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def version(self) -> int:
        """The largest version of the tables' layout that was written; 0 before anything was."""
        return self._read("meta", self.META).agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]

    def _stored(self, name: str, schema: str | None = None) -> DataFrame | None:
        try:
            reader = self.spark.read if schema is None else self.spark.read.schema(schema)
            return reader.parquet(f"{self.path}/{name}")
        except Exception as e:  # a table nobody has written yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None

    def _read(self, name: str, schema: str) -> DataFrame:
        found = self._stored(name, schema)
        return self.spark.createDataFrame([], schema) if found is None else found

    def _alive(self, rows: DataFrame) -> DataFrame:
        return rows.join(self._read("gone", self.GONE), "scan_id", "left_anti")

    def _append(self, name: str, df: DataFrame) -> None:
        df.write.mode("append").parquet(f"{self.path}/{name}")

    def begin(self, scan_id: str, project: str | None = None, fmt: str = "human", now_ns: int | None = None) -> None:
        """Insert or ignore."""
        if self.version() < self.VERSION:
            self._append("meta", self.spark.createDataFrame([(self.VERSION,)], self.META))
        if not self._read("started", self.STARTED).where(F.col("scan_id") == scan_id).head(1):
            row = [(scan_id, time.time_ns() if now_ns is None else now_ns, project, fmt)]
            self._append("started", self.spark.createDataFrame(row, self.STARTED))

    def commit(self, scan_id: str, findings: DataFrame, turns: DataFrame | None = None) -> None:
        """Append the findings of files this scan hasn't committed yet, and their paths.

        turns (file_path at least) names the scanned files, those without
        findings too, and how many turns each has; else the files with findings
        count, with no turns.
        """
        known = self._read("files", self.FILES).where(F.col("scan_id") == scan_id).select(F.col("path").alias("file_path"))
        kept, commit = [c for c in findings.columns if c != "matched_raw"], uuid.uuid4().hex
        fresh = findings.join(known, "file_path", "left_anti").select(F.lit(scan_id).alias("scan_id"), *kept)
        paths = fresh.select("file_path").distinct().withColumn("turns", F.lit(0).cast("long")) if turns is None else turns.groupBy("file_path").agg(F.count("*").alias("turns")).join(known, "file_path", "left_anti")
        # the paths are settled before the findings are written: they are the commit
        paths = materialise(paths.select(F.lit(scan_id).alias("scan_id"), F.col("file_path").alias("path"), "turns", F.lit(commit).alias("commit_id")), "paths")
        self._append("findings", fresh.withColumn("commit_id", F.lit(commit)))
        self._append("files", paths)

    def finalize(self, scan_id: str, duration_ms: int, exit_code: int, cancelled: bool = False) -> None:
        self._append("ended", self.spark.createDataFrame([(scan_id, duration_ms, exit_code, cancelled)], self.ENDED))

    def findings(self) -> DataFrame:
        """The committed findings of all scans that were not deleted."""
        found = self._stored("findings")
        if found is None:
            return self.spark.createDataFrame([], "scan_id string, file_path string, detector_id string, turn_idx long, confidence string")
        commits = self._read("files", self.FILES).select("commit_id").distinct()
        return self._alive(found.join(commits, "commit_id", "left_semi")).drop("commit_id")

    def reload(self, scan_id: str) -> DataFrame:
        """One scan's findings as they were stored, by detector and turn, ready for the reports and the view of results; without matched texts they can't be redacted."""
        return self.findings().where(F.col("scan_id") == scan_id).orderBy("detector_id", "turn_idx", "byte_start") if self._stored("findings") is not None else self.findings()

    def scans(self) -> DataFrame:
        """One row per scan with its totals, counted from what was committed; complete where it was finalized."""
        ended = self._read("ended", self.ENDED).dropDuplicates(["scan_id"])
        files = self._read("files", self.FILES).groupBy("scan_id", "path").agg(F.max("turns").alias("turns")).groupBy("scan_id").agg(F.count("*").alias("total_files"), F.sum("turns").alias("total_turns"))
        started = self._alive(self._read("started", self.STARTED))
        totals = scan_totals(started, self.findings().select("scan_id", "confidence"))
        rows = started.join(ended, "scan_id", "left").join(files, "scan_id", "left").join(totals, "scan_id", "left")
        return rows.withColumn("complete", F.col("exit_code").isNotNull()).withColumnsRenamed({c: f"findings_{c}" for c in ("high", "medium", "low")})

    def delete(self, scan_id: str) -> None:
        """A scan and all that hangs on it."""
        self._append("gone", self.spark.createDataFrame([(scan_id,)], self.GONE))

    def clear(self) -> None:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        root = hadoop.Path(self.path)
        root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(root, True)

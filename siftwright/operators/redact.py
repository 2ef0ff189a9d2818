"""Redaction: merging overlapping spans and rewriting contents, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwright.functions.scalars import byte_slice, hmac_sha256
from siftwright.operators.ordered import numbered

MODES = ("mask", "hash", "partial", "vault_ref", "mask_with_type")


def merge_spans(findings: DataFrame) -> DataFrame:
    """Groups of overlapping spans per turn: file_path, turn_idx, byte_start, byte_end, detector_id of the first, n_findings.

    Touching spans stay apart; empty and inverted spans and findings of decoded
    or joined texts (their ranges are of another text) are left out.
    """
    plain = findings.where((F.col("byte_end") > F.col("byte_start")) & (F.col("byte_start") >= 0) & (F.size("transforms") == 0) & (F.col("span_kind") == "single"))
    w = Window.partitionBy("file_path", "turn_idx").orderBy("byte_start", "byte_end", "detector_id")
    reached = F.max("byte_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = plain.withColumn("__new", F.when(reached.isNull() | (F.col("byte_start") >= reached), 1).otherwise(0))
    grouped = opened.withColumn("__g", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.min(F.struct("byte_start", "byte_end", "detector_id"))
    out = grouped.groupBy("file_path", "turn_idx", "__g").agg(first.alias("f"), F.max("byte_end").alias("byte_end"), F.count("*").alias("n_findings"))
    return out.select("file_path", "turn_idx", F.col("f.byte_start").alias("byte_start"), "byte_end", F.col("f.detector_id").alias("detector_id"), "n_findings")


def _char_bound(place: str, step: int) -> Column:
    """A byte offset of content, moved by up to 3 in the direction of step to where a character begins."""
    inside = lambda x: F.hex(F.substr(F.col("content").cast("binary"), (x + 1).cast("int"), F.lit(1))).rlike("^[89AB]")
    at = F.col(place) + 3 * step
    for k in (2, 1, 0):
        at = F.when(inside(F.col(place) + k * step), at).otherwise(F.col(place) + k * step)
    return at


def _replacement(mode: str, piece: Column, salt: bytes) -> Column:
    if mode == "mask":
        return F.lit("[REDACTED]")
    if mode == "hash":
        return F.concat(F.lit("[sha256:"), F.substring(hmac_sha256(piece, salt), 1, 8), F.lit("]"))
    if mode == "partial":
        # at most 6 bytes, and no part of a character
        head = F.element_at(F.filter(F.transform(F.sequence(F.lit(1), F.lit(6)), lambda k: F.left(piece, k)), lambda x: F.octet_length(x) <= 6), -1)
        return F.concat(F.coalesce(head, F.lit("")), F.lit("[REDACTED]"))
    if mode == "vault_ref":
        return F.concat(F.lit("${VAULT:"), F.col("detector_id"), F.lit("_"), F.col("ref"), F.lit("}"))
    return F.concat(F.lit("[REDACTED:"), F.col("detector_id"), F.lit("]"))


def redact(turns: DataFrame, findings: DataFrame, mode: str = "mask", salt: bytes = b"") -> DataFrame:
    """turns with their findings' spans replaced; a turn without findings is unchanged.

    hash: the same value has the same tag under one salt. vault_ref: numbered
    per detector in the order of file, turn and place. Spans that reach beyond
    the content are clamped; an end inside a character moves outwards to its bound. turns must hold a (file_path, turn_idx) once.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    spans = merge_spans(findings)
    if mode == "vault_ref":
        spans = numbered(spans, ["detector_id"], ["file_path", "turn_idx", "byte_start"], "ref")
    size = F.octet_length("content")
    own = turns.select("file_path", "turn_idx", "content").where("content IS NOT NULL")
    cut = spans.join(own, ["file_path", "turn_idx"]).where(F.col("byte_start") < size).withColumn("byte_end", F.least("byte_end", size))
    cut = cut.withColumns({"byte_start": _char_bound("byte_start", -1), "byte_end": _char_bound("byte_end", 1)})
    new = _replacement(mode, byte_slice(F.col("content"), F.col("byte_start"), F.col("byte_end")), salt)
    per_turn = cut.withColumn("new", new).groupBy("file_path", "turn_idx").agg(F.array_sort(F.collect_list(F.struct("byte_start", "byte_end", "new"))).alias("s"))
    rows = turns.join(per_turn, ["file_path", "turn_idx"], "left")
    gap = lambda x, i: F.when(i + 1 < F.size("s"), byte_slice(F.col("content"), x["byte_end"], F.get("s", i + 1)["byte_start"])).otherwise(byte_slice(F.col("content"), x["byte_end"]))
    rest = F.array_join(F.transform("s", lambda x, i: F.concat(x["new"], gap(x, i))), "")
    whole = F.concat(byte_slice(F.col("content"), F.lit(0), F.get("s", F.lit(0))["byte_start"]), rest)
    return rows.withColumn("content", F.when(F.col("s").isNull(), F.col("content")).otherwise(whole)).select(*turns.columns)


def redact_texts(spark: SparkSession, paths: list[str] | str, findings: DataFrame, mode: str = "mask", salt: bytes = b"") -> DataFrame:
    """(file_path, content) of whole text files with the spans of their findings replaced, as a findings report names them.

    findings: file_path, detector_id, byte_start, byte_end (see
    sources.parsers.read_findings_json); only those of a file apply to it, and
    ranges are within the file. A finding without a range (one that comes from
    history, or lies in a decoded layer), or whose range goes beyond the file,
    is passed over.
    """
    files = spark.read.text(paths, wholetext=True).select(F.regexp_replace(F.col("_metadata.file_path"), "^file:/*", "/").alias("file_path"), F.lit(0).cast("long").alias("turn_idx"), F.col("value").alias("content"))
    sizes = files.select("file_path", F.octet_length("content").alias("size"))
    usable = findings.where("byte_end > byte_start").join(sizes, "file_path").where("byte_end <= size")
    transforms = F.col("transforms") if "transforms" in findings.columns else F.array().cast("array<string>")
    spans = usable.select("file_path", F.lit(0).cast("long").alias("turn_idx"), "detector_id", "byte_start", "byte_end", transforms.alias("transforms"), F.lit("single").alias("span_kind"))
    return redact(files, spans, mode, salt).select("file_path", "content")


def write_redacted(redacted: DataFrame, folder: str) -> None:
    """Write redacted files below a folder of the shared file system, `name=<file name>` each; the originals stay."""
    name = F.element_at(F.split("file_path", "/"), -1)
    redacted.select(name.alias("name"), F.col("content").alias("value")).write.mode("overwrite").partitionBy("name").text(folder)

"""Reports of findings: lines for people, JSON, SARIF 2.1.0. None shows a matched text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def location_label(line: Column, turn: Column) -> Column:
    return F.when(line.isNotNull(), F.concat(F.lit("L"), line)).otherwise(F.concat(F.lit("msg "), turn))


def human(findings: DataFrame) -> DataFrame:
    """`line`: [HIGH  ] file  Lnn or msg n  label  bytes=a..b [via=x+y]."""
    f = findings if "line_in_file" in findings.columns else findings.withColumn("line_in_file", F.lit(None).cast("int"))
    via = F.when(F.size("transforms") > 0, F.concat(F.lit("  via="), F.array_join("transforms", "+"))).otherwise(F.lit(""))
    label = F.coalesce(F.nullif("display_name", F.lit("")), F.col("detector_id")) if "display_name" in f.columns else F.col("detector_id")
    line = F.concat(F.lit("["), F.rpad(F.upper("confidence"), 6, " "), F.lit("] "), F.col("file_path"), F.lit("  "), location_label(F.col("line_in_file"), F.col("turn_idx")), F.lit("  "), label, F.lit("  bytes="), F.col("byte_start"), F.lit(".."), F.col("byte_end"), via)
    return f.select("fingerprint", line.alias("line"))


def to_json(findings: DataFrame) -> DataFrame:
    """`json`: one object per finding; absent members are left out."""
    have = set(findings.columns)
    take = [("file", "file_path"), ("turn", "turn_idx"), ("line", "line_in_file"), ("detector", "detector_id"), ("detector_display", "display_name"), ("confidence", "confidence"), ("byte_start", "byte_start"), ("byte_end", "byte_end"), ("synthetic", "synthetic"), ("fingerprint", "fingerprint"), ("excerpt", "excerpt"), ("category", "category"), ("context_class", "context_class")]
    fields = [F.col(c).alias(n) for n, c in take if c in have]
    fields.append(F.when(F.size("transforms") > 0, F.col("transforms")).alias("transforms"))
    return findings.select("fingerprint", F.to_json(F.struct(*fields)).alias("json"))


def sarif_rules(findings: DataFrame) -> DataFrame:
    """Distinct rules with their position by first sight in order of file, turn and place."""
    seen = findings.groupBy("detector_id").agg(F.min(F.struct("file_path", "turn_idx", "byte_start")).alias("first"), F.count("*").alias("results"))
    return seen.select("detector_id", "results", F.row_number().over(Window.orderBy("first", "detector_id")).alias("position"))  # one row per rule


def sarif_results(findings: DataFrame, *keep: str) -> DataFrame:
    """`result`: a SARIF result object per finding, for a writer to put into runs[0].results."""
    level = F.when(F.col("confidence") == "high", "error").when(F.col("confidence") == "medium", "warning").otherwise("note")
    label = F.coalesce(F.nullif("display_name", F.lit("")), F.col("detector_id"))
    text = F.concat(label, F.lit(" detected at bytes "), F.col("byte_start"), F.lit(".."), F.col("byte_end"), F.lit("  excerpt: "), F.col("excerpt"))
    place = F.array(F.struct(F.struct(F.struct(F.col("file_path").alias("uri")).alias("artifactLocation"), F.struct(F.col("byte_start").alias("byteOffset"), (F.col("byte_end") - F.col("byte_start")).alias("byteLength")).alias("region")).alias("physicalLocation")))
    result = F.struct(F.col("detector_id").alias("ruleId"), level.alias("level"), F.struct(text.alias("text")).alias("message"), place.alias("locations"), F.struct(F.col("fingerprint").alias("findingFingerprint/v1")).alias("partialFingerprints"), F.struct(F.col("context_class").alias("contextClass"), F.col("category").alias("category")).alias("properties"))
    return findings.select("fingerprint", *keep, F.to_json(result).alias("result"))


def by_file(findings: DataFrame) -> DataFrame:
    """(file_path, high, medium, low, findings, turns) of each file with findings."""
    return findings.groupBy("file_path").agg(*[F.count_if(F.col("confidence") == c).alias(c) for c in ("high", "medium", "low")], F.count("*").alias("findings"), F.countDistinct("turn_idx").alias("turns"))


def write_sarif(findings: DataFrame, path: str, version: str = "0") -> None:
    """One SARIF log, a file of lines in a folder: head with the rules, a result a line in order of file, turn and place, end.

    The results pass through one task, sorted and spilled, as a log is one
    file; they are not held. Rules are those that have results.
    """
    rules = ",".join('{"id":"%s"}' % r.detector_id for r in sarif_rules(findings).orderBy("position").collect())  # as many as there are rules
    head = '{"version":"2.1.0","$schema":"https://json.schemastore.org/sarif-2.1.0.json","runs":[{"tool":{"driver":{"name":"siftwright","version":"%s","rules":[%s]}},"results":[' % (version, rules)
    order = ["file_path", "turn_idx", "byte_start", "detector_id", "fingerprint"]
    rows = sarif_results(findings, *order[:4]).withColumn("n", F.row_number().over(Window.orderBy(*order, "result")))
    lines = rows.select(F.lit(1).alias("k"), "n", F.concat(F.when(F.col("n") > 1, ",").otherwise(""), "result").alias("value"))
    ends = findings.sparkSession.createDataFrame([(0, 0, head), (2, 0, "]}]}")], "k int, n int, value string")
    lines.unionByName(ends).repartition(1).sortWithinPartitions("k", "n").select("value").write.mode("overwrite").text(path)

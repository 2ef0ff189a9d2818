"""Queries of the scanning engine over the given tables, with the SQL that gives the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwright.functions.rules import RULES, STOPWORDS, keywords
from siftwright.functions.scalars import entropy, fingerprint, iban_ok, luhn
from siftwright.operators import detect, evaluate, history, redact, reports
from siftwright.sources import corpus
from siftwright.session import parallel, read_table

SALT = b"siftwright"


def _turns(spark, folder):
    """turns, one row per (file_path, turn_idx)."""
    t = read_table(spark, folder, "turns").select("file_path", "turn_idx", "role", "content")
    return parallel(t.where("content IS NOT NULL").dropDuplicates(["file_path", "turn_idx"]))


def _documents(spark, folder):
    d = read_table(spark, folder, "documents").where("text IS NOT NULL")
    return parallel(d.select(F.col("doc_id").cast("string").alias("file_path"), F.lit(0).cast("long").alias("turn_idx"), F.lit("user").alias("role"), F.col("text").alias("content")))


def planted(turns):
    """turns with secrets derived from their keys, in plain, base64 and hex, so that every path has something to find."""
    key = F.md5(F.concat("file_path", F.lit(":"), F.col("turn_idx").cast("string")))
    token = F.concat(F.lit("ghp_"), F.substring(F.concat(key, key), 1, 36))
    n = F.col("turn_idx") % 4
    text = (
        F.when(n == 0, F.concat("content", F.lit(" AKIA"), F.upper(F.substring(key, 1, 16))))
        .when(n == 1, F.concat("content", F.lit(" "), token, F.lit(" ")))
        .when(n == 2, F.concat("content", F.lit("\n"), F.base64(F.concat(F.lit("key "), token).cast("binary"))))
        .otherwise(F.concat("content", F.lit("\n"), F.lower(F.hex(F.concat(F.lit("key "), token)))))
    )
    return turns.withColumn("content", text)


_PLANTED = """
WITH t AS (SELECT DISTINCT file_path, turn_idx, role, content, md5(file_path || ':' || turn_idx::VARCHAR) AS k FROM turns WHERE content IS NOT NULL),
planted AS (SELECT file_path, turn_idx, role, CASE turn_idx % 4
  WHEN 0 THEN content || ' AKIA' || upper(substr(k, 1, 16))
  WHEN 1 THEN content || ' ghp_' || substr(k || k, 1, 36) || ' '
  WHEN 2 THEN content || chr(10) || to_base64(encode('key ghp_' || substr(k || k, 1, 36)))
  ELSE content || chr(10) || lower(hex('key ghp_' || substr(k || k, 1, 36))) END AS content, k FROM t)
"""


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _entropy_sql(raw: str) -> str:
    return f"list_entropy(string_split({raw}, ''))"


def _rules_sql(source: str, text: str, keep: str) -> str:
    """UNION of all rules' validated matches of a table in DuckDB."""
    parts = []
    for r in RULES:
        words = keywords(r)
        arm = " OR ".join(f"contains({text}, {_quote(w)})" for w in words)
        valid = {
            "": "true",
            "entropy": f"{_entropy_sql('raw')} >= {r.threshold}",
            "luhn": "(list_sum(list_transform(range(1, len(raw) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(raw[len(raw) - i + 1] AS INT) ELSE (CAST(raw[len(raw) - i + 1] AS INT) * 2) // 10 + (CAST(raw[len(raw) - i + 1] AS INT) * 2) % 10 END)) % 10) = 0",
            "iban": "list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(substr(raw, 5) || substr(raw, 1, 4), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN CAST(c AS BIGINT) ELSE CAST(ord(c) - 55 AS BIGINT) END)), lambda a, c: (a * (CASE WHEN c > 9 THEN 100 ELSE 10 END) + c) % 97) = 1",
        }[r.validator]
        stop = f" AND raw NOT IN ({', '.join(map(_quote, STOPWORDS))})" if r.stopwords else ""
        where = f" WHERE {arm}" if arm else ""
        parts.append(f"SELECT {keep}, {_quote(r.id)} AS detector_id, {_quote(r.confidence)} AS confidence, raw FROM (SELECT {keep}, unnest(regexp_extract_all({text}, {_quote(r.pattern)}, {r.group})) AS raw FROM {source}{where}) WHERE {valid}{stop}")
    return " UNION ALL ".join(parts)


def finding_counts(spark, folder):
    """The flagship: all rules over all documents, once per fingerprint, counted."""
    found = detect.dedupe(detect.detect(_documents(spark, folder)))
    return found.groupBy("detector_id", "confidence").agg(F.count("*").alias("findings"))


def turn_findings(spark, folder):
    f = detect.dedupe(detect.detect(_turns(spark, folder)))
    return f.select("file_path", "turn_idx", "detector_id", "confidence", "fingerprint")


def _with_positives(turns):
    """turns, each with a text that some rule finds a secret in; all rules in turn."""
    made = turns.sparkSession.createDataFrame([(i, t) for i, (_, t) in enumerate(corpus.positives())], "__i int, __made string")
    n = 4 * len(RULES)
    key = F.conv(F.substring(F.md5(F.concat("file_path", F.lit(":"), F.col("turn_idx").cast("string"))), 1, 6), 16, 10).cast("int") % n
    return turns.withColumn("__i", key).join(F.broadcast(made), "__i").withColumn("content", F.concat("content", F.lit("\n"), "__made")).drop("__i", "__made")  # a few rows per rule


def _positives_sql():
    rows = ", ".join(f"({i}, {_quote(t)})" for i, (_, t) in enumerate(corpus.positives()))
    return f"""WITH made(i, t) AS (VALUES {rows}), own AS (SELECT DISTINCT file_path, turn_idx, content FROM turns WHERE content IS NOT NULL),
planted AS (SELECT file_path, turn_idx, content || chr(10) || t AS content FROM own JOIN made ON i = CAST('0x' || substr(md5(file_path || ':' || turn_idx::VARCHAR), 1, 6) AS INT) % {4 * len(RULES)})"""


def rule_findings(spark, folder):
    """Every rule on texts made for it."""
    f = detect.dedupe(detect.detect(_with_positives(_turns(spark, folder))))
    return f.select("file_path", "turn_idx", "detector_id", "category", "confidence", F.round("entropy_score", 6).alias("entropy"), "fingerprint")


def planted_findings(spark, folder):
    f = detect.dedupe(detect.detect(planted(_turns(spark, folder))))
    return f.select("file_path", "turn_idx", "detector_id", "byte_start", "byte_end", "fingerprint", "excerpt")


def decoded_findings(spark, folder):
    f = detect.detect_decoded(planted(_turns(spark, folder)))
    return f.select("file_path", "turn_idx", "detector_id", F.array_join("transforms", "+").alias("via"), "byte_start", "byte_end", "fingerprint").distinct()


def _split_over_turns(turns):
    """turns with one secret cut in two: its head ends a turn, its tail starts the next one."""
    key = F.md5(F.concat("file_path", F.lit("/"), F.floor(F.col("turn_idx") / 2).cast("string")))
    token = F.concat(F.lit("ghp_"), F.substring(F.concat(key, key), 1, 36))
    first = F.col("turn_idx") % 2 == 0
    return turns.withColumn("content", F.when(first, F.concat("content", F.lit(" "), F.left(token, F.lit(16)))).otherwise(F.concat(F.substr(token, F.lit(17)), F.lit(" "), "content")))


def cross_turn_findings(spark, folder):
    f = detect.detect_across(_split_over_turns(_turns(spark, folder)))
    return f.select("file_path", "turn_idx", "detector_id", F.get("contributing_turns", F.lit(0)).alias("prev_turn"), "fingerprint").distinct()


def full_scan(spark, folder):
    f = detect.scan(planted(_turns(spark, folder)))
    return f.select("file_path", "turn_idx", "detector_id", "confidence", "category", F.array_join("transforms", "+").alias("via"), "span_kind", "context_class", "fingerprint", "excerpt")


def classified_scan(spark, folder):
    """What rules find on texts made for them, with its context, by class and confidence."""
    t = _with_positives(_turns(spark, folder))
    f = detect.classify_context(detect.dedupe(detect.detect(t)), t)
    return f.groupBy("detector_id", "context_class").agg(F.count("*").alias("findings"))


def findings_by_file(spark, folder):
    return reports.by_file(read_table(spark, folder, "findings"))


def chunks(spark, folder):
    c = detect.chunk(_turns(spark, folder))
    return c.select("file_path", "turn_idx", "chunk_idx", "chunk_start", F.octet_length("content").cast("long").alias("chunk_bytes"))


def context_signals(spark, folder):
    return detect.context_signals(_turns(spark, folder)).select("file_path", "turn_idx", "edu", "doc_url")


def _corpus(spark, folder):
    c = read_table(spark, folder, "context_corpus")
    turns = c.select(F.col("id").alias("file_path"), F.posexplode("turns").alias("turn_idx", "t")).select("file_path", F.col("turn_idx").cast("long").alias("turn_idx"), "t.role", "t.content")
    found = c.select(F.col("id").alias("file_path"), F.col("finding_turn_idx").cast("long").alias("turn_idx"), "expected_class", F.col("matched_raw"), F.when(F.col("span_kind").isin("cross_turn", "crossturn", "cross"), "cross_turn").otherwise("single").alias("span_kind"), "entropy_score")
    return detect.classify_context(found, turns)


def context_class(spark, folder):
    return _corpus(spark, folder).select(F.col("file_path").alias("id"), "expected_class", "context_class")


def context_scores(spark, folder):
    return evaluate.binary_scores(_corpus(spark, folder))


def entropy_scores(spark, folder):
    f = read_table(spark, folder, "findings").where("fingerprint IS NOT NULL")
    return f.select("id", F.round(entropy(F.col("fingerprint")), 6).alias("entropy"))


def checksum_checks(spark, folder):
    o = read_table(spark, folder, "orders").select((F.col("o_orderkey") * 7919 + 4_000_000_000_000).cast("string").alias("digits"), "o_orderkey")
    return o.select("o_orderkey", luhn(F.col("digits")).alias("luhn"))


def fingerprints(spark, folder):
    f = read_table(spark, folder, "findings")
    return f.select("id", fingerprint(F.col("excerpt"), F.col("detector_id"), F.col("file_path"), F.col("turn_idx")).alias("fp"))


def _spans(spark, folder):
    """Findings with spans that overlap often, over turns of documents."""
    f = read_table(spark, folder, "findings").where("byte_start IS NOT NULL AND byte_end IS NOT NULL AND turn_idx IS NOT NULL AND file_path IS NOT NULL AND detector_id IS NOT NULL")
    return f.select("file_path", "turn_idx", "detector_id", (F.col("byte_start") % 97).alias("byte_start"), (F.col("byte_start") % 97 + F.col("byte_end") - F.col("byte_start")).alias("byte_end"), F.array().cast("array<string>").alias("transforms"), F.lit("single").alias("span_kind"))


def merge_spans(spark, folder):
    return redact.merge_spans(_spans(spark, folder)).select("file_path", "turn_idx", "byte_start", "byte_end", F.col("n_findings").alias("n"))


def _redacted(mode):
    def query(spark, folder):
        t = planted(_turns(spark, folder))
        found = detect.detect(t)
        return redact.redact(t, found, mode, SALT).select("file_path", "turn_idx", "content")

    return query


def scan_totals(spark, folder):
    return history.scan_totals(read_table(spark, folder, "scans"), read_table(spark, folder, "findings"))


def global_totals(spark, folder):
    return history.global_totals(read_table(spark, folder, "scans"))


def recent_scans(spark, folder):
    s = history.recent_scans(read_table(spark, folder, "scans"), 20)
    return s.select("scan_id", "started_at_ns", history.started_label(F.col("started_at_ns")).alias("started"))


def findings_for_scan(spark, folder):
    """Every scan's findings in its listing order, as a position."""
    from pyspark.sql import Window

    f = read_table(spark, folder, "findings")
    w = Window.partitionBy("scan_id").orderBy(F.col("detector_id").asc_nulls_last(), F.col("turn_idx").asc_nulls_last(), "id")
    return f.select("scan_id", "id", F.row_number().over(w).cast("long").alias("position"))


def history_filter(spark, folder):
    return history.filter_history(read_table(spark, folder, "scans"), "ED").select("scan_id", "project_name")


def suppression_flags(spark, folder):
    f = read_table(spark, folder, "findings")
    listed = f.where("confidence = 'low'").select("fingerprint").distinct()
    return history.with_suppression(f, listed).select("id", "suppressed")


def results_view(spark, folder):
    return history.results_view(read_table(spark, folder, "findings"), least="medium").select("id")


def recovery_sweep(spark, folder):
    s = history.recovered(read_table(spark, folder, "scans"), 1_800_000_000_000_000_000)
    return s.select("scan_id", "duration_ms", "cancelled")


def _stored(spark, folder):
    f = read_table(spark, folder, "findings")
    return f.withColumn("transforms", F.coalesce(F.from_json("transforms", "array<string>"), F.array().cast("array<string>")))


def report_human(spark, folder):
    f = _stored(spark, folder).where("id IS NOT NULL AND confidence IS NOT NULL AND file_path IS NOT NULL AND turn_idx IS NOT NULL AND detector_id IS NOT NULL AND byte_start IS NOT NULL AND byte_end IS NOT NULL")
    return reports.human(f.withColumn("fingerprint", F.col("id"))).select(F.col("fingerprint").alias("id"), "line")


def report_json(spark, folder):
    return reports.to_json(_stored(spark, folder))


def report_sarif_rules(spark, folder):
    return reports.sarif_rules(read_table(spark, folder, "findings").where("detector_id IS NOT NULL AND file_path IS NOT NULL AND turn_idx IS NOT NULL AND byte_start IS NOT NULL"))


def report_sarif(spark, folder):
    return reports.sarif_results(_stored(spark, folder).withColumn("display_name", F.col("detector_id")))


def _labelled(spark, folder):
    f = read_table(spark, folder, "findings").where("byte_start IS NOT NULL AND byte_end > byte_start AND file_path IS NOT NULL AND category IS NOT NULL")
    rows = f.select(F.col("scan_id").alias("entry"), F.col("category").alias("class"), F.col("id").alias("n"), "byte_start", "byte_end")
    labels = rows.where("n % 5 <> 0").select("entry", "class", F.col("n").alias("label_no"), F.col("byte_start").alias("start"), F.col("byte_end").alias("end"))
    guesses = rows.where("n % 3 <> 0").select("entry", "class", F.col("n").alias("pred_no"), (F.col("byte_start") + 5).alias("start"), (F.col("byte_end") + 5).alias("end"))
    return labels, guesses


def precision_recall(spark, folder):
    return evaluate.precision_recall(*_labelled(spark, folder))


def corpus_scores(spark, folder):
    """Precision and recall of the rules on the generated corpus."""
    made = corpus.generate(spark, 20_000)
    labels = made.select("entry", F.posexplode("labels").alias("label_no", "l")).select("entry", "l.class", F.col("label_no").cast("long").alias("label_no"), "l.start", "l.end")
    f = detect.detect(corpus.as_turns(made)).where(F.col("detector_id").isin(*corpus.SHAPES))
    guesses = f.select(F.col("file_path").alias("entry"), F.col("detector_id").alias("class"), F.col("byte_start").cast("long").alias("pred_no"), F.col("byte_start").cast("long").alias("start"), F.col("byte_end").alias("end"))
    return evaluate.precision_recall(labels, guesses)


def queries():
    names = [finding_counts, turn_findings, rule_findings, findings_by_file, classified_scan, planted_findings, decoded_findings, cross_turn_findings, full_scan, chunks, context_signals, context_class, context_scores, entropy_scores, checksum_checks, fingerprints, merge_spans, scan_totals, global_totals, recent_scans, findings_for_scan, history_filter, suppression_flags, results_view, recovery_sweep, report_human, report_json, report_sarif_rules, report_sarif, precision_recall, corpus_scores]
    return {f.__name__: f for f in names} | {f"redact_{m}": _redacted(m) for m in redact.MODES}


def _le8(turn: str) -> str:
    return f"unhex(array_to_string(list_reverse(regexp_extract_all(lpad(hex({turn}::BIGINT), 16, '0'), '..')), ''))"


def _fp(raw: str, det: str, file: str, turn: str) -> str:
    return f"substr(sha256(encode(coalesce({raw}, '')) || encode(coalesce({det}, '')) || encode(coalesce({file}, '')) || {_le8(turn)}), 1, 8)"


def _once(table: str) -> str:
    return f"(SELECT DISTINCT file_path, turn_idx, content FROM {table} WHERE content IS NOT NULL)"


def _edu() -> str:
    own = " + ".join(f"contains(low, {_quote(k)})::INT" for k in detect.EDUCATIONAL)
    doc = " OR ".join(f"contains(low, {_quote(k)})" for k in detect.DOC_SITES)
    return f"""WITH o AS (SELECT file_path, turn_idx, {own} AS own, ({doc})::INT AS doc FROM (SELECT file_path, turn_idx, lower(content) AS low FROM {_once('turns')}))
SELECT file_path, turn_idx, CAST(own + sum((own > 0)::INT) OVER w - (own > 0)::INT AS INTEGER) AS edu, max(doc) OVER w = 1 AS doc_url
FROM o WINDOW w AS (PARTITION BY file_path ORDER BY turn_idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"""


def _class_sql(findings: str, texts: str) -> str:
    """findings (key, raw, span_kind, entropy, and `kept` columns) of turns (key: file_path, turn_idx) with context_class."""
    own = " + ".join(f"contains(low, {_quote(k)})::INT" for k in detect.EDUCATIONAL)
    doc = " OR ".join(f"contains(low, {_quote(k)})" for k in detect.DOC_SITES)
    known = " OR ".join(f"contains(raw, {_quote(k)})" for k in detect.PLACEHOLDERS)
    return f"""low_texts AS (SELECT file_path, turn_idx, role, content, {own} AS own, ({doc})::INT AS doc FROM (SELECT *, lower(coalesce(content, '')) AS low FROM {texts})),
signals AS (SELECT file_path, turn_idx, role, coalesce(content, '') AS content, own + sum((own > 0)::INT) OVER w - (own > 0)::INT AS edu, max(doc) OVER w = 1 AS doc_url
  FROM low_texts WINDOW w AS (PARTITION BY file_path ORDER BY turn_idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
seen AS (SELECT f.*, s.role AS turn_role, s.content AS turn_text, s.edu, s.doc_url,
  len(list_filter(string_split_regex(s.content, '(?m)^[ \\t]*```[^\\n]*$'), lambda p, i: i % 2 = 0 AND contains(p, raw))) > 0 AS fence,
  len(list_filter(regexp_extract_all(s.content, '(?s)```.*?(?:```|\\z)|`([^`]*)`', 1), lambda p: contains(p, raw))) > 0 AS code
  FROM {findings} f LEFT JOIN signals s USING (file_path, turn_idx)),
classed AS (SELECT *, CASE WHEN turn_text IS NULL THEN 'unclassified' WHEN span_kind = 'cross_turn' THEN 'real_paste' WHEN {known} THEN 'model_hallucination'
  WHEN doc_url AND (fence OR code) THEN 'documentation_quote'
  WHEN edu >= 2 AND (turn_role IS NOT DISTINCT FROM 'assistant' OR fence) THEN 'educational'
  WHEN fence AND edu >= 1 AND turn_role IS NOT DISTINCT FROM 'assistant' THEN 'educational'
  WHEN turn_role = 'user' AND edu = 0 AND coalesce(entropy, 0) >= 4.5 THEN 'real_paste'
  WHEN turn_role = 'user' AND edu = 0 AND NOT fence THEN 'real_paste' ELSE 'unclassified' END AS context_class FROM seen)"""


_CORPUS = """WITH corpus_turns AS (SELECT id AS file_path, unnest(range(0, len(turns))) AS turn_idx, unnest(turns).role AS role, unnest(turns).content AS content FROM context_corpus),
corpus_findings AS (SELECT id AS file_path, CAST(finding_turn_idx AS BIGINT) AS turn_idx, expected_class, matched_raw AS raw, CASE WHEN span_kind IN ('cross_turn', 'crossturn', 'cross') THEN 'cross_turn' ELSE 'single' END AS span_kind, entropy_score AS entropy FROM context_corpus),
"""


def oracle_sql():
    corpus_class = _CORPUS + _class_sql("corpus_findings", "corpus_turns")
    rule_hits = f"{_positives_sql()}, f AS ({_rules_sql('planted', 'content', 'file_path, turn_idx')}), once AS (SELECT DISTINCT file_path, turn_idx, detector_id, confidence, raw FROM f)"
    categories = f"(VALUES {', '.join(f'({_quote(r.id)}, {_quote(r.category)})' for r in RULES)}) c(detector_id, category)"
    docs = "(SELECT doc_id::VARCHAR AS file_path, text FROM documents WHERE text IS NOT NULL)"
    key = SALT.ljust(64, bytes(1))
    inner, outer = (bytes(x ^ y for x in key).hex() for y in (0x36, 0x5C))
    tags = {
        "mask": "'[REDACTED]'",
        "partial": "substr(piece, 1, 6) || '[REDACTED]'",
        "mask_with_type": "'[REDACTED:' || detector_id || ']'",
        "vault_ref": "'${VAULT:' || detector_id || '_' || row_number() OVER (PARTITION BY detector_id ORDER BY file_path, turn_idx, a) || '}'",
        "hash": f"'[sha256:' || substr(sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode(piece)))), 1, 8) || ']'",
    }
    # every match at its first place in the text, overlapping ones merged, the text rebuilt around them
    merged = _PLANTED + f""", f AS ({_rules_sql('planted', 'content', 'file_path, turn_idx, content')}),
s AS (SELECT DISTINCT file_path, turn_idx, content, detector_id, length(split_part(content, raw, 1)) AS a, length(split_part(content, raw, 1)) + length(raw) AS b FROM f),
r AS (SELECT *, max(b) OVER (PARTITION BY file_path, turn_idx ORDER BY a, b, detector_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM s),
g AS (SELECT *, sum(CASE WHEN reached IS NULL OR a >= reached THEN 1 ELSE 0 END) OVER (PARTITION BY file_path, turn_idx ORDER BY a, b, detector_id ROWS UNBOUNDED PRECEDING) AS grp FROM r),
m AS (SELECT file_path, turn_idx, content, min(a) AS a, max(b) AS b, min({{'a': a, 'b': b, 'd': detector_id}}).d AS detector_id FROM g GROUP BY file_path, turn_idx, content, grp),
p AS (SELECT *, substr(content, a + 1, b - a) AS piece, coalesce(lag(b) OVER (PARTITION BY file_path, turn_idx ORDER BY a), 0) AS past FROM m),
"""
    redacted = {
        f"redact_{m}": merged
        + f"""tagged AS (SELECT *, {tag} AS tag FROM p),
done AS (SELECT file_path, turn_idx, string_agg(substr(content, past + 1, a - past) || tag, '' ORDER BY a) || substr(any_value(content), max(b) + 1) AS content FROM tagged GROUP BY 1, 2)
SELECT file_path, turn_idx, coalesce(d.content, o.content) AS content FROM planted o LEFT JOIN done d USING (file_path, turn_idx)"""
        for m, tag in tags.items()
    }
    return redacted | {
        "finding_counts": f"WITH f AS ({_rules_sql(docs, 'text', 'file_path')}) SELECT detector_id, confidence, count(*) AS findings FROM (SELECT DISTINCT detector_id, confidence, file_path, raw FROM f) GROUP BY 1, 2",
        "turn_findings": f"WITH f AS ({_rules_sql(_once('turns'), 'content', 'file_path, turn_idx')}) SELECT DISTINCT file_path, turn_idx, detector_id, confidence, {_fp('raw', 'detector_id', 'file_path', 'turn_idx')} AS fingerprint FROM f",
        "rule_findings": f"{rule_hits} SELECT file_path, turn_idx, detector_id, category, confidence, round({_entropy_sql('raw')}, 6) AS entropy, {_fp('raw', 'detector_id', 'file_path', 'turn_idx')} AS fingerprint FROM once JOIN {categories} USING (detector_id)",
        "classified_scan": f"{rule_hits}, own_roles AS (SELECT DISTINCT ON (file_path, turn_idx) file_path, turn_idx, role FROM turns WHERE content IS NOT NULL), full_turns AS (SELECT p.file_path, p.turn_idx, r.role, p.content FROM planted p JOIN own_roles r USING (file_path, turn_idx)), hits AS (SELECT *, 'single' AS span_kind, {_entropy_sql('raw')} AS entropy FROM once), {_class_sql('hits', 'full_turns')} SELECT detector_id, context_class, count(*) AS findings FROM classed GROUP BY 1, 2",
        "context_class": f"{corpus_class} SELECT file_path AS id, expected_class, context_class FROM classed",
        "context_scores": f"{corpus_class}, n AS (SELECT count(*) FILTER (expected_class = 'real_paste' AND context_class = 'real_paste') AS tp, count(*) FILTER (expected_class <> 'real_paste' AND context_class = 'real_paste') AS fp, count(*) FILTER (expected_class = 'real_paste' AND context_class <> 'real_paste') AS fn FROM classed), pr AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1.0 END AS recall FROM n) SELECT *, precision >= 0.90 AND recall >= 0.85 AS passed FROM pr",
        "findings_by_file": "SELECT file_path, count(*) FILTER (confidence = 'high') AS high, count(*) FILTER (confidence = 'medium') AS medium, count(*) FILTER (confidence = 'low') AS low, count(*) AS findings, count(DISTINCT turn_idx) AS turns FROM findings GROUP BY 1",
        "report_json": """SELECT fingerprint, CAST(json_merge_patch('{}', json_object('file', file_path, 'turn', turn_idx, 'line', line_in_file, 'detector', detector_id, 'confidence', confidence, 'byte_start', byte_start, 'byte_end', byte_end, 'synthetic', synthetic, 'fingerprint', fingerprint, 'excerpt', excerpt, 'category', category, 'context_class', context_class,
'transforms', CASE WHEN coalesce(len(CAST(CAST(transforms AS JSON) AS VARCHAR[])), 0) > 0 THEN CAST(CAST(transforms AS JSON) AS VARCHAR[]) END)) AS VARCHAR) AS json FROM findings""",
        "report_sarif": """SELECT fingerprint, CAST(json_merge_patch('{}', json_object('ruleId', detector_id, 'level', CASE confidence WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END,
'message', json_object('text', coalesce(nullif(detector_id, ''), detector_id) || ' detected at bytes ' || byte_start || '..' || byte_end || '  excerpt: ' || excerpt),
'locations', json_array(json_merge_patch('{}', json_object('physicalLocation', json_object('artifactLocation', json_object('uri', file_path), 'region', json_object('byteOffset', byte_start, 'byteLength', byte_end - byte_start))))),
'partialFingerprints', json_object('findingFingerprint/v1', fingerprint), 'properties', json_object('contextClass', context_class, 'category', category))) AS VARCHAR) AS result FROM findings""",
        "planted_findings": _PLANTED
        + f""", f AS ({_rules_sql('planted', 'content', 'file_path, turn_idx, content')}),
cut AS (SELECT DISTINCT file_path, turn_idx, detector_id, raw, split_part(content, raw, 1) AS pre, substr(content, length(split_part(content, raw, 1)) + length(raw) + 1) AS post, {_fp('raw', 'detector_id', 'file_path', 'turn_idx')} AS fingerprint FROM f)
SELECT file_path, turn_idx, detector_id, octet_length(encode(pre)) AS byte_start, octet_length(encode(pre)) + octet_length(encode(raw)) AS byte_end, fingerprint,
regexp_replace(right(pre, 30) || '[FP:' || fingerprint || ']' || left(post, 30), '[\\x00-\\x1f\\x7f]', ' ', 'g') AS excerpt FROM cut""",
        "decoded_findings": _PLANTED
        + f"""SELECT file_path, turn_idx, 'github_pat_classic' AS detector_id, CASE turn_idx % 4 WHEN 2 THEN 'base64' ELSE 'hex' END AS via, CAST(4 AS BIGINT) AS byte_start, CAST(44 AS BIGINT) AS byte_end,
{_fp("'ghp_' || substr(k || k, 1, 36)", "'github_pat_classic'", 'file_path', 'turn_idx')} AS fingerprint FROM planted WHERE turn_idx % 4 >= 2""",
        "cross_turn_findings": f"""WITH d AS (SELECT DISTINCT file_path, turn_idx, content, 'ghp_' || substr(repeat(md5(file_path || '/' || (turn_idx // 2)::VARCHAR), 2), 1, 36) AS token FROM turns WHERE content IS NOT NULL),
u AS (SELECT file_path, turn_idx, CASE WHEN turn_idx % 2 = 0 THEN content || ' ' || left(token, 16) ELSE substr(token, 17) || ' ' || content END AS c FROM d),
t AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY turn_idx) AS n,
  left(c, list_max(list_filter(range(0, 129), lambda k: octet_length(encode(left(c, CAST(k AS INT)))) <= 128))) AS head,
  right(c, list_max(list_filter(range(0, 129), lambda k: octet_length(encode(right(c, CAST(k AS INT)))) <= 128))) AS tail FROM u),
joined AS (SELECT b.file_path, b.turn_idx, a.turn_idx AS prev_turn, a.tail || b.head AS joined, octet_length(encode(a.tail)) AS border
  FROM t a JOIN t b ON a.file_path = b.file_path AND b.n - a.n BETWEEN 1 AND 3 WHERE octet_length(encode(a.tail)) >= 8 AND octet_length(encode(b.head)) >= 8),
f AS ({_rules_sql('joined', 'joined', 'file_path, turn_idx, prev_turn, joined, border')}),
g AS (SELECT *, octet_length(encode(split_part(joined, raw, 1))) AS a FROM f)
SELECT DISTINCT file_path, turn_idx, detector_id, prev_turn, {_fp('raw', 'detector_id', 'file_path', 'turn_idx')} AS fingerprint FROM g WHERE a < border AND a + octet_length(encode(raw)) > border""",
        "context_signals": _edu(),
        "entropy_scores": f"SELECT id, round({_entropy_sql('fingerprint')}, 6) AS entropy FROM findings WHERE fingerprint IS NOT NULL",
        "checksum_checks": "WITH d AS (SELECT o_orderkey, (o_orderkey * 7919 + 4000000000000)::VARCHAR AS raw FROM orders) SELECT o_orderkey, (list_sum(list_transform(range(1, len(raw) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(raw[len(raw) - i + 1] AS INT) ELSE (CAST(raw[len(raw) - i + 1] AS INT) * 2) // 10 + (CAST(raw[len(raw) - i + 1] AS INT) * 2) % 10 END)) % 10) = 0 AS luhn FROM d",
        "fingerprints": f"SELECT id, {_fp('excerpt', 'detector_id', 'file_path', 'turn_idx')} AS fp FROM findings",
        "merge_spans": """WITH s AS (SELECT file_path, turn_idx, detector_id, byte_start % 97 AS a, byte_start % 97 + byte_end - byte_start AS b FROM findings
WHERE byte_start IS NOT NULL AND byte_end > byte_start AND turn_idx IS NOT NULL AND file_path IS NOT NULL AND detector_id IS NOT NULL),
r AS (SELECT *, max(b) OVER (PARTITION BY file_path, turn_idx ORDER BY a, b, detector_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM s),
g AS (SELECT *, sum(CASE WHEN reached IS NULL OR a >= reached THEN 1 ELSE 0 END) OVER (PARTITION BY file_path, turn_idx ORDER BY a, b, detector_id ROWS UNBOUNDED PRECEDING) AS grp FROM r)
SELECT file_path, turn_idx, min(a) AS byte_start, max(b) AS byte_end, count(*) AS n FROM g GROUP BY file_path, turn_idx, grp""",
        "scan_totals": "SELECT s.scan_id, count(*) FILTER (f.confidence = 'high') AS high, count(*) FILTER (f.confidence = 'medium') AS medium, count(*) FILTER (f.confidence = 'low') AS low FROM (SELECT DISTINCT scan_id FROM scans) s LEFT JOIN findings f USING (scan_id) GROUP BY 1",
        "global_totals": "SELECT count(*) AS scans, count(*) FILTER (coalesce(findings_high, 0) + coalesce(findings_medium, 0) + coalesce(findings_low, 0) = 0) AS clean, CAST(coalesce(sum(findings_high), 0) AS BIGINT) AS high, CAST(coalesce(sum(findings_medium), 0) AS BIGINT) AS medium, CAST(coalesce(sum(findings_low), 0) AS BIGINT) AS low FROM scans",
        "recent_scans": "SELECT scan_id, started_at_ns, strftime(make_timestamp(greatest(started_at_ns // 1000, 0)), '%Y-%m-%d %H:%M') AS started FROM scans ORDER BY started_at_ns DESC NULLS LAST, scan_id LIMIT 20",
        "findings_for_scan": "SELECT scan_id, id, row_number() OVER (PARTITION BY scan_id ORDER BY detector_id NULLS LAST, turn_idx NULLS LAST, id) AS position FROM findings",
        "history_filter": "SELECT scan_id, project_name FROM scans WHERE contains(lower(scan_id), 'ed') OR contains(lower(coalesce(project_name, '')), 'ed') OR contains(lower(coalesce(claude_account, '')), 'ed')",
        "suppression_flags": "SELECT id, coalesce(fingerprint IN (SELECT fingerprint FROM findings WHERE confidence = 'low' AND fingerprint IS NOT NULL), false) AS suppressed FROM findings",
        "results_view": "SELECT id FROM findings WHERE confidence IN ('high', 'medium') AND coalesce(context_class NOT IN ('educational', 'documentation_quote'), true)",
        "recovery_sweep": "SELECT scan_id, CASE WHEN lost THEN greatest(coalesce(duration_ms, 0), (1800000000000000000 - started_at_ns) // 1000000) ELSE duration_ms END AS duration_ms, CASE WHEN lost THEN true ELSE cancelled END AS cancelled FROM (SELECT *, NOT coalesce(complete, false) AND NOT coalesce(cancelled, false) AS lost FROM scans)",
        "report_human": """SELECT id, '[' || rpad(upper(confidence), 6, ' ') || '] ' || file_path || '  ' || CASE WHEN line_in_file IS NOT NULL THEN 'L' || line_in_file ELSE 'msg ' || turn_idx END || '  ' || detector_id || '  bytes=' || byte_start || '..' || byte_end ||
CASE WHEN coalesce(len(CAST(transforms AS VARCHAR[])), 0) > 0 THEN '  via=' || array_to_string(list_transform(CAST(CAST(transforms AS JSON) AS VARCHAR[]), lambda x: x), '+') ELSE '' END AS line
FROM findings WHERE id IS NOT NULL AND confidence IS NOT NULL AND file_path IS NOT NULL AND turn_idx IS NOT NULL AND detector_id IS NOT NULL AND byte_start IS NOT NULL AND byte_end IS NOT NULL""",
        "report_sarif_rules": "WITH f AS (SELECT detector_id, min({'file_path': file_path, 'turn_idx': turn_idx, 'byte_start': byte_start}) AS first, count(*) AS results FROM findings WHERE detector_id IS NOT NULL AND file_path IS NOT NULL AND turn_idx IS NOT NULL AND byte_start IS NOT NULL GROUP BY 1) SELECT detector_id, results, CAST(row_number() OVER (ORDER BY first, detector_id) AS INTEGER) AS position FROM f",
    }

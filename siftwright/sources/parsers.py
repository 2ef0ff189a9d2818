"""Reading conversation files of any supported kind into turns.

Files are read whole (`binaryFile`), sniffed by name and first bytes, and
parsed where they lie; a broken line or file costs only itself.
"""

from __future__ import annotations

import glob
import json
import os
import re
import sqlite3

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TURNS = "file_path string, turn_idx long, role string, content string, byte_start long, byte_end long, source string, conversation_id string, ts_seconds long, model string, line_in_file int"
NAMES = [c.split()[0] for c in TURNS.split(", ")]
ROLES = {"user": "user", "assistant": "assistant", "system": "system", "tool": "tool", "function": "tool"}
HEAD = 4096


def compact(value) -> str:
    return json.dumps(value, separators=(",", ":"), sort_keys=True, ensure_ascii=False)


def sniff(path: str, head: bytes) -> str | None:
    """The kind of a file: the best score wins, on a tie the later kind; None if nothing fits."""
    name, text = path.rsplit("/", 1)[-1], head[:HEAD].decode("utf-8", "ignore")
    low = name.lower()
    spoken = any(f'"type":{s}"{k}"' in text for s in ("", " ") for k in ("user", "assistant"))
    scores = [
        ("claude_code", (2 if spoken else 1) if low.endswith(".jsonl") else 0),
        ("chat_gpt", 0 if not low.endswith(".json") or '"mapping"' not in text else 2 if '"conversation_id"' in text or '"title"' in text else 1),
        ("cursor", ("state.vscdb" in name) + head.startswith(b"SQLite format 3\0")),
        ("git_hub_copilot", int("Copilot" in name and "Chat" in name and low.endswith(".log"))),
        ("gemini_cli", int("Gemini" in path and name == "MyActivity.json" and text.lstrip()[:1] in ("[", "{") and text != "")),
    ]
    best = max(s for _, s in scores)
    return None if best == 0 else [k for k, s in scores if s == best][-1]


def _blocks(content) -> str:
    """Text of a content that is a string or an array of blocks."""
    if isinstance(content, str):
        return content
    out = []
    for b in content if isinstance(content, list) else ():
        kind = b.get("type") if isinstance(b, dict) else None
        if kind == "text" and isinstance(b.get("text"), str):
            piece = b["text"]
        elif kind == "tool_use":
            piece = f"[tool_use {b.get('name') or ''}] {compact(b.get('input'))}"
        elif kind == "tool_result":
            piece = _blocks(b.get("content"))
        else:
            continue
        out.append(("\n" if any(out) else "") + piece)
    return "".join(out)


def parse_session(data: bytes, errors: list | None = None):
    """JSONL session log, a record per line. A turn's range is its raw line; broken and unknown lines take no index."""
    at = n = 0
    for no, line in enumerate(data.split(b"\n"), 1):
        start, at = at, at + len(line) + 1
        end = min(at, len(data))
        try:
            o = json.loads(line)
        except ValueError as e:
            if errors is not None and line.strip():
                errors.append((no, str(e)))
            continue
        kind = o.get("type") if isinstance(o, dict) else None
        if kind in ("user", "assistant"):
            m = o.get("message")
            if not isinstance(m, dict):
                continue
            role = m.get("role") or kind
            content, model = _blocks(m.get("content")), o.get("model") or m.get("model")
        elif kind in ("tool", "tool_result"):
            role, content, model = "tool", _blocks(o.get("content")), o.get("model")
        else:
            continue
        if role not in ("user", "assistant", "system", "tool"):
            continue
        ts = o.get("timestamp")
        yield n, role, content, start, end, o.get("sessionId"), int(ts) if isinstance(ts, (int, float)) and not isinstance(ts, bool) else None, model, no
        n += 1


def parse_graph(data: bytes, errors: list | None = None):
    """JSON export with message graphs: breadth first from each conversation's root; cycles and dangling children are passed over.

    A conversation that is not what it should be costs only itself.
    """
    root = json.loads(data)
    n = at = 0
    for no, conv in enumerate(root if isinstance(root, list) else [root] if isinstance(root, dict) else [], 1):
        try:
            found = list(_graph_messages(conv))
        except (ValueError, AttributeError, TypeError) as e:
            found = []
            if errors is not None:
                errors.append((no, f"conversation: {e}"))
        for role, text, conversation, ts, model in found:
            size = len(text.encode())
            yield n, role, text, at, at + size, conversation, ts, model, None
            n, at = n + 1, at + size


def _graph_messages(conv):
    """(role, text, conversation, time, model) of one conversation of an export."""
    mapping = conv.get("mapping") if isinstance(conv, dict) else None
    if not isinstance(mapping, dict):
        return
    queue, seen = [k for k, v in mapping.items() if isinstance(v, dict) and v.get("parent") is None][:1], set()
    for k in queue:
        if k in seen or not isinstance(mapping.get(k), dict):
            continue
        seen.add(k)
        node = mapping[k]
        queue += [c for c in node.get("children") or () if c in mapping]
        m = node.get("message") or {}
        role = ROLES.get(((m.get("author") or {}).get("role")))
        c = m.get("content") or {}
        if not role or not isinstance(c, dict) or c.get("content_type") not in (None, "text", "multimodal_text"):
            continue
        text = "\n".join(p if isinstance(p, str) else compact(p) for p in c.get("parts") or () if p not in (None, ""))
        if text:
            ts = m.get("create_time")
            yield role, text, conv.get("conversation_id") or conv.get("id"), None if ts is None else int(ts), (m.get("metadata") or {}).get("model_slug")


def _value_text(v) -> str:
    if isinstance(v, str):
        return v
    if isinstance(v, list):
        return "\n".join(t for t in map(_value_text, v) if t)
    if isinstance(v, dict):
        inner = next((v[k] for k in ("text", "value") if v.get(k)), None)
        return compact(v) if inner is None else _value_text(inner)
    return "" if v is None else compact(v)


def parse_editor(data: bytes):
    """SQLite state database: every object with a role and content under keys `aiService.%`, at any depth, outermost first."""
    con = sqlite3.connect(":memory:")
    try:
        # a copy of one file has no journal beside it: bytes 18 and 19 say that there is none
        con.deserialize(data[:18] + b"\x01\x01" + data[20:])
        rows = con.execute("SELECT key, value FROM ItemTable WHERE key LIKE 'aiService.%' ORDER BY rowid").fetchall()
    except (sqlite3.Error, OverflowError):
        rows = []
    finally:
        con.close()
    n = at = 0
    for key, value in rows:
        try:
            stack = [json.loads(value if isinstance(value, str) else bytes(value or b"").decode("utf-8", "replace"))]
        except ValueError:
            continue
        while stack:
            v = stack.pop()
            if isinstance(v, list):
                stack += reversed(v)
            elif isinstance(v, dict):
                role = ROLES.get(v.get("role")) if isinstance(v.get("role"), str) else None
                text = _value_text(next((v[k] for k in ("content", "text", "message") if k in v), None))
                if role and text:
                    size = len(text.encode())
                    yield n, role, text, at, at + size, key, None, None, None
                    n, at = n + 1, at + size
                stack += [v[k] for k in sorted(v, reverse=True)]


def parse_log(data: bytes):
    """Editor chat log: the first JSON object of each line, whatever surrounds it."""
    n = at = 0
    for no, line in enumerate(data.decode("utf-8", "replace").split("\n"), 1):
        start, at = at, at + len(line.encode()) + 1
        i = line.find("{")
        if i < 0:
            continue
        try:
            o, _ = json.JSONDecoder().raw_decode(line[i:])
        except ValueError:
            continue
        if isinstance(o.get("message"), dict):
            o = o["message"]
        role = ROLES.get(o.get("role"))
        text = _value_text(next((o[k] for k in ("content", "message", "text") if o.get(k)), None))
        if role and text:
            yield n, role, text, start, at, None, None, None, no
            n += 1


def parse_activity(data: bytes):
    """Takeout JSON: an array of conversations with messages; role `model` is the assistant."""
    root = json.loads(data)
    n = at = 0
    for conv in root if isinstance(root, list) else ():
        for m in (conv.get("messages") or ()) if isinstance(conv, dict) else ():
            role = {**ROLES, "model": "assistant"}.get(m.get("role"))
            text, ts = m.get("content"), m.get("timestamp")
            if role and isinstance(text, str) and text:
                size = len(text.encode())
                yield n, role, text, at, at + size, conv.get("title"), ts if isinstance(ts, int) else None, None, None
                n, at = n + 1, at + size


PARSERS = {"claude_code": parse_session, "chat_gpt": parse_graph, "cursor": parse_editor, "git_hub_copilot": parse_log, "gemini_cli": parse_activity}


def load_turns(spark: SparkSession, paths: str | list[str], kind: str = "auto") -> DataFrame:
    """Turns of all files under paths (folders recursively, globs); files of no known kind give none."""

    def run(batches):
        for pdf in batches:
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                data = bytes(data)
                found = sniff(path, data[:HEAD]) if kind == "auto" else kind
                out = []
                try:
                    for idx, role, content, start, end, conv, ts, model, line in PARSERS[found](data) if found else ():
                        out.append((path, idx, role, content, start, end, found, conv, ts, model, line))
                except (ValueError, AttributeError, TypeError):  # not what it looked like; what was read before stays
                    pass
                yield pd.DataFrame(out, columns=NAMES).astype({"ts_seconds": "Int64", "line_in_file": "Int32"})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    return files.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "content").mapInPandas(run, TURNS)


def read_errors(spark: SparkSession, paths: list[str] | str, kind: str = "auto") -> DataFrame:
    """(file_path, source, place, error) of what load_turns passes over: broken lines and conversations (by number), and files that are no such file (place null)."""

    def run(batches):
        for pdf in batches:
            out = []
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                data, errors = bytes(data), []
                found = sniff(path, data[:HEAD]) if kind == "auto" else kind
                try:
                    for _ in PARSERS[found](data, errors) if found in ("claude_code", "chat_gpt") else PARSERS[found](data) if found else ():
                        pass
                except (ValueError, AttributeError, TypeError) as e:
                    errors.append((None, str(e)))
                out += [(path, found, no, e) for no, e in errors]
            yield pd.DataFrame(out, columns=["file_path", "source", "place", "error"]).astype({"place": "Int64"})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    return files.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "content").mapInPandas(run, "file_path string, source string, place long, error string")


def text_turn(spark: SparkSession, text: str, path: str = "<stdin>") -> DataFrame:
    """A text that came through a pipe, as one user turn."""
    size = len(text.encode())
    return spark.createDataFrame([(path, 0, "user", text, 0, size, "generic", None, None, None, None)], TURNS)


# Where tools keep their histories below the home folder or the folder of configurations, how deep to look, and for which files.
PLACES = (
    ("home", ".claude/projects", 6, r"(?i).*\.jsonl"),
    ("home", "Library/Application Support/Claude", 2, r"(?i).*\.json"),
    ("config", "claude", 2, r"(?i).*\.json"),
    ("home", "Library/Application Support/Cursor/User/workspaceStorage", 6, r"(?i).*\.vscdb"),
    ("config", "Cursor/User/workspaceStorage", 6, r"(?i).*\.vscdb"),
    ("home", "Library/Application Support/Code/logs", 6, r"(?=.*Copilot)(?=.*Chat).*\.log"),
    ("config", "Code/logs", 6, r"(?=.*Copilot)(?=.*Chat).*\.log"),
    ("home", "Downloads/Takeout/Gemini", 4, r"MyActivity\.json"),
    ("home", "Takeout/Gemini", 4, r"MyActivity\.json"),
)
FORMATS = {"jsonl": "jsonl", "json": "json", "toml": "toml", "vscdb": "sqlite", "sqlite": "sqlite", "db": "sqlite", "zip": "archive", "gz": "archive", "tgz": "archive"}


def discover(home: str, extra: str = "", config: str | None = None) -> list[tuple[str, str]]:
    """(path, format) of the history files of known tools and of colon-separated extra globs, each once, in order.

    config is the folder of configurations: $XDG_CONFIG_HOME, else .config
    below home. Links are not followed; a folder that is missing or can't be
    read has no files.
    """
    bases = {"home": home, "config": config or os.environ.get("XDG_CONFIG_HOME") or os.path.join(home, ".config")}
    found = set()
    for base, root, deepest, name in PLACES:
        top = os.path.join(bases[base], root)
        for folder, folders, files in os.walk(top):
            depth = 0 if folder == top else os.path.relpath(folder, top).count(os.sep) + 1
            folders[:] = folders if depth + 1 < deepest else []
            found |= {os.path.realpath(os.path.join(folder, f)) for f in files if re.fullmatch(name, f) and not os.path.islink(os.path.join(folder, f))}
    for pattern in filter(None, extra.split(":")):
        found |= {os.path.realpath(p) for p in glob.glob(pattern, recursive=True) if os.path.isfile(p)}
    return [(p, FORMATS.get(p.rsplit(".", 1)[-1].lower(), "text")) for p in sorted(found)]


def project_of(path: str) -> str | None:
    """The folder that holds .git, closest above a path."""
    at = os.path.abspath(path)
    while True:
        if os.path.exists(os.path.join(at, ".git")):
            return os.path.basename(at) or None
        if os.path.dirname(at) == at:
            return None
        at = os.path.dirname(at)


def account_of(path: Column) -> Column:
    """The folder below .claude/projects in a path, null if there is none."""
    return F.nullif(F.regexp_extract(path, r"\.claude/projects/([^/]+)", 1), F.lit(""))


def total_size(spark: SparkSession, paths: list[str]) -> int:
    """Bytes of all files of the given files and folders; the contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    return files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]


def read_findings_json(spark: SparkSession, path: str) -> DataFrame:
    """Findings from a JSON report (an array, or an object a line), as redaction takes them: file_path, turn_idx, detector_id, byte_start, byte_end and what else it has.

    Records without a detector or a range are left out; so are those whose
    range is turned round.
    """
    schema = "file string, turn long, detector string, byte_start long, byte_end long, synthetic boolean, line int, transforms array<string>, fingerprint string"
    f = spark.read.schema(schema).option("multiLine", "true").json(path) if _is_array(spark, path) else spark.read.schema(schema).json(path)
    f = f.where("detector IS NOT NULL AND byte_start IS NOT NULL AND byte_end >= byte_start")
    return f.select(F.col("file").alias("file_path"), F.coalesce("turn", F.lit(0)).alias("turn_idx"), F.col("detector").alias("detector_id"), "byte_start", "byte_end", F.coalesce("synthetic", F.lit(False)).alias("synthetic"), F.col("line").alias("line_in_file"), F.coalesce("transforms", F.array().cast("array<string>")).alias("transforms"), F.lit("single").alias("span_kind"), "fingerprint")


def _is_array(spark: SparkSession, path: str) -> bool:
    first = spark.read.text(path).where("trim(value) <> ''").head(1)
    return bool(first) and first[0][0].lstrip().startswith("[")


def load_suppressions(spark: SparkSession, path: str) -> DataFrame:
    """(fingerprint) of a suppression file; a missing or malformed one gives none."""
    try:
        with open(path) as f:
            marks = json.load(f)["suppressed_fingerprints"]
    except (OSError, ValueError, KeyError, TypeError):
        marks = []
    return spark.createDataFrame([(m,) for m in sorted(set(marks))], "fingerprint string")


def save_suppressions(path: str, fingerprints: list[str]) -> None:
    with open(path, "w") as f:
        json.dump({"version": 1, "suppressed_fingerprints": sorted(set(fingerprints))}, f, indent=2)


def toggle_suppression(path: str, fingerprint: str) -> bool:
    """Add a fingerprint to a suppression file, or take it out; whether it is in it now."""
    try:
        with open(path) as f:
            marks = set(json.load(f)["suppressed_fingerprints"])
    except (OSError, ValueError, KeyError, TypeError):
        marks = set()
    marks ^= {fingerprint}
    save_suppressions(path, list(marks))
    return fingerprint in marks


DEFAULTS = {"schema_version": 1, "scan": {"confidence_threshold": 0.85}}


def load_config(path: str | list[str] | None = None, env: dict | None = None, prefix: str = "SIFTWRIGHT_") -> dict:
    """Defaults, then TOML files in their order (the user's, then the project's), then the environment (`__` nests)."""
    import tomllib

    def merge(a, b):
        return {**a, **{k: merge(a[k], v) if isinstance(v, dict) and isinstance(a.get(k), dict) else v for k, v in b.items()}}

    config = DEFAULTS
    for p in [path] if isinstance(path, str) else path or []:
        if os.path.exists(p):
            with open(p, "rb") as f:
                config = merge(config, tomllib.load(f))
    for key, value in sorted((os.environ if env is None else env).items()):
        if key.startswith(prefix) and "__" in key:
            *where, leaf = key[len(prefix) :].lower().split("__")
            try:
                nested = json.loads(value)
            except ValueError:
                nested = value
            nested = {leaf: nested}
            for k in reversed(where):
                nested = {k: nested}
            config = merge(config, nested)
    if config["schema_version"] != 1:
        raise ValueError("schema_version must be 1")
    return config

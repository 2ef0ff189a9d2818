"""Schemas that drift between files: one settled table, and a report of each change.

A catalogue of column lifespans is kept per producer (series), field and type:
each file's field names and types are gathered as a footer would list them,
`lag` over the producer's files finds the islands of unbroken presence, and
the starts and endings of islands are the changes. An alias table tells which
fields hold the same thing under another name, and generates the casts that
bring every record to settled columns and types.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwright.operators.shredding import decode, kind_of, scalar_text
from siftwright.session import materialise, parallel

# The settled column, its type and the names it goes by.
ALIASES = {
    "role": ("role", ("role", "sender", "author", "from_role", "speaker")),
    "time": ("timestamp", ("timestamp", "ts", "time", "createdAt", "created_at", "sent")),
    "content": ("text", ("content", "contentText", "text", "body", "message")),
    "model": ("string", ("model", "modelSlug", "model_name", "engine")),
    "tokens": ("bigint", ("tokens", "token_count", "usage_total")),
    "lang": ("string", ("lang", "locale")),
    "rating": ("bigint", ("rating",)),
    "pinned": ("boolean", ("pinned",)),
    "tags": ("list", ("tags",)),
    "parent_ref": ("string", ("parent_ref",)),
    "device": ("string", ("device",)),
    "meta": ("string", ("meta",)),
}
# Spellings of roles.
ROLE_SPELLINGS = {"user": "user", "human": "user", "assistant": "assistant", "bot": "assistant", "model": "assistant", "system": "system", "tool": "tool", "function": "tool"}

RECORDS = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("series", T.StringType()),
        T.StructField("file_seq", T.IntegerType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("line_no", T.LongType()),
        T.StructField("message_id", T.StringType()),
        T.StructField("names", T.ArrayType(T.StringType())),
        T.StructField("kinds", T.ArrayType(T.StringType())),
        T.StructField("texts", T.ArrayType(T.StringType())),
    ]
)


def _members(record: dict, wrap: bool) -> list[tuple[str, object]]:
    """(field, value) of a record; the members of a `message` object under `message.`."""
    out: dict = {}
    for name, value in record.items():
        if wrap and name == "message" and isinstance(value, dict):
            out |= {"message." + k: v for k, v in value.items() if v is not None}
        elif value is not None:
            out.setdefault(name, value)
    return list(out.items())


def message_objects(value):
    """Objects with an `id` at any depth, outermost first."""
    stack = [value]
    while stack:
        v = stack.pop()
        if isinstance(v, dict):
            if v.get("id") is not None:
                yield v
            stack += reversed(list(v.values()))
        elif isinstance(v, list):
            stack += reversed(v)
        elif isinstance(v, str) and v[:1] in '{["' and '"id' in v:
            inner = decode(v)
            if isinstance(inner, (dict, list)):
                stack.append(inner)


def _as_text(value) -> str | None:
    return json.dumps(value, ensure_ascii=False) if isinstance(value, (dict, list)) else scalar_text(value)


def _reader(source: str, nested: bool):
    def run(batches):
        for pdf in batches:
            out = []
            for series, seq, path, line, text in zip(*(pdf[c] for c in ("series", "file_seq", "file_path", "line_no", "raw")), strict=True):
                value = decode(text)
                found = message_objects(value) if nested else ([value] if isinstance(value, dict) else [])
                for record in found:
                    members = _members(record, not nested)
                    out.append((source, series, seq, path, line, str(record["id"]) if nested else None, [n for n, _ in members], [kind_of(v) for _, v in members], [_as_text(v) for _, v in members]))
            yield pd.DataFrame(out, columns=RECORDS.names)

    return run


def read_records(raw_messages: DataFrame, item_table: DataFrame) -> DataFrame:
    """Every record of both sources as arrays of field names, types and texts; null members count as absent.

    Cut, blank and null lines give no record; a line delivered again (same
    file, line and text) counts once.
    """
    cols = ["series", "file_seq", "file_path"]
    lines = raw_messages.select(*cols, F.col("line_no").cast("long").alias("line_no"), "raw").where("raw IS NOT NULL AND trim(raw) <> ''")
    items = item_table.where("key LIKE 'aiService.%' AND value IS NOT NULL").select(*cols, F.col("record_id").alias("line_no"), F.col("value").alias("raw"))
    a = parallel(lines).dropDuplicates().mapInPandas(_reader("raw_messages", False), RECORDS)
    b = parallel(items).dropDuplicates().mapInPandas(_reader("item_table", True), RECORDS)
    return a.unionByName(b)


def files_of(raw_messages: DataFrame, item_table: DataFrame) -> DataFrame:
    """Every file of a series with its place in it, also files without a readable record."""
    cols = ["series", "file_seq", "file_path"]
    both = raw_messages.select(*cols).unionByName(item_table.select(*cols)).where("series IS NOT NULL AND file_seq IS NOT NULL")
    files = both.groupBy("series", "file_seq").agg(F.min("file_path").alias("file_path"))
    return files.withColumn("place", F.row_number().over(Window.partitionBy("series").orderBy("file_seq")))


def _shape(text: Column) -> Column:
    """A value's outline, whole: digits as 0, letters as a."""
    return F.regexp_replace(F.regexp_replace(text, r"\d+", "0"), r"\p{L}+", "a")


def values_of(records: DataFrame) -> DataFrame:
    """(series, file_seq, field, type, shape, telling, h): a row per value, with hashes of its outline and of itself; telling: the outline is more than one word."""
    f = records.where("series IS NOT NULL AND file_seq IS NOT NULL").select("series", "file_seq", F.explode(F.arrays_zip("names", "kinds", "texts")).alias("f"))
    f = f.select("series", "file_seq", F.col("f.names").alias("field"), F.col("f.kinds").alias("type"), _shape(F.col("f.texts")).alias("shape"), F.xxhash64("f.texts").alias("h"))
    return f.select("series", "file_seq", "field", "type", F.xxhash64("shape").alias("shape"), F.coalesce(F.col("shape").rlike("[^a]"), F.lit(False)).alias("telling"), "h")


def lifespans(values: DataFrame, files: DataFrame) -> DataFrame:
    """The catalogue: per series, field and file its main type and its main outline (on a tie the last by name)."""
    key = ["series", "file_seq", "field"]
    both = values.groupBy(*key, "type", "shape", "telling").agg(F.count("*").alias("n"))
    types = both.groupBy(*key, "type").agg(F.sum("n").alias("k"), F.max(F.struct("n", "shape", "telling")).alias("s"))
    main = types.groupBy(*key).agg(F.max(F.struct("k", "type")).alias("t"), F.max("s").alias("s"))
    return main.join(files, ["series", "file_seq"]).select("series", "file_seq", "place", "field", F.col("t.type").alias("type"), "s.shape", "s.telling")


def _concept() -> Column:
    pairs = [F.lit(x) for concept, (_, names) in ALIASES.items() for n in names for x in (n, concept)]
    return F.element_at(F.create_map(*pairs), F.regexp_replace("field", r"^message\.", ""))


def _with_values(fields: DataFrame, values: DataFrame) -> DataFrame:
    """fields with a row per distinct value they hold in their file (h), and the number of these (n)."""
    key = ["series", "file_seq", "field"]
    held = materialise(values.join(fields.select(*key), key, "left_semi").select(*key, "h").distinct(), "held")
    return fields.join(held, key).join(held.groupBy(*key).agg(F.count("*").alias("n")), key)


def changes(raw_messages: DataFrame, item_table: DataFrame) -> DataFrame:
    """(file_path, field, change) of each file against the one before it in its series.

    A field is present in a file if one of its records holds it with a value
    that is not null. Its type is the one most of the file's values have (on a
    tie the last by name). A field that starts where another of the same
    concept (alias table) ends is renamed; fields the table doesn't know are
    matched if they share half of the distinct values of one of them, or the
    main outline. Files with a null series
    or file_seq belong to no series and are left out; the first file of a
    series has no changes.
    """
    files = materialise(files_of(raw_messages, item_table), "files")
    values = materialise(values_of(read_records(raw_messages, item_table)), "values")
    spans = lifespans(values, files)
    w = Window.partitionBy("series", "field").orderBy("place")
    spans = spans.withColumns({"before": F.lag("place").over(w), "type_before": F.lag("type").over(w), "after": F.lead("place").over(w)})
    last = files.groupBy("series").agg(F.max("place").alias("last"))
    spans = materialise(spans.join(last, "series"), "lifespans")
    unbroken = F.col("before") == F.col("place") - 1
    facts = ["file_seq", "field", "type", "shape", "telling", _concept().alias("concept")]
    starts = spans.where((F.col("place") > 1) & ~F.coalesce(unbroken, F.lit(False))).select("series", "place", *facts)
    ends = spans.where((F.col("place") < F.col("last")) & ~F.coalesce(F.col("after") == F.col("place") + 1, F.lit(False))).select("series", (F.col("place") + 1).alias("place"), *facts)
    retyped = spans.where(unbroken & (F.col("type") != F.col("type_before"))).select("series", "place", "field", F.lit("retyped").alias("change"))
    # a wrapped and an unwrapped field are never the same thing
    level = lambda df: df.withColumn("level", F.col("field").startswith("message."))
    nth = Window.partitionBy("series", "place", "level", "concept").orderBy("field")
    key = ["series", "place", "level", "concept", "nth"]
    new = level(starts).withColumn("nth", F.row_number().over(nth))
    old = level(ends).withColumn("nth", F.row_number().over(nth))
    by_table = new.where("concept IS NOT NULL").join(old.where("concept IS NOT NULL").select(*key, F.col("field").alias("old_field"), F.col("type").alias("old_type")), key).select("series", "place", "field", "type", "old_field", "old_type")
    here = ["series", "place", "level"]
    strange = level(starts).where("concept IS NULL").drop("concept")
    gone = level(ends).drop("concept").join(by_table.select("series", "place", F.col("old_field").alias("field")), ["series", "place", "field"], "left_anti")
    gone = gone.join(strange.select(*here).distinct(), here, "left_semi")
    if strange.head(1):
        strange, gone = _with_values(materialise(strange, "strange"), values), _with_values(materialise(gone, "gone"), values)
        as_old = lambda df: df.select(*here, *[F.col(c).alias(f"old_{c}") for c in ("field", "type", "shape", "n")], *[c for c in ("h",) if c in df.columns])
        once = lambda df: df.drop("h").distinct()
        shared = strange.select(*here, "field", "h").join(as_old(gone).select(*here, "old_field", "h"), [*here, "h"]).groupBy(*here, "field", "old_field").agg(F.count("*").alias("shared"))
        met = once(strange).join(as_old(once(gone)), here).join(shared, [*here, "field", "old_field"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
        alike = ((F.col("shared") > 0) & (F.col("shared") * 2 >= F.least("n", "old_n"))) | ((F.col("shape") == F.col("old_shape")) & F.col("telling"))
        best = lambda by, then: F.row_number().over(Window.partitionBy("series", "place", by).orderBy(F.col("shared").desc(), then))
        guessed = met.where(alike).withColumn("r", best("field", "old_field")).where("r = 1")
        guessed = guessed.withColumn("r", best("old_field", "field")).where("r = 1")
        by_table = by_table.unionByName(guessed.select(*by_table.columns))
    renamed = materialise(by_table, "renamed")
    out = (
        renamed.select("series", "place", "field", F.lit("renamed").alias("change"))
        .unionByName(renamed.where("type <> old_type").select("series", "place", "field", F.lit("retyped").alias("change")))
        .unionByName(starts.join(renamed, ["series", "place", "field"], "left_anti").select("series", "place", "field", F.lit("added").alias("change")))
        .unionByName(ends.join(renamed.select("series", "place", F.col("old_field").alias("field")), ["series", "place", "field"], "left_anti").select("series", "place", "field", F.lit("removed").alias("change")))
        .unionByName(retyped)
    )
    return out.join(files, ["series", "place"]).select("file_path", "field", "change")


def _cast(kind: str, raw: Column) -> Column:
    """The settled value of a field's text; what cannot be read gives null."""
    number = raw.try_cast("double")
    if kind == "timestamp":
        seconds = F.when(F.abs(number) > 1e11, number / 1000).otherwise(number)
        return F.when(number.isNotNull(), F.timestamp_micros((seconds * 1_000_000).cast("long"))).otherwise(raw.try_cast("timestamp"))
    if kind == "bigint":
        return number.try_cast("long")
    if kind == "boolean":
        return F.when(F.lower(raw).isin("true", "1", "1.0", "yes"), True).when(F.lower(raw).isin("false", "0", "0.0", "no"), False)
    if kind == "list":
        return F.when(raw.startswith("["), F.from_json(raw, "array<string>")).otherwise(F.split(raw, r"\s*,\s*"))
    if kind == "role":
        bare = F.lower(F.trim(F.when(raw.startswith("{"), F.get_json_object(raw, "$.name")).otherwise(raw)))
        spelled = F.create_map(*[F.lit(x) for kv in ROLE_SPELLINGS.items() for x in kv])
        return F.coalesce(F.try_element_at(spelled, bare), bare)
    if kind == "text":
        blocks = F.from_json(raw, "array<struct<type:string,text:string>>")
        return F.when(raw.startswith('[{"'), F.array_join(F.transform(blocks, lambda b: b["text"]), "\n")).otherwise(raw)
    return raw


def settled(raw_messages: DataFrame, item_table: DataFrame) -> DataFrame:
    """All records of both sources in one table with settled columns and types.

    Columns: source, series, file_seq, file_path, line_no (record_id for the
    item table), message_id, those of ALIASES, and `other`: a map of every
    member that is in none of these columns (fields the table doesn't know, a
    second field of the same concept, values that could not be cast), as text
    under its own name. A record that was readable is never dropped.
    """
    rows = read_records(raw_messages, item_table)
    cols, used = {}, []
    for c, (kind, names) in ALIASES.items():
        # a name may stand both at the top and in the wrapped message: the wrapped one counts
        known = F.array(*[F.lit(p + n) for n in names for p in ("message.", "")])
        name = F.get(F.array_intersect(known, F.col("names")), F.lit(0))
        raw = F.try_element_at("texts", F.nullif(F.array_position("names", name).cast("int"), F.lit(0)))
        cols[c] = _cast(kind, raw)
        used.append(F.when(cols[c].isNotNull(), name))
    named = F.map_from_arrays("names", "texts")
    other = F.map_filter(named, lambda k, v: ~F.array_contains(F.array_compact(F.array(*used)), k))
    return rows.select("source", "series", "file_seq", "file_path", "line_no", "message_id", *[v.alias(k) for k, v in cols.items()], other.alias("other"))

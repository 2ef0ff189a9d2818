"""Column functions: entropy, checksums, fingerprints, excerpts, redaction tags. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def byte_pairs(raw: Column) -> Column:
    """The UTF-8 bytes of a text as an array of two-digit hex strings."""
    return F.regexp_extract_all(F.hex(raw), F.lit("(..)"), F.lit(1))


def entropy(raw: Column) -> Column:
    """Shannon entropy over bytes, in bits per byte, summed in byte order; 0 for an empty text."""
    pairs = byte_pairs(raw)
    n = F.greatest(F.size(pairs), F.lit(1)).cast("double")
    parts = F.transform(F.array_sort(F.array_distinct(pairs)), lambda b: F.size(F.filter(pairs, lambda x: x == b)) / n)
    return F.aggregate(parts, F.lit(0.0), lambda a, p: a - p * F.log2(p))


def luhn(raw: Column) -> Column:
    """Luhn check of 12 to 19 digits, white space and hyphens aside."""
    digits = F.regexp_replace(raw, r"[\s-]", "")
    return F.coalesce(digits.rlike("^[0-9]{12,19}$") & F.call_function("luhn_check", digits), F.lit(False))


def iban_ok(raw: Column) -> Column:
    """ISO 13616 mod-97 check of 15 to 34 letters and digits."""
    bare = F.upper(F.regexp_replace(raw, r"\s", ""))
    turned = F.concat(F.substr(bare, F.lit(5)), F.substr(bare, F.lit(1), F.lit(4)))
    value = lambda c: F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55)
    left = F.aggregate(F.split(turned, ""), F.lit(0), lambda r, c: F.when(c == "", r).otherwise((r * F.when(c.between("0", "9"), 10).otherwise(100) + value(c)) % 97).cast("int"))
    return F.coalesce(bare.rlike("^[A-Z0-9]{15,34}$") & (left == 1), F.lit(False))


def fingerprint(raw: Column, detector: Column, file: Column, turn: Column) -> Column:
    """The first 8 hex digits of SHA-256 over match, detector, file and the turn as 8 little-endian bytes."""
    little = F.unhex(F.array_join(F.reverse(F.regexp_extract_all(F.lpad(F.hex(turn.cast("long")), 16, "0"), F.lit("(..)"), F.lit(1))), ""))
    parts = [F.coalesce(c.cast("string"), F.lit("")).cast("binary") for c in (raw, detector, file)]
    return F.substring(F.sha2(F.concat(*parts, little), 256), 1, 8)


def byte_slice(text: Column, start: Column, end: Column | None = None) -> Column:
    """Bytes start (from 0) to end of a text, which must lie on character bounds."""
    data = text.cast("binary")
    rest = F.substr(data, start + 1) if end is None else F.substr(data, start + 1, end - start)
    return F.decode(rest, "UTF-8")


def byte_head(text: Column, n: int) -> Column:
    """The first n bytes of a text; a character cut by the end is left out."""
    kept = F.regexp_replace(F.hex(F.substr(text.cast("binary"), F.lit(1), F.lit(n))), r"(?<=^(?:..){0,%d})(?:[CD].|E.(?:[89AB].)?|F.(?:[89AB].){0,2})$" % n, "")
    return F.when(F.octet_length(text) <= n, text).otherwise(F.decode(F.unhex(kept), "UTF-8"))


def byte_tail(text: Column, n: int) -> Column:
    """The last n bytes of a text; a character cut by the start is left out."""
    kept = F.regexp_replace(F.hex(F.substr(text.cast("binary"), F.octet_length(text) - (n - 1), F.lit(n))), r"^(?:[89AB].)+", "")
    return F.when(F.octet_length(text) <= n, text).otherwise(F.decode(F.unhex(kept), "UTF-8"))


def one_line(text: Column) -> Column:
    """Control characters as spaces."""
    return F.regexp_replace(text, r"[\x00-\x1f\x7f]", " ")


def excerpt(text: Column, start: Column, end: Column, fp: Column) -> Column:
    """30 characters before, the fingerprint in place of the match, 30 after; on one line."""
    return one_line(F.concat(F.right(byte_slice(text, F.lit(0), start), F.lit(30)), F.lit("[FP:"), fp, F.lit("]"), F.left(byte_slice(text, end), F.lit(30))))


def confidence_rank(confidence: Column) -> Column:
    return F.when(confidence == "high", 2).when(confidence == "medium", 1).otherwise(0)


def bucket(threshold: Column) -> Column:
    """The least confidence a numeric threshold lets through."""
    return F.when(threshold >= 0.85, "high").when(threshold >= 0.5, "medium").otherwise("low")


def hmac_sha256(value: Column, key: bytes) -> Column:
    """HMAC-SHA256 in hex, composed of SHA-256 over binary."""
    import hashlib

    k = hashlib.sha256(key).digest() if len(key) > 64 else key
    k = k.ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in k), bytes(b ^ 0x5C for b in k)
    hexed = lambda b: F.unhex(F.lit(b.hex()))
    return F.sha2(F.concat(hexed(outer), F.unhex(F.sha2(F.concat(hexed(inner), value.cast("binary")), 256))), 256)

"""A labelled synthetic corpus, derived from row numbers: the same rows for the same seed on any cluster."""

from __future__ import annotations

import math
import random
import re
import string
from collections import Counter

try:
    from re import _constants as sre
    from re import _parser as sre_parse
except ImportError:  # Python before 3.11
    import sre_constants as sre
    import sre_parse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwright.functions.rules import RULES, STOPWORDS, Rule, keywords

# Per cent of entries with one secret, with two, with look-alikes of high entropy, with near misses, and without any.
MIX = {"single": 30, "double": 6, "hard_negative": 24, "near_miss": 16, "clean": 24}
# What stands before a secret's body, and how long the body is; keys are rule ids.
SHAPES = {
    "aws_access_key_id": ("AKIA", 16),
    "aws_sts_access_key_id": ("ASIA", 16),
    "github_pat_classic": ("ghp_", 36),
    "github_oauth_token": ("gho_", 36),
    "openai_api_key": ("sk-", 48),
    "stripe_live_secret_key": ("sk_live_", 24),
    "stripe_webhook_secret": ("whsec_", 32),
    "npm_token": ("npm_", 36),
    "gcp_api_key": ("AIza", 35),
    "gitlab_pat": ("glpat-", 20),
    "digitalocean_pat": ("dop_v1_", 64),
    "shopify_access_token": ("shpat_", 32),
}
# Sentences around a secret; {} is its place.
CONTEXTS = ("export KEY={} before you run it", "my config has {} in it", '{{"key": "{}"}}', "curl -H 'X-Key: {}' https://host.example", "I pasted {} by accident")
PROSE = ("Can you explain how the index works?", "The build is green again.", "Please keep the same tone.", "Let us look at the second chapter.")


def _pick(choices, by: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in choices]), (F.pmod(by, F.lit(len(choices))) + 1).cast("int"))


def generate(spark: SparkSession, count: int = 50_000, seed: int = 42, mix: dict[str, int] = MIX) -> DataFrame:
    """entry, text, bucket, labels: array of (class, start, end) in bytes; `mix` must sum to 100."""
    if sum(mix.values()) != 100:
        raise ValueError("the mix must sum to 100")
    h = lambda salt: F.xxhash64(F.lit(seed), F.col("id"), F.lit(salt))
    share, bucket, upto = F.pmod(h("bucket"), F.lit(100)), None, 0
    for name, part in mix.items():
        upto += part
        bucket = F.when(share < upto, name) if bucket is None else bucket.when(share < upto, name)

    def secret(salt: str, less: int = 0) -> tuple[Column, Column]:
        rule = _pick(list(SHAPES), h("rule" + salt))
        body = F.sha2(F.concat_ws(":", F.lit(seed), "id", F.lit(salt)), 256)
        text = None
        for rid, (head, size) in SHAPES.items():
            own = F.substring(body, 1, size - less)
            own = F.upper(own) if rid.startswith("aws") else own
            value = F.concat(F.lit(head), own)
            text = F.when(rule == rid, value) if text is None else text.when(rule == rid, value)
        return rule, text

    def placed(context: Column, value: Column) -> tuple[Column, Column]:
        at = F.locate("{}", context) - 1
        text = F.concat(F.substr(context, F.lit(1), at), value, F.substr(context, at + 3))
        return text, at.cast("long")

    (r1, s1), (r2, s2), (_, near) = secret("a"), secret("b"), secret("n", less=8)
    contexts = [c.replace("{{", "{").replace("}}", "}") if "{{" in c else c for c in CONTEXTS]
    t1, a1 = placed(_pick(contexts, h("c1")), s1)
    t2, a2 = placed(_pick(contexts, h("c2")), s2)
    look = F.concat(_pick(("commit ", "etag ", "md5 "), h("l")), F.md5(F.concat(F.col("id").cast("string"), F.lit(str(seed)))))
    miss, _ = placed(_pick(contexts, h("c3")), near)
    label = lambda rule, at, s: F.struct(rule.alias("class"), at.alias("start"), (at + F.octet_length(s)).alias("end"))
    b = F.col("bucket")
    shift = (F.octet_length(t1) + 1).cast("long")
    text = F.when(b == "single", t1).when(b == "double", F.concat(t1, F.lit("\n"), t2)).when(b == "hard_negative", look).when(b == "near_miss", miss).otherwise(_pick(PROSE, h("p")))
    one = F.array(label(r1, a1, s1))
    labels = F.when(b == "single", one).when(b == "double", F.array(label(r1, a1, s1), label(r2, a2 + shift, s2))).otherwise(F.slice(one, 1, 0))
    return spark.range(count).withColumn("bucket", bucket).select(F.format_string("turn_%06d", "id").alias("entry"), text.alias("text"), "bucket", labels.alias("labels"))


def as_turns(corpus: DataFrame) -> DataFrame:
    return corpus.select(F.col("entry").alias("file_path"), F.lit(0).cast("long").alias("turn_idx"), F.lit("user").alias("role"), F.col("text").alias("content"))


def _made(nodes, rng: random.Random) -> str:
    """A text that a parsed pattern matches."""
    out = []
    for op, arg in nodes:
        if op == sre.LITERAL:
            out.append(chr(arg))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, inner = arg
            times = rng.randint(low, min(int(high), low + 6))
            out += [_made(inner, rng) for _ in range(times)]
        elif op == sre.SUBPATTERN:
            out.append(_made(arg[-1], rng))
        elif op == sre.BRANCH:
            out.append(_made(rng.choice(arg[1]), rng))
        elif op in (sre.IN, sre.NOT_LITERAL, sre.ANY, sre.CATEGORY):
            test = arg if op == sre.IN else [(op, arg)]
            out.append(rng.choice([c for c in string.ascii_letters + string.digits + string.punctuation if _in(test, c)] or [" "]))
    return "".join(out)


_CLASSES = {sre.CATEGORY_DIGIT: str.isdigit, sre.CATEGORY_SPACE: str.isspace, sre.CATEGORY_WORD: lambda c: c.isalnum() or c == "_"}
_OTHERS = {sre.CATEGORY_NOT_DIGIT: sre.CATEGORY_DIGIT, sre.CATEGORY_NOT_SPACE: sre.CATEGORY_SPACE, sre.CATEGORY_NOT_WORD: sre.CATEGORY_WORD}


def _in(items, c: str) -> bool:
    hit, turned = False, False
    for op, arg in items:
        if op == sre.NEGATE:
            turned = True
        elif op == sre.LITERAL:
            hit |= c == chr(arg)
        elif op == sre.NOT_LITERAL:
            hit |= c != chr(arg)
        elif op == sre.RANGE:
            hit |= arg[0] <= ord(c) <= arg[1]
        elif op == sre.CATEGORY:
            hit |= not _CLASSES[_OTHERS[arg]](c) if arg in _OTHERS else bool(_CLASSES[arg](c))
        elif op == sre.ANY:
            hit = True
    return hit != turned


def _passes(rule: Rule, raw: str) -> bool:
    if rule.stopwords and raw in STOPWORDS:
        return False
    if rule.validator == "entropy":
        return -sum(n / len(raw) * math.log2(n / len(raw)) for n in Counter(raw.encode()).values()) >= rule.threshold
    if rule.validator == "luhn":
        return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(raw))) % 10 == 0
    if rule.validator == "iban":
        return int("".join(str(int(c, 36)) for c in raw[4:] + raw[:4])) % 97 == 1
    return True


def positives(rules: list[Rule] = RULES, each: int = 4, seed: int = 7) -> list[tuple[str, str]]:
    """(rule id, text) of `each` texts for every rule that it finds a secret in, made from its pattern, validator and keywords."""
    rng, out = random.Random(seed), []
    for rule in rules:
        tree, words = sre_parse.parse(rule.pattern), keywords(rule)
        for _ in range(each):
            for _ in range(20_000):
                made = _made(tree, rng)
                text = (rng.choice(words) + " " if words else "") + made + " "
                hits = [m.group(rule.group) for m in re.finditer(rule.pattern, text)]
                if hits and _passes(rule, hits[0]):
                    out.append((rule.id, text))
                    break
            else:
                raise ValueError(f"no text found for {rule.id}")
    return out

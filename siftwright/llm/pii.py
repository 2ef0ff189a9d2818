"""Personal data in free text, by a skip-chain conditional random field.

Candidate spans (anything shaped remotely like an address, number or name) are
the variables of the field. Their unary potentials come from features of the
span and of the words around it; neighbours in the text share a chain
potential, and candidates of the same or similar wording anywhere in the
document share a skip potential, so that one clear mention settles the others.
Loopy belief propagation finds the labels. The field is fitted on a bounded
sample of texts whose clear cases are labelled by context rules.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwright.operators.hierarchy import place_orphans

LABELS = ("none", "email", "phone", "id_number", "address", "name")
PLACEHOLDERS = {k: f"[{k.upper()}]" for k in LABELS[1:]}
TRAIN_TEXTS = 6000  # texts that the field is fitted on, the first by a hash of the text
COMMON_RATE = 12 / 24_000  # share of the texts that hold an everyday word
BUCKETS = 1 << 15
BARE = "bare"  # the feature of a pair that neither its letters nor the words before it make a name
BARE_PRIOR, SKIP_PRIOR = 2.0, 4.0  # what the weights start from: such a pair is none, and the same wording has the same label

_LATIN = "A-Za-z0-9_\u00c0-\u024f"  # scripts without spaces may stand right beside a span
_AT = r"(?:\s?@\s?|%40|\s?[\[(]\s?at\s?[\])]\s?)"
_DOT = r"(?:\.|\s?[\[(]\s?dot\s?[\])]\s?)"
_EMAIL = re.compile(rf"(?<![{_LATIN}.+'-])[{_LATIN}.+'-]*[{_LATIN}]{_AT}[{_LATIN}-]+(?:{_DOT}[{_LATIN}-]+)+", re.I)
_NUMBER = re.compile(rf"(?<![{_LATIN}@])(?:[A-Za-z]-?)?(?:\(?\+|\()?\d(?:[\d \u00a0().\-/]{{4,22}})\d(?:[A-Za-z](?![{_LATIN}]))?(?:,?\s?(?:ext|x|app|Durchwahl)\.?\s?\d{{1,5}})?(?![{_LATIN}@])", re.I)
# Kinds of streets and how they are written.
_EN_STREET = r"(?:street|st|avenue|ave|road|rd|lane|ln|drive|dr|court|ct|close|crescent|cres|way|place|pl|boulevard|blvd|terrace|square|sq|row|hill|walk|mews)"
_STREETS = (
    ((), re.compile(r"\d [^\W\d_]"), re.compile(rf"(?:\b(?:flat|apt|unit|suite)\.? \d{{1,4}}[a-z]?, )?(?<![{_LATIN}])\d{{1,5}}[a-z]? (?:[\w'-]+ ){{1,4}}{_EN_STREET}(?![{_LATIN}])\.?(?:,? (?:apt|flat|unit|suite|#)\.? ?\d{{1,4}}[a-z]?)?", re.I)),
    (
        ("straße", "strasse", "str.", "weg", "allee", "gasse", "platz", "ring", "ufer", "damm", "steig", "hof", "chaussee"),
        re.compile(r"(?:straße|strasse|str\.|weg|allee|gasse|platz|ring|ufer|damm|steig|hof|chaussee) ?\d", re.I),
        re.compile(rf"(?<![{_LATIN}])[{_LATIN}-]*(?:straße|strasse|str\.|weg|allee|gasse|platz|ring|ufer|damm|steig|hof|chaussee) ?\d{{1,4}} ?[a-z]?(?![{_LATIN}])(?:, \d{{5}} [{_LATIN}-]+)?", re.I),
    ),
    (
        ("calle", "c/", "avda", "avenida", "paseo", "plaza", "pza", "camino", "ronda", "travesía", "carrera"),
        re.compile(r"\b(?:calle|c/|avda|avenida|paseo|plaza|pza|camino|ronda|travesía|carrera)", re.I),
        re.compile(rf"(?:\bcalle|\bc/|\bavda\.?|\bavenida|\bpaseo|\bplaza|\bpza\.?|\bcamino|\bronda|\btravesía|\bcarrera)(?: [{_LATIN}'-]+){{1,5}},? ?(?:n[ºo°.]* ?)?\d{{1,4}}(?![{_LATIN}])(?:\s?[-,]\s?\d{{5}} [{_LATIN}-]+)?", re.I),
    ),
    (
        ("rue ", "avenue ", "boulevard ", "place ", "quai ", "impasse ", "allée ", "chemin ", "cours ", "route "),
        re.compile(r"\d(?: bis| ter)?,? (?:rue|avenue|boulevard|place|quai|impasse|allée|chemin|cours|route) ", re.I),
        re.compile(rf"(?<![{_LATIN}])\d{{1,4}}(?: bis| ter)?,? (?i:rue|avenue|boulevard|place|quai|impasse|allée|chemin|cours|route)(?: de| du| des| la| le)*(?: (?:d['’]|l['’])?[A-Z\u00c0-\u00de][{_LATIN}'’-]+){{1,3}}(?:,? \d{{5}} [{_LATIN}-]+)?"),
    ),
    (
        ("via ", "viale ", "piazza ", "corso ", "rua ", "travessa ", "praça ", "ul. ", "ulica "),
        re.compile(r"\b(?:Via|[Vv]iale|[Pp]iazza|[Cc]orso|[Rr]ua|[Tt]ravessa|[Pp]raça|ul\.|ulica) "),
        re.compile(rf"\b(?:Via|[Vv]iale|[Pp]iazza|[Cc]orso|[Rr]ua|[Tt]ravessa|[Pp]raça|ul\.|ulica)(?: (?:d[aeio]l?l?[aeio]?|dos|das))?(?: [A-Z\u00c0-\u017d][a-z\u00df-\u024f][{_LATIN}'’-]*){{1,3}},? (?:n[º°.]* ?)?\d{{1,4}}[a-z]?(?![{_LATIN}])"),
    ),
    (
        ("straat ", "laan ", "plein ", "gracht ", "kade ", "gatan ", "vägen ", "gade ", "vej "),
        re.compile(r"(?:straat|laan|plein|gracht|kade|gatan|vägen|gade|vej) \d", re.I),
        re.compile(rf"(?<![{_LATIN}])[A-Z][{_LATIN}-]*(?:straat|laan|plein|gracht|kade|gatan|vägen|gade|vej) \d{{1,4}} ?[a-z]?(?![{_LATIN}])"),
    ),
    (
        ("ул.", "улица", "проспект", "пр-т", "переулок", "пер.", "набережная"),
        re.compile(r"(?:ул\.|улица|проспект|пр-т|переулок|пер\.|набережная)"),
        re.compile(r"(?:ул\.|улица|проспект|пр-т|переулок|пер\.|набережная) ?[А-ЯЁ][А-Яа-яё-]+(?: [А-ЯЁ][а-яё-]+)?,? ?(?:д\.|дом)? ?\d{1,4}[а-я]?(?:,? ?(?:кв\.|квартира) ?\d{1,4})?"),
    ),
    (
        ("路", "街", "大道", "巷", "弄"),
        re.compile(r"(?:路|街|大道|巷|弄)\d"),
        re.compile(r"[\u4e00-\u9fff]{2,12}(?:路|街|大道|巷|弄)\d{1,5}[号號](?:[\u4e00-\u9fff\d]{1,8}[室楼])?"),
    ),
)
# Words that announce what follows.
_ID_WORDS = re.compile(r"\b(?:ssn|social security|dni|nie|nif|sozialversicherung|social_security|passport|pasaporte|reisepass|licen[cs]e|licencia|führerschein|steuer-?id|tax[ _-]?id|national[ _-]?id|nacional|identity|identidad|personalausweis|ausweis|insurance n|citizen|id[ _-]?(?:card|number|no|nummer))", re.I)
_PHONE_WORDS = re.compile(r"\b(?:tel|tfno|phone|call|text|whatsapp|mobile|cell|fax|handy|ruf|telefon|teléfono|llám|my number|picks up at|contact|contacto|sms|reach me)", re.I)
_OTHER_WORDS = re.compile(r"\b(?:ticket|order|range|chapter|section|page|line|column|build|hash|sha|md5|digest|route|iso|version|answered|commit|row|step|port|seed|port|pins|serial|invoice no|model|account|iban|card|tracking|isbn)\b", re.I)
_CUE = r"(?:\b(?:my name is|name is|i'm|i am|according to|told|letter out to|spoke to (?:mrs?|ms|dr)\.?|invoice for|between me and|patient:|cc:|frag bitte|ich heiße|me llamo|pregunta a|ask|dr\.|mrs?\.?|ms\.?|regards,\s|grüße\s|saludo,\s)|approved_by=|_name\"?: ?\"|\d\d:\d\d\]|--)"
_NAME_CUE = re.compile(_CUE + r"[ \t]*$", re.I)
_NAME_WORD = r"[A-Z\u00c0-\u024f][A-Za-z\u00c0-\u024f\u0300-\u036f'’]+"
_STRONG_NAME = re.compile(rf"({_NAME_WORD})((?: [A-Z]\.| von| van| de| al)*) ((?:al-|O['’]|von )?{_NAME_WORD}(?:-{_NAME_WORD})?)")
_HAN_NAME = re.compile(r"(?:我叫|我的名字(?:是|叫)|姓名[:：]|联系人[:：]|患者[:：]|名前は|氏名[:：])\s*([\u4e00-\u9fff]{2,4}?)(?=[，。、,.;；!！\s]|$|です|と申|先生|女士)")
_GLUED = re.compile(r"['’]s?$|(?<=[a-z]{3})[A-Z]|(?<=[A-Z]{3})[a-z]{2}")  # where what follows a surname without a space begins
_UNIT = re.compile(r"\d ?ms[ \t]*$")  # milliseconds, no title
_WORDS = re.compile(r"\w+|[^\w\s]")


_PLAIN = re.compile(r"[^\W\d_]{2,}")
_LONG_WORD = re.compile(r"[^\W\d_][^\W\d_'’-]{4,}")


# Words before a surname that are no first name.
_TITLES = frozenset("mr mrs ms dr prof herr frau señor señora sr sra don doña ask told bitte frag an a und and y project the".split())


_FOLD = {chr(i): c for i in range(0xC0, 0x250) if (c := unicodedata.normalize("NFD", chr(i))[0]).isascii()} | dict(zip("ØøŁłĐđ", "OoLlDd", strict=True))
_MARKED = re.compile("[" + "".join(_FOLD) + "]")


def fold(text: str) -> str:
    """The text without accents, of the same length."""
    return text if text.isascii() else _MARKED.sub(lambda m: _FOLD[m.group()], text)


def cued(left: str) -> bool:
    """What stands before a span announces a name."""
    return bool(_NAME_CUE.search(left)) and not _UNIT.search(left)


def pairs(text: str):
    """(start, end, first name, surname, announced) of capitalised pairs; announced: right behind a word that announces a name."""
    at = 0
    while m := _STRONG_NAME.search(text, at):
        at = m.end(1)
        left = text[max(0, m.start() - 24) : m.start()]
        first, last = m.group(1), _GLUED.split(m.group(3), maxsplit=1)[0]
        if first[0].isupper() and any(c.isupper() for c in last[:5]) and first.lower() not in _TITLES:
            told = cued(left)
            if told:
                at = m.start(3) + len(last)
            yield m.start(), m.start(3) + len(last), first, last, told


def announced(text: str):
    """(start, end, first name, surname) of the announced pairs."""
    return ((a, b, first, last) for a, b, first, last, told in pairs(text) if told)


class Lexicon:
    """Endings of surnames and first names, learned from the names that clear contexts announce."""

    # common: the everyday words, those that at least COMMON_RATE of the texts write in lower case (so 1 / COMMON_RATE times a text's words at most)
    def __init__(self, endings: set[str], firsts: set[str], common: set[str] = frozenset()):
        self.endings, self.firsts, self.common = endings, firsts, common
        tail = "|".join(sorted(map(re.escape, endings))) or r"(?!)"
        word = r"[A-Za-z\u00c0-\u024f][A-Za-z\u00c0-\u024f'’]*"
        last = rf"(?:(?:al-|o['’]|(?:von|van|de) )?{word}-)?(?:al-|o['’])?{word}(?:{tail})(?:-{word})?"
        edge = rf"(?![{_LATIN}@]|['’-][{_LATIN}])"
        self.pattern = re.compile(rf"(?<![{_LATIN}@.'’-])(?:(?P<last>{last}), (?P<first>{word})|(?P<first2>{word})(?P<mid>(?: [a-z]\.)?(?: (?:von|van|de|al))?) (?P<last2>{last})){edge}", re.I)

    @classmethod
    def learn(cls, texts: list[str]) -> Lexicon:
        counts = Counter(x for t in texts for x in heard(t))
        endings, firsts = cls.known((kind, word, n) for (kind, word), n in counts.items())
        plain = Counter(w for t in texts for w in plain_words(t))
        return cls(endings, firsts, {w for w, n in plain.items() if n >= common_least(len(texts))})

    @staticmethod
    def known(counts) -> tuple[set[str], set[str]]:
        """(endings, first names) heard often enough, of (kind, word, times)."""
        counts = list(counts)
        endings = {w for kind, w, n in counts if kind == "end" and n >= 3 and re.fullmatch(r"[a-z\u00df-\u024f]{4}", w)}
        return endings, {w for kind, w, n in counts if kind == "first" and n >= 2}

    def rare(self, *words: str) -> bool:
        """None of the words, nor a part of them, is an everyday one."""
        return not any(w in self.common for x in words for w in _PLAIN.findall(fold(x).lower()))

    def names(self, text: str, low: str):
        """Pairs of a first name and a surname of the lexicon, written alike (Title, UPPER or lower); accents do not count."""
        ends, whole, text = self.endings, text, fold(text)
        low = low if text == whole else text.lower()
        if not any(w[-4:] in ends for w in _LONG_WORD.findall(low)):
            return
        at = 0
        while m := self.pattern.search(text, at):
            first, last = m.group("first") or m.group("first2"), m.group("last") or m.group("last2")
            core = last.split(" ")[-1].split("-")[-1].lstrip("oO'’")
            alike = (first.isupper() and core.isupper()) or (first.islower() and core.islower()) or (first[0].isupper() and not first.isupper() and any(c.isupper() for c in last) and not core.isupper())
            if alike and first.lower() not in _TITLES:
                yield m.span()
                at = m.end()
            else:
                at = m.start() + len(m.group("last") or m.group("first2"))


def heard(text: str):
    """("end", ending) and ("first", first name) of the names that a text announces."""
    for _, _, first, last in announced(text):
        surname = fold(last.lower()).split("-")[-1]
        if len(surname) >= 6:
            yield "end", surname[-4:]
        yield "first", fold(first.lower())


def plain_words(text: str) -> set[str]:
    """The words that a text writes in lower case."""
    return {w for w in set(_PLAIN.findall(fold(text))) if w.islower()}


def common_least(texts: int) -> float:
    """Texts, of so many, that must hold a word in lower case for it to be an everyday one."""
    return max(12, COMMON_RATE * texts)


def candidates(text: str, lexicon: Lexicon) -> list[tuple[int, int, str]]:
    """(start, end, shape) of candidate spans, in order, not overlapping; the earlier shapes take precedence."""
    spans: list[tuple[int, int, str]] = []
    low = text.lower()

    def take(found, shape):
        for a, b in found:
            if all(b <= s or a >= e for s, e, _ in spans):
                spans.append((a, b, shape))

    if "@" in text or "%40" in text or "at]" in low or "at)" in low or "at ]" in low:
        take((m.span() for m in _EMAIL.finditer(text)), "email")
    if _DIGIT.search(text):
        for some, gate, pattern in _STREETS:
            if (not some or any(w in low for w in some)) and gate.search(text):
                take((m.span() for m in pattern.finditer(text)), "address")
        take((m.span() for m in _NUMBER.finditer(text) if sum(c.isdigit() for c in m.group()) >= 7 and not _DATE.match(m.group()) and not _IP.match(m.group())), "number")
    take(lexicon.names(text, low), "name")
    # every capitalised pair is a variable, whatever its letters, if it is announced or holds no everyday word
    both = [p for p in pairs(text) if p[4] or lexicon.rare(p[2], p[3])]
    take(((a, b) for a, b, _, _, told in both if told), "name")
    if both:
        named = {skip_key(text[a:b], s) for a, b, s in spans if s == "name"}
        take(((a, b) for a, b, *_ in both if skip_key(text[a:b], "name") in named), "name")
        take(((a, b) for a, b, *_ in both), "name")
    if not text.isascii():
        take((m.span(1) for m in _HAN_NAME.finditer(text)), "name")
    return sorted(spans)


_DIGIT = re.compile(r"\d")
_DATE = re.compile(r"(?:19|20)\d\d[-./]\d\d?[-./]\d\d?(?:\D|$)")
_IP = re.compile(r"\d{1,3}(?:\.\d{1,3}){3}$")
_ID_SHAPE = re.compile(r"(?:\d{3}[- ]\d{2}[- ]\d{4}|[A-Z]-?\d{4}-\d{4}-\d{2}|[A-Z]\d{7}|\d{8}[A-Z]|\d{6}-\d{4}|\d{2} \d{3} \d{3} \d{3}|\d{9,11})$", re.I)
_PHONE_SHAPE = re.compile(r"\(?(?:\+\d{1,3}|00\d{2}|1)[-. ]?\(?\d|\(\d{3}\) ?\d{3}[-. ]\d{4}|\d{3}[-. ]\d{3}[-. ]\d{4}|(?:\d\d[. ]){4}\d\d|0\d{2,4}[ /]\d")


def _around(text: str, a: int, b: int) -> tuple[str, str]:
    """What stands before and after a span within its line."""
    left = text[max(0, a - 44) : a]
    return left, text[b : b + 24]


def weak_label(text: str, a: int, b: int, shape: str, lexicon: Lexicon) -> str | None:
    """The label that the context makes clear; None where it doesn't."""
    span = text[a:b]
    left, right = _around(text, a, b)
    near = re.split(r"[\n.!?]\s", left)[-1]
    if shape == "email":
        local, _, domain = re.split(rf"({_AT})", span, maxsplit=1, flags=re.I)[:3]
        ending = re.split(r"[.\s\]\)]", domain)[-1]
        bad = local.lower() in ("git", "svn", "app") or not ending.isalpha() or len(ending) < 2 or re.search(r"://\S*$|/$|['\"]@?\S*/$", left)
        return "none" if bad else "email"
    if shape == "address":
        return "address"
    if shape == "number":
        if _DATE.match(span) or _IP.match(span):
            return "none"
        marks = [(max((m.end() for m in p.finditer(near)), default=-1), k) for p, k in ((_ID_WORDS, "id_number"), (_PHONE_WORDS, "phone"), (_OTHER_WORDS, "none"))]
        at, kind = max(marks)
        if at >= 0:
            if kind == "phone" and not _PHONE_SHAPE.match(span):
                return None
            return kind
        if re.match(r"\W{0,3}(?:a valid |is what they |as )?(?:ssn|dni|passport|national id)|\W{0,2} is what they have", right, re.I):
            return "id_number"
        return "phone" if re.match(r"\(?\+\d", span) else None
    m = lexicon.pattern.match(fold(text), a)
    first = (m.group("first") or m.group("first2") or "").lower() if m else ""
    if m and (m.group("last") or m.group("last2")).lower() in lexicon.common:
        return "none"  # the surname is an everyday word of the corpus
    if first in lexicon.firsts or (cued(left) and span[:1].isupper()) or not span[:1].isascii():
        return "name"
    if not m:
        return "none"  # a pair that neither its letters nor the words around it make a name; skip edges may
    return "none" if first in ("the", "a", "an", "of", "and", "my", "der", "die", "das", "el", "la", "und", "y", "zu", "am", "is", "for", "this", "that", "about") else None


def features(text: str, a: int, b: int, shape: str, lexicon: Lexicon) -> list[int]:
    """Hashed features of a candidate: outline, endings, announcing words, words before and after."""
    span = text[a:b]
    left, right = _around(text, a, b)
    outline = re.sub(r"[A-Za-z]+", "a", re.sub(r"\d", "9", span))[:28]
    before, after = _WORDS.findall(left.lower())[-3:], _WORDS.findall(right.lower())[:2]
    near = re.split(r"[\n.!?]\s", left)[-1]
    f = [f"s={shape}", f"o={shape}|{outline}", f"u={shape}|{span[:1].isupper()}"]
    f += [f"b{i}={w}" for i, w in enumerate(reversed(before))] + [f"a{i}={w}" for i, w in enumerate(after)]
    if shape == "number":
        f += [f"w={k}" for k, p in (("id", _ID_WORDS), ("tel", _PHONE_WORDS), ("oth", _OTHER_WORDS)) if p.search(near)]
        f += [f"n={k}" for k, p in (("date", _DATE), ("ip", _IP), ("id", _ID_SHAPE), ("tel", _PHONE_SHAPE)) if p.match(span)]
        f += [f"after={bool(re.match('[^a-z]{0,3}(?:a valid|is what)', right, re.I))}", f"plus={'+' in span}", f"digits={sum(c.isdigit() for c in span)}"]
    elif shape == "email":
        f += [f"tld={span.lower()[-4:]}", f"alpha={span[-1:].isalpha()}", f"local={span.lower()[:4]}", f"url={'://' in left}"]
    elif shape == "name":
        words, cue = _WORDS.findall(fold(span.lower())), cued(left)
        f += [f"first={w}" for w in words[:1]] + [f"last={w[-4:]}" for w in words[-1:]] + [ f"known={any(w in lexicon.firsts for w in words)}", f"end={bool(words) and words[-1][-4:] in lexicon.endings}", f"han={'一' <= span[:1] <= '鿿'}", f"start={not left.strip() or left.rstrip()[-1:] in '.!?:'}", f"cue={cue}", f"plain={any(w in lexicon.common for w in words)}"]
        if not (cue or "一" <= span[:1] <= "鿿" or any(w in lexicon.firsts for w in words) or (words and words[-1][-4:] in lexicon.endings)):
            f.append(BARE)
    return [zlib.crc32(x.encode()) % BUCKETS for x in f]


def skip_key(span: str, shape: str) -> str:
    """Candidates with the same key are the same or similar wording."""
    if shape == "number":
        return "n" + re.sub(r"\D", "", span)
    if shape == "name":
        return "p" + "".join(sorted(w for w in _WORDS.findall(span.lower()) if len(w) > 2))
    return shape[0] + span.lower()


class Field:
    """Weights of a skip-chain CRF and its inference."""

    def __init__(self, lexicon: Lexicon):
        k = len(LABELS)
        self.lexicon = lexicon
        self.unary = np.zeros((BUCKETS, k), np.float32)
        self.chain = np.zeros((k, k), np.float32)
        self.skip = SKIP_PRIOR * np.eye(k, dtype=np.float32)
        self.unary[zlib.crc32(BARE.encode()) % BUCKETS, 0] = BARE_PRIOR

    @staticmethod
    def edges(text: str, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, bool]]:
        """(i, j, is skip): neighbours, and each span with the next one of its key."""
        out = [(i, i + 1, False) for i in range(len(spans) - 1)]
        last: dict[str, int] = {}
        for j, (a, b, shape) in enumerate(spans):
            key = skip_key(text[a:b], shape)
            if key in last:
                out.append((last[key], j, True))
            last[key] = j
        return out

    def beliefs(self, scores: np.ndarray, edges: list[tuple[int, int, bool]], rounds: int = 8) -> tuple[np.ndarray, list[np.ndarray]]:
        """Node and edge marginals by loopy belief propagation in log space."""
        n, k = scores.shape
        msg = {}
        for i, j, _ in edges:
            msg[i, j, _], msg[j, i, _] = np.zeros(k), np.zeros(k)
        into: list[list] = [[] for _ in range(n)]
        for key in msg:
            into[key[1]].append(key)
        for _ in range(min(rounds, 2 * n)):
            new = {}
            for i, j, kind in msg:
                pot = self.skip if kind else self.chain
                pot = pot if i < j else pot.T
                base = scores[i] + sum((msg[m] for m in into[i] if not (m[0] == j and m[2] == kind)), np.zeros(k))
                out = _lse(base[:, None] + pot, 0)
                new[i, j, kind] = out - out.max()
            change = max(np.abs(new[m] - msg[m]).max() for m in msg) if msg else 0
            msg = new
            if change < 1e-3:
                break
        node = np.stack([scores[i] + sum((msg[m] for m in into[i]), np.zeros(k)) for i in range(n)])
        node = np.exp(node - _lse(node, 1)[:, None])
        pair = []
        for i, j, kind in edges:
            pot = self.skip if kind else self.chain
            bi = scores[i] + sum((msg[m] for m in into[i] if not (m[0] == j and m[2] == kind)), np.zeros(k))
            bj = scores[j] + sum((msg[m] for m in into[j] if not (m[0] == i and m[2] == kind)), np.zeros(k))
            joint = bi[:, None] + bj[None, :] + pot
            joint = np.exp(joint - joint.max())
            pair.append(joint / joint.sum())
        return node, pair

    def fit(self, texts: list[str], epochs: int = 6, rate: float = 0.15, decay: float = 1e-4) -> Field:
        """Likelihood ascent with belief propagation; what has no clear label takes the field's own belief."""
        rng = np.random.default_rng(0)
        docs = []
        for t in texts:
            spans = candidates(t, self.lexicon)[:60]
            if not spans:
                continue
            gold = [weak_label(t, *s, self.lexicon) for s in spans]
            # the same wording as a name of this text is a name too: what skip edges are learned from
            named = {skip_key(t[a:b], shape) for (a, b, shape), g in zip(spans, gold, strict=True) if g == "name"}
            gold = ["name" if shape == "name" and g != "name" and skip_key(t[a:b], shape) in named else g for (a, b, shape), g in zip(spans, gold, strict=True)]
            if any(g is not None for g in gold):
                docs.append(([np.array(features(t, *s, self.lexicon)) for s in spans], self.edges(t, spans), [None if g is None else LABELS.index(g) for g in gold]))
        for epoch in range(epochs):
            step = rate / (1 + 0.5 * epoch)
            for d in rng.permutation(len(docs)):
                feats, edges, gold = docs[d]
                scores = np.stack([self.unary[f].sum(0) for f in feats])
                node, pair = self.beliefs(scores, edges) if edges else (np.exp(scores - _lse(scores, 1)[:, None]), [])
                for i, g in enumerate(gold):
                    if g is not None:
                        grad = -node[i]
                        grad[g] += 1
                        if np.abs(grad).max() > 1e-3:
                            self.unary[feats[i]] += step * grad
                for (i, j, kind), p in zip(edges, pair, strict=True):
                    if gold[i] is not None and gold[j] is not None:
                        grad = -p
                        grad[gold[i], gold[j]] += 1
                        weights = self.skip if kind else self.chain
                        weights += 0.2 * step * grad - decay * weights
        return self

    def label(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """(start, end, kind) of the personal data in each text."""
        all_spans = [candidates(t, self.lexicon) for t in texts]
        flat = [features(t, *s, self.lexicon) for t, spans in zip(texts, all_spans, strict=True) for s in spans]
        if not flat:
            return [[] for _ in texts]
        sizes = np.fromiter(map(len, flat), np.int64, len(flat))
        starts = np.r_[0, np.cumsum(sizes)[:-1]]
        scores = np.add.reduceat(self.unary[np.concatenate([np.array(f) for f in flat])], starts, axis=0)
        top2 = np.partition(scores, -2, axis=1)[:, -2:]
        margin = top2[:, 1] - top2[:, 0]
        reach = 2 * max(float(np.ptp(self.chain)), 1e-9)
        out, at = [], 0
        for t, spans in zip(texts, all_spans, strict=True):
            n = len(spans)
            own = scores[at : at + n]
            best = own.argmax(1) if n else []
            if n > 1:
                # messages cannot overturn a span whose lead exceeds all that its neighbours can carry, nor those whose like agree
                edges = self.edges(t, spans)
                if (margin[at : at + n] < 2 * reach).any() or any(skip and best[i] != best[j] for i, j, skip in edges):
                    best = self.beliefs(own, edges)[0].argmax(1)
            out.append([(a, b, LABELS[k]) for (a, b, _), k in zip(spans, best, strict=True) if k])
            at += n
        return out


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis)
    return top + np.log(np.exp(x - np.expand_dims(top, axis)).sum(axis))


def learn_lexicon(texts: DataFrame) -> Lexicon:
    """Lexicon.learn over all rows of `texts`; only the words that are kept come to the driver."""

    def counted(batches, of):
        for pdf in batches:
            counts = Counter(x for t in pdf["text"] for x in of(t))
            yield pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["kind", "word", "n"])

    def count(of, least: float):
        parts = texts.select("text").mapInPandas(lambda batches: counted(batches, of), "kind string, word string, n long")
        return [(r.kind, r.word, r.n) for r in parts.groupBy("kind", "word").agg(F.sum("n").alias("n")).where(F.col("n") >= least).collect()]

    endings, firsts = Lexicon.known(count(heard, 2))
    common = count(lambda t: (("plain", w) for w in plain_words(t)), common_least(texts.count()))
    return Lexicon(endings, firsts, {w for _, w, _ in common})


def train(texts: DataFrame) -> Field:
    """A field fitted on the TRAIN_TEXTS texts with the smallest hashes, its lexicon counted over all; `texts` has a column text."""
    usable = texts.where("text IS NOT NULL AND length(text) BETWEEN 8 AND 20000").select("text", F.xxhash64("text").alias("h"))
    # the hash cuts the sample out where the rows lie, so that a driver gets about TRAIN_TEXTS rows from any number of partitions
    part = min(1.0, 1.3 * TRAIN_TEXTS / max(1, texts.count()))
    low = F.pmod("h", F.lit(1_000_000)) < int(part * 1_000_000) + 1
    sample = usable.where(low).orderBy("h", "text").limit(TRAIN_TEXTS)
    rows = [r.text for r in sample.collect()]
    return Field(learn_lexicon(texts.where("text IS NOT NULL"))).fit(rows)


def find(texts: DataFrame, field: Field) -> DataFrame:
    """(key columns, spans) of the texts with personal data; texts: key columns and text.

    Equal texts are searched once per row they stand in; null and blank texts
    have none. spans are (start, end, kind) in characters.
    """
    keys = [c for c in texts.columns if c != "text"]
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(field)  # bounded: BUCKETS x labels weights and the lexicon
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in texts.schema if f.name in keys]

    def run(batches):
        model = shared.value
        for pdf in batches:
            found = model.label(pdf["text"].tolist())
            hit = np.array([bool(x) for x in found], bool)
            out = pdf.loc[hit, [*keys, "text"]].astype(object)
            out["spans"] = pd.Series([[{"a": a, "b": b, "kind": k} for a, b, k in x] for x in found if x], dtype=object, index=out.index)
            yield out

    return texts.where("text IS NOT NULL AND trim(text) <> ''").mapInPandas(run, ", ".join([*fields, "text string", "spans array<struct<a:int,b:int,kind:string>>"]))


def redact(texts: DataFrame, field: Field) -> DataFrame:
    """The same rows with each span replaced by its kind's placeholder; the rest of a text, and null and blank texts, unchanged."""
    shared = texts.sparkSession.sparkContext.broadcast(field)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.schema)

    def run(batches):
        model = shared.value
        for pdf in batches:
            rows = pdf["text"].tolist()
            at = [i for i, t in enumerate(rows) if t and not t.isspace()]
            for i, spans in zip(at, model.label([rows[i] for i in at]), strict=True):
                for a, b, kind in reversed(spans):
                    rows[i] = rows[i][:a] + PLACEHOLDERS[kind] + rows[i][b:]
            pdf["text"] = pd.Series(rows, dtype=object, index=pdf.index)
            yield pdf

    return texts.mapInPandas(run, fields)


def all_texts(turns: DataFrame, messages: DataFrame, context: DataFrame) -> DataFrame:
    """(tab, rec, pos, text) of the three tables; messages belong to the conversation their parent belongs to."""
    text = lambda c: F.col(c).cast("string")
    a = turns.select(F.lit("turns").alias("tab"), text("file_path").alias("rec"), text("turn_idx").alias("pos"), F.col("content").alias("text"))
    placed = place_orphans(messages.select("conversation_id", "node_id", "parent", "children", "file_path", "content"))
    b = placed.select(F.lit("messages").alias("tab"), text("conversation_id").alias("rec"), text("node_id").alias("pos"), F.col("content").alias("text"))
    c = context.select("id", F.posexplode("turns").alias("i", "t")).select(F.lit("context_corpus").alias("tab"), text("id").alias("rec"), text("i").alias("pos"), F.col("t.content").alias("text"))
    return a.unionByName(b).unionByName(c)


def found(turns: DataFrame, messages: DataFrame, context: DataFrame) -> DataFrame:
    """(tab, rec, pos, kind): each kind of personal data in each text, once."""
    texts = all_texts(turns, messages, context)
    spans = find(texts, train(turns.select(F.col("content").alias("text")).unionByName(messages.select(F.col("content").alias("text")))))
    return spans.select("tab", "rec", "pos", F.explode(F.array_distinct("spans.kind")).alias("kind")).distinct()


def redacted(turns: DataFrame, messages: DataFrame, context: DataFrame) -> DataFrame:
    """(tab, rec, pos, text) with placeholders; repeated rows of a text come out once."""
    texts = all_texts(turns, messages, context)
    return redact(texts, train(turns.select(F.col("content").alias("text")).unionByName(messages.select(F.col("content").alias("text"))))).distinct()

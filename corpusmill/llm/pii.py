"""Personal data: e-mail addresses, IP addresses, card and phone numbers, as they are written or disguised.

Base matches come from the plain text. Disguised ones come from transducers: each rewrites a text and keeps where every piece
came from (`Rewritten`), so that a match in the last text is mapped back through all of them to a span of the source. One
replaces look-alike characters (and drops invisible ones), one turns spelled or letter-like digits into digits, one turns
disguised at signs and dots into `@` and `.`. A match of the rewritten text counts only if its source is written otherwise;
so a text without disguises gives its base matches and no more.

Spans are in code points, the end exclusive. All scans take time in proportion to the text (no repeated starts inside a run).

Defined results: null text is the empty text, which has no spans; null doc_id and repeated rows have a result each; further
columns are ignored (find_personal_data) or kept (redact); an empty table gives an empty result. Spans of different kinds may
overlap, and an added span may overlap a base one.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import own_columns, place, slices

KINDS = ("email", "ip", "card", "phone")


class Span(NamedTuple):
    kind: int
    start: int
    end: int
    base: bool
    value: str  # as it is read


# --- plain matches, leftmost and without overlap

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
DIGIT = re.compile(r"[0-9]")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    """A match's local part is all that its characters allow before an at sign, back to the match before."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        end = DOMAIN.match(text, at + 1) if start < at else None
        if end:
            last = end.end()
            found.append((start, last))
        at = text.find("@", max(at + 1, last))
    return found


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def ips(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in IP.finditer(text) if all(map(_small, m.group().split(".")))]


def luhn(digits: str) -> bool:
    """The check sum of card numbers."""
    own, doubled = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, own)) + sum(sum(divmod(2 * int(d), 10)) for d in doubled)) % 10 == 0


def cards(text: str) -> list[tuple[int, int]]:
    found = []
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(m.span())
    return found


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in PHONE.finditer(text) if 8 <= len(DIGIT.findall(m.group())) <= 15] if "+" in text else []


MATCHERS: tuple[Callable[[str], list[tuple[int, int]]], ...] = (emails, ips, cards, phones)


# --- transducers


class Rewritten:
    """A text after edits (start, end, replacement) of another; edits ascend and don't overlap."""

    def __init__(self, source: str, edits: list[tuple[int, int, str]]):
        self.edits, parts, at, size = edits, [], 0, 0
        self.begins: list[int] = []  # of the replacements in the new text
        for start, end, new in edits:
            parts += [source[at:start], new]
            size += start - at
            self.begins.append(size)
            size += len(new)
            at = end
        self.text = "".join([*parts, source[at:]]) if edits else source

    def _of(self, i: int) -> tuple[int, int]:
        """Where the i-th character came from."""
        k = bisect_right(self.begins, i) - 1
        if k < 0:
            return i, i + 1
        start, end, new = self.edits[k]
        past = i - self.begins[k] - len(new)
        return (start, end) if past < 0 else (end + past, end + past + 1)

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The span that a span came from."""
        return self._of(start)[0], self._of(end - 1)[1]


# Letters of other scripts that look like ASCII letters, script by script.
LOOK_ALIKE_LETTERS = {
    "Cyrillic": "аa еe іi јj кk мm оo рp сc тt уy хx ѕs һh ԁd ԛq ԝw ѵv ӏl З3 б6 АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT УY ХX ԚQ ԜW",
    "Greek": "αa εe ηn ιi κk νv οo ρp τt υu χx ωw ϲc ϳj ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX",
    "Armenian": "հh ոn սu օo յj",
    "Latin": "ıi ɑa ɡg ɩi ʏY",
}
# What looks like an at sign, a point, a hyphen or a plus sign.
LOOK_ALIKE_SIGNS = {"@": "ⓐⒶ", ".": "·∙⋅。｡․", "-": "‐‑‒–—―−﹣", "+": "﬩➕"}
# Characters that aren't seen.
INVISIBLE = "­͏᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤﻿"


@functools.lru_cache(maxsize=1)
def look_alikes() -> tuple[dict[str, str], re.Pattern]:
    """The ASCII character that each look-alike stands for ('' for unseen ones), and a pattern that finds them.

    Beside the tables above: whatever is compatible with one ASCII character (full-width, mathematical, circled, raised) and the
    decimal digits of all scripts.
    """
    found = {}
    for c in map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x20000))):
        plain = unicodedata.normalize("NFKC", c)
        if len(plain) == 1 and plain < "\x7f":
            found[c] = plain
        elif (digit := unicodedata.decimal(c, None)) is not None:
            found[c] = str(digit)
    found |= {pair[0]: pair[1] for pairs in LOOK_ALIKE_LETTERS.values() for pair in pairs.split()}
    found |= {c: plain for plain, chars in LOOK_ALIKE_SIGNS.items() for c in chars} | dict.fromkeys(INVISIBLE, "")
    points = sorted(map(ord, found))
    ranges, begin = [], points[0]
    for a, b in zip(points, [*points[1:], None]):
        if b != a + 1:
            ranges.append((begin, a))
            begin = b
    return found, re.compile("[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in ranges) + "]")


def folded(text: str) -> Rewritten:
    """The text with look-alikes replaced and unseen characters dropped."""
    if text.isascii():
        return Rewritten(text, [])
    plain, pattern = look_alikes()
    return Rewritten(text, [(m.start(), m.end(), plain[m.group()]) for m in pattern.finditer(text)])


# Digits as they are spelled, from zero, in English, German, French and Spanish; words for at and dot.
SPELLED_DIGITS = {
    "en": "zero one two three four five six seven eight nine",
    "de": "null eins zwei drei vier fünf sechs sieben acht neun",
    "fr": "zéro un deux trois quatre cinq six sept huit neuf",
    "es": "cero uno dos tres cuatro cinco seis siete ocho nueve",
}
OTHER_ZEROS = ("oh", "o", "nought", "naught")
TIMES = {"double": 2, "triple": 3}
AT_WORDS = ("at", "ät", "arroba", "arobase")
DOT_WORDS = ("dot", "punkt", "point", "punto")
SIGN_WORDS = {"underscore": "_", "hyphen": "-", "dash": "-"}
AT_CODES = ("&#64;", "&#x40;", "&commat;", "%40")
DOT_CODES = ("&#46;", "&#x2e;", "&period;", "%2e")

DIGIT_OF = {w: str(i) for words in SPELLED_DIGITS.values() for i, w in enumerate(words.split())}
_AT, _DOT = "|".join(AT_WORDS), "|".join(DOT_WORDS)
SPELLED = re.compile(rf"(?<![^\W_])(?:(?:({'|'.join(TIMES)}) {{1,2}})?({'|'.join([*DIGIT_OF, *OTHER_ZEROS])})|([0-9]++))(?![^\W_])", re.I)
#: What may be between digits that are spelled one after another; group 1 if it stands for a point.
BETWEEN = re.compile(rf" {{0,2}}[,()-]? {{0,2}}|( {{0,2}}\. {{0,2}}| {{1,3}}(?:{_DOT}) {{1,3}}| {{0,3}}[\[({{<] {{0,2}}(?:{_DOT}|\.) {{0,2}}[\])}}>] {{0,3}})", re.I)
PLUS = re.compile(r"(?:(?<![^\W_])plus|\+) {0,2}\(?\Z", re.I)
#: Fewer spelled digits than this in a row are words.
LEAST_SPELLED = 3
LETTERS = "OoIlSBZ"
LETTER_DIGITS = str.maketrans(LETTERS, "0011582")
GROUP = re.compile(rf"[0-9{LETTERS}]+")
NUMBER_LIKE = re.compile(rf"(?<![A-Za-z0-9])[0-9{LETTERS}]++(?![A-Za-z0-9])(?:[.() -]{{1,3}}[0-9{LETTERS}]++(?![A-Za-z0-9]))*+")


def _spelled_edits(text: str) -> list[tuple[int, int, str]]:
    edits: list[tuple[int, int, str]] = []

    def close() -> None:
        if sum(bool(m[2]) and m[2].lower() in DIGIT_OF for m, _ in run) < LEAST_SPELLED:
            return
        first = run[0][0].start()
        plus = PLUS.search(text, max(0, first - 9, edits[-1][1] if edits else 0), first)
        if plus:
            edits.append((plus.start(), first, "+"))
        at = first
        for m, point in run:
            if at < m.start():
                edits.append((at, m.start(), "." if point else ""))
            if m[2]:
                edits.append((m.start(), m.end(), DIGIT_OF.get(m[2].lower(), "0") * TIMES.get((m[1] or "").lower(), 1)))
            at = m.end()

    run: list[tuple[re.Match, bool]] = []
    for m in SPELLED.finditer(text):
        gap = BETWEEN.fullmatch(text, run[-1][0].end(), m.start()) if run and m.start() - run[-1][0].end() <= 20 else None
        if gap is None:
            if run:
                close()
            run = []
        run.append((m, bool(gap and gap[1])))
    if run:
        close()
    return edits


def spelled_digits(text: str) -> Rewritten:
    """Spelled digits in a row as digits, side by side; a point word between them as a point; a plus word before them as a sign."""
    lower = text.lower()
    return Rewritten(text, _spelled_edits(text) if sum(lower.count(w) for w in DIGIT_OF) >= LEAST_SPELLED else [])


def _belongs(text: str, start: int, end: int) -> bool:
    """Whether a group of letters alone is part of a number: signs tie it to one, or it is as long as a card's groups. (`I` and `Il` are words.)"""
    return end - start == 4 or text[start - 1 : start] in ("+", ".", "-", "(") or text[end : end + 1] in (".", "-", ")") and GROUP.match(text, end + 1) is not None


def letter_digits(text: str) -> Rewritten:
    """O and l and their like as digits, in numbers of which at least half the characters are digits."""
    edits = []
    if DIGIT.search(text):
        for m in NUMBER_LIKE.finditer(text):
            groups = [g for g in GROUP.finditer(text, m.start(), m.end()) if DIGIT.search(g.group()) or _belongs(text, *g.span())]
            letters = [i for g in groups for i in range(*g.span()) if text[i] in LETTERS]
            if letters and sum(g.end() - g.start() for g in groups) >= 2 * len(letters):
                edits += [(i, i + 1, text[i].translate(LETTER_DIGITS)) for i in letters]
    return Rewritten(text, edits)


POINT_IN_NUMBER = re.compile(rf"(?<=[0-9])(?: {{1,3}}(?:{_DOT}|\.) {{1,3}}| {{0,3}}[\[({{<] {{0,2}}(?:{_DOT}|\.) {{0,2}}[\])}}>] {{0,3}})(?=[0-9])", re.I)


def points_in_numbers(text: str) -> Rewritten:
    """Disguised points between digits."""
    return Rewritten(text, [(*m.span(), ".") for m in POINT_IN_NUMBER.finditer(text)] if DIGIT.search(text) else [])


BRACKETED_AT = re.compile(rf"[\[({{<] {{0,2}}(?:{_AT}|@) {{0,2}}[\])}}>]", re.I)
BRACKETED_DOT = re.compile(rf"[\[({{<] {{0,2}}(?:{_DOT}|\.) {{0,2}}[\])}}>]", re.I)
#: Groups: an at sign in brackets, spaces or as a code; a spelled one; a point in brackets or as a code; a spelled or spaced one; another sign's name.
MARK = re.compile(
    rf"( {{0,3}}[\[({{<] {{0,2}}(?:{_AT}|@) {{0,2}}[\])}}>] {{0,3}}| {{1,3}}@ {{1,3}}|{'|'.join(AT_CODES)})|((?<=[A-Za-z0-9])(?: {{1,3}}(?:{_AT}) {{1,3}}| {{0,3}}([_*~-])(?:{_AT})\3 {{0,3}})(?=[A-Za-z0-9]))"
    rf"|( {{0,3}}[\[({{<] {{0,2}}(?:{_DOT}|\.) {{0,2}}[\])}}>] {{0,3}}|{'|'.join(DOT_CODES)})|((?<=[A-Za-z0-9])(?: {{1,3}}(?:{_DOT}|\.) {{1,3}}| {{0,3}}([_*~-])(?:{_DOT})\6 {{0,3}})(?=[A-Za-z0-9]))"
    rf"|(?<=[A-Za-z0-9]) {{1,3}}({'|'.join(SIGN_WORDS)}) {{1,3}}(?=[A-Za-z0-9])",
    re.I,
)


@dataclass
class Marked:
    """A text with at signs and points put in; `spelled` has the places, in the new text, of those that were bare words."""

    rewritten: Rewritten
    at_words: set[int]
    points: set[int]


def marked(text: str) -> Marked:
    found = list(MARK.finditer(text))
    out = Rewritten(text, [(*m.span(), "@" if m[1] or m[2] else SIGN_WORDS[m[7].lower()] if m[7] else ".") for m in found])
    upper = lambda m: m[2] and m[2].strip(" _*~-").isupper()  # noqa: E731  AT among small letters is meant
    return Marked(out, {b for b, m in zip(out.begins, found) if m[2] and not (upper(m) and text[m.start() - 1].islower())}, {b for b, m in zip(out.begins, found) if m[4] or m[5]})


def _may_hide_email(text: str, changed: bool) -> bool:
    if BRACKETED_AT.search(text):
        return True
    lower = text.lower()
    if any(x in lower for x in AT_CODES):
        return True
    dots = any(w in lower for w in (*DOT_WORDS, *DOT_CODES))
    if "@" in text:
        return changed or dots or " @ " in text or " . " in text or bool(BRACKETED_DOT.search(text))
    return dots and any(w in lower for w in AT_WORDS) or any(f" {w.upper()} " in text for w in AT_WORDS)


def find(text: str) -> list[Span]:
    """All spans of a text, by kind, then place."""
    base = [Span(kind, s, e, True, text[s:e]) for kind, match in enumerate(MATCHERS) for s, e in match(text)] if DIGIT.search(text) or "@" in text else []
    known = {x[:3] for x in base}
    added = set()
    plain = folded(text)

    def add(kind: int, stages: list[Rewritten], start: int, end: int) -> None:
        value = stages[-1].text[start:end]
        for stage in reversed(stages):
            start, end = stage.source(start, end)
        if text[start:end] != value and (kind, start, end) not in known:
            added.add(Span(kind, start, end, False, value))

    if _may_hide_email(plain.text, bool(plain.edits)):
        marks = marked(plain.text)
        for start, end in emails(marks.rewritten.text):
            at = marks.rewritten.text.rindex("@", start, end)
            if at not in marks.at_words or any(at < p < end for p in marks.points):
                add(0, [plain, marks.rewritten], start, end)
    spelled = spelled_digits(plain.text)
    letters = letter_digits(spelled.text)
    points = points_in_numbers(letters.text)
    stages = [plain, spelled, letters, points]
    if any(x.edits for x in stages) and DIGIT.search(points.text):
        for kind, match in list(enumerate(MATCHERS))[1:]:
            for start, end in match(points.text):
                add(kind, stages, start, end)
    return sorted([*base, *added])


SPANS = "array<struct<kind:string,start:int,end:int,base:boolean,value:string>>"
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("value", pa.string())])


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans: kind, start, end (code points), base (found as it is written) and value (as it is read) of each, by kind and place."""
    own = own_columns(docs, doc_id=id_col, text=text_col).selectExpr("CAST(doc_id AS BIGINT) doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                spans = [[{"kind": KINDS[x.kind], "start": x.start, "end": x.end, "base": x.base, "value": x.value} for x in find(t)] if t else [] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spans, pa.list_(_SPAN))], ["doc_id", "spans"])

    return own.mapInArrow(run, f"doc_id long, spans {SPANS}")


def redacted(text: str) -> str:
    """The text with its spans, where they overlap joined to one, replaced by the kind of the first."""
    parts, at = [], 0
    for x in sorted(find(text), key=lambda x: (x.start, -x.end)):
        if x.start >= at:
            parts += [text[at : x.start], f"[{KINDS[x.kind].upper()}]"]
        at = max(at, x.end)
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with personal data replaced by [EMAIL], [IP], [CARD] or [PHONE]; null stays null."""
    names = docs.columns
    at = place(names, text_col)
    plain = docs.toDF(*[f"c{i}_" for i in range(len(names))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                texts = pa.array([t and redacted(t) for t in part.column(at).to_pylist()], pa.string())
                yield part.set_column(at, part.schema.field(at).with_type(pa.string()), texts)

    return plain.mapInArrow(run, plain.schema).toDF(*names)


def digests(found: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, the SHA-256 of the base spans, all spans as `kind:start:end`, and how many were added."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), (F.size("spans") - F.size(base)).cast("long").alias("n_added"))

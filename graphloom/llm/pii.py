"""Personal data, also where it is disguised, with offsets into the source text.

Base detectors read the text as it stands. Then a chain of transducers rewrites
a disguised text - look-alike characters, spelled digits, "at" and "dot" in words
or brackets - and keeps for each character it writes the source span it stands
for. What the detectors find in the rewritten text is mapped back to the source;
a span is added where no base span lies. A text that holds nothing a transducer
would touch is not rewritten.

Defined results: a null text is the empty text, without spans; repeated rows
give repeated results; an empty table gives an empty result; a carried column
named ``spans`` is replaced, all others are carried along, whatever their names.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.store import slices

KINDS = ("email", "ip", "card", "phone")

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_LOCAL_RUN = re.compile(r"[A-Za-z0-9._%+-]++\Z")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_DIGIT = re.compile(r"[0-9]")


def _emails(text: str) -> list[tuple[int, int]]:
    """Anchored at the @: the local part is the longest run before it that no earlier match reaches."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(text, start - 1):
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            found.append((start, end := m.end()))
        at = text.find("@", max(at + 1, end))
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def detect(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the plain identifiers, by kind and then start; what fails its test is dropped."""
    spans = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        spans += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in m.groups())]
        for m in _CARD.finditer(text):
            if 16 <= len(m[0]) and 16 <= len(digits := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
                spans.append(("card", m.start(), m.end()))
        if "+" in text:
            spans += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return spans


#: Letters of other scripts that look like Latin ones. Fixed values.
_LOOKALIKE = dict(zip("АВЕКМНОРСТУХЅІЈаеорсухѕіјԁԛԝһΑΒΕΖΗΙΚΜΝΟΡΤΥΧονιαρ", "ABEKMHOPCTYXSIJaeopcyxsijdqwhABEZHIKMNOPTYXoviap", strict=True)) | dict.fromkeys("\u2010\u2011\u2012\u2212", "-")
_ZERO_WIDTH = "\u200b\u200c\u200d\u2060\ufeff\u00ad"
#: Names of digits in four languages and how at, dot, plus and dash are said. Fixed values.
_DIGITS = {
    "zero": "0", "oh": "0", "null": "0", "cero": "0", "zéro": "0",
    "one": "1", "eins": "1", "uno": "1", "un": "1",
    "two": "2", "zwei": "2", "zwo": "2", "dos": "2", "deux": "2",
    "three": "3", "drei": "3", "tres": "3", "trois": "3",
    "four": "4", "vier": "4", "cuatro": "4", "quatre": "4",
    "five": "5", "fünf": "5", "cinco": "5", "cinq": "5",
    "six": "6", "sechs": "6", "seis": "6",
    "seven": "7", "sieben": "7", "siete": "7", "sept": "7",
    "eight": "8", "acht": "8", "ocho": "8", "huit": "8",
    "nine": "9", "neun": "9", "nueve": "9", "neuf": "9",
}
_AT, _DOT = r"(?:at|ät|arroba|arobase|klammeraffe|@)", r"(?:dot|punkt|punto|point|\.)"
_OPEN, _CLOSE = r"[\[({<]\s{0,3}", r"\s{0,3}[\])}>]"
_NAME = r"(?<![^\W_])(?:" + "|".join(sorted(_DIGITS, key=len, reverse=True)) + r")(?![^\W_])"
#: Four digits at least stand in a row, one of them spelled; a lone number word is prose.
_SPELLED = re.compile(rf"(?:{_NAME}|[0-9])(?:[\s,-]{{1,3}}(?:{_NAME}|[0-9])|[0-9]){{3,}}", re.I)
_ONE_NAME = re.compile(_NAME, re.I)
_ATS = re.compile(rf"\s{{0,3}}{_OPEN}{_AT}{_CLOSE}\s{{0,3}}", re.I)
_DOTS = re.compile(rf"\s{{0,3}}{_OPEN}{_DOT}{_CLOSE}\s{{0,3}}", re.I)
#: Without brackets only a whole address counts: a name, at, a host, dot, an ending; at or a dot has to be spelled or spaced.
_INNER = rf"[A-Za-z0-9-]{{1,63}}(?:(?:\s+{_DOT}\s+|\s?\.\s?)[A-Za-z0-9-]{{1,63}}){{0,5}}"
_SAID = re.compile(
    rf"(?<![A-Za-z0-9._%+-])(?P<name>(?:[A-Za-z0-9_%+-]{{1,64}}\s+{_DOT}\s+){{0,3}}[A-Za-z0-9._%+-]{{1,64}})"
    rf"(?:(?P<at>\s+{_AT}\s+|\s+@|@\s+){_INNER}(?:\s+{_DOT}\s+|(?P<plain>\.))|(?P<sign>@){_INNER}\s+{_DOT}\s+)[A-Za-z]{{2,24}}(?![A-Za-z])",
    re.I,
)
#: Words before "at" and a plain host name that are prose and no name.
_PROSE = frozenset("us me him her it them you look looking looks find found visit visited available hosted more online site page here there and or email mail e-mail contact reach read see is are was were be been live based documented published posted up down start meet arrive check out now today directly".split())
_SAID_DOT = re.compile(rf"\s+{_DOT}\s+|\s\.\s?|\.\s", re.I)
_SAID_IP = re.compile(rf"(?<![0-9])[0-9]{{1,3}}(?:\s+{_DOT}\s+[0-9]{{1,3}}){{3}}(?![0-9])", re.I)
_PLUS = re.compile(r"(?<![^\W_])(?:plus|más|mas)\s+(?=[0-9])", re.I)
_WORD = re.compile(r"[^\W_]+")
_BRACKETED = re.compile(rf"{_OPEN}(?:{_AT}|{_DOT}){_CLOSE}", re.I)


class Rewriting:
    """A text and, for each of its characters, the source span it stands for."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, list(range(len(text))), list(range(1, len(text) + 1))

    def apply(self, edits: list[tuple[int, int, str]]) -> None:
        """Replaces the spans of ``edits`` (ascending, apart); all new characters stand for the whole span."""
        if not edits:
            return
        text, start, end, at = [], [], [], 0
        for a, b, new in edits:
            text += [self.text[at:a], new]
            start += self.start[at:a] + [self.start[a]] * len(new)
            end += self.end[at:a] + [self.end[b - 1]] * len(new)
            at = b
        self.text = "".join([*text, self.text[at:]])
        self.start, self.end = start + self.start[at:], end + self.end[at:]


def _fold(c: str) -> str | None:
    """The ASCII character that ``c`` disguises, nothing for zero-width ones, None for all others."""
    if c in _ZERO_WIDTH:
        return ""
    if c in _LOOKALIKE:
        return _LOOKALIKE[c]
    if c.isdigit():
        return str(unicodedata.digit(c))
    plain = unicodedata.normalize("NFKC", c)
    return plain if len(plain) == 1 and " " < plain <= "~" else None


def _characters(text: str) -> list[tuple[int, int, str]]:
    found = {c: new for c in set(text) if c > "\x7f" and (new := _fold(c)) is not None}
    return [(i, i + 1, found[c]) for i, c in enumerate(text) if c in found] if found else []


def _spelled(text: str) -> list[tuple[int, int, str]]:
    """In a row of digits the names become digits, and the gaps beside a name go."""
    edits = []
    for m in _SPELLED.finditer(text):
        at = m.start()
        names = list(_ONE_NAME.finditer(text, m.start(), m.end()))
        for n in names:
            edits.append((n.start() if n.start() == at or not text[at : n.start()].strip(" \t\n,-") == "" else at, n.end(), _DIGITS[n[0].lower()]))
            at = n.end()
    return edits


def _said(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for m in _SAID.finditer(text):
        at = "sign" if m["sign"] else "at"
        if m["plain"] and "@" not in m["at"] and m["name"].lower() in _PROSE:
            continue
        edits += [(*d.span(), ".") for d in _SAID_DOT.finditer(text, *m.span("name"))]
        if not m["sign"]:
            edits.append((*m.span(at), "@"))
        edits += [(*d.span(), ".") for d in _SAID_DOT.finditer(text, m.end(at), m.end())]
    return edits


#: Each reads a text and gives edits; they run in this order.
TRANSDUCERS = (
    _characters,
    lambda t: [(*m.span(), "@") for m in _ATS.finditer(t)],
    lambda t: [(*m.span(), ".") for m in _DOTS.finditer(t)],
    _spelled,
    _said,
    lambda t: [(*d.span(), ".") for m in _SAID_IP.finditer(t) for d in _SAID_DOT.finditer(t, m.start(), m.end())],
    lambda t: [(*m.span(), "+") for m in _PLUS.finditer(t)],
)


def _touched(text: str) -> bool:
    """Whether some transducer would rewrite the text; cheap tests first."""
    if not text.isascii() and _characters(text):
        return True
    if any(c in text for c in "[({<") and _BRACKETED.search(text):
        return True
    if _DIGIT.search(text) and (_SAID_IP.search(text) or _PLUS.search(text)):
        return True
    return bool(_said(text) or _names_in_row(text) and _spelled(text))


def _names_in_row(text: str) -> bool:
    """Whether a word that names a digit stands beside another or beside a number, as in all rows; plain word tests, as most texts hold none."""
    words = _WORD.findall(text.lower())
    if _DIGITS.keys().isdisjoint(words):
        return False
    before, named = "", False
    for w in words:
        name = w in _DIGITS
        if name and (named or _DIGIT.search(before)) or named and _DIGIT.search(w):
            return True
        before, named = w, name
    return False


def _lone(beside: str) -> bool:
    """Whether what stands beside a plain number is nothing or a single word for a digit, which may as well be prose."""
    return len(_ONE_NAME.findall(beside)) <= 1 and not _ONE_NAME.sub("", beside).strip(" \t\n,-")


def _meeting(starts: list[int], ends: list[int], x: int, y: int) -> Iterator[tuple[int, int]]:
    """The spans, sorted and apart, that meet the one from ``x`` to ``y``."""
    i = bisect_right(ends, x)
    while i < len(starts) and starts[i] < y:
        yield starts[i], ends[i]
        i += 1


def find(text: str | None) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, base) by kind as listed, then start; offsets are code points of the source."""
    text = text or ""
    base = detect(text)
    spans = [(*s, True) for s in base]
    if _touched(text):
        out = Rewriting(text)
        for transducer in TRANSDUCERS:
            out.apply(transducer(out.text))
        if out.text != text:
            # the spans of a kind lie apart and come in order, base ones and added ones
            known = {(k, own): ([], []) for k in KINDS for own in (True, False)}
            for kind, a, b, _ in spans:
                for side, at in zip(known[kind, True], (a, b)):
                    side.append(at)
            for kind, a, b in detect(out.text):
                x, y = out.start[a], out.end[b - 1]
                # what lies in a span is known; what reaches beyond one of its kind is the whole of which that was a part
                if all(k == kind and not (p <= x and y <= q or _lone(text[x:p]) and _lone(text[q:y])) for (k, _), sides in known.items() for p, q in _meeting(*sides, x, y)):
                    spans.append((kind, x, y, False))
                    for side, at in zip(known[kind, False], (x, y)):
                        side.append(at)
    return sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1]))


def detect_spans(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` with ``spans``: an array of (kind, start, end, base)."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != "spans"]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def run(batches):
        for part in slices(batches, "text"):
            found = [[dict(zip(("kind", "start", "end", "base"), s)) for s in find(t)] for t in part.column("text").to_pylist()]
            yield pa.record_batch([part.column("row"), pa.array(found, kind)], ["row", "spans"])

    # the kept columns stand in a struct, so that no name of theirs meets another
    row = F.struct(*(F.col(c) for c in keep)) if keep else F.struct(F.lit(None).cast("int").alias("none"))
    read = docs.select(row.alias("row"), F.col(text).cast("string").alias("text"))
    out = read.mapInArrow(run, f"row {read.schema['row'].dataType.simpleString()}, spans array<struct<kind: string, start: long, end: long, base: boolean>>")
    return out.select(*(F.col("row").getField(c).alias(c) for c in keep), "spans")


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets, from the last to the first."""
    ordered = F.array_sort(spans, lambda a, b: (b["start"] - a["start"]).cast("int"))
    return F.aggregate(ordered, text, lambda t, s: F.concat(F.substring(t, F.lit(1), s["start"].cast("int")), F.lit("<"), s["kind"], F.lit(">"), F.substr(t, s["end"].cast("int") + 1)))

"""PII: identifiers found through their disguises, each span kept as places of the source text.

A text runs through two transducers. The first replaces homoglyphs, one character for one,
so places stay. The second rewrites spelled digits, at/dot disguises and invisible
characters, and notes for each piece it writes where the piece comes from. Identifiers are
detected in the text as it is (base spans) and in the normalised one; spans of the latter
are mapped back to the source and added, unless a base span of their kind holds them.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwright.llm.workspace import unused

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
# a run of digits that isn't followed by what is asked for fails from each of its digits,
# so runs are taken whole and tried once
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The signs are sought, and the run before each: long runs without a sign cost nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin, step = at, 32
        while begin > done:  # back to the last character that can't belong to the local part, the last sign included
            lo = max(done, begin - step)
            other = max((m.end() for m in _NOT_LOCAL.finditer(text, lo, begin)), default=lo)
            begin, step = other, 2 * step
            if other > lo:
                break
        domain = _DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            yield begin, domain.end()
            at = domain.end() - 1
        done = max(done, at + 1)
        at = text.find("@", done)


def base_spans(text: str) -> list[Span]:
    """Identifiers as they stand, leftmost and non-overlapping within a kind, by start and kind."""
    found = [(a, 0, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.groups())]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(digits := re.sub("[ -]", "", m[0])) <= 19 and _luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return [(KINDS[k], a, b) for a, k, b in sorted(found)]


# Letters of other scripts that look like these, and signs that stand for signs.
_LOOKALIKES = {
    "a": "аαɑ", "b": "Ь", "c": "сϲ", "d": "ԁ", "e": "еєҽ", "g": "ɡ", "h": "һ", "i": "іιı", "j": "јϳ", "k": "кκ",
    "l": "ӏ", "m": "м", "n": "ո", "o": "оοօ", "p": "рρ", "q": "ԛ", "r": "г", "s": "ѕ", "t": "тτ", "u": "υս", "v": "νѵ", "w": "ԝ", "x": "хχ", "y": "уү",
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "H": "НΗ", "I": "ІΙӀ", "J": "Ј", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟ", "P": "РΡ",
    "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Y": "ΥҮ", "Z": "Ζ", ".": "。｡․·•", "-": "‐‑‒–—―−", "+": "➕",
}
_SAME = {ord(other): plain for plain, others in _LOOKALIKES.items() for other in others}
_KNOWN: dict[str, str | None] = {}


def _plain(c: str) -> str | None:
    """The ASCII character that c stands for, if it is one; digits of all scripts are digits."""
    if c not in _KNOWN:
        digit = unicodedata.digit(c, None)
        simple = str(digit) if digit is not None else _SAME.get(ord(c)) or unicodedata.normalize("NFKC", c)
        _KNOWN[c] = simple if len(simple) == 1 and simple.isascii() else None
    return _KNOWN[c]


# letters that look like digits, among digits
_AMONG_DIGITS = re.compile(r"(?:(?<=[0-9])|(?<=[0-9][ .-])|(?<![A-Za-z0-9.@_+-])(?=[OoIl|]+[0-9]))[OoIl|]+(?=[ ().-]{0,2}[0-9])|(?<=[0-9OoIl|][0-9])[OoIl|]+(?![A-Za-z0-9])")
_AS_DIGITS = str.maketrans("OoIl|", "00111")
_SPELLED_NUMBER = re.compile(r"[0-9][OoIl| .-]{1,8}[0-9]|[OIl|][0-9]{2}|[0-9OoIl|][0-9][OoIl|]")


def homoglyphs(text: str) -> str:
    """The first transducer: as many characters as text has, look-alikes made plain."""
    if not text.isascii():
        table = {ord(c): p for c in set(text) if not c.isascii() and (p := _plain(c))}
        text = text.translate(table) if table else text
    if _SPELLED_NUMBER.search(text):
        text = _AMONG_DIGITS.sub(lambda m: m[0].translate(_AS_DIGITS), text)
    return text


# The digits 0 to 9 as words, in the languages of the texts.
_DIGIT_WORDS = (
    "zero one two three four five six seven eight nine",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
    "zero uno due tre quattro cinque sei sette otto nove",
)
_DIGITS = {w: str(d) for words in _DIGIT_WORDS for d, w in enumerate(words.split())} | {"oh": "0", "fuenf": "5"}
# How often a digit is meant, words for signs, domains that words alone may spell, words that are no host.
_TIMES = {"double": 2, "triple": 3}
_DOT_WORDS, _AT_WORDS = "dot|punkt|punto|point", "at|arroba|chiocciola|arobase|klammeraffe"
_TOP = "com|org|net|edu|gov|mil|int|info|biz|io|ai|app|dev|co|me|tv|uk|us|ca|au|de|at|ch|fr|be|es|it|nl|se|no|dk|fi|pl|pt|br|mx|jp|cn|in|ru|eu|test|example|invalid|local"
_NO_HOST = "the|a|an|this|that|these|those|each|every|our|your|its|my|his|her|their"

_WORD = "|".join(sorted(map(re.escape, _DIGITS), key=len, reverse=True))
_ALONE = r"(?![^\W_])"
_ATOM = rf"(?:[0-9]++|(?<![^\W_])(?:(?:(?:{'|'.join(_TIMES)})[ \t]{{1,3}})?(?:{_WORD})|{_DOT_WORDS}|plus){_ALONE})"
_GAP = r"[ \t]{0,3}+(?:,|-|\n)?+[ \t]{0,3}+"
_NUMBER = re.compile(rf"{_ATOM}(?:{_GAP}{_ATOM})++", re.I)
_NUMBER_WORDS = {*_DIGITS, *_TIMES, *_DOT_WORDS.split("|"), "plus"}
_PART = re.compile(_ATOM, re.I)

_OPEN, _CLOSE = r"[\[({<][ \t]{0,3}", r"[ \t]{0,3}[\])}>]"
_SIGNS = re.compile(
    rf"(?P<at>[ \t]{{0,3}}{_OPEN}(?:{_AT_WORDS}|@){_CLOSE}[ \t]{{0,3}}|&\#64;|&commat;|%40)|(?P<dot>[ \t]{{0,3}}{_OPEN}(?:{_DOT_WORDS}|\.){_CLOSE}[ \t]{{0,3}}|&\#46;|&period;)"
    rf"|(?P<sign>(?<=\w)[ \t]{{1,3}}@[ \t]{{1,3}}(?=\w))|(?P<none>[\u00AD\u200B-\u200F\u2060\uFEFF]+)",
    re.I,
)
_SIGN_HINT = re.compile(rf"&(?:\#(?:64|46)|commat|period);|%40|{_OPEN}(?:{_AT_WORDS}|{_DOT_WORDS}|@|\.){_CLOSE}|[ \t]@[ \t]|[\u00AD\u200B-\u200F\u2060\uFEFF]", re.I)
_LABEL = r"[A-Za-z0-9-]+"
_DOT = rf"(?:[ \t]{{1,3}}(?:{_DOT_WORDS})[ \t]{{1,3}}|_(?:{_DOT_WORDS})_)"
_ANY_DOT = rf"(?:{_DOT}|[ \t]{{1,3}}\.[ \t]{{1,3}})"  # where the other sign is certain
# words alone are a disguise only where both signs are words and the domain is a known one, or where the sign is certain
_SAID = re.compile(
    rf"(?<![\w.@%+-])(?P<local>[A-Za-z0-9%+-]+(?:[._][A-Za-z0-9%+-]+){{0,6}}?(?:{_DOT}[A-Za-z0-9%+-]+(?:\.[A-Za-z0-9%+-]+){{0,3}}){{0,4}})(?P<at>[ \t]{{1,3}}(?:{_AT_WORDS})[ \t]{{1,3}}|_(?:{_AT_WORDS})_)(?!(?:{_NO_HOST})[ \t])"
    rf"(?P<host>{_LABEL}(?:(?:{_DOT}|\.){_LABEL}){{0,6}}{_DOT}(?:{_TOP}))(?![\w-])",
    re.I,
)
# a name of letters with figures or signs, before a word for the sign and a plain domain
_NAMED = re.compile(rf"(?<![\w.@%+-])(?=[A-Za-z0-9._+-]{{0,64}}[A-Za-z])(?=[A-Za-z+-]{{0,64}}[0-9._])[A-Za-z0-9._+-]*[A-Za-z0-9](?P<at>[ \t]{{1,3}}(?:{_AT_WORDS})[ \t]{{1,3}}){_LABEL}(?:\.{_LABEL}){{0,6}}\.(?:{_TOP})(?![\w-])", re.I)
_AFTER_AT = re.compile(rf"(?<=@){_LABEL}(?:(?:{_ANY_DOT}|\.){_LABEL}){{0,6}}{_ANY_DOT}(?:{_TOP})(?![\w-])", re.I)
_DOT_ONLY = re.compile(_ANY_DOT, re.I)


class Written:
    """A rewritten text that knows where each of its characters comes from."""

    def __init__(self, text: str, edits: list[tuple[int, int, str]]):
        """edits: (start, end, what stands there instead), in order; one that begins within another is left out."""
        pieces, done, at = [], 0, 0
        self._begin, self._from, self._to = [], [], []  # by piece: its place here, its source, or where the source of all of it ends
        for start, end, new in edits:
            if start < done:
                continue
            for piece, source, stop in ((text[done:start], done, None), (new, start, end)):
                if piece:
                    self._begin.append(at)
                    self._from.append(source)
                    self._to.append(stop)
                    pieces.append(piece)
                    at += len(piece)
            done = end
        self._begin.append(at)
        self._from.append(done)
        self._to.append(None)
        pieces.append(text[done:])
        self.text = "".join(pieces)

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The span of the text before that the characters start to end come from."""
        a, b = bisect_right(self._begin, start) - 1, bisect_right(self._begin, end - 1) - 1
        first = self._from[a] if self._to[a] is not None else self._from[a] + start - self._begin[a]
        last = self._to[b] if self._to[b] is not None else self._from[b] + end - self._begin[b]
        return first, last


def _signs(text: str) -> list[tuple[int, int, str]]:
    """Bracketed signs, signs between spaces, and characters that aren't seen."""
    if not _SIGN_HINT.search(text):
        return []
    return [(m.start(), m.end(), {"at": "@", "sign": "@", "dot": ".", "none": ""}[m.lastgroup]) for m in _SIGNS.finditer(text)]


def _said(text: str) -> list[tuple[int, int, str]]:
    """Signs that are words, in what reads as an address."""
    low = text.lower()
    edits = [(m.start("at"), m.end("at"), "@") for m in _NAMED.finditer(text)] if any(f" {w} " in low for w in _AT_WORDS.split("|")) else []
    if not any(w in low for w in (*_DOT_WORDS.split("|"), " .")):
        return edits
    for m in _SAID.finditer(text):
        edits += [(d.start(), d.end(), ".") for d in _DOT_ONLY.finditer(text, m.start("local"), m.end("local"))]
        edits.append((m.start("at"), m.end("at"), "@"))
        edits += [(d.start(), d.end(), ".") for d in _DOT_ONLY.finditer(text, m.start("host"), m.end("host"))]
    if "@" in text:
        edits += [(d.start(), d.end(), ".") for m in _AFTER_AT.finditer(text) for d in _DOT_ONLY.finditer(text, m.start(), m.end())]
    return sorted(set(edits))


def _numbers(text: str) -> list[tuple[int, int, str]]:
    """Digits and signs of numbers that are words; what stands between a word and its neighbour goes."""
    words = _apart(text.lower())
    if not any(w in _NUMBER_WORDS and (_counts(words[i - 1 : i]) or _counts(words[i + 1 : i + 2])) for i, w in enumerate(words)):
        return []
    edits = []
    for m in _NUMBER.finditer(text):
        atoms = [(p.start(), p.end(), _meant(p[0])) for p in _PART.finditer(text, m.start(), m.end())]
        # a lone word at an edge beside figures is prose: "555 0123 one day"
        if len(atoms) > 1 and atoms[0][2] not in ("", "+") and not atoms[1][2]:
            atoms = atoms[1:]
        if len(atoms) > 1 and atoms[-1][2] and not atoms[-2][2]:
            atoms.pop()
        for k, (a, b, meant) in enumerate(atoms):
            if meant:
                edits.append((a, b, meant))
            if k and (meant or atoms[k - 1][2]) and a > atoms[k - 1][1]:
                edits.append((atoms[k - 1][1], a, ""))
    return sorted(edits)


def _apart(low: str) -> list[str]:
    for sign in ".,-()+":
        low = low.replace(sign, " ")
    return low.split()


def _counts(word: list[str]) -> bool:
    return bool(word) and (word[0] in _NUMBER_WORDS or word[0][0].isdigit())


def _meant(atom: str) -> str:
    """What a word of a number stands for; nothing for figures."""
    low = atom.lower()
    if low.isdigit():
        return ""
    words = low.split()
    if words[-1] in _DIGITS:
        return _DIGITS[words[-1]] * (_TIMES[words[0]] if len(words) > 1 else 1)
    return "+" if low == "plus" else "."


def find_in(text: str | None) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, base) of all identifiers, by start, kind and end; null has none."""
    if not text:
        return []
    base = base_spans(text)
    written, steps = homoglyphs(text), []
    changed = written is not text
    for transducer in (_signs, _said, _numbers):
        if edits := transducer(written):
            steps.append(Written(written, edits))
            written, changed = steps[-1].text, True
    out = {(k, a, b): True for k, a, b in base}
    if changed:
        for kind, a, b in base_spans(written):
            for step in reversed(steps):
                a, b = step.source(a, b)
            if not any(k == kind and x <= a and b <= y for k, x, y in base):
                out.setdefault((kind, a, b), False)
    return [(k, a, b, known) for (k, a, b), known in sorted(out.items(), key=lambda x: (x[0][1], KINDS.index(x[0][0]), x[0][2]))]


_FOUND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))


def _finder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column(batch.num_columns - 1)
        found = [[dict(zip(("kind", "start", "end", "base"), s)) for s in find_in(text[i].as_py())] for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, _FOUND)], names=[*batch.schema.names[:-1], "pii"])


def find_pii(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs``' columns ``keep`` (default: all) with pii, an array of (kind, start, end, base).

    start and end are code points of the text, end exclusive; base marks what stands plainly,
    the rest was found through a disguise. Sorted by start, kind (email, ip, card, phone) and
    end.

    Defined results: a null or empty text has an empty array; repeated rows are searched
    each; texts of any length are searched whole, in time that grows with their length; an
    empty table gives no rows; an input column called pii is replaced.
    """
    keep = [c for c in (keep if keep is not None else docs.columns) if c.lower() != "pii"]
    held = unused(docs, "__text")
    rows = docs.select(*keep, F.col(text).cast("string").alias(held))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), "pii array<struct<kind:string,start:int,end:int,base:boolean>>"])
    return rows.mapInArrow(_finder, schema)


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, pii: Column) -> Column:
    """A text with every identifier replaced by its kind in brackets; of overlapping spans the first one is."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        begin = F.greatest(acc["at"], s["start"])
        sign = F.when(s["start"] >= acc["at"], F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("")
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, begin - acc["at"]), sign).alias("out"))

    return F.aggregate(pii, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))

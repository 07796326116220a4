"""Operator 9, personal data: detection in the text and in an offset-preserving normalised form of it.

Transducers rewrite a text in turn: single characters (homoglyphs, full-width and other decimal digits, invisible
characters), spelled digits, at/dot disguises, in which spelled, bracketed, bare and plain forms may be mixed. A number
may end where a plain one begins or go on in it, so a text has up to three such readings. Each output character keeps the source interval that it came from, so a
span found in the normalised text goes back to source characters. Such a span counts only if it holds something that was
rewritten and doesn't lie within a base span of its kind; base spans always stay.

Bare at and dot are English; digits may be spelled in English, French, German or Spanish, and bracketed forms of at and
dot in these too.

Defined results: a null or empty text has no spans; a very long text takes time in proportion to its length; of spans of
one kind that start together the longer one counts; repeated rows give repeated results; scanning ignores columns besides
doc_id and text, and masking carries them along, whatever their names; an empty table gives no rows. Spans are in code
points, end exclusive.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  in_blocks uses it
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quire.llm.common import columns, in_blocks

KINDS = ["email", "ip", "card", "phone"]
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?+[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Letters of other scripts that look like Latin letters, with those letters.
LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "ⅼ": "l",
    "․": ".", "。": ".", "‐": "-", "‑": "-", "−": "-", " ": " ",
}
INVISIBLE = "​‌‍⁠﻿­"
# The digits from 0 to 9 in the corpus's languages, and the words for at and dot.
SPELLED = [
    ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"],
    ["zéro", "un", "deux", "trois", "quatre", "cinq", "six", "sept", "huit", "neuf"],
    ["null", "eins", "zwei", "drei", "vier", "fünf", "sechs", "sieben", "acht", "neun"],
    ["cero", "uno", "dos", "tres", "cuatro", "cinco", "seis", "siete", "ocho", "nueve"],
]
AT, DOT = ["at", "arobase", "arroba"], ["dot", "point", "punkt", "punto"]
DIGITS = {word: str(k) for words in SPELLED for k, word in enumerate(words)}


@lru_cache(maxsize=1)
def _characters() -> tuple[dict[str, str], re.Pattern]:
    """Every rewritten character with its replacement: full-width forms and decimal digits come from rules."""
    table = LOOKALIKES | {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)} | dict.fromkeys(INVISIBLE, "")
    table |= {chr(c): str(unicodedata.decimal(chr(c))) for c in range(0x660, 0x1FBFA) if unicodedata.decimal(chr(c), None) is not None}
    return table, re.compile("[" + "".join(map(re.escape, table)) + "]")


_TOKEN = rf"(?:(?<![A-Za-z])(?:{'|'.join(DIGITS)})(?![A-Za-z])|[0-9])"
_ONE_DIGIT = re.compile(rf"(?i){_TOKEN}")
#: A number of at least nine digits, spelled or not in any mix; the shortest phone number has nine.
_NUMBER = re.compile(rf"(?i)(?:(?<![A-Za-z0-9])(plus[ ,-]{{1,2}}))?{_TOKEN}(?:[ ,.()-]{{0,3}}{_TOKEN}){{8,}}+")
_OPEN, _CLOSE = r"[ ]{0,2}[(\[{<][ ]{0,2}", r"[ ]{0,2}[)\]}>][ ]{0,2}"
_BRACKETED = re.compile(rf"(?i){_OPEN}({'|'.join(AT + DOT)}){_CLOSE}")
_DOT = r"(?:\.|[ ]{1,2}dot[ ]{1,2})"
_PART = _TOKEN.replace("[0-9])", "(?<![0-9])[0-9]{1,3}(?![0-9]))")
_ONE_PART = re.compile(rf"(?i){_PART}")
_OCTET = rf"({_PART}(?:[ -]{{0,2}}{_PART}){{0,2}})"
_OCTETS = re.compile(rf"(?i)(?<![0-9.]){_OCTET}" + rf"({_DOT}){_OCTET}" * 3)
#: A bare at needs a host with a dot, plain or spelled, after it, and none of the words that prose would have there.
_AT = re.compile(r"(?i)@|[ ]{1,2}at[ ]{1,2}(?!(?:the|an?|this|that|my|our|your|his|her|its|their) )")
_HOST = re.compile(rf"(?i)[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++")
_LABEL = re.compile(rf"(?i)({_DOT})([A-Za-z0-9-]++)")
_TOP = re.compile(r"[A-Za-z]{2,24}")
_NAME = re.compile(r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?:[ ]{1,2}dot[ ]{1,2}[A-Za-z0-9._%+-]{1,64})+$")
_BARE_DOT = re.compile(r"(?i)[ ]{1,2}dot[ ]{1,2}")
_AFTER = re.compile(rf"(?![a-z])(?:[ ,.()-]{{0,3}}|{_DOT})(?:{'|'.join(DIGITS)}|[0-9])")
_BEFORE = re.compile(r"[0-9](?:[ ,.()-]{0,3}|[ ]{1,2}dot[ ]{1,2})$")
_DIGIT_DOT = re.compile(r"[0-9][ ]{1,2}dot[ ]{1,2}[0-9]")


def _emails(text: str):
    """Leftmost matches; each at sign is looked at once, so long runs of letters cost no more than their length."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def _luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def detect(text: str) -> list[tuple[int, int, int]]:
    """(number of the kind, start, end), by kind and then start."""
    found = [(0, a, b) for a, b in _emails(text)]
    if any(d in text for d in "0123456789"):
        found += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                found.append((2, m.start(), m.end()))
        if "+" in text:
            found += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


class Tape:
    """A text with, for each character, the source interval it stands for and whether it was rewritten."""

    def __init__(self, text: str):
        self.text, n = text, len(text)
        self.start, self.end, self.new = np.arange(n), np.arange(1, n + 1), np.zeros(n, dtype=bool)

    def rewrite(self, pieces: list[tuple[int, int, str]]) -> None:
        """Put each replacement for its interval; its characters all stand for the whole interval."""
        if not pieces:
            return
        text, start, end, new, last = [], [], [], [], 0
        for a, b, put in [*pieces, (len(self.text), len(self.text), "")]:
            text += [self.text[last:a], put]
            start += [self.start[last:a], np.full(len(put), self.start[a] if b > a else 0)]
            end += [self.end[last:a], np.full(len(put), self.end[b - 1] if b > a else 0)]
            new += [self.new[last:a], np.ones(len(put), dtype=bool)]
            last = b
        self.text, self.start, self.end, self.new = "".join(text), np.concatenate(start), np.concatenate(end), np.concatenate(new)


    def copy(self) -> Tape:
        other = object.__new__(Tape)
        other.text, other.start, other.end, other.new = self.text, self.start, self.end, self.new
        return other


def _digit(token: str) -> str:
    return token if token.isdigit() else DIGITS[token.lower()]


def _number_pieces(text: str, beside: bool) -> list[tuple[int, int, str]]:
    """Spelled digits of long numbers as digits, without what parts two of them; with `beside` also without what parts them from plain ones."""
    pieces = []
    for m in _NUMBER.finditer(text):
        tokens = [(d.start(), d.end()) for d in _ONE_DIGIT.finditer(text, m.end(1) if m[1] else m.start(), m.end())]
        if not m[1] and all(b - a == 1 for a, b in tokens):
            continue
        if m[1]:
            pieces.append((m.start(1), m.end(1), "+"))
        last = None
        for a, b in tokens:
            if last and a > last[1] and (b - a > 1) + (last[1] - last[0] > 1) > (not beside):
                pieces.append((last[1], a, ""))
            if b - a > 1:
                pieces.append((a, b, _digit(text[a:b])))
            last = (a, b)
    return pieces


def _octet_pieces(text: str) -> list[tuple[int, int, str]]:
    """Four numbers below 256, digits and dots of which are spelled or not in any mix."""
    pieces = []
    for m in _OCTETS.finditer(text):
        octets = [[(d.start(), d.end()) for d in _ONE_PART.finditer(text, m.start(g), m.end(g))] for g in (1, 3, 5, 7)]
        value = lambda ts: int("".join(_digit(text[a:b]) for a, b in ts))
        # What stands beside the address may be a number too: the outer octets give up digits until they fit.
        while octets[0] and value(octets[0]) > 255:
            octets[0] = octets[0][1:]
        while octets[3] and value(octets[3]) > 255:
            octets[3] = octets[3][:-1]
        if not octets[0] or not octets[3]:
            continue
        dots = [m.span(g) for g in (2, 4, 6)]
        plain = all(text[a].isdigit() for ts in octets for a, b in ts) and all(b - a == 1 for a, b in dots)
        if plain or any(value(ts) > 255 for ts in octets):
            continue
        found = [(a, b, ".") for a, b in dots if b - a > 1]
        for ts in octets:
            found += [(a, b, _digit(text[a:b])) for a, b in ts if not text[a].isdigit()]
            found += [(b, c, "") for (_, b), (c, _) in zip(ts, ts[1:], strict=False) if c > b]
        pieces += sorted(found)
    return pieces


def _email_pieces(text: str) -> list[tuple[int, int, str]]:
    """Bare at and dot of addresses, each of which may be bare or plain; the host ends at its last label of letters."""
    pieces, last, lower = [], 0, _lower(text)
    places = [m.start() for m in re.finditer("@", text)]
    at = lower.find(" at ")
    while at >= 0:
        places.append(at - (at > 0 and text[at - 1] == " "))
        at = lower.find(" at ", at + 3)
    for at in sorted(places):
        m = _AT.match(text, at) if at > last and text[at - 1] in _LOCAL else None
        if not m:
            continue
        host = _HOST.match(text, m.end())
        labels = list(_LABEL.finditer(text, m.end(), host.end())) if host else []
        while labels and not _TOP.fullmatch(labels[-1][2]):
            labels.pop()
        if not labels:
            continue
        found = [(*d.span(1), ".") for d in labels if d[1] != "."]
        if m[0] != "@":
            found.append((*m.span(), "@"))
        name = _NAME.search(text, max(last, m.start() - 400), m.start()) if "dot " in text[max(last, m.start() - 400) : m.start()].lower() else None
        if name:
            found += [(*d.span(), ".") for d in _BARE_DOT.finditer(text, name.start(), m.start())]
        pieces += sorted(found)
        last = labels[-1].end()
    return pieces


def _lower(text: str) -> str:
    """Lower case of the same length."""
    lower = text.lower()
    return lower if len(lower) == len(text) else "".join(c.lower() if c.isascii() else c for c in text)


def _beside(lower: str) -> bool:
    """Whether a spelled digit stands beside another digit; looked at before the slower patterns, as prose has single ones."""
    for word in DIGITS:
        at = lower.find(word)
        while at >= 0:
            if not (at and "a" <= lower[at - 1] <= "z") and (_AFTER.match(lower, at + len(word)) or _BEFORE.search(lower[max(0, at - 8) : at])):
                return True
            at = lower.find(word, at + len(word))
    return False


def normalise(text: str) -> list[Tape]:
    """The readings of the text that differ from it: without long numbers, with spelled digits joined, and with plain ones joined to these."""
    tape = Tape(text)
    if not text.isascii():
        table, pattern = _characters()
        tape.rewrite([(m.start(), m.end(), table[m[0]]) for m in pattern.finditer(text)])
    lower = _lower(tape.text)
    if any(c in lower for c in "([{<") and any(word in lower for word in (*AT, *DOT)):
        tape.rewrite([(m.start(), m.end(), "@" if m[1].lower() in AT else ".") for m in _BRACKETED.finditer(tape.text)])
        lower = _lower(tape.text)
    readings, spelled = [tape], _beside(lower)
    if spelled or "plus " in lower or "plus-" in lower or "plus," in lower:
        for pieces in filter(None, (_number_pieces(tape.text, False), _number_pieces(tape.text, True))):
            other = tape.copy()
            other.rewrite(pieces)
            if all(other.text != t.text for t in readings):
                readings.append(other)
    for t in readings:
        if spelled or " dot " in lower and _DIGIT_DOT.search(lower):
            t.rewrite(_octet_pieces(t.text))
        if " at " in lower or " dot " in lower and "@" in lower:
            t.rewrite(_email_pieces(t.text))
    return [t for t in readings if t.new.any() or len(t.text) != len(text)]


def spans_of(text: str) -> list[tuple[int, int, int, bool]]:
    """(number of the kind, start, end, base) of all spans in source code points, by kind and then start."""
    base = detect(text)
    found = {(k, a, -b, False) for k, a, b in base}
    for tape in normalise(text):
        changed = np.r_[0, np.cumsum(tape.new)]
        gap = np.r_[0, np.cumsum(np.r_[tape.start[1:] != tape.end[:-1], False])] if len(tape.text) else np.zeros(1, int)
        for k, a, b in detect(tape.text):
            if changed[b] > changed[a] or gap[b - 1] > gap[a]:  # something in it was rewritten or taken out
                found.add((k, int(tape.start[a]), -int(tape.end[b - 1]), True))
    # Base spans stay; of the others, those within a span of their kind are left out.
    spans, kind, last = [], -1, 0
    for k, a, b, new in sorted(found):
        if k != kind:
            kind, last = k, 0
        if not new or -b > last:
            spans.append((k, a, -b, not new))
        last = max(last, -b)
    return sorted(spans)


def scan(documents: DataFrame) -> DataFrame:
    """doc_id and spans (array of kind, start, end, base) of each text; nothing is shuffled."""

    def run(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
        for batch in in_blocks(batches):
            rows = [[{"kind": KINDS[k], "start": a, "end": b, "base": base} for k, a, b, base in spans_of(t)] if t else [] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], ["doc_id", "spans"])

    return columns(documents, doc_id="long", text="string").mapInArrow(run, "doc_id long, spans array<struct<kind string, start long, end long, base boolean>>")


def digest(scanned: DataFrame) -> DataFrame:
    """Counts and hashes of base spans, and all spans as one string."""
    return scanned.selectExpr(
        "doc_id",
        *(f"cast(size(filter(spans, s -> s.kind = '{k}' and s.base)) as bigint) n_{k}" for k in KINDS),
        "sha2(array_join(transform(filter(spans, s -> s.base), s -> concat_ws(':', s.kind, s.start, s.end)), ','), 256) base_sha256",
        "array_join(transform(spans, s -> concat_ws(':', s.kind, s.start, s.end)), ',') spans",
    )


def mask(text: str | None) -> str | None:
    """The text with each span, overlapping ones merged, replaced by its kind in angle brackets."""
    if not text:
        return text
    out, last = [], 0
    for a, b, k in sorted((a, -b, k) for k, a, b, _ in spans_of(text)):
        if a >= last:
            out += [text[last:a], f"<{KINDS[k].upper()}>"]
        last = max(last, -b)
    return "".join([*out, text[last:]])


def redact(documents: DataFrame) -> DataFrame:
    """The documents, in their own columns, with personal data masked; n_chars follows the new text where it exists."""
    schema = StructType(documents.schema.fields)

    def run(batches):
        for batch in in_blocks(batches):
            at = batch.schema.get_field_index("text")
            texts = pa.array([mask(t) for t in batch.column("text").to_pylist()], batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), texts)

    out = documents.mapInArrow(run, schema)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in documents.columns else out

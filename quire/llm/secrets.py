"""Operator 1, secret scans: one deterministic automaton for all rules, run over the bytes of many texts at once.

The rules' patterns together become one nondeterministic automaton, by subset construction one deterministic automaton,
and by partition refinement the smallest one, kept as an array of transitions over byte classes. One pass over the bytes,
in lanes that numpy moves together, tells for every byte which rules have a match that ends there. Matches are runs of
such bytes: a run's end is the match's end, its first byte is the first of the rule's last, repeated part, and the short
fixed part before that leads to the start. Least lengths are checked on the matches, as failing ones still use up their
bytes; they are no part of the automaton, whose states they would multiply.

Defined results: a null or empty text has no spans; a very long text takes time in proportion to its length, whatever it
holds; matches that overlap an earlier one of their kind aren't found; repeated rows give repeated results; columns
besides doc_id and text are ignored, whatever their names; an empty table gives no rows. Spans are in code points, end
exclusive.
"""

from __future__ import annotations

import re
from functools import lru_cache
from re import _parser as parser

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  in_blocks uses it
from pyspark.sql import DataFrame

from quire.llm.common import columns, in_blocks, joined_bytes

_VALUE = rb"[A-Za-z0-9+/_.=-]"
_WEB = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-"
_NAMES = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
#: kind: (pattern, least length of its last, repeated part). What precedes that part has a fixed length but in `_start`.
BASE = {
    "assign": (rb"(?i:password|passwd|secret|token|api_?key)[\"']? *[:=] *[\"']?" + _VALUE + rb"+", 6),
    "access": (rb"AKIA[A-Z0-9]+", 16),
    "hex": (rb"[0-9a-f]+", 24),
}
#: Further token formats that their issuers document.
MORE = {
    "private_key": (rb"-----BEGIN [A-Z ]*PRIVATE KEY-----", 1),
    "code_host_token": (rb"gh[opsur]_[A-Za-z0-9]+", 36),
    "chat_token": (rb"xox[abprs]-[A-Za-z0-9-]+", 10),
    "cloud_key": (rb"AIza[A-Za-z0-9_-]+", 35),
    "payment_key": (rb"[rs]k_live_[A-Za-z0-9]+", 16),
    "web_token": (rb"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 8),
}
#: Bytes of a match before its repeated part.
_BEFORE = {"access": 4, "hex": 0, "code_host_token": 4, "chat_token": 5, "cloud_key": 4, "payment_key": 8}
RULES = BASE | MORE
_KINDS = list(RULES)
_LANE = 256


class _Nfa:
    """Thompson's construction over Python's own parse of a bytes pattern."""

    def __init__(self):
        self.empty: list[set[int]] = []
        self.moves: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.empty.append(set())
        self.moves.append(None)
        return len(self.empty) - 1

    def step(self, at: int, chars: set[int], fold: bool) -> int:
        if fold:
            chars = {c for x in chars for c in (ord(chr(x).lower()), ord(chr(x).upper())) if x < 128} | chars
        end = self.state()
        self.moves[at] = (frozenset(chars), end)
        fresh = self.state()
        self.empty[end].add(fresh)
        return fresh

    def build(self, items, at: int, fold: bool = False) -> int:
        for op, arg in items:
            kind = str(op)
            if kind == "LITERAL":
                at = self.step(at, {arg}, fold)
            elif kind == "IN":
                at = self.step(at, {c for k, v in arg for c in ([v] if str(k) == "LITERAL" else range(v[0], v[1] + 1))}, fold)
            elif kind == "SUBPATTERN":
                at = self.build(arg[3], at, fold or bool(arg[1] & re.IGNORECASE))
            elif kind == "BRANCH":
                end = self.state()
                for branch in arg[1]:
                    start = self.state()
                    self.empty[at].add(start)
                    self.empty[self.build(branch, start, fold)].add(end)
                at = end
            elif kind == "MAX_REPEAT":
                least, most, body = arg
                for _ in range(least):
                    at = self.build(body, at, fold)
                if most == parser.MAXREPEAT:
                    loop, out = self.state(), self.state()
                    self.empty[at] |= {loop, out}
                    self.empty[self.build(body, loop, fold)] |= {loop, out}
                    at = out
                else:
                    out = self.state()
                    for _ in range(most - least):
                        self.empty[at].add(out)
                        at = self.build(body, at, fold)
                    self.empty[at].add(out)
                    at = out
            else:
                raise ValueError(f"{kind} isn't supported in a rule")
        return at

    def closure(self, state: int) -> int:
        """The states that the empty moves reach, as bits."""
        seen, todo = {state}, [state]
        while todo:
            fresh = self.empty[todo.pop()] - seen
            seen |= fresh
            todo += fresh
        return sum(1 << s for s in seen)


#: The automaton, once it is built here or has come from the driver.
_BUILT: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []


def _install(tables) -> None:
    if not _BUILT:
        _BUILT.append(tables)


def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not _BUILT:
        _install(_build())
    return _BUILT[0]


def _build() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte classes, transitions [state, class] and the mask of rules that end in each state; class 0 goes back to state 0."""
    nfa = _Nfa()
    root, ends = nfa.state(), {}
    for k, (pattern, _) in enumerate(RULES.values()):
        start = nfa.state()
        nfa.empty[root].add(start)
        ends[nfa.build(parser.parse(pattern), start)] = 1 << k
    sets = sorted({m[0] for m in nfa.moves if m}, key=sorted)
    keys: dict[tuple, int] = {}
    classes = np.array([keys.setdefault(tuple(c in s for s in sets), len(keys) + 1) for c in range(256)], dtype=np.uint8)
    begin = nfa.closure(root)
    # For each state with a move its byte classes and, as bits, where the move leads.
    moves = {s: ([classes[c] for c in sorted(m[0])], nfa.closure(m[1]) | begin) for s, m in enumerate(nfa.moves) if m}
    moves = {s: (sorted({int(c) for c in cs}), bits) for s, (cs, bits) in moves.items()}
    number, table, todo = {begin: 0}, [], [begin]
    for states in todo:  # grows meanwhile
        targets = [begin] * (len(keys) + 1)
        rest = states
        while rest:
            low = rest & -rest
            rest ^= low
            for c in moves.get(low.bit_length() - 1, ((), 0))[0]:
                targets[c] |= moves[low.bit_length() - 1][1]
        for target in targets:
            if target not in number:
                number[target] = len(number)
                todo.append(target)
        table.append([0, *(number[t] for t in targets[1:])])
    move = np.array(table)
    masks = np.array([sum(bit for s, bit in ends.items() if states >> s & 1) for states in todo])
    part = np.unique(masks, return_inverse=True)[1]
    while True:
        finer = np.unique(np.column_stack([part, part[move]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == part.max():
            break
        part = finer
    order = np.unique(part, return_index=True)[1]
    # State 0 starts; the states where a rule ends come last, so that one comparison finds them.
    order = np.array(sorted(order, key=lambda s: (masks[s] > 0, part[s] != part[0], s)))
    place = np.empty(part.max() + 1, dtype=np.int64)
    place[part[order]] = np.arange(len(order))
    return classes, place[part[move[order]]].astype(np.int32), masks[order]


#: With fewer lanes than this to redo, their bytes are walked one by one.
_FEW = 16


def endings(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each byte of the texts the mask of the rules that have a match which ends there; one zero byte parts two texts."""
    classes, move, masks = automaton()
    n, k = len(offsets) - 1, move.shape[1]
    flat = (move * k).ravel()
    row = np.repeat(np.arange(n), np.diff(offsets))
    lanes = max(1, -(-(len(data) + n) // _LANE))
    symbols = np.zeros(lanes * _LANE, dtype=np.uint8)  # class 0 parts the texts
    symbols[np.arange(len(data)) + row] = classes[data]
    across = np.ascontiguousarray(symbols.reshape(lanes, _LANE).T)
    state, states = np.zeros(lanes, dtype=np.int32), np.empty((_LANE, lanes), dtype=np.int32)
    for t in range(_LANE):
        state = flat[state + across[t]]
        states[t] = state
    # A lane starts in the state that the lane before it ends in; lanes are redone until they meet what they had.
    redo = np.flatnonzero(np.r_[0, states[-1, :-1]])
    while len(redo) >= _FEW:
        live, state = redo, states[-1, redo - 1]
        for t in range(_LANE):
            state = flat[state + across[t, live]]
            differs = state != states[t, live]
            live, state = live[differs], state[differs]
            if not len(live):
                break
            states[t, live] = state
        redo = live[live < lanes - 1] + 1
    states = states.T.ravel()
    steps = _steps()[1]
    for lane in redo:
        at, now = int(lane) * _LANE, int(states[lane * _LANE - 1])
        while at < len(states):
            had = states[at : at + 65536].tolist()
            walked = 0
            for symbol, old in zip(symbols[at : at + 65536].tolist(), had, strict=True):
                now = steps[now + symbol]
                if now == old:
                    break
                had[walked] = now
                walked += 1
            states[at : at + walked] = had[:walked]
            if walked < len(had):
                break
            at += walked
    return masks.astype(np.uint16)[states[: len(data) + n] // k]


def _tail(text: bytes, end: int, strip: bytes) -> int:
    """Where the run of these bytes before `end` starts; the pieces looked at double, so that many short runs stay cheap."""
    size = 64
    while True:
        piece = text[max(0, end - size) : end]
        rest = piece.rstrip(strip)
        if rest or size >= end:
            return end - len(piece) + len(rest)
        size *= 2


def _start(kind: str, text: bytes, first: int) -> int:
    """The start of the match whose repeated part begins at `first`."""
    if kind in _BEFORE:
        return first - _BEFORE[kind]
    if kind == "private_key":
        return text.rindex(b"-----BEGIN ", 0, first)
    if kind == "web_token":
        middle = _tail(text, first - 1, _WEB)
        head = _tail(text, middle - 1, _WEB)
        return text.index(b"eyJ", head)
    at = first - (text[first - 1 : first] in (b'"', b"'"))
    at = _tail(text, at, b" ") - 1  # the colon or equals sign
    at = _tail(text, at, b" ")
    at -= text[at - 1 : at] in (b'"', b"'")
    name = next(n for n in _NAMES if text[max(0, at - len(n)) : at].lower() == n)
    return at - len(name)


@lru_cache(maxsize=1)
def _steps() -> tuple[list[int], list[int], list[int]]:
    """Byte classes, transitions and masks for walking byte by byte; states are multiples of the number of classes."""
    classes, move, masks = automaton()
    return classes.tolist(), (move * move.shape[1]).ravel().tolist(), masks.tolist()


def _first(k: int, text: bytes, begin: int, end: int) -> int | None:
    """The first byte from `begin` on where rule k has a match that starts there or later."""
    classes, steps, masks = _steps()
    n, state = len(steps) // len(masks), 0
    for at in range(begin, end):
        state = steps[state + classes[text[at]]]
        if masks[state // n] >> k & 1:
            return at
    return None


def spans_of(data: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
    """For each text that has any, its (start, number of the kind, end), in order, in code points."""
    masks = endings(data, offsets)
    begins = offsets[:-1] + np.arange(len(offsets) - 1)
    found: dict[int, list] = {}
    for k, (kind, (_, least)) in enumerate(RULES.items()):
        on = np.r_[False, (masks >> k) & 1 > 0, False]
        edge = np.flatnonzero(on[1:] != on[:-1])
        first, end = edge[::2], edge[1::2]
        if kind == "hex":  # prose is full of short ones, which can't overlap others
            keep = end - first >= least
            first, end = first[keep], end[keep]
        text_of = np.searchsorted(begins, first, side="right") - 1
        text, of, used = b"", -1, 0
        for i, a, b in zip(text_of.tolist(), (first - begins[text_of]).tolist(), (end - begins[text_of]).tolist(), strict=True):
            if i != of:
                text, of, used = data[offsets[i] : offsets[i + 1]].tobytes(), i, 0
            start = _start(kind, text, a)
            if start < used:  # its first bytes belong to the match before it: another may start behind that
                a = _first(k, text, used, b)
                if a is None:
                    continue
                start = _start(kind, text, a)
            used = b
            if b - a >= least and (kind != "web_token" or all(len(part) >= 8 for part in text[start + 3 : b].replace(b".eyJ", b".").split(b"."))):
                found.setdefault(i, []).append((start, k, b))
    for i, spans in found.items():
        spans.sort()
        text = data[offsets[i] : offsets[i + 1]]
        if len(text) and text.max() > 127:
            lead = np.cumsum((text & 0xC0) != 0x80)
            found[i] = [(int(lead[a]) - 1, k, int(lead[b - 1])) for a, k, b in spans]
    return found


def scan(documents: DataFrame) -> DataFrame:
    """doc_id and spans (array of kind, start, end, base) of each text; nothing is shuffled."""

    tables = automaton()  # two megabytes, built once and sent along

    def run(batches):
        _install(tables)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
        for batch in in_blocks(batches, 4_000_000):
            data, offsets = joined_bytes(batch.column("text"))
            rows = [[] for _ in range(len(offsets) - 1)]
            for i, spans in spans_of(data, offsets).items():
                rows[i] = [{"kind": _KINDS[k], "start": a, "end": b, "base": k < len(BASE)} for a, k, b in spans]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], ["doc_id", "spans"])

    return columns(documents, doc_id="long", text="string").mapInArrow(run, "doc_id long, spans array<struct<kind string, start long, end long, base boolean>>")


def digest(scanned: DataFrame) -> DataFrame:
    """Counts and hashes of base spans, and all spans as one string."""
    return scanned.selectExpr(
        "doc_id",
        *(f"cast(size(filter(spans, s -> s.kind = '{k}')) as bigint) n_{k}" for k in BASE),
        "sha2(array_join(transform(filter(spans, s -> s.base), s -> concat_ws(':', s.kind, s.start, s.end)), ','), 256) base_sha256",
        "array_join(transform(spans, s -> concat_ws(':', s.kind, s.start, s.end)), ',') spans",
    )

"""Edit distance and shortest edit scripts by bit vectors: a column of the table is one long integer, a cell a bit.

A step costs as many machine words as the shorter side fills, and what both sides share at their ends is cut off first, so
lines that differ in a few places are cheap and none is too long.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import isqrt

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import LongType


def _shared(a: Sequence, b: Sequence) -> int:
    """How many items both begin with."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _core(a: Sequence, b: Sequence) -> tuple[int, int]:
    """How many items both begin with, and with how many of the others both end."""
    head = _shared(a, b)
    return head, _shared(a[head:][::-1], b[head:][::-1])


def _places(items: Sequence) -> dict:
    """The places of each item as bits."""
    out: dict = {}
    for i, x in enumerate(items):
        out[x] = out.get(x, 0) | 1 << i
    return out


def edit_distance(a: Sequence, b: Sequence) -> int:
    """The least number of items to insert, delete or change."""
    head, tail = _core(a, b)
    a, b = sorted((a[head : len(a) - tail], b[head : len(b) - tail]), key=len)
    if not a:
        return len(b)
    places, every, last = _places(a), (1 << len(a)) - 1, 1 << (len(a) - 1)
    more, less, score = every, 0, len(a)  # where a cell is one more or one less than the one above it
    for x in b:
        equal = places.get(x, 0)
        across = (((equal & more) + more) ^ more) | equal
        up, down = less | ~(across | more) & every, more & across
        if up & last:
            score += 1
        elif down & last:
            score -= 1
        up, down, equal = (up << 1 | 1) & every, down << 1 & every, equal | less
        more, less = (down | ~(equal | up)) & every, up & equal
    return score


def diff(a: Sequence, b: Sequence) -> list[tuple[str, int, int, int, int]]:
    """A shortest edit script as runs in order: (what, from and to in a, from and to in b); what is equal, deleted or inserted.

    Bit vectors of the longest common subsequence go forward once; each square root of b's length is kept, and the walk back
    makes those between two of them anew, so memory stays far below the whole table.
    """
    head, tail = _core(a, b)
    one, other = a[head : len(a) - tail], b[head : len(b) - tail]
    n, m = len(one), len(other)
    places, every = _places(one), (1 << n) - 1

    def forward(vector, items):
        for x in items:
            met = vector & places.get(x, 0)
            vector = ((vector + met) | (vector - met)) & every
            yield vector

    step, kept, vector = max(1, isqrt(m)), [every], every
    for k, vector in enumerate(forward(every, other), 1):
        if k % step == 0:
            kept.append(vector)
    i, j, back, base, block = n, m, [], m + 1, []
    while i and j:
        if j - 1 < base:  # vectors of the block that holds j - 1 and j
            base = max(0, j - 1) // step * step
            block = [kept[base // step], *forward(kept[base // step], other[base : min(m, base + step)])]
        if block[j - base] >> (i - 1) & 1:
            i -= 1
            back.append("deleted")
        else:
            j -= 1
            if j and not block[j - base] >> (i - 1) & 1:
                back.append("inserted")
            else:
                i -= 1
                back.append("equal")
    back += ["deleted"] * i + ["inserted"] * j
    script, p, q = [], 0, 0

    def run(what, x, y):
        nonlocal p, q
        if x or y:
            if script and script[-1][0] == what:
                script[-1] = (what, script[-1][1], p + x, script[-1][3], q + y)
            else:
                script.append((what, p, p + x, q, q + y))
            p, q = p + x, q + y

    run("equal", head, head)
    gone = new = 0
    for what in back[::-1]:  # between two equal runs, what is deleted comes first
        if what == "equal":
            run("deleted", gone, 0)
            run("inserted", 0, new)
            gone = new = 0
            run("equal", 1, 1)
        else:
            gone, new = gone + (what == "deleted"), new + (what == "inserted")
    run("deleted", gone, 0)
    run("inserted", 0, new)
    run("equal", tail, tail)
    return script


@F.pandas_udf(LongType())
def _distances(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else edit_distance(x, y) for x, y in zip(a, b, strict=True)], dtype="Int64")


def edit_distances(a: str, b: str):
    """Column: character edit distance of two string columns, null if one is null. Equal texts don't go to Python."""
    differ = F.expr(f"{a} <> {b}")
    apart = _distances(F.when(differ, F.expr(a)), F.when(differ, F.expr(b)))
    return F.when(F.expr(f"{a} = {b}"), F.lit(0).cast("long")).otherwise(apart)

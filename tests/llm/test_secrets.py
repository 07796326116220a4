import random
import re
import time

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import secrets as S
from quire.llm.common import joined_bytes

PIECES = ['token = "', "password:", "abc123", "deadbeef" * 3, "AKIA", "ABCDEF0123456789", " ", "é", "x" * 300, "api_key=", '"', "ghp_" + "a" * 36, "=", "secret", "f" * 30, "-----BEGIN RSA PRIVATE KEY-----", "😀", "passwd   :   ", " " * 700, "TOKEN=", "xoxb-" + "1a-" * 4, "sk_live_", "AIza", "ghp_", "eyJ", ".", "-----BEGIN ", "PRIVATE KEY-----", "A", "_", "token", ":", "eyJabcdefghijk.eyJabcdefghijk.abcdefghijk"]


def brute(text: str) -> list[tuple[int, str, int]]:
    """The base contract by Python's own regexes over code points."""
    found = []
    named = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY]"
    for m in re.finditer(rf"({named})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m[2]) >= 6:
            found.append((m.start(), "assign", m.end()))
    found += [(m.start(), "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found, key=lambda x: (x[0], ["assign", "access", "hex"].index(x[1])))


def found(texts):
    spans = S.spans_of(*joined_bytes(pa.array(texts, pa.string())))
    return [[(a, S._KINDS[k], b) for a, k, b in spans.get(i, [])] for i in range(len(texts))]


def further(text: str) -> list[tuple[int, str, int]]:
    """The other rules by Python's own regexes: matches of the whole patterns, in order, and then the least lengths."""
    out = []
    for kind, (pattern, least) in S.MORE.items():
        for m in re.finditer(pattern.decode(), text):
            parts = m[0][3:].replace(".eyJ", ".").split(".") if kind == "web_token" else [m[0][S._BEFORE.get(kind, 0) :]]
            if all(len(x) >= least for x in parts):
                out.append((m.start(), kind, m.end()))
    return sorted(out, key=lambda x: (x[0], S._KINDS.index(x[1])))


def test_base_spans_match_plain_regexes():
    pick = random.Random(1)
    texts = ["".join(pick.choice(PIECES) for _ in range(pick.randint(0, 30))) for _ in range(400)]
    for text, spans in zip(texts, found(texts), strict=True):
        assert [s for s in spans if s[1] in S.BASE] == brute(text)
        assert [s for s in spans if s[1] in S.MORE] == further(text)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES + ["\n", "K", "ſecret:abcdef"]), max_size=12).map("".join), max_size=6))
def test_property(texts):
    for text, spans in zip(texts, found(texts), strict=True):
        assert [s for s in spans if s[1] in S.BASE] == brute(text)
        assert [s for s in spans if s[1] in S.MORE] == further(text)


def test_nulls_empty_long_and_clashing_columns(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, 'token = "abcdef"', "c"), (3, 'token = "abcdef"', "c"), (4, "x" * 1_000_000 + "deadbeef" * 4, "d"), (None, "secret=abcdefg", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    out = {(r.doc_id, r.spans) for r in S.digest(S.scan(df)).collect()}
    assert out == {(1, ""), (2, ""), (3, "assign:0:15"), (4, "hex:1000000:1000032"), (None, "assign:0:14")}
    assert S.scan(df.limit(0)).count() == 0


def test_further_formats():
    assert [s[1] for s in found(["ghp_" + "z" * 36])[0]] == ["code_host_token"]
    assert [s[1] for s in found(["eyJabcdefghijk.eyJabcdefghijk.abcdefghijk"])[0]] == ["web_token"]
    assert found(["ghp_" + "z" * 30, "the skeleton keys of the token ring"]) == [[], []]


@pytest.mark.parametrize("run", ["token", "eyJ", "eyJa.", "token=", "token ", "-----BEGIN ", " ", "a", "AKIA", "ghp_", "é"])
def test_any_text_takes_linear_time(run):
    text = "secret" + run * (1_000_000 // len(run)) + '="abcdefg"'
    began = time.perf_counter()
    spans = found([text, "token" + " " * 1_000_000 + "= abcdef"])
    assert time.perf_counter() - began < 15
    assert spans[1][-1] == (0, "assign", 1_000_013)

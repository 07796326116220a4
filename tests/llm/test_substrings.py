import hashlib
import random

import pytest

from quire.llm import substrings as S


def brute(texts):
    docs = {i: (t or "").encode() for i, t in texts}
    least = {}
    for i in sorted(docs):
        for p in range(len(docs[i]) - 49):
            least.setdefault(docs[i][p : p + 50], i)
    out = {}
    for i, b in docs.items():
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if least[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        out[i] = (len(b), sum(gone), sum(1 for x in bytes(gone).split(b"\0") if x), hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("split", [4096, 2])
def test_matches_brute_force(corpus, texts, split, monkeypatch):
    monkeypatch.setattr(S, "SPLIT", split)
    monkeypatch.setattr(S, "BUCKET", 500 * split)
    want = brute(texts)
    rows = S.digest(S.remove(corpus)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id], r.doc_id


@pytest.mark.parametrize("split", [4096, 1])
def test_long_runs_of_one_character(spark, split, monkeypatch):
    monkeypatch.setattr(S, "SPLIT", split)
    tail = "and then a sentence that both texts share, of more than fifty bytes"
    rows = [(1, "x" * 30_000 + "ab" * 40 + tail), (2, "y" + "x" * 20_000 + "q"), (3, "ab" * 10_000 + "c" + tail), (4, "x" * 49 + "z" + "ab" * 24)]
    want = brute(rows)
    for r in S.digest(S.remove(spark.createDataFrame(rows, "doc_id long, text string"))).collect():
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id], r.doc_id


def test_empty_table_and_missing_ids(spark, corpus):
    assert S.remove(corpus.limit(0)).count() == 0
    text = "a sentence of more than fifty bytes, the same in both rows of this table"
    rows = {r.n_removed for r in S.remove(spark.createDataFrame([(None, text), (1, text)], "doc_id long, text string")).collect()}
    assert rows == {0}


def test_interval_tree_finds_all_maximal_repeats():
    pick = random.Random(2)
    members = [(bytes(pick.choice(b"ab") for _ in range(6)), b"G" * 3 + bytes(pick.choice(b"ab") for _ in range(6))) for _ in range(12)]
    found = S.maximal_repeats(members, length=6, gram=3)
    common = lambda x, y: next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))
    for i in range(12):
        for j in range(i + 1, 12):
            left, right = common(members[i][0], members[j][0]), common(members[i][1], members[j][1])
            if left + right >= 6:
                assert (left, right) in {(a, b) for a, b, group in found if i in group and j in group}
    for left, right, group in found:
        assert left + right >= 6
        assert len({members[i][0][:left] + b"|" + members[i][1][:right] for i in group}) == 1
        assert len({members[i][0][: left + 1] for i in group}) > 1 or left == 6
        assert len({members[i][1][: right + 1] for i in group}) > 1 or right == 9


def test_anchors_are_the_same_in_equal_windows():
    import numpy as np

    pick = random.Random(4)
    shared = bytes(pick.choice(b"abcdef ") for _ in range(50))
    texts = [bytes(pick.choice(b"abcdef ") for _ in range(70)) + shared + bytes(pick.choice(b"abcdef ") for _ in range(70)) for _ in range(2)]
    found = []
    for t in texts:
        _, at, gram, _ = S.anchors(np.frombuffer(t, dtype=np.uint8), np.array([0, len(t)]))
        found.append({(int(p) - 70, int(g)) for p, g in zip(at, gram, strict=True) if 70 <= p <= 100})
    assert found[0] & found[1]


def test_few_windows_stay_open_of_a_frequent_gram(spark, monkeypatch):
    # Forty texts share twenty bytes and little else: a window of one can't be one of another, so none needs to be sent on.
    pick = random.Random(9)
    junk = lambda n: "".join(pick.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    rows = [(k, junk(60) + "0123456789ABCDEFGHIJ" + junk(60)) for k in range(40)] + [(40, junk(9) + junk(60)), (41, junk(5))]
    rows += [(50 + k, t[20:-20]) for k, t in rows[:3]]
    monkeypatch.setattr(S, "SPLIT", 3)
    monkeypatch.setattr(S, "BUCKET", 1 << 30)
    made = []
    cut = S.cut
    monkeypatch.setattr(S, "cut", lambda df: made.append(out := cut(df)) or out)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.digest(S.remove(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got == brute(rows)
    assert made[-1].filter("h1 is not null").count() == 0


@pytest.mark.parametrize("shared", [45, 53, 64])
def test_few_windows_stay_open_of_a_frequent_line(spark, shared, monkeypatch):
    # The line is longer than a gram and the bytes beside it, so the texts that hold it can't be told apart by these alone.
    pick = random.Random(shared)
    junk = lambda n: "".join(pick.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    line = "".join(chr(0x30 + k) for k in range(shared))
    rows = [(k, junk(60) + line + junk(60)) for k in range(40)] + [(40, junk(9) + line), (41, line + junk(5)), (42, line)]
    rows += [(50 + k, t[20:-20]) for k, t in rows[:3]]
    monkeypatch.setattr(S, "SPLIT", 3)
    monkeypatch.setattr(S, "BUCKET", 1 << 30)
    made = []
    cut = S.cut
    monkeypatch.setattr(S, "cut", lambda df: made.append(out := cut(df)) or out)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.digest(S.remove(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got == brute(rows)
    assert made[0].filter("salt >= 0").count() > 0  # the tasks know SPLIT
    assert made[-1].filter("h1 is not null").count() <= 4 * len(rows)

import hashlib
import random
import zlib

import pytest

from quire.llm import trie as T


def brute(sequences):
    """sequences: conv_id -> turns (role, text)."""
    members = {}
    for c, s in sequences.items():
        for d in range(len(s) + 1):
            members.setdefault(tuple(s[:d]), []).append(c)
    children = {p: [q for q in members if len(q) == len(p) + 1 and q[:-1] == p] for p in members}

    def below(p):
        for q in [p, *children[p]]:
            yield from [q] if q == p else below(q)

    out = []
    for p, cs in members.items():
        under = list(below(p))
        ends = ",".join(str(c) for c in sorted(cs) if len(sequences[c]) == len(p))
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in under if q)
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(children[p]), sum(not children[q] for q in under), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def plain(rows):
    """The turns of each conversation, in order, from rows (conv_id, turn, role, text)."""
    own = {}
    for c, *t in rows:
        if c is not None:
            own.setdefault(c, []).append(t)
    return {c: [(r or "", x or "") for _, r, x in sorted(t, key=lambda t: (t[0] is not None, t[0] or 0, t[1] or "", t[2] or ""))] for c, t in own.items()}


def plain_rebuilt(own):
    out = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + t[h:]
    return out


def result(df):
    return sorted((tuple(r[c] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) for r in df.collect()), key=str)


def made(pick, n):
    texts = ["", "a", "b", "é", "long " * 40, "long " * 40 + "x"]
    return [(c, t, pick.choice(["user", "assistant", None]), pick.choice(texts)) for c in range(n) for t in range(pick.choice([0, 1, 2, 3, 12]))]


@pytest.mark.parametrize("shard, band", [(T.SHARD, T.BAND), (5, 4), (1, 1), (40, 2)])
def test_rebuilt_tries_match_brute_force(spark, monkeypatch, shard, band):
    monkeypatch.setattr(T, "SHARD", shard)
    monkeypatch.setattr(T, "BAND", band)
    pick = random.Random(shard)
    rows = made(pick, 60)
    rows += [(None, 0, "user", "lost"), (3, None, "user", "first"), (3, 1, None, None), (3, 1, None, None), (3, 1, "user", "tie"), (1004, 0, "user", "no base"), (500, 7, "a", "x" * 30_000)]
    rows += [(600 + k, t, "user", "same") for k in range(40) for t in range(6)] + [(700, t, "user", "same") for t in range(50)]
    pick.shuffle(rows)
    df = spark.createDataFrame([(*r, 1, "d") for r in rows], "conv_id long, turn long, role string, text string, depth int, d1 string")
    assert result(T.digest(*T.nodes(*T.rebuilt(T.ordered(df))))) == brute(plain_rebuilt(plain(rows)))


@pytest.mark.parametrize("shard, band", [(T.SHARD, T.BAND), (3, 2)])
def test_tries_of_conversations_as_they_are(spark, monkeypatch, shard, band):
    monkeypatch.setattr(T, "SHARD", shard)
    monkeypatch.setattr(T, "BAND", band)
    rows = made(random.Random(9), 80)
    turns = T.ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    ids = spark.range(-3, 80).withColumnRenamed("id", "conv_id")  # some have no turns
    table, ends = T.nodes(turns, ids)
    assert result(T.digest(table, ends)) == brute({c: plain(rows).get(c, []) for c in range(-3, 80)})
    assert ends.count() == 83


def test_empty_tables(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert T.digest(*T.nodes(*T.rebuilt(T.ordered(df)))).count() == 0


def test_bitmaps():
    for n in (1, 7, 8, 9, 100):
        some = [k for k in range(n) if k % 3 == 0]
        assert T._ones(T._bitmap(some, n), n).tolist() == some

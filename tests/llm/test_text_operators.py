import itertools
import math
import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quire.llm import decontaminate as D
from quire.llm import licenses as L
from quire.llm import ngrams as N
from quire.llm import packing as K
from quire.llm import quality as Q


@pytest.mark.parametrize("known, heavy, least, share", [(N.KNOWN, N.HEAVY, 2, N.SHARE), (20, 0, 2, N.SHARE), (20, 30, 3, 1e-9), (0, N.HEAVY, 2, 1e-9), (N.KNOWN, 3, 20, 1e-9)])
def test_backoff_scores_match_brute_force(corpus, texts, known, heavy, least, share, monkeypatch):
    monkeypatch.setattr(N, "SHARE", share)
    monkeypatch.setattr(N, "BUCKET_WORDS", 2000)
    docs = [(i, bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()).split()) for i, t in texts]
    one, two, three = Counter(), Counter(), Counter()
    for _, w in docs:
        one.update(w)
        two.update(zip(w, w[1:], strict=False))
        three.update(zip(w, w[1:], w[2:], strict=False))
    total, want = sum(one.values()), {}

    def value(w, k):
        """(score, orders used) of the word at k."""
        if k > 1 and three[tuple(w[k - 2 : k + 1])] >= least:
            return math.log(three[tuple(w[k - 2 : k + 1])] / two[w[k - 2], w[k - 1]]), 3
        back = math.log(0.4) if k > 1 else 0
        if k and two[w[k - 1], w[k]] >= least:
            return back + math.log(two[w[k - 1], w[k]] / one[w[k - 1]]), 2
        return back + (math.log(0.4) if k else 0) + math.log(one[w[k]] / total), 1

    for i, w in docs:
        parts = [value(w, k) for k in range(len(w))]
        n, k, k3, x = want.get(i, (0, 0, 0, 0.0))
        want[i] = (n + len(w), k + sum(o > 1 for _, o in parts), k3 + sum(o > 2 for _, o in parts), x + sum(v for v, _ in parts))
    rows = N.score(corpus, least=least, known=known, heavy=heavy).collect()
    assert {r.doc_id for r in rows} == set(want)
    for r in rows:
        n, k, k3, s = want[r.doc_id]
        assert (r.n_words, r.n_seen, r.n_seen3) == (n, k, k3) and r.score == pytest.approx(s, abs=1e-5), (r, want[r.doc_id])
        assert r.mean_score == pytest.approx(s / n if n else 0, abs=1e-5)


def test_backoff_of_an_empty_table(corpus):
    assert N.score(corpus.limit(0)).count() == 0


def test_decontamination_tolerates_substitutions(spark):
    item = [f"word{i}" for i in range(24)]
    leak = list(item)
    leak[5], leak[14] = "changed", "other"
    filler = [f"fill{i}" for i in range(40)]
    rows = [(1, " ".join([*filler, *item, *filler])), (2, " ".join([*filler[:3], *leak])), (3, " ".join(filler)), (4, None), (5, ""), (6, " ".join(item[:9])), (2, " ".join(filler)), (None, " ".join(item)), (7, " ".join(item).upper() + "!")]
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, item_id string, same int")
    bench = spark.createDataFrame([(10, " ".join(item)), (11, None), (12, "too short"), (13, " ".join(f"z{i}" for i in range(30))), (None, " ".join(filler))], "item_id long, text string")
    assert {(r.doc_id, r.items) for r in D.contaminated(docs, bench).collect()} == {(1, "10"), (2, "10"), (7, "10")}
    kept = D.remove(docs, bench)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 3, 4, 5, 6]
    assert D.contaminated(docs.limit(0), bench).count() == 0 and D.contaminated(docs, bench.limit(0)).count() == 0


def holds(doc, item, window=13, least=10):
    """The rule, by every diagonal: the most equal tokens of a window, or None."""
    w, best = min(window, len(item)), -1
    for d in range(1 - len(item), len(doc)):
        same = [0 <= d + j < len(doc) and doc[d + j] == item[j] for j in range(len(item))]
        best = max(best, *(sum(same[k : k + w]) for k in range(len(item) - w + 1)))
    return best if best >= math.ceil(w * least / window) else None


def test_decontamination_finds_each_pattern_of_three_substitutions(spark):
    item = [f"w{i}" for i in range(13)]
    rows = [(k, " ".join("x" if i in gone else t for i, t in enumerate(item))) for k, gone in enumerate(itertools.combinations(range(13), 3))]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert len(rows) == 286 and {r.doc_id for r in D.find(docs, bench).collect()} == {k for k, _ in rows}


@pytest.mark.parametrize("most", [D.BROADCAST_TOKENS, 0])
def test_decontamination_matches_the_rule_by_brute_force(spark, most, monkeypatch):
    monkeypatch.setattr(D, "BROADCAST_TOKENS", most)
    pick = random.Random(11)
    items = {n * 10 + k: [f"t{pick.randrange(400)}" for _ in range(n)] for n in [*range(1, 15), 16, 20, 24, 40] for k in range(2)}
    docs = {}
    for i in range(200):
        item = items[pick.choice(list(items))]
        rate = pick.choice([0, 0.1, 0.15, 0.2, 0.3])
        leak = [t if pick.random() >= rate else "x" for t in item][pick.choice([0, 0, 0, 2]) :]
        around = [[f"t{pick.randrange(400)}" for _ in range(pick.choice([0, 3, 20]))] for _ in range(2)]
        docs[i] = around[0] + leak + around[1]
    want = {(i, k, n) for i, d in docs.items() for k, item in items.items() if (n := holds(d, item)) is not None}
    rows = D.find(spark.createDataFrame([(i, " ".join(d)) for i, d in docs.items()], "doc_id long, text string"), spark.createDataFrame([(k, " ".join(t)) for k, t in items.items()], "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.same) for r in rows} == want
    assert min(len(items[k]) for _, k, _ in want) == 1


@pytest.mark.parametrize("size", range(1, 14))
def test_some_mask_survives_each_pattern_of_substitutions(size):
    wrong = size - math.ceil(size * 10 / 13)
    chosen = D.masks(size, wrong)
    for gone in itertools.combinations(range(size), wrong):
        assert any(all(a + p not in gone for p in mask) for mask in chosen for a in range(size - mask[-1]))
    if size == 13:
        assert sorted(len(m) for m in chosen) == [5, 5, 5] and all(m[-1] >= len(m) for m in chosen)  # each ignores some inner token


@pytest.mark.parametrize("most", [D.BROADCAST_TOKENS, 0])
def test_decontamination_of_long_texts_ties_and_repeated_rows(spark, most, monkeypatch):
    monkeypatch.setattr(D, "BROADCAST_TOKENS", most)
    item = [f"w{i}" for i in range(20)]
    long = ["the"] * 30_000
    long[20_000:20_020] = item
    rows = [(1, " ".join(long)), (2, " ".join([*item[:13], "x", *item[:13]])), (3, " ".join(item)), (3, " ".join(item)), (4, "the " * 20_000)]
    docs = spark.createDataFrame([(i, t, "seed", 7) for i, t in rows], "doc_id long, text string, h string, item_at int")
    bench = spark.createDataFrame([(1, " ".join(item), "w"), (2, "the " * 13, "w"), (1, " ".join(item), "w")], "item_id long, text string, span string")
    got = sorted((r.doc_id, r.item_id, r["at"], r.same) for r in D.find(docs, bench).collect())
    # Of the equal places of "the" the first counts.
    assert got == [(1, 1, 20_000, 13), (1, 2, 0, 13), (2, 1, 0, 13), (3, 1, 0, 13), (4, 2, 0, 13)]


MIT = """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""


def test_license_rules(spark):
    rows = [(1, MIT), (2, None), (3, ""), (4, "Text.\nLicensed under CC BY-NC 4.0.\nReleased under the MIT License."), (5, "# SPDX-License-Identifier: GPL-3.0-or-later\n"), (6, "the license of birds, with permission"), (7, "This work is licensed under the GNU General Public License, version 3.")]
    wrapped = "Licensed under CC BY-NC 4.0\nsome more text of the page\n\n" + MIT.split("\n\n", 1)[1]
    rows += [(8, wrapped), (9, MIT.replace("License\n\n", "License\n")), (10, "x\n" + MIT + "\n" + "word " * 50_000 + "\n" + MIT), (11, "This is free and unencumbered software released\n  into the public domain."), (4, rows[3][1])]
    df = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], "doc_id long, text string, licenses string, s int, t string")
    out = {r.doc_id: (r.licenses, r.n_known) for r in L.scan(df).collect()}
    assert out == {1: ("MIT", 3), 2: ("", 0), 3: ("", 0), 4: ("MIT,CC-BY-NC-4.0", 2), 5: ("GPL-3.0-or-later", 1), 6: ("", 0), 7: ("GPL-3.0-only", 1), 8: ("MIT,CC-BY-NC-4.0", 4), 9: ("MIT", 3), 10: ("MIT", 6), 11: ("Unlicense", 1)}
    assert L.scan(df).count() == len(rows)
    assert L.scan(df.limit(0)).count() == 0


@pytest.mark.parametrize("run", [" ", ".", "! ", "\n", " \n", "a\n", "license ", "license\n"])
def test_license_scan_takes_linear_time(spark, run):
    df = spark.createDataFrame([(1, "Released under the MIT License.\n\n" + run * (1_000_000 // len(run)) + "x")], "doc_id long, text string")
    began = time.perf_counter()
    assert [r.licenses for r in L.scan(df).collect()] == ["MIT"]
    assert time.perf_counter() - began < 20


def test_every_license_sentence_has_an_anchor():
    assert all(any(a in s for a in L.ANCHORS) for s in L.SENTENCES.values())
    assert all(s in L.SENTENCES for _, sequence in L.RULES for s in sequence)


def test_boundaries_are_optimal():
    from itertools import combinations

    pick = np.random.default_rng(1)
    longest = np.sort(pick.choice(200, 9, replace=False)).astype(float)
    rows = pick.integers(1, 50, 9).astype(float)
    cost = lambda ends: sum(r * min(e for e in ends if e >= x) for x, r in zip(longest, rows, strict=True))
    for k in (1, 2, 3, 4, 9, 20):
        best = min(cost([*c, longest[-1]]) for n in range(min(k, 9)) for c in combinations(longest[:-1], n))
        got = K.boundaries(longest, rows, k)
        assert len(got) <= k and cost(got) == best
    assert K.boundaries(np.zeros(0), np.zeros(0), 3) == []


def test_packing_places_each_row_once(corpus, texts, monkeypatch):
    monkeypatch.setattr(K, "SHARD_ROWS", 7)
    rows = K.pack(corpus, buckets=4, budget=300).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in rows) == Counter((i, len((t or "").encode().split())) for i, t in texts)
    for bucket in {r.bucket for r in rows}:
        of = [r for r in rows if r.bucket == bucket]
        size = max(1, 300 // max(1, of[0].bucket_tokens))
        places = sorted(r.batch * size + r.place for r in of)
        assert places == list(range(len(of)))  # full batches but for the last
        assert all(r.n_tokens <= r.bucket_tokens and r.place < size for r in of)
    assert K.pack(corpus.limit(0)).count() == 0


def test_quality_learns_and_holds_out(spark):
    pick = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(600):
        good = i % 3 > 0
        words = ["".join(pick.choice(list("abcdefgh"), 5)) for _ in range(pick.integers(20, 60))]
        rows.append((i, " ".join(words) if good else " ".join(w.upper() + "!!" for w in words), i))
        labels.append((i, int(good), 0))
    rows += [(1000, None, 0), (1001, "", 0), (5, rows[5][1], 5), (999, "plain words of a long text " * 40_000, 0)] + [(8, "other " * k, 0) for k in range(1, 40)]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string, score long"), spark.createDataFrame([*labels, (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    out = Q.quality(docs, known).collect()
    assert len(out) == len(rows)
    held = [r for r in out if r.held_out and r.doc_id < 600]
    assert held and np.mean([r.predicted == int(r.doc_id % 3 > 0) for r in held]) > 0.97
    assert len({r.score for r in out if r.doc_id >= 1000}) == 1 and all(0 <= r.score <= 1 for r in out)
    kept = Q.keep_good(docs, known)
    assert kept.columns == docs.columns
    assert Q.quality(docs.limit(0), known).count() == 0
    assert {r.score for r in Q.quality(docs, known.limit(0)).collect()} == {0.5}


def test_statistics_of_edge_texts():
    x = Q.statistics(pa.array([None, "", " ", "a", "é" * 10, "a" * 100_000, "\n\n"]))
    assert x.shape == (7, len(Q.STATISTICS)) and np.isfinite(x).all()


def test_trees_agree_with_a_plain_walk():
    pick = np.random.default_rng(5)
    x = pick.standard_normal((300, 6))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] * x[:, 3] > 0)).astype(float)
    model = Q.fit(x, y, trees=12, depth=3, bins=16)
    scores = model.score(x)
    for row, score in zip(x, scores, strict=True):
        margin = model.base
        for feature, threshold, leaf in zip(model.feature, model.threshold, model.leaf, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            margin += leaf[node - len(feature)]
        assert score == pytest.approx(1 / (1 + math.exp(-margin)))
    assert ((scores > 0.5) == (y > 0.5)).mean() > 0.75

import math
import random

import numpy as np
import pytest

from quire.llm import negatives as N


@pytest.mark.parametrize("shape", [(1, 1, 1), (33, 64, 40), (64, 64, 64), (65, 67, 71), (100, 3, 90), (0, 5, 7), (40, 0, 40), (129, 128, 200)])
def test_strassen_is_exact(shape):
    m, k, n = shape
    pick = np.random.Generator(np.random.PCG64(1))
    for most in (300, 2**62):  # products of the latter wrap around, as they do in a plain multiplication
        a, b = pick.integers(-most, most, (m, k)), pick.integers(-most, most, (k, n))
        for leaf in (1, 8, 32):
            assert np.array_equal(N.strassen(a, b, leaf), a @ b)


def test_heaps_keep_the_best_and_go_by_id_among_equals():
    pick = random.Random(2)
    heap, seen = N.Heap(6, 4), {r: [] for r in range(6)}
    for _ in range(12):
        ids = np.sort(np.array(pick.sample(range(100_000), 9)))
        scores = np.array([[pick.choice([-5, 0, 1, 2, N._LOWEST]) for _ in ids] for _ in range(6)], dtype=np.int64)
        allowed = np.array([[pick.random() < 0.4 for _ in ids] for _ in range(6)])
        heap.add(scores, ids, allowed)
        for r in range(6):
            seen[r] += [(-int(s), int(i)) for s, i, a in zip(scores[r], ids, allowed[r], strict=True) if a]
    for r in range(6):
        at = heap.row == r
        assert [(-int(s), int(i)) for s, i in zip(heap.score[at], heap.id[at], strict=True)] == sorted(seen[r])[:4]


def brute(rows, positives=5, negatives=10):
    """rows: vec_id, label, vector; one for each vec_id."""
    good = [(i, l, [math.floor(256 * x) for x in v]) for i, l, v in rows if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, l, v in good:
        if i % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j, m) for j, m, w in good if j != i)
            for p, j, _ in [s for s in scored if s[2] == l][:positives]:
                fit = [(n, k) for n, k, m in scored if m != l and 30 * -p <= 100 * -n <= 90 * -p][:negatives]
                out += [(i, j, r, k, -p, -n) for r, (n, k) in enumerate(fit, 1)]
    return out


def vectors(pick, n, dim, labels):
    centres = [[pick.gauss(0, 1) for _ in range(dim)] for _ in range(3)]
    return [(i, pick.randrange(labels), [c + pick.gauss(0, 1) for c in pick.choice(centres)]) for i in range(n)]


def rows_of(df):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


@pytest.mark.parametrize("dim, labels, anchors, tile, share", [(64, 4, 4096, 1024, 1_000_000), (40, 2, 3, 7, 50), (5, 10, 4096, 64, 1_000_000)])
def test_mined_rows_match_brute_force(spark, monkeypatch, dim, labels, anchors, tile, share):
    monkeypatch.setattr(N, "ANCHORS", anchors)
    monkeypatch.setattr(N, "SHARE", share)
    pick = random.Random(dim)
    rows = vectors(pick, 900, dim, labels)
    rows += [(1000 + k, k % labels, rows[0][2]) for k in range(60)]  # many equal scores
    rows += [(2000, None, [1.0] * dim), (2001, 1, None), (2100, 1, [math.nan] * dim), (2200, 1, [1.0, None]), (2300, 1, [math.inf] * dim), (2400, 1, []), (2500, 1, [1.0, 2.0]), (None, 1, [1.0] * dim), (-100, 0, [0.5] * dim)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").selectExpr("*", "1 id", "'x' block", "array(2.0) v")
    got, want = rows_of(N.mine(df)), sorted(brute(rows))
    assert got == want and len(want) > 100


def test_rows_that_share_an_id_and_empty_tables(spark):
    rows = [(100, 2, [3.0]), (100, 1, [1.0]), (100, 1, [0.9]), (1, 1, [1.0]), (2, 5, [0.5]), (2, 5, [0.5])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    assert rows_of(N.mine(df)) == sorted(brute([(100, 1, [np.float32(0.9)]), (1, 1, [1.0]), (2, 5, [0.5])]))
    assert N.mine(df.limit(0)).count() == 0
    assert N.mine(df.filter("vec_id < 100")).count() == 0


def test_huge_components_do_not_fail(spark):
    df = spark.createDataFrame([(100, 1, [1e300]), (1, 1, [-1e300]), (2, 2, [1e300])], "vec_id long, label int, embedding array<double>")
    N.mine(df).collect()


def test_labels_move_on(spark):
    df = spark.createDataFrame([(7, 9, [1.0]), (8, 9, [1.0]), (14, None, None), (None, 3, [1.0])], "vec_id long, label int, embedding array<float>")
    assert {(r.vec_id, r.label) for r in N.relabelled(df).collect()} == {(7, 0), (8, 9), (14, None), (None, 3)}

import numpy as np
import pytest

from quire.llm import embeddings as V
from quire.llm import graph
from quire.llm import minhash as M
from quire.llm.graph import components


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingle_set(text):
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4))


@pytest.mark.parametrize("local", [1_000_000, 10])
def test_components_of_paths_stars_and_loops(spark, local, monkeypatch):
    monkeypatch.setattr(graph, "_LOCAL", local)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, x) for x in range(200, 260)] + [(5, 5), (3, 7), (900, 800), (800, 900)]
    got = {r.id: r.component_id for r in components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    want = roots({x for e in edges for x in e}, edges)
    assert got == {k: v for k, v in want.items() if k != 5}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_match_brute_force(corpus, texts):
    sets = {i: shingle_set(t) for i, t in texts}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = roots(ids, links)
    rows = M.link(corpus).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_deduplicate_keeps_columns_and_least_ids(corpus, texts):
    kept = M.deduplicate(corpus)
    assert kept.columns == corpus.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {400, 401, 402, 403, 408} <= ids and 404 not in ids and not ids & set(range(201, 225))
    assert M.link(corpus.limit(0)).count() == 0


def test_other_texts_of_a_doc_id_are_judged_apart(spark):
    words = " ".join(f"w{i}" for i in range(40))
    rows = [(1, words), (2, words), (2, "another text under the same number that nothing else resembles"), (2, words), (3, None), (None, words), (4, "")]
    kept = M.deduplicate(spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, fingerprint int"))
    assert sorted(((r.doc_id or 0), (r.text or "")[:3]) for r in kept.collect()) == [(0, "w0 "), (1, "w0 "), (2, "ano"), (3, ""), (4, "")]


def test_estimate_is_close():
    import pyarrow as pa

    words = [f"w{i}" for i in range(400)]
    texts = pa.array([" ".join(words), " ".join(words[:380])])
    value, offsets = M.shingles(texts)
    a, b = set(value[: offsets[1]].tolist()), set(value[offsets[1] :].tolist())
    _, planes = M.sign(value, offsets)
    lanes = 128 - sum(bin(((int(planes[0, i]) ^ int(planes[1, i])) | (int(planes[0, i + 1]) ^ int(planes[1, i + 1]))) & (2**64 - 1)).count("1") for i in (0, 2))
    assert abs((lanes / 128 - 0.25) / 0.75 - len(a & b) / len(a | b)) < 0.2


@pytest.fixture(scope="module")
def vectors(spark):
    pick = np.random.default_rng(3)
    base = pick.standard_normal((60, 16))
    rows = [(i, base[i].tolist()) for i in range(60)]
    rows += [(100 + i, (base[3] + pick.standard_normal(16) * 0.12).tolist()) for i in range(40)]
    rows += [(200 + i, (base[4] + pick.standard_normal(16) * 0.3).tolist()) for i in range(30)]
    rows += [(300, base[9].tolist()), (301, (base[9] * 7).tolist()), (302, (base[9] * 1e-30).tolist()), (303, base[9].tolist())]
    rows += [(400, None), (401, []), (402, [0.0] * 16), (403, [float("nan")] * 16), (404, [None] * 16), (405, [float("inf"), *[1.0] * 15]), (406, base[9][:8].tolist()), (303, base[9].tolist())]
    return rows


@pytest.mark.parametrize("block", [512, 4])
def test_vectors_match_brute_force(spark, vectors, block, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", block)
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in vectors], "vec_id long, embedding array<double>, label int, id string")
    good = [(i, np.array(v)) for i, v in vectors if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = [(i, v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max())) for i, v in good]
    near = [[k for k in range(len(unit)) if k != j and len(unit[k][1]) == len(unit[j][1]) and unit[j][1] @ unit[k][1] >= 0.95] for j in range(len(unit))]
    want = roots({i for i, _ in vectors}, [(unit[j][0], unit[k][0]) for j in range(len(unit)) for k in near[j]])
    links = {unit[j][0]: len(near[j]) for j in range(len(unit))}
    rows = V.link(df).collect()
    assert len(rows) == len(vectors)
    for r in rows:
        assert (r.n_links, r.component_id, r.kept) == (links.get(r.vec_id, 0), want[r.vec_id], want[r.vec_id] == r.vec_id)
    assert V.link(df.limit(0)).count() == 0


def crowded(pick, n, dims, cosine):
    """Unit vectors of mutual cosine `cosine` on average."""
    axis = pick.standard_normal(dims)
    axis /= np.linalg.norm(axis)
    x = pick.standard_normal((n, dims))
    x -= np.outer(x @ axis, axis)
    x /= np.linalg.norm(x, axis=1)[:, None]
    return np.sqrt(cosine) * axis + np.sqrt(1 - cosine) * x


@pytest.mark.parametrize("block", [1024, 2])
def test_links_in_crowds_are_found(spark, block, monkeypatch):
    """Cones of mutual cosine 0.9 and 0.8, in which few pairs reach 0.95; blocks of 2 would copy so often that passes are taken."""
    monkeypatch.setattr(V, "BLOCK", block)
    pick = np.random.default_rng(8)
    x = np.concatenate([crowded(pick, 900, 32, 0.9), crowded(pick, 300, 32, 0.8), pick.standard_normal((300, 32))])
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    want = roots(range(len(x)), list(zip(*np.nonzero(near), strict=True)))
    rows = V.link(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()
    found = sum(r.n_links for r in rows)
    assert near.sum() > 300 and found <= near.sum()
    assert found >= (near.sum() if block > 2 else 0.99 * near.sum())
    if block > 2:
        assert {r.vec_id: r.component_id for r in rows} == want


def test_links_in_wider_cones_are_found(spark):
    """Cones of mutual cosine 0.80 to 0.89, whose vectors have mates right above the threshold."""
    pick = np.random.default_rng(5)
    cones = [crowded(pick, 2500, 64, c) for c in (0.8, 0.83, 0.86, 0.89)]
    mates = []
    for x in cones:
        cosine = pick.uniform(0.9505, 0.956, 100)[:, None]
        aside = pick.standard_normal((100, 64))
        aside -= (aside * x[:100]).sum(axis=1, keepdims=True) * x[:100]
        mates.append(cosine * x[:100] + np.sqrt(1 - cosine**2) * aside / np.linalg.norm(aside, axis=1)[:, None])
    x = np.concatenate([*cones, *mates])
    x /= np.linalg.norm(x, axis=1)[:, None]
    total = sum(int((x[k : k + 500] @ x.T >= 0.95).sum()) for k in range(0, len(x), 500)) - len(x)
    found = sum(r.n_links for r in V.link(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect())
    assert total >= 800 and 0.99 * total <= found <= total

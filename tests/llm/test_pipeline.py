import itertools
import random
import re
from collections import Counter

import corpus_pipeline
from quire.llm import decontaminate, minhash, packing, pii, quality
from tests.llm.test_near_duplicates import roots, shingle_set
from tests.llm.test_text_operators import holds


def test_stages_take_effect(spark, tmp_path):
    good = ["the plain report {} describes how {} people in the town number {} went to work at {} each day and what they saw on their way".format(a, b, c, a * b) for a in range(8) for b in range(8) for c in range(4)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(good)]
    item = "benchmark passage with quite a few words that must never show up in any of the training documents at all"
    rows += [(1000 + i, "WOW!! BUY!! NOW!! " * 10, "en", "s", 1) for i in range(60)]
    rows += [(2000, item, "en", "s", len(item)), (2001, "mail me at someone@example.com about the plain report number nine that nobody in town has read", "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 1000 or i >= 2000), 0) for i, *_ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == columns
        out.write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        ids = {r.doc_id for r in docs.collect()}
        assert not any(1000 <= i < 2000 for i in ids)
        if name in ("decontamination", "personal_data", "packing"):
            assert 2000 not in ids and 2001 in ids
        if name == "personal_data":
            assert [r.text for r in docs.filter("doc_id = 2001").collect()][0].startswith("mail me at <EMAIL> about")
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == ids
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5
    assert all(m for m in (decontaminate, minhash, packing, pii, quality))


WORDS = [a + b for a in ("al", "be", "co", "du", "en", "fi") for b in ("ma", "ne", "ri", "so", "tu")]


def tables(spark, path, documents, labels, benchmark, schema="doc_id long, text string, lang string, source string, n_chars long"):
    spark.createDataFrame(documents, schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_stages_match_brute_force_and_take_edge_cases(spark, tmp_path):
    """Nulls, empty, repeated and very long texts, ties and clashing columns go through; each stage's decision is redone plainly."""
    pick = random.Random(6)
    prose = lambda n: " ".join(pick.choice(WORDS) + pick.choice(WORDS) for _ in range(n))
    item = prose(20)
    texts = [(i, prose(pick.randint(20, 60))) for i in range(120)]
    texts += [(200 + i, texts[i][1] + " " + prose(pick.randint(0, 12))) for i in range(0, 60, 3)]
    texts += [(300 + i, prose(9) + " " + " ".join(w if pick.random() > k / 20 else "x" for w in item.split()) + " " + prose(9)) for i, k in enumerate([0, 1, 2, 3, 4, 6, 9])]
    texts += [(400 + i, f"{prose(12)} write to some.one@example.com or 10.0.0.{i} {prose(12)}") for i in range(5)]
    texts += [(500, None), (501, ""), (None, prose(30)), (502, "one two"), (503, " ".join([prose(40)] * 2000)), texts[3], texts[3], (600, texts[3][1])]
    bad = [(1000 + i, "BUY!! " * pick.randint(5, 40)) for i in range(60)]
    rows = [(i, t, "en", "s", len(t or ""), 1, "x", 0.5) for i, t in texts + bad]
    schema = "doc_id long, text string, lang string, source string, n_chars long, seed int, fingerprint string, score double"
    tables(spark, tmp_path, rows, [(i, int(i is None or i < 1000), 0) for i, _ in texts + bad], [(1, item), (2, None), (None, item)], schema)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r.doc_id, r.text) for r in docs.collect()]
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        columns, docs = docs.columns, spark.read.parquet(f"{tmp_path}/out{k}")
        after = docs.collect()
        count = lambda pairs: Counter((i, t) for i, t in pairs)
        if name != "packing":
            assert docs.columns == columns
        if name == "quality":
            scored = {(r.doc_id, r.text): r.s for r in quality.score(spark.createDataFrame(before, "doc_id long, text string"), quality.train(spark.createDataFrame(before, "doc_id long, text string"), spark.read.parquet(f"{tmp_path}/labels.parquet")), "s").collect()}
            assert count((r.doc_id, r.text) for r in after) == count(x for x in before if scored[x] >= 0.3)
            assert not any((r.doc_id or 0) >= 1000 for r in after)
        elif name == "near_duplicates":
            sets = [(i, t, shingle_set(t)) for i, t in before]
            linked = lambda a, b: a and 100 * len(a & b) >= 75 * len(a | b)
            links = [(a[0], b[0]) for a, b in itertools.combinations([s for s in sets if s[0] is not None], 2) if linked(a[2], b[2])]
            root = roots({i for i, _ in before if i is not None}, links)
            assert count((r.doc_id, r.text) for r in after) == count((i, t) for i, t in before if i is None or root[i] == i)
        elif name == "decontamination":
            leaks = lambda t: holds([w for w in re.split(r"[^\w]+|_", (t or "").lower()) if w], item.split()) is not None
            assert count((r.doc_id, r.text) for r in after) == count((i, t) for i, t in before if i is None or not leaks(t))
            assert 0 < len(after) < len(before)
        elif name == "personal_data":
            assert count((r.doc_id, r.text) for r in after) == count((i, pii.mask(t)) for i, t in before)
            assert any("<EMAIL>" in (r.text or "") for r in after) and all(r.n_chars == (len(r.text) if r.text is not None else None) for r in after)
        else:
            assert Counter((r.doc_id, r.n_tokens) for r in after) == Counter((i, len((t or "").split())) for i, t in before)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(after)


def test_empty_tables_go_through(spark, tmp_path):
    tables(spark, tmp_path, [], [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

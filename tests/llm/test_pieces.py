import hashlib
import random

import numpy as np
import pytest

from quire.llm import pieces as P

public_tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "a", " a ", "\n", "▁", "▁▁ x", "<s>", "</s>", "<unk>", "<0x41>", "\0", "a\0b", "é" * 50, "日本語テキスト", "👨\u200d👩\u200d👧", "⁇", "a   b" + " " * 40 + "d", "\t\tx\n\n y", "\r\n", "\ufeff x", "\ufffd"]


@pytest.fixture(scope="module")
def vocabulary():
    with open(MODEL, "rb") as f:
        return P.Vocabulary(f.read())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def made(pick: random.Random, n: int, most: int) -> list[str]:
    parts = ["a", "b", " ", "   ", "▁", "the", "é", "\n", "ing", "tion", "日", "👍", "<s>", "0", "1", ".", ",", "\0", "\u0301", "x" * 30]
    return ["".join(pick.choice(parts) for _ in range(pick.randint(0, most))) for _ in range(n)]


def test_ids_and_texts_are_those_of_the_library(vocabulary, library):
    pick = random.Random(1)
    texts = ODD + made(pick, 3000, 60) + made(pick, 30, 4000)
    ids, offsets = vocabulary.encode(texts)
    for k, want in enumerate(library.encode(texts, add_eos=True)):
        got = ids[offsets[k] : offsets[k + 1]]
        assert got.tolist() == want, texts[k]
        assert vocabulary.decode(got) == library.decode(want), texts[k]


def test_any_ids_decode_as_in_the_library(vocabulary, library):
    pick = random.Random(2)
    rows = [[pick.randrange(0 if pick.random() < 0.1 else 3, 32000 if pick.random() < 0.3 else 300) for _ in range(pick.randint(0, 12))] for _ in range(5000)]
    for ids, want in zip(rows, library.decode(rows), strict=True):
        assert vocabulary.decode(np.array(ids, dtype=np.int64)) == want, ids


def test_both_agendas_agree(vocabulary):
    chunks = [c for t in made(random.Random(3), 500, 12) if (c := t.replace(" ", "▁")) and len(c) <= 32]
    ids, sizes = vocabulary.merge_all(chunks)
    for c, end, n in zip(chunks, np.cumsum(sizes), sizes, strict=True):
        assert ids[end - n : end].tolist() == vocabulary.merge(c)[0].tolist()


def test_forgetting_changes_nothing(vocabulary, monkeypatch):
    texts = made(random.Random(4), 200, 30)
    want = vocabulary.encode(texts)[0].tolist()
    monkeypatch.setattr(P, "KEPT_CHARS", 10)
    for k in range(0, 200, 50):
        vocabulary.encode(texts[k : k + 50])
    assert vocabulary.encode(texts)[0].tolist() == want


def test_long_unbroken_text(vocabulary, library):
    text = "theing" * 50_000
    assert vocabulary.encode([text])[0].tolist() == library.encode(text, add_eos=True)


def test_rows_through_spark(spark, corpus, texts, library):
    got = P.digest(P.decode(P.encode(corpus, MODEL, check=True), MODEL, check=True)).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in texts:
        ids = library.encode(t or "", add_eos=True)
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))))
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert P.decode(P.encode(corpus.limit(0), MODEL), MODEL).count() == 0
    nulls = spark.createDataFrame([(1, None), (None, [2])], "doc_id long, ids array<int>")
    assert {(r.doc_id, r.text) for r in P.decode(nulls, MODEL).collect()} == {(1, ""), (None, "")}


def test_other_vocabularies_are_refused(vocabulary):
    with open(MODEL, "rb") as f:
        model = f.read()
    with pytest.raises(ValueError, match="merge type"):
        P.Vocabulary(model.replace(b"\x18\x02\x20\x80\xfa\x01", b"\x18\x01\x20\x80\xfa\x01"))

import random

import pytest

WORDS = [a + b for a in ("al", "be", "co", "du", "en", "fi", "go", "hu") for b in ("ma", "ne", "ri", "so", "tu", "va", "xi", "zo")]


def prose(pick: random.Random, n: int) -> list[str]:
    return [pick.choice(WORDS) + pick.choice(WORDS) for _ in range(n)]


@pytest.fixture(scope="session")
def corpus(spark):
    """Texts with exact and near copies, a shared passage, repeated rows, nulls, empty and very long ones, and extra columns with clashing names."""
    pick = random.Random(5)
    base = [prose(pick, pick.randint(30, 120)) for _ in range(40)]
    passage = prose(pick, 30)
    rows = []
    for i, words in enumerate(base):
        rows.append((i * 3 + 1, " ".join(words)))
    for i in range(25):  # one group of near copies, one text of which is the least changed
        words = list(base[7])
        for _ in range(pick.randint(0, 2)):
            words[pick.randrange(len(words))] = pick.choice(WORDS)
        rows.append((200 + i, "\n".join(words) if i % 5 == 0 else " ".join(words).upper() if i % 5 == 1 else " ".join(words)))
    for i in range(12):
        rows.append((300 + i, " ".join([*prose(pick, 20 + i), *passage, *prose(pick, 15)])))
    rows += [(400, None), (401, ""), (402, "  \n\t "), (403, "one two three"), (404, "one two three"), (405, "é" * 60), (406, "x" + "é" * 60), (407, "line of text that repeats itself " * 3000), (408, "short"), (22, " ".join(base[7]))]
    rows.append(rows[5])
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0, "a", 1.5) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, id int, _gone string, score double")


@pytest.fixture(scope="session")
def texts(corpus):
    return [(r.doc_id, r.text) for r in corpus.collect()]

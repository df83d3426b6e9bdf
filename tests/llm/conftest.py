import random

import pytest


@pytest.fixture(scope="session")
def corpus(spark):
    """Small documents with copies, near copies, a shared passage, nulls, empty and long texts, a repeated row and a further column."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    passage = " ".join(word() for _ in range(60))
    texts = []
    for i in range(60):
        base = [word() for _ in range(rng.choice([3, 6, 40, 150]))]
        texts.append(" ".join(base))
        for _ in range(i % 4):
            near = list(base)
            near[rng.randrange(len(near))] = word()
            texts.append(" ".join(near))
        if i % 5 == 0:
            texts += [" ".join(base).upper(), "  ".join(base) + "\n", passage + " " + " ".join(word() for _ in range(80))]
    texts += [None, "", " \t\n", "one", "One", "a b c d", "x " * 30_000, " ".join(word() for _ in range(30_000)), "éß 日本 \U0001F600 mail a@b.co"]
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", len(t or ""), i % 2, "further") for i, t in enumerate(texts)]
    rows.append(rows[4])
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, k long, score string")


@pytest.fixture(scope="session")
def empty(corpus):
    return corpus.limit(0)

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom import session
from tabloom.operators import word_vectors
from tabloom.plans import registry

TEXTS = ["a b c a", "B a d", None, "", "x", "c d e f g h c d", "a b c a", "e f e f q"]


def _table(texts, window, shift=1.0):
    counts = {}
    for t in texts:
        w = (t or "").lower().split()
        for i in range(len(w)):
            for j in range(i + 1, min(len(w), i + window + 1)):
                for pair in ((w[i], w[j]), (w[j], w[i])):
                    counts[pair] = counts.get(pair, 0) + 1
    total, of = sum(counts.values()), {}
    for (a, _), n in counts.items():
        of[a] = of.get(a, 0) + n
    cells = {(a, b): np.log(n * total / (of[a] * of[b])) - np.log(shift) for (a, b), n in counts.items()}
    return counts, {p: v for p, v in cells.items() if v > 0}


@pytest.mark.parametrize("window, stretch", [(1, 1000), (2, 1), (5, 3)])
def test_neighbours_and_associations(spark, monkeypatch, window, stretch):
    monkeypatch.setattr(word_vectors, "WORDS_PER_STRETCH", stretch)
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    counts, cells = _table(TEXTS, window, 1.5)
    found = word_vectors.neighbour_counts(df, "t", window)
    assert {(r.word, r.context): r.n for r in found.collect()} == counts
    got = {(r.word, r.context): r.value for r in word_vectors.associations(found, 1.5).collect()}
    assert got == pytest.approx(cells)


@pytest.mark.parametrize("shared", [False, True])
def test_pairs_are_sent_once_and_as_numbers(spark, monkeypatch, shared):
    if shared:
        own = word_vectors._number
        monkeypatch.setattr(word_vectors, "_number", lambda word, turn: F.length(word).cast("long") if turn < 2 else own(word, turn))
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    counts, cells = _table(TEXTS, 2, 1.5)
    found = word_vectors.numbered_neighbours(df, "t", 2)
    assert found.pairs.dtypes == [("a", "bigint"), ("b", "bigint"), ("n", "bigint")]
    assert found.pairs.count() == len({tuple(sorted(p)) for p in counts})
    weighed = found.named(word_vectors.associations(found, 1.5), "word", "context").collect()
    assert {(r.word, r.context): r.value for r in weighed} == pytest.approx(cells)
    assert all(r.n == counts[r.word, r.context] for r in weighed)


def test_vectors_are_the_leading_eigenvectors(spark):
    rng = np.random.default_rng(3)
    # Three topics with words of their own and a few words in common.
    texts = [" ".join(rng.choice([f"{t}{i}" for i in range(8)] + ["and", "or"], 30)) for t in "xyz" for _ in range(12)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    fitted = word_vectors.fit_word_vectors(df, "t", 4, 3, rounds=8)
    _, cells = _table(texts, 3)
    names = sorted({a for a, _ in cells})
    matrix = np.array([[cells.get((a, b), 0.0) for b in names] for a in names])
    values, basis = np.linalg.eigh(matrix)
    best = np.argsort(-np.abs(values))[:4]
    assert np.abs(fitted.values) == pytest.approx(np.abs(values[best]), rel=1e-3)
    rows = {r.word: np.array(r.vector) for r in fitted.table.collect()}
    assert sorted(rows) == names
    got = np.array([rows[n] for n in names])
    want = basis[:, best] * np.sqrt(np.abs(values[best]))
    assert got @ got.T == pytest.approx(want @ want.T, abs=0.05)
    near = [r.word for r in word_vectors.nearest_words(fitted, "x1", 5).collect()]
    assert all(w.startswith("x") for w in near)


def test_document_vectors_save_and_replay(spark, tmp_path):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "word int, t string")
    fitted = word_vectors.fit_word_vectors(df, "t", 3)
    fitted.save(str(tmp_path / "vectors"))
    again = word_vectors.WordVectors.load(spark, str(tmp_path / "vectors"), 3)
    assert again.values == pytest.approx(fitted.values)
    new = spark.createDataFrame([(1, "a a never"), (1, "a a never"), (2, None), (3, "never")], "n int, t string")
    rows = word_vectors.document_vectors(new, "t", again).orderBy("n").collect()
    a = [r.vector for r in fitted.table.filter("word = 'a'").collect()][0]
    assert len(rows) == 4 and rows[0] == rows[1]
    assert list(rows[0])[1:] == pytest.approx([2 * x / 3 for x in a])
    assert list(rows[2])[1:] == list(rows[3])[1:] == [0.0] * 3
    # A column called `word` is an ordinary column.
    assert word_vectors.document_vectors(df, "t", fitted, False).columns == ["word", "t", "w2v_dim_0", "w2v_dim_1", "w2v_dim_2"]
    assert word_vectors.document_vectors(df, "t", fitted).count() == len(TEXTS)


def test_no_words(spark):
    df = spark.createDataFrame([("one",), (None,)], "t string")
    for rows in (df, df.limit(0)):
        fitted = word_vectors.fit_word_vectors(rows, "t", 2)
        assert fitted.table.count() == 0
        assert [list(r) for r in word_vectors.document_vectors(rows, "t", fitted).collect()] == [[0.0, 0.0]] * rows.count()
    assert word_vectors.nearest_words(fitted, "one").count() == 0


def test_min_count_leaves_rare_words_out(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    counts, cells = _table(TEXTS, 5)
    of = {}
    for (a, _), n in counts.items():
        of[a] = of.get(a, 0) + n
    got = word_vectors.associations(word_vectors.neighbour_counts(df, "t"), min_count=9)
    assert {(r.word, r.context) for r in got.collect()} == {p for p in cells if min(of[p[0]], of[p[1]]) >= 9}


def test_step(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, t string")
    out = registry._vectorize({"dataframe": df}, {"method": "neighbours", "max_features": 2})
    assert out["dataframe"].columns == ["id", "w2v_dim_0", "w2v_dim_1"] and out["text_column"] == "t"


def _few_known(monkeypatch):
    """Three words known to every task, the rest in many parts, counted in short stretches."""
    for name, value in (("HEAD", 3), ("PAIRS_PER_PART", 10), ("WORDS_PER_STRETCH", 7), ("COMMON_BYTES", 64)):
        monkeypatch.setattr(word_vectors, name, value)


def test_pairs_of_words_that_no_task_knows(spark, monkeypatch):
    _few_known(monkeypatch)
    rng = np.random.default_rng(8)
    texts = [*TEXTS, *[" ".join(rng.choice([f"w{i}" for i in range(40)], n)) for n in (1, 2, 30, 200)], "b b b", "q q"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(3)
    counts, cells = _table(texts, 4, 1.2)
    found = word_vectors.numbered_neighbours(df, "t", 4)
    assert found.parts > 20 and 0 < len(found.head.value.ids) <= 3 and found.blocks.filter("kind = 2").count() > 20
    names = {r.id: r.word for r in found.words.collect()}
    pairs = {tuple(sorted((names[r.a], names[r.b]))): r.n for r in found.pairs.collect()}
    assert pairs == {(a, b): n // 2 if a == b else n for (a, b), n in counts.items() if a <= b}
    rows = found.named(word_vectors.associations(found, 1.2), "word", "context").collect()
    assert {(r.word, r.context): r.value for r in rows} == pytest.approx(cells) and len(rows) == len(cells)
    assert {r.word: r.of_word for r in found.words.collect()} == {w: sum(n for (a, _), n in counts.items() if a == w) for w in names.values()}


def test_vectors_do_not_depend_on_the_words_known(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice([f"{t}{i}" for i in range(8)] + ["and", "or", "or"], 30)) for t in "xyz" for _ in range(12)] + [None, "x1 never x1"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    known = word_vectors.fit_word_vectors(df, "t", 4, 3, min_count=5)
    means = sorted(map(list, word_vectors.document_vectors(df, "t", known).collect()))
    _few_known(monkeypatch)
    numbers = itertools.count()
    monkeypatch.setattr(session, "shared_folder", lambda spark, purpose: f"{tmp_path}/{purpose}-{next(numbers)}")
    few = word_vectors.fit_word_vectors(df, "t", 4, 3, min_count=5)
    # Counts and rounds have given their disk back.
    assert [p.name.split("-")[0] for p in tmp_path.iterdir()] == ["word_vectors"]
    assert few.values == pytest.approx(known.values)
    want = {r.word: r.vector for r in known.table.collect()}
    got = {r.word: r.vector for r in few.table.collect()}
    assert sorted(got) == sorted(want) and all(got[w] == pytest.approx(want[w], abs=1e-8) for w in want)
    again = sorted(map(list, word_vectors.document_vectors(df, "t", few).collect()))
    assert np.array(again) == pytest.approx(np.array(means), abs=1e-8)


def test_few_words_reach_the_driver(spark):
    counted = spark.createDataFrame([(n, i) for i, n in enumerate([900, 800, 700, 50, 50, 50, 50, 1, 0])], "of_word long, i long")
    kept = lambda most: sorted(r.i for r in counted.filter(word_vectors._most_frequent(counted, most)).collect())
    assert [kept(n) for n in (0, 1, 3, 6, 7, 100)] == [[], [0], [0, 1, 2], [0, 1, 2], [0, 1, 2, 3, 4, 5, 6], [0, 1, 2, 3, 4, 5, 6, 7]]


@pytest.mark.parametrize("high", [5, 1 << 21, 1 << 40])
def test_sums_by_keys_of_any_size(high):
    rng = np.random.default_rng(1)
    a, b, n = (rng.integers(0, h, 400) for h in (4, high, 9))
    b[::3] = high - 1
    got = word_vectors._sum_by([a, b], n)
    want = {}
    for x in zip(a.tolist(), b.tolist(), n.tolist()):
        want[x[:2]] = want.get(x[:2], 0) + x[2]
    assert list(zip(*(x.tolist() for x in got[:2]))) == sorted(want) and got[2].tolist() == [want[k] for k in sorted(want)]
    # Rows whose keys fill more than one number.
    wide = word_vectors._sum_by([a * (1 << 40), b], n)
    assert wide[2].tolist() == got[2].tolist() and (wide[0] >> 40).tolist() == got[0].tolist()

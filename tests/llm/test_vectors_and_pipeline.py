import random

import numpy as np

import corpus_pipeline
from pyspark.sql import functions as F
from tabloom.llm import toxicity, vector_dedup, vector_search

SCHEMA = "vec_id long, embedding array<float>, label int, id string, score double"
ODD = [None, [], [0.0] * 8, [1.0, None] + [0.0] * 6, [float("nan")] * 8, [float("inf")] * 8]


def vectors(spark, n=400, dims=16):
    rng = np.random.default_rng(1)
    rows = [rng.normal(size=dims) for _ in range(n // 2)]
    rows += [rows[i % 9] + rng.normal(scale=0.08, size=dims) for i in range(n - len(rows))]
    rows += [rows[0], rows[0]]
    data = [(i, [float(x) for x in r], 0, "z", 1.0) for i, r in enumerate(rows)]
    return spark.createDataFrame([*data, *[(9000 + i, v, 0, "z", 1.0) for i, v in enumerate(ODD)]], SCHEMA)


def test_vector_links(spark):
    df = vectors(spark)
    rows = {r["vec_id"]: r for r in vector_dedup.link_vectors(df, block=40).collect()}
    data = {r["vec_id"]: np.array(r["embedding"], dtype=float) for r in df.collect() if r["vec_id"] < 9000}
    ids = sorted(data)
    x = np.stack([data[i] for i in ids])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    got = np.array([rows[i]["n_links"] for i in ids])
    assert (got <= near.sum(1)).all() and got.sum() >= 0.9 * near.sum()
    assert rows[0]["n_links"] >= 2 and rows[ids[-1]]["component_id"] == 0
    assert all(rows[9000 + i]["n_links"] == 0 and rows[9000 + i]["kept"] for i in range(len(ODD)))
    assert len(rows) == df.count() and vector_dedup.link_vectors(df.limit(0)).collect() == []


def test_nearest(spark):
    df = vectors(spark)
    rows = vector_search.nearest_neighbours(df, F.col("vec_id") % 20 == 0, k=10, block=100, chunk=7).collect()
    data = {r["vec_id"]: np.array(r["embedding"], dtype=float) for r in df.collect() if r["vec_id"] < 9000}
    hit = 0
    queries = [i for i in data if i % 20 == 0]
    for q in queries:
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in rows if r["query_id"] == q)
        assert [m[0] for m in mine] == list(range(1, 11)) and q not in [m[1] for m in mine]
        assert all(abs(m[2] - np.linalg.norm(data[m[1]] - data[q])) < 1e-9 for m in mine)
        want = sorted(data, key=lambda i: (i == q, np.linalg.norm(data[i] - data[q]), i))[:10]
        hit += len(set(want) & {m[1] for m in mine})
    assert hit >= 0.9 * 10 * len(queries)
    few = vector_search.nearest_neighbours(df.filter("vec_id IN (0, 1, 2)"), F.col("vec_id") == 0).collect()
    assert [r["rank"] for r in few] == [1, 2]
    assert vector_search.nearest_neighbours(df.limit(0), F.col("vec_id") == 0).collect() == []


def test_nearest_counts_a_few_radii_a_query():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 24))
    x[20:40] = x[:20] + 0.01 * rng.normal(size=(20, 24))
    lines, radii = vector_search.Lines(x, 64), []
    at = x[3] @ lines.directions + lines.shift
    values = x @ lines.directions
    for radius in (0.3, 2.0, 100.0):
        assert (lines.counts(at, radius) == (np.abs(values - values[3]) <= radius).sum(1)).all()
    count = lines.counts
    lines.counts = lambda at, radius: radii.append(radius) or count(at, radius)
    for i in range(60):
        near, distance = lines.nearest(x[i], 10, 0.6, 1.2, np.arange(700) == i)
        best = near[np.lexsort((near, distance))[:10]]
        want = np.argsort(np.where(np.arange(700) == i, np.inf, np.linalg.norm(x - x[i], axis=1)), kind="stable")[:10]
        assert len(set(best) & set(want)) >= 9 and best[0] == want[0]
    # Growing from the first window on takes many more.
    assert len(radii) <= 60 * 8
    few, _ = lines.nearest(x[0], 10, 0.6, 1.2, np.arange(700) >= 4)
    assert sorted(few) == [0, 1, 2, 3]
    with np.errstate(all="ignore"):
        huge, distance = vector_search.Lines(x * 1e200, 64).nearest(x[0] * 1e200, 10, 0.6, 1.2, np.arange(700) == 0)
    assert len(huge) >= 10


def repeated(spark):
    """Ids that repeat with equal and with different vectors, null ids, null vectors, ties."""
    e = np.eye(8)
    near = [float(x) for x in e[0] + 0.05 * e[1]]
    rows = [(0, e[0]), (0, e[0]), (1, near), (1, e[2]), (2, e[0] + 0.02 * e[3]), (3, None), (3, near), (4, e[4]), (4, near),
            (None, e[4]), (None, e[5]), (None, None), (7, e[2]), (None, e[0])]
    data = [(i, None if v is None else [float(x) for x in v], 0, "z", 1.0) for i, v in rows]
    return [(r[0], r[1]) for r in data], spark.createDataFrame(data, SCHEMA).repartition(5)


def test_links_of_repeated_ids(spark):
    rows, df = repeated(spark)
    want = []
    unit = [None if v is None else np.array(v, dtype="f4").astype(float) for _, v in rows]
    unit = [None if v is None else v / np.linalg.norm(v) for v in unit]
    linked = [[i != j and a is not None and b is not None and a @ b >= 0.9 for j, b in enumerate(unit)] for i, a in enumerate(unit)]
    for i in range(len(rows)):
        reached, open_ = {i}, [i]
        while open_:
            at = open_.pop()
            for j in range(len(rows)):
                if linked[at][j] and j not in reached:
                    reached.add(j)
                    open_.append(j)
        component = min((rows[j][0] for j in reached if rows[j][0] is not None), default=None)
        want.append((rows[i][0], sum(linked[i]), component, rows[i][0] == component))
    got = [tuple(r) for r in vector_dedup.link_vectors(df, block=3).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_nearest_of_repeated_ids(spark):
    rows, df = repeated(spark)
    data = [(i, np.array(v, dtype="f4").astype(float)) for i, v in rows if v is not None]
    want = []
    for at, (q, v) in enumerate(data):
        if q in (1, 4):
            others = sorted((np.linalg.norm(v - w), 10**9 if i is None else i) for j, (i, w) in enumerate(data) if j != at)[:6]
            want.append((q, [(round(d, 9), i) for d, i in others]))
    got = vector_search.nearest_neighbours(df, F.col("vec_id").isin(1, 4), k=6, block=100).collect()
    lists = [[g for g in got if g["query_id"] == q] for q in (1, 4)]
    assert [sorted(r["rank"] for r in mine) for mine in lists] == [sorted([*range(1, 7)] * 2)] * 2
    count = lambda pairs: sorted((q, d, i) for q, l in pairs for d, i in l)
    assert count(want) == count([(g["query_id"], [(round(g["score"], 9), 10**9 if g["vec_id"] is None else g["vec_id"])]) for g in got])


def test_pipeline_stages(spark, corpus, tmp_path):
    rng = random.Random(9)
    labels = []
    docs = [r.asDict() for r in corpus.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    for i in range(200):
        bad = i % 4 == 0
        text = " ".join([f"n{rng.randrange(500)}" for _ in range(20)] + ["vile insult"] * bad)
        docs.append({"doc_id": 10_000 + i, "text": text, "lang": "en", "source": "s1", "n_chars": len(text)})
        labels.append((10_000 + i, int(bad)))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    df, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, str(tmp_path))
        assert [f.name for f in df.schema.fields] == ["doc_id", "text", "lang", "source", "n_chars"]
        df.write.parquet(f"{tmp_path}/{name}")
        df = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = [r["doc_id"] for r in df.collect()]
    assert not {i for i, y in labels if y} & set(kept["toxicity"]) and {i for i, y in labels if not y} <= set(kept["toxicity"])
    assert len(kept["near_copies"]) == len(set(kept["near_copies"])) < len(kept["language"])
    assert kept["personal_data"] and not df.filter("text LIKE '%a@b.co%'").count()
    packed = corpus_pipeline.STAGES[-1][1](spark, df, str(tmp_path))
    assert {r["doc_id"] for r in packed.collect()} == set(kept["personal_data"])


def test_held_out_share(spark):
    ids = spark.range(1000).withColumnRenamed("id", "doc_id")
    assert 150 < ids.filter(toxicity.held_out("doc_id", 5, 0)).count() < 250


def test_vector_links_far_from_the_origin(spark):
    rng = np.random.default_rng(3)
    common = np.zeros(64)
    common[0] = 14
    near = rng.normal(size=(900, 64)) + common
    near /= np.linalg.norm(near, axis=1)[:, None]
    aside = rng.normal(size=near.shape)
    aside -= (aside * near).sum(1)[:, None] * near
    other = 0.902 * near + np.sqrt(1 - 0.902**2) * aside / np.linalg.norm(aside, axis=1)[:, None]
    x = np.concatenate([near, other])
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    want = int((x @ x.T >= 0.9).sum()) - len(x)
    got = sum(r["n_links"] for r in vector_dedup.link_vectors(df).collect())
    assert 0.97 * want <= got <= want
    few = spark.createDataFrame([(1, [1.0, 1.0, 0.1]), (2, [1.0, 1.0, -0.1])], "vec_id long, embedding array<double>")
    assert [r["n_links"] for r in vector_dedup.link_vectors(few).collect()] == [1, 1]

import hashlib
import math
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.llm import queries, source_mix, turn_trie, vector_codes


def _brute_trie(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)},{role}{text}".encode()).hexdigest()
            turns[conv].append(((turn is not None, turn or 0, role, digest), (role, text)))
    own = {c: [t for _, t in sorted(ts)] for c, ts in turns.items()}
    full = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(math.fmod(c, 100))
        full[c] = tuple(own.get(base, [])[:h] + ts[h:])
    nodes = {full[c][:d] for c in full for d in range(len(full[c]) + 1)}
    members = {v: [c for c in full if full[c][:len(v)] == v] for v in nodes}
    kids = {v: [u for u in nodes if len(u) == len(v) + 1 and u[:len(v)] == v] for v in nodes}
    out = set()
    for v in nodes:
        below = [u for u in nodes if u[:len(v)] == v]
        saved = sum((len(members[u]) - 1) * len(u[-1][1]) for u in below if u)
        ends = ",".join(str(c) for c in sorted(c for c in full if full[c] == v))
        out.add((min(members[v]), len(v), min(members[v[:-1]]) if v else None, len(members[v]), len(kids[v]),
                 sum(not kids[u] for u in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


TALK = [(c, t, ["user", "assistant", None][t % 3], ["hi", "tell me", None, "é𝄞", "", "x" * 3000][(c * c + t * (c % 4)) % 6])
        for c in [*range(0, 9), *range(96, 112), 200, 201, 305, -7, -120, 10**12] for t in range((c * 7) % 9 + 1)]
TALK += [(3, None, None, "no turn"), (3, None, "a", None), (3, 2, "user", "tie"), (None, 1, "user", "lost"), TALK[10], TALK[10],
         (400, 0, "user", "only"), *[(c, 0, "user", "same") for c in range(500, 560)]]
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _talk(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, depth string, leaf int")


def test_trie_equals_brute_force(spark):
    nodes = turn_trie.prefix_trie(_talk(spark, TALK))
    got = [tuple(r) for r in nodes.select(*NODE).collect()]
    assert len(got) == len(set(got)) and set(got) == _brute_trie(TALK)


def test_trie_of_nothing_and_one_long_conversation(spark):
    assert turn_trie.prefix_trie(_talk(spark, TALK[:1]).limit(0)).count() == 0
    long = [(50, t, "user", f"t{t % 7}") for t in range(400)]
    got = {tuple(r) for r in turn_trie.prefix_trie(_talk(spark, long)).select(*NODE).collect()}
    assert got == _brute_trie(long)


def test_nodes_get_their_turns(spark):
    rows = [(0, 0, "user", "a"), (0, 1, "bot", None), (1, 0, "user", "a"), (1, 1, "bot", "c")]
    df = _talk(spark, rows)
    got = {(r.depth, r.role, r.text) for r in turn_trie.with_turns(turn_trie.prefix_trie(df, heads=1), df, heads=1).collect()}
    assert got == {(0, None, None), (1, "user", "a"), (2, "bot", ""), (2, "bot", "c")}


def _brute_codes(rows, parts=16, entries=64, rounds=2):
    kept = sorted(((i, label, v) for i, label, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)),
                  key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    ints = np.array([[math.floor(256 * x) for x in v] for _, _, v in kept]).reshape(len(kept), parts, -1)
    books = ints[:entries].transpose(1, 0, 2).copy()
    for r in range(rounds + 1):
        far = ((ints[:, :, None] - books[None]) ** 2).sum(axis=3)
        codes = far.argmin(axis=2)
        if r < rounds:
            for j in range(parts):
                for e in range(books.shape[1]):
                    mine = ints[codes[:, j] == e, j]
                    if len(mine):
                        books[j, e] = [int(s) // len(mine) for s in mine.sum(axis=0)]
    errors = far.min(axis=2).sum(axis=1)
    totals = defaultdict(int)
    for (_, label, _), e in zip(kept, errors):
        totals[label] += int(e)
    digest = hashlib.sha256(",".join(str(x) for x in books.ravel()).encode()).hexdigest()
    return sorted(((i, bytes(c.astype("u1")).hex(), int(e), totals[label], digest) for (i, label, _), c, e in zip(kept, codes, errors)), key=str)


@pytest.mark.parametrize("n", [5, 700])
def test_codes_equal_a_full_search(spark, n):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(n, 32)).astype("f4")
    base[n // 2:] = base[: n - n // 2] + rng.normal(size=(n - n // 2, 32)).astype("f4") * rng.choice([0, 0.001, 0.2], size=(n - n // 2, 1))
    rows = [(i, None if i % 3 == 0 else i % 2, [float(x) for x in v]) for i, v in enumerate(base)]
    rows += [(2, 5, rows[1][2]), (2, 5, rows[1][2]), (None, 1, rows[0][2]), (n, 1, None), (n + 1, 1, [None] * 32), (n + 2, 1, [float("nan")] * 32),
             (n + 3, 1, [float("inf")] + [0.0] * 31), (n + 4, None, [0.0] * 32)]
    df = spark.createDataFrame([(*r, "e") for r in rows], "vec_id long, label int, embedding array<float>, error string").repartition(5)
    got = vector_codes.vector_codes(df)
    got = sorted((tuple(r) for r in got.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)
    assert got == _brute_codes(rows)


def test_pivots_prune_most_distances():
    rng = np.random.default_rng(1)
    rows = vector_codes.integers(rng.normal(scale=0.2, size=(2000, 64))).reshape(2000, 16, -1)
    first = rows[:64].transpose(1, 0, 2)
    books = vector_codes.Codebooks(first, vector_codes.choose_pivots(first))
    codes, best, measured = vector_codes.nearest_entries(rows, vector_codes.pivot_distances(rows, books.pivots), books)
    far = ((rows[:, :, None] - first[None]) ** 2).sum(axis=3)
    assert (codes == far.argmin(axis=2)).all() and (best == far.min(axis=2)).all()
    assert measured < 0.25 * far.size


def test_codes_of_odd_tables(spark):
    df = spark.createDataFrame([(1, [1.0] * 3, 0), (2, [], 0), (3, [0.5] * 16, 0), (4, [0.5] * 32, 0)], "vec_id long, embedding array<double>, label int")
    assert [r.vec_id for r in vector_codes.vector_codes(df).collect()] == [3]
    assert vector_codes.vector_codes(df.limit(0)).count() == 0
    with pytest.raises(Exception, match="summed exactly"):
        vector_codes.vector_codes(spark.createDataFrame([(1, [1e30] * 16, 0)], df.schema)).collect()


def _check_mix(rows, got, share=1.5, repeats=2):
    """Targets against repeated sharing; each source near its target."""
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len([w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")])
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total = sum(sizes.values())
    want, left, room = {}, share * total, set(order)
    while room:
        each = left / sum(weight[s] for s in room)
        full = [s for s in room if weight[s] * each > repeats * sizes[s]]
        if not full:
            want.update({s: weight[s] * each for s in room})
            break
        for s in full:
            want[s] = float(repeats * sizes[s])
            left -= want[s]
            room.discard(s)
    taken = defaultdict(int)
    for r in got:
        source = dict((i, s) for i, _, s in rows)[r.doc_id]
        assert r.source_size == sizes[source] and r.target == pytest.approx(want[source]) and 0 <= r.taken <= repeats * r.size
        taken[source] += r.taken
    assert sum(taken.values()) == int(share * total)
    for s in order:
        assert abs(taken[s] - want[s]) <= 8


def test_mix_meets_targets_and_repeats_itself(spark):
    rows = [(i, " \t".join(["w"] * ((i * 13) % 40)), ["b", "a", None, "ü", "c\U0001F600"][min(i % 11, 4)]) for i in range(600)]
    rows += [(600, None, "a"), (601, "", "a"), (602, "long " * 3000, "b"), (603, "lone", "single")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int")
    got = source_mix.mix_documents(df).collect()
    assert len(got) == len(rows)
    _check_mix(rows, got)
    again = source_mix.mix_documents(df.repartition(7), range_rows=500).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_mixed_texts_follow_the_plan(spark):
    rows = [(i, f"t{i} " * (i % 9), "ab"[i % 2]) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = {r.doc_id: r.taken for r in source_mix.mix_documents(df).collect()}
    out = source_mix.mixed(df).collect()
    words = defaultdict(int)
    for r in out:
        words[r.doc_id] += r.words
        assert r.text == dict((i, t) for i, t, _ in rows)[r.doc_id]
    assert {k: v for k, v in plan.items() if v} == dict(words)
    assert [r.finish for r in out] == sorted(r.finish for r in out)


def test_mix_of_odd_tables(spark):
    df = spark.createDataFrame([(None, "a b", None), (None, "a b", None), (1, "c", "s"), (1, "c", "s"), (1, "d e f", "s")],
                               "doc_id long, text string, source string")
    got = source_mix.mix_documents(df).collect()
    assert len(got) == 5 and sum(r.taken for r in got) == int(1.5 * 9)
    assert source_mix.mix_documents(df.limit(0)).count() == 0
    none = source_mix.mix_documents(df.withColumn("text", F.lit(None).cast("string"))).collect()
    assert {(r.size, r.source_size, r.target, r.taken) for r in none} == {(0, 0, 0.0, 0)}


def test_queries_are_registered():
    for name in ("op11_turn_trie", "op12_vector_codes", "op13_source_mix"):
        assert name in queries.QUERIES and name in queries.SQL

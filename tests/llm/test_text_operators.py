import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from tabloom import session
from tabloom.llm import language, packing, pieces, pii, sharding, shingle_join, toxicity, urls


def brute_components(rows):
    sets = {}
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (r["text"] or "").translate(urls.LOWER))
        sets[r["doc_id"]] = {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    label = {d: d for d in sets}
    for _ in range(6):
        for a in sorted(sets):
            for b in sorted(sets):
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    return {d: (len(sets[d]), label[d]) for d in sets}


@pytest.mark.parametrize("frequent", [1, 64])
def test_join_matches_brute_force(corpus, frequent):
    rows = shingle_join.near_duplicate_components(corpus, frequent=frequent).collect()
    want = brute_components(corpus.collect())
    assert len(rows) == corpus.count()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == want


def test_join_of_nothing(empty):
    assert shingle_join.near_duplicate_components(empty).collect() == []


def test_hot_family_matches_brute_force(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.choice([1, 2, 4, 6])):
            words[rng.randrange(120)] = f"e{rng.random()}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in shingle_join.near_duplicate_components(docs, frequent=8).collect()}
    assert got == brute_components(docs.collect())


def test_join_gives_its_disk_back(corpus, tmp_path, monkeypatch):
    numbers = itertools.count()
    monkeypatch.setattr(session, "shared_folder", lambda spark, purpose: f"{tmp_path}/{purpose}-{next(numbers)}")
    shingle_join.near_duplicate_components(corpus, frequent=1)
    assert {p.name.split("-")[0] for p in tmp_path.iterdir()} <= {"rows", "sets", "components", "links"}


def test_prefix_bounds():
    for n in range(2, 3000):
        short = n - shingle_join.overlap_needed(n) + 1
        upper = (n * 100 // 80).bit_length() - 1
        for level in {n.bit_length() - 1, upper}:
            assert shingle_join.prefix_length(n) >= short + shingle_join.groups_of_level(level)


def brute_spans(text):
    found = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        total = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits)))
        if 13 <= len(digits) <= 19 and total % 10 == 0:
            found.append(("card", m.start(), m.end()))
    return found + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.findall("[0-9]", m[0])) <= 15]


def test_pii_matches_plain_patterns():
    rng = random.Random(1)
    parts = ["a.b@c.de", "x@y", "@", "1.2.3.4", "1.2.3.4.5.6.7.8", "300.1.1.1", "4111 1111 1111 1111", "4111111111111112", "+1 (459) 555-7415", "+", ".", "-", " ", "é",
             "a@b.c@d.e", "007.08.1.0", "_", "%", "12", "@b.co", "q@w-e.r-t.y"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) + rng.choice(["", " ", "z"]) for _ in range(rng.randint(0, 8)))
        assert pii.base_spans(text) == brute_spans(text), text


def test_pii_further_kinds_and_masking(spark, corpus, empty):
    text = "Pay to bank account DE89 3704 0044 0532 0130 00 now; ssn 123-45-6789. " + "and so on " * 9 + "order 123-45-6780."
    kinds = [s[0] for s in pii.spans_of(text)]
    assert kinds == ["iban", "id_number"]
    assert pii.spans_of("account DE88 3704 0044 0532 0130 00") == []
    assert pii.masked("write a@b.co or call") == "write [EMAIL] or call"
    rows = {r["doc_id"]: r for r in pii.counts(pii.find_pii(corpus)).collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    assert all(rows[r["doc_id"]]["base_sha256"] == nothing for r in corpus.collect() if not r["text"])
    masked = pii.redact(corpus)
    assert masked.schema == corpus.schema and masked.count() == corpus.count()
    assert masked.filter("text IS NULL").count() == corpus.filter("text IS NULL").count()
    assert pii.find_pii(empty).collect() == [] and pii.redact(empty).collect() == []
    long = "9" * 200_000 + " " + "a" * 200_000 + "@"
    assert pii.base_spans(long) == []


def test_language(spark, corpus, empty):
    rng = random.Random(2)
    letters = {"aa": "abcdeé", "bb": "uvwxyzß"}
    rows = [(i, " ".join("".join(rng.choice(letters[y]) for _ in range(5)) for _ in range(30)), y) for i, y in enumerate(["aa", "bb"] * 40)]
    docs = spark.createDataFrame([*rows, (900, None, "aa"), (901, "12 34", "aa"), (902, rows[0][1], None)], "doc_id long, text string, lang string")
    model = language.fit(docs, max_rows=30, bits=12)
    got = {r["doc_id"]: r for r in language.identify(docs, model).collect()}
    assert all(got[i]["lang_pred"] == y and 0.5 < got[i]["score"] <= 1 for i, _, y in rows)
    assert [got[i]["lang_pred"] for i in (900, 901)] == ["und", "und"] and got[900]["score"] == 0
    kept = language.drop_unsure(docs, model)
    assert kept.schema == docs.schema and kept.count() == len(rows) + 1
    none = language.fit(empty)
    assert {r["lang_pred"] for r in language.identify(corpus, none).collect()} == {"und"}
    assert language.identify(empty, model).collect() == []


def test_toxicity_learns_an_interaction(spark, corpus, empty):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        words = [f"n{rng.randrange(200)}" for _ in range(20)]
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        rows.append((i, " ".join(words + ["rotten"] * insult + ["folk"] * group)))
        labels.append((i, int(insult and group)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    machine = toxicity.fit(docs, marks.filter("doc_id < 450"))
    score = {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(docs, machine).collect()}
    right = sum((score[i] >= 0.5) == bool(y) for i, y in labels if i >= 450)
    assert right >= 140
    kept = toxicity.drop_toxic(docs, machine)
    assert {r["doc_id"] for r in kept.collect()} == {i for i in score if score[i] < 0.5}
    plain = toxicity.fit(docs, marks.limit(0))
    assert {r["score"] for r in toxicity.toxicity_scores(corpus, plain).collect()} == {0.5}
    assert toxicity.toxicity_scores(empty, machine).collect() == []
    assert toxicity.toxicity_scores(corpus, machine).count() == corpus.count()


def test_urls(spark):
    says = lambda u: urls.best_rule(*urls.split_url(u), urls.rule_index(urls.RULES))
    assert urls.split_url("HTTP://A.Example.COM?x://y") == ("a.example.com", "")
    assert urls.split_url(None) == urls.split_url("no mark") == ("", "")
    assert says("http://www.example.com/en/x") == ("www.example.com/en/", "allow")
    assert says("http://m.example.com/en/x") == ("example.com/en/", "block")
    assert says("http://notexample.com/en/x") == ("com/", "allow")
    assert says("http://a.net/es/1")[1] == "block" and says("http://a.net/de/1") == (None, None)
    rows = [(0, "http://a.org/xxx"), (1, "http://a.org/xxxx"), (2, "http://a.org/adult-poker"), (3, "http://a.org/poker/poker"), (4, None), (5, ""), (5, ""), (6, "x" * 200_000 + " porn")]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, host string")
    got = [(r["page_id"], r["verdict"]) for r in urls.judge_urls(pages).collect()]
    assert got == [(0, "block"), (1, "allow"), (2, "block"), (3, "allow"), (4, "allow"), (5, "allow"), (5, "allow"), (6, "block")]
    assert urls.judge_urls(pages.limit(0)).collect() == []


@pytest.mark.parametrize("mixture", [None, {None: 1.0, "s0": 5.0, "s1": 2.0, "s2": 2.0}])
def test_packing(corpus, empty, mixture):
    rows = packing.pack(corpus, length=64, window=4, mixture=mixture, with_ids=True).collect()
    from tokenizers import Tokenizer
    import public_tokenizers

    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    copies, ids = {}, {}
    for r in corpus.collect():
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
        ids[r["doc_id"]] = plain.encode(r["text"] or "", add_special_tokens=False).ids + [2]
    covered = {d: [0] * len(x) for d, x in ids.items()}
    for r in rows:
        part = ids[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        assert r["ids"] == part and r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])
        for i in range(r["start"], r["start"] + r["length"]):
            covered[r["doc_id"]][i] += 1
    assert all(set(c) == {copies[d]} for d, c in covered.items())
    ends = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert ends.get(r["sequence_id"], 0) == r["offset"]
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert sorted(ends) == list(range(len(ends))) and all(ends[s] == 64 for s in range(len(ends) - 1)) and ends[len(ends) - 1] <= 64
    assert packing.pack(empty).collect() == []


def test_packing_keeps_the_mixture(spark):
    docs = spark.createDataFrame([(i, "word " * 50, "a" if i % 4 else "b") for i in range(400)], "doc_id long, text string, source string")
    rows = packing.pack(docs, length=64, window=4).collect()
    for w in range(60):
        b = sum(r["length"] for r in rows if r["sequence_id"] // 4 == w and r["doc_id"] % 4 == 0)
        assert abs(b - 64) <= 8
    with pytest.raises(Exception, match="no weight for source"):
        packing.pack(docs, mixture={"a": 1.0}).collect()


def test_words_encode_as_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    plain, words = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), packing.WordEncoder()
    rng = random.Random(6)
    alphabet = ["a", "B", "é", "É", "ß", "ΑΣ", "Σ", "İ", "1", "'s", "'ll", "\u0301", " ", "\n", "\u00a0", "\u2003", "\x1c", "\x85", "日", "\U0001F600", "!?", "_", "<|endoftext|>"]
    for _ in range(1500):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12)))
        assert np.frombuffer(words.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


def test_pieces_match_the_library(spark, corpus, empty):
    import public_tokenizers
    import sentencepiece

    sp, model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")), pieces.Model()
    rng = random.Random(7)
    texts = [r["text"] for r in corpus.collect()]
    alphabet = ["the", "a", "aa", "th", "e", " ", "  ", "é", "\u0301", "日", "本", "\U0001F600", "\n", "0", "12", "ing", "▁", "\x00", "of", "ß"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    got = [np.frombuffer(x, "<u4").tolist() for x in pieces.TextEncoder(model).encode(texts)]
    assert got == [sp.encode(t or "") for t in texts]
    assert [pieces.decoded(model, x) for x in got] == [sp.decode(x) for x in got]
    rows = pieces.decode(pieces.encode(corpus)).collect()
    assert sorted(r["decoded"] for r in rows) == sorted((r["text"] or "") for r in corpus.collect())
    assert pieces.encode(empty).collect() == []


def test_words_are_cut_where_no_piece_lies_across():
    import public_tokenizers
    import sentencepiece

    sp, model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")), pieces.Model()
    rng = random.Random(9)
    parts = ["word", "Th", "é", "1", ",", ".", "\n", "\t", " ", "▁", "'s", "(", "...", "ing", "日", "\\", "]", "^", "-"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(1000)]
    encoder = pieces.TextEncoder(model)
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [sp.encode(t) for t in texts]
    encoder = pieces.TextEncoder(model)
    encoder.encode(["one, two. one two;\none two,\ttwo"])
    assert set(encoder.known) <= {"▁one", "▁two", "one", "two", ",", ".", ";", "\n", "\t"}
    assert "".join(model.words.findall("".join(texts))) == "".join(texts)


def test_unigram_states_match_plain_search():
    model = pieces.Model(unigram=True)
    rng = random.Random(8)
    words = {"▁" + "".join(rng.choice("theaingo") for _ in range(rng.randint(1, 9))) for _ in range(300)}
    got = model.encode_words(words)
    for word in words:
        best = [0.0]
        for end in range(1, len(word) + 1):
            best.append(max(best[end - n] + model.scores.get(word[end - n:end], model.lowest) for n in range(1, min(end, model.longest) + 1)
                            if n == 1 or word[end - n:end] in model.ids))
        names = {i: p for p, i in model.ids.items()}
        assert sum(model.scores[names[i]] for i in np.frombuffer(got[word], "<u4").tolist()) == pytest.approx(best[-1])


def test_sharding(corpus, empty):
    rows = sharding.shard_documents(corpus, sharding.TREE_24, sharding.grown(sharding.TREE_24)).collect()
    text = {r["doc_id"]: (r["text"] or "").encode() for r in corpus.collect()}
    slots = {}
    for r in rows:
        assert r["size"] == len(text[r["doc_id"]]) + 8 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]])
        assert r["grown_shard"] in (r["shard"], 24) and 0 <= r["shard"] < 24
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(empty).collect() == []


def test_sharding_is_even_and_confined(spark):
    docs = spark.range(24_000).selectExpr("id AS doc_id", "'' AS text")
    tree = [[[1.0, 1.0], [2.0]], [[1.0, 3.0]]]
    heavier = [[[1.0, 1.0], [2.0]], [[1.0, 5.0]]]
    a = {r["doc_id"]: r for r in sharding.place(docs, tree).collect()}
    b = {r["doc_id"]: r for r in sharding.place(docs, heavier).collect()}
    counts = np.bincount([r["shard"] for r in a.values()], minlength=5)
    assert np.allclose(counts / 3000, [1, 1, 2, 1, 3], rtol=0.1)
    moved = [(a[i], b[i]) for i in a if a[i]["shard"] != b[i]["shard"]]
    assert moved and all(y["region"] == 1 for _, y in moved)


def test_samples_are_of_different_texts(spark):
    word = lambda i: "".join("abcdefghij"[int(c)] for c in str(i))
    rows = [(i, "copy of one text", "aa", 0) for i in range(20_000)]
    rows += [(20_000 + i, f"text {word(i)}", "aa", 0) for i in range(100)] + [(21_000 + i, f"12 {i}", "bb", 1) for i in range(2_000)]
    rows += [(30_000 + i, f"other {word(i)}", "bb", 1) for i in range(100)] + [(40_000, "einzig", "cc", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    drawn = [y for y, *_ in language.sample(docs, 50, 12, "text", "lang")]
    assert {y: drawn.count(y) for y in drawn} == {"aa": 50, "bb": 50, "cc": 1}
    data, counts = toxicity.sampled(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"), 50, 16, "doc_id", "text", "toxic")
    assert [sum(y == label for y, _ in data) for label in (0, 1)] == [50, 50] and counts == {0: 20_100, 1: 2_101}


def test_language_of_one_text_is_learned(spark):
    rows = [(f"abab {'ab' * i}", "aa") for i in range(1, 30)]
    for first in ("xyz zyx xxz", "zzy yxz zyx", "yyx xzy zzx", "zx xy yz", "xx yy zz"):
        docs = spark.createDataFrame([*rows, (first, "cc")], "text string, lang string")
        assert language.fit(docs, bits=12).predict(first)[0] == "cc"


def test_account_numbers_before_words_in_capitals():
    bare = ["BE68539007547034", "NO9386011117947", "AT611904300234573201", "DE89370400440532013000", "ES9121000418450200051332", "PL61109010140000071219812874"]
    for number in bare:
        for shown in (number, " ".join(number[i:i + 4] for i in range(0, len(number), 4))):
            for after in ("", " now", " EUR 50", " BIC", " IBAN", " A", " EURO 2024 PAID", " TRANSFERS", " DE88 3704", "."):
                for before in ("", "to ", "NR10 ABCD "):
                    text = before + shown + after
                    assert [(k, text[a:b]) for k, a, b in pii.further_spans(text)] == [("iban", shown)], text
    both = "BE68 5390 0754 7034 AT61 1904 3002 3457 3201 EUR"
    assert [both[a:b] for _, a, b in pii.further_spans(both)] == ["BE68 5390 0754 7034", "AT61 1904 3002 3457 3201"]
    assert pii.masked("account BE68 5390 0754 7034 EUR 50") == "account [IBAN] EUR 50"


def test_toxicity_learns_words_of_equal_shares():
    rng, find = random.Random(3), toxicity.Terms(20)

    def rows(n):
        out = []
        for i in range(n):
            y, a = i % 2, rng.randrange(2)
            words = [f"n{rng.randrange(200)}" for _ in range(20)] + [f"insult{a}", f"group{a if y else 1 - a}"]
            out.append((y, find.of(" ".join(words))))
        return out

    machine = toxicity.learn(rows(900), {0: 450, 1: 450}, 20)
    assert sum((machine.score(t) >= 0.5) == bool(y) for y, t in rows(600)) >= 570


def test_words_that_differ_by_case_or_a_mark_behind_are_remembered_once():
    encoder = packing.WordEncoder()
    texts = ["The word, the WORD. Word! word, and 12, end.", "J̌, Été, X, <|endoftext|> It's, Å. x.\nY", None, ""]
    plain = [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode_all(texts)] == plain
    encoder = packing.WordEncoder()
    encoder.encode_all(["Word, word. WORD! word, Word."])
    assert set(encoder.known) == {"word", ",", ".", "!", "word."}


def test_texts_of_the_join_are_sent_in_small_batches(spark, monkeypatch):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual, own, own_linked = spark.conf.get(name), shingle_join._entries, shingle_join._linked

    def watched(run):
        def few(batches):
            def checked():
                for batch in batches:
                    assert batch.num_rows <= 2000
                    yield batch
            return run(checked())
        return few

    monkeypatch.setattr(shingle_join, "_entries", lambda *a: watched(own(*a)))
    monkeypatch.setattr(shingle_join, "_linked", watched(own_linked))
    # Texts that come twice but for one word of a hundred.
    common = " ".join(f"w{i}" for i in range(99))
    docs = spark.range(2400).selectExpr("id AS doc_id", f"concat('{common} ', id div 2, ' x', id % 2) AS text").coalesce(1)
    got = shingle_join.near_duplicate_components(docs).agg({"component_id": "max", "doc_id": "count"}).first()
    assert tuple(got) == (0, 2400)
    assert spark.conf.get(name) == usual


def test_prefix_tokens_leave_a_task_in_small_batches():
    import pyarrow as pa

    texts = [" ".join(f"{i}w{j}" for j in range(400)) for i in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(300), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    parts = list(shingle_join._entries(64, 64)(iter([batch])))
    assert max(p.num_rows for p in parts) <= 20_000 < sum(p.num_rows for p in parts)
    prefixes = [shingle_join.shingles(t)[:shingle_join.prefix_length(396)] for t in texts]
    sent = pa.Table.from_batches(parts).to_pylist()
    assert sorted(r["k"] for r in sent if r["kind"] == 0) == sorted(np.concatenate(prefixes).view(np.int64).tolist())
    assert sorted(r["doc"] for r in sent if r["kind"] == 1) == list(range(300))


def test_new_words_of_letters_are_encoded_as_one_line():
    class Counted:
        def __init__(self, tokenizer):
            self.tokenizer, self.asked = tokenizer, 0

        def encode_batch_fast(self, texts, **options):
            self.asked += len(texts)
            return self.tokenizer.encode_batch_fast(texts, **options)

    encoder = packing.WordEncoder()
    whole = encoder.tokenizer
    encoder.tokenizer, encoder.letters = Counted(whole), Counted(encoder.letters)
    texts = ["naïve Größe señor été words of letters$$$ and more&&& end.%%% of", "ÇA łódź Words 'tis it's $$$"]
    want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode_all(texts)] == want
    assert encoder.letters.asked <= 2
    assert {"letters", "more", "end", "$$$"} <= encoder.known.keys() and not {"letters$$$", "more&&&"} & encoder.known.keys()
    # Where the vocabulary does not mark the last token of a word, words are encoded one by one.
    other = packing.WordEncoder()
    other.is_last[:] = False
    assert [np.frombuffer(x, "<u4").tolist() for x in other.encode_all(texts)] == want


def test_merging_looks_up_each_pair_once():
    class Counted(dict):
        asked = 0

        def get(self, *key):
            Counted.asked += 1
            return super().get(*key)

    model = pieces.Model()
    text = "internationalisation"
    whole = model.merged(list(text))
    model.scores = Counted(model.scores)
    symbols = list(text)
    assert model.merged(symbols) == whole and symbols == list(text)
    assert Counted.asked <= 3 * len(text)


def test_tokens_of_a_set_are_shuffled_once(spark, monkeypatch):
    tokens = shingle_join.token_table(spark.createDataFrame([(i, f"a b c d e f g h i j k l m{i % 2}") for i in range(6)], "doc_id long, text string"))
    plans = []
    monkeypatch.setattr(shingle_join, "written_table", lambda df, purpose: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        entries = shingle_join.index_entries(tokens).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(entries) == len(set(entries)) > 0
    assert plans[0].replace("ReusedExchange", "").count("Exchange hashpartitioning") <= 2 and "hashpartitioning(k" not in plans[0]


def test_texts_to_pack_are_sent_in_small_batches(spark, corpus, monkeypatch):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, sizes, write = spark.conf.get(name), {}, packing.written_table
    monkeypatch.setattr(packing, "written_table", lambda df, purpose: sizes.update({purpose: int(spark.conf.get(name))}) or write(df, purpose))
    packing.pack(corpus, length=64, window=4)
    assert sizes["tokens"] <= 2000 and spark.conf.get(name) == before

"""Operators against brute force on small tables with nulls, empty and long texts, ties, repeats and clashing names."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helixlake.llm import chat, decontaminate, mixing, ngram_join, ranking, rules, sharding, substrings, tokens, toxicity
from helixlake.llm.common import fold

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DDL = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall(text or "")


def corpus(seed=1):
    """Rows with shared passages, near copies, runs, odd white space, nulls, repeats and one long text."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    make = lambda n: [rng.choice(vocab) for _ in range(n)]
    passage, base = make(40), make(120)
    rows = []
    for i in range(40):
        w = make(rng.randint(1, 150))
        if i % 3 == 0:
            at = rng.randint(0, len(w))
            w[at:at] = passage[rng.randint(0, 10) : 40]
        if i % 7 == 0:
            w = base[: rng.randint(100, 120)] + make(3)
        if i % 11 == 0:
            w += ["run"] * rng.randint(2, 40) + ["x", "y"] * rng.randint(1, 20)
        rows.append((i, rng.choice([" ", "  ", "\n", "\t "]).join(w), "en", f"s{i % 4}", 1))
    rows += [(100, None, None, None, None), (101, "", "en", "s0", 0), (102, " \n\t", "en", None, 3), (103, rows[3][1], "en", "s1", 1), (103, rows[3][1], "en", "s1", 1), (None, rows[6][1], "en", "s2", 1), (None, None, None, None, None)]
    rows.append((104, " ".join(make(30_000) + ["run"] * 500 + passage), "en", "s9", 1))
    rows.append((105, "One two THREE four", "en", "s1", 1))
    rows.append((106, "one two three  FOUR", "en", "s1", 1))
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DDL).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DDL)


def clashing(df):
    """Extra columns with names that the operators use themselves."""
    for c in ("n", "name", "label", "chunk", "score", "items", "shard", "slot", "size", "rows", "word"):
        df = df.withColumn(c, F.lit(7))
    return df


def key(df):
    return sorted(map(repr, map(tuple, df.collect())))


# ---- 1


def dedup_brute(rows):
    low = {}
    for d, t, *_ in rows:
        if d is not None:
            w = words(t)
            for i in range(len(w) - 12):
                g = tuple(w[i : i + 13])
                low[g] = min(low.get(g, d), d)
    out = []
    for d, t, *_ in rows:
        w, gone = words(t), set()
        for i in range(len(w) - 12):
            least = low.get(tuple(w[i : i + 13]))
            if least is not None and (d is None or least < d):
                gone.update(range(i, i + 13))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(map(repr, out))


@pytest.mark.parametrize("seed", [1, 2])
def test_substrings(spark, seed):
    data = corpus(seed)
    df = spark.createDataFrame(data, DDL).repartition(3)
    got = key(substrings.dedup(clashing(df)).select("doc_id", "n_words", "n_removed", "kept_sha256"))
    assert got == dedup_brute(data)


def test_substrings_empty(empty):
    assert substrings.dedup(empty).collect() == []


def test_recompression_names_equal_substrings_alike():
    rng = random.Random(5)
    common = [rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(400)]
    texts = [" ".join(["left", *common, "x"]), " ".join(["other", "words", *common, "y", "z"])]
    found = []
    for t in texts:
        raw = np.frombuffer(t.encode(), np.uint8)
        w = substrings.Words(raw, np.array([0, len(raw)]))
        start = t.split().index(common[0]) if t.split()[1] == common[0] else 2
        found.append({int(b) - start for b in w.borders() if 8 <= b - start < 390})
    assert found[0] == found[1] and len(found[0]) < 300


# ---- 2


def test_chat(spark):
    turns = [(1, 0, "user", "a <b> [c] %0 </s>"), (1, 1, "assistant", None), (1, 2, None, "é[INST]"), (2, 0, "assistant", "x" * 100_000), (2, 0, "assistant", "x"), (None, 3, "user", "n"), (3, None, "assistant", "tie")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    done = chat.format_chats(chat.as_events(clashing(df))).withColumn("back", chat.parse("formatted"))
    got = {r.conv_id: r for r in done.collect()}
    for c in {t[0] for t in turns}:
        want = sorted((t[1] if t[1] is not None else -1, t[2] or "", t[3] or "") for t in turns if t[0] == c)
        assert sorted((r.role, r.text) for r in got[c].back) == sorted(w[1:] for w in want)
        assert got[c].formatted.count("</s>") == len(want)
        loss = [got[c].formatted[s.start : s.start + s.length] for s in got[c].loss_spans]
        assert loss == [w[2].replace("%", "%0").replace("<", "%1").replace("[", "%2") for w in want if w[1] == "assistant"]
    assert chat.format_chats(chat.as_events(df.limit(0))).collect() == []


def test_chat_events(spark):
    log = [(1, 0, 0, "message", "user", "hi"), (1, 1, 1, "message", "assistant", "He"), (1, 2, 1, "delta", "assistant", "llo"), (1, 3, 2, "message", "user", "old"), (1, 4, 1, "regenerate", "assistant", ""), (1, 5, 1, "delta", "assistant", "Hey"), (1, 6, 0, "edit", "user", "hi!"), (1, 7, 2, "message", "user", "new")]
    df = spark.createDataFrame(log, "conv_id long, seq long, turn long, kind string, role string, text string").repartition(4)
    r = chat.format_chats(df).withColumn("back", chat.parse("formatted")).first()
    assert [(x.role, x.text) for x in r.back] == [("user", "hi!"), ("assistant", "Hey"), ("user", "new")]


# ---- 3


def sets_of(rows):
    out = []
    for d, t, *_ in rows:
        w = words((t or "").translate({i: i + 32 for i in range(65, 91)}))
        out.append((d, {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()))
    return out


def join_brute(rows):
    sets = sets_of(rows)
    label = list(range(len(sets)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            (a, x), (b, y) = sets[i], sets[j]
            if a is not None and b is not None and x and y and 100 * len(x & y) >= 75 * len(x | y):
                label[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            low[root(i)] = min(low.get(root(i), d), d)
    return sorted(repr((d, len(s), low[root(i)] if d is not None else None)) for i, (d, s) in enumerate(sets))


@pytest.mark.parametrize("seed", [1, 3])
def test_ngram_join(spark, seed):
    data = corpus(seed)
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 400)}" for _ in range(90)]
    for k in range(30):  # near copies of each other with words changed
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(90)] = f"c{rng.randint(0, 5)}"
        data.append((1000 + k, " ".join(w), "en", "s1", 1))
    got = key(ngram_join.joined(clashing(spark.createDataFrame(data, DDL).repartition(3))))
    assert got == join_brute(data)


@pytest.mark.parametrize("seed", [1, 3])
def test_ngram_links(spark, seed, empty):
    data, rng = corpus(seed), random.Random(seed)
    base = [f"w{rng.randint(0, 400)}" for _ in range(90)]
    for k in range(30):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(90)] = f"c{rng.randint(0, 5)}"
        data.append((1000 + k, " ".join(w), "en", "s1", 1))
    sets = sets_of(data)
    n = [sum(k != j and None not in (a, b) and 100 * len(x & y) >= 75 * len(x | y) > 0 for j, (b, y) in enumerate(sets)) for k, (a, x) in enumerate(sets)]
    got = ngram_join.linked(clashing(spark.createDataFrame(data, DDL).repartition(3)))
    assert sorted(repr((r.doc_id, r.n_links)) for r in got.collect()) == sorted(repr((d, k)) for (d, *_), k in zip(data, n, strict=True))
    assert key(got.drop("n_links")) == join_brute(data) and max(n) > 2
    assert ngram_join.linked(empty).collect() == []


def test_ngram_join_keeps_one(spark, docs, rows, empty):
    assert ngram_join.joined(empty).collect() == []
    left = ngram_join.keep_one(docs)
    assert left.columns == docs.columns
    want = collections.Counter(eval(x)[2] for x in join_brute(rows))  # noqa: S307
    ids = [r.doc_id for r in left.collect()]
    assert {i for i in ids if i is not None} == {k for k in want if k is not None} and ids.count(None) == 2 and ids.count(103) <= 1


def test_ngram_join_keeps_rows_of_repeated_ids(spark):
    base = [f"w{k}" for k in range(60)]
    near = " ".join([*base[:58], "x", "y"])
    data = [(1, " ".join(base)), (2, near), (2, "a text of its own with nothing in common"), (5, "p " + " ".join(reversed(base))), (5, "q " + " ".join(reversed(base))), (5, "q " + " ".join(reversed(base))), (6, ""), (6, ""), (None, near)]
    left = [(r.doc_id, r.text) for r in ngram_join.keep_one(clashing(spark.createDataFrame(data, "doc_id long, text string").repartition(3))).collect()]
    assert sorted(map(repr, (x for x in left if x[0] != 5))) == sorted(map(repr, [data[0], data[2], data[6], data[7], data[8]]))
    assert [x[0] for x in left].count(5) == 1


def test_prefix_lengths():
    assert ngram_join.prefix(np.array([2] * 100, np.uint32), 100)[1] - ngram_join.prefix(np.array([2] * 100, np.uint32), 100)[0] == 25
    assert ngram_join.prefix(np.array([2] * 70, np.uint32), 100) == (0, 0)


# ---- 4


def test_sharding(spark, docs, rows, empty):
    out = sharding.shuffled(clashing(docs), bucket_bytes=20_000)
    got = out.collect()
    assert len(got) == len(rows) and collections.Counter((r.doc_id, r.text) for r in got) == collections.Counter((r[0], r[1]) for r in rows)
    places = sorted((r.shard, r.slot) for r in got)
    counts = collections.Counter(s for s, _ in places)
    assert max(counts.values()) - min(counts.values()) <= 1 and places == [(s, k) for s in range(8) for k in range(counts[s])]
    order = [r.doc_id for r in sorted(got, key=lambda r: (r.slot, r.shard))]
    assert order != sorted(order, key=lambda d: (d is None, d))
    assert sharding.shuffled(empty).collect() == []


# ---- 5


def test_tokens_round_trip(spark, docs, rows, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_tokenizer())
    got = sorted(tokens.digest(clashing(docs)).collect(), key=lambda r: r.start)
    want = collections.Counter()
    for d, text, *_ in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want[(d, len(ids), zlib.crc32(ids.tobytes()))] += 1
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.doc_id is not None and r.doc_id for r in got] == sorted((r.doc_id is not None and r.doc_id) for r in got)
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    assert tokens.digest(empty).collect() == []


def test_tokens_of_special_strings(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_tokenizer())
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y z", "a  <|endoftext|>\n b", "<|endoftext|><|endoftext|> <|endoftext|>!", "one <|endoftext", "a b c"]
    got = sorted(tokens.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect(), key=lambda r: r.doc_id)
    want = [np.array([*t.encode(x, add_special_tokens=False).ids, 0], "<u4") for x in texts]
    assert [(r.n_tokens, r.ids_crc32) for r in got] == [(len(x), zlib.crc32(x.tobytes())) for x in want]
    assert [r.start for r in got] == np.cumsum([0] + [len(x) for x in want])[:-1].tolist() and 50256 in want[0]


def test_repair_and_random_access():
    rng = np.random.default_rng(3)
    docs = [np.append(rng.choice(np.tile([5, 6, 7, 8, 9, 9], 3), rng.integers(0, 400)), 0).astype(np.uint32) for _ in range(60)] + [np.zeros(1, np.uint32)]
    ids, at = np.concatenate(docs), np.concatenate(([0], np.cumsum([len(d) for d in docs])))
    s = tokens.Shard(tokens.pack([None, *range(60)], ids, at, 65_536))
    back, places = s.everything()
    assert (back == ids).all() and (places == at).all() and len(s.rules) and s.n_symbols < len(ids) and s.doc_ids[0] is None
    assert all((s.document(k) == d).all() for k, d in enumerate(docs))
    assert [s.id_at(7, j) for j in range(len(docs[7]))] == docs[7].tolist()


def test_repair_goes_on_until_no_pair_is_frequent():
    rng = np.random.default_rng(5)
    passage = rng.integers(1, 60_000, 700)
    docs = [np.concatenate([rng.integers(1, 60_000, 5), passage, np.full(k, 9), [0]]) for k in range(60)]
    ids, at = np.concatenate(docs).astype(np.uint32), np.concatenate(([0], np.cumsum([len(d) for d in docs])))
    s = tokens.Shard(tokens.pack([*range(60)], ids, at, 65_536))
    symbols = s.symbols(0, s.n_symbols)
    pairs = collections.Counter(p for a, b in zip(s.first, s.first[1:]) for p in zip(symbols[a : b - 1].tolist(), symbols[a + 1 : b].tolist()))
    assert max(pairs.values()) < tokens.LEAST and s.lengths.max() > 500
    back, places = s.everything()
    assert (back == ids).all() and (places == at).all() and [s.id_at(7, j) for j in range(0, 700, 99)] == docs[7][:700:99].tolist()


def test_encoder_odd_white_space():
    e = tokens.Encoder(tokens.default_tokenizer())
    texts = ["a  b", " a", "a ", "", None, "x  y", "a\n b", "don't stop", "<|endoftext|> a", "é è", "a b a b"]
    ids, at = e.encode(pa.array(texts))
    for t, a, b in zip(texts, at, at[1:]):
        assert ids[a:b].tolist() == [*e.tokenizer.encode(t or "", add_special_tokens=False).ids, 0]


def test_encoder_sorts_its_pieces_twice_a_batch(monkeypatch):
    """The remembered pieces are put in order once for whole words, and once for all other pieces and their stems."""
    calls, real = [], tokens.Encoder.remember
    monkeypatch.setattr(tokens.Encoder, "remember", lambda self, *a: calls.append(len(a[0])) or real(self, *a))
    e = tokens.Encoder(tokens.default_tokenizer())
    texts = ["plain words, and stems; stems, and plain!", f"x{'y' * 90}, x{'y' * 90}! x{'y' * 90}, 12 a1", "words\nplain; don't"]
    for _ in range(2):
        ids, at = e.encode(pa.array(texts))
        for t, a, b in zip(texts, at, at[1:]):
            assert ids[a:b].tolist() == [*e.tokenizer.encode(t, add_special_tokens=False).ids, 0]
        assert len(calls) <= 2 and (e.hash[1:] > e.hash[:-1]).all()
        calls.clear()


# ---- 6


def rules_brute(t):
    w = words(t)
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    n = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    again = {j for i in range(len(w) - 4) if n[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(again)


def test_rules(spark, docs, rows, empty):
    extra = [(200, "a b\na b\n \nc # <x> *", None, None, None), (201, "same words here now ok " * 9, None, None, None)]
    df = clashing(docs.unionByName(spark.createDataFrame(extra, DDL)))
    got = rules.judged(df, []).collect()
    want = collections.Counter((d, *rules_brute(t)) for d, t, *_ in rows + extra)
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and r.kept == (not r.base_failed)
    assert rules.judged(empty, []).collect() == []


def test_rules_are_learned(spark, empty):
    rng = random.Random(4)
    data = [(i, " ".join(rng.choice(["good", "words", "here", "and", "there"]) + rng.choice("abcdefgh") + ("%%%" if i % 4 == 0 else "") for _ in range(60)), None, None, None) for i in range(200)]
    docs = spark.createDataFrame(data, DDL)
    labels = spark.createDataFrame([(i, int(i % 4 != 0), None) for i in range(150)] + [(None, 1, 0), (3, None, 1)], "doc_id long, quality int, toxic int")
    learned = rules.learn(docs, labels)
    assert learned and all(name in rules.FEATURES for rule in learned for name, _, _ in rule)
    verdict = {r.doc_id: r.kept for r in rules.judged(docs, learned).collect()}
    assert all(verdict[i] == (i % 4 != 0) for i in range(200))
    assert rules.learn(docs, labels.limit(0)) == []


# ---- 7 and 8


def labelled(spark):
    rng = random.Random(6)
    insults = ["idiot", "stupid", "disgusting"]
    data, labels = [], []
    for i in range(300):
        w = ["".join(rng.choice("etaoinshrd") for _ in range(rng.randint(2, 8))) for _ in range(50)]
        toxic, junk = int(i % 5 == 0), int(i % 4 == 0)
        if toxic:
            for _ in range(3):
                w[rng.randrange(50)] = rng.choice(insults)
        if junk:
            w = [x + "###" for x in w]
        data.append((i, " ".join(w), None, None, None))
        labels.append((i, 1 - junk, toxic))
    data += [(900, None, None, None, None), (901, "", None, None, None), (None, "you are an idiot", None, None, None), (902, "hello " * 20_000 + "idi0t stupid!", None, None, None)]
    return spark.createDataFrame(data, DDL), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark, empty):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels, fold(4) != 2)
    assert {"disgusting", "stupid"} <= {t.rstrip("*") for t, _ in model["terms"]} | {"stupid"}
    got = {r.doc_id: r.score for r in toxicity.scored(clashing(docs).drop("score"), model).collect()}
    assert all(0 <= s <= 1 for s in got.values())
    right = sum((got[i] >= 0.3) == (i % 5 == 0) for i in range(300) if zlib.crc32(str(i).encode()) % 4 == 2)
    assert right >= 0.97 * sum(zlib.crc32(str(i).encode()) % 4 == 2 for i in range(300))
    assert got[900] == got[901] < 0.3 < got[902]
    kept = toxicity.clean(clashing(docs), model)
    assert kept.columns == clashing(docs).columns and {r.doc_id for r in kept.collect()} >= {1, 900, 901}
    assert toxicity.scored(empty, model).collect() == []
    assert toxicity.fit(docs, labels.limit(0))["terms"] == []


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i, *[0] * len(b)], row
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return row[-1]


def test_levenshtein_automaton():
    rng = random.Random(8)
    terms = ["idiot", "stupid", "disgusting", "clown", "abc"]
    lex = toxicity.Lexicon(terms)
    for _ in range(3000):
        w = list(rng.choice(terms))
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(w) + 1)
            w[k : k + rng.randint(0, 1)] = rng.choice(["", "x", "i"])
        w = "".join(w)
        near = min(((levenshtein(w, t), t) for t in terms if levenshtein(w, t) <= toxicity.edits(len(t))), default=None)
        found = lex.find(w)
        assert (found is None) == (near is None) and (found is None or found[0] == near[0])
    assert toxicity.Lexicon(["lowei*", "lowein"]).find("loweischaft") is not None
    assert toxicity.context('he said "you idiot here" then'.split(), 3)[1] and not toxicity.context("you idiot".split(), 1)[1]


def test_ranking(spark, empty):
    docs, labels = labelled(spark)
    model = ranking.fit(docs, labels, fold(5) != 0)
    got = {r.doc_id: r.score for r in ranking.scored(clashing(docs), model).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.3) == (i % 4 != 0) for i in held) >= 0.97 * len(held)
    assert all(0 <= s <= 1 for s in got.values()) and {900, 901, None} <= set(got)
    assert ranking.scored(empty, model).collect() == [] and ranking.fit(docs, labels.limit(0)) == {}
    w = ranking.bradley_terry(np.array([[1.0], [2.0], [0.0], [-1.0]]), np.array([1, 1, 0, 0]))
    assert w[0] > 0


@pytest.mark.parametrize("share", [0.5, 0.004])
def test_ranking_learns_from_all_rows(spark, monkeypatch, share):
    """More labelled rows than the 20,000 that counted once, in many groups: means, scales, pairs and quantile are those of all."""
    monkeypatch.setattr(ranking, "FEW", 50)
    n, k = 30_000, len(ranking.FEATURES)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, k)).round(1)
    y = (x[:, 0] + rng.normal(size=n) > np.quantile(x[:, 0], 1 - share)).astype(int)
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(x.tolist())], "doc_id long, x array<double>").repartition(3)
    model = ranking.learned(rows, spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "doc_id long, quality int"))
    assert np.allclose(model["mean"], x.mean(0)) and np.allclose(model["scale"], x.std(0))
    w = np.array(model["weights"])
    worth = (x - x.mean(0)) / x.std(0) @ w
    assert model["cut"] == pytest.approx(np.quantile(worth, (y == 0).mean())) and model["slope"] == pytest.approx(4 / worth.std())
    assert np.abs(w - ranking.bradley_terry((x - x.mean(0)) / x.std(0), y)).max() < 0.1 * np.abs(w).max()
    at = spark.createDataFrame([(int(v), r, i) for i, (v, r) in enumerate(zip(y, x.tolist(), strict=True))], "label int, x array<double>, at long")
    seen = ranking.groups(at, int(y.sum()), int(n - y.sum())).collect()
    sides = [[np.frombuffer(b, "<f8").reshape(-1, k) for b in (r.good, r.bad)] for r in seen]
    assert len(sides) > 1 and all(len(a) and len(b) for a, b in sides)
    assert {r.tobytes() for pair in sides for side in pair for r in side} == {r.tobytes() for r in x}


# ---- 9


def test_decontamination(spark, docs, rows, empty):
    rng = random.Random(1)
    items = [(1, " ".join(words(rows[0][1])[2:14])), (2, "Short Item"), (3, None), (4, "..."), (None, " ".join(words(rows[5][1])[:9])), (1, rows[9][1]), (7, "one two three four five six seven eight nine")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    extra = [(300, "x ONE two-three, four five six seven EIGHT nine! short: item", None, None, None)]
    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
    want = collections.Counter()
    for d, t, *_ in rows + extra:
        w, hit, ids = norm(t), set(), set()
        for item, text in items:
            g = norm(text)
            for win in {tuple(g[i : i + 8]) for i in range(max(1, len(g) - 7))} if g else ():
                for i in range(len(w) - len(win) + 1):
                    if tuple(w[i : i + len(win)]) == win:
                        hit.update(range(i, i + len(win)))
                        ids.add(str(item) if item is not None else "null")
        want[(d, len(w), len(hit), tuple(sorted(ids)))] += 1
    df = docs.unionByName(spark.createDataFrame(extra, DDL))
    got = decontaminate.find(clashing(df), bench).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got) == want
    r = next(r for r in got if r.doc_id == 300)
    assert [extra[0][1][s.start : s.end] for s in r.hit_spans] == ["ONE two-three, four five six seven EIGHT nine! short: item"]
    left = decontaminate.decontaminate(clashing(df), bench, 2)
    assert left.columns == clashing(df).columns and 300 not in {r.doc_id for r in left.collect()}
    assert decontaminate.find(empty, bench).collect() == []
    assert {len(r["items"]) for r in decontaminate.find(docs, bench.limit(0)).collect()} == {0}
    several = decontaminate.find(df.where("doc_id is not null and doc_id != 103"), bench, block_windows=100).collect()
    one = {r.doc_id: r for r in got}
    assert all((r.n_hit, r["items"]) == (one[r.doc_id].n_hit, one[r.doc_id]["items"]) for r in several)
    del rng


def test_decontamination_in_blocks(spark, docs, rows):
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    items = [(k, " ".join(words(rows[k][1])[:12])) for k in range(12)] + [(50, " ".join(text.split()[:8])), (51, " ".join(text.split()[8:]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    again = [(None, rows[6][1], "en", "s2", 1), (None, text, None, None, None), (103, text, "en", "s1", 1), (103, rows[0][1], "en", "s1", 1), (7, text, "en", "s1", 1), (7, text, "en", "s1", 1)]
    df = clashing(docs.unionByName(spark.createDataFrame(again, DDL)))
    whole = df.select(F.struct(*df.columns).alias("__row"), "text")
    assert key(decontaminate.find(df, bench, block_windows=100)) == key(decontaminate.find(df, bench))
    assert key(decontaminate.find(whole, bench, block_windows=100, keep=("__row",))) == key(decontaminate.find(whole, bench, keep=("__row",)))


# ---- 10


def test_targets():
    assert mixing.targets([100, 100, 100]) == pytest.approx([200.0, 250 / 3, 500 / 3])
    assert mixing.targets([]) == [] and mixing.targets([0, 10]) == [0.0, 15.0]


def test_permutation():
    for n in (1, 2, 5, 64, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, 9).tolist()) == list(range(n))


def test_draw_meets_totals():
    got = mixing.draw([100, 0, 7], 8, 1)
    assert got.sum(axis=0).tolist() == [100, 0, 7] and (got.sum(axis=1) >= 13).all()


def test_mixing(spark, docs, rows, empty):
    r, pieces = mixing.mixture(clashing(docs), block=16)
    base, taken = r.collect(), collections.Counter()
    spans = collections.defaultdict(list)
    for p in pieces.collect():
        taken[(p.src, p.start)] += p.end - p.first
        spans[(p.src, p.start, p.epoch)] += range(p.first, p.end)
    assert collections.Counter((x.doc_id, x.size) for x in base) == collections.Counter((d, len(words(t))) for d, t, *_ in rows)
    by = collections.defaultdict(lambda: [0, 0, 0.0])
    for x in base:
        by[x.src][0] += x.size
        by[x.src][1] += taken[(x.src, x.start)] if x.size else 0
        by[x.src][2] = x.target
        assert not x.size or taken[(x.src, x.start)] <= 2 * x.size
    order = sorted({t[3] for t in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(len(words(t[1])) for t in rows if t[3] == s) for s in order]
    for (size, got, target), n, t in zip((by[k] for k in sorted(by)), sizes, mixing.targets(sizes), strict=True):
        assert size == n and target == pytest.approx(t) and abs(got - t) <= 1
    assert all(len(s) == len(set(s)) for s in spans.values())
    again = mixing.mixture(docs.repartition(5), block=16)[1].groupBy("src", "start").agg(F.sum(F.col("end") - F.col("first")).alias("n")).collect()
    assert {(x.src, x.start): x.n for x in again} == dict(taken)
    assert mixing.mixture(empty)[0].collect() == []


def test_mixing_sends_no_slots_to_the_driver(spark, docs, monkeypatch):
    """Slots are made from a small table, which the planner must not take for their size; that table has a row for a run of
    shards, however many shards and sources there are."""
    made, real = [], type(spark).createDataFrame
    monkeypatch.setattr(mixing, "SLOTS_PER_SHARD", 4)
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *a, **kw: made.append(len(data)) or real(self, data, *a, **kw))
    rows, pieces = mixing.mixture(docs, block=2)
    plan = pieces._jdf.queryExecution()
    assert plan.toRdd().count() == pieces.count() > 1000
    assert "BroadcastHashJoin" not in plan.executedPlan().toString()
    shards, sources = pieces.agg(F.countDistinct("shard"), F.countDistinct("src")).first()
    assert shards > 200 and max(made) <= max(sources + 1, 4 * spark.sparkContext.defaultParallelism) < shards


def test_mixed_texts(spark, docs, rows, empty):
    out = mixing.mixed(clashing(docs), block=16)
    got = out.collect()
    assert out.columns == clashing(docs).columns
    total = sum(len(words(t)) for _, t, *_ in rows)
    assert abs(sum(len(words(r.text)) for r in got) - 1.5 * total) <= 10
    texts = collections.defaultdict(set)
    for d, t, *_ in rows:
        texts[d].update(words(t))
    assert all(set(words(r.text)) <= texts[r.doc_id] and r.n_chars == len(r.text) for r in got)
    assert mixing.mixed(empty).collect() == []

"""The queries opN themselves, over whole tables, against brute force and held-out labels."""

import collections
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from helixlake.llm import mixing, ngram_join, ranking, registry, rules, sharding, tokens, toxicity
from helixlake.llm.common import fold, table

from test_llm import DDL, join_brute, key, rules_brute, words

SF, LARGER, LARGEST = (f"/root/testdata/sf{x}" for x in ("0.001", "0.01", "0.1"))


@pytest.fixture(scope="module")
def texts():
    t = pq.read_table(f"{SF}/documents.parquet")
    return list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), t["source"].to_pylist(), strict=True))


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


def test_op4(spark, texts):
    got = sharding.op4(spark, SF).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == collections.Counter((d, size(t), zlib.crc32((t or "").encode())) for d, t, _ in texts)
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}
    counts = collections.Counter(r.shard for r in got)
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    assert sorted((r.shard, r.slot) for r in got) == [(s, k) for s in range(8) for k in range(counts[s])]


def test_op5(spark, texts):
    from tokenizers import Tokenizer

    plain, start, want = Tokenizer.from_file(tokens.default_tokenizer()), 0, []
    for d, t, _ in sorted(texts, key=lambda x: x[0]):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, tokens.op5(spark, SF).collect())) == want


def test_op6(spark, texts):
    got = rules.op6(spark, SF).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == collections.Counter((d, *rules_brute(t)) for d, t, _ in texts)
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.kept and r.base_failed) for r in got)


def test_rules_with_a_filter_behind(spark):
    """The optimizer moves filters into the statistics; words and window hashes are still computed once a row."""
    rows = rules.judged(table(spark, LARGER, "documents").select("doc_id", "text"), [])
    want = collections.Counter((r.doc_id, r.n_repeat_words, r.n_echoes) for r in rows.collect() if r.kept and r.n_repeat_words < 3 and r.n_echoes < 9)
    got = rows.where("kept and n_repeat_words < 3 and n_echoes < 9").collect()
    assert want and collections.Counter((r.doc_id, r.n_repeat_words, r.n_echoes) for r in got) == want


def test_rules_on_held_out_rows(spark):
    """Learned on two thirds of the labelled rows, held against the last third."""
    docs, labels = table(spark, LARGER, "documents"), table(spark, LARGER, "labels")
    learned = rules.learn(docs, labels.where(fold(3) != 0))
    rows = rules.judged(docs.select("doc_id", "text"), learned).select("doc_id", "base_failed", "kept").collect()
    kept = {r.doc_id: r.kept for r in rows if not r.base_failed}
    held = [(kept[r.doc_id], r.quality == 1) for r in labels.collect() if crc(r.doc_id) % 3 == 0 and r.doc_id in kept]
    assert len(held) > 50 and sum(a == b for a, b in held) >= 0.95 * len(held)


@pytest.mark.parametrize(("op", "label", "modulus", "out"), [(toxicity.op7, "toxic", 4, 2), (ranking.op8, "quality", 5, 0)])
def test_op7_and_op8(spark, op, label, modulus, out):
    """Accuracy on rows that the models never learn from; some thousand labelled rows are there to learn from."""
    got = {r.doc_id: r for r in op(spark, LARGEST).collect()}
    ids = pq.read_table(f"{LARGEST}/documents.parquet")["doc_id"].to_pylist()
    assert sorted(got) == sorted(ids) and op(spark, LARGEST).columns == ["doc_id", "held_out", "score", "predicted"]
    assert all(r.held_out == (crc(d) % modulus == out) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for d, r in got.items())
    labels = pq.read_table(f"{LARGEST}/labels.parquet")
    held = [(got[d].predicted, y) for d, y in zip(labels["doc_id"].to_pylist(), labels[label].to_pylist(), strict=True) if y is not None and got[d].held_out]
    assert len(held) > 500 and sum(a == b for a, b in held) >= 0.97 * len(held)


def test_op10(spark, texts):
    got = mixing.op10(spark, SF).collect()
    size = {d: len(words(t)) for d, t, _ in texts}
    names = sorted({s for *_, s in texts}, key=lambda s: (s is None, s or ""))
    of = {s: sum(size[d] for d, _, x in texts if x == s) for s in names}
    weight, share, goal = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}, 1.5 * sum(of.values()), {}
    while len(goal) < len(names):  # by hand: what is above its bound is fixed, the rest is shared anew
        left = [s for s in names if s not in goal]
        rest = share - sum(goal.values())
        now = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        above = [s for s in left if now[s] > 2 * of[s]]
        goal |= {s: 2.0 * of[s] for s in above} if above else now
    source, taken = {d: s for d, _, s in texts}, collections.Counter()
    for r in got:
        s = source[r.doc_id]
        assert (r["size"], r.source_size) == (size[r.doc_id], of[s]) and r.target == pytest.approx(goal[s]) and 0 <= r.taken <= 2 * r["size"]
        taken[s] += r.taken
    assert len(got) == len(texts) and all(abs(taken[s] - goal[s]) <= 64 for s in names)
    assert key(mixing.op10(spark, SF)) == sorted(map(repr, map(tuple, got)))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_crowded_lists(spark, monkeypatch, seed):
    """Large groups of near copies and near misses, with words left out and put in, by pivots of several levels."""
    monkeypatch.setattr(ngram_join, "CROWD", 2)
    rng, data = random.Random(seed), []
    line = [f"common{k}" for k in range(14)]
    for g in range(3):
        base = [f"g{g}w{rng.randint(0, 300)}" for _ in range(50 + 20 * g)]
        for _ in range(50):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 5])):
                at = rng.randrange(len(w))
                w[at : at + rng.randint(0, 2)] = [f"c{rng.randint(0, 40)}"] * rng.randint(0, 1)
            data.append((len(data), " ".join(w), "en", "s", 1))
    for _ in range(60):
        data.append((len(data), " ".join([*line, *(f"own{rng.randint(0, 60)}" for _ in range(rng.randint(2, 25)))]), "en", "s", 1))
    seen = []
    real = ngram_join.against
    monkeypatch.setattr(ngram_join, "against", lambda pairs, classes: seen.append(pairs.count()) or real(pairs, classes))
    assert key(ngram_join.joined(spark.createDataFrame(data, DDL).repartition(3))) == join_brute(data)
    assert seen and seen[0] > 50


def test_every_query_is_registered():
    assert {f"op{n}" for n in range(1, 11)} | {"pipeline"} == {q.split("_")[0] for q in registry.QUERIES}

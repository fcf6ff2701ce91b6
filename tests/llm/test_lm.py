import math
import re
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cinderwell.llm import gru, lm
from tests.llm.helpers import SCHEMA, documents

LOWER = {i: i + 32 for i in range(65, 91)}


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(3)
    flat = gru.initial(np.arange(gru.VOCAB, 0, -1.0), np.ones(gru.ENDINGS))
    flat[:gru.SIZE] += rng.normal(0, 0.2, gru.SIZE)
    return gru.Model(flat)


def plain_score(m, doc):
    """One document, word by word, in doubles."""
    p = {k: v.astype(float) for k, v in m.p.items()}
    H, h, total, last = gru.HIDDEN, np.zeros(gru.HIDDEN), 0.0, gru.START
    soft = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    for t in doc:
        x, g = p["inputs"][last], h @ p["again"]
        z, r = (1 / (1 + np.exp(-(x[a:a + H] + g[a:a + H]))) for a in (0, H))
        new = np.tanh(x[2 * H:] + r * g[2 * H:])
        h = (1 - z) * new + z * h
        classes = soft(np.append(h, 1) @ p["classes"])
        if t < gru.VOCAB:
            c = t // gru.IN_CLASS
            own = slice(c * gru.IN_CLASS, (c + 1) * gru.IN_CLASS)
            total += math.log(classes[c]) + math.log(soft(p["words"][own] @ np.append(h, 1))[t % gru.IN_CLASS])
        else:
            total += math.log(classes[gru.HEADS + t - gru.VOCAB])
        last = t
    return total


def some_docs(seed, n):
    rng = np.random.default_rng(seed)
    return [rng.integers(0, gru.START, k).astype(np.int32) for k in rng.integers(1, 150, n)]


def test_state_is_carried_through_whole_documents(model, monkeypatch):
    docs = some_docs(1, 9)
    want = [plain_score(model, d) for d in docs]
    assert np.allclose(model.score(docs), want, rtol=1e-4)
    monkeypatch.setattr(gru, "WINDOW", 3)
    monkeypatch.setattr(gru, "LANES", 2)
    assert np.allclose(model.score(docs), want, rtol=1e-4)


def test_probabilities_of_a_next_word_add_up(model):
    first = [5, gru.VOCAB + 3]
    each = model.score([np.array([*first, t], np.int32) for t in range(gru.START)]) - model.score([np.array(first, np.int32)])[0]
    assert np.exp(each).sum() == pytest.approx(1, abs=1e-3)


def test_gradients_are_those_of_small_steps(model, monkeypatch):
    docs, seen = some_docs(2, 4), {}
    monkeypatch.setattr(gru, "WINDOW", 400)  # one window: nothing is cut off
    m = gru.Model(model.flat)
    monkeypatch.setattr(m, "_update", seen.update)
    m.learn(docs)
    rows, values = seen["inputs"]
    full = np.zeros(gru.SHAPES["inputs"])
    full[rows] = values
    loss = lambda: -sum(plain_score(m, d) for d in docs)
    for name, got in [*((k, v) for k, v in seen.items() if k != "inputs"), ("inputs", full)]:
        for at in [np.unravel_index(k, got.shape) for k in np.argsort(-np.abs(got).ravel())[:3]]:
            old = m.p[name][at]
            m.p[name][at] = old + 0.01
            up = loss()
            m.p[name][at] = old - 0.01
            down = loss()
            m.p[name][at] = old
            assert got[at] == pytest.approx((up - down) / 0.02, rel=0.02, abs=0.02), name


def test_learning_helps():
    rng = np.random.default_rng(7)
    two = [np.array([*(40 * k + rng.integers(0, 20, 60)), 0], np.int32) for k in rng.integers(1, 3, 400)]
    m = gru.Model(gru.initial(np.ones(gru.VOCAB), np.ones(gru.ENDINGS)))
    before = m.score(two[300:]).sum()
    for _ in range(6):
        m.learn(two[:300])
    assert m.score(two[300:]).sum() > 0.7 * before


def plain(rows):
    toks = [re.findall(r"[^\x20\x09-\x0D]+", (r["text"] or "").translate(LOWER)) + [""] for r in rows]
    held = [zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 10 == 0 for r in rows]
    c = Counter(w for t, h in zip(toks, held) if not h for w in t)
    n, v = sum(c.values()), len(c)
    return [(r["doc_id"], h, len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)) for r, t, h in zip(rows, toks, held)]


def same(got, want):
    order = lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:5]), round(r[5], 4))
    got, want = sorted((tuple(r)[:6] for r in got), key=order), sorted(want, key=order)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert [r[5] for r in got] == pytest.approx([r[5] for r in want])


@pytest.mark.parametrize("lookup", [lm.LOOKUP, 30])
def test_counts_and_unigram_scores(spark, lookup):
    extra = [(None, "Words of NO id ÄÖ", None, None, None), (None, None, None, None, None), (5000, "x" * 90 + " y " + "x" * 90, "en", "s", 0),
             (5001, "x" * 90 + " " + "x" * 91, "en", "s", 0), (5000, "again", "en", "s", 0)]
    docs = documents(spark, extra=extra).repartition(3, "doc_id").withColumn("score", F.lit("x")).withColumn("part", F.lit(1))
    got = lm.score(docs, lookup=lookup).collect()
    same(got, plain(docs.collect()))
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert got[0].asDict().keys() == {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"}


def test_untrained_model_is_the_unigram_model(spark):
    docs = documents(spark)
    counts = lm.word_counts(docs).cache()
    known = lm.lexicon(counts, 50)
    params = gru.initial(np.array(known.vocabulary) + lm.ADDED, known.ending_mass)
    for r in lm.scored(lm.numbered(docs, known), counts, known, params).collect():
        assert r["score"] == pytest.approx(r["base_score"], rel=1e-3)


def test_held_out_text_gets_likelier(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(f"{'ab'[i % 2]}{k}" for k in rng.integers(0, 30, 120)), "en", "s", 0) for i in range(400)]
    got = [r for r in lm.score(spark.createDataFrame(rows, SCHEMA)).collect() if r["held_out"]]
    assert len(got) > 20 and sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


def test_none_to_learn_from(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert lm.score(empty).count() == 0
    only = spark.createDataFrame([(None, "no id is held out", None, None, None)], SCHEMA)
    row = lm.score(only).first()
    assert row["held_out"] and row["base_score"] == 0 and row["n_known"] == 0 and row["train_tokens"] == 0 and math.isfinite(row["score"])


def test_rows_far_below_the_largest_logit():
    x = np.random.default_rng(3).normal(0, 1, (5, 8)).astype(np.float32)
    x[2] -= 300
    target = np.array([0, 3, 7, 1, 2])
    want = x.astype(np.float64) - np.log(np.exp(x.astype(np.float64) - x.max(1, keepdims=True)).sum(1, keepdims=True)) - x.max(1, keepdims=True)
    slope = np.exp(want) - np.eye(8)[target]
    assert np.allclose(gru._log_soften(x, target, True), want[np.arange(5), target], atol=1e-4) and np.allclose(x, slope, atol=1e-5)


def test_tasks_look_up_and_count_many_documents_at_a_time(monkeypatch):
    monkeypatch.setattr(lm, "WORDS", 4)
    texts = [b"", b"a bb \xff cc cc", b"x" * 70 + b" a " + b"x" * 70, b" ", b"dd a e\xc3\xa9 a", b"a"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6), pa.int64()), pa.array([10, 11, 12, 13, 14, 20], pa.int64()), pa.array(texts, pa.binary())], ["doc_id", "part", "text"])
    told = lambda w: lm.key(w).decode("utf-8", "replace")
    want = Counter((told(w), lm.ending(w), p % 10 == 0) for p, t in zip(batch.column("part").to_pylist(), texts) for w in lm.tokens(t))
    got = Counter()
    for rows in lm._count([batch]):
        for r in rows.to_pylist():
            got[r["word"], r["ending"], False] += r["train"]
            got[r["word"], r["ending"], True] += r["held"]
    assert +got == want
    known = lm.Lexicon(20, 8, {b"a": 0, lm.key(b"x" * 70): 1, b"cc": 2}, np.array([5, 2, 0]), np.array([1, 2, gru.VOCAB + lm.ending(b"cc")], np.int32), 4, [4, 5, 2], np.ones(gru.ENDINGS))
    rows = [r for b in lm._number(SimpleNamespace(value=known))([batch]) for r in b.to_pylist()]
    assert [r["doc_id"] for r in rows] == list(range(6))
    for r, text in zip(rows, texts):
        words = lm.tokens(text)
        place = [known.place.get(lm.key(w)) for w in words]
        assert {x["word"]: x["n"] for x in r["rest"]} == Counter(told(w) for w, p in zip(words[:-1], place) if p is None)
        numbers = [0 if not w else gru.VOCAB + lm.ending(w) if p is None else known.number[p] for w, p in zip(words, place)]
        assert np.frombuffer(r["numbers"], np.uint16).tolist() == numbers and r["n_tokens"] == len(words)
        seen = [known.count[p] for p in place if p is not None]
        assert r["n_known"] == sum(n > 0 for n in seen) + 1
        assert r["base"] == pytest.approx(sum(math.log10(n + 0.1) for n in [*seen, 4]) - len(words) * math.log10(known.all_mass))
        assert r["share"] == pytest.approx(sum(math.log10(0.1) for w in words if w == b"cc"))

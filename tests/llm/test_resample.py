import math
import re
import zlib
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cinderwell.llm import resample
from tests.llm.helpers import SCHEMA, documents

LOWER = {i: i + 32 for i in range(65, 91)}


def grams(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return w, [" ".join(w[i:i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain(rows, target, percent=5, min_words=20):
    """The draw by loops: (doc_id, n_features, weight, score, rank) of each row."""
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = [0] * 10000, [0] * 10000
    for texts, out in (([r[1] for r in rows], s), (target, t)):
        for text in texts:
            for f in grams(text)[1]:
                out[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10000) / ((a + 1) * (sum(t) + 10000)))) for a, b in zip(s, t)]
    scored = []
    for r in rows:
        w, f = grams(r[1])
        h = int(sha256(f"42:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(x)] for x in f)
        scored.append((len(w), r[0], len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in scored if r[0] >= min_words), key=lambda r: (-r[4], r[1] is None, r[1] or 0))
    rank = {}
    for i, r in enumerate(fit[:percent * len(fit) // 100], 1):
        rank.setdefault(r, []).append(i)
    return sorted(((*r[1:], rank[r].pop(0) if rank.get(r) else None) for r in scored), key=str)


def check(docs, target, percent=40):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = resample.resample(docs, target, percent=percent).drop("n_words")
    want = plain(rows, [r["text"] for r in target.collect()], percent)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    return want


def test_draw_is_that_of_plain_loops(spark):
    long = "\n".join(["one", "", "two words", "a" * 70 + " x", "b" * 200, "ÄÖ é z"] * 40)
    docs = documents(spark, extra=[
        (None, "alpha\nbeta gamma\n" * 30, None, None, None), (None, None, None, None, None), (2000, "", "en", "s", 0),
        (2001, long, "en", "s", 0), (2002, long, "en", "s", 0), (2002, long, "en", "s", 0), (2003, "\n\n\n", "en", "s", 0)])
    target = spark.createDataFrame([("the and plain words two words",), (None,), ("b" * 200 + " one\ntwo",)], "text string")
    want = check(docs, target)
    assert sum(r[4] is not None for r in want) >= 5


def test_empty_sides(spark):
    nothing, one = spark.createDataFrame([], SCHEMA), documents(spark, 4)
    assert resample.resample(nothing, one).count() == 0
    check(one, nothing.select("text"))


def test_columns_with_clashing_names_are_left_alone(spark):
    docs = documents(spark, 10).select("doc_id", "text", F.lit("x").alias("score"), F.lit(1).alias("rank"), F.lit(1).alias("place"))
    check(docs, docs.select("text"))


@pytest.mark.parametrize("texts", [["a b\nc d e", "x"], ["", "é\n\nà b", "z" * 65 + " " + "y" * 66 + "\nk"], ["a\nb\nc\nd"]])
def test_features_within_and_across_lines_add_up(texts):
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    words = resample.Words(data, np.cumsum([len(t.encode()) for t in texts]))
    of, bucket = resample.features(words)
    want = sorted((k, zlib.crc32(f.encode()) % 10000) for k, t in enumerate(texts) for f in grams(t)[1])
    assert sorted(zip(of.tolist(), bucket.tolist())) == want
    within = sorted((k, zlib.crc32(f.encode()) % 10000) for k, t in enumerate(texts) for line in t.split("\n") for f in grams(line)[1])
    across = resample.features(words, across=True)
    assert sorted([*within, *zip(across[0].tolist(), across[1].tolist())]) == want


def test_pieces_do_not_cut_words(monkeypatch):
    text = ("some words, é and\nlines " * 50)
    whole = np.frombuffer(text.encode(), np.uint8)
    want = resample.features(resample.Words(whole, np.array([len(whole)])))[1]
    for piece in (1, 2, 7, 64):
        monkeypatch.setattr(resample, "PIECE", piece)
        assert (resample.features(resample.Words(whole, np.array([len(whole)])))[1] == want).all()
        assert sum(len(ends) for _, _, ends in resample._slices(pa.array(["ab", "", "c" * 9, ""]))) == 4

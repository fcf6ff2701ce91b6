import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinderwell.llm import runs
from tests.llm.helpers import SCHEMA, documents


def plain_runs(w):
    """All runs by comparing words at each period, the smallest period kept."""
    n, found = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)  # periods ascend
            i = j + 1
    return sorted(((a, b - a, q) for (a, b), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and w:
        a, g = h // 10 % len(w), h // 10
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    found = plain_runs(w)
    gone = {i for a, n, q in found for i in range(a + q, a + n)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None, None, None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None,
            sha("".join(f"{a},{n},{q}\n" for a, n, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def made(rng):
    """Few letters, with periodic stretches, some broken by one word."""
    out = [rng.choice("abc") for _ in range(rng.randrange(12))]
    for _ in range(rng.randrange(4)):
        root = [rng.choice("abc") for _ in range(rng.randrange(1, 7))]
        part = (root * 12)[:rng.randrange(1, 40)]
        if rng.random() < 0.3:
            part[rng.randrange(len(part))] = "d"
        out += part + [rng.choice("abcd") for _ in range(rng.randrange(3))]
    return out


@pytest.mark.parametrize("seed", range(8))
def test_runs_are_those_of_plain_comparison(seed):
    rng = random.Random(seed)
    texts = [made(rng) for _ in range(120)] + [[], ["a"], ["a"] * 5, ["a"] * 6, ["a", "b"] * 4, list("aab") * 40, ["a"] * 300]
    assert runs.in_texts(texts) == [plain_runs(t) for t in texts]


def test_runs_inside_runs_and_at_both_ends():
    deep = (["x"] * 6 + ["y"]) * 5
    texts = [deep, deep[3:], ["z"] + deep + ["z"], deep * 2 + ["x"] * 9]
    got = runs.in_texts(texts)
    assert got == [plain_runs(t) for t in texts]
    assert (0, 35, 7) in got[0] and (0, 6, 1) in got[0]


def test_suffix_array_and_shared_words():
    rng = random.Random(5)
    texts = [[rng.choice("ab") for _ in range(rng.randrange(1, 30))] for _ in range(20)]
    ids, ends = runs.numbered(texts)
    order, place, common = runs.suffixes(ids, ends)
    start = {}
    for k, e in enumerate(ends):
        for i in range(e - len(texts[k]), e):
            start[i] = (k, ids[i:e].tolist())
    assert [start[i] for i in order] == sorted(start.values())
    assert (order[place] == np.arange(len(ids))).all()
    for j in range(1, len(order)):
        (a, x), (b, y) = start[order[j - 1]], start[order[j]]
        same = next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
        assert common[j] == (same if a == b else 0)


def test_groups_do_not_matter(monkeypatch):
    rng = random.Random(9)
    texts = [made(rng) for _ in range(60)]
    want = runs.in_texts(texts)
    assert [runs.in_texts([t])[0] for t in texts] == want
    monkeypatch.setattr(runs, "GROUP", 10)
    assert runs.in_texts(texts) == want


def test_rows(spark):
    rng = random.Random(3)
    extra = [(3000 + i, " ".join(made(rng)), "en", "s", 0) for i in range(80)]
    extra += [(None, "go " * 40, None, None, None), (None, None, None, None, None), (7, "", "en", "s", 0), (3000, extra[0][1], "en", "s", 0),
              (4000, "\n".join(["one line again"] * 9) + " é ü", "en", "s", 0)]
    docs = documents(spark, extra=extra)
    got = runs.periodic(docs.withColumn("start", F.lit("x")), edit=runs.planted).collect()
    want = [plain_row(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert sum(r["n_runs"] > 0 for r in got) > 20 and runs.periodic(spark.createDataFrame([], SCHEMA)).count() == 0


def test_collapse_leaves_other_texts_alone(spark):
    docs = spark.createDataFrame([(1, "a  b\nc"), (2, "go " * 8 + "on"), (3, None)], "doc_id long, text string")
    assert [r["text"] for r in runs.collapse(docs).orderBy("doc_id").collect()] == ["a  b\nc", "go on", None]

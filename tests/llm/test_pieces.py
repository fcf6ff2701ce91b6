import random

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from cinderwell.llm import pieces
from tests.llm.helpers import SCHEMA, documents, prose, write_table

TEXTS = ["", " ", "  Hello\n\tworld  ", "▁▁ a▁b", "日本語テキスト😀 x\u0000y", "ab" * 300, " " * 40 + "x", " " * 100, "é" * 50, "a b", "the the",
         "!!!!!???", "<s> </s> <unk> <0x41>", "ﬁ Ｈ", "snake_case_name(x)->y; a²b c². 3²", "xyz" * 2000, "don't stop.", "\r\n\r\n", "हिन्दी में", "ไทย" * 20]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())


def ids(rows):
    return [np.frombuffer(r, np.int32).tolist() for r in rows]


def test_ids_are_the_librarys(library):
    rng = random.Random(1)
    alphabet = "aeinst rdlu▁  ,.()_$²éß日\n0123AZ"
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 80))) for _ in range(400)] + [prose(rng, 50) for _ in range(20)]
    matcher, decoder = pieces.load(pieces.model_path())
    for text, got in zip(texts, ids(matcher.encode(texts))):
        assert got == library.encode(text), repr(text)
        assert decoder.decode(got) == library.decode(got) == library.normalize(text).replace("▁", " ")[1:]


def test_index_finds_every_occurrence():
    vocabulary = {p: (i, -float(i)) for i, p in enumerate(["a", "ab", "b", "ba", "aba", "c", "ccc"])}
    m = pieces.Matcher(vocabulary, True, None, 9, str)
    text = "abaccccba\0ab"
    start, end, which = m.edges(np.array([ord(c) for c in text], np.int64))
    want = sorted((i + len(p), len(p), i, p) for p in vocabulary for i in range(len(text)) if text.startswith(p, i))
    assert [(e, e - s, s, m.names[w]) for s, e, w in zip(start.tolist(), end.tolist(), which.tolist())] == want


def test_unigram_takes_the_best_path():
    rng = random.Random(7)
    vocabulary = {c: (i, -8.0 - i) for i, c in enumerate("abc")}
    for _ in range(25):
        p = "".join(rng.choice("abc") for _ in range(rng.randrange(2, 5)))
        vocabulary.setdefault(p, (len(vocabulary), -rng.random() * 12))
    m = pieces.Matcher(vocabulary, False, None, 99, str)

    def best(t):
        at = [(0.0, [])]
        for j in range(1, len(t) + 1):
            at.append(max((at[i][0] + vocabulary[t[i:j]][1], at[i][1] + [vocabulary[t[i:j]][0]]) for i in range(j) if t[i:j] in vocabulary))
        return at[-1][1]

    texts = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 30))) for _ in range(60)]
    assert ids(m.encode(texts)) == [best(t) for t in texts]


def test_memory_is_bounded_and_results_do_not_depend_on_it(monkeypatch, library):
    monkeypatch.setattr(pieces, "MEMO_CUTS", 3)
    monkeypatch.setattr(pieces, "MEMO_PAIRS", 20)
    monkeypatch.setattr(pieces, "INDEX_CHARS", 10)
    matcher = pieces.load.__wrapped__(pieces.model_path())[0]
    for _ in range(2):
        assert ids(matcher.encode(TEXTS)) == [library.encode(t) for t in TEXTS]


def test_query(spark, tmp_path, library):
    docs = documents(spark, 24).persist()
    got = pieces.op1_sentencepiece(spark, write_table(spark, tmp_path, "documents", docs)).collect()
    want = sorted((r.doc_id, tuple(library.encode(r.text or "")), r.text or "") for r in docs.collect())
    assert sorted((r.doc_id, tuple(r.ids), r.decoded) for r in got) == want
    assert all(r.n_ids == len(r.ids) for r in got)


def test_edge_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert pieces.decoded(pieces.encoded(docs)).count() == 0
    docs = spark.createDataFrame([(1, None, "en", "s", 0)] * 2, SCHEMA).withColumn("ids", F.lit("mine"))
    out = pieces.decoded(pieces.encoded(docs))
    assert [(r.ids, r.n_ids, r.decoded) for r in out.collect()] == [([], 0, "")] * 2

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from cinderwell.llm import digests
from tests.llm.helpers import SCHEMA, documents, prose, write_table


def test_counts_by_plain_loop():
    rng = random.Random(1)
    for n in (0, 1, 4, 5, 6, 300):
        text = bytes(rng.randrange(256) for _ in range(n))
        padded, want = text.ljust(5, b"\0") if text else b"", [0] * 256
        for i in range(max(0, len(padded) - 4)):
            for salt, places in enumerate(digests.TRIPLETS):
                h = 0x811C9DC5 ^ salt
                for p in places:
                    h = (h ^ padded[i + p]) * 0x01000193 % 2**32
                h ^= h >> 15
                want[h * 0x9E3779B1 % 2**32 >> 24] += 1
        assert digests.counts(text).tolist() == want


def test_pieces_of_a_long_text_add_up(monkeypatch):
    text = prose(random.Random(2), 500).encode()
    whole = digests.digest(text)
    monkeypatch.setattr(digests, "PIECE", 64)
    assert digests.digest(text) == whole


def test_difference_is_bounded_symmetric_and_grows_with_edits():
    rng = random.Random(3)
    a, b = prose(rng, 400), prose(rng, 400)
    d = [digests.digest(x.encode()) for x in (a, a + " more", a[:len(a) // 2] + b[len(a) // 2:], b, "", "z")]
    for x in d:
        for y in d:
            assert digests.difference(x, y) == digests.difference(y, x) and 0 <= digests.likeness(x, y) <= 1
            assert (digests.difference(x, y) == 0) == (x == y)
    assert digests.likeness(d[0], d[1]) > digests.likeness(d[0], d[2]) > digests.likeness(d[0], d[3])
    worst = bytes([0, 0, 0]) + bytes([0x33] * 64), bytes([1, 255, 0x88]) + bytes([0xCC] * 64)
    assert digests.difference(*worst) == digests.MAX_DIFFERENCE


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_every_document_meets_the_next(spark, tmp_path, parts):
    docs = documents(spark, 40).dropDuplicates(["doc_id"]).repartition(3).persist()
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()))
    got = {r.doc_id: r for r in digests.fingerprints(docs, parts=parts).collect()}
    assert len(got) == len(rows)
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        n = len(text) // 2
        edited = text[:len(text) - n] + after[:n]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        own, changed, other = (digests.digest(x.encode()) for x in (text, edited, after))
        assert (r.fingerprint, r.edited_fingerprint) == (own.hex(), changed.hex())
        assert (r.near_edited, r.near_next) == (digests.likeness(own, changed), digests.likeness(own, other))
    d = write_table(spark, tmp_path, "documents", docs.withColumn("part", F.lit(1)).withColumn("lent", F.lit(True)))
    assert sorted(digests.op2_fingerprints(spark, d).collect()) == sorted(got.values())


@pytest.mark.parametrize("rows", [[], [(None, "a b", None, None, None)], [(1, "hello there", "en", "s", 0)] * 3, [(None, None, None, None, None), (None, "x", None, None, None), (2, "y", None, None, None)]])
def test_degenerate_tables(spark, rows):
    out = digests.fingerprints(spark.createDataFrame(rows, SCHEMA), parts=3).collect()
    assert len(out) == len(rows) and sorted(r.n_chars for r in out) == sorted(len(r[1] or "") for r in rows)

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cinderwell.llm import arrowfiles
from tests.llm.helpers import SCHEMA, documents, write_table

TEXTS = ["a  b c", "x \n y", " lead", "trail ", "it's don't  x y z", "a <|endoftext|> b", "l.\nNext,one;two\n\nthree", "a\0b c", "日本 ﬁ😀 é", "a.b ... x, , y., 's don't. z\n", "x\n", "\nx", " x y ", "a\u2028b c", "a\x1cb c", "²³ x² y", "\n\n x\n", "tab\t x", "w\u00a0 x \u00a0y", ""]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(arrowfiles.tokenizer_path())
    return lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids


def test_cuts_do_not_change_ids(library, spark):
    texts = TEXTS + [r.text or "" for r in documents(spark, 40).collect()]
    encoder = arrowfiles._encoder(arrowfiles.tokenizer_path())
    for _ in range(2):
        for text in texts:
            assert np.frombuffer(encoder.encode(text), encoder.type).tolist() == library(text), repr(text)


def test_query(spark, tmp_path, library):
    docs = documents(spark, 30).dropDuplicates(["doc_id"]).withColumn("shard", F.lit("mine")).persist()
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect())
    want, start = [], 0
    for i, text in rows:
        ids = library(text) + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = arrowfiles.op4_token_ids(spark, write_table(spark, tmp_path, "documents", docs))
    assert sorted(map(tuple, got.select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == want


def test_files_are_fixed_size_lists_read_without_a_copy(spark, tmp_path, library):
    docs = documents(spark, 30).persist()
    shards = arrowfiles.write(docs, str(tmp_path), length=16, parts=2)
    fs, base = arrowfiles._filesystem(str(tmp_path))
    ids = []
    for k, n in shards:
        reader = arrowfiles.ShardReader(fs, f"{base}/tokens-{k:06d}.arrow")
        assert reader.file.schema.field("input_ids").type == pa.list_(pa.uint16(), 16)
        assert reader.file.schema.field("mask").type == pa.list_(pa.bool_(), 16)
        before = pa.total_allocated_bytes()
        views = [reader.sequence(s) for s in range(-(-n // 16))]
        assert pa.total_allocated_bytes() == before  # mapped, not read
        flat, mask = np.concatenate([v for v, _ in views]), [x for _, m in views for x in m.to_pylist()]
        assert mask == [True] * n + [False] * (len(mask) - n)
        ids += flat[:n].tolist()
        assert np.concatenate(list(reader.ids(3, n - 3))).tolist() == flat[3:n].tolist()
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    assert sorted(ids) == sorted(x for _, t in rows for x in library(t) + [2])


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)], [(1, "hello", "en", "s", 0)] * 3])
def test_degenerate_tables(spark, tmp_path, rows):
    folder = str(tmp_path / "out")
    shards = arrowfiles.write(spark.createDataFrame(rows, SCHEMA), folder)
    got = arrowfiles.read(spark, folder, shards, arrowfiles._checksum, "doc_id long, start long, n_tokens long, ids_crc32 long").collect()
    assert len(got) == len(rows) and sum(r.n_tokens for r in got) == sum(n for _, n in shards)


def test_rewriting_a_shard_replaces_it(spark, tmp_path):
    docs = documents(spark, 10)
    assert arrowfiles.write(docs, str(tmp_path), parts=1) == arrowfiles.write(docs, str(tmp_path), parts=1)
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["docs-000000.arrow", "tokens-000000.arrow"]

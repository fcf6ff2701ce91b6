import random

import public_tokenizers
import pytest

from cinderwell.llm import rollup
from tests.llm.helpers import SCHEMA, documents, write_table

CHANGE = "op string, doc_id long, version string, source string, lang string, n_tokens long, n_chars long"


def totals(r):
    return {(x.version, x.source, x.lang): (x.n_docs, x.n_tokens, x.n_chars) for x in r.totals().collect()}


def test_random_batches_against_a_dictionary(spark, tmp_path):
    rng = random.Random(9)
    r, state = rollup.Rollup(spark, str(tmp_path / "r")), {}
    for batch in range(1, 5):
        changes, last = [], {}
        for _ in range(30):
            key = (rng.choice([None, *range(12)]), rng.choice(["v1", "v2"]))
            if rng.random() < 0.3:
                changes.append(("delete", *key, None, None, None, None))
                last.setdefault(key, None)
            else:
                new = (rng.randrange(9), rng.randrange(50), rng.choice(["a", "b"]), rng.choice(["en", "de"]))
                changes += [("upsert", *key, new[2], new[3], new[0], new[1])] * rng.choice([1, 1, 2])
                last[key] = max(last.get(key) or new, new)
        for key, new in last.items():
            state.pop(key, None)
            if new:
                state[key] = new
        df = spark.createDataFrame(changes, CHANGE)
        assert r.apply(batch, df) is True
        assert r.apply(batch, df) is False  # the same batch again
        want = {}
        for (_, version), (tokens, chars, source, lang) in state.items():
            g = want.setdefault((version, source, lang), [0, 0, 0])
            g[0], g[1], g[2] = g[0] + 1, g[1] + tokens, g[2] + chars
        assert totals(r) == {k: tuple(v) for k, v in want.items()}


def test_a_batch_that_broke_off_is_done_again(spark, tmp_path):
    r = rollup.Rollup(spark, str(tmp_path / "r"))
    df = spark.createDataFrame([("upsert", 1, "v", "a", "en", 5, 9)], CHANGE)
    r.apply(1, df)
    (tmp_path / "r" / "rollup" / "batch=1" / "_SUCCESS").unlink()  # as if the commit had not happened
    assert totals(r) == {} and r.apply(1, df) is True
    assert totals(r) == {("v", "a", "en"): (1, 5, 9)}


def test_empty_and_unknown(spark, tmp_path):
    r = rollup.Rollup(spark, str(tmp_path / "r"))
    assert totals(r) == {} and r.committed() == []
    assert r.apply(1, spark.createDataFrame([], CHANGE)) and r.committed() == [1]
    assert r.apply(2, spark.createDataFrame([("delete", 7, "v", None, None, None, None)], CHANGE))
    assert totals(r) == {}


@pytest.mark.parametrize("n", [0, 24])
def test_query(spark, tmp_path, n):
    docs = (documents(spark, n) if n else spark.createDataFrame([], SCHEMA)).dropDuplicates(["doc_id"]).persist()
    got = rollup.op8_token_rollup(spark, write_table(spark, tmp_path, "documents", docs))
    seen, want = set(), {}
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        text = r.text or ""
        if text in seen:
            continue
        seen.add(text)
        text = "\n".join(dict.fromkeys(text.split("\n")))
        for v in rollup.VERSIONS:
            ids = rollup._encoding(public_tokenizers.path(f"{v}.tiktoken"), public_tokenizers.PATTERN).encode_ordinary(text)
            g = want.setdefault((v, r.source, r.lang), [0, 0, 0])
            g[0], g[1], g[2] = g[0] + 1, g[1] + len(ids), g[2] + len(text)
    assert {(x.version, x.source, x.lang): [x.n_docs, x.n_tokens, x.n_chars] for x in got.collect()} == want

import random
import re

import pytest
from pyspark.sql import functions as F

from cinderwell.llm import quality
from tests.llm.helpers import SCHEMA, documents, prose, write_table


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    covered = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 5)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_counts_match_brute_force(spark, tmp_path):
    docs = documents(spark, 30).where("doc_id < 1000").unionByName(
        spark.createDataFrame([(None, "a b c d e a b c d e f", "en", "x", 0), (77, "x x x x x x x", None, None, None)], SCHEMA))
    docs = docs.persist()
    got = quality.op3_quality_rules(spark, write_table(spark, tmp_path, "documents", docs)).collect()
    want = sorted((str(r.doc_id), *brute(r.text)) for r in docs.collect())
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_verdict_finds_junk_without_labels(spark):
    import random
    rng = random.Random(3)
    good = [(i, ".\n".join(prose(rng, 30) for _ in range(4)) + ".", "en", "a", 0) for i in range(200)]
    junk = [(1000 + i, " ".join(w + "%%%" for w in prose(rng, 100).split()), "en", "a", 0) for i in range(20)]
    kept = {r.doc_id for r in quality.filter_documents(spark.createDataFrame(good + junk, SCHEMA)).collect()}
    assert kept >= set(range(200)) and not kept & set(range(1000, 1020))


def test_posterior_is_the_em_fixed_point_of_the_patterns(spark):
    """One rule that objects often and alone is trusted; one that objects
    hardly ever is put down to error."""
    clean, often, rarely = 4253, 4253 - 3, 4253 - 27 * 3  # symbols, stutter object
    fit = quality.posteriors(spark.createDataFrame([(clean, 100_000), (often, 5000), (rarely, 20)], "pattern int, n long"))
    p = {r.pattern: r.posterior for r in fit.collect()}
    assert p[clean] > 0.99 and p[often] < 0.5 < p[rarely]


RULES = ["length", "symbols", "repeats", "dup_lines", "stutter", "word_length", "line_ends", "capitals"]


def pattern(**votes):
    return sum((votes.get(name, 0) + 1) * 3 ** j for j, name in enumerate(RULES))


GOOD = {"length": 1, "word_length": 1, "line_ends": 1}
#: the most frequent patterns of a corpus of 10,000 documents
COUNTS = {pattern(**GOOD): 8163, pattern(**GOOD, symbols=-1): 479, pattern(word_length=1, line_ends=1): 254,
          pattern(**GOOD, repeats=-1, dup_lines=-1, capitals=-1): 172, pattern(**GOOD, repeats=-1, capitals=-1): 154,
          pattern(length=1, word_length=1, line_ends=-1, repeats=-1, stutter=-1): 149, pattern(length=-1, word_length=1, line_ends=1): 116,
          pattern(length=1, line_ends=1, symbols=-1): 93, pattern(**GOOD, dup_lines=-1): 14, pattern(line_ends=1): 3}


def fitted(spark, counts):
    return {r.pattern: r.posterior for r in quality.posteriors(spark.createDataFrame(list(counts.items()), "pattern int, n long")).collect()}


def test_frequent_lone_objection_is_trusted_at_any_size(spark):
    """The same shares give the same posteriors, and the fit has settled."""
    assert [name for name, _ in quality.rules()] == RULES
    once = fitted(spark, COUNTS)
    assert once[pattern(**GOOD, symbols=-1)] < 0.1 and once[pattern(**GOOD)] > 0.99 and once[pattern(**GOOD, dup_lines=-1)] > 0.5
    for scale in (10, 100):
        p = fitted(spark, {k: n * scale for k, n in COUNTS.items()})
        assert p == pytest.approx(once, abs=1e-6)


def test_abstention_does_not_count_against_a_document(spark):
    """No bad vote, and enough words: kept, whatever the others are."""
    abstains = {pattern(line_ends=1): 3, pattern(): 1, pattern(length=1): 1, pattern(word_length=1, line_ends=1): 2}
    mostly_junk = {pattern(**GOOD, symbols=-1): 9000, pattern(length=1, word_length=1, line_ends=-1, stutter=-1): 900}
    for counts in (COUNTS, {k: 5 * n for k, n in COUNTS.items()}, mostly_junk):
        p = fitted(spark, abstains | counts)
        assert all(p[k] > 0.999 for k in abstains)
    words = " ".join(f"k{i}" for i in range(10, 30)) + "."
    rows = [(i, " ".join(f"%% {w}$$" for w in prose(random.Random(i), 60).split()), "en", "a", 0) for i in range(40)] + [(99, words, "en", "a", 0)]
    assert [r.doc_id for r in quality.filter_documents(spark.createDataFrame(rows, SCHEMA)).collect()] == [99]


def test_rule_that_does_not_fit_the_corpus_is_left_out(spark):
    """All lines without a full stop: the lines say nothing, symbols still do."""
    bare, junk = pattern(length=1, word_length=1, line_ends=-1), pattern(length=1, word_length=1, line_ends=-1, symbols=-1)
    p = fitted(spark, {bare: 900, junk: 100, pattern(**GOOD): 20})
    assert p[bare] > 0.999 and p[junk] < 0.1


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None)], [(None, "", "en", "s", 0)] * 2])
def test_degenerate_tables(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    scored = quality.score(docs, keep=["doc_id"])
    assert scored.count() == len(rows) and scored.where("kept").count() == 0
    assert quality.filter_documents(docs).columns == docs.columns


def test_clashing_columns_stay(spark):
    docs = documents(spark, 16).withColumn("n_words", F.lit("mine")).withColumn("kept", F.lit(7)).withColumn("t", F.lit(1)).withColumn("row", F.lit(2))
    out = quality.filter_documents(docs)
    assert out.columns == docs.columns and {(r.n_words, r.kept, r.t, r.row) for r in out.collect()} == {("mine", 7, 1, 2)}

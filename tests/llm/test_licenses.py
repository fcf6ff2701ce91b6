import random
import re

import pytest
from pyspark.sql import functions as F

from cinderwell.llm import licenses
from tests.llm.helpers import SCHEMA, documents, write_table

PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def brute(text):
    text = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    hits = [(i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
    places = [i for i, _ in hits]
    return len(w), len(hits), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in hits}))


def licensed(spark):
    rng = random.Random(6)
    parts = ["GNU General Public License", "apache license", "Apache  License,\nVersion 2.0", "cc by", "CC BY-NC 4.0", "mit license", "MIT", "license", "gnu",
             "general public license", "the", "é", "cc", "by", "Permission is hereby granted, free of charge, to any person obtaining a copy", "GNU GNU general"]
    rows = [(i, " ".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))), "en", "s", 0) for i in range(150)]
    rows += [(500, "Licensed under the Apache License, Version 2.0.", "en", "s", 0), (501, "\u212aIT license MIT\u00a0license", "en", "s", 0), (None, "cc by", None, None, None)]
    return documents(spark, 16, extra=rows)


def test_base_columns_match_brute_force(spark, tmp_path):
    docs = licensed(spark).persist()
    got = licenses.op6_license_scan(spark, write_table(spark, tmp_path, "documents", docs)).persist()
    want = sorted(map(str, ((r.doc_id, *brute(r.text)) for r in docs.collect())))
    assert sorted(str((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in got.collect()) == want
    for r in got.collect():
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    by_id = {r.doc_id: r for r in got.collect()}
    assert by_id[500].labels == "apache,apache-2.0" and by_id[500].score == 1


def test_long_templates_need_phrase_and_weight(spark):
    text = "x Permission is hereby granted, free of charge, to any persons obtaining a copy"
    other = "permission is hereby granted to nobody at all"
    rows = licenses.scan(spark.createDataFrame([(1, text), (2, other), (3, "free of charge to any person obtaining a copy")], "doc_id long, text string"))
    assert {r.row.doc_id: r.labels for r in rows.collect()} == {1: "mit", 2: "", 3: ""}


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None)], [(1, "mit license", "en", "s", 0)] * 2])
def test_degenerate_tables(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("w", F.lit(1)).withColumn("labels", F.lit("mine"))
    out = licenses.scan(docs).collect()
    assert len(out) == len(rows) and all(r.row.labels == "mine" for r in out)

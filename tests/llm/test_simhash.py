import random
import re
from itertools import combinations

import pytest
import xxhash
from pyspark.sql import functions as F

from cinderwell.llm import simhash
from tests.llm.helpers import SCHEMA, documents, write_table


def brute_fingerprint(text):
    text = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_roots(values, bits):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in combinations(sorted(root), 2):
        if ((a ^ b) & (2**64 - 1)).bit_count() <= bits:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {v: find(v) for v in root}


def test_matches_brute_force(spark, tmp_path):
    docs = documents(spark, 60, extra=[(2000 + i, "KAB  İx y Z", "en", "s", 0) for i in range(3)]).persist()
    rows = docs.collect()
    prints = {i: brute_fingerprint(r.text) for i, r in enumerate(rows)}
    roots = brute_roots(set(prints.values()), 3)
    first = {}
    for i, r in enumerate(rows):
        first[roots[prints[i]]] = min(first.get(roots[prints[i]], r.doc_id), r.doc_id)
    want = sorted((r.doc_id, f"{prints[i]:016x}", first[roots[prints[i]]]) for i, r in enumerate(rows))
    got = simhash.op5_simhash_near_dedup(spark, write_table(spark, tmp_path, "documents", docs))
    assert sorted(map(tuple, got.collect())) == want


@pytest.mark.parametrize("chunk", [4096, 3])
def test_links_reach_all_close_pairs_also_in_split_keys(spark, chunk):
    rng = random.Random(5)
    seeds = [rng.getrandbits(64) for _ in range(20)]
    values = set(seeds)
    for s in seeds[:8]:
        for _ in range(30):  # chains and dense groups
            s ^= sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3, 3, 4])))
            values.add(s)
    signed = [v - 2**64 if v >> 63 else v for v in values]
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), chunk=chunk)
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    want = {v: r for v, r in brute_roots(signed, 3).items()}
    sizes = {}
    for v, r in want.items():
        sizes.setdefault(r, set()).add(v)
    assert got == {v: min(sizes[r]) for v, r in want.items() if len(sizes[r]) > 1}


def test_components_of_a_path_a_hub_and_nothing(spark):
    path = [(i, i + 1) for i in range(40)]
    hub = [(100, 101 + i) for i in range(30)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(path + hub + [(7, 7)], "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 131)}
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each_group_stays(spark):
    rows = [(3, "a b c d", "en", "s", 0), (1, "A b c  D", "en", "t", 0), (1, "A b c  D", "en", "t", 0), (5, "other words stand here", "en", "s", 0),
            (None, "yet another null id text", None, None, None), (8, None, "en", "s", 0), (9, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("fp", F.lit("x")).withColumn("key", F.lit("y"))
    out = simhash.one_of_each(docs)
    assert out.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in out.collect()) == sorted(
        [("1", "A b c  D"), ("5", "other words stand here"), ("None", "yet another null id text"), ("8", None)])


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)], [(4, "", None, None, None)] * 3])
def test_degenerate_tables(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows) and all(r.fp == 0 and r.component_id == rows[0][0] for r in got)
    assert simhash.one_of_each(docs).count() == min(1, len(rows))

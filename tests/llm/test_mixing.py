import random

import pytest
from pyspark.sql import functions as F

from cinderwell.llm import mixing
from tests.llm.helpers import SCHEMA, prose, write_table


def brute_targets(sizes, weights=(1, 2, 3), cap=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > cap * sizes[s] + 1e-9]
        if not over:
            return fixed | share
        fixed |= {s: cap * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 5, "c": 7, "é": 900, None: 3}, {"a": 1, "b": 1000}, {"z": 10}, {None: 4, "a": 400, "b": 0}, {f"s{i}": 3 ** i for i in range(9)}])
def test_targets(spark, sizes):
    got = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"))
    want = brute_targets(sizes)
    assert {r.source: r.target for r in got.collect()} == pytest.approx(want)


def corpus(spark, seed=2):
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.randrange(1, 200)), "en", rng.choice(["hot"] * 6 + ["b", "c", None]), 0) for i in range(400)]
    rows += [(900 + i, t, "en", "b", 0) for i, t in enumerate([None, "", " \n"])] + [rows[5], rows[5]]
    return spark.createDataFrame(rows, SCHEMA)


def test_taken_words_come_near_targets_and_reruns_agree(spark, tmp_path):
    docs = corpus(spark).persist()
    d = write_table(spark, tmp_path, "documents", docs)
    got = mixing.op10_source_mix(spark, d)
    rows = got.collect()
    assert len(rows) == docs.count()
    source = {r.doc_id: r.source for r in docs.collect()}
    by = {}
    for r in rows:
        assert r.taken % max(r["size"], 1) == 0 and r.taken <= 3 * r["size"]
        assert r.taken // max(r["size"], 1) in (int(r.target / r.source_size), int(r.target / r.source_size) + 1) or not r["size"]
        by.setdefault(source[r.doc_id], []).append(r)
    for rs in by.values():
        assert sum(r["size"] for r in rs) == rs[0].source_size
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= max(r["size"] for r in rs) * 3
    shuffled = write_table(spark, tmp_path / "again", "documents", docs.repartition(7))
    assert sorted(map(str, mixing.op10_source_mix(spark, shuffled).collect())) == sorted(map(str, rows))


def test_tree_of_several_levels_keeps_mass(spark):
    rng = random.Random(4)
    units = spark.createDataFrame([("s", i, float(rng.randrange(1, 50)), 0.37, 500) for i in range(500)], "source string, key long, mass double, p double, n long")
    up = {r.key: r.extra for r in mixing.rounded(units, 500, group=8).collect()}
    mass = {r.key: r.mass for r in units.collect()}
    assert len(up) == 500 and set(up.values()) == {0, 1}
    assert abs(sum(mass[k] * v for k, v in up.items()) - 0.37 * sum(mass.values())) <= 25.01


def test_pivotal_matches_a_plain_loop(spark):
    import struct

    import xxhash

    def draw(key, level):
        h = 42
        for v, fmt in ((mixing.SEED, "<i"), (level, "<i"), (key, "<q")):
            h = xxhash.xxh64_intdigest(struct.pack(fmt, v), h)
        return (h >> 11) * 2.0 ** -53

    items = [(k, float(5 + 3 * k % 7), 0.3 + 0.05 * (k % 3)) for k in range(12)]
    df = spark.createDataFrame([(items,)], "items array<struct<key: long, mass: double, p: double>>")
    got = df.select(mixing._pivotal(F.col("items"), 1).alias("x")).first().x
    (ok, om, op), want = items[0], {}
    for k, m, p in items[1:]:
        ratio = om / m
        up, down = min(1 - op, p / ratio), min(op, (1 - p) / ratio)
        rises = draw(k, 1) * (up + down) < down
        no, nk = (op + up, p - up * ratio) if rises else (op - down, p + down * ratio)
        if (up == 1 - op) if rises else (down == op):
            want[ok] = 1.0 if rises else 0.0
            ok, om, op = k, m, nk
        else:
            want[k] = 0.0 if rises else 1.0
            op = no
    assert {r.key: r.p for r in got[:-1]} == want and (got[-1].key, got[-1].p) == (ok, pytest.approx(op))


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None)], [(None, "", "en", "s", 0)], [(1, "a b", "en", "s", 0)] * 2])
def test_degenerate_tables(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    out = mixing.copies(docs).collect()
    assert sum(r.n_rows for r in out) == len(rows)
    assert mixing.mixed(docs).count() == len(rows)  # a lone source is taken once


def test_mixed_keeps_columns_and_repeats_rows(spark):
    docs = corpus(spark).withColumn("copies", F.lit("mine")).withColumn("size", F.lit(1)).withColumn("key", F.lit(2))
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    want = {r.key.doc_id: r.copies * r.n_rows for r in mixing.copies(docs).collect() if r.copies}
    got = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert got == want

import duckdb
import sentencepiece
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from cinderwell.llm import mixing, pieces, quality, registry, simhash
from tests.llm.helpers import documents, write_table

SMOKE = "/root/testdata/sf0.001"


def test_stages_apply_to_what_was_kept(spark, tmp_path):
    # ids of their own: with repeated ones, groups that are not linked may share a component_id
    docs = documents(spark, 60).withColumn("doc_id", F.monotonically_increasing_id())
    docs = spark.createDataFrame(docs.collect(), docs.schema).persist()
    d = write_table(spark, tmp_path, "documents", docs)
    now, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, d)
        assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
    after = {n: spark.read.parquet(str(tmp_path / n)) for n, _ in corpus_pipeline.STAGES[:-1]}
    kept = [r.row.text for r in quality.score(docs).where("kept").collect()]
    assert sorted(r.text for r in after["quality_rules"].collect()) == sorted(kept)
    marked = simhash.near_duplicates(after["quality_rules"]).collect()
    assert after["simhash_near_dedup"].count() == len({r.component_id for r in marked})
    assert {r.doc_id for r in after["simhash_near_dedup"].collect()} == {r.component_id for r in marked}
    assert after["source_mix"].count() == sum(r.copies * r.n_rows for r in mixing.copies(after["simhash_near_dedup"]).collect())
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    want = sorted((r.doc_id, str(r.source), r.lang, tuple(sp.encode(r.text or "")), sp.decode(sp.encode(r.text or ""))) for r in after["source_mix"].collect())
    assert sorted((r.doc_id, str(r.source), r.lang, tuple(r.ids), r.decoded) for r in corpus_pipeline.run(spark, d).collect()) == want


def test_registered_queries_and_their_sql(spark):
    assert set(registry.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert {n for n in registry.QUERIES} == {q for q in entry.queries() if q.startswith("op")}
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMOKE}/{t}.parquet')")
    for name, sql in registry.SQL.items():
        got = registry.QUERIES[name](spark, SMOKE)
        want = con.execute(sql)
        columns = [c[0] for c in want.description]
        assert sorted(columns) == sorted(got.columns)
        rounded = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
        assert sorted(map(str, map(rounded, got.select(*columns).collect()))) == sorted(map(str, map(rounded, want.fetchall()))), name

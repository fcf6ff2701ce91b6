"""Token counts as delta-maintained rollups.

A batch of changes (documents counted, counted anew or deleted) becomes signed
rows: what the batch takes back of the state before it (-1) and what it adds
(+1); rows that cancel go. The signed rows go to a ledger, their sums by
tokenizer version, source and language to a rollup, each in a folder of the
batch. Totals are sums of the rollups, so reading them costs a row a group and
batch, whatever the corpus.

Batches have ascending numbers. A batch is committed when its rollup is
complete (Spark's ``_SUCCESS``); until then a rerun overwrites what an attempt
has left, afterwards applying the same number again changes nothing. The state
before batch b is the ledger of the committed batches below b.

One document has one count for each tokenizer version. Within a batch, an
upsert outweighs a delete of the same document and version, and of several
upserts the largest counts, so repeated rows change nothing. Deleting what is
not there changes nothing. A null doc_id is an id like others; null source or
language are groups of their own; a null text has no tokens. Empty batches are
committed too.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderwell.llm.arrowfiles import _filesystem
from cinderwell.llm.common import or_empty, shared_folder, small_batches, table
from cinderwell.session import stable_checkpoint

#: tokenizer versions that the query counts with
VERSIONS = ("byte_bpe_50k", "byte_bpe_multi_50k")
GROUP = ["version", "source", "lang"]
KEY = ["doc_id", "version"]
ENTRY = ["doc_id", "version", "source", "lang", "n_tokens", "n_chars"]
_LEDGER = "doc_id long, version string, source string, lang string, n_tokens long, n_chars long, sign long, batch long"
_ROLLUP = "version string, source string, lang string, n_docs long, n_tokens long, n_chars long, batch long"


@functools.lru_cache(maxsize=4)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, path: str, pattern: str) -> Column:
    """Tokens of a text, special tokens' strings taken as text."""

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        encode = _encoding(path, pattern).encode_ordinary
        return pa.array(np.fromiter((len(encode(t)) for t in texts.to_pylist()), np.int64, len(texts)))

    return count(or_empty(text))


def counted(docs: DataFrame, versions: tuple = VERSIONS) -> DataFrame:
    """Upserts (op, doc_id, version, source, lang, n_tokens, n_chars) of all
    documents under each tokenizer version."""
    import public_tokenizers as public

    docs = small_batches(docs)
    text = docs["text"]
    each = [F.struct(F.lit(v).alias("version"), token_count(text, public.path(f"{v}.tiktoken"), public.PATTERN).alias("n_tokens")) for v in versions]
    out = docs.select(F.lit("upsert").alias("op"), docs["doc_id"].cast("long").alias("doc_id"), docs["source"].alias("source"), docs["lang"].alias("lang"),
                      F.length(or_empty(text)).cast("long").alias("n_chars"), F.array(*each).alias("each"))
    return out.select("op", "doc_id", "source", "lang", "n_chars", F.inline("each"))


def deletes(ids: DataFrame, versions: tuple = VERSIONS) -> DataFrame:
    """Deletes of the documents in column ``doc_id`` under all versions."""
    none = lambda kind: F.lit(None).cast(kind)
    return ids.select(F.lit("delete").alias("op"), F.col("doc_id").cast("long").alias("doc_id"), none("string").alias("source"), none("string").alias("lang"),
                      none("long").alias("n_chars"), F.explode(F.array(*[F.lit(v) for v in versions])).alias("version"), none("long").alias("n_tokens"))


class Rollup:
    """Totals kept in ``folder``, which driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def committed(self) -> list[int]:
        fs, base = _filesystem(f"{self.folder}/rollup")
        found = fs.get_file_info(pafs.FileSelector(base, allow_not_found=True, recursive=True))
        return sorted(int(f.path.split("/")[-2].removeprefix("batch=")) for f in found if f.base_name == "_SUCCESS")

    def _read(self, what: str, schema: str, batches: list[int]) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/{what}") \
            .parquet(*[f"{self.folder}/{what}/batch={b}" for b in batches])

    def state(self, before: int | None = None) -> DataFrame:
        """The counts in force, those of committed batches below ``before``."""
        batches = [b for b in self.committed() if before is None or b < before]
        return self._read("ledger", _LEDGER, batches).groupBy(*ENTRY).agg(F.sum("sign").alias("n")).where("n > 0").select(*ENTRY)

    def totals(self) -> DataFrame:
        """version, source, lang -> documents, tokens, characters; groups that
        have lost all their documents are not listed."""
        sums = [F.sum(c).alias(c) for c in ("n_docs", "n_tokens", "n_chars")]
        return self._read("rollup", _ROLLUP, self.committed()).groupBy(*GROUP).agg(*sums).where("n_docs <> 0")

    def apply(self, batch: int, changes: DataFrame) -> bool:
        """Commit a batch of changes; False if that number is committed already."""
        if batch in self.committed():
            return False
        new = F.struct((F.col("op") == "upsert").alias("upsert"), "n_tokens", "n_chars", "source", "lang")
        # counting is the dear part: the changes are computed once
        last = stable_checkpoint(changes.groupBy(*KEY).agg(F.max(new).alias("new")))
        before = self.state(batch)
        known = (before["doc_id"].eqNullSafe(last["doc_id"])) & (before["version"].eqNullSafe(last["version"]))
        taken = before.join(last.select(*KEY), known, "left_semi").select(*ENTRY, F.lit(-1).cast("long").alias("sign"))
        added = last.where("new.upsert").select(*KEY, "new.source", "new.lang", "new.n_tokens", "new.n_chars") \
            .select(*ENTRY, F.lit(1).cast("long").alias("sign"))
        signed = taken.unionByName(added).groupBy(*ENTRY).agg(F.sum("sign").alias("sign")).where("sign <> 0")
        signed.write.mode("overwrite").parquet(f"{self.folder}/ledger/batch={batch}")
        rows = self._read("ledger", _LEDGER, [batch])
        rows.groupBy(*GROUP).agg(F.sum("sign").alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).alias("n_tokens"),
                                 F.sum(F.col("sign") * F.col("n_chars")).alias("n_chars")) \
            .write.mode("overwrite").parquet(f"{self.folder}/rollup/batch={batch}")
        return True


def later_copies(docs: DataFrame) -> DataFrame:
    """doc_ids of documents whose text a smaller doc_id has already."""
    hashed = docs.select("doc_id", F.sha2(or_empty(F.col("text")), 256).alias("h"))
    first = hashed.groupBy("h").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    return hashed.join(first, "h").where("doc_id > first").select("doc_id").distinct()


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """The documents that say some line twice, with each line said once."""
    lines = F.split(or_empty(F.col("text")), "\n")
    once = F.array_distinct(lines)
    return docs.where(F.size(once) < F.size(lines)).withColumn("text", F.array_join(once, "\n"))


def op8_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after three batches: all documents counted; later copies of a
    text deleted; documents with repeated lines, if they are still there,
    counted anew without the repetitions. The second batch comes twice."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    rollup = Rollup(spark, shared_folder(spark, "token-rollup"))
    rollup.apply(1, counted(docs))
    copies = stable_checkpoint(later_copies(docs))
    rollup.apply(2, deletes(copies))
    rollup.apply(2, deletes(copies))
    rollup.apply(3, counted(without_repeated_lines(docs).join(copies, "doc_id", "left_anti")))
    return rollup.totals()

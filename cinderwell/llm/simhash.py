"""SimHash near-duplicates with pigeonhole blocks.

A document's fingerprint has one bit for each bit of a 64-bit hash, set if
more than half of the hashes of its word shingles have it set. Two documents
are linked if their fingerprints differ in at most three bits.

Search: the 64 bits are cut into six blocks. Two fingerprints at most three
bits apart agree on at least three whole blocks, so each distinct fingerprint
goes under its 20 choices of three blocks (about 32 bits a key), equal keys
meet in one partition, and every candidate is verified by its Hamming
distance. Equal fingerprints are one item from the start, so exact copies cost
nothing. Within a key, only a spanning forest of the links is returned, not
all pairs. A key with more than ``CHUNK`` fingerprints is not worked on where
it is met: its members are written out, split into chunks, and each pair of
chunks is a group of its own, so that no task holds more than two chunks and
no link is lost.

Components: alternating large-star and small-star steps on the links, each
step a join and an aggregate, checkpointed in the shared folder.

Null text has no words, like the empty text: fingerprint zero, linked like any
other. Rows with a null doc_id get a fingerprint; they lend their links to the
others but no number, and where a component has no other number its id is
null. Repeated rows all stay in the result, with the same component. An empty
table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderwell.llm.common import or_empty, packed, small_batches, table, unpacked
from cinderwell.session import stable_checkpoint

SHINGLE = 3
MAX_BITS = 3
SEED = 42
BLOCKS = 6
CHUNK = 4096
SALTS = 8


# ------------------------------------------------------------ fingerprints
def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of a UTF-8 text. ``bytes`` methods fold only
    A-Z and split only at the six ASCII white-space characters."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        digests = xxhash.xxh64_digest(joined, seed)
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = (ends - [len(w) + 1 for w in words])[: len(words) - shingle + 1].tolist()
        digest = xxhash.xxh64_digest
        digests = b"".join([digest(joined[a:b], seed) for a, b in zip(starts, (ends[shingle - 1:] - 1).tolist())])
    bits = np.unpackbits(np.frombuffer(digests, np.uint8)).reshape(-1, 64)
    most = 2 * bits.sum(axis=0, dtype=np.int64) > len(bits)
    return int.from_bytes(np.packbits(most).tobytes(), "big")


def fingerprint_column(text: Column, shingle: int = SHINGLE, seed: int = SEED) -> Column:
    """The fingerprint as a signed long."""

    @F.arrow_udf("long")
    def simhash(texts: pa.Array) -> pa.Array:
        out = np.fromiter((fingerprint(x.as_buffer().to_pybytes(), shingle, seed) for x in texts), np.uint64, len(texts))
        return pa.array(out.view(np.int64))

    return simhash(or_empty(text))


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# ------------------------------------------------------------ links
def _masks(blocks: int, agree: int) -> list[int]:
    """Signed 64-bit masks, one for each choice of ``agree`` of the blocks."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    block = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    masks = [sum(x) for x in combinations(block, agree)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _forest(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """(smallest member, other member) for each component of the links among
    these distinct fingerprints."""
    if len(fps) == 2:
        a, b = sorted(fps.tolist())
        return [(a, b)] if ((a ^ b) & 0xFFFFFFFFFFFFFFFF).bit_count() <= max_bits else []
    left, out = np.sort(fps), []
    while len(left):
        root, left = left[0], left[1:]
        front = [root]
        while front and len(left):
            near = np.bitwise_count((left ^ front.pop()).view(np.uint64)) <= max_bits
            if near.any():
                found, left = left[near], left[~near]
                front.extend(found)
                out.extend((int(root), int(x)) for x in found)
    return out


def _runs(batches, names: list[str]):
    """Batches sorted by ``names``: (key, array of fp) of each run of a key; at
    most one run and one batch are held."""
    key, parts = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
        fps = batch.column("fp").to_numpy(zero_copy_only=False)
        change = np.zeros(len(fps), bool)
        change[0] = True
        for k in keys:
            change[1:] |= k[1:] != k[:-1]
        at = np.flatnonzero(change).tolist() + [len(fps)]
        for a, b in zip(at, at[1:]):
            this = tuple(int(k[a]) for k in keys)
            if this != key:
                if key is not None:
                    yield key, parts
                key, parts = this, []
            parts.append(fps[a:b])
    if key is not None:
        yield key, parts


_LINKS = "a long, b long, c int, m long"
_SCHEMA = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("c", pa.int32()), ("m", pa.int64())])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows) if rows else [[]] * 4, _SCHEMA)], schema=_SCHEMA)


def links(fps: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS, chunk: int = CHUNK) -> DataFrame:
    """Distinct ``fp`` (long) -> links (a, b) whose components are those of all
    pairs at most ``max_bits`` apart."""
    masks = _masks(blocks, blocks - max_bits)
    keyed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("c", "m"))

    def near(batches):
        """Links of the small keys; the members of a large key go on as they are."""
        rows: list[tuple] = []
        for (c, m), parts in _runs(batches, ["c", "m"]):
            n = sum(map(len, parts))
            if n > chunk:
                rows.extend((int(x), None, c, m) for p in parts for x in p)
            elif n > 1:
                rows.extend((a, b, c, m) for a, b in _forest(np.concatenate(parts), max_bits))
            if len(rows) >= 10_000:
                yield _rows(rows)
                rows = []
        yield _rows(rows)

    found = keyed.repartition("c", "m").sortWithinPartitions("c", "m").mapInArrow(near, _LINKS)
    found = stable_checkpoint(found)
    large = found.where("b is null").select(F.col("a").alias("fp"), "c", "m")
    # each member meets its own chunk and every other chunk of its key once
    sizes = large.groupBy("c", "m").agg(F.ceil(F.count("*") / chunk).cast("int").alias("n"))
    own = F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")
    split = large.join(sizes, ["c", "m"]).select("fp", "c", "m", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
    split = split.select("fp", "c", "m", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def near_chunks(batches):
        for (c, m, _, _), parts in _runs(batches, ["c", "m", "i", "j"]):
            yield _rows([(a, b, c, m) for a, b in _forest(np.concatenate(parts), max_bits)])

    more = split.repartition("c", "m", "i", "j").sortWithinPartitions("c", "m", "i", "j").mapInArrow(near_chunks, _LINKS)
    return found.where("b is not null").select("a", "b").union(more.select("a", "b")).distinct()


# ------------------------------------------------------------ components
def components(edges: DataFrame) -> DataFrame:
    """Links (a, b) of longs -> (node, root): the smallest node of each node's
    component; nodes without a link are not listed.

    Large-star hangs the larger neighbours of a node on its smallest neighbour,
    small-star the smaller ones; repeated until nothing changes, which takes
    about log n rounds and leaves stars around the roots. A hub's neighbours
    are spread over ``SALTS`` partitions.
    """
    def minima(pairs: DataFrame) -> DataFrame:
        least = pairs.groupBy("u").agg(F.min("v").alias("low"))
        return least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))

    def starred(pairs: DataFrame) -> DataFrame:
        salted = pairs.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
        return salted.join(minima(pairs), ["u", "salt"])

    def signature(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = stable_checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = signature(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = starred(both).where("v > u").select(F.col("v").alias("u"), F.least("low", "u").alias("v")).distinct()
        small = starred(large)
        now = stable_checkpoint(
            small.where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
            .unionByName(small.select("u", F.col("low").alias("v"))).distinct())
        before, seen = seen, signature(now)
        if seen == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def groups(marked: DataFrame, member: str, max_bits: int = MAX_BITS, blocks: int = BLOCKS, chunk: int = CHUNK) -> DataFrame:
    """Rows with ``fp`` and an orderable column ``member`` -> (fp, component):
    for each distinct fingerprint the smallest member of its component."""
    fps = stable_checkpoint(marked.groupBy("fp").agg(F.min(member).alias("low")))
    roots = components(links(fps.select("fp"), max_bits, blocks, chunk))
    linked = fps.join(roots, fps.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = linked.groupBy("root").agg(F.min("low").alias("component"))
    # written once more: with an exchange on either side a join on a hot
    # fingerprint can be split
    return stable_checkpoint(linked.join(lowest, "root").select("fp", "component"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """(doc_id, fp, component_id) for every row."""
    docs = small_batches(docs)
    marked = stable_checkpoint(docs.select(docs[f"`{doc_id}`"].alias("doc_id"), fingerprint_column(docs[f"`{text}`"]).alias("fp")))
    return marked.join(groups(marked, "doc_id", **how).withColumnRenamed("component", "component_id"), "fp", "left") \
        .select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row of each group of near-duplicates, the one with the smallest
    doc_id (null last; then the smallest text hash), all columns as they were.
    The texts are hashed where they lie and moved once, for the final join."""
    docs = small_batches(docs)
    key = F.struct(docs[f"`{doc_id}`"].isNull().alias("none"), docs[f"`{doc_id}`"].alias("id"),
                   F.xxhash64(docs[f"`{text}`"]).alias("h"))
    marked = stable_checkpoint(docs.select(key.alias("key"), fingerprint_column(docs[f"`{text}`"]).alias("fp")))
    first = groups(marked, "key", **how).select(F.col("component").alias("key")).distinct()
    rows = packed(docs, key.alias("key"))
    on = (rows.key["id"].eqNullSafe(first.key["id"])) & (rows.key["h"] == first.key["h"])
    kept = rows.join(first.select("key"), on, "left_semi")
    return unpacked(kept.dropDuplicates(["key"]), docs.columns)


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", as_hex(F.col("fp")).alias("fingerprint"), "component_id")

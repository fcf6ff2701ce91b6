"""Importance resampling towards a target distribution.

A document's features are its runs of one to three consecutive words, hashed
into ``BUCKETS`` buckets. How much likelier a bucket is in the target texts
than in the corpus is its gain; a document's weight is the sum of the gains of
its features. Weights plus Gumbel noise, seeded by doc_id, order the documents;
the first ``PERCENT`` in a hundred of those with ``MIN_WORDS`` words or more are
a draw without replacement in proportion to exp(weight).

The corpus counts come from segments. Newlines cut texts into lines and no word
spans a newline, so a feature lies within a line or crosses line ends. Equal
lines are gathered with map-side partial counts (a line that every document
holds moves as one row a task), the features of each distinct line are counted
once and multiplied by its occurrences. Features across line ends are counted
from the documents, which needs the hashes of the few words around the ends
only. Both sums are exact; nothing is sampled.

Weights are read off in a second scan of the documents against the 10,000
gains, the only data that goes to all tasks. The draw sorts slim rows (no
texts) by range of score and numbers them by the offsets of the ranges, one
number a range at the driver.

Words are found and hashed as bytes: in UTF-8 every byte of a non-ASCII
character is a word byte. CRCs of words are computed side by side, and those of
runs by combining: crc(ab) is crc(a) moved over len(b) zero bytes, xor crc(b).

Null and empty texts have no features and weight 0, and are never drawn. A null
doc_id is hashed as the empty text and comes after the others. Equal scores go
to the smaller doc_id; repeated rows each have a rank. Texts are
scanned whole, about ``PIECE`` bytes of short ones at a time; a very long text
holds some tens of bytes a word meanwhile. An empty
corpus, or empty target texts, give gains from the added ones alone. Columns
other than the two named are not read, so their names cannot clash.
"""

from __future__ import annotations

import functools
import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderwell.llm.common import or_empty, shuffle_partitions, table
from cinderwell.session import written_table

BUCKETS = 10_000
MIN_WORDS, PERCENT, SEED = 20, 5, 42
#: bytes of text whose working arrays are held at a time
PIECE = 1 << 20
#: longer words and gaps are left to the library's own CRC
LONGEST = 64
SPACE_CRC = np.uint32(zlib.crc32(b" "))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


@functools.lru_cache(maxsize=1)
def _crc_tables() -> tuple[np.ndarray, np.ndarray]:
    """The byte table of CRC-32 and, for each length up to LONGEST, four tables
    that move a CRC over so many zero bytes."""
    byte = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        byte = np.where(byte & 1, (byte >> 1) ^ np.uint32(0xEDB88320), byte >> 1).astype(np.uint32)
    shift = np.empty((LONGEST + 1, 4, 256), np.uint32)
    shift[0] = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(LONGEST):
        shift[n + 1] = byte[shift[n] & 255] ^ (shift[n] >> 8)
    return byte, shift


def _moved(crc: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    shift = _crc_tables()[1]
    return shift[n, 0, crc & 255] ^ shift[n, 1, crc >> 8 & 255] ^ shift[n, 2, crc >> 16 & 255] ^ shift[n, 3, crc >> 24]


class Words:
    """Words of texts that lie one behind the other in ``data``; text k ends
    before ``ends[k]``."""

    def __init__(self, data: np.ndarray, ends: np.ndarray):
        self.data = data
        starts, stops = [], []
        bounds = np.concatenate([[0], ends])
        for a in range(0, len(data), PIECE):
            b = min(a + PIECE, len(data))
            is_word = _IS_WORD[data[max(a - 1, 0):b + 1]]  # with a neighbour on either side
            here = is_word[a - max(a - 1, 0):][:b - a]
            before = np.concatenate([[False], here[:-1]]) if a == 0 else is_word[:b - a].copy()
            after = np.concatenate([is_word[a - max(a - 1, 0) + 1:], [False]])[:b - a]
            cut = bounds[(bounds >= a) & (bounds <= b)] - a
            before[cut[cut < b - a]] = False
            after[cut[cut > 0] - 1] = False
            starts.append(np.flatnonzero(here & ~before) + a)
            stops.append(np.flatnonzero(here & ~after) + a + 1)
        self.start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        self.length = (np.concatenate(stops) if stops else np.zeros(0, np.int64)) - self.start
        self.text = np.searchsorted(ends, self.start, side="right")

    def lines(self) -> np.ndarray:
        """The number of line ends before each word."""
        return np.searchsorted(np.flatnonzero(self.data == 10), self.start)

    def _long(self, k: int, crc: int = 0) -> int:
        return zlib.crc32(_LOWER[self.data[self.start[k]:self.start[k] + self.length[k]]].tobytes(), crc)

    def crc(self, at: np.ndarray) -> np.ndarray:
        """Of the words numbered ``at``."""
        byte = _crc_tables()[0]
        order = at[np.argsort(-np.minimum(self.length[at], LONGEST + 1), kind="stable")]
        start, n = self.start[order], self.length[order]
        crc = np.full(len(order), 0xFFFFFFFF, np.uint32)
        first = int(np.searchsorted(-n, -LONGEST))  # longer ones come first
        for k in range(int(n[first]) if first < len(n) else 0):
            last = int(np.searchsorted(-n, -k))  # these have more than k bytes
            part = crc[first:last]
            crc[first:last] = byte[(part ^ _LOWER[self.data[start[first:last] + k]]) & 255] ^ (part >> 8)
        crc = ~crc
        for j in range(first):
            crc[j] = self._long(order[j])
        out = np.empty(len(self.start), np.uint32)
        out[order] = crc
        return out

    def extended(self, crc: np.ndarray, at: np.ndarray, own: np.ndarray) -> np.ndarray:
        """CRC of runs with CRC ``crc``, a space and word ``at``."""
        spaced = _moved(crc, 1) ^ SPACE_CRC
        n = self.length[at]
        out = _moved(spaced, np.minimum(n, LONGEST)) ^ own[at]
        for j in np.flatnonzero(n > LONGEST):
            out[j] = self._long(at[j], int(spaced[j]))
        return out


def features(words: Words, across: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every run of one to three words in a text; ``across``:
    of those alone that cross a line end."""
    n = len(words.start)
    every = np.arange(n)
    pair = every[:-1][words.text[:-1] == words.text[1:]] if n else every
    triple = every[:-2][words.text[:-2] == words.text[2:]] if n > 1 else every[:0]
    if across:
        line = words.lines()
        pair, triple = pair[line[pair] != line[pair + 1]], triple[line[triple] != line[triple + 2]]
        single = every[:0]
        needed = np.unique(np.concatenate([pair, pair + 1, triple, triple + 1, triple + 2]))
    else:
        single = needed = every
    own = words.crc(needed)
    two = words.extended(own[pair], pair + 1, own)
    # the first two words of a triple are a pair of its own, which may lie in one line
    three = words.extended(words.extended(own[triple], triple + 1, own) if across else _at(two, pair, triple), triple + 2, own)
    crcs = np.concatenate([own[single], two, three])
    return words.text[np.concatenate([single, pair, triple])], crcs % np.uint32(BUCKETS)


def _at(values: np.ndarray, keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    return values[np.searchsorted(keys, wanted)]


def _slices(texts: pa.Array):
    """(first row, bytes, ends) of runs of texts of about PIECE bytes."""
    if pa.types.is_large_string(texts.type):
        kind = np.int64
    else:
        texts, kind = texts.cast(pa.string()), np.int32
    _, offsets, data = texts.buffers()
    if not len(texts):
        return
    at = np.frombuffer(offsets, kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(at, at[a] + PIECE, side="right")) - 1)
        yield a, whole[at[a]:at[b]], at[a + 1:b + 1] - at[a]
        a = b


def _bucket_rows(total: np.ndarray):
    used = np.flatnonzero(total)
    return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], ["bucket", "n"])


def _line_counts(batches):
    """(line, n): the buckets of each line's features, n times."""
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        times = batch.column("n").to_numpy()
        for first, data, ends in _slices(batch.column("line")):
            text, bucket = features(Words(data, ends))
            np.add.at(total, bucket, times[first + text])
    yield _bucket_rows(total)


def _across_counts(batches):
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for _, data, ends in _slices(batch.column("text")):
            total += np.bincount(features(Words(data, ends), across=True)[1], minlength=BUCKETS)
    yield _bucket_rows(total)


def bucket_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """(bucket, n): how often the features of all texts fall in each bucket;
    buckets without any are left out."""
    whole = texts.select(or_empty(texts[f"`{text}`"]).alias("text"))
    lines = whole.select(F.explode(F.split("text", "\n", -1)).alias("line")).groupBy("line").agg(F.count("*").alias("n"))
    within = lines.mapInArrow(_line_counts, "bucket int, n long")
    crossing = whole.where(F.instr("text", "\n") > 0).mapInArrow(_across_counts, "bucket int, n long")
    return within.unionByName(crossing).groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame) -> np.ndarray:
    """The gain of each bucket from its counts in both. BUCKETS rows a side
    come to the driver at most."""
    s, t = (np.zeros(BUCKETS) for _ in range(2))
    for counts, out in ((corpus, s), (target, t)):
        for row in counts.collect():
            out[row["bucket"]] = row["n"]
    ratio = (t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each document."""
    def each(batches):
        for batch in batches:
            sums = np.zeros((3, batch.num_rows), np.int64)
            for first, data, ends in _slices(batch.column("text")):
                words = Words(data, ends)
                of, bucket = features(words)
                n = len(ends)
                part = sums[:, first:first + n]
                part[0] = np.bincount(words.text, minlength=n)
                part[1] = np.bincount(of, minlength=n)
                # sums of whole numbers far below 2^53
                part[2] = np.bincount(of, gain[bucket], minlength=n)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, sums)], ["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(docs[f"`{doc_id}`"].cast("long").alias("doc_id"), or_empty(docs[f"`{text}`"]).alias("text"))
    return rows.mapInArrow(each, "doc_id long, n_words long, n_features long, weight long")


def with_score(weighted: DataFrame, seed: int = SEED) -> DataFrame:
    """Adds ``score``: the weight plus a thousand times a standard Gumbel
    value that depends on the seed and the doc_id alone."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    return weighted.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long"))


def drawn(scored: DataFrame, eligible, percent: int = PERCENT, parts: int | None = None) -> DataFrame:
    """Adds ``rank`` (1 is the highest score, ties to the smaller doc_id) to the
    first floor(percent * N / 100) of the N eligible rows; null for the others.

    The rows are range-partitioned in that order and written once; a row's
    place is that of its range plus its own in the range."""
    order = [F.col("out"), F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    flagged = scored.withColumn("out", ~F.coalesce(eligible, F.lit(False)))
    # the tie breaker spreads rows that are equal in all the rest
    spread = flagged.withColumn("spread", F.monotonically_increasing_id())
    parts = parts or shuffle_partitions(scored.sparkSession)
    frozen = written_table(spread, "scored")
    ranged = frozen.repartitionByRange(parts, *order, "spread").sortWithinPartitions(*order, "spread")
    placed = written_table(ranged.withColumn("place", F.monotonically_increasing_id()), "placed")
    part, within = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = {r["part"]: r for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.count_if(~F.col("out")).alias("ok")).collect()}
    taken = sum(r["ok"] for r in sizes.values()) * percent // 100
    # rows before each range: one number a range
    before = [0, *accumulate(sizes[i]["n"] if i in sizes else 0 for i in range(max(sizes, default=0)))]
    offset = F.element_at(F.array(*[F.lit(n).cast("long") for n in before]), part.cast("int") + 1)
    rank = offset + within + 1
    return placed.select(*scored.columns, F.when(~F.col("out") & (rank <= taken), rank).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text",
             min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every document."""
    gain = gains(bucket_counts(docs, text), bucket_counts(target, target_text))
    return drawn(with_score(weights(docs, gain, doc_id, text), seed), F.col("n_words") >= min_words, percent)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")) \
        .select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 bit by bit, over the distinct features
OP11_SQL = r"""
WITH texts AS (
  SELECT doc_id AS id, 0 AS side, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT NULL, 1, coalesce(text, '') FROM benchmark),
cut AS (
  SELECT row_number() OVER () AS k, id, side,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM texts),
runs AS (
  SELECT k, side, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])
                           || list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS f FROM cut),
counted AS (SELECT k, side, f, count(*) AS n FROM runs GROUP BY ALL),
bits AS (
  SELECT f, list_concat([4294967295::UBIGINT], flatten(list_transform(range(0, octet_length(encode(f))),
    lambda b: list_transform(range(0, 8), lambda i: (get_bit(encode(f)::BIT, (8 * b + 7 - i)::INTEGER))::UBIGINT)))) AS bits
  FROM (SELECT DISTINCT f FROM counted)),
hashed AS (
  SELECT f, xor(list_reduce(bits, lambda c, b: xor(c >> 1, 3988292384::UBIGINT * (xor(c, b) & 1))), 4294967295::UBIGINT) % 10000 AS bucket FROM bits),
cells AS (SELECT k, side, bucket, sum(n) AS n FROM counted JOIN hashed USING (f) GROUP BY ALL),
sums AS (SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 1), 0)::DOUBLE AS t FROM cells GROUP BY bucket),
whole AS (SELECT coalesce(sum(s), 0) AS s, coalesce(sum(t), 0) AS t FROM sums),
gain AS (SELECT bucket, floor(1000 * ln((sums.t + 1) * (whole.s + 10000) / ((sums.s + 1) * (whole.t + 10000))))::BIGINT AS gain FROM sums, whole),
weight AS (SELECT k, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM cells JOIN gain USING (bucket) WHERE side = 0 GROUP BY k),
scored AS (
  SELECT cut.id AS doc_id, len(w) >= 20 AS ok, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('42:' || coalesce(cut.id::VARCHAR, '')), 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM cut LEFT JOIN weight USING (k) WHERE cut.side = 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY ok ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) FILTER (ok) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN ok AND place <= 5 * n // 100 THEN place END AS rank FROM placed
"""

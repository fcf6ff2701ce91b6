"""Document fingerprints: quartile bucket digests.

A window of five bytes slides over the UTF-8 text; six triplets of each window
are hashed into 256 buckets. The digest says for each bucket in which quartile
of all buckets its count lies (two bits), after a check byte, the length on a
logarithmic scale and the spread of the quartiles. A few edits shift few
counts across a quartile, so like texts have like digests. ``difference`` of
two digests is bounded: each part adds up to a fixed maximum, and ``likeness``
is one minus its share of the whole maximum.

Texts are digested whole, the empty text and a null one alike. Equal texts
have equal digests.

``with_next`` hands each document to the one before it in doc_id order: ranges
of doc_id are cut at quantiles, the first document of each range is also sent
to the range before, and each sorted range is read through once, so that texts
are moved once and no task holds more than a batch. Null doc_ids come first;
rows with the same doc_id follow in text order, a repeated row being its own
next document. A single row is its own next. An empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderwell.llm.common import or_empty, shuffle_partitions, small_batches, table

WINDOW = 5
#: places in the window of each triplet; the first is the newest byte
TRIPLETS = [(4, 3, 2), (4, 3, 1), (4, 2, 1), (4, 2, 0), (4, 3, 0), (4, 1, 0)]
BUCKETS = 256
#: most that the parts of a digest add to a difference
MAX_LENGTH, MAX_SPREAD, MAX_CHECK, STEP = 24, 24, 1, (0, 1, 2, 6)
MAX_DIFFERENCE = BUCKETS * STEP[3] + MAX_LENGTH + 2 * MAX_SPREAD + MAX_CHECK
PIECE = 1 << 20


def _triplet_buckets(data: np.ndarray, salt: int, places: tuple[int, int, int]) -> np.ndarray:
    """A multiplicative hash of three bytes and a salt; the top byte of 32 bits."""
    n = len(data) - WINDOW + 1
    h = np.full(n, 0x811C9DC5 ^ salt, np.uint32)
    for p in places:
        h = (h ^ data[p:p + n]) * np.uint32(0x01000193)
    h ^= h >> np.uint32(15)
    return (h * np.uint32(0x9E3779B1)) >> np.uint32(24)


def counts(text: bytes) -> np.ndarray:
    """How often each bucket is hit. Texts under five bytes are padded."""
    data = np.frombuffer(text.ljust(WINDOW, b"\0") if text else b"", np.uint8).astype(np.uint32)
    out = np.zeros(BUCKETS, np.int64)
    for a in range(0, max(0, len(data) - WINDOW + 1), PIECE):  # bounded memory for very long texts
        part = data[a:a + PIECE + WINDOW - 1]
        for salt, places in enumerate(TRIPLETS):
            out += np.bincount(_triplet_buckets(part, salt, places), minlength=BUCKETS)
    return out


def digest(text: bytes) -> bytes:
    """check byte, length byte, byte of quartile ratios, 64 bytes of quartiles."""
    n = counts(text)
    q1, q2, q3 = np.sort(n)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    code = (n > q1).astype(np.uint8) + (n > q2) + (n > q3)
    length = min(255, int(np.log(len(text)) * 16)) if text else 0
    spread = (int(q1 * 16 // q3) % 16, int(q2 * 16 // q3) % 16) if q3 else (0, 0)
    packed = code.reshape(-1, 4)
    body = packed[:, 0] << 6 | packed[:, 1] << 4 | packed[:, 2] << 2 | packed[:, 3]
    check = hashlib.blake2b(text, digest_size=1).digest()
    return check + bytes([length, spread[0] << 4 | spread[1]]) + body.astype(np.uint8).tobytes()


_STEP = np.array(STEP)


def _codes(d: bytes) -> np.ndarray:
    x = np.frombuffer(d, np.uint8, offset=3)
    return np.stack([x >> 6, x >> 4 & 3, x >> 2 & 3, x & 3]).astype(np.int64)


def difference(a: bytes, b: bytes) -> int:
    """0 for equal digests, at most MAX_DIFFERENCE."""
    if a == b:
        return 0
    around = lambda x, y: min((x - y) % 16, (y - x) % 16)  # noqa: E731  ratios wrap around
    out = int(a[0] != b[0]) + min(MAX_LENGTH, abs(a[1] - b[1]))
    out += sum(min(MAX_SPREAD, 3 * around(a[2] >> s & 15, b[2] >> s & 15)) for s in (0, 4))
    return out + int(_STEP[np.abs(_codes(a) - _codes(b))].sum())


def likeness(a: bytes, b: bytes) -> float:
    return 1.0 - difference(a, b) / MAX_DIFFERENCE


def spliced(text: str, following: str) -> str:
    """The last half of a text (rounded down) replaced by as many first
    characters of the following one, or all it has."""
    n = len(text) // 2
    return text[:len(text) - n] + following[:n]


_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                  ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _read_through(batches):
    """Rows sorted by (part, lent, doc_id, text): each row of a part with the
    next one; the last with the row lent by the next part."""
    rows: list[list] = []

    def out():
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_OUT)], schema=_OUT)

    def pair(doc_id, text, own, following, theirs):
        edited = spliced(text, following).encode()
        changed = digest(edited)
        rows.append([doc_id, len(text), hashlib.sha256(edited).hexdigest(), own.hex(), changed.hex(),
                     likeness(own, changed), likeness(own, theirs)])

    part, held = None, None
    for batch in batches:
        for p, lent, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("part", "lent", "doc_id", "text"))):
            if p != part:
                part, held = p, None
            if lent and held is None:  # the rest of what was lent
                continue
            own = digest(text.encode())
            if held is not None:
                pair(*held, text, own)
            held = None if lent else (doc_id, text, own)
            if len(rows) >= 1000:
                yield out()
                rows = []
    yield out()


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """(part, lent, doc_id, text), partitioned and sorted: all rows by range of
    doc_id (``lent`` false), and in each part the row that comes after it."""
    docs = docs.select(docs[f"`{doc_id}`"].cast("long").alias("doc_id"), or_empty(docs[f"`{text}`"]).alias("text"))
    parts = parts or shuffle_partitions(docs.sparkSession)
    q = docs.agg(F.min("doc_id").alias("low"), F.count_if(F.col("doc_id").isNull()).alias("none"),
                 F.percentile_approx("doc_id", [i / parts for i in range(parts)], 10 * parts).alias("cuts")).first()
    # first doc_id of each range
    cuts = np.array(sorted({q["low"], *q["cuts"]}) if q["cuts"] else [], np.int64)
    first_is_null, last = q["none"] > 0, max(len(cuts) - 1, 0)

    @F.arrow_udf("array<int>")
    def places(ids: pa.Array) -> pa.Array:
        """Own part and, for the first row of a part, the part before; the
        first row of all goes to the last part."""
        none = ids.is_null().to_numpy(zero_copy_only=False)
        x = ids.fill_null(0).to_numpy(zero_copy_only=False)
        own = np.where(none, 0, np.maximum(np.searchsorted(cuts, x, side="right") - 1, 0))
        first = none if first_is_null else np.zeros(len(x), bool)
        if len(cuts):
            starts = (cuts[own] == x) & ~none
            first = first | starts & ((own > 0) | (not first_is_null))
        before = np.where(own > 0, own - 1, last)
        flat = np.column_stack([own, before])[np.column_stack([np.ones(len(x), bool), first])]
        ends = np.cumsum(np.concatenate([[0], 1 + first]))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))

    placed = docs.select("doc_id", "text", F.posexplode(places("doc_id")).alias("lent", "part")) \
        .withColumn("lent", F.col("lent") > 0)
    return placed.repartitionById(last + 1, "part").sortWithinPartitions("part", "lent", "doc_id", "text")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """Digest of each whole text and of its splice with the next document, and
    the likeness of its digest to the splice's and to the next document's."""
    return with_next(small_batches(docs), doc_id, text, parts).mapInArrow(
        _read_through, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))

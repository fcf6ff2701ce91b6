"""Periodic runs of words.

A run is a stretch of words with smallest period q (words q apart are equal)
that no neighbouring word extends and that is at least ``REPEATS`` periods and
``LEAST`` words long. Runs are found with an enhanced suffix array, that is the
suffix array, its inverse and the common-prefix (LCP) array, without a tree:

* LCP intervals are swept with a stack. In an interval of depth d all suffixes
  share d words; its children are cut where the LCP is d exactly.
* Words i.. and i+d.. of the interval in different children make a *branching*
  square, words i to i+2d that cannot be moved one to the right. Every suffix i
  of the smaller children (all but one largest) asks the inverse array whether
  suffix i+d, and whether i-d, lies in the interval. A suffix is in a smaller
  child at most log2(n) times, so the questions are n log n at most.
* The last square of every run branches. Squares are rotated to the left as
  far as they stay squares; those that share a run merge into it. A period's
  multiples give the same stretch, and the smallest one names the run.

Texts are taken in groups of about ``GROUP`` words and their suffixes sorted
together, each text's words numbered apart from the others', so no suffix is
compared across texts. A run of the wanted kind repeats some four words at
least three times; the sorted hashes of a group's word quadruples tell which
texts may have one, and only these are sorted by suffix (equal quadruples have
equal hashes, so none is lost).

A task holds a group of texts; a text beyond ``GROUP`` words is a group of its
own and takes about 300 bytes a word in one task. No text moves between tasks.

Null and empty texts have no words and no runs. Rows stand for themselves, so
repeated rows and ids give equal rows. Ties for the foremost run go to the
smaller start, then the smaller period. An empty table gives an empty result.
Columns other than the two named are not read, so names cannot clash.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderwell.llm.common import or_empty, table

REPEATS, LEAST = 4, 6
GROUP = 100_000
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_QUAD = 4


def words(text: str) -> list[str]:
    return _WORDS.findall(text)


def numbered(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, ends): a number for each word of all texts, equal within a
    text where the words are equal."""
    known: dict[str, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for text in texts for w in text), np.int64)
    return ids, np.cumsum([len(t) for t in texts])


def may_repeat(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of each text, whether some four words occur three times. Hashes decide,
    so a text may be named without cause but none is missed."""
    out = np.zeros(len(ends), bool)
    n = len(ids) - _QUAD + 1
    if n < 3:
        return out
    h = np.zeros(n, np.uint64)
    for k in range(_QUAD):
        h = (h ^ ids[k:k + n].astype(np.uint64) + np.uint64(k + 1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    text = np.searchsorted(ends, np.arange(n), side="right")
    inside = np.arange(n) + _QUAD <= ends[text]
    keys = np.sort(text[inside].astype(np.uint64) << np.uint64(40) | h[inside] >> np.uint64(24))
    if len(keys) > 2:
        out[(keys[2:][keys[2:] == keys[:-2]] >> np.uint64(40)).astype(np.int64)] = True
    return out


def suffixes(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, place, common): suffix array, its inverse and the number of
    words that each suffix shares with the one before. Suffixes end with their
    text and sort by text first. Ranks by 1, 2, 4, ... words are kept, and the
    shared words are read off them."""
    n = len(ids)
    text = np.searchsorted(ends, np.arange(n), side="right")
    rest = ends[text] - np.arange(n)
    _, rank = np.unique(text * (int(ids.max(initial=0)) + 1) + ids, return_inverse=True)
    levels, step = [rank.astype(np.int32)], 1
    while int(rank.max(initial=0)) + 1 < n:
        after = np.zeros(n, np.int64)
        after[:max(n - step, 0)] = rank[step:] + 1
        after[rest <= step] = 0
        _, rank = np.unique(rank * (n + 1) + after, return_inverse=True)
        levels.append(rank.astype(np.int32))
        step *= 2
    order = np.argsort(rank)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(n, np.int64)
    live = np.arange(1, n)
    for k in range(len(levels) - 1, -1, -1):
        i, j = a + common[1:], b + common[1:]
        fits = (rest[a] - common[1:] >= 1 << k) & (rest[b] - common[1:] >= 1 << k)
        same = np.zeros(n - 1 if n else 0, bool)
        same[fits] = levels[k][i[fits]] == levels[k][j[fits]]
        common[live[same]] += 1 << k
    return order, place, common


def intervals(common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """LCP intervals of depth 1 and more as (low, high, depth), high excluded,
    and of each place in the array the interval whose children it parts (-1)."""
    low, high, depth = [0], [len(common)], [0]
    open_, owner = [0], np.full(len(common), -1, np.int64)
    parts = []
    for j, d in enumerate(common.tolist()):
        left = j - 1
        while d < depth[open_[-1]]:
            done = open_.pop()
            high[done] = j
            left = low[done]
        if d > depth[open_[-1]]:
            open_.append(len(low))
            low.append(left)
            high.append(len(common))
            depth.append(d)
        parts.append(open_[-1])
    owner[:] = parts
    owner[owner == 0] = -1
    return np.array(low), np.array(high), np.array(depth), owner


def branching_squares(order: np.ndarray, place: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of the squares that cannot be moved one to the right."""
    low, high, depth, owner = intervals(common)
    cut = np.flatnonzero(owner > 0)
    by = np.argsort(owner[cut], kind="stable")
    cut, own = cut[by], owner[cut[by]]
    # children: from the interval's low, or a cut, to the next cut or its high
    first = np.concatenate([[True], own[1:] != own[:-1]]) if len(own) else np.zeros(0, bool)
    of = np.concatenate([own[first], own])
    begin = np.concatenate([low[own[first]], cut])
    by = np.lexsort((begin, of))
    of, begin = of[by], begin[by]
    end = np.where(np.concatenate([of[1:] != of[:-1], [True]]) if len(of) else np.zeros(0, bool), high[of], np.concatenate([begin[1:], [0]]) if len(of) else begin)
    size = end - begin
    by = np.lexsort((-size, of))
    largest = by[np.concatenate([[True], of[by][1:] != of[by][:-1]])] if len(of) else by
    small = np.ones(len(of), bool)
    small[largest] = False
    of, begin, end, size = of[small], begin[small], end[small], size[small]
    starts, periods = [], []
    # some children at a time, so that the questions held are bounded
    bound = np.searchsorted(np.cumsum(size), np.arange(0, size.sum(), 4 * GROUP))
    for a, b in zip(bound, [*bound[1:], len(size)]):
        n = size[a:b]
        child = np.repeat(np.arange(a, b), n)
        i = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + begin[child]]
        d = depth[of[child]]
        for other, start in ((i + d, i), (i - d, i - d)):
            there = (other >= 0) & (other < len(order))
            at = place[np.where(there, other, 0)]
            there &= (at >= low[of[child]]) & (at < high[of[child]]) & ((at < begin[child]) | (at >= end[child]))
            starts.append(start[there])
            periods.append(d[there])
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = np.unique(np.stack([np.concatenate(starts) + 2 * np.concatenate(periods), np.concatenate(periods)], axis=1), axis=0)
    return both[:, 0] - 2 * both[:, 1], both[:, 1]


def _rotated(ids: np.ndarray, start: int, period: int, first: int) -> int:
    """The first word, not before ``first``, from which words ``period`` apart
    are equal up to ``start``; blocks of growing length are compared."""
    block = 16
    while start > first:
        n = min(block, start - first)
        other = np.flatnonzero(ids[start - n:start] != ids[start - n + period:start + period])
        if len(other):
            return start - n + int(other[-1]) + 1
        start, block = start - n, 2 * block
    return start


def runs(ids: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs in all texts, in order, starts
    counted from the first word of the first text."""
    square, period = branching_squares(*suffixes(ids, ends))
    end = square + 2 * period
    first = np.concatenate([[0], ends])[np.searchsorted(ends, square, side="right")]
    # a long enough run has more squares to the left of its last
    more = np.maximum(REPEATS * period, LEAST) - 2 * period
    keep = square - more >= first
    square, period, end, first, more = (x[keep] for x in (square, period, end, first, more))
    far = square - more
    keep = (ids[far] == ids[far + period]) & (ids[square - 1] == ids[square - 1 + period])
    found, at, length, last_end = [], [], [], -1
    for e, q, s, f in zip(*(x[keep].tolist() for x in (end, period, square, first))):  # by end, then period
        if e != last_end:
            found, last_end = [], e
        if any(q % known == 0 and s >= start for start, known in found):
            continue  # a multiple of a period merges into its run
        start = _rotated(ids, s, q, f)
        found.append((start, q))
        if e - start >= max(REPEATS * q, LEAST):
            at.append((start, e - start, q))
    return sorted(at, key=lambda r: (r[0], r[2]))


def collapsed(text: list[str], found: list[tuple[int, int, int]]) -> list[str]:
    """The words without those that a run repeats."""
    if not found:
        return text
    keep = np.ones(len(text), bool)
    for start, length, period in found:
        keep[start + period:start + length] = False
    return [text[i] for i in np.flatnonzero(keep)]


def foremost(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length over period, compared exactly."""
    best = None
    for r in found:  # by start, then period
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def in_texts(texts: list[list[str]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each text."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    ids, ends = numbered(texts)
    chosen = np.flatnonzero(may_repeat(ids, ends))
    if len(chosen):
        starts = ends - [len(t) for t in texts]
        kept = np.concatenate([ids[starts[k]:ends[k]] for k in chosen])
        kept_ends = np.cumsum(ends[chosen] - starts[chosen])
        for start, length, period in runs(kept, kept_ends):
            k = int(np.searchsorted(kept_ends, start, side="right"))
            out[chosen[k]].append((start - (int(kept_ends[k - 1]) if k else 0), length, period))
    return out


def planted(doc_id: int | None, text: list[str]) -> list[str]:
    """The edit that the query asks for: of a document whose hash ends in 0,
    the words from one on repeat the first few of them. A null id takes none."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not text:
        return text
    g, n = h // 10, len(text)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return text[:a] + [text[a + i % p] for i in range(n - a)]


_OUT = pa.schema([("doc_id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()),
                  ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])


def _row(doc_id, text, found):
    best = foremost(found)
    listed = "".join(f"{a},{n},{q}\n" for a, n, q in found)
    return (doc_id, len(found), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(" ".join(collapsed(text, found)).encode()).hexdigest())


def _grouped(batches, edit):
    """Groups of (doc_id, words) of GROUP words or one text."""
    group, held = [], 0
    for batch in batches:
        ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
        for i, doc_id in enumerate(ids):
            text = edit(doc_id, words(texts[i].as_py()))
            if group and held + len(text) > GROUP:
                yield group
                group, held = [], 0
            group.append((doc_id, text))
            held += len(text)
    if group:
        yield group


def periodic(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", edit=lambda doc_id, words: words) -> DataFrame:
    """Number of runs, the foremost one, and digests of all runs and of the
    collapsed text, of each document as ``edit`` gives its words."""
    def each(batches):
        for group in _grouped(batches, edit):
            found = in_texts([t for _, t in group])
            rows = [_row(i, t, r) for (i, t), r in zip(group, found)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _OUT)], schema=_OUT)

    rows = docs.select(docs[f"`{doc_id}`"].cast("long").alias("doc_id"), or_empty(docs[f"`{text}`"]).alias("text"))
    return rows.mapInArrow(each, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")


def collapse(docs: DataFrame, text: str = "text") -> DataFrame:
    """``text`` of each document without what its runs repeat, its words joined
    by one space then; texts without a run, and nulls, stay as they are."""
    @F.arrow_udf("string")
    def shorter(texts: pa.Array) -> pa.Array:
        out = []
        for (_, (whole, ws)), r in _with_runs(texts):
            out.append(" ".join(collapsed(ws, r)) if r else whole)
        return pa.array(out, pa.string())

    return docs.withColumn(text, shorter(docs[f"`{text}`"]))


def _with_runs(texts: pa.Array):
    held, n = [], 0
    for i, whole in enumerate(texts.to_pylist()):
        ws = words(whole or "")
        if held and n + len(ws) > GROUP:
            yield from zip(held, in_texts([w for _, (_, w) in held]))
            held, n = [], 0
        held.append((i, (whole, ws)))
        n += len(ws)
    yield from zip(held, in_texts([w for _, (_, w) in held]))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic(table(spark, sf_dir, "documents"), edit=planted)

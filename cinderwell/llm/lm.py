"""Language-model scores of whole documents.

Words are counted over all documents, apart for training and held-out ones (map
tasks count, Spark sums). From the counts come a smoothed unigram score and the
parts of the recurrent model (``gru``) that are not learned: its vocabulary, the
mass of each class, and the share of every word in its class.

The second reading turns each document into numbers of the model's vocabulary
(two bytes a word), adds up what the counts of its frequent words give, and
lists its other words with how often it holds them. These rows, each with a
number of its own, are written once; texts are not read again. Counts of
frequent words go to all tasks: those of the ``LOOKUP`` most frequent ones at
most, and long words go by their digest, so the bound holds in bytes too. The
other words are joined with the counts, and their sums come back to the row. No
text is shuffled. Since frequent words do not take part in it, the join has no
hot key: a word of it occurs in less than one LOOKUP-th of all tokens.

The network learns in ``ROUNDS`` rounds. In each, every task learns from its
part of one in ROUNDS training documents, starting from the same parameters, and
the parameters are averaged by the number of words they have met, in two levels
of groups; so every training document is learned from once. A set of parameters
has a fixed size (under a megabyte), whatever the corpus. Scoring carries the
state from the first to the last word of each document.

Nulls and empty texts have the end token alone. A document without an id counts
as one whose id is the empty text, which is held out. Repeated rows are counted,
learned from and scored each. Without a training document every token has
probability 1 by the unigram score. Very long texts are scored whole; a task
holds about ``GROUP`` words, or one text. An empty table gives an empty result.
Only the two named columns are read, so names cannot clash.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderwell.llm import gru
from cinderwell.llm.common import or_empty, table
from cinderwell.session import written_table

ADDED = 0.1
HELD_OUT, ROUNDS = 10, 4
LOOKUP, LONGEST = 200_000, 64
#: words that a task counts before it hands them on, or holds to learn and score; words looked up at a time
GROUP, WORDS = 3_000_000, 200_000
#: documents numbered at a time
ROWS = 500
#: parameters a row, and groups of tasks, when parameters are averaged
BLOCK, GROUPS = 1 << 14, 256
END = b""


def tokens(text: bytes) -> list[bytes]:
    """Words, A-Z lower-cased (``bytes`` knows ASCII only), then the end."""
    out = text.lower().split()
    out.append(END)
    return out


def key(word: bytes) -> bytes:
    """A long word's digest; it holds a space, so no word is like it."""
    return word if len(word) <= LONGEST else b" " + hashlib.sha256(word).hexdigest().encode()


def ending(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % gru.ENDINGS


def _dealt(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, part, text): ``part`` is the hash of the id."""
    i = docs[f"`{doc_id}`"]
    return docs.select(i.cast("long").alias("doc_id"), F.crc32(F.coalesce(i.cast("string"), F.lit("")).cast("binary")).alias("part"),
                       or_empty(docs[f"`{text}`"]).cast("binary").alias("text"))


def _is_held_out() -> Column:
    return F.col("part") % HELD_OUT == 0


def _endings(words: pa.Array) -> np.ndarray:
    """``ending`` of each word; few differ in their last two bytes."""
    tails = pc.binary_slice(words, -2).dictionary_encode()
    known = np.fromiter(map(ending, tails.dictionary.to_pylist()), np.int32, len(tails.dictionary))
    return known[tails.indices.to_numpy()] if len(words) else known


def _keys(words: pa.Array) -> pa.Array:
    long = pc.greater(pc.binary_length(words), LONGEST)
    return pc.replace_with_mask(words, long, pa.array([key(w) for w in words.filter(long).to_pylist()], pa.binary()))


def _strings(words: pa.Array) -> pa.Array:
    try:
        return words.cast(pa.string())
    except pa.ArrowInvalid:  # not UTF-8
        return pa.array([w.decode("utf-8", "replace") for w in words.to_pylist()], pa.string())


def _count(batches):
    def rows(train, held):
        # distinct long words have distinct digests
        chunks = pa.chunked_array(train + held, pa.binary()).dictionary_encode().chunks
        words = chunks[0].dictionary if chunks else pa.array([], pa.binary())
        counts = [sum((np.bincount(c.indices.to_numpy(), minlength=len(words)) for c in part), np.zeros(len(words), np.int64))
                  for part in (chunks[:len(train)], chunks[len(train):])]
        return pa.RecordBatch.from_arrays([_strings(_keys(words)), pa.array(_endings(words), pa.int32()), *(pa.array(c, pa.int64()) for c in counts)],
                                          ["word", "ending", "train", "held"])

    both, n = ([], []), 0
    for batch in batches:
        met = [], []
        for part, text in zip(batch.column("part").to_pylist(), batch.column("text")):
            words = met[part % HELD_OUT == 0]
            words += tokens(text.as_py())
            if len(words) > WORDS:
                both[part % HELD_OUT == 0].append(pa.array(words, pa.binary()))
                n += len(words)
                words.clear()
            if n > GROUP:
                yield rows(*both)
                both, n = ([], []), 0
        for held, words in zip(both, met):
            if words:
                held.append(pa.array(words, pa.binary()))
                n += len(words)
    yield rows(*both)


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, ending, train, held) of every distinct token; the end is empty."""
    return _dealt(docs, doc_id, text).mapInArrow(_count, "word string, ending int, train long, held long") \
        .groupBy("word", "ending").agg(F.sum("train").alias("train"), F.sum("held").alias("held"))


@dataclass
class Lexicon:
    """What all tasks know of the counts: a fixed number of words at most."""
    tokens: int                #: training tokens
    types: int                 #: distinct ones
    place: dict[bytes, int]    #: of each frequent word, in the arrays below
    count: np.ndarray          #: in training
    number: np.ndarray         #: its number in the model
    end_count: int
    vocabulary: list[int]      #: counts of the model's words, the end first
    ending_mass: np.ndarray    #: smoothed counts of each ending, with one unseen word

    @property
    def all_mass(self) -> float:
        return self.tokens + ADDED * (self.types + 1)


def lexicon(counts: DataFrame, lookup: int = LOOKUP) -> Lexicon:
    by_ending = counts.groupBy("ending").agg(F.sum("train").alias("n"), F.count_if(F.col("train") > 0).alias("types")).collect()
    # how many words there are by eighths of a doubling of their count
    words = counts.where(F.col("word") != "").withColumn("bin", F.floor(8 * F.log2(F.col("train") + F.col("held"))).cast("int"))
    fits, least = 0, 1 << 30
    for b, n in sorted(words.groupBy("bin").count().collect(), reverse=True):
        if fits + n > lookup:
            break
        fits, least = fits + n, b
    frequent = sorted(words.where(F.col("bin") >= least).select("word", "ending", "train").collect(), key=lambda r: (-r["train"], r["word"]))
    end_count = sum(r["train"] for r in counts.where(F.col("word") == "").collect())
    count = np.array([r["train"] for r in frequent], np.int64)
    number = np.array([gru.VOCAB + r["ending"] for r in frequent], np.int32)
    chosen = [r for r in frequent[:gru.VOCAB - 1] if r["train"]]
    number[:len(chosen)] = np.arange(1, len(chosen) + 1)
    mass = np.full(gru.ENDINGS, ADDED)
    for r in by_ending:
        mass[r["ending"]] += r["n"] + ADDED * r["types"]
    for r in chosen:
        mass[r["ending"]] -= r["train"] + ADDED
    mass[ending(END)] -= end_count + ADDED * (end_count > 0)
    return Lexicon(sum(r["n"] for r in by_ending), sum(r["types"] for r in by_ending), {r["word"].encode(): k for k, r in enumerate(frequent)},
                   count, number, end_count, [end_count, *count[:len(chosen)].tolist()], mass)


_NUMBERED = ("doc_id long, part long, n_tokens long, n_known long, base double, share double, "
             "numbers binary, rest array<struct<word: string, n: int>>")


def _number(told):
    """What the second reading makes of each document. ``base`` is its unigram
    score, ``share`` the score of words within their ending classes, both
    without what the counts of the words in ``rest`` add."""
    def each(batches):
        known = told.value
        frequent = pc.SetLookupOptions(pa.array(list(known.place), pa.binary()))
        log_count = np.log10(known.count + ADDED)
        log_ending = np.log10(np.maximum(known.ending_mass, 1e-300))
        log_all, log_end = np.log10(known.all_mass), np.log10(known.end_count + ADDED)

        def rows(part, held):
            size = np.array([len(w) for w in held])
            ends = np.cumsum(size)
            words = [w for some in held for w in some]
            at = pc.index_in(pa.array(words, pa.binary()), options=frequent).fill_null(-1).to_numpy().astype(np.int64)
            rare = at < 0
            rare[ends - 1] = False
            if max(map(len, words)) > LONGEST:
                for i in np.flatnonzero(rare).tolist():
                    if len(words[i]) > LONGEST:
                        at[i] = known.place.get(key(words[i]), -1)
                rare &= at < 0
            place, seen = np.flatnonzero(rare), np.flatnonzero(at >= 0)
            others = [words[i] for i in place.tolist()]
            numbers = np.zeros(len(words), np.int32)  # the end is number 0
            numbers[seen] = known.number[at[seen]]
            numbers[place] = gru.VOCAB + _endings(pa.array(others, pa.binary()))
            base, share, met = np.zeros(len(words)), np.zeros(len(words)), np.zeros(len(words), np.int64)
            base[seen] = log_count[at[seen]]
            met[seen] = known.count[at[seen]] > 0
            outside = numbers >= gru.VOCAB
            share[outside] = base[outside] - log_ending[numbers[outside] - gru.VOCAB]
            base, share, met = (np.add.reduceat(x, ends - size) for x in (base, share, met))
            listed, times, bounds = [], [], [0]
            for a, b in pairwise(np.searchsorted(place, np.concatenate([[0], ends])).tolist()):
                rest = Counter(others[a:b])
                listed += rest.keys()
                times += rest.values()
                bounds.append(len(listed))
            rest = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays(
                [_strings(_keys(pa.array(listed, pa.binary()))), pa.array(times, pa.int32())], ["word", "n"]))
            at_byte = np.concatenate([[0], 2 * ends]).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(held), [None, pa.py_buffer(at_byte), pa.py_buffer(numbers.astype(np.uint16))])
            return pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("part"), pa.array(size, pa.int64()), pa.array(met + int(known.end_count > 0)),
                 pa.array(base + log_end - size * log_all), pa.array(share), packed, rest],
                ["doc_id", "part", "n_tokens", "n_known", "base", "share", "numbers", "rest"])

        for batch in batches:
            a, held, n = 0, [], 0
            for i, text in enumerate(batch.column("text")):
                held.append(tokens(text.as_py()))
                n += len(held[-1])
                if n > WORDS or i + 1 - a == ROWS or i + 1 == batch.num_rows:
                    yield rows(batch.slice(a, len(held)), held)
                    a, held, n = i + 1, [], 0
    return each


def numbered(docs: DataFrame, known: Lexicon, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A written row for each document, with a number ``row`` of its own."""
    told = docs.sparkSession.sparkContext.broadcast(known)
    rows = _dealt(docs, doc_id, text).mapInArrow(_number(told), _NUMBERED)
    out = written_table(rows.withColumn("row", F.monotonically_increasing_id()), "lm-rows")
    told.unpersist()
    return out


def _rows(batches, columns):
    """(columns..., numbers) of each row."""
    for batch in batches:
        numbers = batch.column("numbers")
        for i, rest in enumerate(zip(*(batch.column(c).to_pylist() for c in columns))):
            yield *rest, np.frombuffer(numbers[i].as_py(), np.uint16).astype(np.int32)


def _groups(rows, size):
    """Lists of rows that have GROUP words together, or one row."""
    held, n = [], 0
    for row in rows:
        if held and n + size(row) > GROUP:
            yield held
            held, n = [], 0
        held.append(row)
        n += size(row)
    if held:
        yield held


def _learned(flat):
    """Learns from a task's documents; blocks of the parameters times the
    number of words met, in (task, block, words, values)."""
    def each(batches):
        model, met = gru.Model(flat.value), 0
        for docs in _groups((numbers for _, numbers in _rows(batches, ("part",))), len):
            model.learn(docs)
            met += sum(map(len, docs))
        if met:
            values = model.flat.astype(np.float64) * met
            blocks = [values[a:a + BLOCK].tobytes() for a in range(0, len(values), BLOCK)]
            n = len(blocks)
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()] * n, pa.int32()), pa.array(range(n), pa.int32()),
                                              pa.array([met] * n, pa.int64()), pa.array(blocks, pa.binary())], ["task", "block", "words", "values"])
    return each


def _summed(group: pa.Table) -> pa.Table:
    rows = sorted(zip(*(group.column(c).to_pylist() for c in ("task", "block", "words", "values"))))  # the same sum each time
    total = np.sum([np.frombuffer(v, np.float64) for *_, v in rows], axis=0)
    return pa.table({"task": pa.array([rows[0][0]], pa.int32()), "block": pa.array([rows[0][1]], pa.int32()),
                     "words": pa.array([sum(r[2] for r in rows)], pa.int64()), "values": pa.array([total.tobytes()], pa.binary())})


def fitted(rows: DataFrame, known: Lexicon, rounds: int = ROUNDS) -> np.ndarray:
    """The model's parameters after all rounds over numbered documents."""
    sc = rows.sparkSession.sparkContext
    flat = gru.initial(np.array(known.vocabulary) + ADDED, known.ending_mass)
    kind = "task int, block int, words long, values binary"
    train = rows.where(~_is_held_out()).select("part", "numbers")
    for r in range(rounds):
        now = sc.broadcast(flat)
        parts = train.where(F.floor(F.col("part") / HELD_OUT) % rounds == r).mapInArrow(_learned(now), kind)
        some = parts.groupBy("block", F.col("task") % GROUPS).applyInArrow(_summed, kind)
        blocks = some.groupBy("block").applyInArrow(_summed, kind).orderBy("block").collect()
        if blocks:
            flat = np.concatenate([np.frombuffer(b["values"], np.float64) / b["words"] for b in blocks]).astype(np.float32)
        now.unpersist()
    return flat


def _scores(params):
    """(row, log10 probability of the document's numbers)."""
    def each(batches):
        model = gru.Model(params.value)
        for group in _groups(_rows(batches, ("row",)), lambda r: len(r[1])):
            rows, docs = zip(*group)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(model.score(list(docs)) / np.log(10))], ["row", "model"])
    return each


def scored(rows: DataFrame, counts: DataFrame, known: Lexicon, params: np.ndarray) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of
    numbered documents."""
    sc = rows.sparkSession.sparkContext
    logs = rows.select("row", "numbers").mapInArrow(_scores(sc.broadcast(params)), "row long, model double")
    rare = rows.select("row", F.inline("rest")).join(counts.where(F.col("train") > 0).select("word", "train"), "word", "left")
    count = F.coalesce("train", F.lit(0))
    sums = rare.groupBy("row").agg(F.sum(F.col("n") * F.log10(count + ADDED)).alias("more"), F.sum(F.when(count > 0, F.col("n")).otherwise(0)).alias("seen"))
    more = F.coalesce("more", F.lit(0.0))
    return rows.drop("rest", "numbers").join(logs, "row").join(sums, "row", "left").select(
        "doc_id", _is_held_out().alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("seen", F.lit(0))).alias("n_known"),
        F.lit(known.tokens).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"),
        (F.col("model") + F.col("share") + more).alias("score"))


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lookup: int = LOOKUP) -> DataFrame:
    counts = written_table(word_counts(docs, doc_id, text), "lm-counts")
    known = lexicon(counts, lookup)
    rows = numbered(docs, known, doc_id, text)
    return scored(rows, counts, known, fitted(rows, known))


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))

"""Token ids as Arrow files of equal-length sequences.

A shard holds the ids of a range of documents in order, cut into sequences of
``LENGTH``: an Arrow IPC file whose batches have ``input_ids``
(fixed_size_list<uint16>, or <uint32> for a vocabulary beyond 65,536) and
``mask`` (fixed_size_list<bool>: true for an id, false for the padding at the
end of a shard). Batches have equal numbers of sequences, so the place of any
token follows by division, and a memory-mapped batch is read without a copy. Beside it, a second Arrow file lists the
shard's documents: doc_id, offset in the shard, number of ids.

Documents are range-partitioned by doc_id (null first, equal ids by text), one
shard a partition; the shards' sizes, one row each, give every shard's first
token number. A shard is written under a name of its own attempt and renamed
when it is whole, so a lost or repeated task leaves one whole shard.

A null text counts as empty and has the end id alone. Texts are encoded whole:
they are cut only where the tokenizer's own first split falls, and a worker
remembers the ids of cuts. Repeated rows are written each. An
empty table gives no shards and an empty result.
"""

from __future__ import annotations

import functools
import os
import re
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinderwell.llm.common import or_empty, shared_folder, shuffle_partitions, small_batches, table

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
LENGTH = 2048
BATCH = 64
DOC_BATCH = 4096
MEMO = 1_200_000

#: where byte-level BPE's first split always falls: before a single space,
#: between a letter and punctuation or a line end, after a single line end
CUT = re.compile(r"(?<=\S)(?= \S)|(?<=[^\W\d_])(?=[.,;:!?#$%*&|\n])|(?<=\S\n)(?=\S)")
MARKS = ".,;:!?"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _cut(text: str) -> list[str]:
    """A text whose white space is all single spaces and line ends is cut at
    each of these; others only where that is sure to be right."""
    if text.replace("\n", " ").split(" ") == text.split():
        return text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")
    return CUT.sub("\0", text).split("\0")


class Encoder(dict):
    """Texts to ids with the tokenizers library: a dictionary of the cuts known
    so far, which encodes a cut that it is asked for and does not know."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # texts with these are encoded in one piece
        self.whole = ["\0", *(t.content for t in self.tokenizer.get_added_tokens_decoder().values())]
        small = self.tokenizer.get_vocab_size() <= 1 << 16
        self.type, self.code = np.dtype("<u2" if small else "<u4"), "H" if small else "I"

    def ids(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def __missing__(self, cut: str) -> bytes:
        word = cut[1:] if cut[:1] == " " else cut
        if word.isalpha():
            ids = self.ids(cut)
        elif word[-1:] in MARKS and word[:-1].isalpha():  # its parts are likely known
            ids = self[cut[:-1]] + self[cut[-1]]
        else:
            parts = CUT.sub("\0", cut).split("\0")
            ids = b"".join([self[p] for p in parts]) if len(parts) > 1 else self.ids(cut)
        self[cut] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of a text, as bytes of ``type``."""
        if any(x in text for x in self.whole):
            return self.ids(text)
        if len(self) > MEMO:
            self.clear()
        return b"".join(map(self.__getitem__, _cut(text)))


@functools.lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    """Once for each worker process."""
    return Encoder(path)


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """``file:/x`` is how Hadoop writes ``file:///x``."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def _schema(length: int, ids: np.dtype) -> pa.Schema:
    return pa.schema([("input_ids", pa.list_(pa.from_numpy_dtype(ids), length)), ("mask", pa.list_(pa.bool_(), length))],
                     {b"length": str(length).encode(), b"batch": str(BATCH).encode()})


_DOCS = pa.schema([("doc_id", pa.int64()), ("offset", pa.int64()), ("n_tokens", pa.int64())])


class ShardWriter:
    """Writes one shard; holds a batch of sequences and of documents."""

    def __init__(self, fs: pafs.FileSystem, folder: str, shard: int, ids: np.dtype, length: int = LENGTH):
        self.fs, self.length, self.type, self.tag = fs, length, ids, uuid.uuid4().hex
        self.names = [f"{folder}/{kind}-{shard:06d}.arrow" for kind in ("tokens", "docs")]
        fs.create_dir(folder, recursive=True)
        self.schema = _schema(length, ids)
        self.sinks = [fs.open_output_stream(f"{n}.{self.tag}") for n in self.names]
        self.tokens = pa.ipc.new_file(self.sinks[0], self.schema)
        self.docs = pa.ipc.new_file(self.sinks[1], _DOCS)
        self.held, self.n_held, self.rows, self.offset, self.n_docs = [], 0, [], 0, 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.rows.append((doc_id, self.offset, len(ids)))
        self.offset += len(ids)
        self.n_docs += 1
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= BATCH * self.length:
            self._sequences(whole=True)
        if len(self.rows) >= DOC_BATCH:
            self._documents()

    def _sequences(self, whole: bool) -> None:
        flat, size = np.concatenate(self.held), BATCH * self.length
        stop = len(flat) // size * size if whole else len(flat)
        for a in range(0, stop, size):
            part = flat[a:min(a + size, stop)]
            n = -(-len(part) // self.length) * self.length
            ids, mask = np.zeros(n, self.type), np.zeros(n, bool)
            ids[:len(part)], mask[:len(part)] = part, True
            self.tokens.write_batch(pa.record_batch([
                pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)], schema=self.schema))
        self.held, self.n_held = [flat[stop:]], len(flat) - stop

    def _documents(self) -> None:
        self.docs.write_batch(pa.record_batch([pa.array([r[i] for r in self.rows], pa.int64()) for i in range(3)], schema=_DOCS))
        self.rows = []

    def close(self) -> None:
        if self.n_held:
            self._sequences(whole=False)
        if self.rows:
            self._documents()
        for writer, sink, name in zip((self.tokens, self.docs), self.sinks, self.names):
            writer.close()
            sink.close()
            self.fs.move(f"{name}.{self.tag}", name)


class ShardReader:
    """Random access to a shard: ``ids(offset, n)`` yields views of the mapped
    batches. The file system maps local files and reads ranges of others."""

    def __init__(self, fs: pafs.FileSystem, name: str):
        self.source = pa.memory_map(name) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(name)
        self.file = pa.ipc.open_file(self.source)
        self.length = int(self.file.schema.metadata[b"length"])
        self.size = int(self.file.schema.metadata[b"batch"]) * self.length
        self.at, self.batch = -1, None

    def _batch(self, k: int) -> pa.RecordBatch:
        if k != self.at:
            self.at, self.batch = k, self.file.get_batch(k)
        return self.batch

    def sequence(self, k: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids and mask of sequence k, without a copy (the mask stays in bits)."""
        n = self.size // self.length
        ids, mask = (c.flatten()[k % n * self.length:][:self.length] for c in self._batch(k // n).columns)
        return ids.to_numpy(), mask

    def ids(self, offset: int, n: int):
        while n:
            k, a = divmod(offset, self.size)
            flat = self._batch(k).column(0).flatten()
            part = flat[a:a + n].to_numpy()
            yield part
            offset, n = offset + len(part), n - len(part)


def write(docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text", path: str | None = None,
          end_id: int = END_ID, length: int = LENGTH, parts: int | None = None) -> list[tuple[int, int]]:
    """Write all documents to shards in ``folder``, which all executors share;
    (shard, tokens) of those that have any, in doc_id order."""
    path, spark = path or tokenizer_path(), docs.sparkSession

    def shard(batches):
        encoder, writer, k = _encoder(path), None, TaskContext.get().partitionId()
        end = np.array([end_id], encoder.type).tobytes()
        for batch in batches:
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                writer = writer or ShardWriter(*_filesystem(folder), k, encoder.type, length)
                writer.add(i, np.frombuffer(encoder.encode(text.as_py()) + end, encoder.type))
        if writer:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([writer.offset], pa.int64())], ["shard", "n"])

    rows = docs.select(docs[f"`{doc_id}`"].cast("long").alias("doc_id"), or_empty(docs[f"`{text}`"]).alias("text"))
    rows = small_batches(rows).repartitionByRange(parts or shuffle_partitions(spark), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    # a row for each shard
    return sorted((r["shard"], r["n"]) for r in rows.mapInArrow(shard, "shard int, n long").collect())


def read(spark: SparkSession, folder: str, shards: list[tuple[int, int]], each, schema: str) -> DataFrame:
    """``each(doc_id, start, ids)`` of every document in the shards, a task a
    shard; ``ids`` yields arrays in order, ``each`` returns a row of ``schema``."""
    firsts, start = [], 0
    for k, n in shards:
        firsts.append((k, start))
        start += n
    arrow = pa.schema([pa.field(f.name, {"bigint": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}[f.dataType.simpleString()])
                       for f in T.StructType.fromDDL(schema)])

    def documents(batches):
        fs, base = _filesystem(folder)
        for batch in batches:
            for k, first in zip(*(c.to_pylist() for c in batch.columns)):
                tokens = ShardReader(fs, f"{base}/tokens-{k:06d}.arrow")
                with fs.open_input_file(f"{base}/docs-{k:06d}.arrow") as source:
                    file = pa.ipc.open_file(source)
                    for b in range(file.num_record_batches):
                        rows = [each(i, first + at, n, tokens.ids(at, n)) for i, at, n in zip(*(c.to_pylist() for c in file.get_batch(b).columns))]
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), arrow)], schema=arrow)

    listed = spark.createDataFrame(firsts, "shard int, first long")
    return listed.repartitionByRange(max(len(firsts), 1), "shard").mapInArrow(documents, schema)


def _checksum(doc_id, start, n, parts):
    crc = 0
    for ids in parts:
        crc = zlib.crc32(ids.astype("<u4", copy=False).tobytes(), crc)
    return doc_id, start, n, crc


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "token-ids")
    shards = write(table(spark, sf_dir, "documents"), folder)
    return read(spark, folder, shards, _checksum, "doc_id long, start long, n_tokens long, ids_crc32 long")

"""SentencePiece encoding and decoding by suffix-array matching.

Texts are normalised by the model's own rules and cut where no piece can
cross: before a run of white-space marks. The distinct cuts of a batch that
are not known yet are concatenated into one index text; a suffix array over
it, sorted as deep as the longest piece, is searched for every piece of the
vocabulary at once by binary search; the ranges found are the edges of a
lattice, which are sorted by end position and relaxed from left to right.

Relaxation depends on the kind of model:

* unigram: the best sum of scores reaching each position;
* BPE: each prefix of a cut has exactly one encoding, and its last piece is
  the one edge whose piece stands beside the last piece of the prefix before
  it, where two pieces stand side by side if merging their joint characters
  by score ends in just these two. Merges inside a prefix never depend on
  what follows, so this gives the same ids as merging the whole text.

A character that no piece covers becomes byte pieces, or the unknown id where
the model has none. Decoding joins pieces and bytes and takes off the leading
space that normalisation put there.

Null text is encoded like the empty text: no ids. Texts of any length are
encoded whole; the work is linear in the length of a cut. Repeated rows are
encoded alike. An empty table gives an empty result. Other columns are kept;
the result columns ``ids`` and ``n_ids`` replace those of the same name.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderwell.llm.common import or_empty, small_batches, table

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: encoded cuts and pair tests a worker remembers, characters of new cuts that
#: are indexed at once, and characters of text that are in work at once
MEMO_CUTS, MEMO_PAIRS, INDEX_CHARS, TEXT_CHARS = 120_000, 150_000, 100_000, 1_000_000
ROWS = 300
SLOT_BITS = 20
NO_SCORE = float("-inf")


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _model_type(proto: bytes) -> int:
    """trainer_spec.model_type of a model file: 1 unigram (the default), 2 BPE."""
    def fields(data: bytes):
        i = 0

        def varint():
            nonlocal i
            n = shift = 0
            while True:
                b = data[i]
                i += 1
                n |= (b & 127) << shift
                shift += 7
                if b < 128:
                    return n

        while i < len(data):
            tag = varint()
            if tag & 7 == 0:
                yield tag >> 3, varint()
            elif tag & 7 == 2:
                n = varint()
                yield tag >> 3, data[i:i + n]
                i += n
            else:
                n = 8 if tag & 7 == 1 else 4
                yield tag >> 3, data[i:i + n]
                i += n

    trainer = next((v for k, v in fields(proto) if k == 2), b"")
    return next((v for k, v in fields(trainer) if k == 3), 1)


class Matcher:
    """A vocabulary, and the cuts a worker has encoded with it so far."""

    def __init__(self, pieces: dict[str, tuple[int, float]], bpe: bool, bytes_at: list[int] | None, unknown: int, normalize):
        self.pieces, self.bpe, self.bytes_at, self.unknown, self.normalize = pieces, bpe, bytes_at, unknown, normalize
        self.score = {p: s for p, (_, s) in pieces.items()}
        self.names = sorted(pieces)
        self.longest = max(map(len, self.names), default=1)
        lengths = np.array([len(p) for p in self.names], np.int64)
        chars = np.zeros((len(self.names), self.longest), np.int64)
        for i, p in enumerate(self.names):
            chars[i, :len(p)] = [ord(c) for c in p]
        self.lengths, self.chars, self.id_of = lengths, chars, np.array([pieces[p][0] for p in self.names], np.int32)
        self.cuts = self._cuts(pieces)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self.slot_pair, self.slot_fits = np.full(1 << SLOT_BITS, -1, np.int64), np.zeros(1 << SLOT_BITS, bool)

    @staticmethod
    def _cuts(pieces) -> re.Pattern:
        """The finest of three ways to cut a text that no piece crosses: between
        word and other characters, before runs of marks, not at all. Word
        characters that stand beside others in some piece keep what they touch
        uncut."""
        if any(MARK in p.lstrip(MARK) for p in pieces):
            return re.compile(r"(?s:.+)")
        word = {c: bool(re.match(r"\w", c)) for c in set("".join(pieces))}
        glue = {a if word[a] else b for p in pieces for a, b in zip(p.lstrip(MARK), p.lstrip(MARK)[1:]) if word[a] != word[b]}
        if len(glue) > 100:
            return re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        held = "".join(map(re.escape, sorted(glue | {"_"})))
        return re.compile(rf"{MARK}*+(?:[^\W{held}]++(?![{held}])|[^\w{MARK}]++(?![{held}])|[^{MARK}]+)|{MARK}+")

    # ---- merging two pieces, to see whether they stand side by side
    def side_by_side(self, left: int, right: int) -> bool:
        """Is this what merging gives? With nothing on the left: is the piece one?"""
        pair = [self._symbol(x) for x in (left, right) if x]
        return self._merged("".join(pair)) == pair

    def _merged(self, text: str) -> list[str]:
        """Merge by score, leftmost first; only for texts of two pieces."""
        symbols, score = list(text), self.score
        while len(symbols) > 1:
            best, at = NO_SCORE, -1
            for i in range(len(symbols) - 1):
                s = score.get(symbols[i] + symbols[i + 1], NO_SCORE)
                if s > best:
                    best, at = s, i
            if at < 0:
                break
            symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    # ---- the index
    def edges(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Occurrences of all pieces in an array of code points, 0 between cuts:
        (start, end, piece number), sorted by end, shorter ones first."""
        letters, rank = np.unique(text, return_inverse=True)
        rank = rank.astype(np.int64) + 1  # 0: behind the end
        width = int(len(letters)).bit_length()
        step = min(self.longest, 62 // width)  # as many characters as one key holds
        key, padded = np.zeros(len(text), np.int64), np.concatenate([rank, np.zeros(step, np.int64)])
        for k in range(step):
            key = (key << width) | padded[k:k + len(text)]
        order = self._suffixes(key, step)
        low, high = self._ranges(text, order, key[order], letters, width, step)
        n = high - low
        which = np.repeat(np.arange(len(n)), n)
        first = np.repeat(np.cumsum(n) - n, n)
        start = order[np.arange(len(which)) - first + np.repeat(low, n)]
        end = start + self.lengths[which]
        by_place = np.argsort(end * (self.longest + 1) + (end - start))
        return start[by_place], end[by_place], which[by_place]

    def _suffixes(self, key: np.ndarray, depth: int) -> np.ndarray:
        """Places in the order of their suffixes, equal if they agree on the
        length of the longest piece: prefix doubling from keys of the first
        ``depth`` characters."""
        order = np.argsort(key)
        while depth < self.longest:
            ranked = key[order]
            new = np.zeros(len(key), np.int64)
            new[order] = np.cumsum(np.concatenate([[0], ranked[1:] != ranked[:-1]]))
            after = np.zeros(len(key), np.int64)
            after[:max(0, len(key) - depth)] = new[depth:] + 1
            key = new * (len(key) + 2) + after
            depth *= 2
            order = np.argsort(key)
        return order

    def _ranges(self, text, order, keys, letters, width, step) -> tuple[np.ndarray, np.ndarray]:
        """Of each piece, the range of ``order`` that starts with it: binary
        search for all pieces at once, first among the sorted ``keys``, then
        character by character for what a key does not hold."""
        code = np.searchsorted(letters, self.chars)
        inside = np.arange(self.longest) < self.lengths[:, None]
        occurs = ((letters[np.minimum(code, len(letters) - 1)] == self.chars) | ~inside).all(axis=1)
        code = np.where(inside, code + 1, 0)[:, :step]
        shift = width * np.arange(step - 1, -1, -1)
        least = (code << shift).sum(axis=1)
        most = least + (np.int64(1) << (width * (step - np.minimum(self.lengths, step))))
        low = np.where(occurs, np.searchsorted(keys, least), 0)
        high = np.where(occurs, np.searchsorted(keys, most), 0)
        deep = np.flatnonzero((self.lengths > step) & (low < high))
        padded = np.concatenate([text, np.zeros(self.longest, text.dtype)])

        def bound(after: bool) -> np.ndarray:
            a, b = low[deep], high[deep]
            while len(open_ := np.flatnonzero(a < b)):
                mid = (a[open_] + b[open_]) // 2
                differ = (padded[order[mid][:, None] + np.arange(self.longest)] - self.chars[deep[open_]]) * inside[deep[open_]]
                at = np.argmax(differ != 0, axis=1)
                sign = differ[np.arange(len(open_)), at]
                right = sign <= 0 if after else sign < 0
                a[open_[right]] = mid[right] + 1
                b[open_[~right]] = mid[~right]
            return a

        low[deep], high[deep] = bound(False), bound(True)
        return low, high

    # ---- relaxing
    def learn(self, cuts: list[str]) -> None:
        """Encode new cuts and remember their ids."""
        block, size = [], 0
        for c in [*cuts, None]:
            if block and (c is None or size + len(c) >= INDEX_CHARS):
                self._learn(block)
                block, size = [], 0
            if c is not None:
                block.append(c)
                size += len(c) + 1

    def _learn(self, cuts: list[str]) -> None:
        text = np.frombuffer("\0".join([*cuts, ""]).encode("utf-32-le"), np.uint32).astype(np.int64)
        length = np.array([len(c) for c in cuts], np.int64)
        begin = np.cumsum(length + 1) - length - 1
        relax = self._relax_bpe if self.bpe else self._relax_unigram
        place, symbol = relax(text, begin, length, self.edges(text))
        size, ids = self._ids(symbol)
        of = np.searchsorted(begin, place, side="right") - 1
        end = 4 * np.cumsum(np.bincount(of, weights=size, minlength=len(cuts)).astype(np.int64))
        flat, end = ids.tobytes(), end.tolist()
        self.known.update(zip(cuts, [flat[a:b] for a, b in zip([0, *end], end)]))

    def _symbol(self, x: int) -> str:
        return self.names[x - 1] if x <= len(self.names) else chr(x - len(self.names) - 1)

    def _fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``side_by_side`` for arrays of symbol numbers (0: nothing). Answers
        are kept in a table by a hash of the pair; a slot holds one pair."""
        base = len(self.names) + 0x110001
        code = left * base + right
        slot = self._slot(code)
        out = self.slot_fits[slot]
        miss = np.flatnonzero(self.slot_pair[slot] != code)
        if len(miss):
            fresh, place = np.unique(code[miss], return_inverse=True)
            answer = np.array([self._pair(c, base) for c in fresh.tolist()])
            out[miss] = answer[place]
            slot = self._slot(fresh)
            self.slot_pair[slot], self.slot_fits[slot] = fresh, answer
        return out

    @staticmethod
    def _slot(code: np.ndarray) -> np.ndarray:
        return (code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)

    def _pair(self, code: int, base: int) -> bool:
        found = self.pairs.get(code)
        if found is None:
            if len(self.pairs) >= MEMO_PAIRS:
                self.pairs.clear()
            found = self.pairs[code] = self.side_by_side(*divmod(code, base))
        return found

    def _relax_bpe(self, text: np.ndarray, begin: np.ndarray, length: np.ndarray, edges) -> tuple[np.ndarray, np.ndarray]:
        """All cuts in step: first every prefix of one character, then of two,
        ... Returns the symbols chosen and where they start, in text order.
        Symbol numbers: 0 nothing, then the pieces, then all code points."""
        start, end, which = edges
        far = end - begin[np.searchsorted(begin, start, side="right") - 1]
        order = np.argsort(far)
        start, end, which, far = start[order], end[order], which[order] + 1, far[order]
        steps = int(length.max())
        upto = np.searchsorted(far, np.arange(steps + 1), side="right").tolist()
        by_length = np.argsort(-length)
        long_enough = np.searchsorted(-length[by_length], -np.arange(steps + 1), side="right").tolist()
        last = np.full(len(text) + 1, -1, np.int64)  # the last symbol of the prefix that ends here
        # a cut's start shares its place with nothing: cuts are one apart
        last[begin] = 0
        one = len(self.names) + 1
        for j in range(1, steps + 1):
            a, b = upto[j - 1], upto[j]
            if a < b:
                fits = self._fits(last[start[a:b]], which[a:b])
                last[end[a:b][fits]] = which[a:b][fits]
            at = begin[by_length[:long_enough[j]]] + j
            bare = at[last[at] < 0]  # no piece ends here: a character of its own
            last[bare] = one + text[bare - 1]
        size = np.ones(one + 1, np.int64)
        size[1:one] = self.lengths
        places, symbols = [], []
        at, left = begin + length, begin
        while len(at):
            s = last[at]
            at = at - size[np.minimum(s, one)]
            places.append(at)
            symbols.append(s)
            more = at > left
            at, left = at[more], left[more]
        place, symbol = np.concatenate(places), np.concatenate(symbols)
        order = np.argsort(place)
        return place[order], symbol[order]

    def _relax_unigram(self, text: np.ndarray, begin: np.ndarray, length: np.ndarray, edges) -> tuple[np.ndarray, np.ndarray]:
        """One cut after the other, edge by edge."""
        low = min(self.score.values(), default=0.0) - 10.0  # an uncovered character
        start, end, which = (x.tolist() for x in edges)
        scores, one = [self.score[p] for p in self.names], len(self.names) + 1
        places, i, n = [], 0, len(start)
        for base, size in zip(begin.tolist(), length.tolist()):
            best, back, by = [0.0] + [NO_SCORE] * size, [0] * (size + 1), [0] * (size + 1)
            for j in range(1, size + 1):
                best[j], back[j], by[j] = best[j - 1] + low, j - 1, one + int(text[base + j - 1])
                while i < n and end[i] == base + j:
                    s = best[start[i] - base] + scores[which[i]]
                    if s > best[j]:
                        best[j], back[j], by[j] = s, start[i] - base, which[i] + 1
                    i += 1
            own, j = [], size
            while j:
                own.append((base + back[j], by[j]))
                j = back[j]
            places += own[::-1]
        out = np.array(places, np.int64).reshape(-1, 2)
        return out[:, 0], out[:, 1]

    def _ids(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each symbol has, and all ids: a piece has one, another
        character its bytes' or the unknown id."""
        size = np.ones(len(symbols), np.int64)
        bare = np.flatnonzero(symbols > len(self.names))
        own = {}
        for x in np.unique(symbols[bare]).tolist():
            c = chr(x - len(self.names) - 1)
            known = self.pieces.get(c)
            own[x] = [known[0]] if known else [self.bytes_at[b] for b in c.encode()] if self.bytes_at else [self.unknown]
        spelt = [own[x] for x in symbols[bare].tolist()]
        size[bare] = [len(x) for x in spelt]
        at = np.cumsum(size) - size
        ids = np.zeros(int(size.sum()), np.int32)
        piece = symbols <= len(self.names)
        ids[at[piece]] = self.id_of[symbols[piece] - 1]
        for a, x in zip(at[bare].tolist(), spelt):
            ids[a:a + len(x)] = x
        return size, ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        out, block, size = [], [], 0
        for t in texts:
            block.append(t)
            size += len(t)
            if size >= TEXT_CHARS:
                out += self._encode(block)
                block, size = [], 0
        return out + self._encode(block)

    def _encode(self, texts: list[str]) -> list[bytes]:
        cut = [self.cuts.findall(self.normalize(t)) for t in texts]
        if len(self.known) >= MEMO_CUTS:  # what was not used since the last time goes
            self.known, self.older = {}, self.known
        known, older, new = self.known, self.older, []
        for c in set().union(*cut):
            if c not in known:
                if c in older:
                    known[c] = older[c]
                else:
                    new.append(c)
        self.learn(new)
        return [b"".join([known[c] for c in cs]) for cs in cut]


class Decoder:
    def __init__(self, surfaces: list[bytes], leading: bool):
        self.surfaces, self.leading = surfaces, leading

    def decode(self, ids: list[int]) -> str:
        """A leading white-space mark is the one that normalisation added."""
        get = self.surfaces.__getitem__
        text = b"".join(map(get, ids)).decode("utf-8", "replace")
        return text[1:] if self.leading and text.startswith(" ") else text


@functools.lru_cache(maxsize=2)
def load(path: str) -> tuple[Matcher, Decoder]:
    """Once for each worker process."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    size = sp.get_piece_size()
    pieces, bytes_at, surfaces = {}, {}, [b""] * size
    for i in range(size):
        p = sp.id_to_piece(i)
        if sp.is_byte(i):
            bytes_at[int(p[3:-1], 16)] = i
            surfaces[i] = bytes([int(p[3:-1], 16)])
        elif sp.is_unknown(i):
            surfaces[i] = " ⁇ ".encode()
        elif not sp.is_control(i):
            surfaces[i] = p.replace(MARK, " ").encode()
            if not sp.is_unused(i):
                pieces[p] = (i, sp.get_score(i))
    table_ = [bytes_at[b] for b in range(256)] if len(bytes_at) == 256 else None
    leading = sp.normalize("a").startswith(MARK)
    return Matcher(pieces, _model_type(sp.serialized_model_proto()) == 2, table_, sp.unk_id(), sp.normalize), Decoder(surfaces, leading)


def _list_array(rows: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0] + [len(r) // 4 for r in rows]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(rows), np.int32)))


def ids_column(text: Column, path: str) -> Column:
    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        matcher = load(path)[0]
        parts = [_list_array(matcher.encode(texts.slice(a, ROWS).to_pylist())) for a in range(0, len(texts), ROWS)]
        return pa.concat_arrays(parts) if parts else _list_array([])

    return encode(or_empty(text))


def recoded(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_ids, ids, decoded), and the columns ``keep`` behind them:
    encoded and decoded again in one pass that holds ``ROWS`` rows at a time."""
    path = path or model_path()
    names = ["doc_id", "n_ids", "ids", "decoded", *keep]

    def each(batches):
        matcher, decoder = load(path)
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                rows = matcher.encode(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array([len(r) // 4 for r in rows], pa.int32()), _list_array(rows),
                    pa.array([decoder.decode(np.frombuffer(r, np.int32).tolist()) for r in rows], pa.string()),
                    *part.columns[2:]], names)

    rows = docs.select(docs[f"`{doc_id}`"].cast("long").alias("doc_id"), or_empty(docs[f"`{text}`"]).alias("text"), *[docs[f"`{c}`"] for c in keep])
    kept = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[2:])
    return small_batches(rows).mapInArrow(each, "doc_id long, n_ids int, ids array<int>, decoded string" + kept)


def text_column(ids: Column, path: str) -> Column:
    @F.arrow_udf("string")
    def decode(rows: pa.Array) -> pa.Array:
        decoder = load(path)[1]
        return pa.array([decoder.decode(x.values.to_numpy().tolist() if x.is_valid else []) for x in rows], pa.string())

    return decode(ids)


def encoded(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """Replaces ``text`` by ``ids`` (array<int>) and ``n_ids``."""
    docs = small_batches(docs)
    rest = [docs[f"`{c}`"] for c in docs.columns if c.lower() not in (text.lower(), "ids", "n_ids")]
    out = docs.select(*rest, ids_column(docs[f"`{text}`"], path or model_path()).alias("ids"))
    return out.withColumn("n_ids", F.size("ids"))


def decoded(docs: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """Adds ``decoded``, the text of the ids."""
    return small_batches(docs).withColumn("decoded", text_column(docs[f"`{ids}`"], path or model_path()))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recoded(table(spark, sf_dir, "documents"))

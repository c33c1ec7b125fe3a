"""Packing by order-preserving dynamic programming.

Documents follow one another in table order as one stream of token ids. Cuts may fall at document ends
(free) and sentence ends (a small penalty); a stretch of more than a quarter of a window without either may be cut
anywhere at a larger penalty. best[j] = min over i with p[j] - p[i] <= W of best[i] + W - (p[j] - p[i]) +
penalty[j] is a sliding-window minimum of best[i] + p[i], kept by a monotone queue. Cuts are final as far as
the best ways to all places that may come next agree, so what is packed is the optimum of the whole stream,
while only what is still open is held.

Within the last window of a stream, cuts may fall anywhere, and sequences whose length is a power of two, which need no
padding, are further choices of the same recurrence.

Each partition of the table is packed by itself without a shuffle, so a lost task is simply packed again
and gives the same sequences: they are numbered by partition and by place in it.

Defined results: a null or empty text is a document of the end id alone; repeated rows are packed one by
one; of ways that cost the same, the one found first is taken; a document longer than a window goes on in the next
sequences; an empty table gives no rows; only doc_id and text are read, so other columns may have any names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain
from unicodedata import normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Tokens between two attempts to make cuts final; sequences of one partition are numbered below 2**SEQUENCE_BITS.
STRETCH, SEQUENCE_BITS = 1 << 20, 40
#: Costs of a cut in padding tokens: at a sentence end, elsewhere.
SENTENCE_PENALTY, CUT_PENALTY = 4, 64
#: Chunks and words in a generation of a worker's memory; at about 200 bytes each.
CACHE_PIECES = 400_000
#: Marks after a word that are tokens of their own.
MARKS = ".,;:!?"
#: Bytes of text whose pieces are looked up together.
BATCH_BYTES = 4 << 20


class WordIds:
    """Little-endian unsigned 32-bit ids of texts, put together from remembered chunks between blanks.

    The vocabulary's normaliser and pre-tokeniser never join what stands on both sides of white space, so
    the ids of a text are those of its chunks, one after another.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        # a generation in use and the one before, so that what is frequent stays; words are chunks without a mark
        self.cache: dict[str, bytes] = {}
        self.old_cache = self.cache
        zero = self.model.encode("0", add_special_tokens=False).ids
        self.zero = zero[0] if len(zero) == 1 else None
        self.marks = {m: self._encode(m) for m in MARKS}
        vocab = self.model.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True

    def _encode(self, text: str) -> bytes:
        return np.asarray(self.model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _many(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without digits or blanks: one call on all of them, parted by a digit, which is a token of its own."""
        if not texts:
            return []
        if self.zero is not None:
            ids = np.asarray(self.model.encode_batch_fast([" 0 ".join(texts)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(ids == self.zero)
            if len(cuts) == len(texts) - 1:
                lo, hi = np.concatenate([[0], cuts + 1]), np.concatenate([cuts, [len(ids)]])
                raw = ids.tobytes()
                return [raw[4 * a : 4 * b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
        return [self._encode(t) for t in texts]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters only: one call on all of them, parted where a token ends a word."""
        ids = np.asarray(self.model.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4") if words else np.zeros(0, "<u4")
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(words):  # a letter here is none to the vocabulary, or its lower case isn't
            return self._many(words)
        raw, at = ids.tobytes(), [0, *(4 * stops).tolist()]
        return [raw[a:b] for a, b in zip(at, at[1:], strict=False)]

    def _learn(self, chunks: list[str]) -> None:
        """A word with at most one mark after it is looked up by the word, an ASCII one in lower case; other chunks are encoded as they are.

        A word has letters only, in the vocabulary's normal form too: an accent that comes off its letter there would join the mark.
        """
        cache, old, marks = self.cache, self.old_cache, self.marks
        parts, rest = [], []
        for chunk in chunks:
            ascii_ = chunk.isascii()
            low = chunk.lower() if ascii_ else chunk
            core, mark = (low[:-1], low[-1]) if low[-1:] in marks else (low, "")
            if core.isalpha() and (ascii_ or normalize("NFC", core).lower().isalpha()):
                parts.append((chunk, core, mark))
            else:
                rest.append(chunk)
        new = {core for _, core, _ in parts}.difference(cache)
        if old is not cache:
            cache.update({w: old[w] for w in new if w in old})
            new = new.difference(cache)
        words = list(new)
        cache.update(zip(words, self._words(words), strict=True))
        for chunk, core, mark in parts:
            if mark or core != chunk:
                cache[chunk] = cache[core] + marks[mark] if mark else cache[core]
        plain = [c for c in rest if not any(map(str.isnumeric, c))]
        cache.update(zip(plain, self._many(plain), strict=True))
        for chunk in rest:
            if chunk not in cache:
                cache[chunk] = self._encode(chunk)

    def encode(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        """The ids of each text; what a batch has many times is looked up once, an ASCII word apart from the mark after it."""
        if len(self.cache) > CACHE_PIECES:
            self.old_cache, self.cache = self.cache, {}
        flat, at = chunks(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        coded = flat.dictionary_encode()
        core, mark = parted(coded.dictionary)
        core = core.dictionary_encode()
        names = core.dictionary.to_numpy(zero_copy_only=False).tolist()
        pieces = list(map(self.cache.get, names))
        lacks = [k for k, piece in enumerate(pieces) if piece is None]
        new = [names[k] for k in lacks]
        self.cache.update({c: self.old_cache[c] for c in new if c in self.old_cache})
        self._learn([c for c in new if c not in self.cache])
        for k in lacks:
            pieces[k] = self.cache[names[k]]
        pieces += [*self.marks.values(), b""]
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
        # two pieces a chunk: its core and its mark, which may be the empty piece at the end
        which = np.column_stack([core.indices.to_numpy(), len(names) + mark])[coded.indices.to_numpy()].ravel()
        ids = np.frombuffer(b"".join(pieces), "<u4")[K.ragged((np.cumsum(sizes) - sizes)[which], sizes[which])]
        cuts = (4 * np.concatenate([[0], np.cumsum(sizes[which])])[2 * at]).tolist()
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def parted(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(the word in lower case, the number of the mark after it) of chunks that are ASCII letters and at most one mark; others whole, with a number beyond the marks."""
    low = pc.ascii_lower(texts)
    data, off = K.buffers(low)
    number = np.full(256, len(MARKS))
    number[list(MARKS.encode())] = range(len(MARKS))
    mark = np.full(len(texts), len(MARKS))
    some = off[1:] > off[:-1]
    mark[some] = number[data[off[1:][some] - 1]]
    core = pc.if_else(pa.array(mark < len(MARKS)), pc.utf8_slice_codeunits(low, 0, -1), low)
    word = pc.and_(pc.string_is_ascii(texts), pc.ascii_is_alpha(core))
    return pc.if_else(word, core, texts), np.where(word, mark, len(MARKS))


def chunks(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(what stands between the blanks of all texts, and how much of it is before each text and in all)."""
    texts = texts.fill_null("")
    data, _ = K.buffers(texts)
    if ((data >= 0x1C) & (data <= 0x1F)).any():  # for str.split() and Arrow these are blanks, for the vocabulary they aren't
        rows = [re.split("[ \t\n\r]+", t) if _ODD(t) else t.split() for t in texts.to_pylist()]
        return pa.array(chain.from_iterable(rows), pa.string()), np.cumsum([0, *map(len, rows)])
    rows = pc.utf8_split_whitespace(texts)
    at = rows.offsets.to_numpy()
    return rows.flatten(), at - at[0]


_ODD = re.compile("[\x1c-\x1f]").search


def word_ids(path: str) -> WordIds:
    return K.held(("words", path), lambda: WordIds(path))


def padding(length: int, window: int) -> int:
    return 0 if length & (length - 1) == 0 else window - length


def plan(points: np.ndarray, costs: np.ndarray, window: int, final: bool = True) -> list[int]:
    """Places of the chosen cuts: points[0] first, ascending, neighbours at most `window` apart.

    points ascend and costs are those of a cut there. If the stream is at its end, the last cut is points[-1], and points
    may also be reached by a sequence whose length is a power of two in the last window. Else the cuts are those on
    which the best ways to all points within a window of the last one agree.
    """
    p, c = points.tolist(), costs.tolist()
    last = len(p) - 1
    best, back = [0] * len(p), [0] * len(p)
    # the monotone queue, from head to end: places that may be the best start, and best + p of each, ascending
    places, keys, head, end = [0] * len(p), [p[0]] * len(p), 0, 1
    tail = p[last] - window if final else p[last]
    index = {x: j for j, x in enumerate(p) if x >= tail}
    for j in range(1, len(p)):
        at = p[j]
        floor = at - window
        while p[places[head]] < floor:
            head += 1
        i = places[head]
        cost = keys[head] + window - at
        if final and at > tail:
            for k in range(window.bit_length()):
                near = index.get(at - (1 << k))
                if near is not None and best[near] < cost:
                    i, cost = near, best[near]
        back[j] = i
        best[j] = cost = cost + c[j]
        key = cost + at
        while end > head and keys[end - 1] >= key:
            end -= 1
        places[end], keys[end] = j, key
        end += 1
    ways = {last} if final else {j for j in range(len(p)) if p[j] > p[last] - window}
    while len(ways) > 1:
        j = max(ways)
        ways.remove(j)
        ways.add(back[j])
    j = ways.pop()
    out = [j]
    while j:
        j = back[j]
        out.append(j)
    return [p[j] for j in reversed(out)]


def cut_points(ids: np.ndarray, ends: np.ndarray, enders: np.ndarray, window: int, final: bool) -> tuple[np.ndarray, np.ndarray]:
    """(places, costs) where cuts may fall in a stretch whose documents end at `ends`; at the stream's end, anywhere in the last window."""
    cost = np.full(len(ids) + 1, -1, np.int32)
    cost[1:][enders[ids]] = SENTENCE_PENALTY
    cost[ends] = 0
    cost[0] = cost[len(ids)] = 0
    points = np.flatnonzero(cost >= 0)
    gaps = np.flatnonzero(np.diff(points) > window // 4)
    for g in gaps:
        own = cost[points[g] + 1 : points[g + 1]]
        own[own < 0] = CUT_PENALTY
    if final:
        own = cost[max(0, len(ids) - window) :]
        own[own < 0] = CUT_PENALTY
    points = np.flatnonzero(cost >= 0)
    return points, cost[points]


class Packer:
    """Packs a stream of documents; `rows` collects (document, start, length, crc, tokens of it, sequence, offset)."""

    def __init__(self, first: int, window: int, enders: np.ndarray) -> None:
        self.sequence, self.window, self.enders = first, window, enders
        self.docs: list[tuple[int | None, int, int]] = []  # (id, tokens already packed, tokens in all)
        self.parts: list[np.ndarray] = []
        self.held, self.next = 0, STRETCH
        self.rows: list[tuple] = []

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc, 0, len(ids)))
        self.parts.append(ids)
        self.held += len(ids)
        if self.held >= self.next:
            self.pack(False)
            self.next = self.held + STRETCH

    def pack(self, final: bool) -> None:
        if not self.held:
            return
        ids = np.concatenate(self.parts)
        ends = np.cumsum([len(x) for x in self.parts])
        cuts = plan(*cut_points(ids, ends, self.enders, self.window, final), self.window, final)
        raw, at = memoryview(ids.tobytes()), 0
        d, begin = 0, 0  # the document at `at`, and where its held ids begin
        ends = ends.tolist()
        for cut in cuts[1:]:
            offset = 0
            while at < cut:
                doc, done, total = self.docs[d]
                stop = min(cut, ends[d])
                self.rows.append((doc, done + at - begin, stop - at, zlib.crc32(raw[4 * at : 4 * stop]), total, self.sequence, offset))
                offset += stop - at
                at = stop
                if at == ends[d]:
                    d, begin = d + 1, at
            self.sequence += 1
        if d < len(self.docs):
            doc, done, total = self.docs[d]
            self.docs = [(doc, done + at - begin, total), *self.docs[d + 1 :]]
            self.parts = [np.frombuffer(raw[4 * at : 4 * ends[d]], "<u4"), *self.parts[d + 1 :]]
        else:
            self.docs, self.parts = [], []
        self.held = sum(map(len, self.parts))

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [()] * 7
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[c.split()[0] for c in SCHEMA.split(", ")])


def pack_documents(docs: DataFrame, path: str, window: int = 4096, end_id: int = 2) -> DataFrame:
    """One row per piece of a document in a sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(path)
        vocab = words.model.get_vocab_size(with_added_tokens=True)
        enders = np.zeros(vocab, bool)
        for mark in (".</w>", "!</w>", "?</w>", "...</w>"):
            i = words.model.token_to_id(mark)
            if i is not None:
                enders[i] = True
        packer = Packer(TaskContext.get().partitionId() << SEQUENCE_BITS, window, enders)
        end = np.array([end_id], "<u4").tobytes()
        for b in K.slices(batches, limit=BATCH_BYTES):
            for doc, ids in zip(b.column("doc_id").to_pylist(), words.encode(b.column("text")), strict=True):
                packer.add(doc, np.frombuffer(ids + end, "<u4"))
            if packer.rows:
                yield packer.take()
        packer.pack(True)
        if packer.rows:
            yield packer.take()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(K.tidy(run), SCHEMA)

"""Token counts by a whole-token shortcut.

Proved once, before any text is read: each vocabulary string with a word's end is merged alone, and those that end as
one token form the table of whole tokens. In the texts, a pre-token in that table counts 1 without any merge; only the rest
is merged. The table has at most as many rows as the vocabulary and goes to the tasks as a broadcast.

Texts are taken in chunks between blanks, which the vocabulary's normaliser and pre-tokeniser never join; a worker
remembers the counts of chunks that it has met. Printable ASCII chunks are lower-cased and parted by the pattern here, others by the vocabulary's own
normaliser and pre-tokeniser; a chunk with a special token's string goes to the vocabulary as it is.

Defined results: a null or empty text has no bytes and no tokens; repeated rows are counted one by one; a text of any
length is read whole, and at exactly the limit it isn't over it; an empty table gives no rows; only doc_id and text are read,
so other columns may have any names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
#: Chunks that a worker remembers, and the longest of them in code points.
CACHE_CHUNKS, CACHE_LENGTH = 400_000, 64
#: The vocabulary's pre-tokens, for lower-cased printable ASCII without blanks. Fixed value.
ASCII_PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+"
#: Blanks that part chunks; all of them are blanks to the vocabulary.
BLANKS = re.compile("[ \t\n\r]+").split


def _library(path: str):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return model


def whole_tokens(path: str, suffix: str = "</w>") -> frozenset[str]:
    """The pre-tokens, in the vocabulary's own letters, that merge to one token each."""
    model = _library(path)
    words = [w.removesuffix(suffix) for w in model.get_vocab(with_added_tokens=False) if w.endswith(suffix) and w != suffix]
    return frozenset(w for w in words if len(model.model.tokenize(w)) == 1)


class Counter:
    """Counts tokens of texts; `proven` are whole_tokens()."""

    def __init__(self, path: str, proven: frozenset[str]) -> None:
        self.model = _library(path)
        self.proven, self.seen = proven, {"": 0}
        self.specials = [str(t.content) for t in self.model.get_added_tokens_decoder().values()]
        self.split = re.compile(ASCII_PRE_TOKENS).findall
        self.shortcut = self.merged = 0

    def _pre_tokens(self, chunk: str) -> list[str]:
        if chunk.isascii() and chunk.isprintable():
            return self.split(chunk.lower())
        return [p for p, _ in self.model.pre_tokenizer.pre_tokenize_str(self.model.normalizer.normalize_str(chunk))]

    def chunk(self, chunk: str) -> int:
        if any(s in chunk for s in self.specials):
            return len(self.model.encode(chunk, add_special_tokens=False).ids)
        n, proven, merge = 0, self.proven, self.model.model.tokenize
        for p in self._pre_tokens(chunk):
            if p in proven:
                n += 1
                self.shortcut += 1
            else:
                n += len(merge(p))
                self.merged += 1
        return n

    def count(self, text: str) -> int:
        seen, chunks = self.seen, BLANKS(text)
        if len(seen) > CACHE_CHUNKS:
            seen.clear()
            seen[""] = 0
        long = {}
        for c in set(chunks).difference(seen):
            (seen if len(c) <= CACHE_LENGTH else long)[c] = self.chunk(c)
        if long:
            return sum(seen[c] if c in seen else long[c] for c in chunks)
        return sum(map(seen.__getitem__, chunks))


def token_counts(spark: SparkSession, docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether they are over the limit, for every row of docs; no shuffle."""
    proven = spark.sparkContext.broadcast(whole_tokens(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = K.held(("counts", path), lambda: Counter(path, proven.value))
        for b in K.slices(batches):
            n = np.array([counter.count(t) if t else 0 for t in b.column("text").to_pylist()], np.int64)
            _, off = K.buffers(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(off)), pa.array(n), pa.array(n > limit)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(K.tidy(run), SCHEMA)

"""Cross-tokenizer alignment: packed bitsets of token ends, shared cuts by AND, token ranges by popcount rank.

A text is a blank and the text. Vocabulary A's and B's token ends are bits over its bytes. The AND of both bitsets has the cuts where
both end a token; the rank of a cut (set bits up to it, from running popcounts of 64-bit words) in either bitset is the number of
tokens before it, so neighbouring cuts give the two token ranges of a group. Every pair of a group's A and B tokens is a link.

Texts are parted into units before blanks, and before single line ends, that follow a non-blank character. Neither vocabulary has a
token across such a place: A's pattern always cuts there and no piece of B holds a blank or a line end after another character (checked when it is
loaded, else a text is one unit). So units are tokenised and aligned once, many of them as one long text, and remembered.

Texts are tokenised once: each row's figures, its distinct pairs of ids and the links of each are written, counted by pair, and read
again to look the counts up. The most frequent pairs, LOOKUP_ROWS at most, go to each task; links of rarer
pairs, each of which few documents hold, are joined by shuffle.

Defined results: a null or empty text, or one that either vocabulary doesn't give back byte by byte, has no tokens: zeros and an empty digest;
strings of special tokens are plain text; repeated rows count as documents of their own; a text of any length is aligned whole; an empty
table gives no rows; only doc_id and text are read, so other columns may have any names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .shared import Workspace

SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
#: Units in a generation of a worker's memory, of which there are two, and pairs of ids, beyond which it starts anew.
CACHE_UNITS, CACHE_PAIRS = 400_000, 1_000_000
#: Bytes of new units that are tokenised as one text.
JOINED_BYTES = 1 << 17
#: Most pairs whose counts go to each task, at 17 bytes each.
LOOKUP_ROWS = 1_000_000
#: Rows whose counts are looked up together.
SUMMED_ROWS = 1000
#: Groups with more pairs of tokens than this are expanded by distinct ids.
WIDE_GROUP = 256

_ODD = re.compile(r"\s\s|\x00").search
_UNIT_START = re.compile(r"(?<=\S)(?= |\n\S)").split
_SPACE = "▁"


def bitset(ends: np.ndarray, size: int) -> np.ndarray:
    """64-bit words with a bit set at each place in `ends`, of places up to `size`."""
    bits = np.zeros((size // 64 + 1) * 64, np.uint8)
    bits[ends] = 1
    return np.packbits(bits, bitorder="little").view("<u8")


def places(words: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))


def rank(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many bits are set at each place and before it."""
    counts = np.bitwise_count(words).astype(np.int64)
    before = np.cumsum(counts) - counts
    upto = ~np.uint64(0) >> (63 - (at & 63)).astype(np.uint64)
    return before[at >> 6] + np.bitwise_count(words[at >> 6] & upto)


def runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each run, one run after another."""
    total = int(sizes.sum())
    return np.arange(total) - np.repeat(np.cumsum(sizes) - sizes - starts, sizes)


class Grown:
    """A numpy array that grows at its end."""

    def __init__(self, kind: type) -> None:
        self.held, self.n = np.zeros(1024, kind), 0

    def extend(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.held):
            self.held = np.concatenate([self.held[: self.n], np.zeros(self.n + 2 * len(more) + 1024, self.held.dtype)])
        self.held[self.n : self.n + len(more)] = more
        self.n += len(more)

    @property
    def all(self) -> np.ndarray:
        return self.held[: self.n]


class Vocabularies:
    def __init__(self, a_path: str, b_path: str) -> None:
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=b_path)
        # the letters of byte-level entries stand for one byte each
        self.a_bytes = [b""] * self.a.get_vocab_size(with_added_tokens=True)
        letters = byte_letters()
        for entry, i in self.a.get_vocab(with_added_tokens=True).items():
            self.a_bytes[i] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.names = list(map(str, range(max(len(self.a_bytes), len(pieces)))))
        self.a_size, self.b_size = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        self.apart = not any(_SPACE in p.lstrip(_SPACE) or "\n" in p[1:] or p == "\n" for p in pieces)

    def units(self, text: str) -> list[str]:
        """The names of a text's units: a unit without its first blank, one that begins with a line end as it is, or \\x00 and the unit."""
        if not self.apart:
            return ["\x00 " + text]
        own = " " + text
        if _ODD(own):
            return ["\x00" + u for u in _UNIT_START(own)]
        return own.replace("\n", " \n").split(" ")[1:]

    @staticmethod
    def literal(name: str) -> str:
        first = name[:1]
        return name[1:] if first == "\x00" else name if first == "\n" else " " + name

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """A's ids of a blank and the text, and B's of the text; None unless both give back the bytes."""
        want = (" " + text).encode()
        a = self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids
        b = self.b.encode(text, num_threads=1) if text else []
        if b"".join(map(self.a_bytes.__getitem__, a)) != want or b"".join(map(self.b_bytes.__getitem__, b)) != want:
            return None
        return np.array(a, np.int64), np.array(b, np.int64)


def byte_letters() -> dict[str, int]:
    """The byte of each letter of byte-level vocabularies: printable bytes are their own letters, the others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


def aligned(voc: Vocabularies, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(byte offsets of shared cuts, A tokens up to each, B tokens up to each)."""
    a_ends, b_ends = np.cumsum(voc.a_size[a]), np.cumsum(voc.b_size[b])
    size = int(a_ends[-1])
    a_bits, b_bits = bitset(a_ends, size), bitset(b_ends, size)
    cuts = places(a_bits & b_bits)
    return cuts, rank(a_bits, cuts), rank(b_bits, cuts)


def linked(a: np.ndarray, b: np.ndarray, a_to: np.ndarray, b_to: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, pair of ids, links of the pair in the group), the pair as A's id times 2**32 plus B's."""
    a_from, b_from = np.concatenate([[0], a_to[:-1]]), np.concatenate([[0], b_to[:-1]])
    n_a, n_b = a_to - a_from, b_to - b_from
    wide = n_a * n_b > WIDE_GROUP
    g = np.flatnonzero(~wide)
    pairs = n_a[g] * n_b[g]
    of = np.repeat(g, pairs)
    k = runs(np.zeros(len(g), np.int64), pairs)
    groups, keys, times = [of], [a[a_from[of] + k // n_b[of]] << 32 | b[b_from[of] + k % n_b[of]]], [np.ones(len(of), np.int64)]
    for g in np.flatnonzero(wide).tolist():
        (x, nx), (y, ny) = np.unique(a[a_from[g] : a_to[g]], return_counts=True), np.unique(b[b_from[g] : b_to[g]], return_counts=True)
        keys.append((x[:, None] << 32 | y[None, :]).ravel())
        times.append(np.outer(nx, ny).ravel())
        groups.append(np.full(len(keys[-1]), g))
    return np.concatenate(groups), np.concatenate(keys), np.concatenate(times)


class Units:
    """What is remembered of units, by their numbers."""

    def __init__(self) -> None:
        self.at: dict[str, int] = {}
        self.strings: list[str] = []  # the groups
        self.figures = [Grown(np.int64) for _ in range(4)]  # n_a, n_b, n_groups, n_links
        self.good = Grown(np.bool_)
        self.first = Grown(np.int64)  # where a unit's pairs begin
        self.first.extend(np.zeros(1, np.int64))
        self.pairs, self.times = Grown(np.int64), Grown(np.int64)

    def add(self, names: list[str], strings: list[str], figures: list[np.ndarray], good: np.ndarray, n_pairs: np.ndarray, pairs: np.ndarray, times: np.ndarray) -> None:
        self.at.update(zip(names, range(len(self.at), len(self.at) + len(names)), strict=True))
        self.strings += strings
        for f, x in zip(self.figures, figures, strict=True):
            f.extend(x)
        self.good.extend(good)
        self.first.extend(self.pairs.n + np.cumsum(n_pairs))
        self.pairs.extend(pairs)
        self.times.extend(times)

    def take(self, other: Units, names: list[str]) -> None:
        """Units of an earlier generation."""
        at = np.fromiter(map(other.at.__getitem__, names), np.int64, len(names))
        n = np.diff(other.first.all)[at]
        p = runs(other.first.all[at], n)
        strings = [other.strings[i] for i in at.tolist()] if other.strings else []
        self.add(names, strings, [f.all[at] for f in other.figures], other.good.all[at], n, other.pairs.all[p], other.times.all[p])


class Aligner:
    """Units that have been aligned, and the pairs of ids that they link. The strings of their groups are kept if asked for."""

    def __init__(self, a_path: str, b_path: str, strings: bool = True) -> None:
        self.voc, self.keeps = Vocabularies(a_path, b_path), strings
        self.units, self.old = Units(), Units()
        self.pair_at: dict[int, int] = {}
        self.pair_keys = Grown(np.int64)

    def clear(self) -> None:
        """Forgets all pairs and units."""
        self.units, self.old, self.pair_at, self.pair_keys = Units(), Units(), {}, Grown(np.int64)

    def crowded(self) -> bool:
        return len(self.pair_at) > CACHE_PAIRS

    def learn(self, units: list[str]) -> None:
        """Aligns new units, many as one text; what ends with a blank only ends a text, so it is taken by itself."""
        old = self.old.at
        known = [u for u in units if u in old]
        if known:
            self.units.take(self.old, known)
            units = [u for u in units if u not in old]
        part, size = [], 0
        for u in units:
            if not u or u[-1].isspace() or u == "\x00":
                self._learn([u])
                continue
            part.append(u)
            size += len(u) + 1
            if size > JOINED_BYTES:
                self._learn(part)
                part, size = [], 0
        if part:
            self._learn(part)

    def _learn(self, units: list[str]) -> None:
        literals = list(map(self.voc.literal, units))
        # a known unit goes first, as B gives nothing for an empty text
        found = self.voc.tokens("a" + "".join(literals)) if self.voc.apart else (self.voc.tokens(literals[0][1:]) if len(units) == 1 else None)
        if found is None and len(units) > 1:
            half = len(units) // 2
            self._learn(units[:half])
            self._learn(units[half:])
            return
        if found is None:
            none = np.zeros(1, np.int64)
            self.units.add(units, [""] * self.keeps, [none] * 4, np.zeros(1, bool), none, none[:0], none[:0])
            return
        a, b = found
        cuts, a_to, b_to = aligned(self.voc, a, b)
        lead = 2 if self.voc.apart else 0  # bytes of the known unit
        ends = np.cumsum([len(u.encode()) for u in literals]) + lead
        last = np.searchsorted(cuts, ends)  # the group that ends with each unit
        start = int(np.searchsorted(cuts, lead, "right")) if lead else 0
        group, keys, times = linked(a, b, a_to, b_to)
        mine = group >= start
        group, keys, times = group[mine], keys[mine], times[mine]
        unit = np.searchsorted(last, group)
        # a pair's links in all groups of a unit together
        order = np.lexsort((keys, unit))
        unit, keys, times = unit[order], keys[order], times[order]
        new = np.ones(len(keys), bool)
        new[1:] = (unit[1:] != unit[:-1]) | (keys[1:] != keys[:-1])
        heads = np.flatnonzero(new)
        times = np.add.reduceat(times, heads) if len(heads) else times
        unit, keys = unit[heads], keys[heads]
        names = np.unique(keys)
        fresh = [k for k in names.tolist() if k not in self.pair_at]
        self.pair_at.update(zip(fresh, range(len(self.pair_at), len(self.pair_at) + len(fresh)), strict=True))
        self.pair_keys.extend(np.array(fresh, np.int64))
        local = np.fromiter(map(self.pair_at.__getitem__, names.tolist()), np.int64, len(names))
        begin = np.concatenate([[start], last[:-1] + 1])
        upto = lambda to: np.diff(np.concatenate([[to[start - 1] if start else 0], to[last]]))
        links = np.bincount(unit, weights=times, minlength=len(units)).astype(np.int64)
        strings = self._strings(a, b, a_to, b_to, begin, last) if self.keeps else []
        figures = [upto(a_to), upto(b_to), last + 1 - begin, links]
        self.units.add(units, strings, figures, np.ones(len(units), bool), np.bincount(unit, minlength=len(units)), local[np.searchsorted(names, keys)], times)

    def _strings(self, a: np.ndarray, b: np.ndarray, a_to: np.ndarray, b_to: np.ndarray, begin: np.ndarray, last: np.ndarray) -> list[str]:
        names = self.voc.names
        a_text, b_text = list(map(names.__getitem__, a.tolist())), list(map(names.__getitem__, b.tolist()))
        i = j = 0
        groups = []
        for x, y in zip(a_to.tolist(), b_to.tolist(), strict=True):
            left = a_text[i] if x == i + 1 else ",".join(a_text[i:x])
            groups.append(left + "|" + b_text[j] if y == j + 1 else left + "|" + ",".join(b_text[j:y]))
            i, j = x, y
        return [";".join(groups[x : y + 1]) for x, y in zip(begin.tolist(), last.tolist(), strict=True)]

    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(units of all texts as numbers, how many each text has); a text without tokens has none."""
        if len(self.units.at) > CACHE_UNITS:
            self.old, self.units = self.units, Units()
        rows = [self.voc.units(t) if t else [] for t in texts]
        new = set()
        for r in rows:
            new.update(r)
        self.learn(list(new.difference(self.units.at)))
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        flat = np.fromiter(map(self.units.at.__getitem__, chain.from_iterable(rows)), np.int64, int(sizes.sum()))
        bad = ~self.units.good.all[flat]
        if bad.any():
            of = np.repeat(np.arange(len(rows)), sizes)
            out = np.unique(of[bad])
            flat = flat[~np.isin(of, out)]
            sizes[out] = 0
        return flat, sizes


def by_text(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of runs of values."""
    upto = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(sizes)
    return upto[ends] - upto[ends - sizes]


def aligner(a_path: str, b_path: str) -> Aligner:
    return K.held(("aligner", a_path, b_path), lambda: Aligner(a_path, b_path))


def _input(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


TALLIED = "_row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, _pairs array<long>, _times array<long>"


def tallied(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """The figures and digest of every row of docs, its distinct pairs of ids and the links of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al = aligner(a_path, b_path)
        row = TaskContext.get().partitionId() << 40
        names = [c.split()[0] for c in TALLIED.split(", ")]
        for b in K.slices(batches):
            if al.crowded():
                al.clear()
            flat, sizes = al.batch(b.column("text").to_pylist())
            units, held = al.units, len(al.units.at) + 1
            figures = [by_text(f.all[flat], sizes) for f in units.figures]
            ends, own = np.cumsum(sizes).tolist(), flat.tolist()
            digests, start = [], 0
            for end in ends:
                digests.append(hashlib.sha256(";".join(map(units.strings.__getitem__, own[start:end])).encode()).hexdigest() if end > start else "")
                start = end
            key, often = np.unique(np.repeat(np.arange(len(sizes)), sizes) * held + flat, return_counts=True)
            text, unit = np.divmod(key, held)
            first = units.first.all
            n = first[unit + 1] - first[unit]
            p = runs(first[unit], n)
            held = al.pair_keys.n + 1
            key = np.repeat(text, n) * held + units.pairs.all[p]
            order = np.argsort(key, kind="stable")
            key = key[order]
            heads = np.flatnonzero(np.diff(key, prepend=-1))
            times = np.add.reduceat((units.times.all[p] * np.repeat(often, n))[order], heads) if len(heads) else np.zeros(0, np.int64)
            text, pair = np.divmod(key[heads], held)
            at = pa.array(np.searchsorted(text, np.arange(len(sizes) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in (al.pair_keys.all[pair], times)]
            made = [pa.array(np.arange(row, row + len(sizes))), b.column("doc_id"), *map(pa.array, figures), pa.array(digests, pa.string()), *lists]
            row += len(sizes)
            yield pa.RecordBatch.from_arrays(made, names=names)

    return _input(docs).mapInArrow(K.tidy(run), TALLIED)


def pair_counts(space: Workspace, rows: DataFrame) -> DataFrame:
    """pair, n: in how many of the tallied rows a pair of ids is linked, and best: whether n is the highest of its A id."""
    counted = space.save(rows.select(F.explode("_pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pairs")
    first = F.shiftright("pair", 32)
    best = counted.groupBy(first.alias("_a")).agg(F.max("n").alias("_n"))  # one row an id of A
    return counted.join(F.broadcast(best), first == F.col("_a")).select("pair", "n", (F.col("n") == F.col("_n")).alias("best"))


def least_frequent(counts: DataFrame, most: int) -> int:
    """The least power of two so that at most `most` pairs have that count or more; 1 if all have."""
    level = F.floor(F.log2("n")).cast("int")
    found = counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect()  # 64 rows at most
    total = 0
    for r in found:
        total += r["count"]
        if total > most:
            return 1 << r["level"] + 1
    return 1


def align(spark: SparkSession, docs: DataFrame, a_path: str, b_path: str, lookup_rows: int = LOOKUP_ROWS) -> DataFrame:
    """Counts of tokens, groups and links, the links' corpus-wide counts and a digest of the groups, for every row of docs."""
    space = Workspace(spark, "alignment")
    rows = space.save(tallied(docs, a_path, b_path), "tallied")
    counts = space.save(pair_counts(space, rows), "counts")
    least = least_frequent(counts, lookup_rows)
    known = counts.filter(F.col("n") >= least).orderBy("pair").toArrow()  # lookup_rows rows at most
    known = spark.sparkContext.broadcast(tuple(known[c].to_numpy() for c in ("pair", "n", "best")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.held(("no aligner",), lambda: None)  # what the first pass remembered isn't needed any more
        pair, count, best = known.value
        names = ["_row", "_pairs", "_times", *(c.split()[0] for c in SCHEMA.split(", "))]
        for batch in batches:
            for start in range(0, batch.num_rows, SUMMED_ROWS):
                b = batch.slice(start, SUMMED_ROWS)
                lists = b.column("_pairs")
                sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
                keys, times = lists.flatten().to_numpy(), b.column("_times").flatten().to_numpy()
                at = np.minimum(np.searchsorted(pair, keys), max(len(pair) - 1, 0))
                has = pair[at] == keys if len(pair) else np.zeros(len(keys), bool)
                value = np.where(has, count[at], 0) if len(pair) else np.zeros(len(keys), np.int64)
                top = np.where(has, best[at], False) if len(pair) else has
                sums = [by_text(x * times, sizes) for x in (top.astype(np.int64), value)]
                ends = pa.array(np.concatenate([[0], np.cumsum(by_text((~has).astype(np.int64), sizes))]).astype(np.int32))
                rest = [pa.ListArray.from_arrays(ends, pa.array(x[~has])) for x in (keys, times)]
                figures = [b.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
                yield pa.RecordBatch.from_arrays([b.column("_row"), *rest, *figures, *map(pa.array, sums), b.column("groups_sha256")], names=names)

    out = rows.mapInArrow(K.tidy(run), f"_row long, _pairs array<long>, _times array<long>, {SCHEMA}")
    if least == 1:  # every pair was at hand
        return out.drop("_row", "_pairs", "_times")
    out = space.save(out, "aligned")
    rest = out.select("_row", F.explode(F.arrays_zip("_pairs", "_times")).alias("x")).select("_row", F.col("x._pairs").alias("pair"), F.col("x._times").alias("t"))
    rest = rest.join(counts.filter(F.col("n") < least), "pair").groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("t")).otherwise(0)).alias("_best"), F.sum(F.col("t") * F.col("n")).alias("_sum"))
    more = lambda c, x: (F.col(c) + F.coalesce(F.col(x), F.lit(0))).alias(c)
    kept = [c.split()[0] for c in SCHEMA.split(", ")]
    return out.join(rest, "_row", "left").select(*[more(c, {"n_best": "_best", "count_sum": "_sum"}[c]) if c in ("n_best", "count_sum") else c for c in kept])

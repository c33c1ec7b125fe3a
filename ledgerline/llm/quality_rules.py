"""Quality rules with tokeniser fertility.

Base counts come from vectorised word, line and 5-word-window hashes. The method's verdict measures each
text with a public vocabulary: characters per token, the share of byte-fallback tokens and the entropy of
the token distribution, held against rejection bands.

Bands are taken from the corpus itself: of all texts that the base rule passes, those of one script, language
(column lang) and power of two of tokens give the median and the median deviation of each figure, over
histograms with fixed bins, so that the result doesn't depend on the order of rows; copies count once. What
lies over SPREAD deviations from the median fails; the fewer texts a group has, the less its median is trusted and the wider its band,
by a factor that falls towards one without a step. Texts without a language are a group like any other.
The fixed bands of the script are outer limits. A share of byte tokens counts as high as it surely is, by its lower confidence bound,
so that a few characters outside the vocabulary don't fail a short text.

Defined results: a null or empty text has no words, so it fails the base rule; repeated rows are judged
one by one, and so are texts of any length, read whole; a figure on a band's edge is inside; an empty table gives no rows; extra input columns are ignored by `quality_rules` and returned untouched by `keep_quality`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel as K
from .shared import Workspace, as_row, lookup, rows_of

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, script string, n_tokens long, chars_per_token double, byte_share double, token_entropy double, band_failed boolean"
)
#: Rejection bands by script: (least characters per token, most, most byte-fallback share, least entropy in bits). A vocabulary
#: without a script's letters gives a token for each of their two to four bytes and one more for a word's start.
BANDS = {
    "latin": (1.00, 12.0, 0.30, 2.5), "cyrillic": (0.70, 12.0, 0.50, 2.5), "greek": (0.60, 12.0, 0.60, 2.5), "armenian": (0.50, 12.0, 0.70, 2.5),
    "hebrew": (0.55, 12.0, 0.60, 2.5), "arabic": (0.55, 12.0, 0.60, 2.5), "syriac": (0.35, 12.0, 0.97, 2.3), "georgian": (0.55, 12.0, 0.60, 2.5),
    "indic": (0.28, 12.0, 0.98, 2.3), "southeast": (0.28, 12.0, 0.98, 2.3), "ethiopic": (0.25, 12.0, 0.98, 2.3),
    "hangul": (0.35, 12.0, 0.80, 2.5), "cjk": (0.30, 12.0, 0.90, 2.5), "other": (0.20, 12.0, 0.98, 2.0),
}
SCRIPTS = tuple(BANDS)
#: First code points of ranges and the script of the letters from there on; "" is none (signs, digits, emoji, private use).
RANGES = (
    (0xAA, "latin"), (0xAB, ""), (0xBA, "latin"), (0xBB, ""), (0xC0, "latin"), (0xD7, ""), (0xD8, "latin"), (0xF7, ""), (0xF8, "latin"), (0x2B0, ""),
    (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x700, "syriac"), (0x750, "arabic"), (0x780, "other"),
    (0x860, "syriac"), (0x870, "arabic"), (0x900, "indic"), (0xE00, "southeast"), (0xF00, "other"), (0x1000, "southeast"), (0x10A0, "georgian"), (0x1100, "hangul"),
    (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "southeast"), (0x1800, "other"), (0x1950, "southeast"), (0x1A00, "other"), (0x1A20, "southeast"),
    (0x1AB0, ""), (0x1B00, "other"), (0x1C80, "cyrillic"), (0x1C90, "georgian"), (0x1CC0, "other"), (0x1CD0, "indic"), (0x1D00, "latin"), (0x1DC0, ""),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, ""), (0x2C00, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x2D00, "georgian"), (0x2D30, "other"),
    (0x2D80, "ethiopic"), (0x2DE0, "cyrillic"), (0x2E00, ""), (0x2E80, "cjk"), (0x3000, ""), (0x3005, "cjk"), (0x3008, ""), (0x3021, "cjk"), (0x3130, "hangul"),
    (0x3190, "cjk"), (0x4DC0, ""), (0x4E00, "cjk"), (0xA000, "other"), (0xA640, "cyrillic"), (0xA6A0, "other"), (0xA700, ""), (0xA720, "latin"),
    (0xA800, "other"), (0xA8E0, "indic"), (0xA900, "other"), (0xA960, "hangul"), (0xA980, "other"), (0xA9E0, "southeast"), (0xAA00, "other"),
    (0xAA60, "southeast"), (0xAAE0, "other"), (0xAB00, "ethiopic"), (0xAB30, "latin"), (0xAB70, "other"), (0xAC00, "hangul"), (0xD800, ""), (0xF900, "cjk"),
    (0xFB00, "latin"), (0xFB13, "armenian"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, ""), (0xFE70, "arabic"), (0xFEFF, ""), (0xFF21, "latin"), (0xFF5B, ""),
    (0xFF66, "cjk"), (0xFFA0, "hangul"), (0xFFE0, ""), (0x10000, "other"), (0x1B000, "cjk"), (0x1B170, "other"), (0x1D000, ""), (0x1E000, "other"),
    (0x1E7E0, "ethiopic"), (0x1E800, "other"), (0x1EE00, "arabic"), (0x1F000, ""), (0x20000, "cjk"), (0x32000, ""),
)
#: Deviations from the median that a band of the corpus takes in, and the texts of a group for which it is twice as wide as for many.
SPREAD, TRUSTED_TEXTS = 4.0, 50
#: Tokens beyond this power of two don't part lengths any more.
LONGEST = 12
#: Least half-width of a derived band as a share of its median (characters per token, entropy).
LEAST_WIDTH = (0.03, 0.02)
#: Most byte share that a derived band always lets pass, and the standard errors of its lower bound.
BYTE_SHARE, BYTE_ERRORS = 0.10, 4.0
#: n tokens have log2(n) bits at most; a text's least entropy is this share of it, up to its script's.
ENTROPY_SHARE = 0.45
#: Words in a generation of a worker's memory of tokens.
CACHE_WORDS = 150_000

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LINE = np.zeros(256, bool)
_LINE[10] = True
_START = np.ones(256, bool)
_START[0x80:0xC0] = False
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_FROM = np.array([at for at, _ in RANGES])
_SCRIPT = np.array([-1, *(SCRIPTS.index(s) if s else -1 for _, s in RANGES)])


class Fertility:
    """Token ids of words by a sentencepiece vocabulary, remembered by word hash."""

    def __init__(self, model: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        self.size = self.model.get_piece_size()
        self.byte = np.array([self.model.is_byte(i) for i in range(self.size)], bool)
        self.known: dict[int, int] = {}
        self.clear()

    def clear(self) -> None:
        """Starts a new generation; words of the one before are taken over when they come again."""
        self.old = self.known and (self.known, self.at, self.ids)
        self.known = {}
        self.at, self.ids, self.n = np.zeros(1 << 15, np.int64), np.zeros(1 << 16, np.int32), 0

    def _learn(self, hashes: list[int], words: list[str]) -> None:
        self._add(hashes, self.model.encode(words, num_threads=1))

    def _add(self, hashes: list[int], rows: list) -> None:
        flat = np.fromiter(chain.from_iterable(rows), np.int32)
        ends = self.n + np.cumsum(np.fromiter(map(len, rows), np.int64, len(rows)))
        first, self.n = len(self.known), self.n + len(flat)
        self.ids = np.resize(self.ids, 2 * self.n) if self.n > len(self.ids) else self.ids
        self.at = np.resize(self.at, 2 * (first + len(rows) + 1)) if first + len(rows) >= len(self.at) else self.at
        self.ids[self.n - len(flat) : self.n] = flat
        self.at[first + 1 : first + 1 + len(rows)] = ends
        self.known.update(zip(hashes, range(first, first + len(rows)), strict=True))

    def tokens(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, tokens of each word)."""
        if len(self.known) > CACHE_WORDS:
            self.clear()
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        keys = distinct.tolist()
        missing = [i for i, h in enumerate(keys) if h not in self.known]
        if missing and self.old:
            known, at, ids = self.old
            seen = [keys[i] for i in missing if keys[i] in known]
            slots = [known[h] for h in seen]
            self._add(seen, [ids[at[k] : at[k + 1]] for k in slots])
            missing = [i for i in missing if keys[i] not in self.known]
        if missing:
            raw = data.tobytes()
            self._learn([keys[i] for i in missing], [raw[starts[first[i]] : ends[first[i]]].decode("utf-8", "replace") for i in missing])
        known = self.known
        slot = np.fromiter((known[h] for h in keys), np.int64, len(keys))[inverse]
        lens = self.at[slot + 1] - self.at[slot]
        return self.ids[K.ragged(self.at[slot], lens)], lens


def _fertility(model: str) -> Fertility:
    return K.held(("fertility", model), lambda: Fertility(model))


def scripts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Place in SCRIPTS of the script that most letters of each text have, Latin without any letters; of equals the first."""
    found = np.zeros((len(off) - 1, len(SCRIPTS)), np.int64)
    at = np.flatnonzero(data >= 0xC2)
    if len(at):
        lead = data[at].astype(np.int64)
        tail = [data[np.minimum(at + i, len(data) - 1)].astype(np.int64) & 0x3F for i in (1, 2, 3)]
        two, three = (lead & 0x1F) << 6 | tail[0], (lead & 0x0F) << 12 | tail[0] << 6 | tail[1]
        point = np.where(lead < 0xE0, two, np.where(lead < 0xF0, three, (lead & 0x07) << 18 | tail[0] << 12 | tail[1] << 6 | tail[2]))
        script = _SCRIPT[np.searchsorted(_FROM, point, "right")]
        doc = np.searchsorted(off, at, "right") - 1
        own = script >= 0
        found = np.bincount(doc[own] * len(SCRIPTS) + script[own], minlength=found.size).reshape(found.shape)
    found[:, 0] += K.per_doc(_LETTER[data], off)
    return found.argmax(1)


def measure(doc_ids: pa.Array, text: pa.Array, model: str, bands: dict, max_repeat: int, min_words: int) -> pa.RecordBatch:
    data, off = K.buffers(text)
    starts, ends, before = K.spans(data, off)
    n_words = np.diff(before)
    space = K.SPACE[data]
    word_chars = K.per_doc(_START[data] & ~space, off)
    n_symbols = K.per_doc(_SYMBOL[data], off)

    hashes = K.hash_spans(data, starts, ends)
    lo, hi, lines = K.spans(data, off, _LINE)
    words_in = np.searchsorted(starts, hi) - np.searchsorted(starts, lo)
    own = np.flatnonzero(words_in > 0)
    at = np.searchsorted(own, lines)
    _, later = K.repeated(K.hash_spans(data, lo[own], hi[own]), at)
    n_dup = K.per_doc(later, at)

    windows, wat = K.shingles(hashes, before)
    twice, _ = K.repeated(windows, wat)
    cover = np.zeros(len(starts) + 6, np.int32)
    hit = np.flatnonzero(twice)
    doc = np.searchsorted(wat, hit, "right") - 1
    first = before[doc] + hit - wat[doc]
    np.add.at(cover, first, 1)
    np.add.at(cover, first + 5, -1)
    n_repeat = K.per_doc(np.cumsum(cover)[: len(starts)] > 0, before)

    ids, lens = _fertility(model).tokens(data, starts, ends, hashes)
    tat = np.concatenate([[0], np.cumsum(lens)])[before]
    n_tokens = np.diff(tat)
    fert = _fertility(model)
    n_byte = K.per_doc(fert.byte[ids], tat)
    entropy = np.zeros(len(n_words))
    for d in np.flatnonzero(n_tokens):
        counts = np.bincount(ids[tat[d] : tat[d + 1]], minlength=1)
        p = counts[counts > 0] / n_tokens[d]
        entropy[d] = -(p * np.log2(p)).sum()
    some = np.maximum(n_tokens, 1)
    per_token, share = word_chars / some, n_byte / some
    script = scripts(data, off)
    band = np.array([bands.get(s, bands["other"]) for s in SCRIPTS])[script]
    out = (per_token < band[:, 0]) | (per_token > band[:, 1]) | (surely(share, some) > band[:, 2])
    out |= entropy < np.minimum(band[:, 3], ENTROPY_SHARE * np.log2(some))
    band_failed = out & (n_tokens > 0)
    base_failed = (n_words < min_words) | (100 * n_repeat > max_repeat * n_words)
    columns = [doc_ids, n_words, word_chars, n_symbols, n_dup, n_repeat, base_failed, ~(base_failed | band_failed), np.array(SCRIPTS)[script], n_tokens, per_token, share, entropy, band_failed]
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)


def surely(share, n, root=np.sqrt):
    """Wilson's lower bound of a share of n, BYTE_ERRORS standard errors under it: of numbers, arrays or columns (root: F.sqrt)."""
    z = BYTE_ERRORS * BYTE_ERRORS
    return (share + z / (2 * n) - BYTE_ERRORS * root(share * (1 - share) / n + z / (4 * n * n))) / (1 + z / n)


def _langs(docs: DataFrame) -> Column:
    return F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")


def derived_bands(figures: DataFrame) -> DataFrame:
    """key (script, power of two of tokens, language or none), n_rows, low, high, most, least of every group.

    figures: script, lang, size, n_tokens, word_chars, chars_per_token, byte_share, token_entropy of texts.
    """
    group = ["script", "size", "lang"]
    texts = figures.groupBy(*group, "n_tokens", "word_chars", F.round(F.col("token_entropy") * 1e6).cast("long").alias("e"), F.round("byte_share", 6).alias("byte_share"))
    texts = texts.agg(F.count("*").alias("rows"), F.first("chars_per_token").alias("c"))
    bin_ = lambda i, c: F.struct(F.lit(i).alias("f"), F.least(F.round(c * 100), F.lit(3000.0)).cast("int").alias("bin"))
    each = texts.select(*group, "rows", F.explode(F.array(bin_(0, F.col("c")), bin_(1, F.col("e") / 1e6), bin_(2, F.col("byte_share")))).alias("b")).select(*group, "rows", "b.*")
    bins = each.groupBy(*group, "f", "bin").agg(F.count("*").alias("n"), F.sum("rows").alias("rows"))
    key = [*group, "f"]

    def with_median(frame: DataFrame, value: str, name: str) -> DataFrame:
        own = Window.partitionBy(*key)
        before = F.sum("n").over(own.orderBy(value).rangeBetween(Window.unboundedPreceding, Window.currentRow))
        half = frame.withColumns({"_upto": before, "texts": F.sum("n").over(own)})
        return half.withColumn(name, F.min(F.when(2 * F.col("_upto") >= F.col("texts"), F.col(value))).over(own))

    middle = with_median(bins, "bin", "median").withColumn("off", F.abs(F.col("bin") - F.col("median")))
    spread = with_median(middle, "off", "mad").groupBy(*key).agg((F.first("median") / 100).alias("m"), (F.first("mad") * 0.014826).alias("d"), F.sum("rows").alias("n_rows"), F.first("texts").alias("texts"))
    of = lambda i, c: F.max(F.when(F.col("f") == i, F.col(c)))
    loose = 1 + TRUSTED_TEXTS / F.max("texts")
    wide = lambda i: loose * F.greatest(SPREAD * F.greatest(of(i, "d"), F.lit(0.01)), LEAST_WIDTH[i] * of(i, "m"))
    return spread.groupBy(*group).agg(
        F.max("n_rows").alias("n_rows"), (of(0, "m") - wide(0)).alias("low"), (of(0, "m") + wide(0)).alias("high"),
        (of(2, "m") + loose * F.greatest(SPREAD * of(2, "d"), F.lit(BYTE_SHARE))).alias("most"), (of(1, "m") - wide(1)).alias("least"),
    ).select(_key("script", "size", "lang").alias("_key"), "n_rows", F.struct("low", "high", "most", "least").alias("_band"))


def _key(script: str, size: str, lang: str) -> Column:
    return F.to_json(F.struct(F.col(script).alias("s"), F.col(size).alias("n"), F.col(lang).alias("l")))


def _outside(measured: DataFrame, space: Workspace) -> DataFrame:
    """measured (a struct _of of figures, base_failed among them, and lang in _lang) with _out: it lies outside the band derived for its group."""
    size = F.least(F.floor(F.log2(F.greatest(F.col("_of.n_tokens"), F.lit(1)))), F.lit(LONGEST)).cast("int")
    judged = measured.withColumns({"_size": size, "_script": F.col("_of.script")})
    good = judged.filter(~F.col("_of.base_failed") & (F.col("_of.n_tokens") > 0))
    good = good.select(F.col("_script").alias("script"), F.col("_lang").alias("lang"), F.col("_size").alias("size"), *[F.col(f"_of.{c}") for c in ("n_tokens", "word_chars", "chars_per_token", "byte_share", "token_entropy")])
    bands = space.save(derived_bands(good), "bands")
    n, rows = bands.count(), measured.count()
    judged = lookup(judged.withColumn("_key", _key("_script", "_size", "_lang")), bands, "_key", rows, n, "n_rows")
    per, share, entropy = (F.col(f"_of.{c}") for c in ("chars_per_token", "byte_share", "token_entropy"))
    sure = surely(share, F.greatest(F.col("_of.n_tokens"), F.lit(1)).cast("double"), F.sqrt)
    out = (per < F.col("_band.low")) | (per > F.col("_band.high")) | (sure > F.col("_band.most")) | (entropy < F.col("_band.least"))
    return judged.withColumn("_out", F.coalesce(out & (F.col("_of.n_tokens") > 0), F.lit(False)))


def quality_rules(docs: DataFrame, model: str, bands: dict | None = None, max_repeat: int = 20, min_words: int = 10) -> DataFrame:
    """One row per input row with the base counts, the fertility figures and the verdict; texts are read once and not shuffled."""
    bands, names = bands or BANDS, [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.slices(batches):
            own = measure(b.column("doc_id"), b.column("text"), model, bands, max_repeat, min_words)
            yield pa.RecordBatch.from_arrays([*own.columns, b.column("_lang")], names=[*names, "_lang"])

    space = Workspace(docs.sparkSession, "quality")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _langs(docs).alias("_lang"))
    measured = space.save(texts.mapInArrow(K.tidy(run), SCHEMA + ", _lang string"), "figures")
    judged = _outside(measured.select(F.struct(*names).alias("_of"), "_lang"), space)
    failed = F.col("_of.band_failed") | F.col("_out")
    verdict = {"band_failed": failed, "kept": ~(F.col("_of.base_failed") | failed)}
    return judged.select(*[verdict.get(c, F.col(f"_of.{c}")).alias(c) for c in names])


def keep_quality(docs: DataFrame, model: str, bands: dict | None = None) -> DataFrame:
    """The rows that the rules keep, with all their columns; they are written once with their figures, from which the bands come.

    A row goes through Python in one struct, so no name of its columns can clash with one of ours.
    """
    bands, names = bands or BANDS, [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, text in K.row_slices(batches):
            own = measure(pa.nulls(b.num_rows, pa.int64()), text, model, bands, 20, 10)
            yield pa.RecordBatch.from_arrays([b.column("_row"), b.column("_lang"), pa.StructArray.from_arrays(own.columns, names)], names=["_row", "_lang", "_of"])

    space = Workspace(docs.sparkSession, "quality")
    rows = docs.select(as_row(docs), _langs(docs).alias("_lang"))
    kinds = ", ".join(f"{c.split()[0]}: {c.split()[1]}" for c in SCHEMA.split(", "))
    schema = T.StructType([rows.schema["_row"], rows.schema["_lang"], T.StructField("_of", T._parse_datatype_string(f"struct<{kinds}>"))])
    measured = space.save(rows.mapInArrow(K.tidy(run), schema), "measured")
    judged = _outside(measured, space).filter("_of.kept AND NOT _out")
    return rows_of(judged, docs)

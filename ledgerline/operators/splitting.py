"""Texts in pieces of bounded size, by greedy packing on two levels.

A text that is too long is taken apart at its lines or its sentences, and neighbours are put together while they fit; what doesn't fit by
itself is taken apart at the next level, in the end at a fixed width. Packing depends on order, so a text's pieces are found in one place
(its own row), in Arrow batches and without a shuffle; each piece becomes a row.

Defined results: null and empty texts have no pieces, a text that fits is one piece as it stands, blank lines of a longer one are dropped, and
every other character is in exactly one piece.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.text import compact, public_text
from ledgerline.operators import parsing

#: Characters of a chunk of a live filing, of a piece of it that a search reads, and of a chunk by sentences.
LIVE_CHARS, SEARCH_CHARS, SENTENCE_CHARS = 8_000, 2_400, 3_500
#: Fixed value: what ends a sentence, with the blank after it.
SENTENCE_END = re.compile(r"(?<=[.다음니)]\s)")
#: Titles of sections where no markup tells them.
TITLES = (
    "연결재무제표", "재무제표", r"회사의?\s*개요", r"사업의\s*내용", r"재무에\s*관한\s*사항", r"이사의\s*경영진단", r"감사인의\s*감사의견", "이사회", r"주주에\s*관한\s*사항",
    r"임원\s*및\s*직원", "계열회사", r"이해관계자와의\s*거래", r"투자자\s*보호",
)
TITLE = re.compile(r"(?<![0-9A-Za-z가-힣])((?:[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩIVX]{1,4}\s*[.)]?\s*)?(?:" + "|".join(TITLES) + r")[^\n]{0,100})")


def packed(parts: Iterable[str], most: int, glue: str = "") -> Iterator[str]:
    """Neighbours joined by glue, as many as fit in `most`; a part that is longer stands by itself."""
    held: list[str] = []
    size = 0
    for part in parts:
        more = len(part) + (len(glue) if held else 0)
        if held and size + more > most:
            yield glue.join(held)
            held, size, more = [], 0, len(part)
        held.append(part)
        size += more
    if held:
        yield glue.join(held)


def by_lines(text: str, most: int = SEARCH_CHARS) -> list[str]:
    """Lines packed; a line that is too long is cut at a fixed width."""
    if len(text) <= most:
        return [text] if text else []
    return list(packed((line[i : i + most] for line in text.splitlines() for i in range(0, len(line), most)), most, "\n"))


def by_sentences(text: str, most: int = SENTENCE_CHARS) -> list[str]:
    """Sentences packed; one that is too long stays whole."""
    if len(text) <= most:
        return [text] if text else []
    return list(packed(filter(None, SENTENCE_END.split(text)), most))


def by_lines_and_sentences(text: str, most: int = SENTENCE_CHARS) -> list[str]:
    """Lines packed, too long ones at their sentences, too long sentences at a fixed width: nothing is longer than `most`."""
    if len(text) <= most:
        return [text] if text else []

    def fitting() -> Iterator[str]:
        for line in text.splitlines():
            for s in by_sentences(line, most):
                yield from (s[i : i + most] for i in range(0, len(s), most))

    return list(packed(fitting(), most, "\n"))


WAYS: dict[str, Callable[[str, int], list[str]]] = {"lines": by_lines, "sentences": by_sentences, "both": by_lines_and_sentences}


def pieces(rows: DataFrame, way: str, most: int, text: str = "text") -> DataFrame:
    """The other columns of rows with `piece` (from 1) and `text` for each piece of a row's text."""
    cut, kept = WAYS[way], [c for c in rows.columns if c != text]
    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept), "piece int", "text string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 256):
                own = b.slice(start, 256)
                found = [cut(t, most) if t else [] for t in own.column(text).to_pylist()]
                take = pa.array([i for i, f in enumerate(found) for _ in f], pa.int64())
                out = [own.column(c).take(take) for c in kept]
                numbers = pa.array([k for f in found for k in range(1, len(f) + 1)], pa.int32())
                yield pa.RecordBatch.from_arrays([*out, numbers, pa.array([p for f in found for p in f], pa.string())], names=[*kept, "piece", "text"])

    return rows.select(*kept, text).mapInArrow(run, schema)


def visible_lines(markup: Column) -> Column:
    """What a page shows, a line for each block, blanks collapsed."""
    bare = F.regexp_replace(markup, r"(?is)^\s*<\?xml[^>]*\?>|<(script|style)\b.*?</\1\s*>|<!--.*?-->", "")
    edges = F.regexp_replace(bare, r"(?i)</?(?:address|article|br|caption|div|h[1-6]|li|p|pre|section|td|th|tr|title[12]?|tu|te|table)\b[^>]*>", "\n")
    lines = F.transform(F.split(public_text(F.regexp_replace(edges, r"(?s)<[^>]*>", "")), r"\n"), compact)
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def titled_sections(text: str, name: str) -> list[tuple[str, str]]:
    """(path, body) by titles in running text; the whole text under the file's name if there is none."""
    found = list(TITLE.finditer(text))
    if not found:
        return [(f"원문 > {name}", text)]
    ends = [m.start() for m in found[1:]] + [len(text)]
    bodies = [(" ".join(m[1].split()), text[m.end() : e].strip()) for m, e in zip(found, ends, strict=True)]
    return [(path, body) for path, body in bodies if body]


def live_chunks(sources: DataFrame, most: int = LIVE_CHARS) -> DataFrame:
    """doc_id, rcept_no, src_file, document_sequence, attachment, source -> doc_id, document_sequence, path, part, n_chars, n_tables, text.

    Sources are parsed as markup; one that gives no chunk is read as the text it shows, by its titles. A path that a document has twice is numbered.
    """
    parsed = parsing.number_repeated_paths(parsing.parse_chunks(sources, most))
    key = ["doc_id", "document_sequence"]
    bare = sources.join(parsed.select(*key).distinct(), key, "left_anti").select(
        *key, "src_file", "attachment", F.size(F.regexp_extract_all("source", F.lit("(?i)(<table\\b)"), F.lit(1))).alias("n_tables"), visible_lines(F.col("source")).alias("text")
    ).filter("text <> ''")
    types = {"doc_id": pa.string(), "document_sequence": pa.int32(), "n_tables": pa.int32(), "path": pa.string(), "section": pa.int32(), "part": pa.int32(), "text": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                for s, (path, body) in enumerate(titled_sections(r["text"], r["src_file"])):
                    path = f"[attachment] {path}" if r["attachment"] else path
                    rows += [(r["doc_id"], r["document_sequence"], r["n_tables"] * (s == 0), path, s, i // most + 1, body[i : i + most]) for i in range(0, len(body), most)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types.values(), strict=True)], names=list(types))

    shown = bare.mapInArrow(run, "doc_id string, document_sequence int, n_tables int, path string, section int, part int, text string")
    nth = F.dense_rank().over(Window.partitionBy("doc_id", "path").orderBy("document_sequence", "section"))
    shown = shown.withColumn("path", F.when(nth > 1, F.concat("path", F.lit(" ("), nth, F.lit(")"))).otherwise(F.col("path")))
    out = [*key, "path", "part", "n_tables", "text"]
    both = parsed.select(*out).unionByName(shown.select(*out))
    return both.withColumn("n_chars", F.length("text"))

"""Facts from the tables and sentences of section chunks.

Markdown tables become one long relation of cells (chunk, table, row, label, column, header, value, unit). What the
reference reads with one extractor per topic are filters and aggregates over it: operand rows, current-period
columns, totals that must equal the sum of their members, values that must agree across passages. Whatever is
missing or in conflict abstains and says why in `state`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.numbers import accounting, in_won
from ledgerline.functions.text import row_label
from ledgerline.operators.workflows import measure_of

CELLS = "chunk_id string, table_no int, row_no int, label string, column_no int, header string, value string, unit string, even boolean"
_UNIT = re.compile(r"단위\s*[:：]\s*([^)\]\n]+)")
#: Headers of the current period.
CURRENT = r"당기|당분기|당반기|제\s*[0-9]+\s*기|현재"
#: Common facts and the labels that name them.
FACTS = {"dividend_per_share": "주당\\s*현금배당금|주당배당금", "payout_ratio": "현금배당성향", "dividend_total": "현금배당금총액", "employees": "직원수|직원의수|총직원", "largest_shareholder": "최대주주", "segment_sales": "부문|사업부"}
#: Funding types of a period.
FUNDING = ("회사채", "전환사채", "유상증자", "기업어음", "단기사채")
#: Topics and the words that make a sentence one of theirs.
TOPICS = {"research": "연구개발|R&D|기술개발", "currency": "환율|환위험|외환", "plan": "계획|예정|추진", "market": "시장점유율|시장 규모|경쟁", "raw_material": "원재료|원자재", "customer": "고객|매출처|수주", "investment": "설비|투자|증설", "environment": "환경|탄소|온실가스", "risk": "위험|리스크|불확실"}
MOST_SENTENCES = 3


def _tables(text: str) -> Iterator[tuple[list[str], list[list[str]], str | None]]:
    """(header, rows, unit) of the Markdown tables of a text; a unit stands in the lines above."""
    lines, unit, i = text.split("\n"), None, 0
    cells = lambda s: [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", s.strip()[1:].removesuffix("|"))]
    while i < len(lines):
        if (m := _UNIT.search(lines[i])) and not lines[i].startswith("|"):
            unit = m[1].strip()
        if lines[i].startswith("|") and i + 1 < len(lines) and re.fullmatch(r"\|(?:\s*:?-{3,}:?\s*\|)+", lines[i + 1].strip()):
            head, j = cells(lines[i]), i + 2
            if m := _UNIT.search(lines[i]):
                unit = m[1].strip()
            while j < len(lines) and lines[j].startswith("|"):
                j += 1
            yield head, [cells(x) for x in lines[i + 2 : j]], unit
            unit, i = None, j
        else:
            i += 1


def table_cells(chunks: DataFrame) -> DataFrame:
    """One row per cell beside the label of its row, and whether the row is as wide as the header; no shuffle."""
    names = [c.split()[0] for c in CELLS.split(", ")]
    types = [{"int": pa.int32(), "boolean": pa.bool_()}.get(c.split()[1], pa.string()) for c in CELLS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for chunk, text in zip(b.column("chunk_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                for t, (head, body, unit) in enumerate(_tables(text or "")):
                    for r, own in enumerate(body):
                        rows += [(chunk, t, r, own[0], c, head[c] if c < len(head) else "", own[c], unit, len(own) == len(head)) for c in range(1, len(own))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return chunks.select("chunk_id", "text").mapInArrow(run, CELLS)


def operand_rows(cells: DataFrame) -> DataFrame:
    """Cells of rows that name a measure, in tables with a unit."""
    return cells.withColumn("measure", measure_of(F.col("label"))).filter("measure IS NOT NULL AND unit IS NOT NULL")


def current_column(cells: DataFrame) -> DataFrame:
    """The first column of the current period, else the first column."""
    key = ["chunk_id", "table_no", "row_no"]
    pick = F.coalesce(F.min(F.when(F.col("header").rlike(CURRENT), F.col("column_no"))), F.min("column_no"))
    first = cells.groupBy(*key).agg(pick.alias("column_no"))
    return cells.join(first, [*key, "column_no"], "left_semi")


def common_facts(cells: DataFrame, by: DataFrame) -> DataFrame:
    """by: chunk_id -> rcept_no. One row per filing and fact: its value if all its cells agree."""
    clean = row_label(F.col("label"))
    fact = None
    for name, words in FACTS.items():
        fact = F.when(clean.rlike(words), name) if fact is None else fact.when(clean.rlike(words), name)
    rows = current_column(cells).withColumn("fact", fact).filter("fact IS NOT NULL AND NOT value IN ('', '-')").join(by.select("chunk_id", "rcept_no"), "chunk_id")
    out = rows.groupBy("rcept_no", "fact").agg(F.count_distinct("value").alias("k"), F.min("value").alias("value"), F.min("unit").alias("unit"))
    return out.withColumns({"state": F.when(F.col("k") == 1, "ok").otherwise("conflict"), "value": F.when(F.col("k") == 1, F.col("value"))}).drop("k")


def funding_by_type(cells: DataFrame) -> DataFrame:
    """Totals of the funding types in won; types without a row are marked, not zero."""
    kinds = cells.sparkSession.createDataFrame([(k,) for k in FUNDING], "kind string")
    rows = cells.join(F.broadcast(kinds), F.contains(row_label(F.col("label")), F.col("kind")))
    won = in_won(accounting(F.col("value")), F.coalesce("unit", F.lit("원")))
    sums = current_column(rows).groupBy("kind").agg(F.sum(won).alias("total"), F.count("*").alias("n"))
    return kinds.join(sums, "kind", "left").withColumn("state", F.when(F.col("n").isNull(), "absent").otherwise("present"))


def executive_pay(chunks: DataFrame, person: str) -> DataFrame:
    """The total pay of one person by filing; several different totals conflict."""
    cells = table_cells(chunks).filter(F.regexp_replace("label", r"\s", "") == re.sub(r"\s", "", person))
    pay = cells.filter(F.col("header").rlike("보수\\s*총액|총\\s*보수|합계")).withColumn("v", accounting(F.col("value"))).filter("v IS NOT NULL").join(chunks.select("chunk_id", "rcept_no"), "chunk_id")
    out = pay.groupBy("rcept_no").agg(F.count_distinct("v").alias("k"), F.max("v").alias("total"), F.min("unit").alias("unit"))
    return out.select("rcept_no", F.when(F.col("k") == 1, F.col("total")).alias("total"), "unit", F.when(F.col("k") == 1, "ok").otherwise("conflict").alias("state"))


def company_profile(chunks: DataFrame) -> DataFrame:
    """Founding date, head office and chief executives by filing; what differs between passages is left out."""
    text = F.col("text")
    rows = chunks.select(
        "rcept_no", F.nullif(F.regexp_extract(text, r"([0-9]{4}년\s*[0-9]{1,2}월\s*[0-9]{1,2}일)[^.\n]{0,20}설립", 1), F.lit("")).alias("founded"),
        F.nullif(F.trim(F.regexp_extract(text, r"본점\s*소재지\s*[:|]?\s*([^\n|]{4,80})", 1)), F.lit("")).alias("address"),
        F.nullif(F.trim(F.regexp_extract(text, r"대표이사\s*[:|]?\s*([가-힣]{2,4}(?:\s*,\s*[가-힣]{2,4})*)", 1)), F.lit("")).alias("ceos"),
    )
    one = lambda c: F.when(F.count_distinct(c) == 1, F.min(c)).alias(c)
    return rows.groupBy("rcept_no").agg(one("founded"), one("address"), one("ceos"))


def sentences(c: Column) -> Column:
    """Sentences by their ends, tables left out."""
    plain = F.regexp_replace(c, r"(?m)^\|.*$", "")
    return F.filter(F.transform(F.split(plain, r"(?<=[.!?])\s+|\n+"), lambda x: F.trim(x)), lambda s: s.rlike(r"[.!?]$") & (F.length(s) >= 10))


def topic_sentences(chunks: DataFrame, topics: dict[str, str] | None = None) -> DataFrame:
    """The first sentences of each topic by filing, in document order, distinct."""
    from ledgerline.operators.analysis import first_per

    topics = topics or TOPICS
    tags = F.array_compact(F.array(*(F.when(F.col("sentence").rlike(w), t) for t, w in topics.items())))
    rows = chunks.select("rcept_no", "document_sequence", "chunk_id", F.posexplode(sentences(F.col("text"))).alias("pos", "sentence"))
    rows = rows.withColumn("topic", F.explode(tags))
    once = first_per(rows, ["rcept_no", "topic", "sentence"], ["document_sequence", "chunk_id", "pos"])
    return first_per(once, ["rcept_no", "topic"], ["document_sequence", "chunk_id", "pos"], MOST_SENTENCES).select("rcept_no", "topic", "document_sequence", "chunk_id", "pos", "sentence")


def issuer_name(c: Column, company: str) -> Column:
    """Words for the issuer replaced by its name, with the particle that its last sound takes."""
    last = company[-1]
    closed = "가" <= last <= "힣" and (ord(last) - ord("가")) % 28 > 0
    pairs = (("은|는", "은" if closed else "는"), ("이|가", "이" if closed else "가"), ("을|를", "을" if closed else "를"), ("과|와", "과" if closed else "와"))
    for old, new in pairs:
        c = F.regexp_replace(c, rf"(?:당사|회사|지배기업)(?:{old})(?![가-힣])", company + new)
    return F.regexp_replace(c, r"(?:당사|지배기업)(?![가-힣])", company)


def short_links(c: Column) -> Column:
    """Citation links to their receipts and back, see long_links."""
    return F.regexp_replace(c, r"\[([0-9]{14})\]\(https://[^)\s]*?rcpNo=\1\)", "[$1]")


def long_links(c: Column, base: str) -> Column:
    return F.regexp_replace(c, r"\[([0-9]{14})\](?!\()", rf"[\$1]({base}?rcpNo=\$1)".replace("\\$", "$"))

"""Interim statements: texts of structured rows, and figures out of tables with one or two header rows.

A section's lines are rows in document order. What a line says of those below it (unit, statement, terms, three months or cumulative) is
carried down by windows over the section, also from the chunk before but no further. Each number then knows its term and kind by the
place of its cell. Rows that name one measure must agree; what has no unit, no term or no kind abstains.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.numbers import WON, accounting, accounting_text
from ledgerline.functions.text import compact, row_label, table_cells
from ledgerline.operators.workflows import basis_of, measure_of, quarter_value
from ledgerline.session import dealt

#: Report codes, the word for the report's period, its last month and its quarter.
REPORTS = {"11011": ("사업", 12, 4), "11012": ("반기", 6, 2), "11013": ("1분기", 3, 1), "11014": ("3분기", 9, 3)}
ANNUAL = "11011"
#: The terms of statement rows, their labels and fields.
TERMS = (("당기", "thstrm"), ("전기", "frmtrm"), ("전전기", "bfefrmtrm"))


def statement_key(rows: DataFrame) -> DataFrame:
    """rows with `basis` (CFS, OFS) and `statement` (BS, IS), told by their names where the codes say nothing."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")) if c in rows.columns else F.lit("")
    fs, sj = F.upper(F.coalesce(F.nullif("fs_div", F.lit("")), F.lit("CFS"))), F.upper(F.coalesce(F.nullif("sj_div", F.lit("")), F.lit("IS")))
    basis = F.when(fs.isin("CFS", "OFS"), fs).when(F.contains(text("fs_nm"), F.lit("연결")), "CFS").otherwise("OFS")
    told = F.when(sj.isin("BS", "IS", "CIS"), sj).when(F.contains(text("sj_nm"), F.lit("상태")), "BS").otherwise("IS")
    return rows.withColumns({"basis": basis, "statement": F.when(told == "BS", "BS").otherwise("IS")})


def statement_texts(rows: DataFrame) -> DataFrame:
    """One text per filing, basis and statement: path, terms, unit and a table in the order of the rows.

    Annual reports have three terms; interim income has three months and cumulative for two terms, an interim balance the period's end. A missing
    cumulative amount is that of the three months. Rows come by `ord` (what is no number last), then by name.
    """
    keyed = statement_key(rows)
    have = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    place = F.coalesce(F.col("ord").try_cast("int"), F.lit(2147483647))
    cell = lambda c: accounting_text(have(c))
    total = lambda t: accounting_text(F.coalesce(F.nullif(have(f"{t}_add_amount"), F.lit("")), have(f"{t}_amount")))
    name = F.trim(F.coalesce("account_nm", F.lit("")))
    row = lambda *cells: F.concat(F.lit("| "), F.concat_ws(" | ", name, *cells), F.lit(" |"))
    annual, income = F.col("reprt_code") == ANNUAL, F.col("statement") == "IS"
    three = [cell(f"{t}_amount") for _, t in TERMS]
    line = F.when(annual, row(*three)).when(income, row(three[0], total("thstrm"), three[1], total("frmtrm"))).otherwise(row(*three[:2]))
    terms = [F.concat_ws(" · ", F.nullif(compact(have(f"{t}_nm")), F.lit("")), F.nullif(compact(have(f"{t}_dt")), F.lit(""))) for _, t in TERMS]
    said = F.array_compact(F.array(*(F.when(t != "", F.concat(F.lit(f"{label}: "), t)) for (label, _), t in zip(TERMS, terms, strict=True))))
    one = F.struct(place.alias("place"), compact(F.col("account_nm")).alias("by_name"), line.alias("line"), said.alias("said"), have("currency").alias("currency"))
    key = ["rcept_no", "reprt_code", "basis", "statement"]
    lists = keyed.select(*key, one.alias("x")).groupBy(*key).agg(F.array_sort(F.collect_list("x")).alias("xs"))  # a statement of one filing
    word = F.lit(None).cast("string")
    for code, (w, _, _) in REPORTS.items():
        word = F.when(F.col("reprt_code") == code, w).otherwise(word)
    head = (
        F.when(annual, "| 계정과목 | 당기 | 전기 | 전전기 |\n|---|---|---|---|")
        .when(income, F.concat(F.lit("| 계정과목 | 당기 "), word, F.lit(" 3개월 | 당기 "), word, F.lit(" 누적 | 전기 "), word, F.lit(" 3개월 | 전기 "), word, F.lit(" 누적 |\n|---|---|---|---|---|")))
        .otherwise(F.concat(F.lit("| 계정과목 | 당기 "), word, F.lit("말 | 전기말 |\n|---|---|---|")))
    )
    path = F.concat(F.when(F.col("basis") == "CFS", "연결재무제표").otherwise("재무제표"), F.lit(" > "), F.when(income, "손익계산서").otherwise("재무상태표"))
    money = F.coalesce(F.nullif(F.col("xs")[0]["currency"], F.lit("")), F.lit("KRW"))
    unit = F.concat(F.lit("(단위 : "), F.when(money.isin("KRW", "원"), "원").otherwise(money), F.lit(")"))
    body = F.concat(F.array(F.concat(F.lit("["), path, F.lit("]"))), F.col("xs")[0]["said"], F.array(unit, head), F.transform("xs", lambda x: x["line"]))
    return lists.select(*key, path.alias("path"), F.array_join(body, "\n").alias("text"), F.size("xs").alias("n_rows"))


def interim_measure(label: Column) -> Column:
    """The measure that a row's label names; net income is also called by its quarter or half."""
    plain = F.regexp_replace(row_label(label), r"\(주[0-9,\s]*\)$", "")
    plain = F.regexp_replace(plain, "^(?:연결)?(?:분기|반기)(?:연결)?[순손](이익|손익|손실)", "당기순$1")
    return measure_of(plain)


def statement_values(chunks: DataFrame) -> DataFrame:
    """doc_id, path, sequence, text -> a row per number: measure, term (0 is the current one), kind (three_months, cumulative or single), value, unit.

    sequence: of the chunks in a document. A value without a readable header above it isn't told.
    """
    # a chunk counts for eight of its lines
    chunks = dealt(chunks.select("doc_id", "path", "sequence", "text"), 8 * chunks.count(), "doc_id")
    lines = chunks.select("doc_id", "path", "sequence", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    cells = F.when(F.col("line").startswith("|") & ~F.col("line").rlike(r"^\|(?:\s*:?-{3,}:?\s*\|)+\s*$"), table_cells(F.col("line")))
    lines = lines.withColumn("cells", cells)
    others = F.filter("cells", lambda x, i: i > 0)
    numbers = F.filter(others, lambda x: accounting(x).isNotNull())
    names_term = lambda x: x.rlike(r"제\s*[0-9]+\s*기|당기|전기|당분기|당반기|전분기|전반기")
    names_kind = lambda x: x.rlike("3개월|누적")
    wide = F.size("cells") > 1
    terms = F.when(wide & (F.size(numbers) == 0) & F.exists(others, names_term), F.col("cells"))
    kinds = F.when(wide & (F.size(numbers) == 0) & F.exists(others, names_kind), F.col("cells"))
    unit = F.nullif(F.trim(F.regexp_extract("line", r"단위\s*[:：]\s*([^)\]|]+)", 1)), F.lit(""))
    title = F.when(F.col("line").rlike("손익계산서"), "IS").when(F.col("line").rlike("재무상태표"), "BS")
    above = Window.partitionBy("doc_id", "path").orderBy("sequence", "n").rowsBetween(Window.unboundedPreceding, 0)

    def carried(what: Column) -> Column:
        last = F.last(F.when(what.isNotNull(), F.struct(what.alias("v"), F.col("sequence").alias("s"), F.col("n").alias("at"))), ignorenulls=True).over(above)
        return F.when(last["s"] >= F.col("sequence") - 1, last)

    told = lines.withColumns({"_unit": carried(unit), "_title": carried(title), "_terms": carried(terms), "_kinds": carried(kinds)})
    rows = told.filter(terms.isNull() & kinds.isNull() & (F.size(numbers) > 0)).withColumn("measure", interim_measure(F.get("cells", 0))).filter("measure IS NOT NULL")
    # words for kinds that stand above the terms belong to another table
    follows = (F.col("_kinds.s") > F.col("_terms.s")) | ((F.col("_kinds.s") == F.col("_terms.s")) & (F.col("_kinds.at") >= F.col("_terms.at")))
    blank = F.transform("cells", lambda x: F.lit(""))  # words for kinds may stand in the terms
    rows = rows.withColumn("kinds", F.coalesce(F.when(follows, F.col("_kinds.v")), blank)).filter((F.size("_terms.v") == F.size("cells")) & (F.size("kinds") == F.size("cells")))
    numbered = F.transform("_terms.v", lambda x: F.nullif(F.regexp_extract(x, r"제\s*([0-9]+)\s*기", 1), F.lit("")).cast("int"))
    each = rows.withColumns({"numbered": numbered, "newest": F.array_max(numbered)}).select(
        "doc_id", "path", "sequence", "n", "measure", F.col("_unit.v").alias("unit"), F.col("_title.v").alias("statement"), "newest", F.posexplode(F.arrays_zip("cells", F.col("_terms.v").alias("terms"), "kinds", "numbered")).alias("column", "c"),
    )
    head = F.col("c.terms")
    term = F.when(F.col("c.numbered").isNotNull(), F.col("newest") - F.col("c.numbered")).when(head.rlike("전전기"), 2).when(head.rlike("전기|전분기|전반기"), 1).when(head.rlike("당기|당분기|당반기"), 0)
    word = F.when(F.col("c.kinds") == "", head).otherwise(F.col("c.kinds"))
    kind = F.when(F.contains(word, F.lit("누적")), "cumulative").when(F.contains(word, F.lit("3개월")), "three_months").otherwise("single")
    value = accounting(F.col("c.cells"))
    return each.select("doc_id", "path", "statement", "measure", term.alias("term"), kind.alias("kind"), value.alias("value"), "unit", "column").filter("column > 0 AND value IS NOT NULL AND term IS NOT NULL")


def interim_figures(values: DataFrame) -> DataFrame:
    """doc_id, basis, measure, term -> three_months, cumulative, single, unit, state. Rows that name one measure must agree in value and unit."""
    of = lambda k: F.when(F.col("kind") == k, F.col("value"))
    one = lambda k: F.when(F.min(of(k)) == F.max(of(k)), F.max(of(k))).alias(k)
    many = lambda c: F.coalesce(F.min(c) != F.max(c), F.lit(False))
    own = values.withColumn("basis", basis_of(F.col("path"))).groupBy("doc_id", "basis", "measure", "term").agg(
        *map(one, ("three_months", "cumulative", "single")), F.min("unit").alias("unit"),
        (many(of("three_months")) | many(of("cumulative")) | many(of("single")) | many(F.col("unit"))).alias("differs"),
    )
    known = F.col("unit").isin(*WON)
    return own.withColumn("state", F.when(F.col("differs"), "conflict").when(~F.coalesce(known, F.lit(False)), "unit_unknown").otherwise("ok")).drop("differs")


def interim_answers(asked: DataFrame, figures: DataFrame) -> DataFrame:
    """asked: doc_id, basis, measure, quarter, cumulative (whether that was asked for) -> value, unit, state of the current term.

    Three months by default; in the first quarter a blank one is the cumulative amount.
    """
    key = ["doc_id", "basis", "measure"]
    rows = 2 * asked.count()
    found = dealt(asked, rows, "doc_id").join(dealt(figures.filter("term = 0").drop("term"), rows, "doc_id"), key, "left")
    value = quarter_value(F.coalesce("three_months", "single"), F.coalesce("cumulative", F.when(F.col("quarter") == 1, F.col("three_months"))), F.col("quarter"), F.col("cumulative_asked"))
    state = F.when(F.col("state").isNull(), "missing").when(F.col("state") != "ok", F.col("state")).when(value.isNull(), "missing").otherwise("ok")
    return found.select(*asked.columns, F.when(state == "ok", value).alias("value"), F.when(state == "ok", F.col("unit")).alias("unit"), state.alias("state"))

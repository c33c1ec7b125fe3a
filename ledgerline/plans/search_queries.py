"""Queries on the stored index, and on functions and workflows that no other query runs."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import dates, jsons, numbers, text
from ledgerline.operators import analysis, evaluation, forms, lineage, retrieval, tools, workflows
from ledgerline.plans.registry import _PHRASES, _STATUS, _TOK, _links, _statuses, _table, query
from ledgerline.plans.store import Store
from ledgerline.schemas import CITATION_FIELDS
from ledgerline.session import shared_folder, written
from ledgerline.sources import adapters as A

_INDEXED = f"""{_STATUS}, ix AS (SELECT c.chunk_id, c.doc_id, c.path, c.text, c.part, d.rcept_no, d.corp_code, d.doc_subtype, d.base_year, d.base_month, s.is_latest
FROM v_chunk c JOIN v_document d USING (doc_id) JOIN statuses s USING (rcept_no))"""
_HITS = ", ".join(
    f"5.0 * len(list_filter(p, lambda x: {c})) + len(list_filter(t, lambda x: {c})) AS f{i}"
    for i, c in enumerate(("x = 'the'", "starts_with(x, 'tion')", "starts_with(x, 'enlich')"))
)
_PART = " + ".join(
    f"CASE WHEN f{i} > 0 THEN CASE WHEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - n{i} + 0.5) / (n{i} + 0.5)) END * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * d / a)) ELSE 0 END"
    for i in range(3)
)
_SEARCH = f"""{_INDEXED}, h AS (SELECT *, len(p) + len(t) AS d, {_HITS} FROM (SELECT *, {_TOK('path')} AS p, {_TOK('text')} AS t FROM ix)),
g AS (SELECT count(*) AS n, avg(d) AS a, {', '.join(f"count(*) FILTER (f{i} > 0) AS n{i}" for i in range(3))} FROM h),
r AS (SELECT *, -({_PART}) AS score FROM h, g WHERE f0 > 0 OR f1 > 0 OR f2 > 0)"""


#: Raised when what an index holds changes.
INDEX_VERSION = 2


def _index(spark, sf_dir, status: DataFrame | None = None) -> str:
    """The folder of an index over all chunks of known filings. It is built once for the same files and shared by all queries.

    Its name follows from the tables' files, their sizes and times; it is built aside and moved, so a folder of that name is whole.
    """
    files = [f for t in ("documents", "orders", "lineitem") for f in Store(spark, sf_dir).marks(f"{t}.parquet")]
    name = "index-" + hashlib.sha256(repr((INDEX_VERSION, files)).encode()).hexdigest()[:32]
    store = Store(spark, shared_folder(spark))
    if not store.exists(name):
        staging = f".{name}-{uuid.uuid4().hex}"
        status = _statuses(spark, sf_dir) if status is None else status
        retrieval.build_index(retrieval.index_rows(A.chunks(spark, sf_dir), A.documents(spark, sf_dir), status), store.place(staging))
        try:
            store.move(staging, name)
        except FileExistsError:  # another session was first
            store.delete(staging)
    return store.place(name)


@query(f"WITH RECURSIVE {_INDEXED} SELECT term, count(DISTINCT chunk_id) AS n FROM (SELECT chunk_id, unnest(list_concat({_TOK('path')}, {_TOK('text')})) AS term FROM ix) GROUP BY term")
def index_build(spark, sf_dir):
    folder = _index(spark, sf_dir)
    return retrieval.frequencies(spark.read.parquet(f"{folder}/postings"))


@query(f"WITH RECURSIVE {_SEARCH}, k AS (SELECT * FROM r WHERE is_latest AND base_year = 1996 AND contains(path, 'en >') ORDER BY score, chunk_id LIMIT 21) SELECT chunk_id, doc_id, rcept_no, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY k.score, chunk_id) AS INTEGER) AS rank, sha256(text) AS text_sha FROM k")
def search_scoped(spark, sf_dir):
    folder = _index(spark, sf_dir)
    rows = retrieval.search(spark, folder, _PHRASES, 20, latest_only=True, base_year=1996, path_hint="EN >")
    return rows.select("chunk_id", "doc_id", "rcept_no", F.round("score", 6).alias("score"), "rank", F.sha2("text", 256).alias("text_sha"))


@query(f"WITH RECURSIVE {_SEARCH}, k AS (SELECT * FROM r WHERE doc_subtype = 'annual' ORDER BY score, chunk_id LIMIT 6) SELECT chunk_id, corp_code, base_month, is_latest, row_number() OVER (ORDER BY score, chunk_id) > 5 AS more FROM k")
def search_citations(spark, sf_dir):
    folder = _index(spark, sf_dir)
    return retrieval.search(spark, folder, _PHRASES, 5, doc_subtype="annual").select("chunk_id", "corp_code", "base_month", "is_latest", "more")


@query(f"""WITH RECURSIVE {_SEARCH}, k AS (SELECT *, row_number() OVER (ORDER BY score, chunk_id) AS rank FROM r WHERE is_latest AND base_year = 1997 AND rcept_no IN (SELECT rcept_no FROM v_document d JOIN statuses s USING (rcept_no) WHERE base_year = 1997 AND s.is_latest)
    ORDER BY score, chunk_id LIMIT 20)
SELECT CAST(k.rank AS INTEGER) AS rank, k.chunk_id, k.doc_id, k.rcept_no, k.corp_code, u.corp_name, d.report_nm, d.rcept_dt, k.path AS section, s.is_latest, s.root_rcept_no, s.latest_rcept_no,
    CASE WHEN NOT d.is_correction THEN 'original' ELSE coalesce(l.status, '') END AS correction_status, coalesce(l.method, '') AS correction_method
FROM k JOIN v_document d USING (doc_id) JOIN v_universe u ON u.corp_code = k.corp_code JOIN statuses s ON s.rcept_no = k.rcept_no LEFT JOIN links l ON l.correction_rcept_no = k.rcept_no""")
def cited_search(spark, sf_dir):
    """Ranked hits with all twelve fields of their citation."""
    docs = A.documents(spark, sf_dir).join(A.universe(spark, sf_dir).select("corp_code", "corp_name"), "corp_code")
    links = _links(spark, sf_dir)
    status = written(lineage.statuses(A.documents(spark, sf_dir), links), "statuses")
    told, rows, _ = retrieval.search_answer(spark, _index(spark, sf_dir, status), "the tion enlich", docs, status, links, 20, base_year=1997)
    if rows is None:
        raise ValueError(told)
    return rows.select("rank", "chunk_id", *(f"citation.{c}" for c in CITATION_FIELDS))


@query("""SELECT * FROM (VALUES ('missing_chunk', 3), ('unknown_chunk', 0), ('repeated_chunk', 0), ('repeated_posting', 0), ('unknown_posting', 0), ('unposted_chunk', 0), ('wrong_count', 0)) AS t("check", n)""")
def index_qa(spark, sf_dir):
    """Three chunks that the index doesn't hold are expected, and found missing."""
    folder, rows = _index(spark, sf_dir), A.chunks(spark, sf_dir).join(A.documents(spark, sf_dir), "doc_id", "left_semi")
    planted = spark.createDataFrame([("no#1",), ("no#2",), ("no#3",)], "chunk_id string")
    faults = retrieval.index_faults(spark, folder, rows.select("chunk_id").unionByName(planted))
    return faults.withColumn("n", F.col("n").cast("int"))


# ---- functions -----------------------------------------------------------------------------------

_SHA = lambda c: f"sha256({c})"


@query(f"""SELECT doc_id, {_SHA("trim(regexp_replace(translate(text, chr(160) || 'ㆍ', ' ·'), '[ \t\n\r\f\v]+', ' ', 'g'), ' ')")} AS normal, {_SHA("lower(regexp_replace(text, '[^0-9A-Za-z가-힣]', '', 'g'))")} AS key,
{_SHA("regexp_replace(text, '^\\[[^\\]]+\\]', '')")} AS untagged, regexp_matches(text, '^[ \t\n\f\r\v]*[=+@-]') AS formula, len(regexp_extract_all(replace(text, chr(10), ' '), '[^ ]+')) AS words FROM documents""")
def text_normal_forms(spark, sf_dir):
    sha, t = (lambda c: F.sha2(c, 256)), F.col("text")
    return _table(spark, sf_dir, "documents").select(
        "doc_id", sha(text.norm_text(t)).alias("normal"), sha(text.plain_key(t)).alias("key"), sha(F.regexp_replace(t, r"^\[[^\]]+\]", "")).alias("untagged"),
        (text.csv_safe(t) != t).alias("formula"), F.size(F.regexp_extract_all(F.replace(t, F.lit("\n"), F.lit(" ")), F.lit("([^ ]+)"), F.lit(1))).cast("long").alias("words"),
    )


@query(f"""SELECT page_id, {_SHA("replace(replace(replace(replace(replace(regexp_replace(html, '(?i)<br[ \t\n]*/?>', chr(10), 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')")} AS public,
{_SHA("replace(replace(replace(translate(html, '[]|', '［］｜'), chr(10), '%0A'), chr(9), '%09'), chr(13), '%0D')")} AS cited, CAST(ceil(length(html) / 500.0) AS INTEGER) AS parts, {_SHA("substr(html, 501, 500)")} AS second FROM pages""")
def page_texts(spark, sf_dir):
    sha, h = (lambda c: F.sha2(c, 256)), F.col("html")
    parts = text.fixed_parts(h, 500)
    return _table(spark, sf_dir, "pages").select("page_id", sha(text.public_text(h)).alias("public"), sha(text.citation_safe(h)).alias("cited"), F.size(parts).alias("parts"), sha(F.coalesce(F.get(parts, 1), F.lit(""))).alias("second"))


_MONEY = "CASE o_orderkey % 5 WHEN 0 THEN '(' || p || ')' WHEN 1 THEN '△' || p WHEN 2 THEN '-' || p WHEN 3 THEN '-' ELSE ' ' || p || ' ' END"


@query(f"""WITH m AS (SELECT o_orderkey, o_custkey, CAST(o_totalprice AS DECIMAL(18,2)) AS v, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS p FROM orders)
SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 5 = 4 THEN v WHEN o_orderkey % 5 = 3 THEN NULL ELSE -v END AS VARCHAR) AS accounted, CAST(CASE WHEN o_orderkey % 5 = 4 THEN v END AS VARCHAR) AS strict,
CAST(CASE WHEN o_orderkey % 5 = 3 THEN NULL WHEN o_orderkey % 5 = 2 THEN -v ELSE v END AS VARCHAR) AS first, CAST(round(v / 100000000, 2) AS DOUBLE) AS hundred_millions FROM m""")
def money_texts(spark, sf_dir):
    p, i = F.col("v").cast("string"), F.col("o_orderkey") % 5
    money = F.when(i == 0, F.concat(F.lit("("), p, F.lit(")"))).when(i == 1, F.concat(F.lit("△"), p)).when(i == 2, F.concat(F.lit("-"), p)).when(i == 3, F.lit("-")).otherwise(F.concat(F.lit(" "), p, F.lit(" ")))
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("v")).withColumn("m", money)
    plain = lambda c: c.cast("decimal(18,2)").cast("string")
    return rows.select(
        "o_orderkey", plain(numbers.accounting(F.col("m"))).alias("accounted"), plain(numbers.strict_accounting(F.col("m"))).alias("strict"), plain(numbers.first_amount(F.col("m"))).alias("first"),
        numbers.in_hundred_millions(F.col("v"), F.lit("원")).cast("double").alias("hundred_millions"),
    )


# half up in whole hundredths of a percent: the quotient of integers n / d
_HALF_UP = "CAST(sign(n) * ((2 * abs(n) + d) // (2 * d)) AS DOUBLE) / 100"


@query(f"""WITH m AS (SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS HUGEINT) AS a, CAST(o_custkey AS HUGEINT) AS b FROM orders),
r AS (SELECT o_orderkey, {_HALF_UP} AS ratio FROM (SELECT o_orderkey, a * 100 AS n, nullif(b, 0) AS d FROM m)),
c AS (SELECT o_orderkey, {_HALF_UP} AS change FROM (SELECT o_orderkey, (100 * b - a) * 10000 AS n, nullif(a, 0) AS d FROM m))
SELECT o_orderkey, ratio, change FROM r JOIN c USING (o_orderkey)""")
def percent_figures(spark, sf_dir):
    a, b = F.col("o_totalprice").cast("decimal(18,2)"), F.col("o_custkey").cast("decimal(18,0)")
    return _table(spark, sf_dir, "orders").select("o_orderkey", numbers.ratio_percent(a, b).cast("double").alias("ratio"), numbers.percent_change(a, b).cast("double").alias("change"))


_PATH = "CASE o_orderkey % 4 WHEN 0 THEN 'III > 연결재무제표' WHEN 1 THEN 'III > 재무제표' WHEN 2 THEN 'III > 별도 재무제표 주석' ELSE 'I > 개요' END"


@query(f"""WITH p AS (SELECT o_orderkey, {_PATH} AS path FROM orders) SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'consolidated' WHEN 2 THEN 'separate' ELSE 'unknown' END AS basis,
o_orderkey % 4 = 0 AS joint, o_orderkey % 4 IN (1, 2) AS own FROM p""")
def statement_basis(spark, sf_dir):
    i = F.col("o_orderkey") % 4
    path = F.when(i == 0, "III > 연결재무제표").when(i == 1, "III > 재무제표").when(i == 2, "III > 별도 재무제표 주석").otherwise("I > 개요")
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", path.alias("path"))
    return rows.select("o_orderkey", workflows.basis_of(F.col("path")).alias("basis"), tools.basis_filter(F.col("path"), "consolidated").alias("joint"), tools.basis_filter(F.col("path"), "separate").alias("own"))


_LABEL = "['자산총계', '1. 부채총계', '자본 총계', '매출액(주1)', '영업이익(손실)', '기본주당이익', '모름'][1 + l_linenumber % 7]"
_STATEMENT = f"""st AS (SELECT l_orderkey, CASE WHEN l_partkey % 2 = 0 THEN 'CFS' ELSE 'OFS' END AS basis, {_LABEL} AS label, CAST(l_extendedprice AS DECIMAL(18,2)) AS v FROM lineitem),
mv AS (SELECT l_orderkey, basis, CASE label WHEN '자산총계' THEN 'assets' WHEN '1. 부채총계' THEN 'liabilities' WHEN '자본 총계' THEN 'equity' WHEN '매출액(주1)' THEN 'revenue' WHEN '영업이익(손실)' THEN 'operating_profit' WHEN '기본주당이익' THEN 'basic_eps' END AS measure, v FROM st),
fa AS (SELECT l_orderkey, basis, measure, max(v) AS value, count(DISTINCT v) = 1 AS agrees FROM mv WHERE measure IS NOT NULL GROUP BY ALL)"""


def _statements(spark, sf_dir):
    label = F.get(F.array(*map(F.lit, ("자산총계", "1. 부채총계", "자본 총계", "매출액(주1)", "영업이익(손실)", "기본주당이익", "모름"))), F.col("l_linenumber") % 7)
    return _table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.when(F.col("l_partkey") % 2 == 0, "CFS").otherwise("OFS").alias("fs_div"), F.lit("BS").alias("sj_div"), F.lit("KRW").alias("currency"), label.alias("account_nm"),
        F.col("l_extendedprice").cast("decimal(18,2)").cast("string").alias("thstrm_amount"), F.col("l_linenumber").cast("string").alias("ord"),
    )


@query(f"WITH {_STATEMENT} SELECT l_orderkey, basis, measure, CAST(value AS VARCHAR) AS value, agrees FROM fa")
def statement_facts(spark, sf_dir):
    rows = workflows.facts(_statements(spark, sf_dir), ["l_orderkey"])
    return rows.select("l_orderkey", "basis", "measure", F.col("value").cast("decimal(18,2)").cast("string").alias("value"), "agrees")


@query(f"""WITH {_STATEMENT}, pv AS (SELECT l_orderkey, basis, {', '.join(f"max(value) FILTER (measure = '{m}' AND agrees) AS {m}" for m in ('liabilities', 'equity', 'operating_profit', 'revenue'))} FROM fa GROUP BY ALL),
rt AS (SELECT l_orderkey, basis, 'debt_ratio' AS ratio, liabilities AS a, equity AS b FROM pv UNION ALL SELECT l_orderkey, basis, 'operating_margin', operating_profit, revenue FROM pv)
SELECT l_orderkey, basis, ratio, CASE WHEN a IS NULL OR b IS NULL THEN 'operand_missing' WHEN b = 0 THEN 'zero_denominator' ELSE 'ok' END AS state, CAST(round(a * 100 / nullif(b, 0), 2) AS DOUBLE) AS percent FROM rt""")
def statement_ratios(spark, sf_dir):
    rows = workflows.ratios(workflows.facts(_statements(spark, sf_dir), ["l_orderkey"]), ["l_orderkey"]).filter("ratio IN ('debt_ratio', 'operating_margin')")
    return rows.select("l_orderkey", "basis", "ratio", "state", F.col("percent").cast("double").alias("percent"))


@query("""WITH c AS (SELECT conv_id, turn, role, length(text) % 3 = 0 AS a, CASE WHEN length(text) % 2 = 0 THEN length(text) % 5 = 0 END AS b FROM conversations)
SELECT role AS track, axis, count(ok) AS eligible, count(*) FILTER (coalesce(ok, false)) AS passed FROM (SELECT role, 'response_contract' AS axis, a AS ok FROM c UNION ALL SELECT role, 'citation_completeness', b FROM c) GROUP BY ALL""")
def axis_scores(spark, sf_dir):
    n = F.length("text")
    cases = _table(spark, sf_dir, "conversations").select(F.col("role").alias("track"), (n % 3 == 0).alias("response_contract"), F.when(n % 2 == 0, n % 5 == 0).alias("citation_completeness"))
    return evaluation.axis_scores(cases)


@query("""SELECT doc_id, CASE WHEN n_chars % 2 = 0 THEN 'none' WHEN n_chars % 7 = 0 THEN 'no_results' WHEN n_chars % 3 <> 0 THEN 'wrong_filing' WHEN n_chars % 5 <> 0 THEN 'wrong_section' ELSE 'wrong_passage' END AS failure FROM documents""")
def failure_categories(spark, sf_dir):
    n = F.col("n_chars")
    return _table(spark, sf_dir, "documents").select("doc_id", evaluation.failure_category(n % 2 == 0, n % 3 == 0, n % 5 == 0, n % 7).alias("failure"))


@query("""SELECT o_orderkey, year(o_orderdate) || '-01-01' = strftime(o_orderdate, '%Y-%m-%d') AS full_year, substr(strftime(o_orderdate, '%Y%m%d') || '000042', 1, 8) AS received,
CASE o_orderkey % 5 WHEN 0 THEN 3 WHEN 1 THEN 6 WHEN 2 THEN 9 WHEN 3 THEN 12 END AS month, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders""")
def period_texts(spark, sf_dir):
    day, i = F.col("o_orderdate"), F.col("o_orderkey") % 5
    period = F.concat(F.date_format(day, "yyyy.MM.dd"), F.lit(" ~ "), F.date_format(day, "yyyy"), F.lit("년 12월 31일"))
    asked = F.when(i == 0, "1분기 실적").when(i == 1, "반기 매출").when(i == 2, "3Q revenue").when(i == 3, "연간 실적").otherwise("1분기와 3분기")
    written_day = F.concat(F.date_format(day, "yyyy"), F.lit("년 "), F.month(day), F.lit("월 "), F.dayofmonth(day), F.lit("일"))
    return _table(spark, sf_dir, "orders").select(
        "o_orderkey", dates.is_full_year(period, F.year(day)).alias("full_year"), dates.receipt_date(F.concat(F.date_format(day, "yyyyMMdd"), F.lit("000042"))).alias("received"),
        dates.question_month(asked).alias("month"), dates.first_date(written_day).alias("day"),
    )


@query("""SELECT c_custkey, c_name AS title, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS field, lower(c_mktsegment) AS stem FROM customer""")
def compact_details(spark, sf_dir):
    field = F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise("-")
    pairs = F.to_json(F.array(F.array(F.lit("1. A > 2. Title"), F.col("c_name")), F.array(F.lit("Title"), F.lit("later")), F.array(F.lit("3. Field"), field)))
    rows = _table(spark, sf_dir, "customer").select("c_custkey", jsons.compact_fields(pairs).alias("m"), text.term_key(F.concat("c_mktsegment", F.lit("에서는"))).alias("stem"))
    return rows.select("c_custkey", F.try_element_at("m", F.lit("Title")).alias("title"), F.try_element_at("m", F.lit("Field")).alias("field"), "stem")


_PEOPLE = ("CB 발행", "유상증자 공시", "abcb", "합병 비율", "other")


@query("""SELECT c_custkey, ['전환사채권 발행결정', '유상증자 결정', 'abcb', '회사합병 결정', 'other'][1 + c_custkey % 5] AS event_type, ['삼성전자', '은', 'SK하이닉스', '카카오', '가나다'][1 + c_custkey % 5] AS bare,
['에이비씨', 'abcd', '에스케이하이닉스', 'lg화학', '케이티'][1 + c_custkey % 5] = ['에이비씨', 'abcd', '에스케이하이닉스', '엘지화학', '케이티'][1 + c_custkey % 5] OR c_custkey % 5 = 3 AS spelt FROM customer""")
def name_forms(spark, sf_dir):
    pick = lambda *v: F.get(F.array(*map(F.lit, v)), (F.col("c_custkey") % 5).cast("int"))
    want, read = pick("에이비씨", "abcd", "에스케이하이닉스", "엘지화학", "케이티"), text.letter_reading(pick("ABC", "abcd", "SK하이닉스", "LG화학", "KT"))
    return _table(spark, sf_dir, "customer").select(
        "c_custkey", workflows.canonical_event_type(pick(*_PEOPLE)).alias("event_type"), text.strip_particle(pick("삼성전자의", "은", "SK하이닉스에서", "카카오는", "가나다까지")).alias("bare"), (read == want).alias("spelt"),
    )


@query(f"""WITH w AS (SELECT item_id, list_filter(regexp_extract_all(lower(text), '[0-9a-z가-힣]+'), lambda x: length(x) BETWEEN 2 AND 64) AS l, text FROM benchmark),
t AS (SELECT item_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS found, text FROM w), m AS (SELECT *, len(found) <= 32 AND list_sum(list_transform(found, lambda x: length(x) + 6 + CASE WHEN length(x) >= 4 THEN 1 ELSE 0 END)) - 4 <= 4096 AS fits FROM t)
SELECT item_id, CASE WHEN fits THEN array_to_string(list_transform(found, lambda x: x || CASE WHEN length(x) >= 4 THEN '*' ELSE '' END), ' ') ELSE '' END AS phrases, len(regexp_extract_all(text, '[0-9]{{14,}}')) = 0 AS no_receipts FROM m""")
def phrase_counts(spark, sf_dir):
    rows = _table(spark, sf_dir, "benchmark")
    phrases = F.transform(text.match_phrases(F.col("text")), lambda x: F.concat(x["token"], F.when(x["prefix"], "*").otherwise("")))
    return rows.select("item_id", F.array_join(phrases, " ").alias("phrases"), (F.size(text.receipts_in(F.col("text"))) == 0).alias("no_receipts"))


@query("""SELECT n_nationkey, n_name AS a, 'x|y' AS b, 3 AS n_cells, ['sum', 'total'] AS kept FROM nation""".replace("['sum', 'total'] AS kept", "'sum,total,sum' AS kept"))
def table_rows(spark, sf_dir):
    cells = text.table_cells(F.concat(F.lit("| "), F.col("n_name"), F.lit(r" | x\|y | |")))
    kept = text.drop_repeats(F.array(*map(F.lit, ("", "sum", "sum", "", "total", "sum"))))
    return _table(spark, sf_dir, "nation").select("n_nationkey", F.get(cells, 0).alias("a"), F.replace(F.get(cells, 1), F.lit("\\"), F.lit("")).alias("b"), F.size(cells).alias("n_cells"), F.array_join(kept, ",").alias("kept"))


@query(f"WITH {_STATEMENT}, o AS (SELECT l_orderkey, CASE WHEN l_partkey % 2 = 0 THEN 'CFS' ELSE 'OFS' END AS fs_div, count(*) AS n FROM lineitem GROUP BY ALL) SELECT l_orderkey, fs_div, n AS n_rows, n + 1 AS n_lines FROM o")
def statement_markdown(spark, sf_dir):
    rows = _statements(spark, sf_dir).withColumns({"rcept_no": F.col("l_orderkey").cast("string"), "frmtrm_amount": F.lit(None).cast("string"), "bfefrmtrm_amount": F.lit(None).cast("string")})
    out = workflows.statement_tables(rows)
    return out.select(F.col("rcept_no").cast("long").alias("l_orderkey"), "fs_div", "n_rows", (F.size(F.split("text", "\n")) - 1).cast("long").alias("n_lines"))


@query("""SELECT doc_id, event_type FROM v_event WHERE contains(lower(event_type), 'af') OR contains(lower(event_type), 'annualreport') OR contains(regexp_replace(lower(report_nm), '[^0-9a-z가-힣]', '', 'g'), 'af') OR contains(regexp_replace(lower(report_nm), '[^0-9a-z가-힣]', '', 'g'), 'annualreport')""")
def events_by_words(spark, sf_dir):
    return tools.of_event_types(A.events(spark, sf_dir), ["a-F", "Annual report"]).select("doc_id", "event_type")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '주요사항보고서(자기주식취득결정)' WHEN o_orderkey % 3 = 1 THEN 'given' END AS corr_target_doc,
CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS corr_target_date FROM orders""")
def correction_texts(spark, sf_dir):
    i, day = F.col("o_orderkey") % 3, F.col("o_orderdate")
    body = F.concat(F.lit("<p>1. 정정대상 공시서류 : 주요사항보고서(자기주식취득결정)</p>\n<p>2. 정정대상 공시서류의 최초제출일 : "), F.date_format(day, "yyyy"), F.lit("년 "), F.month(day), F.lit("월 "), F.dayofmonth(day), F.lit("일</p>"))
    rows = _table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(i == 0, body).otherwise("<p>none</p>").alias("source"), F.when(i == 1, "given").alias("corr_target_doc"), F.lit(None).cast("string").alias("corr_target_date"),
    )
    return forms.with_text_targets(rows).select("o_orderkey", "corr_target_doc", "corr_target_date")


@query("""SELECT doc_id, CASE WHEN e.quantity % 2 = 0 THEN e.title WHEN d.doc_group = 'major' THEN trim(regexp_replace(d.report_nm, '^\\[[^\\]]+\\]', '')) END AS title,
CASE WHEN e.quantity % 3 = 0 THEN e.event_date WHEN d.doc_group = 'holding' THEN substr(d.rcept_dt, 1, 4) || '-' || substr(d.rcept_dt, 5, 2) || '-' || substr(d.rcept_dt, 7, 2) END AS event_date FROM v_event e JOIN v_document d USING (doc_id)""")
def event_defaults(spark, sf_dir):
    q = F.col("quantity")
    rows = A.events(spark, sf_dir).select("doc_id", F.when(q % 2 == 0, F.col("title")).alias("title"), F.when(q % 3 == 0, F.col("event_date")).alias("event_date"))
    return forms.with_group_defaults(rows, A.documents(spark, sf_dir))


@query("""WITH e AS (SELECT corp_code, event_type, amount_type, rcept_dt, rcept_no, CAST(amount AS DECIMAL(38,6)) AS v FROM v_event), p AS (SELECT a.corp_code, a.event_type, a.amount_type, a.rcept_no AS f, b.rcept_no AS s, b.v - a.v AS c,
row_number() OVER (PARTITION BY a.corp_code, a.event_type, a.amount_type ORDER BY a.rcept_dt, a.rcept_no, b.rcept_dt, b.rcept_no) AS k FROM e a JOIN e b ON a.corp_code = b.corp_code AND a.event_type = b.event_type AND a.amount_type = b.amount_type AND b.rcept_no > a.rcept_no AND a.v <> b.v)
SELECT corp_code, event_type, f AS first_rcept_no, s AS second_rcept_no, CAST(CAST(c AS DECIMAL(38,2)) AS VARCHAR) AS change FROM p WHERE k = 1""")
def compare_candidates(spark, sf_dir):
    rows = evaluation.compare_candidates(A.events(spark, sf_dir).withColumn("root_rcept_no", F.lit("")))
    return rows.select("corp_code", "event_type", "first_rcept_no", "second_rcept_no", F.col("change").cast("decimal(38,2)").cast("string").alias("change"))


@query(f"WITH RECURSIVE {_STATUS} SELECT root_rcept_no, min(rcept_no) AS oldest_rcept_no, max(latest_rcept_no) AS latest_rcept_no, max(n_corrections) AS n_corrections FROM statuses WHERE n_corrections > 0 GROUP BY root_rcept_no HAVING min(rcept_no) <> max(latest_rcept_no)")
def history_candidates(spark, sf_dir):
    return evaluation.history_candidates(_statuses(spark, sf_dir))


@query("SELECT 48 AS n, 48 AS known FROM region LIMIT 1")
def random_sample(spark, sf_dir):
    companies = A.universe(spark, sf_dir).select("corp_code")
    drawn = analysis.random_sample(companies, 48)
    return drawn.join(companies.withColumn("known", F.lit(1)), "corp_code", "left").agg(F.count("*").cast("int").alias("n"), F.count("known").cast("int").alias("known"))

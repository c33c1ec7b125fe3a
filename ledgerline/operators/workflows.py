"""Deterministic analytic workflows over statement rows and events: figures, ratios, growth, quarters, comparisons, totals.

An operand that is missing, ambiguous or of another basis or unit makes the answer abstain: `state` says so
in place of a number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.numbers import accounting, in_won, percent_change, ratio_percent
from ledgerline.functions.text import bound, row_label
from ledgerline.session import dealt

#: Measures and the row labels that name them.
MEASURES = {
    "liabilities": ("부채총계", "부채"), "equity": ("자본총계", "자본"), "current_assets": ("유동자산",), "current_liabilities": ("유동부채",),
    "assets": ("자산총계", "자산"), "non_current_assets": ("비유동자산",), "non_current_liabilities": ("비유동부채",),
    "net_income": (
        "당기순이익", "연결당기순이익", "당기순손익", "연결당기순손익", "당기순손실", "연결당기순손실", "당기순이익(손실)", "당기순손익(손실)",
    ),
    "revenue": ("매출액", "매출", "영업수익", "수익(매출액)"), "operating_profit": ("영업이익", "영업손익", "영업이익(손실)", "영업손실"),
}
#: Labels of earnings a share, by kind.
EARNINGS_PER_SHARE = {
    "basic_eps": ("기본주당이익", "기본주당순이익", "기본주당이익(손실)"), "diluted_eps": ("희석주당이익", "희석주당순이익", "희석주당이익(손실)"),
}
#: Ratio -> numerator and denominator, in percent.
RATIOS = {"debt_ratio": ("liabilities", "equity"), "current_ratio": ("current_assets", "current_liabilities"), "roe": ("net_income", "equity"), "operating_margin": ("operating_profit", "revenue")}
#: What event types are also called.
EVENT_SYNONYMS = {"CB": "전환사채권 발행결정", "전환사채": "전환사채권 발행결정", "BW": "신주인수권부사채권 발행결정", "EB": "교환사채권 발행결정", "유상증자": "유상증자 결정", "무상증자": "무상증자 결정", "소송": "소송 등의 제기", "합병": "회사합병 결정", "자사주": "자기주식 취득 결정"}
#: Amount types that are an event's headline.
HEADLINE = ("계약금액", "투자금액", "발행금액", "금액")
#: Events of one type above which a total isn't given.
MOST_EVENTS = 3


def statement_family(c: Column) -> Column:
    """Comprehensive income counts as income."""
    return F.when(c == "CIS", "IS").otherwise(c)


def basis_of(path: Column) -> Column:
    """consolidated, separate, or unknown where nothing marks it."""
    return F.when(F.contains(path, F.lit("연결")), "consolidated").when(path.rlike("별도|개별"), "separate").otherwise("unknown")


def measure_of(label: Column) -> Column:
    def named(clean: Column) -> Column:
        out = F
        for name, words in (MEASURES | EARNINGS_PER_SHARE).items():
            out = out.when(clean.isin(*words), name)
        return out

    return bound(row_label(label), named)


def facts(statements: DataFrame, by: list[str], amount: str = "thstrm_amount") -> DataFrame:
    """One row per key and measure: its value, and whether its rows agree; statements are ordered rows of one filing or more."""
    rows = statements.select(*by, F.col("fs_div").alias("basis"), statement_family(F.col("sj_div")).alias("statement"), "currency", measure_of(F.col("account_nm")).alias("measure"), accounting(F.col(amount)).alias("value"))
    rows = dealt(rows.filter("measure IS NOT NULL AND value IS NOT NULL"), statements.count(), *by)
    return rows.groupBy(*by, "basis", "measure").agg(F.max("value").alias("value"), (F.min("value") == F.max("value")).alias("agrees"), F.max("currency").alias("currency"))


def ratios(values: DataFrame, by: list[str]) -> DataFrame:
    """Each ratio whose operands are there, agree and share key and basis; else its state."""
    key = [*by, "basis"]
    one = values.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("measure", F.when(F.col("agrees"), F.col("value"))))).alias("m"))
    pairs = F.array(*(F.struct(F.lit(r).alias("ratio"), F.try_element_at("m", F.lit(n)).alias("numerator"), F.try_element_at("m", F.lit(d)).alias("denominator")) for r, (n, d) in RATIOS.items()))
    rows = one.select(*key, F.inline(pairs))
    state = F.when(F.col("numerator").isNull() | F.col("denominator").isNull(), "operand_missing").when(F.col("denominator") == 0, "zero_denominator").otherwise("ok")
    return rows.withColumns({"state": state, "percent": F.when(state == "ok", ratio_percent(F.col("numerator"), F.col("denominator")))})


def yearly_growth(values: DataFrame, by: list[str], year: str = "year") -> DataFrame:
    w = Window.partitionBy(*by, "basis", "measure").orderBy(year)
    before = F.when(F.lag(year).over(w) == F.col(year) - 1, F.lag("value").over(w))
    rows = values.withColumn("previous", before)
    return rows.withColumns({"growth": percent_change(F.col("previous"), F.col("value")), "state": F.when(F.col("previous").isNull(), "operand_missing").when(F.col("previous") == 0, "zero_base").otherwise("ok")})


def fourth_quarter(annual: DataFrame, nine_months: DataFrame, by: list[str]) -> DataFrame:
    """Annual less nine months, of the same key, basis, measure and currency only."""
    key = [*by, "basis", "measure", "currency"]
    a, b = (f.filter("agrees").select(*key, F.col("value").alias(n)) for f, n in ((annual, "annual"), (nine_months, "nine_months")))
    return a.join(b, key, "left").withColumns({"q4": F.col("annual") - F.col("nine_months"), "state": F.when(F.col("nine_months").isNull(), "operand_missing").otherwise("ok")})


def quarter_value(three_months: Column, cumulative: Column, quarter: Column, asked_cumulative: Column) -> Column:
    """Three months unless the cumulative value is asked for; in the first quarter the one stands for the other."""
    return F.when(asked_cumulative, cumulative).when((quarter == 1) & three_months.isNull(), cumulative).otherwise(three_months)


def compare(values: DataFrame, by: str, value: str, unit: str) -> DataFrame:
    """Larger first, in won, with the difference to and the multiple of the next."""
    rows = values.withColumn("won", in_won(F.col(value), F.col(unit)))
    w = Window.partitionBy(F.lit(1)).orderBy(F.col("won").desc_nulls_last(), by)
    after = F.lead("won").over(w)
    return rows.withColumns({"rank": F.when(F.col("won").isNotNull(), F.row_number().over(w)), "difference": F.col("won") - after, "multiple": F.round(F.try_divide(F.col("won").cast("decimal(28,2)"), after.cast("decimal(28,2)")), 2), "state": F.when(F.col("won").isNull(), "unit_unknown").otherwise("ok")})


def event_totals(events: DataFrame, asked: DataFrame) -> DataFrame:
    """asked: corp_code, event_type. The latest version of each root once; too many events, or a root with different amounts, abstain; absent types say so."""
    own = events.filter(F.col("is_latest")).filter(F.coalesce(F.col("amount_type"), F.lit("금액")).rlike("|".join(HEADLINE)) | (F.col("amount_type") == "원"))
    value = accounting(F.col("amount"))
    roots = own.groupBy("corp_code", "event_type", "root_rcept_no").agg(F.max(value).alias("v"), F.count_distinct(value).alias("k"))
    sums = roots.groupBy("corp_code", "event_type").agg(F.sum("v").alias("total"), F.count("*").alias("n"), F.max("k").alias("k"))
    state = F.when(F.col("n").isNull(), "absent").when(F.col("k") > 1, "conflicting_root").when(F.col("n") > MOST_EVENTS, "too_many").otherwise("ok")
    return asked.join(sums, ["corp_code", "event_type"], "left").withColumns({"state": state, "total": F.when(state == "ok", F.col("total"))}).drop("k")


def sector_ranking(members: DataFrame, values: DataFrame, numerator: str, denominator: str) -> DataFrame:
    """All members with a positive denominator by exact ratio; how many were ranked of how many."""
    from ledgerline.operators.analysis import ratio_ranks

    known = members.join(values, "corp_code")
    ranked = ratio_ranks(known, "sector", numerator, denominator, "corp_code")
    size = members.groupBy("sector").agg(F.count("*").alias("n_population"))
    return ranked.withColumn("n_checked", F.count("*").over(Window.partitionBy("sector"))).join(size, "sector")


def canonical_event_type(c: Column) -> Column:
    out = None
    for word, name in EVENT_SYNONYMS.items():
        hit = F.contains(c, F.lit(word)) if not word.isascii() else c.rlike(rf"(?i)(?<![A-Za-z]){word}(?![A-Za-z])")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(c)


def counterparty_filings(events: DataFrame, universe: DataFrame, filings: DataFrame) -> DataFrame:
    """Second hop: an event's counterparty as a company of the universe, and its latest annual filing; without one the first hop stands alone."""
    from ledgerline.functions.text import plain_key

    names = universe.select(plain_key(F.col("corp_name")).alias("k"), F.col("corp_code").alias("partner_code"))
    hop = events.withColumn("k", plain_key(F.col("counterparty"))).join(names, "k", "left").drop("k")
    annual = filings.filter("doc_subtype = 'annual' AND is_latest")
    last = annual.withColumn("_n", F.row_number().over(Window.partitionBy("corp_code").orderBy(F.col("rcept_no").desc()))).filter("_n = 1").select(F.col("corp_code").alias("partner_code"), F.col("rcept_no").alias("partner_rcept_no"))
    return hop.join(last, "partner_code", "left").withColumn("state", F.when(F.col("partner_code").isNull(), "outside_universe").when(F.col("partner_rcept_no").isNull(), "no_annual_filing").otherwise("ok"))


def statement_tables(rows: DataFrame) -> DataFrame:
    """One Markdown table per filing, basis and statement: current, prior and prior-but-one, in the order of the rows."""
    order = F.coalesce(F.col("ord").try_cast("int"), F.lit(2147483647))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c), F.lit("-")) for c in ("account_nm", "thstrm_amount", "frmtrm_amount", "bfefrmtrm_amount"))), F.lit(" |"))
    own = rows.select("rcept_no", "fs_div", statement_family(F.col("sj_div")).alias("statement"), F.struct(order.alias("o"), F.col("account_nm").alias("a"), line.alias("l")).alias("x"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["l"]), "\n")
    return own.groupBy("rcept_no", "fs_div", "statement").agg(F.concat(F.lit("| 계정 | 당기 | 전기 | 전전기 |\n|---|---|---|---|\n"), body).alias("text"), F.count("*").alias("n_rows"))

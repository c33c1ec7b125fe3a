"""Companies and sectors by what people call them.

Aliases are a table derived from the universe. A batch of queries is resolved by joins on equality: exact codes, exact
aliases, runs of up to five tokens, then aliases at strong boundaries inside a run of characters. Each step sees what the
one before left open; several companies in one step make the query ambiguous.

An alias inside a run stands between a place where one may begin (the run's start, a boundary word before it, a change of
script) and one where it may end (the run's end, a boundary word after it). Both kinds of places come from the run alone, so the pieces
between them, no longer than the longest alias, are joined with the aliases: no alias is looked for in texts that can't hold it, and
neither side has to fit a machine.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.text import PARTICLES, letter_reading, nfkc, nfkc_casefold, normal_key, strip_company_endings, strip_particle

#: Shorthands and the names that they stand for.
SHORTHANDS = {
    "삼전": "삼성전자", "하닉": "sk하이닉스", "하이닉스": "sk하이닉스", "엔솔": "lg에너지솔루션", "엘지엔솔": "lg에너지솔루션", "기아자동차": "기아", "기아차": "기아", "포스코": "posco홀딩스", "포스코홀딩스": "posco홀딩스",
    "네이버": "naver", "삼성이앤에이": "삼성e&a", "엔씨": "nc", "삼성엔지니어링": "삼성e&a", "한화에어로": "한화에어로스페이스", "엘지씨엔에스": "lg씨엔에스", "엘지씨엔에스코퍼레이션": "lg씨엔에스",
}
#: Tokens of an n-gram at most.
WIDEST = 5
#: Characters of a query at most.
LONGEST_QUERY = 1000
#: What may follow an alias inside a run, besides particles.
AFTER = (
    "사업보고서", "분기보고서", "반기보고서", "공시", "연결", "별도", "and", "versus", "vs", "매출액", "매출", "영업수익", "영업이익", "영업손실",
    "당기순이익", "당기순손실", "순이익", "순손실", "자산총계", "부채총계", "자본총계", "배당", "최대주주", "직원수", "종업원수", "설립일", "본점주소",
    "회사개요", "사업내용", "주요사업", "주요제품", "시설투자", "설비투자", "자금조달", "revenue", "sales", "operatingprofit", "operatingloss",
    "netincome", "netloss", "totalassets", "totalliabilities", "totalequity", "dividend", "eps", "roe",
)
#: What may stand before one, besides particles.
BEFORE = (
    "제출된", "공시된", "and", "compare", "summarize", "summary", "explain", "report", "show", "tell", "analyze", "versus", "vs",
    "년", "월", "일", "분기", "기준", "please",
)
#: What follows a sector's name.
SECTOR_BOUNDARY = r"\s*(?:와|과|및|·|ㆍ|/|&|,|[0-9]+\s*사|기업|회사|업체|종목|섹터|산업|업종|군|중|내|$)"
#: Fixed value: what parts the components of a sector's name.
SECTOR_PARTS = r"[·ㆍ/&,+]"


def aliases(universe: DataFrame) -> DataFrame:
    """alias, corp_code: names, codes, English names without endings, read-out initials, former names, shorthands."""
    have = lambda c: F.col(c) if c in universe.columns else F.lit(None).cast("string")
    former = F.regexp_extract_all(F.coalesce(have("note"), F.lit("")), F.lit(r"(?:^|[,;/])\s*구\s+(.+?)(?=\s*\(|[,;/]|$)"), F.lit(1))
    names = F.concat(F.array(have("corp_code"), have("stock_code"), have("corp_name"), have("listed_name"), have("corp_eng_name"), letter_reading(have("corp_name")), letter_reading(have("listed_name"))), former)
    each = universe.select("corp_code", F.explode(names).alias("name"), have("corp_eng_name").alias("eng")).withColumn("k", normal_key(F.col("name")))
    keys = each.select("corp_code", F.explode(F.array("k", F.when(F.col("name") == F.col("eng"), strip_company_endings(F.col("k"))))).alias("alias"))
    short = universe.sparkSession.createDataFrame(list(SHORTHANDS.items()), "short string, full string").select(normal_key(F.col("short")).alias("alias"), normal_key(F.col("full")).alias("full"))
    named = universe.select("corp_code", normal_key(F.col("corp_name")).alias("full"))
    keys = keys.unionByName(named.join(F.broadcast(short), "full").select("corp_code", "alias"))
    return keys.filter(F.length("alias") >= 2).distinct()


def _verdict(hits: DataFrame, step: str) -> DataFrame:
    """hits: query_id, corp_code."""
    codes = F.array_sort(F.collect_set("corp_code"))
    return hits.groupBy("query_id").agg(codes.alias("corp_codes")).withColumns({"step": F.lit(step), "status": F.when(F.size("corp_codes") == 1, "ok").otherwise("ambiguous")})


def _ngrams(words: Column) -> Column:
    n = F.size(words)
    each = lambda size: F.when(n >= size, F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.array_join(F.slice(words, i, F.lit(size)), ""))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(reduce(F.concat, (each(k) for k in range(1, WIDEST + 1))))


def _script(c: Column) -> Column:
    return F.when(c.rlike("[a-z]"), 1).when(c.rlike("[0-9]"), 2).otherwise(3)


def bounded_pieces(run: Column, longest: Column) -> Column:
    """Distinct pieces of a run, of 2 to `longest` characters, that begin and end where an alias may; run: lower-cased letters and digits."""
    n = F.length(run)
    before, after = "(?:" + "|".join((*PARTICLES, *BEFORE)) + ")$", "^(?:" + "|".join((*PARTICLES, *AFTER)) + ")"
    at = lambda i: F.substring(run, i, F.lit(1))
    may_begin = lambda s: (s == 0) | F.substring(run, F.lit(1), s).rlike(before) | (_script(at(s)) != _script(at(s + 1)))
    may_end = lambda e: (e == n) | F.substring(run, e + 1, n).rlike(after)
    begins, ends = F.filter(F.sequence(F.lit(0), n - 2), may_begin), F.filter(F.sequence(F.lit(2), n), may_end)
    of = lambda s: F.transform(F.filter(ends, lambda e: (e - s).between(F.lit(2), longest)), lambda e: F.substring(run, s + 1, e - s))
    return F.when(n >= 2, F.array_distinct(F.flatten(F.transform(begins, of)))).otherwise(F.array().cast("array<string>"))


def resolve_companies(queries: DataFrame, universe: DataFrame) -> DataFrame:
    """query_id, query -> status (ok, ambiguous, not_found, error), corp_codes in their order, step.

    A null, blank or over-long query is an error. Queries that hold `;`, `--` or comment marks are only compared whole.
    """
    alias = aliases(universe)
    codes = F.explode(F.array(*(normal_key(F.col(c)) for c in ("corp_code", "stock_code") if c in universe.columns)))
    code = universe.select(codes.alias("alias"), "corp_code").filter("alias <> ''").distinct()
    fit = F.coalesce((F.trim("query") != "") & (F.length("query") <= LONGEST_QUERY), F.lit(False))
    q = queries.filter(fit).select("query_id", nfkc(F.col("query")).alias("query"), normal_key(F.col("query")).alias("alias"))
    done = [_verdict(q.join(code, "alias"), "code")]
    rest = q.join(done[0].select("query_id"), "query_id", "left_anti")
    done.append(_verdict(rest.join(alias, "alias"), "alias"))
    rest = rest.join(done[1].select("query_id"), "query_id", "left_anti").filter(~F.col("query").rlike(r";|--|/\*|\*/"))
    words = F.regexp_extract_all("query", F.lit("([A-Za-z가-힣&]+|[0-9]+)"), F.lit(1))
    grams = rest.select("query_id", F.explode(_ngrams(words)).alias("gram"))
    forms = [F.lower(F.replace(g, F.lit("&"), F.lit(""))) for g in (F.col("gram"), strip_particle(F.col("gram")))]
    grams = grams.select("query_id", F.explode(F.array(*forms, *map(strip_company_endings, forms))).alias("alias")).filter(F.length("alias") >= 2).distinct()
    done.append(_verdict(grams.join(alias, "alias"), "ngram"))
    rest = rest.join(done[2].select("query_id"), "query_id", "left_anti")
    runs = rest.select("query_id", F.explode(F.regexp_extract_all("query", F.lit("([A-Za-z가-힣0-9&]+)"), F.lit(1))).alias("run"))
    runs = runs.withColumns({"run": F.lower(F.replace("run", F.lit("&"), F.lit(""))), "longest": alias.select(F.max(F.length("alias"))).scalar()})
    inside = runs.select("query_id", F.explode(bounded_pieces(F.col("run"), F.col("longest"))).alias("alias")).distinct()
    done.append(_verdict(inside.join(alias, "alias"), "inside"))
    found = reduce(DataFrame.unionByName, done)
    out = queries.select("query_id", "query").join(found, "query_id", "left")
    status = F.coalesce("status", F.when(fit, "not_found").otherwise("error"))
    return out.withColumns({"status": status, "corp_codes": F.coalesce("corp_codes", F.array().cast("array<string>"))})


def resolve_sectors(queries: DataFrame, universe: DataFrame) -> DataFrame:
    """query_id -> status (ok, ambiguous, not_found, error), the sector, and all sectors named, in the order of their names.

    A sector is named by its whole name, whatever stands between its components, or by one component, each before a word that marks a group.
    The end of such a name is looked for in the query; what precedes it, without separators, is joined with the names.
    """
    fold = lambda c: nfkc_casefold(c)
    bare = lambda c: F.regexp_replace(c, r"[·ㆍ/&,+\s]", "")
    quoted = lambda c: F.regexp_replace(c, r"([^\p{L}\p{N}\s_])", r"\\$1")
    parts = F.filter(F.transform(F.split(fold(F.trim("sector")), SECTOR_PARTS), lambda x: F.trim(x)), lambda x: F.length(F.regexp_replace(x, r"[^\p{L}\p{N}]", "")) >= 2)
    named = universe.select("sector").distinct().filter("trim(sector) <> ''").withColumn("parts", parts).filter(F.size("parts") > 0)
    whole = F.array_join(F.transform("parts", quoted), r"[·ㆍ/&,+\s]*")
    forms = F.concat(F.array(F.struct(F.array_join("parts", "").alias("name"), whole.alias("pattern"))), F.transform("parts", lambda x: F.struct(x.alias("name"), quoted(x).alias("pattern"))))
    names = named.select("sector", F.inline(forms)).withColumn("name", bare(F.col("name"))).distinct()
    fit = F.coalesce((F.trim("query") != "") & (F.length("query") <= LONGEST_QUERY), F.lit(False))
    q = queries.filter(fit).select("query_id", fold(F.col("query")).alias("text"))
    n = F.length("text")
    ends = F.filter(F.sequence(F.lit(1), n), lambda e: F.substring("text", e + 1, n).rlike("^" + SECTOR_BOUNDARY))
    upto = q.select("query_id", "text", F.explode(ends).alias("e")).select("query_id", "text", bare(F.substring("text", F.lit(1), F.col("e"))).alias("upto"))
    upto = upto.distinct().withColumn("longest", names.select(F.max(F.length("name"))).scalar())
    sizes = F.sequence(F.lit(2), F.least(F.length("upto"), F.col("longest")))
    pieces = upto.filter("length(upto) >= 2 AND longest >= 2").select("query_id", "text", F.explode(F.transform(sizes, lambda k: F.substring("upto", F.length("upto") - k + 1, k))).alias("name")).distinct()
    # a separator inside a component must be there, so what was found without separators is looked at as it stands
    hits = pieces.join(names, "name").filter(F.regexp_like("text", F.concat(F.col("pattern"), F.lit("(?=" + SECTOR_BOUNDARY + ")"))))
    found = hits.groupBy("query_id").agg(F.array_sort(F.collect_set("sector")).alias("sectors"))
    out = queries.select("query_id", "query").join(found, "query_id", "left")
    status = F.when(~fit, "error").when(F.col("sectors").isNull(), "not_found").when(F.size("sectors") > 1, "ambiguous").otherwise("ok")
    return out.withColumn("status", status).withColumn("sector", F.when(F.col("status") == "ok", F.get("sectors", 0))).drop("query")


def sector_candidates(resolved: DataFrame, universe: DataFrame) -> DataFrame:
    """A row for each member of the sector that a query names, with its place among them by code."""
    members = resolved.filter("status = 'ok'").select("query_id", "sector").join(universe, "sector")
    kept = [c for c in ("corp_code", "stock_code", "corp_name", "listed_name") if c in universe.columns]
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("corp_code"))
    return members.select("query_id", "sector", *kept, place.alias("place"))

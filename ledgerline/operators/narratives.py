"""Narratives of several reports side by side: sentences on the same topic from each, chosen under a budget.

Passages become sentences, sentences get domains (what they are about) and a family (what kind of statement they make), and a pair of both is a
topic. Of each report the first sentence of a topic stands for it; only topics that every report of a request has can be compared. They
are taken in a fixed order, each sentence once, until the budget is used up. All but the last choice are rows and groups; that one is a
fold over a request's topics, of which there are no more than families times domains.

Defined results: unfinished sentences, tables, navigation and instructions are never quoted; a request with one report, or without a common topic, has
no rows; equal sentences of a report count once; null and empty texts have no sentences.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Domains and the words that tell them.
DOMAINS = {
    "메모리": r"DRAM|NAND|HBM|DDR[0-9]*|메모리", "완제품": r"(?<![A-Za-z])TV(?![A-Za-z])|스마트폰|냉장고|세탁기|에어컨|전자제품", "디스플레이": r"OLED|디스플레이", "파운드리": r"Foundry|파운드리",
    "CIS": r"(?<![A-Za-z])CIS(?![A-Za-z])|CMOS Image Sensor", "항공": r"항공", "방산": r"방산|자주포|군수장비", "시큐리티": r"시큐리티|CCTV", "IT 서비스": r"IT\s*서비스|정보시스템",
    "산업용장비": r"산업용\s*(?:장비|기계)|산업기계", "해양": r"조선|해양제품|해양사업|선박", "우주": r"(?<!항공)우주사업|위성시스템", "DX": r"(?<![A-Za-z])DX(?![A-Za-z])", "DS": r"(?<![A-Za-z])DS(?![A-Za-z])",
    "SDC": r"(?<![A-Za-z])SDC(?![A-Za-z])", "Harman": r"Harman|하만|카오디오|디지털\s*콕핏", "자동차": r"자동차|(?<!철도)(?<!철도 )차량", "배터리": r"배터리|이차전지|2차전지", "의약품": r"의약품|제약", "게임": r"게임",
    "음악": r"음악|음반|공연|뮤직", "콘텐츠": r"콘텐츠|컨텐츠|웹툰|스토리IP", "물류": r"물류|해운|컨테이너|벌크|화물\s*운송|해상운송|물류서비스",
    "원자력": r"원자력|원전|원자로|증기발생기|발전설비|복합화력|스팀터빈|발전플랜트|해상풍력", "인터넷/플랫폼": r"포털|검색|커머스|핀테크|메신저|플랫폼|소프트웨어|모바일|카카오톡",
    "철강": r"철강|제철|강판|열연|냉연|후판", "지주": r"지주회사|포트폴리오", "금융": r"금융|할부금융|신용카드|리스(?:금융|업|사업|상품|거래)|(?<![가-힣])리스(?![가-힣])|증권|보험|은행|여신전문",
}
#: Families of topics, in the order in which they are told apart, and what tells them.
FAMILIES = (
    ("sales", r"판매법인|판매망|판매경로|영업망|유통망"), ("market", r"^(?!.*당사)(?!.*(?:부문(?:은|으로)|사업(?:은|으로)|영위|전개)).*(?:시장|업황|업계|수요)"), ("investment", r"(?:투자|증설).*(?:계획|예정)|설비투자"),
    ("business", r"생산|판매|개발|양산|영위|주력\s*제품|핵심\s*사업|제작|공급|운영|전개|수행|서비스를\s*제공|부문으로\s*(?:구성|구분)|매출을\s*창출|주요\s*사업"), ("composition", r"^(?=.*[0-9]).*(?:매출|비중)"),
)
#: Families in the order in which they are shown; ends of sentences; what is never quoted.
SHOWN = ("business", "composition", "market", "sales", "investment")
END = r"""[다요음임함됨]\.["”’']?"""
NEVER = (
    r"☞|참고하시|참조하시|참고\s*바랍니다|상세한?\s*(?:내용|사항).*참고|자세한.*참고", r"\[근거:|\[정정:|이전\s*(?:지시|규칙)|시스템\s*프롬프트|비밀키|(?i:API\s*키|secret|Authorization)",
    r"(?:다음과|아래와)\s*같(?:습니다|으며|고)|(?:다음|아래)의\s*표|기재를?\s*생략", r"판매\s*가격|판매\s*단가|가격\s*변동",
)
LONGEST = 2000


@dataclass(frozen=True)
class Rules:
    """What tells sentences, domains and families."""

    end: str = END
    never: tuple[str, ...] = NEVER
    domains: dict[str, str] = field(default_factory=lambda: DOMAINS)
    families: tuple[tuple[str, str], ...] = FAMILIES
    shown: tuple[str, ...] = SHOWN


def whole_sentences(text: Column, rules: Rules = Rules()) -> Column:
    """Finished sentences outside tables, in their order; what follows the last end is dropped."""
    prose = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), "\x02", ""), r"(?m)^\s*\|.*$", "\x02\x02")
    parts = F.split(F.regexp_replace(prose, f"({rules.end})", "$1\x02"), "\x02")
    # a part without an end at its end is a tail, or what a table has cut
    trimmed = F.transform(parts, lambda x: F.regexp_replace(F.regexp_replace(x, r"[ \t\n\r\f\x0B]+", " "), "^ | $", ""))
    bad = "|".join(f"(?:{p})" for p in rules.never) or r"(?!)"
    return F.filter(trimmed, lambda x: x.rlike(f"(?:{rules.end})$") & ~x.rlike(bad) & ~F.contains(x, F.lit("|")) & (F.length(x) <= LONGEST))


def topic_rows(passages: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """request_id, doc_no, seq, text -> request_id, doc_no, family, domain, seq, pos, sentence: a row per topic of a sentence."""
    rows = passages.select("request_id", "doc_no", "seq", F.posexplode(whole_sentences(F.col("text"), rules)).alias("pos", "sentence"))
    told = F.array_compact(F.array(*(F.when(F.col("sentence").rlike(f"(?i){p}"), d) for d, p in rules.domains.items())))
    family = reduce(lambda c, x: c.when(F.col("sentence").rlike(x[1]), x[0]), rules.families[1:], F.when(F.col("sentence").rlike(rules.families[0][1]), rules.families[0][0]))
    return rows.withColumns({"family": family, "domain": F.explode(told)}).filter("family IS NOT NULL")


def aligned_topics(passages: DataFrame, budget: int, rules: Rules = Rules()) -> DataFrame:
    """request_id, rank, family, domain, sentences (of each report, in their order): the comparison of a request's reports.

    passages: request_id, doc_no, seq, text. A topic's sentences come before another's if its family is shown earlier, then if its sentences stand earlier
    in their reports, then by the domain's name. A sentence that is used already rules its topic out.
    """
    reports = passages.groupBy("request_id").agg(F.count_distinct("doc_no").alias("reports")).filter("reports > 1")
    place = F.struct("seq", "pos", "sentence")
    first = topic_rows(passages, rules).groupBy("request_id", "family", "domain", "doc_no").agg(F.min(place).alias("p"))
    pair = F.array_sort(F.collect_list(F.struct("doc_no", "p")))  # one a report
    pairs = first.groupBy("request_id", "family", "domain").agg(F.count("*").alias("n"), F.sum(F.col("p.seq") * 1000 + F.col("p.pos")).alias("depth"), pair.alias("xs")).join(reports, "request_id").filter("n = reports")
    shown = F.array_position(F.array(*map(F.lit, rules.shown)), F.col("family"))
    topic = F.struct(shown.alias("shown"), "depth", "domain", "family", F.transform("xs", lambda x: x["p"]["sentence"]).alias("sentences"), F.transform("xs", lambda x: F.concat(x["doc_no"].cast("string"), F.lit(":"), x["p"]["sentence"])).alias("marks"))
    listed = pairs.groupBy("request_id").agg(F.array_sort(F.collect_list(topic)).alias("topics"))  # at most families x domains
    none = F.filter("topics", lambda x: F.lit(False))
    start = F.struct(none.alias("chosen"), F.array().cast("array<string>").alias("used"))

    def take(state: Column, x: Column) -> Column:
        fits = (F.size(state["chosen"]) < budget) & ~F.arrays_overlap(state["used"], x["marks"])
        return F.when(fits, F.struct(F.array_append(state["chosen"], x).alias("chosen"), F.concat(state["used"], x["marks"]).alias("used"))).otherwise(state)

    chosen = listed.select("request_id", F.posexplode(F.aggregate("topics", start, take)["chosen"]).alias("k", "t"))
    return chosen.select("request_id", (F.col("k") + 1).alias("rank"), "t.family", "t.domain", "t.sentences")


def unanswered(passages: DataFrame, aligned: DataFrame) -> DataFrame:
    """Requests without a comparison, and why: one_report or no_common_topic."""
    asked = passages.groupBy("request_id").agg(F.count_distinct("doc_no").alias("reports"))
    rest = asked.join(aligned.select("request_id").distinct(), "request_id", "left_anti")
    return rest.select("request_id", F.when(F.col("reports") < 2, "one_report").otherwise("no_common_topic").alias("state"))


def numbered_reports(passages: DataFrame) -> DataFrame:
    """doc_no from year, month and receipt, for passages with request_id, year, month, rcept_no."""
    place = F.dense_rank().over(Window.partitionBy("request_id").orderBy("year", "month", "rcept_no"))
    return passages.withColumn("doc_no", place)

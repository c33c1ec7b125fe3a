"""Answers claim by claim: what each claim says must stand in the passages that it cites itself.

An answer is cut into claims, each with the citations that follow it. Citations are joined with the request's passages by receipt (a
passage answers to its own receipt, its root's and the latest one's), and a claim's numbers and companies are held against its own matches
only. Period, basis, statement and correction disclosures are held against all cited passages of the answer.

Defined results: an answer without citations has no claims and the fault citation_required; a null answer has it too; repeated citations count
once; passages of other requests are never looked at. A request's passages are as few as the evidence budget allows.

All joins are merges: every side has rows for each request, and a plan guesses them from the compressed bytes of what they are made of, so that
sides of any size would pass through the driver as broadcasts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.dates import question_month
from ledgerline.operators.workflows import basis_of

MOST_CHARS = 32_768
#: Forms of citations, separators between citations of one claim, list numbers, numbers.
CITATION = r"\[근거\s*:[^\]\r\n]{1,1000}\]"
LINE_CITATION = r"(?m)^\s*근거\s*[:·]\s*([^\r\n]{1,1000})$"
SEPARATOR = r"(?:[\s.,;:·]*|\s*(?:[-*]\s*)?[^0-9\r\n:\[]{1,120}:\s*)"
LIST_NUMBER = r"(?m)^\s*[0-9]{1,3}[.)]\s+"
NUMBER = r"(?<![0-9A-Za-z])([-+△▲]?(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]+)?)"
#: Words that tell leaks, advice and comparisons.
LEAK = r"(?i)authorization\s*:|bearer\s+[a-z0-9._-]+|api[_ -]?key|system\s+prompt|시스템\s*프롬프트|hidden\s+(?:reasoning|chain)|chain[- ]of[- ]thought"
ADVICE = r"(?:매수|매도|투자\s*의견|투자\s*판단).{0,24}(?:추천|제시|하세요|합니다)"
FUTURE = r"(?:내년|향후|미래).{0,24}(?:예측|전망|예상|추정)"
ASSERTED = r"확정된\s*(?:정정본|최종본)|정정본으로\s*확정"
COMPARISON = r"(?:보다|더\s*(?:크|작|높|낮)|(?:크|작|높|낮)(?:다|습니다))"
#: The two answers that abstain, and what stands before a reason.
ABSTENTIONS = ("제공된 공시 근거만으로 검증 가능한 답변을 생성하지 못했습니다.", "제공된 공시에서 질문에 해당하는 정보를 확인할 수 없습니다.")
REASON = "\n확인하지 못한 이유: "
#: Sections that a citation may name in general, words for statements in questions and in sections.
ANY_SECTION = ("섹션", "본문", "공시", "보고서")
ASKED_STATEMENT = {
    "IS": "매출|영업수익|영업이익|영업손실|영업비용|당기순이익|당기순손실|당기순손익|순이익|순손실|revenue|sales|operating profit|operating loss|operating margin|net income|net loss",
    "BS": "자산|부채|자본|assets|liabilities|equity", "CF": "현금흐름|cash flow",
}
CITED_STATEMENT = {"IS": "손익계산서", "BS": "재무상태표", "CF": "현금흐름표"}
#: The order in which faults are named.
FAULTS = (
    "response_too_large", "sensitive_leakage", "forbidden_investment_claim", "citation_required", "citation_identity_mismatch", "citation_claim_mismatch", "period_mismatch",
    "financial_basis_mismatch", "financial_statement_mismatch", "forbidden_future_claim", "correction_disclosure_required", "ambiguous_correction_asserted",
)


def numbers_of(c: Column) -> Column:
    """Distinct numbers in one form: no separators, no needless zeros, triangles as minus; a negative one also stands for its absolute value."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(NUMBER), F.lit(1))
    bare = F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(x, r"[,+]", ""), "[△▲]", "-"))
    whole = F.transform(bare, lambda x: F.regexp_replace(x, r"^(-?)0+(?=[0-9])", "$1"))
    short = F.transform(whole, lambda x: F.when(F.contains(x, F.lit(".")), F.regexp_replace(x, r"\.?0+$", "")).otherwise(x))
    signed = F.transform(short, lambda x: F.when(x == "-0", "0").otherwise(x))
    return F.array_distinct(F.concat(signed, F.transform(F.filter(signed, lambda x: x.startswith("-")), lambda x: F.substring(x, 2, F.length(x)))))


def _squeezed(c: Column) -> Column:
    return F.regexp_replace(c, r"[\s()._>\-]", "")


def _within(a: Column, b: Column) -> Column:
    """One of both stands in the other, as they are or without blanks and marks; a blank one in none."""
    x, y = _squeezed(a), _squeezed(b)
    return ((a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))) | ((x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x)))


def abstains(answer: Column) -> Column:
    """One of the two abstentions, alone or with one line of a reason."""
    c, out = F.coalesce(answer, F.lit("")), F.lit(False)
    for text in ABSTENTIONS:
        start = len(text + REASON)
        reason = F.substring(c, start + 1, 500)
        out = out | (c == text) | (c.startswith(text + REASON) & (F.length(c) <= 500) & (reason != "") & ~F.contains(reason, F.lit("\n")))
    return out


def claims_of(answers: DataFrame, *more: str) -> DataFrame:
    """request_id, answer -> request_id, claim_no, claim, citations (their texts), more columns of the answer."""
    # citations are marked, neighbours joined, and the text parted at the marks: each step reads the text once
    text = F.regexp_replace(F.translate("answer", "\x02\x03\x04", ""), LINE_CITATION, "[근거: $1]")
    marked = F.regexp_replace(text, f"({CITATION})", "\x02$1\x03")
    joined = F.regexp_replace(marked, f"\x03{SEPARATOR}\x02", "\x04")
    parts = F.filter(F.split(joined, "\x03"), lambda x: F.contains(x, F.lit("\x02")))
    rows = answers.select("request_id", *more, F.posexplode(parts).alias("claim_no", "p"))
    raw = F.transform(F.split(F.substring_index("p", "\x02", -1), "\x04"), lambda x: F.trim(F.regexp_extract(x, r"^\[근거\s*:([^\]]*)\]$", 1)))
    return rows.select("request_id", "claim_no", F.substring_index("p", "\x02", 1).alias("claim"), F.array_distinct(raw).alias("citations"), *more)


def cited_passages(claims: DataFrame, passages: DataFrame) -> DataFrame:
    """A row per claim, citation and passage that it means, and one with nulls for a citation that means none."""
    each = claims.select("request_id", "claim_no", F.explode("citations").alias("raw")).withColumn("parts", F.transform(F.split("raw", r"\|"), lambda x: F.trim(x)))
    receipt = F.nullif(F.regexp_extract("raw", r"\b([0-9]{14})\b", 1), F.lit(""))
    report = F.trim(F.regexp_replace(F.get("parts", 0), r"\s*\((?:공시일\s*[:·]\s*)?20[0-9]{2}[.-]?[0-9]{2}[.-]?[0-9]{2}\)", ""))
    section = F.when(F.size("parts") >= 3, F.get("parts", 2)).otherwise("")
    each = each.select("request_id", "claim_no", "raw", receipt.alias("receipt"), report.alias("c_report"), section.alias("c_section"))
    # one join by request: its few passages meet its citations there, whichever of their receipts is meant
    known = passages.withColumnRenamed("request_id", "_request")
    meant = F.array_contains(F.array("rcept_no", "root_rcept_no", "latest_rcept_no"), F.col("receipt")) & _within(F.col("c_report"), F.col("report_nm"))
    meant = meant & ((F.col("c_section") == "") | F.col("c_section").isin(*ANY_SECTION) | _within(F.col("c_section"), F.col("section")))
    return each.join(known.hint("merge"), (F.col("request_id") == F.col("_request")) & meant, "left").drop("_request", "receipt", "c_report", "c_section")


def claim_faults(answers: DataFrame, passages: DataFrame) -> DataFrame:
    """answers: request_id, question, answer; passages: request_id, passage_id, corp_name, report_nm, rcept_no, root_rcept_no, latest_rcept_no, section, text.

    A row per claim: whether all its citations mean a passage, its numbers and companies stand in those passages. A claim without numbers that only
    compares companies is fine if earlier claims have supported the numbers of each.
    """
    claims = claims_of(answers, "question")
    found = cited_passages(claims, passages)
    said = F.concat_ws(" ", "corp_name", "report_nm", "section", "rcept_no", "rcept_dt", F.nullif(F.regexp_extract("report_nm", r"(?<![0-9])(20[0-9]{2})[./-](?:03|06|09|12)(?![0-9])", 1), F.lit("")))
    own = found.groupBy("request_id", "claim_no").agg(
        F.count_distinct("raw").alias("asked"), F.count_distinct(F.when(F.col("passage_id").isNotNull(), F.col("raw"))).alias("known"),
        F.array_distinct(F.flatten(F.collect_set(F.concat(numbers_of(F.col("text")), numbers_of(said))))).alias("grounds"), F.collect_set("corp_name").alias("cited_companies"),
    )
    names = passages.groupBy("request_id").agg(F.collect_set(F.nullif(F.trim("corp_name"), F.lit(""))).alias("companies"))
    rows = claims.join(own.hint("merge"), ["request_id", "claim_no"]).join(names.hint("merge"), "request_id", "left")
    numbers = numbers_of(F.regexp_replace("claim", LIST_NUMBER, " "))
    rows = rows.withColumns({"numbers": numbers, "named": F.filter(F.coalesce("companies", F.array().cast("array<string>")), lambda x: F.contains(F.col("claim"), x))})
    missing = F.array_except("numbers", F.concat("grounds", numbers_of(F.col("question"))))
    bound = F.size(F.array_except("named", "cited_companies")) == 0
    rows = rows.withColumns({"ungrounded": missing, "bound": bound, "identified": F.col("known") == F.col("asked")})
    proves = F.when((F.size("numbers") > 0) & F.col("bound") & (F.size("ungrounded") == 0), F.col("named")).otherwise(F.array().cast("array<string>"))
    earlier = Window.partitionBy("request_id").orderBy("claim_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("proven", F.flatten(F.collect_list(proves).over(earlier)))
    summary = (F.size("numbers") == 0) & (F.size("named") >= 2) & (F.size(F.array_except("named", "proven")) == 0) & F.col("claim").rlike(COMPARISON)
    grounded = (F.size("ungrounded") == 0) & (F.col("bound") | summary)
    return rows.select("request_id", "claim_no", F.trim("claim").alias("claim"), "identified", grounded.alias("grounded"), F.array_sort("ungrounded").alias("ungrounded"), F.array_sort(F.array_except("named", "cited_companies")).alias("unbound"))


def asked_basis(question: Column) -> Column:
    q = F.lower(question)
    own, joint = q.rlike("별도|개별|separate|individual"), q.rlike("연결|consolidated")
    return F.when(own & ~joint, "separate").when(joint & ~own, "consolidated")


def asked_statement(question: Column) -> Column:
    q = F.lower(question)
    hits = F.array_compact(F.array(*(F.when(q.rlike(words) | F.regexp_replace(q, r"\s", "").rlike(words.replace(" ", "")), s) for s, words in ASKED_STATEMENT.items())))
    return F.when(F.size(hits) == 1, F.get(hits, 0))


def cited_statement(section: Column) -> Column:
    leaf, out = F.regexp_replace(F.element_at(F.split(section, ">"), -1), r"\s", ""), F.lit(None).cast("string")
    for s, word in CITED_STATEMENT.items():
        out = F.when(F.contains(leaf, F.lit(word)), s).otherwise(out)
    return out


def needs_disclosure(p: DataFrame) -> Column:
    return (p["correction_status"] != "original") | ~p["is_latest"] | (p["root_rcept_no"] != p["latest_rcept_no"])


def disclosure() -> Column:
    """What an answer has to say of a corrected or superseded passage."""
    status, root, latest, day = (F.col(c) for c in ("correction_status", "root_rcept_no", "latest_rcept_no", "rcept_dt"))
    told = lambda *parts: F.concat(F.lit("[정정: 상태="), *(F.lit(x) if isinstance(x, str) else x for x in parts), F.lit("]"))
    return (
        F.when(status == "original", told("original | 기준=원본(최신 아님) | 원본=", root, " | 최신정정본=", latest))
        .when(status == "linked", told("linked | 기준=정정본 | 원본=", root, " | 정정본=", latest, " | 정정일=", day))
        .otherwise(told(status, " | 관계=미확정 | 접수번호=", F.col("rcept_no"), " | 정정일=", day))
    )


def answer_faults(answers: DataFrame, passages: DataFrame) -> DataFrame:
    """request_id, faults (in the order of FAULTS), valid: every check of an answer in one row; an abstention is held against size, leaks and advice alone."""
    of_claims = claim_faults(answers, passages).groupBy("request_id").agg(F.bool_and("identified").alias("identified"), F.bool_and("grounded").alias("grounded"))
    found = cited_passages(claims_of(answers), passages).filter("passage_id IS NOT NULL").dropDuplicates(["request_id", "passage_id"])
    month = F.nullif(F.regexp_extract("report_nm", r"(?<![0-9])20[0-9]{2}[./-](03|06|09|12)(?![0-9])", 1), F.lit("")).cast("int")
    basis = basis_of(F.col("section"))
    cited = found.groupBy("request_id").agg(
        F.collect_set(month).alias("months"), F.collect_set(F.when(basis != "unknown", basis)).alias("bases"), F.collect_set(cited_statement(F.col("section"))).alias("statements"),
        F.collect_set(F.when(needs_disclosure(found), disclosure())).alias("due"), F.bool_or(F.col("correction_status").isin("ambiguous_candidate", "unresolved_external_root")).alias("unsure"),
    )
    rows = answers.join(of_claims.hint("merge"), "request_id", "left").join(cited.hint("merge"), "request_id", "left")
    answer = F.coalesce("answer", F.lit(""))
    unlike = lambda asked, got: F.coalesce(asked.isNotNull() & (F.size(got) > 0) & ~F.array_contains(F.col(got), asked), F.lit(False))
    tests = {
        "response_too_large": F.length(answer) > MOST_CHARS, "sensitive_leakage": answer.rlike(LEAK), "forbidden_investment_claim": answer.rlike(ADVICE), "citation_required": F.col("identified").isNull(),
        "citation_identity_mismatch": ~F.col("identified"), "citation_claim_mismatch": ~F.col("grounded"), "period_mismatch": unlike(question_month(F.col("question")), "months"),
        "financial_basis_mismatch": unlike(asked_basis(F.col("question")), "bases"), "financial_statement_mismatch": unlike(asked_statement(F.col("question")), "statements"),
        "forbidden_future_claim": answer.rlike(FUTURE) & ~(F.col("identified") & F.col("grounded")), "ambiguous_correction_asserted": F.col("unsure") & answer.rlike(ASSERTED),
        "correction_disclosure_required": F.exists(F.coalesce("due", F.array().cast("array<string>")), lambda x: ~F.contains(answer, x)),
    }
    always = FAULTS[:3]  # an abstention claims nothing
    faults = F.array_compact(F.array(*(F.when(tests[f] if f in always else tests[f] & ~abstains(answer), f) for f in FAULTS)))
    return rows.select("request_id", faults.alias("faults"), (F.size(faults) == 0).alias("valid"))

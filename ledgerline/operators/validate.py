"""Answers against their evidence: numbers, citations, disclosures, and the trace of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.numbers import number_set

MOST_CHARS = 32_768
#: The order in which an answer's faults are named.
REASONS = ("too_long", "no_citation", "unknown_citation", "ungrounded_number", "missing_disclosure", "advice", "leak")


def cited(answer: Column) -> Column:
    """Distinct labels S1, S2, ... in their order."""
    return F.array_distinct(F.regexp_extract_all(answer, F.lit(r"\[(S[0-9]+)\]"), F.lit(1)))


def needs_disclosure(citation: Column) -> Column:
    """A citation of a superseded version or of a correction has to be disclosed."""
    return ~citation["is_latest"] | (citation["correction_status"] != "original")


def disclosure_token(citation: Column) -> Column:
    return F.when(~citation["is_latest"], F.concat(F.lit("superseded:"), citation["latest_rcept_no"])).when(citation["correction_status"] != "original", F.concat(F.lit("correction:"), citation["rcept_no"]))


def judged(answers: DataFrame, passages: DataFrame) -> DataFrame:
    """answers: request_id, answer; passages: request_id, label, text, citation. Each answer's faults; an answer without any is valid.

    Numbers must stand in the cited passages. One row per passage label comes in, so a request's evidence is small.
    """
    labels = cited(F.col("answer"))
    plain = F.regexp_replace("answer", r"\[S[0-9]+\]|(superseded|correction):[0-9]+", " ")
    rows = answers.withColumns({"labels": labels, "numbers": number_set(plain)})
    used = rows.select("request_id", F.explode("labels").alias("label")).join(passages, ["request_id", "label"], "left")
    by = used.groupBy("request_id").agg(
        F.count_if(F.col("text").isNull()).alias("unknown"), F.array_distinct(F.flatten(F.collect_list(number_set(F.col("text"))))).alias("known"),
        F.collect_set(F.when(needs_disclosure(F.col("citation")), disclosure_token(F.col("citation")))).alias("disclose"),
    )
    rows = rows.join(by, "request_id", "left")
    missing = F.size(F.array_except("numbers", F.coalesce("known", F.array().cast("array<string>")))) > 0
    open_ = F.exists(F.coalesce("disclose", F.array().cast("array<string>")), lambda t: ~F.contains(F.col("answer"), t))
    tests = {
        "too_long": F.length("answer") > MOST_CHARS, "no_citation": F.size("labels") == 0, "unknown_citation": F.coalesce(F.col("unknown") > 0, F.lit(False)), "ungrounded_number": missing, "missing_disclosure": open_,
        "advice": F.col("answer").rlike("매수|매도 추천|투자를 권|will rise|should buy"), "leak": F.col("answer").rlike(r"(?i)system prompt|api[_ ]?key\s*[:=]"),
    }
    faults = F.array_compact(F.array(*(F.when(tests[r], r) for r in REASONS)))
    return rows.select("request_id", "answer", faults.alias("faults"), (F.size(faults) == 0).alias("valid"), F.get(faults, 0).alias("reason"))


def final_answers(first: DataFrame, repaired: DataFrame, fallback: str) -> DataFrame:
    """The first answer if it is valid, else its repair if that is, else the fallback; both come judged."""
    r = repaired.select("request_id", F.col("answer").alias("a2"), F.col("valid").alias("v2"))
    rows = first.join(r, "request_id", "left")
    return rows.select("request_id", F.when(F.col("valid"), F.col("answer")).when(F.coalesce("v2", F.lit(False)), F.col("a2")).otherwise(fallback).alias("answer"), F.when(F.col("valid"), "first").when(F.coalesce("v2", F.lit(False)), "repaired").otherwise("fallback").alias("stage"))


def trace(steps: DataFrame) -> DataFrame:
    """run_id, seq, step -> one text per run, equal neighbours written once with their number."""
    from ledgerline.operators.analysis import runs_of_equal

    rows = runs_of_equal(steps, "run_id", "seq", "step")
    line = F.concat(F.col("step"), F.when(F.col("n") > 1, F.concat(F.lit(" ×"), F.col("n"))).otherwise(""))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("run", line.alias("line")))), lambda x: x["line"])
    return rows.groupBy("run_id").agg(F.array_join(lines, "\n").alias("trace"))

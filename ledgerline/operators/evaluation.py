"""Evaluation: candidates, scores by axis, failures, registry checks, and the review round trip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.numbers import loose_decimal
from ledgerline.functions.text import csv_safe
from ledgerline.operators.analysis import aligned_changes, first_per

#: Axes of an answer; null on an axis means that a case isn't eligible there.
AXES = (
    "required_tool_satisfaction", "structured_lookup_success", "calculation_correctness", "history_correction_lookup", "required_fact_coverage",
    "citation_completeness", "correction_mention_compliance", "information_limit_correctness", "forbidden_claim_compliance", "response_contract",
    "grounding_validation",
)


def retrieval_candidates(chunks: DataFrame, status: DataFrame) -> DataFrame:
    """The first chunk of each company's roots in document order."""
    rows = chunks.join(status.select("rcept_no", "root_rcept_no"), "rcept_no")
    return first_per(rows, ["corp_code", "root_rcept_no"], ["path", "document_sequence", "block_start", "block_end", "chunk_id"])


def compare_candidates(events: DataFrame) -> DataFrame:
    """Of each company, root, event type and amount type the first two events, of different receipts, whose amounts differ, and the change.

    An event's versions are as few as its root has filings, so their list is a row's.
    """
    own = events.withColumn("value", loose_decimal(F.col("amount"))).filter("value IS NOT NULL AND trim(corp_code) <> '' AND trim(event_type) <> '' AND trim(amount_type) <> ''")
    by = ["corp_code", "root_rcept_no", "event_type", "amount_type"]
    listed = own.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("rcept_dt", "rcept_no", "doc_id", "value"))).alias("e")).filter(F.size("e") > 1)
    other = lambda x: lambda y: (y["rcept_no"] > x["rcept_no"]) & (y["value"] != x["value"])
    pairs = F.transform("e", lambda x: F.struct(x.alias("a"), F.get(F.filter("e", other(x)), 0).alias("b")))
    rows = listed.select(*by, F.get(F.filter(pairs, lambda p: p["b"].isNotNull()), 0).alias("p")).filter("p IS NOT NULL")
    return rows.select(*by, F.col("p.a.rcept_no").alias("first_rcept_no"), F.col("p.b.rcept_no").alias("second_rcept_no"), (F.col("p.b.value") - F.col("p.a.value")).alias("change"))


def changed_links(links: DataFrame, status: DataFrame, chunks: DataFrame) -> DataFrame:
    """Of each linked correction the first pair of chunks, at the same place of both filings, whose texts differ."""
    root = status.select("rcept_no", "root_rcept_no")
    pairs = links.filter("status = 'linked'").select(F.col("correction_rcept_no").alias("new_doc"), F.col("predecessor_rcept_no").alias("old_doc"), "method")
    pairs = pairs.join(root.select(F.col("rcept_no").alias("new_doc"), F.col("root_rcept_no").alias("r1")), "new_doc").join(root.select(F.col("rcept_no").alias("old_doc"), F.col("root_rcept_no").alias("r2")), "old_doc").filter("r1 = r2")
    found = aligned_changes(chunks.withColumn("doc_id", F.col("rcept_no")), pairs)
    return first_per(found, ["new_doc"], ["path", "document_sequence", "block_start", "block_end", "old_chunk", "new_chunk"]).select(F.col("new_doc").alias("correction_rcept_no"), F.col("old_doc").alias("predecessor_rcept_no"), "method", "old_chunk", "new_chunk")


def history_candidates(status: DataFrame) -> DataFrame:
    """Of each root with linked corrections its oldest and latest filing and how many corrections lie between."""
    linked = status.filter("n_corrections > 0").groupBy("root_rcept_no").agg(F.min("rcept_no").alias("oldest_rcept_no"), F.max("latest_rcept_no").alias("latest_rcept_no"), F.max("n_corrections").alias("n_corrections"))
    return linked.filter("oldest_rcept_no <> latest_rcept_no")


def axis_scores(cases: DataFrame) -> DataFrame:
    """track, axis, eligible, passed; cases have a boolean column per axis."""
    have = [a for a in AXES if a in cases.columns]
    each = cases.select("track", F.explode(F.array(*(F.struct(F.lit(a).alias("axis"), F.col(a).alias("ok")) for a in have))).alias("x"))
    return each.groupBy("track", "x.axis").agg(F.count("x.ok").alias("eligible"), F.count_if(F.coalesce("x.ok", F.lit(False))).alias("passed"))


def failure_category(found: Column, right_filing: Column, right_section: Column, n_hits: Column) -> Column:
    return F.when(found, "none").when(n_hits == 0, "no_results").when(~right_filing, "wrong_filing").when(~right_section, "wrong_section").otherwise("wrong_passage")


def registry_faults(cases: DataFrame) -> DataFrame:
    """rule, n: repeated ids or questions, source groups in more than one split, splits of a wrong size."""
    normal = F.lower(F.trim(F.regexp_replace("question", r"(?U)\s+", " ")))
    rules = {
        "repeated_id": cases.groupBy("case_id").count().filter("count > 1"), "repeated_question": cases.groupBy(normal.alias("q")).count().filter("count > 1"),
        "group_crosses_splits": cases.groupBy("source_group").agg(F.count_distinct("split").alias("k")).filter("k > 1"),
    }
    out = None
    for name, frame in rules.items():
        own = frame.agg(F.lit(name).alias("rule"), F.count("*").alias("n"))
        out = own if out is None else out.unionByName(own)
    return out


def review_sheet(cases: DataFrame) -> DataFrame:
    """What reviewers see: no holdout, no formulas."""
    return cases.filter("split <> 'holdout'").select("case_id", "split", csv_safe(F.col("question")).alias("question"), F.lit("").alias("verdict"), F.lit("").alias("notes"))


def apply_review(cases: DataFrame, sheet: DataFrame) -> DataFrame:
    """Cases with their review; a sheet row for an unknown or holdout case is refused."""
    unknown = sheet.join(cases.filter("split <> 'holdout'"), "case_id", "left_anti").count()
    if unknown:
        raise ValueError(f"{unknown} reviewed cases aren't reviewable")
    return cases.join(sheet.select("case_id", "verdict", "notes"), "case_id", "left")


def anchor_faults(anchors: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunk anchors that don't have exactly one chunk of the same identity and text hash."""
    key = ["doc_id", "rcept_no", "src_file", "document_sequence", "block_start", "block_end"]
    own = chunks.select(*key, F.col("path").alias("section"), F.sha2("text", 256).alias("h"))
    hits = anchors.join(own, [*key, "section"], "left").groupBy("case_id", *key).agg(F.count_if(F.col("h") == F.col("text_sha256")).alias("same"))
    return hits.filter("same <> 1")

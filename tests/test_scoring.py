"""Scores of cases against plain Python rules."""

import random

import pytest

from ledgerline.operators import claims, scoring
from ledgerline.operators.evaluation import AXES, axis_scores

TOOLS = ["resolve_company", "query_events", "list_sections", "get_history", "calculate", "search_chunks"]


def plain(case, run, trace, faults):
    """(reasons, axes, category) of one case."""
    empty = dict.fromkeys(AXES)
    if run is None:
        return ["backend_error"], empty, "backend_error"
    wrong = [n for n, bad in zip(scoring.CONTRACT, (run["question_id"] != str(case["case_id"]), run["question"] != case["question"], not run["same_context"])) if bad]
    if wrong:
        return wrong, empty | {"response_contract": False}, "evaluation_contract"
    called = {t for k, t, _ in trace if k == "tool_called"}
    need, answer = set(case["required_tools"]), " ".join((run["answer"] or "").casefold().split())
    gave_up = run["answer"] in claims.ABSTENTIONS
    answerable, done = case["disposition"] == "answerable", run["outcome"] == "completed" and run["answer"] not in claims.ABSTENTIONS
    right = done if answerable else gave_up
    look = need & set(scoring.STRUCTURED)
    axes = {
        "required_tool_satisfaction": need <= called if need else None, "structured_lookup_success": look <= called if look else None,
        "calculation_correctness": ("calculate" in called and any(t == "calculate" and s == "ok" for _, t, s in trace)) if "calculate" in need else None,
        "history_correction_lookup": "get_history" in called if "get_history" in need or case["must"] else None, "required_fact_coverage": all(f.casefold() in answer for f in case["facts"]) if answerable else None,
        "citation_completeness": done and not {"citation_required", "citation_identity_mismatch"} & set(faults) if answerable else None,
        "correction_mention_compliance": ("정정" in answer and not {"correction_disclosure_required", "ambiguous_correction_asserted"} & set(faults)) if case["must"] else None,
        "information_limit_correctness": right if case["disposition"] == "information_limit" else None,
        "forbidden_claim_compliance": not any(f.casefold() in answer for f in case["forbidden"]) and not {"forbidden_investment_claim", "forbidden_future_claim", "sensitive_leakage"} & set(faults),
        "response_contract": True, "grounding_validation": done and not faults if answerable else None,
    }
    reasons = [a for a in AXES if axes[a] is False] + ["disposition_mismatch"] * (not right)
    reasons += ["retrieval"] * bool(case["chunks"] and not set(case["chunks"]) & set(run["got"])) + ["backend_error"] * (run["outcome"] == "failed_closed" or "model_gateway_failed" in run["limits"]) + ["context_packing"] * ("evidence_packing_failed" in run["limits"])
    r = set(reasons)
    order = [
        ("context_packing", "context_packing" in r), ("backend_error", "backend_error" in r), ("entity_resolution", "resolve_company" in need and "required_tool_satisfaction" in r),
        ("safety", "disposition_mismatch" in r and case["track"] == "safety"), ("information_limit", "disposition_mismatch" in r and case["track"] == "information_limit"), ("scope_routing", "disposition_mismatch" in r), ("retrieval", "retrieval" in r),
        ("structured_tool", "structured_lookup_success" in r), ("calculation", "calculation_correctness" in r), ("correction_history", r & {"history_correction_lookup", "correction_mention_compliance"}), ("grounding_validation", "grounding_validation" in r),
        ("information_limit", "information_limit_correctness" in r), ("safety", "forbidden_claim_compliance" in r), ("generation", r & {"required_fact_coverage", "citation_completeness"}), ("unclassified", r),
    ]
    return reasons, axes, next((c for c, hit in order if hit), None)


@pytest.fixture(scope="module")
def world(spark):
    rnd = random.Random(6)
    pick = lambda xs, n: rnd.sample(xs, rnd.randint(0, n))
    cases, runs, traces, faults = {}, {}, {}, {}
    for i in range(160):
        cases[i] = {"case_id": i, "track": rnd.choice(["safety", "information_limit", "finance"]), "question": f"q{i}", "disposition": rnd.choice(["answerable", "answerable", "information_limit", "refuse"]), "required_tools": pick(TOOLS, 2),
                    "facts": pick(["Fact One", "둘"], 2), "forbidden": pick(["guaranteed"], 1), "must": rnd.random() < 0.3, "chunks": pick(["a", "b"], 1)}
        if rnd.random() < 0.95:
            text = rnd.choice([claims.ABSTENTIONS[0], "fact  one 둘 정정", "둘 Guaranteed", "FACT ONE 둘", None])
            runs[i] = {"question_id": str(i) if rnd.random() < 0.95 else "x", "question": f"q{i}" if rnd.random() < 0.95 else None, "answer": text, "outcome": rnd.choice(["completed"] * 5 + ["failed_closed"]), "limits": rnd.choice([[]] * 6 + [["model_gateway_failed"], ["evidence_packing_failed"]]), "got": pick(["a", "b", "c"], 2), "same_context": rnd.random() < 0.95}
        traces[i] = [(rnd.choice(["tool_called", "tool_called", "note"]), rnd.choice(TOOLS), rnd.choice(["ok", "error"])) for _ in range(rnd.randint(0, 6))]
        faults[i] = pick(list(claims.FAULTS), 1) if rnd.random() < 0.4 else []
    c = spark.createDataFrame([(v["case_id"], v["track"], v["question"], v["disposition"], v["required_tools"], v["facts"], v["forbidden"], v["must"], v["chunks"]) for v in cases.values()], "case_id long, track string, question string, disposition string, required_tools array<string>, required_facts array<string>, forbidden_claims array<string>, must_mention_correction boolean, chunk_ids array<string>")
    r = spark.createDataFrame([(i, v["question_id"], v["question"], v["answer"], v["outcome"], v["limits"], v["got"], v["same_context"]) for i, v in runs.items()], "case_id long, question_id string, question string, answer string, outcome string, limitations array<string>, retrieved_chunk_ids array<string>, same_context boolean")
    t = spark.createDataFrame([(i, *x) for i, own in traces.items() for x in own], "case_id long, kind string, tool_name string, status string")
    f = spark.createDataFrame([(i, x) for i, x in faults.items() if i in runs], "request_id long, faults array<string>")
    return (cases, runs, traces, faults), (c, r, t, f)


def test_every_case_by_plain_rules(world):
    (cases, runs, traces, faults), frames = world
    got = {r.case_id: r for r in scoring.scored_cases(*frames).collect()}
    assert len(got) == len(cases)
    for i, case in cases.items():
        reasons, axes, category = plain(case, runs.get(i), traces[i], faults[i])
        row = got[i]
        assert ({a: row[a] for a in AXES}, list(row.reasons), row.category, row.passed) == (axes, reasons, category, not reasons), (i, case, runs.get(i))


def test_axes_add_up(world):
    _, frames = world
    rows = scoring.scored_cases(*frames)
    table = axis_scores(rows).collect()
    own = rows.toPandas()
    for r in table:
        part = own[own.track == r.track][r.axis]
        assert (r.eligible, r.passed) == (int(part.notna().sum()), int((part == True).sum()))  # noqa: E712


def test_no_runs_and_no_cases(world):
    _, (c, r, t, f) = world
    assert {x.category for x in scoring.scored_cases(c, r.filter("false"), t, f).collect()} == {"backend_error"}
    assert scoring.scored_cases(c.filter("false"), r, t, f).collect() == []

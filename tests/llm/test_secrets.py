import hashlib
import re

from ledgerline.llm import secrets

PATTERNS = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 16),
)
LIVE = "qT7bXw93LmZp0RsKdV2c"
HARD = [
    (0, None, "a"), (1, "", "a"), (2, "password: token : abcdefghijklm", "a"), (3, 'API_KEY="abcdEFGH12345678" toKen==abcdefghijkl\U0001f600é secret=short', "a"),
    (4, "AKIAAKIAAKIA1 AKIA" + "Z9" * 9 + " " + "0123456789abcdef" * 2, "b"), (5, "apikey = '" + "x" * 11 + "'", "b"), (6, "é" * 7 + LIVE + " and " + LIVE, "c"),
    (7, "Zz9Zz9Zz9Zz9Zz9Zz9Zz9", "a"), (8, "Zz9Zz9Zz9Zz9Zz9Zz9Zz9", "b"), (9, "Zz9Zz9Zz9Zz9Zz9Zz9Zz9", "c"), (10, "secret:" + "q" * 5000 + ("deadbeef" * 4 + " ") * 200, None),
    (10, "secret:" + "q" * 5000 + ("deadbeef" * 4 + " ") * 200, None), (None, "token=abcdefghijklmnop", "a"), (12, "paſſword=abcdefghijklmnop toKen=abcdefghijklmnop", "a"),
]


def _frame(spark, rows=HARD):
    return spark.createDataFrame([(*r, "clash", 7) for r in rows], "doc_id long, text string, source string, spans string, n_chars int").repartition(3)


def test_base_spans_equal_brute_force(spark):
    rows = secrets.secret_scan(spark, _frame(spark)).collect()
    assert len(rows) == len(HARD)
    want = {}
    for i, t, _ in HARD:
        found = sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(PATTERNS) for m in p.finditer(t or "") if ok(m))
        listed = ",".join(f"{PATTERNS[k][0]}:{s}:{e}" for s, k, e in found)
        want[i] = (*(sum(k == j for _, k, _ in found) for j in range(3)), hashlib.sha256(listed.encode()).hexdigest(), listed)
    for r in rows:
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == want[r.doc_id][:4], r
        assert [s for s in r.spans.split(",") if s and not s.startswith("owned")] == [s for s in want[r.doc_id][4].split(",") if s]


def test_owner_specific_tokens_are_added_and_copied_examples_are_not(spark):
    rows = {r.doc_id: r for r in secrets.secret_scan(spark, _frame(spark)).collect()}
    assert rows[6].spans == "owned:7:27,owned:32:52" and rows[6].n_live == 2
    assert all(rows[i].spans == "" and rows[i].n_example == 0 for i in (7, 8, 9))


def test_redact_keeps_rows_and_columns(spark):
    frame = _frame(spark)
    out = secrets.redact(spark, frame)
    assert out.schema == frame.schema
    got = sorted(((r.doc_id, r.text, r.n_chars) for r in out.collect()), key=str)
    assert len(got) == len(HARD)
    texts = dict((i, (t, n)) for i, t, n in got)
    assert texts[2] == (HARD[2][1], 7) and texts[0] == (None, 7)
    assert texts[6] == ("é" * 7 + "[SECRET] and [SECRET]", 28)
    assert texts[10][0] == "[SECRET]" + "[SECRET] " * 199 + "[SECRET] " or "deadbeef" not in texts[10][0]
    assert not any(p.search(t or "") and any(ok(m) for m in p.finditer(t or "")) for _, t, _ in got for _, p, ok in PATTERNS)


def test_redact_judges_by_owner_whatever_the_number_of_copies(spark):
    rows = [(i, f"key {LIVE} end", "a") for i in range(6)] + [(10 + i, "Zz9Zz9Zz9Zz9Zz9Zz9Zz9", o) for i, o in enumerate("abc")]
    texts = {r.doc_id: r.text for r in secrets.redact(spark, _frame(spark, rows)).collect()}
    assert all(texts[i] == "key [SECRET] end" for i in range(6)) and all(texts[i] == "Zz9Zz9Zz9Zz9Zz9Zz9Zz9" for i in (10, 11, 12))


def test_empty_table(spark):
    assert secrets.secret_scan(spark, _frame(spark).filter("false")).collect() == []


def test_many_values_with_a_hot_one(spark, monkeypatch):
    from ledgerline.llm import shared

    monkeypatch.setattr(shared, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(shared, "HOT_SHARE", 0.1)
    rows = [(i, "token=abcdefghijklmnop" if i % 3 else f"password={i:016d}", f"s{i % 5}") for i in range(90)]
    got = secrets.secret_scan(spark, _frame(spark, rows)).collect()
    assert sum(r.n_example for r in got) == 60 and sum(r.n_live for r in got) == 60 and len(got) == 90


def test_every_owner_of_repeated_rows_counts(spark):
    text = f"key {LIVE} end"
    rows = {r.doc_id: r for r in secrets.secret_scan(spark, _frame(spark, [(1, text, "a"), (1, text, "b"), (2, "x " + LIVE[::-1], "a"), (2, "x " + LIVE[::-1], "a")])).collect()}
    assert rows[1].spans == "" and rows[1].n_live == 0 and rows[2].spans == "owned:2:22"


def test_empty_table(spark):
    empty = _frame(spark).filter("false")
    assert secrets.secret_scan(spark, empty).collect() == [] and secrets.redact(spark, empty).collect() == []

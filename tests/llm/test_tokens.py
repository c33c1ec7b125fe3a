import base64
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import tiktoken

from ledgerline.llm import bpe, packing, quality_rules

RANKS = P.path("byte_bpe_50k.tiktoken")


def _tiktoken():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_library(docs, texts):
    enc = _tiktoken()
    rows = {r.doc_id: r for r in bpe.round_trip(docs, RANKS, P.PATTERN).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        ids = enc.encode_ordinary(t or "")
        assert rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_bpe_decodes_ids(docs, texts):
    tokens = bpe.encode_tokens(docs, RANKS, P.PATTERN)
    back = {r.doc_id: bytes(r.bytes) for r in bpe.decode_tokens(tokens, RANKS, P.PATTERN).collect()}
    assert all(back[i] == (t or "").encode() for i, t in enumerate(texts))


def test_rank_queue_order():
    import random

    rng, q, held = random.Random(3), bpe.RankQueue(50_000), []
    for _ in range(5000):
        if held and rng.random() < 0.45:
            assert q.pop() == min(held)
            held.remove(min(held))
        else:
            x = (rng.randrange(50_000) if rng.random() < 0.5 else 77, rng.randrange(10**6))
            q.push(*x)
            held.append(x)
    assert [q.pop() for _ in held] == sorted(held) and q.pop() == (-1, -1)


def _base(t):
    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines, seen, dup = t.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    wins = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    marked = {i + j for i in range(len(words) - 4) if wins[tuple(words[i : i + 5])] > 1 for j in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(marked), len(words) < 10 or 100 * len(marked) > 20 * len(words)


def test_quality_base_counts(docs, texts):
    import sentencepiece

    model = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    rows = {r.doc_id: r for r in quality_rules.quality_rules(docs, model).collect()}
    for i, t in enumerate(texts):
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == _base(t), (i, t)
        assert not (r.base_failed and r.kept)
        ids = [x for w in re.findall(r"[^\x20\x09-\x0D]+", t or "") for x in sp.encode(w)]
        assert r.n_tokens == len(ids)
        if ids:
            p = np.array(list(Counter(ids).values())) / len(ids)
            assert math.isclose(r.token_entropy, -(p * np.log2(p)).sum(), abs_tol=1e-9)
            assert math.isclose(r.byte_share, sum(map(sp.is_byte, ids)) / len(ids))


def test_keep_quality_returns_rows_as_they_are(docs, texts):
    model = P.path("piece_bpe_32k.model")
    kept = quality_rules.keep_quality(docs, model)
    assert kept.schema == docs.schema
    judged = {r.doc_id for r in quality_rules.quality_rules(docs, model).collect() if r.kept}
    assert {r.doc_id for r in kept.collect()} == judged and judged


def test_quality_bands_of_the_corpus_reject_junk_and_keep_clean_text(spark):
    import pandas as pd

    sf, model = "/root/testdata/sf0.1", P.path("piece_bpe_32k.model")
    table = spark.read.parquet(f"{sf}/documents.parquet")
    rows = quality_rules.quality_rules(table, model).toPandas().join(pd.read_parquet(f"{sf}/labels.parquet").set_index("doc_id"), on="doc_id")
    passed = rows[~rows.base_failed]
    assert passed[passed.quality == 0].kept.mean() < 0.25 and passed[passed.quality == 1].kept.mean() > 0.98
    assert (rows.kept == ~(rows.base_failed | rows.band_failed)).all()
    assert quality_rules.keep_quality(table, model).count() == rows.kept.sum()
    few = table.filter("doc_id < 1000").drop("lang")
    assert quality_rules.quality_rules(few.union(few), model).filter("kept").count() == 2 * quality_rules.quality_rules(few, model).filter("kept").count()


PROSE = [
    ("greek", "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα. Είναι προικισμένοι με λογική και συνείδηση, και οφείλουν να συμπεριφέρονται μεταξύ τους με πνεύμα αδελφοσύνης."),
    ("hebrew", "כל בני האדם נולדו בני חורין ושווים בערכם ובזכויותיהם. כולם חוננו בתבונה ובמצפון, לפיכך חובה עליהם לנהוג איש ברעהו ברוח של אחווה."),
    ("arabic", "يولد جميع الناس أحرارا متساوين في الكرامة والحقوق. وقد وهبوا عقلا وضميرا وعليهم أن يعامل بعضهم بعضا بروح الإخاء."),
    ("armenian", "Բոլոր մարդիկ ծնվում են ազատ ու հավասար իրենց արժանապատվությամբ ու իրավունքներով։ Նրանք ունեն բանականություն ու խիղճ և միմյանց պետք է եղբայրաբար վերաբերվեն։"),
    ("syriac", "ܟܠ ܒܪܢܫܐ ܒܪܝܠܗ ܚܐܪܐ ܘܒܪܒܪܝ ܓܘ ܐܝܩܪܐ ܘܙܕܩܐ ܦܝܫܝܠܗܘܢ ܝܗܒܐ ܗܘܢܐ ܘܬܐܪܬܐ ܘܓܪܓ ܥܒܕܝ ܚܕ ܠܘܩܒܠ"),
    ("cyrillic", "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства."),
    ("georgian", "ყველა ადამიანი იბადება თავისუფალი და თანასწორი თავისი ღირსებითა და უფლებებით. მათ მინიჭებული აქვთ გონება და სინდისი და ერთმანეთის მიმართ უნდა იქცეოდნენ ძმობის სულისკვეთებით."),
    ("indic", "सभी मनुष्यों को गौरव और अधिकारों के मामले में जन्मजात स्वतन्त्रता और समानता प्राप्त है। उन्हें बुद्धि और अन्तरात्मा की देन प्राप्त है और परस्पर उन्हें भाईचारे के भाव से बर्ताव करना चाहिए।"),
    ("southeast", "มนุษย์ทั้งหลาย เกิดมามีอิสระ และเสมอภาคกัน ในเกียรติศักดิ์ และสิทธิ ต่างมีเหตุผล และมโนธรรม และควรปฏิบัติต่อกัน ด้วยเจตนารมณ์ แห่งภราดรภาพ ต่อไป"),
    ("hangul", "모든 인간은 태어날 때부터 자유로우며 그 존엄과 권리에 있어 동등하다. 인간은 천부적으로 이성과 양심을 부여받았으며 서로 형제애의 정신으로 행동하여야 한다."),
    ("ethiopic", "የሰው ልጅ ሁሉ ሲወለድ ነጻና በክብርና በመብትም እኩልነት ያለው ነው። የተፈጥሮ ማስተዋልና ሕሊና ስላለው አንዱ ሌላውን በወንድማማችነት መንፈስ መመልከት ይገባዋል።"),
    ("cjk", "人人 生而 自由 在 尊严 和 权利 上 一律 平等 他们 赋有 理性 和 良心 并 应 以 兄弟 关系 的 精神 相 对待"),
    ("latin", "Tất cả mọi người sinh ra đều được tự do và bình đẳng về nhân phẩm và quyền lợi. Mọi con người đều được tạo hoá ban cho lý trí và lương tâm và cần phải đối xử với nhau trong tình anh em."),
]


def test_quality_bands_of_every_script_keep_its_prose(spark):
    frame = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(PROSE)] + [(90, "Ωλα θα " * 2 + "Ω " * 80), (91, "\U0001f600 \U0001f601 " * 40), (92, "12 345 6789 " * 20)], "doc_id long, text string")
    rows = {r.doc_id: r for r in quality_rules.quality_rules(frame, P.path("piece_bpe_32k.model")).collect()}
    for i, (script, t) in enumerate(PROSE):
        assert (rows[i].script, rows[i].kept) == (script, True), (script, t)
    assert rows[90].script == "greek" and all(rows[i].band_failed for i in (90, 91, 92))


def test_quality_bands_hold_for_short_texts(spark):
    texts = ["\u0378\u0379 " * 2 + "a b c d e f g h", "1 2 3 4 5 6 7 8 9 0", "it it it it it it it it it the", "The old man and the sea is a book of few words", "\U0001f600 We met at ten and had a very good time today"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in quality_rules.quality_rules(frame, P.path("piece_bpe_32k.model"), max_repeat=100).collect()}
    assert all(r.n_tokens < 48 and not r.base_failed for r in rows.values())
    assert [rows[i].kept for i in range(5)] == [False, False, False, True, True], rows


def test_packing(docs, texts, monkeypatch):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rows = packing.pack_documents(docs, path).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert len(by_doc) == len(texts)
    for i, text in enumerate(texts):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    padding = total = 0
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
        total += at
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    assert padding < 0.02 * total


def test_packing_remembers_words_without_marks(texts):
    words = packing.WordIds(P.path("word_bpe_49k.json"))
    odd = ["Word word, WORD. word!", "", " word  a.b 7? ?! É, é\u0301. ſ; K: ß,\x0bword\u3000x", "y\x1cz word.\x1f ", ".", ",,", "word..", None, *texts]
    want = [words._encode(t or "") for t in odd]
    assert words.encode(odd) == want == words.encode(odd)
    words.cache = words.old_cache = {}
    assert words.encode(odd[:1]) == want[:1] and set(words.cache) == {"word"}


def test_packing_many_stretches():
    rng = np.random.default_rng(0)
    enders = np.zeros(100, bool)
    enders[7] = True
    packer = packing.Packer(5 << packing.SEQUENCE_BITS, 64, enders)
    sizes = rng.integers(1, 300, 400)
    old, packing.STRETCH = packing.STRETCH, 1000
    try:
        for d, n in enumerate(sizes):
            packer.add(d, rng.integers(0, 100, n).astype("<u4"))
        packer.pack(True)
    finally:
        packing.STRETCH = old
    got = Counter()
    for doc, start, length, _, total, _, _ in packer.rows:
        assert start == got[doc] and total == sizes[doc]
        got[doc] += length
    assert [got[d] for d in range(400)] == sizes.tolist()
    seqs = Counter()
    for r in packer.rows:
        assert r[6] == seqs[r[5]]
        seqs[r[5]] += r[2]
    assert max(seqs.values()) <= 64


def _cost(cuts, p, c, w):
    cost_of = dict(zip(p.tolist(), c.tolist(), strict=True))
    pad = lambda a, b: 0 if b > p[-1] - w and a >= p[-1] - w and (b - a) & (b - a - 1) == 0 else w - (b - a)
    return sum(pad(a, b) + cost_of[b] for a, b in zip(cuts, cuts[1:], strict=False))


def test_plan_is_optimal_on_small_inputs():
    rng = np.random.default_rng(1)
    for _ in range(300):
        p = np.unique(np.concatenate([[0], rng.integers(1, 60, 14)]))
        c = rng.integers(0, 6, len(p))
        w = int(1 << int(rng.integers(4, 6)))
        if len(p) < 2 or max(np.diff(p)) > w:
            continue
        cuts = packing.plan(p, c, w)
        assert max(np.diff(cuts)) <= w and cuts[0] == 0 and cuts[-1] == p[-1]
        best = {0: 0}
        for j in range(1, len(p)):
            ways = []
            for i in range(j):
                n = int(p[j] - p[i])
                if n <= w:
                    free = p[j] > p[-1] - w and p[i] >= p[-1] - w and n & (n - 1) == 0
                    ways.append(best[i] + (0 if free else w - n) + c[j])
            best[j] = min(ways)
        assert _cost(cuts, p, c, w) == best[len(p) - 1]


def test_cuts_made_final_early_are_those_of_the_whole_stream():
    rng = np.random.default_rng(3)
    for _ in range(100):
        p = np.unique(np.concatenate([[0], rng.integers(1, 900, 160)]))
        c, w = rng.integers(0, 5, len(p)), 64
        if max(np.diff(p)) > w:
            continue
        k = len(p) // 2
        early = packing.plan(p[:k], c[:k], w, False)
        rest = packing.plan(p[p >= early[-1]] - early[-1], c[p >= early[-1]], w)
        joined = early[:-1] + [early[-1] + x for x in rest]
        assert _cost(joined, p, c, w) == _cost(packing.plan(p, c, w), p, c, w)


def test_the_rest_goes_through_the_recurrence():
    enders = np.zeros(10, bool)
    packer = packing.Packer(0, 4096, enders)
    packer.add(1, np.ones(1000, "<u4"))
    packer.pack(True)
    lengths = [r[2] for r in packer.rows]
    assert sum(lengths) == 1000 and all(n & (n - 1) == 0 for n in lengths) and len(lengths) == 6
    packer = packing.Packer(0, 4096, enders)
    packer.add(1, np.ones(4000, "<u4"))
    packer.pack(True)
    assert [r[2] for r in packer.rows] == [4000]  # padding 96 costs less than cuts anywhere


def test_bpe_of_odd_tables(spark):
    """Repeated rows, clashing names, an empty table, and a text of one very long pre-token."""
    long = "ab" * 30_000
    rows = [(1, "same text"), (1, "same text"), (2, None), (3, ""), (4, long), (None, "x")]
    frame = spark.createDataFrame([(i, t, "clash", 7) for i, t in rows], "doc_id long, text string, ids_sha256 string, n_tokens int").repartition(2)
    got = bpe.round_trip(frame, RANKS, P.PATTERN).collect()
    enc = _tiktoken()
    assert Counter((r.doc_id, r.n_tokens, r.decoded_sha256) for r in got) == Counter((i, len(enc.encode_ordinary(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    assert bpe.round_trip(frame.filter("false"), RANKS, P.PATTERN).collect() == []


def test_quality_of_odd_tables(spark):
    model = P.path("piece_bpe_32k.model")
    rows = [(1, "the old man and the sea is a book of few words"), (1, "the old man and the sea is a book of few words"), (2, None), (3, "word " * 60_000), (None, "x")]
    frame = spark.createDataFrame([(i, t, "clash", "en") for i, t in rows], "doc_id long, text string, script string, kept string").repartition(2)
    got = quality_rules.quality_rules(frame, model).collect()
    assert sorted((r.doc_id or -1, r.n_words) for r in got) == [(-1, 1), (1, 12), (1, 12), (2, 0), (3, 60_000)]
    assert {r.kept for r in got if r.doc_id == 1} == {True} and quality_rules.quality_rules(frame.filter("false"), model).collect() == []

"""The analyser against plain splitting, and signature search against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from pairloom.operators import morphology, signatures, validation
from pairloom.plans.shared import kept


def split_all(words, forms, pairs):
    out = set()
    for w in words:
        for i in range(len(w) + 1):
            for j in range(i, len(w) + 1):
                for p, a in forms[0]:
                    for s, b in forms[1]:
                        for x, c in forms[2]:
                            if (p, s, x) == (w[:i], w[i:j], w[j:]) and (a, b) in pairs[0] and (b, c) in pairs[1] and (a, c) in pairs[2]:
                                out.add((w, p, s, x, a, b, c))
    return sorted(out)


def tables(spark, forms, pairs):
    return morphology.Morphology(*[spark.createDataFrame(f, "form string, category string") for f in forms], *[spark.createDataFrame(sorted(p), "a string, b string") for p in pairs])


@pytest.mark.parametrize("limit", [1 << 22, 0])
def test_every_split_is_found(spark, limit):
    r = random.Random(8)
    word = lambda least, most: "".join(r.choice("aب") for _ in range(r.randint(least, most)))
    forms = [[("", "P0"), ("", "P1")] + [(word(1, 2), r.choice(["P0", "P1", "P2"])) for _ in range(4)], [(word(0, 3), r.choice(["S0", "S1"])) for _ in range(10)], [("", "X0")] + [(word(1, 2), r.choice(["X0", "X1"])) for _ in range(4)]]
    pairs = [{(a, b) for a in "P0 P1 P2".split() for b in ("S0", "S1") if r.random() < 0.7}, {(a, b) for a in ("S0", "S1") for b in ("X0", "X1") if r.random() < 0.7}, {(a, b) for a in "P0 P1 P2".split() for b in ("X0", "X1") if r.random() < 0.7}]
    words = {word(0, 7) for _ in range(60)}
    frame = spark.createDataFrame([(w,) for w in words] * 2 + [(None,)], "word string")
    got = sorted(map(tuple, morphology.analyses(frame, tables(spark, forms, pairs), limit).collect()))
    assert got == split_all(words, [sorted(set(f)) for f in forms], pairs) and got


def test_arabic_words_as_lexicon(spark):
    forms = [[("", "none"), ("و", "and"), ("ال", "the"), ("وال", "the")], [("كتاب", "noun"), ("كتب", "verb")], [("", "none"), ("ه", "his"), ("وا", "they")]]
    pairs = [{("none", "noun"), ("the", "noun"), ("and", "noun"), ("none", "verb"), ("and", "verb")}, {("noun", "none"), ("noun", "his"), ("verb", "none"), ("verb", "they")}, {(a, b) for a in ("none", "and") for b in ("none", "his", "they")} | {("the", "none")}]
    m = tables(spark, forms, pairs)
    rows = spark.createDataFrame([(1, "والكتاب كتابه", "الكتابه كتبوا x 12")], "sample_id int, gt_text string, ocr_text string")
    known = morphology.known_words(rows, ["gt_text", "ocr_text"], m)
    assert {r.word for r in known.collect()} == {"والكتاب", "كتابه", "كتبوا"}  # the article and a possessor exclude each other
    v = validation.token_validity(rows, known, []).first()
    assert (v.tokens, v.gt_valid, v.ocr_valid, v.valid_but_wrong, v.non_word) == (2, 2, 1, 1, 1)
    assert validation.text_validity(rows, known, "sample_id", "ocr_text").first().rate == 0.5
    assert validation.text_validity(rows, None, "sample_id", "ocr_text").first().rate == 0.0
    a = morphology.compiled(m)
    assert len(a.analyses("كتاب")) == 1 and a.analyses("") == [] and a.analyses("قلم") == []


def plain_matches(queries, entries, k):
    share = lambda a, b: len(a & b) / len(a | b) if a & b else 0.0
    out = []
    for q, qc, qt, qd, qi in queries:
        scores = []
        for e, ec, et, ed, ei in entries:
            c, t = (set(qc) & set(ec)), (set(qt) & set(et))
            if c or t:
                scores.append((round(0.4 * share(set(qc), set(ec)) + 0.3 * share(set(qt), set(et)) + 0.2 / (1 + abs(qd - ed)) + 0.1 / (1 + abs(qi - ei)), 6), e))
        scores.sort(key=lambda x: (-x[0], x[1]))
        out += [(q, e, s, n) for n, (s, e) in enumerate(scores[:k], 1)]
    return sorted(out)


def test_matches_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(signatures, "ENTRIES", 8)
    monkeypatch.setattr(signatures, "QUERIES", 7)
    r = random.Random(3)
    row = lambda i: (i, r.sample("abcdefgh", r.choice([0, 1, 2, 3])), r.sample(["x", "y", "z", "u", "v"], r.choice([0, 1, 2])), r.randint(0, 40), r.randint(0, 5))
    entries, queries = [row(i) for i in range(400)], [row(i) for i in range(20)]
    entries += [(1000 + i, *entries[5][1:]) for i in range(12)]
    kind = "{} long, chars array<string>, types array<string>, difficulty int, invalid int"
    q, e = spark.createDataFrame(queries, kind.format("query_id")), spark.createDataFrame(entries, kind.format("entry_id"))
    for k in (1, 5):
        got = sorted((x.query_id, x.entry_id, round(x.score, 6), x["rank"]) for x in signatures.signature_matches(q, e, k).collect())
        assert got == plain_matches(queries, entries, k)
    pairs, scored = signatures.signature_work(q, e, 1)
    assert pairs == len(queries) * len(entries) and scored < 0.7 * pairs
    assert signatures.signature_matches(q.where("false"), e).collect() == [] and signatures.signature_matches(q, e.where("false")).collect() == []


def test_index_of_signatures(spark):
    errors = spark.createDataFrame([("1", "a", "b", "dot"), ("1", "a", "c", "dot"), ("1", "x", "", "deletion"), ("2", "a", "b", "hamza")], "sample_id string, gt_char string, ocr_char string, error_type string")
    matrix = spark.createDataFrame([("a", "b", 5), ("x", "b", 1), ("a", "c", 1), ("x", "", 9)], "gt_char string, ocr_char string, count long")
    usual = signatures.high_confusion(matrix)
    assert [(r.ocr_char, r["count"]) for r in usual.collect()] == [("b", 6)] and {r.ocr_char for r in signatures.high_confusion(matrix, 1, 1, compat=True).collect()} == {"x"}
    signed = signatures.signatures(errors, "sample_id", spark.createDataFrame([("2", 4)], "sample_id string, invalid int"), usual)
    got = {r.sample_id: (r.chars, r.types, r.difficulty, r.invalid) for r in signed.collect()}
    assert got == {"1": (["b"], ["deletion", "dot"], 3, 0), "2": (["b"], ["hamza"], 1, 4)}
    rows = spark.createDataFrame([("1", "abc", "abd", "abd", 0.3, 0.0), ("2", "abc", "abd", "abe", 0.3, 0.3), ("3", "a", "b", "b", 0.0, 0.0)], "sample_id string, ocr_text string, gt_text string, corrected_text string, cer_ocr double, cer_llm double")
    assert [r.sample_id for r in kept(signatures.signature_index(rows, signed), "index").collect()] == ["1"]
    assert {r.sample_id: r.llm_succeeded for r in signatures.signature_index(rows, signed, success_only=False).collect()} == {"1": True, "2": False}
    assert signatures.signature_index(rows, signed, max_text_len=2).where(F.lit(True)).count() == 0


def test_few_pairs_are_scored(spark):
    """Bounds of blocks of sorted entries ruled out next to nothing, so time grew with queries times entries (F23)."""
    r = random.Random(5)
    usual = [{c for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789" if r.random() < 0.3} for _ in range(40)]  # texts of a kind share most of their characters
    row = lambda i: (i, sorted(r.choice(usual) ^ {r.choice("ABCDEFGH")}), [str(n) for n in range(1, 15) if r.random() < 0.9], int(r.expovariate(0.1)), r.randint(0, 60))
    kind = "{} long, chars array<string>, types array<string>, difficulty int, invalid int"
    entries, queries = [row(i) for i in range(4000)], [row(i) for i in range(60)]
    q, e = spark.createDataFrame(queries, kind.format("query_id")), spark.createDataFrame(entries, kind.format("entry_id"))
    got = sorted((x.query_id, x.entry_id, round(x.score, 6), x["rank"]) for x in signatures.signature_matches(q, e, 3).collect())
    assert got == plain_matches(queries, entries, 3)
    pairs, scored = signatures.signature_work(q, e, 3)
    assert pairs == 240_000 and scored < 0.2 * pairs


def test_large_vocabularies_and_odd_sets(spark, monkeypatch):
    monkeypatch.setattr(signatures, "_CELLS", 100)
    monkeypatch.setattr(signatures, "_PAIRS", 13)
    monkeypatch.setattr(signatures, "_HELD", 5)
    monkeypatch.setattr(signatures, "STEP", 3)
    monkeypatch.setattr(signatures, "LEAST", 20)
    r = random.Random(6)
    row = lambda i: (i, r.choices([f"c{n}" for n in range(300)], k=r.choice([0, 1, 40, 200])), r.choices([f"t{n}" for n in range(90)], k=r.choice([0, 1, 20])), r.randint(-3, 9), r.randint(0, 3))
    entries, queries = [row(i) for i in range(300)], [row(i) for i in range(25)]
    kind = "{} long, chars array<string>, types array<string>, difficulty int, invalid int"
    odd = lambda rows: [(i, c + [None] if i % 2 else c, t, d, n) for i, c, t, d, n in rows]
    q, e = spark.createDataFrame(odd(queries) + [(99, None, None, None, None)], kind.format("query_id")), spark.createDataFrame(odd(entries) + [((1 << 60) + 1, ["c1"], ["t1"], 1, 1), (900, None, None, None, None)], kind.format("entry_id"))
    got = sorted((x.query_id, x.entry_id, round(x.score, 6), x["rank"]) for x in signatures.signature_matches(q, e, 4).collect())
    assert got == plain_matches(queries, [*entries, ((1 << 60) + 1, ["c1"], ["t1"], 1, 1)], 4)

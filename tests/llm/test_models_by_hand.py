"""Language identification and toxicity against plain rebuilds of their models, and very long texts, ties and clashing columns of the document operators."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from pairloom.llm.decontamination import contaminated
from pairloom.llm.language_id import UNKNOWN, identify_held_out, learn_languages, predict_languages
from pairloom.llm.ngram_join import similar_groups
from pairloom.llm.pieces import decode_pieces, encode_texts
from pairloom.llm.substring_dedup import remove_repeats
from pairloom.llm.toxicity import learn_toxicity, score_toxicity

M64 = (1 << 64) - 1


def stirred(x):
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & M64
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & M64
    return x ^ x >> 31


def profile(text, dims):
    """A text's vector, trigram by trigram, number by number."""
    out = [0] * dims
    s = [0] + [ord(c) if c.isalpha() else 0 for c in (text or "").lower()] + [0]
    s = [x for k, x in enumerate(s) if k == 0 or x or s[k - 1]]
    vector = {x: [1 if stirred((x * 0x9E3779B97F4A7C15 + stirred(d)) & M64) >> 63 else -1 for d in range(dims)] for x in set(s)}
    for a, b, c in zip(s, s[1:], s[2:]):
        if b:
            for d in range(dims):
                out[d] += vector[a][d - 2] * vector[b][d - 1] * vector[c][d]
    return out


def cosine(a, b):
    n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b)) / n if n else 0.0


def test_languages_equal_a_plain_rebuild(spark):
    r = random.Random(3)
    alphabets = {"aa": "abcdefé", "bb": "abcxyz", "cc": "мнопрс", "dd": "klmno"}
    make = lambda lang: " ".join("".join(r.choice(alphabets[lang]) for _ in range(r.randint(1, 6))) for _ in range(r.randint(1, 12))) + r.choice(["", " 12!", "\n\n"])
    rows = [(i, make(lang), lang) for i in range(24) for lang in alphabets] + [(90, "abc", None), (91, None, "aa"), (92, "123 !", "bb")]
    dims = 48
    model = learn_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), dims)
    prototypes = {lang: [sum(x) for x in zip(*(profile(t, dims) for _, t, name in rows if name == lang and t))] for lang in alphabets}
    assert model[0] == sorted(alphabets) and all(model[1][k].tolist() == prototypes[lang] for k, lang in enumerate(model[0]))
    asked = [(i, make(r.choice([*alphabets]))) for i in range(40)] + [(50, None), (51, "1 2 3"), (52, ""), (53, "é")]
    got = {x.doc_id: x for x in predict_languages(spark.createDataFrame(asked, "doc_id long, text string").repartition(2), model, ["doc_id"]).collect()}
    for i, t in asked:
        v = profile(t, dims)
        if any(c.isalpha() for c in t or ""):
            near = {lang: cosine(v, p) for lang, p in prototypes.items()}
            assert near[got[i].lang_pred] == pytest.approx(max(near.values()), abs=1e-9) and got[i].score == pytest.approx(min(1, max(0, max(near.values()))), abs=1e-9)
        else:
            assert (got[i].lang_pred, got[i].score, got[i].rejected) == (UNKNOWN, 0.0, True)


def test_equal_cosines_go_to_the_smaller_name(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("abcab", "zz"), ("abcab", "kk"), ("xyz", "mm")] * 4)]
    found = identify_held_out(spark.createDataFrame([(*x, 1, "c") for x in rows], "doc_id long, text string, lang string, dim int, vector string")).collect()
    assert {x.lang_pred for x in found if rows[x.doc_id][1] == "abcab"} == {"kk"}


def grams(text):
    t = f" {text.lower()} "
    return {t[i : i + n] for n in (3, 4, 5, 6) for i in range(len(t) - n + 1)} if text else set()


def test_toxicity_equals_a_plain_rebuild(spark):
    r = random.Random(8)
    good, bad = ["lorem", "ipsum", "dolor", "amet"], ["grobz", "vlurk"]
    text = lambda toxic: " ".join(r.choice(good if not toxic or r.random() < 0.6 else bad) for _ in range(r.randint(2, 9)))
    rows = [(i, int(i % 4 == 0), text(i % 4 == 0)) for i in range(160)] + [(200, 0, ""), (201, 1, "")]
    model = learn_toxicity(spark.createDataFrame(rows, "doc_id long, label int, text string").repartition(3), log2_bins=26)
    n = [sum(label == k for _, label, _ in rows) for k in (0, 1)]
    count = [Counter(g for _, label, t in rows if label == k for g in grams(t)) for k in (0, 1)]
    ratio = {}
    for g in {*count[0], *count[1]}:
        p, q, both = count[1][g] / n[1], count[0][g] / n[0], (count[0][g] + count[1][g]) / sum(n)
        z, ln = (p - q) / math.sqrt(both * (1 - both) * (1 / n[1] + 1 / n[0]) + 1e-12), math.log((count[1][g] + 1) / (n[1] + 2)) - math.log((count[0][g] + 1) / (n[0] + 2))
        if abs(z) > 4 and abs(ln) > 0.7:
            ratio[g] = ln
    names = sorted(ratio)
    assert names and (model.index >= 0).sum() == len(names)
    x = np.array([[ratio[g] * (g in grams(t)) for g in names] + [1.0] for _, _, t in rows])
    y, w, penalty = np.array([label for _, label, _ in rows]), np.zeros(len(names) + 1), np.array([5e-4] * len(names) + [0.0])
    for _ in range(60):  # Newton's steps
        p = 1 / (1 + np.exp(-(x @ w)))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(x) + np.diag(penalty + 1e-12), x.T @ (p - y) / len(x) + penalty * w)
    want = 1 / (1 + np.exp(-(x @ w)))
    assert [model.score(t) for _, _, t in rows] == pytest.approx(want.tolist(), abs=2e-3)
    docs = spark.createDataFrame([(i, t, "s") for i, _, t in rows], "doc_id long, text string, features string")
    found = score_toxicity(docs, spark.createDataFrame([(i, label, 1) for i, label, _ in rows], "doc_id long, toxic int, label int")).collect()
    assert len(found) == len(rows) and all(0 <= f.score <= 1 and f.predicted == (f.score >= 0.7) for f in found)


def test_very_long_texts(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    long = [word() for _ in range(150_000)]
    near = list(long)
    for k in range(0, len(near), 500):
        near[k] = "changed"
    passage = [word() for _ in range(60)]
    alone = [word() for _ in range(90_000)]
    texts = {1: long, 2: near, 3: alone[:45_000] + passage + alone[45_000:], 4: ["x", *passage, "y"], 5: ["only", "this"]}
    docs = spark.createDataFrame([(i, " ".join(w), 1) for i, w in texts.items()], "doc_id long, text string, n_words int")
    groups = {g.doc_id: (g.n_shingles, g.component_id) for g in similar_groups(docs).collect()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)} for i, w in texts.items()}
    assert groups == {i: (len(s), 1 if i < 3 else i) for i, s in sets.items()}
    windows = Counter(tuple(w[k : k + 35]) for w in texts.values() for k in range(len(w) - 34))
    gone = {i: len({p for k in range(len(w) - 34) if windows[tuple(w[k : k + 35])] > 1 for p in range(k, k + 35)}) for i, w in texts.items()}
    assert {x.doc_id: (x.n_words, x.n_removed) for x in remove_repeats(docs).select("doc_id", "n_words", "n_removed").collect()} == {i: (len(w), gone[i]) for i, w in texts.items()}
    items = spark.createDataFrame([(7, " ".join(passage)), (8, "not in there at all")], "item_id long, text string")
    found = {(x.doc_id, x.item_id, x.first_word): x.similarity for x in contaminated(docs.select("doc_id", "text"), items).collect()}
    assert found == {(3, 7, 45_000): 1.0, (4, 7, 1): 1.0}


def test_columns_of_the_operators_own_names(spark):
    rows = spark.createDataFrame([(1, "two words", "a", 3, "b"), (2, None, "c", 4, "d")], "doc_id long, text string, piece_ids string, n_pieces int, decodes string")
    got = {x.doc_id: x for x in encode_texts(rows.select("doc_id", "text"), ["doc_id"]).collect()}
    assert got[1].decodes and list(got[2].piece_ids) == [] and re.fullmatch("[0-9a-f]{64}", got[1].pieces_sha256)
    assert {x.doc_id: list(x.piece_ids) for x in encode_texts(rows, ["doc_id"]).collect()} == {i: list(x.piece_ids) for i, x in got.items()}
    assert callable(decode_pieces)

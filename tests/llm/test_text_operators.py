"""Operators on documents against brute force, with the edge cases that their docstrings define."""

import hashlib
import random
import re
from collections import Counter

import pytest

from pairloom.llm.decontamination import contaminated, without_contaminated
from pairloom.llm.language_id import identify_held_out
from pairloom.llm.licenses import TEMPLATES, Scanner, find_licenses
from pairloom.llm.ngram_join import similar_groups
from pairloom.llm.pieces import MODEL, PieceModel, decode_pieces, encode_texts, read_model
from pairloom.llm.substring_dedup import remove_repeats
from pairloom.llm.toxicity import score_toxicity

SCHEMA = "doc_id long, text string, lang string, source string, did long, row_key string, key string, id long, n_words int"
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", text or "")


def frame(spark, texts, langs=None):
    """Documents with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, (langs or {}).get(i), "s", 7, "k", "k", 9, 1) for i, t in texts], SCHEMA).repartition(3)


def corpus(seed, n=60):
    """Texts with exact and near copies, shared passages, edges."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.randint(1, 4)))
    passage = [word() for _ in range(50)]
    out = []
    for _ in range(n):
        w = [word() for _ in range(r.choice([0, 1, 3, 5, 20, 34, 35, 36, 80, 300]))]
        if r.random() < 0.3:
            k = r.randint(0, len(w))
            w[k:k] = passage[: r.choice([30, 35, 40, 50])]
        if out and r.random() < 0.4:
            w = words(r.choice(out))
            for _ in range(r.choice([0, 0, 1, 3, 9])):
                if w:
                    w[r.randrange(len(w))] = word()
        out.append(r.choice([" ", "\n", "  "]).join(w))
    return [*enumerate(out), (900, None), (901, ""), (902, " \n "), (903, None), (0, out[0]), (None, out[1])]


def test_repeats_match_brute_force(spark):
    for seed in (1, 2):
        texts = corpus(seed)
        counts = Counter(tuple(w[i : i + 35]) for _, t in texts for w in [words(t)] for i in range(len(w) - 34))
        want = []
        for i, t in texts:
            w = words(t)
            gone = {k for s in range(len(w) - 34) if counts[tuple(w[s : s + 35])] > 1 for k in range(s, s + 35)}
            kept = " ".join(x for k, x in enumerate(w) if k not in gone)
            want.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
        got = [tuple(r)[:5] for r in remove_repeats(frame(spark, texts)).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_repeats_spans_and_parameters(spark):
    text = " ".join(f"w{i}" for i in range(20))
    got = {r.doc_id: r for r in remove_repeats(frame(spark, [(1, "x y " + text), (2, text + " z")]), length=10, gram=4).collect()}
    assert [(s.first, s.n_words) for s in got[1].spans] == [(2, 20)] and got[2].kept_text == "z"
    with pytest.raises(ValueError):
        remove_repeats(frame(spark, [(1, "a")]), length=5, gram=5)


def shingles(text):
    w = words((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_groups(texts):
    sets = [(i, shingles(t)) for i, t in texts]
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                up[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return sorted(((i, len(s), least.get(root(k)) if s else i) for k, (i, s) in enumerate(sets)), key=str)


def test_groups_match_brute_force(spark):
    texts = corpus(3)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in similar_groups(frame(spark, texts)).collect()]
    assert sorted(got, key=str) == brute_groups(texts)


def test_groups_of_chained_near_copies(spark):
    """Drifting copies: neighbours link, ends don't; similarities lie on both sides of the threshold."""
    r = random.Random(5)
    texts, at = [], 0
    for _ in range(6):
        w = [f"w{r.randrange(10**6)}" for _ in range(r.choice([12, 40, 120]))]
        for _ in range(25):
            w = list(w)
            for _ in range(max(1, len(w) // r.choice([20, 40, 60]))):
                w[r.randrange(len(w))] = f"w{r.randrange(10**6)}"
            texts.append((at, " ".join(w)))
            at += 1
    got = [(x.doc_id, x.n_shingles, x.component_id) for x in similar_groups(frame(spark, texts)).collect()]
    assert sorted(got, key=str) == brute_groups(texts)


def drifting(seed, n_groups, n, lengths=(12, 40, 120)):
    r = random.Random(seed)
    texts = []
    for _ in range(n_groups):
        w = [f"w{r.randrange(10**6)}" for _ in range(r.choice(lengths))]
        for _ in range(n):
            w = list(w)
            for _ in range(max(1, len(w) // r.choice([20, 40, 60]))):
                w[r.randrange(len(w))] = f"w{r.randrange(10**6)}"
            texts.append((len(texts), " ".join(w)))
    return texts


@pytest.mark.parametrize("shard", [512, 7])
def test_links_match_brute_force_at_any_shard_size(spark, monkeypatch, shard):
    """Numbers of links and pairs of classes, with exact copies and one hot group, however the blocks are cut."""
    from pairloom.llm import ngram_join

    monkeypatch.setattr(ngram_join, "SHARD", shard)
    monkeypatch.setattr(ngram_join, "ROUTED", shard)
    texts = drifting(9, 3, 12) + [(1000 + i, "a b c d e f g h " * 3) for i in range(40)]
    texts += [(2000 + i, " ".join(["hot"] + [f"h{k}" for k in range(100)] + [f"x{i}"])) for i in range(60)] + [(3000, ""), (3001, None), (3002, "one two")]
    sets = [(i, shingles(t)) for i, t in texts]
    alike = [(i, j) for a, (i, x) in enumerate(sets) for j, y in sets[:a] if x and y and 100 * len(x & y) >= 75 * len(x | y)]
    n_links = Counter(k for pair in alike for k in pair)
    got = similar_groups(frame(spark, texts)).collect()
    assert {r.doc_id: r.n_links for r in got} == {i: n_links[i] for i, _ in texts}
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_groups(texts)
    pairs, member = ngram_join.linked_classes(frame(spark, texts))
    class_of = {r.doc_id: r.class_id for r in member.collect()}
    pairs = [(r.class_a, r.class_b) for r in pairs.collect()]
    assert len(pairs) == len(set(pairs))
    assert {frozenset(p) for p in pairs} == {frozenset((class_of[i], class_of[j])) for i, j in alike if class_of[i] != class_of[j]}


def test_signature_tree_prunes_nothing_that_links():
    import numpy as np

    from pairloom.llm.ngram_join import SignatureTree, bitmaps, dual_traversal

    r = np.random.default_rng(1)
    sets = []
    for _ in range(200):
        base = sets[r.integers(len(sets))] if sets and r.random() < 0.6 else r.choice(10**6, r.integers(5, 90), replace=False)
        sets.append(np.unique(np.concatenate((base[r.random(len(base)) > 0.06], r.choice(10**6, 2)))))
    size = np.array([len(s) for s in sets])
    bits = bitmaps(np.repeat(np.arange(len(sets)), size), np.concatenate(sets) % 2048, len(sets), 2048)
    links = {(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))}
    tree = SignatureTree(bits, size, size)
    found = [(max(a, b), min(a, b)) for _, i, _, j in dual_traversal(tree, tree, False) for a, b in zip(i.tolist(), j.tolist())]
    assert links <= set(found) and len(found) == len(set(found)) < len(sets) * (len(sets) - 1) / 4
    p, q = SignatureTree(bits[:90], size[:90], size[:90]), SignatureTree(bits[90:], size[90:], size[90:])
    across = {(b + 90, a) for _, i, _, j in dual_traversal(p, q, False) for a, b in zip(i.tolist(), j.tolist())}
    assert {x for x in links if x[0] >= 90 > x[1]} <= across


@pytest.mark.parametrize("n_tokens", [60, 9000])
def test_tree_join_is_exact_for_narrow_and_folded_bitmaps(monkeypatch, n_tokens):
    import numpy as np

    from pairloom.llm import ngram_join

    r = np.random.default_rng(2)
    base = r.integers(0, 2**63, n_tokens, dtype=np.uint64)
    sets = [np.unique(np.concatenate((base[r.random(n_tokens) > r.choice([0.0, 0.05, 0.2])], r.integers(0, 2**63, 3, dtype=np.uint64)))) for _ in range(90)]
    want = {(i, j) for i in range(90) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))}
    for wide in (1 << 27, 1):
        monkeypatch.setattr(ngram_join, "_WIDE", wide)
        for shard in (np.zeros(90, int), np.arange(90) % 2):
            join = ngram_join.TreeJoin([s.tobytes() for s in sets], shard)
            got = [frozenset((int(join.order[x]), int(join.order[y]))) for ranges in join.links() for a, b, c, d in zip(*(v.tolist() for v in ranges)) for x in range(a, b) for y in range(c, d)]
            assert len(got) == len(set(got))
            assert set(got) == {frozenset(p) for p in want if not shard.any() or shard[p[0]] != shard[p[1]]}


def brute_leaks(texts, items):
    def grams(w):
        return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([("whole", *w)] if w else [])

    out = []
    for i, t in texts:
        w = words((t or "").translate(LOWER))
        for k, item in items:
            b = words((item or "").translate(LOWER))
            best = None
            for s in range(max(1, len(w) - len(b) + 1)):
                x, y = grams(w[s : s + len(b)] if len(w) > 4 or len(w) == len(b) else w), grams(b)
                if len(b) < 5 and len(w) != len(b):
                    continue
                if (total := sum((x | y).values())) and (sim := sum((x & y).values()) / total) >= 0.75 and (best is None or sim > best[0]):
                    best = (sim, s)
            if best and b:
                out.append((i, k, best[1], round(best[0], 9)))
    return sorted(out, key=str)


def test_leaks_match_brute_force(spark):
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 5)))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate((3, 14, 20, 37, 59))] + [(90, None), (91, ""), (92, "one two three one two three one two three one two three")]
    texts = []
    for i in range(60):
        w = [word() for _ in range(r.choice([0, 2, 10, 60, 200]))]
        if r.random() < 0.6:
            p = words(r.choice(items[:5])[1])
            for _ in range(r.choice([0, 0, 1, 2])):
                p[r.randrange(len(p))] = word().upper()
            k = r.randint(0, len(w))
            w[k:k] = p
        texts.append((i, " ".join(w)))
    texts += [(70, None), (71, ""), (72, items[0][1].upper()), (73, items[6 + 1][1] + " three"), (None, items[3][1]), (3, texts[3][1])]
    bench = spark.createDataFrame(items, "item_id int, text string")
    got = [(x.doc_id, x.item_id, x.first_word, round(x.similarity, 9)) for x in contaminated(frame(spark, texts), bench).collect()]
    assert sorted(got, key=str) == brute_leaks(texts, items)
    dropped = {(i, t) for i, t in texts} - {(x.doc_id, x.text) for x in without_contaminated(frame(spark, texts), bench).collect()}
    assert {i for i, _ in dropped} == {i for i, *_ in brute_leaks(texts, items)}
    assert without_contaminated(frame(spark, texts), bench).columns == frame(spark, texts).columns


def test_languages(spark):
    r = random.Random(2)
    make = lambda letters: " ".join("".join(r.choice(letters) for _ in range(5)) for _ in range(30))
    texts = [(i, make("aeioust" if i % 2 else "zyxwvkq")) for i in range(80)] + [(200, None), (201, ""), (202, "123 !?"), (None, make("aeioust")), (1, make("aeioust"))]
    langs = {i: ("aa" if i % 2 else "zz") for i in range(60)}
    got = identify_held_out(frame(spark, texts, langs)).collect()
    assert len(got) == len(texts) and all(x.lang_pred == ("aa" if x.doc_id % 2 else "zz") and 0 < x.score <= 1 for x in got if x.doc_id is not None and x.doc_id < 200)
    assert all((x.lang_pred, x.score) == ("und", 0) for x in got if x.doc_id is not None and x.doc_id >= 200)
    none = identify_held_out(frame(spark, texts)).collect()
    assert {(x.lang_pred, x.score) for x in none} == {("und", 0.0)}


def test_toxicity(spark):
    r = random.Random(4)
    make = lambda bad: " ".join(["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(40)] + (["zorkish"] if bad else []))
    texts = [(i, make(i % 4 == 0)) for i in range(400)] + [(900, None), (901, ""), (None, make(True)), (8, make(True))]
    labels = spark.createDataFrame([(i, int(i % 4 == 0), 1) for i in range(300)] + [(301, None, None), (None, 1, 0)], "doc_id long, toxic int, quality int")
    got = score_toxicity(frame(spark, texts), labels).collect()
    assert len(got) == len(texts) and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.7) for x in got)
    assert all(x.predicted == int(x.doc_id % 4 == 0) for x in got if x.doc_id is not None and x.doc_id < 400)
    clean = labels.where("toxic = 0")
    assert {round(x.score, 6) for x in score_toxicity(frame(spark, texts), clean).collect()} == {0.0}


def test_pieces_equal_the_library(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = [t or "" for _, t in corpus(9)] + ["Hello  world\n\tcafé 𝒳𝒴 мир", " ", "    ", "a" * 700 + " " * 60 + "b", "x ▁y", "über-straße, l'été; ¿qué? 12345\r\n"]
    rows = spark.createDataFrame([*enumerate(texts), (500, None), (None, "id")], "doc_id long, text string").repartition(3)
    got = encode_texts(rows, ["doc_id"]).collect()
    by = {x.doc_id: x.piece_ids for x in got}
    assert all(by[i] == library.encode(t) for i, t in enumerate(texts)) and by[500] == [] and len(got) == len(texts) + 2 and all(x.round_trip for x in got)
    back = {x.doc_id: x.text for x in decode_pieces(encode_texts(rows, ["doc_id"]), ["doc_id"]).collect()}
    assert all(back[i] == library.decode(library.encode(t)) for i, t in enumerate(texts)) and back[500] == ""


def test_unigram_model_takes_the_best_path():
    def field(n, kind, value):
        return bytes([n << 3 | kind]) + (bytes([len(value)]) + value if kind == 2 else value)

    import struct

    def piece(text, score, kind=1):
        return field(1, 2, field(1, 2, text.encode()) + field(2, 5, struct.pack("<f", score)) + field(3, 0, bytes([kind])))

    raw = piece("<unk>", 0, 2) + b"".join(piece(t, s) for t, s in (("▁", -2), ("a", -3), ("b", -3), ("ab", -4), ("▁a", -3.5), ("▁ab", -9), ("bb", -4.5))) + field(2, 2, field(3, 0, b"\x01"))
    raw += field(3, 2, field(3, 0, b"\x01") + field(4, 0, b"\x00"))
    model = PieceModel(raw)
    assert [model.pieces[i] for i in model.encode_words(["▁ab", "▁abb", "▁aab"])["▁abb"]] == ["▁a", "bb"]
    assert [model.pieces[i] for i in model.encode_words(["▁ab"])["▁ab"]] == ["▁", "ab"] and model.encode_words(["?"])["?"] == [0]


def test_default_model_is_read_whole():
    assert len(PieceModel(read_model()).pieces) == 32000


def test_licenses(spark):
    mit, gpl = TEMPLATES["MIT"], TEMPLATES["GPL-3.0-notice"]
    texts = [
        (1, "Some words here.\nReleased under the MIT License."), (2, f"intro\n{mit}\nmore"), (3, mit.replace("Permission is hereby granted", "Permission is herewith granted")), (4, f"x y. {gpl} And on."), (5, "no notice at all"),
        (6, "My driving license was taken. Copyright law is dull."), (7, None), (8, ""), (None, "Licensed under CC BY-NC 4.0."), (10, "word " * 20000 + "\nLicensed under the Apache License, Version 2.0."), (1, "Some words here.\nReleased under the MIT License."),
    ]
    got = sorted(((x.doc_id, x.license) for x in find_licenses(frame(spark, texts)).collect()), key=str)
    assert got == sorted([(1, "MIT-notice"), (1, "MIT-notice"), (2, "MIT"), (3, "MIT"), (4, "GPL-3.0-notice"), (None, "CC-BY-NC-4.0"), (10, "Apache-2.0-notice")], key=str)
    scanner = Scanner()
    assert all(scanner.scan(t)[0]["license"] == k and scanner.scan(t)[0]["changed"] == 0 for k, t in TEMPLATES.items())


def test_round_trip_is_by_decoding(spark, tmp_path):
    from pairloom.llm.queries import QUERIES

    texts = ["a  b", "x ▁y", " lead", None, "", "é 𝒳\n"]
    spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {x.doc_id: x.round_trip for x in QUERIES["op8_sentencepiece"](spark, str(tmp_path)).collect()}
    assert got == {0: True, 1: False, 2: True, 3: True, 4: True, 5: True}


def test_licenses_inside_sentences():
    scanner, mit = Scanner(), TEMPLATES["MIT"].split(" ")
    texts = {
        "This project is released under the MIT License.": "MIT-notice", "Enjoy! Licensed under CC BY 4.0.": "CC-BY-4.0", "The text, licensed under the Apache License, Version 2.0, is ours.": "Apache-2.0-notice",
        "Note " + " ".join(mit[:-4]): "MIT", "so " + " ".join([*mit[:20], "truly", *mit[20:]]) + " and on": "MIT",
        "".join(f"// {line}\n" for line in TEMPLATES["MIT"].replace("\n\n", " ").split(", ")): "MIT", " * " + TEMPLATES["BSD-3-Clause"].replace("\n\n", "\n *\n * "): "BSD-3-Clause",
        TEMPLATES["ISC"].split("\n\n")[0]: "ISC-part1",
    }
    assert [[f["license"] for f in scanner.scan(t)] for t in texts] == [[k] for k in texts.values()]
    assert [f["first_char"] for f in scanner.scan("Licensed under CC BY 4.0. " * 3)] == [0, 26, 52]
    own = Scanner({"own": "all your base are belong to us and so are the cats in the hall"})
    assert [f["license"] for f in own.scan("see: All your base are belong to them and so are the cats in the hall!")] == ["own"]


def test_altered_licenses_match_brute_force():
    """Copies altered within the permitted change are all found, and others not: every run of words against every template."""
    from pairloom.llm.licenses import differences, plain_words

    r = random.Random(3)
    templates = {"a": " ".join(f"a{i % 17}" for i in range(30)), "b": " ".join(f"b{r.randrange(12)}" for _ in range(21)), "c": "one two three four five"}
    scanner = Scanner(templates)
    for _ in range(120):
        name = r.choice(list(templates))
        w = templates[name].split(" ")
        for _ in range(r.randint(0, 6)):
            k, what = r.randrange(len(w)), r.randrange(3)
            w[k : k + 1] = [[], ["zz"], [w[k], "yy"]][what]
        text = " ".join(["x", *[r.choice(["q", "a1", "b2", "one"]) for _ in range(r.randrange(4))], *w, "y", "Y"])
        plain = [x for x, _, _ in plain_words(text)]
        near = {k for k, t in scanner.words.items() for i in range(len(plain)) for j in range(i + 1, len(plain) + 1) if differences(plain[i:j], t, scanner.most(k)) <= scanner.most(k)}
        assert {f["license"] for f in scanner.scan(text)} == near


def test_empty_tables(spark):
    none = frame(spark, [])
    bench, labels = spark.createDataFrame([], "item_id int, text string"), spark.createDataFrame([], "doc_id long, toxic int")
    for out in (remove_repeats(none), similar_groups(none), contaminated(none, bench), identify_held_out(none), score_toxicity(none, labels), find_licenses(none), encode_texts(none, ["doc_id"])):
        assert out.count() == 0
    assert contaminated(frame(spark, [(1, "a b c d e f g")]), bench).count() == 0

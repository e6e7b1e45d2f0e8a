"""SimHash groups, vector codes and filter audits against brute force, with the edge cases that their docstrings define."""

import hashlib
import math
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
import xxhash

import pairloom.llm.simhash_groups as simhash_groups_module
from pairloom.llm.filter_audit import audit_filters, bitmap_index, judged, labelled
from pairloom.llm.simhash_groups import RADIUS, WIDTHS, bucket_links, chain_masks, fingerprint_links, simhash_groups, turned, xxh64
from pairloom.llm.vector_codes import _pack, _unpack, code_report, compress_vectors, nearest

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", text or "")


def fingerprint(text):
    w = words((text or "").translate(LOWER))
    grams = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def smallest_reached(fps):
    """For each distinct fingerprint the set of those that links reach."""
    known, group = sorted(set(fps)), {}
    for f in known:
        if f in group:
            continue
        group[f], todo = f, [f]
        while todo:
            x = todo.pop()
            for y in known:
                if y not in group and (x ^ y).bit_count() <= RADIUS:
                    group[y] = f
                    todo.append(y)
    return group


def grouped(rows):
    group = smallest_reached([fingerprint(t) for _, t in rows])
    least = {}
    for i, t in rows:
        g = group[fingerprint(t)]
        least[g] = min(x for x in (least.get(g), i) if x is not None) if i is not None or least.get(g) is not None else None
    return sorted(((i, f"{fingerprint(t):016x}", least[group[fingerprint(t)]]) for i, t in rows), key=repr)


def corpus(seed, n=70):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeFÄé") for _ in range(r.randint(1, 9)))
    out = []
    for _ in range(n):
        w = [word() for _ in range(r.choice([0, 1, 3, 4, 5, 20, 120, 300]))]
        if out and r.random() < 0.6:
            w = words(r.choice(out))
            for _ in range(r.choice([0, 0, 1, 1, 2, 5])):
                if w:
                    w[r.randrange(len(w))] = word()
        out.append(r.choice([" ", "\n", " \t "]).join(w))
    out += [" ".join("x" * 400 + str(k) for k in range(9)), "y" * 5000, "  a b"]
    return [*enumerate(out), (900, None), (901, ""), (902, " \n "), (0, out[0]), (None, out[1]), (None, "quite alone here it is"), (700, "z " * 40_000)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 7, "k", 9) for i, t in rows], "doc_id long, text string, fp int, segment string, component int").repartition(3)


def test_hash_is_xxh64():
    r = random.Random(5)
    parts = [r.randbytes(n) for n in [*range(0, 140), 255, 256, 257, 1000]]
    data, ends = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts])
    got = xxh64(data, ends - np.array([len(p) for p in parts]), ends)
    assert got.tolist() == [xxhash.xxh64_intdigest(p, 42) for p in parts]


def test_groups_match_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        assert sorted(map(tuple, simhash_groups(frame(spark, rows)).collect()), key=repr) == grouped(rows)
    assert simhash_groups(frame(spark, rows).where("false")).collect() == []


def heap(seed, n, spread):
    """Fingerprints around a few centres, at most ``spread`` bits away."""
    r = random.Random(seed)
    centres = [r.getrandbits(64) for _ in range(3)]
    centres.append(centres[0] ^ 0b11111 << 20)
    out = {0, (1 << 64) - 1}
    while len(out) < n:
        x = r.choice(centres) if r.random() < 0.9 else r.getrandbits(64)
        for k in r.sample(range(64), r.randint(0, spread)):
            x ^= 1 << k
        out.add(x)
    return sorted(out)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("limit", [1 << 17, 30, 4])
def test_links_of_heaps_at_every_level(spark, limit):
    """Whole buckets, buckets dealt anew by chains of two, and heaps in shards all give the same components."""
    for spread in (2, 5):
        fps = heap(limit + spread, 220, spread)
        links = fingerprint_links(spark.createDataFrame([(signed(x),) for x in fps], "fp long"), limit).collect()
        up = {signed(x): signed(x) for x in fps}
        root = lambda x: x if up[x] == x else root(up[x])
        for a, b in links:
            up[root(a)] = root(b)
        got = {frozenset(y for y in up if root(y) == root(x)) for x in up}
        want = smallest_reached(fps)
        assert got == {frozenset(signed(y) for y in fps if want[y] == want[x]) for x in fps}


@pytest.mark.parametrize("few", [0, 96])
def test_chains_lose_no_pair(monkeypatch, few):
    """Pairs of each distance up to the radius are found from some segment, whether all pairs of a small bucket are counted or not; a bucket's links are few and true."""
    monkeypatch.setattr(simhash_groups_module, "_FEW", few)
    r = random.Random(9)
    for _ in range(300):
        x = r.getrandbits(64)
        y = x
        for k in r.sample(range(64), r.randint(1, RADIUS)):
            y ^= 1 << k
        both = np.array([x, y], np.uint64)
        found = False
        for start in range(len(WIDTHS)):
            ring = turned(both, sum(WIDTHS[:start]))
            shares = all(int(np.bitwise_count((ring[0] ^ ring[1]) & m)) <= most for m, most in chain_masks(start))
            links = bucket_links(both, start, np.array([0, 1]))
            assert len(links[0]) == shares or not int(np.bitwise_count((ring[0] ^ ring[1]) & chain_masks(start)[0][0])) == 0
            found |= shares
        assert found
    fps = np.array(heap(3, 400, 3), np.uint64)
    a, b = bucket_links(fps, 0, np.arange(len(fps)))
    assert len(a) < len(fps) and (np.bitwise_count(fps[a] ^ fps[b]) <= RADIUS).all()


# ---- codes


def coded(rows):
    """The contract in plain loops over all vectors."""
    kept = sorted(((i, label, v) for i, label, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)), key=lambda r: (r[0] is None, r[0] or 0))
    width = -(-max((len(v) for _, _, v in kept), default=0) // 4)
    whole = [[math.floor(1024 * x) for x in v] + [0] * (4 * width - len(v)) for _, _, v in kept]
    parts = [[tuple(v[k * width : (k + 1) * width]) for v in whole] for k in range(4)]
    codes, books, errors = [], [], [0] * len(kept)
    for p in parts:
        book = [list(x) for x in p[:256]]
        near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))  # noqa: E731, B023
        for _ in range(4):
            at = [near(x)[1] for x in p]
            for k in set(at):
                own = [x for x, c in zip(p, at) if c == k]
                book[k] = [sum(x[j] for x in own) // len(own) for j in range(width)]
        found = [near(x) for x in p]
        codes.append([c for _, c in found])
        errors = [e + d for e, (d, _) in zip(errors, found)]
        books.append(book)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    by_label = Counter()
    for (_, label, _), e in zip(kept, errors):
        by_label[label] += e
    return sorted([(i, "".join(f"{c[n]:02x}" for c in codes), errors[n], by_label[label], digest) for n, (i, label, _) in enumerate(kept)], key=repr)


def vectors(spark, rows):
    return spark.createDataFrame([(i, label, v, 1, "p") for i, label, v in rows], "vec_id long, label int, embedding array<float>, row int, part string").repartition(3)


def test_codes_match_brute_force(spark):
    r = random.Random(4)
    f = lambda x: float(np.float32(x))
    some = [[f(r.gauss(0, 0.02)) for _ in range(8)] for _ in range(330)]
    rows = [(i, r.choice([0, 1, None]), r.choice(some[:60]) if i % 3 == 0 else v) for i, v in enumerate(some)]
    rows += [(1000, 1, None), (1001, 1, [None] + [0.0] * 7), (1002, 1, [float("nan")] * 8), (1003, 1, [float("inf")] * 8), (None, 2, some[5]), (1004, None, [f(40.0)] + [0.0] * 6 + [f(-40.0)])]
    assert sorted(map(tuple, code_report(vectors(spark, rows)).collect()), key=repr) == coded(rows)


def test_codes_of_few_odd_or_no_vectors(spark):
    for rows in ([(3, 0, [0.5, -0.5, 0.25, 1.0, 2.0]), (1, None, [0.1]), (2, None, [])], [(1, 0, []), (2, 1, [])], [(1, 0, None)]):
        assert sorted(map(tuple, code_report(vectors(spark, rows)).collect()), key=repr) == coded([(i, label, v and [float(np.float32(x)) for x in v]) for i, label, v in rows])
    huge = compress_vectors(vectors(spark, [(1, 0, [3e38, 0.0, 0.0, 0.0]), (2, 0, [-3e38, 0.0, 0.0, 0.0]), (3, 0, [0.0, 0.0, 0.0, 0.0])]))[0]
    assert sorted((r.vec_id, r.code, r.error) for r in huge.collect()) == [(1, "00000000", 0), (2, "01000000", 0), (3, "02000000", 0)]


def test_parts_keep_their_values_and_distances_are_exact():
    r = np.random.default_rng(3)
    values = np.concatenate([r.integers(-(1 << b), 1 << b, (20, 5)) for b in (3, 14, 17, 40, 62)])
    assert (_unpack(_pack(values), 5) == values).all() and len({len(p) for p in _pack(values)}) == 3
    for most in (900, 1 << 27):
        x, c = r.integers(-most, most, (300, 16)), r.integers(-most, most, (40, 16))
        c[7] = c[3]
        code, error = nearest(x, c)
        full = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        assert (code == full.argmin(axis=1)).all() and (error == full.min(axis=1)).all() and not (code == 7).any()


# ---- audit


def audited(docs, labels):
    first, fails = {}, []
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    for i, t, _ in docs:
        t = t or ""
        w = words(t)
        fails.append({f for f, x in zip("ABCDE", (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and i > first[t])) if x})
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    out = []
    for part in {s or "" for _, _, s in docs}:
        own = [(i, f) for (i, _, s), f in zip(docs, fails) if (s or "") == part]
        gone = {}
        for order in permutations("ABCDE"):
            for k, x in enumerate(order):
                before = set(order[:k])
                removed = [(i, f) for i, f in own if x in f and not f & before]
                gone[order, x] = len(removed)
                out.append([part, "".join(order), k + 1, sum(not f & set(order[: k + 1]) for _, f in own), len(removed), sum(x in f and bool(f & before) for _, f in own), sum(f == {x} for _, f in own), sum(i in good for i, _ in removed), sum(i in toxic for i, _ in removed), x])
        for row in out:
            if row[0] == part:
                row[-1] = sum(n for (_, x), n in gone.items() if x == row[-1])
    return sorted(map(tuple, out))


def test_audit_matches_brute_force(spark):
    r = random.Random(6)
    texts = [None, "", " \n\t"]
    for _ in range(60):
        pool = [r.choice(["Aa", "b#", "é", "ZZZ", "x|y", "word", "ÄÖ"]) + str(k) for k in range(r.choice([3, 30, 90]))]
        texts.append(r.choice([" ", "\n"]).join(r.choice(pool) for _ in range(r.choice([1, 49, 50, 51, 200]))))
    texts += ["u " * 30_000, "Aé" * 20 + " ", "a" * 19 + "B", "a" * 18 + "BB"]
    docs = [(i, r.choice(texts), r.choice(["s0"] * 6 + ["s1", "", None, "no #1"])) for i in range(300)] + [(None, texts[4], "s0"), (None, texts[4], "s0"), (7, texts[9], "s1"), (7, texts[9], "s1")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, 310, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    d = spark.createDataFrame([(*x, 1, "p") for x in docs], "doc_id long, text string, source string, fails int, part string").repartition(3)
    lab = spark.createDataFrame([(*x, True) for x in labels], "doc_id long, quality int, toxic int, good boolean")
    assert sorted(map(tuple, audit_filters(d, lab).collect())) == audited(docs, labels)
    assert audit_filters(d.where("false"), lab).collect() == [] and audit_filters(d, lab.where("false")).count() == audit_filters(d, lab).count()


def test_index_holds_every_row_once(spark):
    docs = spark.createDataFrame([(i, "word " * (i % 90), f"s{i % 130}") for i in range(1000)], "doc_id long, text string, source string")
    index = bitmap_index(labelled(judged(docs), spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int"))).collect()
    assert sum(sum(x.bit_count() for x in r.present) for r in index) == 1000 and all(len(r[k]) % 8 == 0 and len(r[k]) == len(r.present) for r in index for k in range(1, len(r)))

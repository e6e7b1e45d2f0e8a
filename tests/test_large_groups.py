"""What no longer needs one task for one group, archive or stream: running totals, the exact bootstrap, matching blocks, archives by member, bounded streams."""

import difflib
import io
import random
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_summaries import docx, png

from pairloom.functions import blocks
from pairloom.operators import outcomes, prefix_sums, stats
from pairloom.sources import archives
from pairloom.streaming.resume import arriving, correct_stream


def test_running_totals_equal_plain_sums(spark):
    r = random.Random(1)
    rows = [(r.choice(["a", "a", "a", "b", None]), i, r.choice([1, 2, 5, None])) for i in range(500)]
    r.shuffle(rows)
    frame = spark.createDataFrame(rows, "g string, ord long, n long")
    want, so_far = {}, {}
    for g, i, n in sorted(rows, key=lambda x: x[1]):
        so_far[g] = (so_far.get(g, (0, 0))[0] + (n or 0), so_far.get(g, (0, 0))[1] + 1)
        want[g, i] = so_far[g]
    for ranges in (1, 7):
        got = prefix_sums.positions(prefix_sums.running_totals(frame, ["g"], ["ord"], {"upto": "n"}, ranges), ["g"], ["ord"], ranges=ranges)
        assert got.columns == ["g", "ord", "n", "upto", "position"]
        assert {(x.g, x.ord): (x.upto, x.position + 1) for x in got.collect()} == want
    assert prefix_sums.running_totals(frame.where("false"), ["g"], ["ord"], {"upto": "n"}).count() == 0
    spread = prefix_sums.positions(frame.where("g = 'a'"), ["g"], ["ord"], ranges=6)
    assert sorted(x.position for x in spread.collect()) == list(range(spread.count()))


def test_cumulative_changes(spark):
    rows = spark.createDataFrame([("d", i, "abcd", *x) for i, x in enumerate([("abxd", "abcd"), ("abcd", "axcd"), ("xxcd", "abcd")])], "dataset string, ord long, gt_text string, ocr_text string, corrected_text string")
    got = {r.error_type: r for r in outcomes.error_changes(rows, ["dataset"], cumulative=True).collect()}["other_substitution"]
    # running totals before 1, 1, 3 and after 0, 1, 1
    assert (got.baseline, got.residual, got.fixed, got.introduced) == (3, 1, 1 + 0 + 2, 0)


def seeded(d, repeats, alpha, seed):
    rng, n = random.Random(seed), len(d)
    means = sorted(sum(rng.choices(d, k=n)) / n for _ in range(repeats)) if n > 1 else [0.0] * repeats
    at = lambda q: means[max(0, min(int(q * repeats), repeats - 1))]
    return at(alpha / 2), at(1 - alpha / 2)


def test_exact_bootstrap_is_pythons(spark, monkeypatch):
    monkeypatch.setattr(stats, "_BLOCK", 16)
    r = random.Random(4)
    scores = {"base": [r.random() for _ in range(70)], "x": [r.random() for _ in range(70)], "y": [r.random() for _ in range(33)], "one": [0.5]}
    rows = [(run, f"s{i:03}", i, v) for run, vs in scores.items() for i, v in enumerate(vs)]
    r.shuffle(rows)
    runs = spark.createDataFrame(rows, "run string, sample_id string, ord long, cer double")
    for tasks, seed in ((32, 42), (3, 7)):
        got = {x.run: (x.low, x.high) for x in stats.exact_bootstrap(runs, "base", repeats=100, seed=seed, tasks=tasks).collect()}
        assert got == {run: seeded([a - b for a, b in zip(scores["base"], vs)], 100, 0.05, seed) for run, vs in scores.items() if run != "base"}
    states = stats.repeat_states(10, 10, 4, 42)
    assert [(first, times) for first, times, *_ in states] == [(0, 3), (3, 3), (6, 3), (9, 1)]


def test_sums_of_arrays_are_pythons(spark):
    """The exact bootstrap adds up arrays instead of lists of Python floats (F25)."""
    r = np.random.RandomState(2)
    for x in (r.random_sample(5000) - 0.5, r.standard_normal(3000) * 10.0 ** r.randint(-20, 20, 3000), np.zeros(9), np.array([1.0, 1e100, 1.0, -1e100]), np.array([])):
        total = stats.ExactSum()
        for k in range(0, len(x), 777):
            total.add(x[k : k + 777])
        assert total.value == sum(x.tolist())


def test_blocks_are_the_standard_librarys(spark):
    r = random.Random(5)
    for _ in range(400):
        letters = "abcdefgh"[: r.randint(1, 8)]
        a, b = ([r.choice(letters) for _ in range(r.randint(0, 40))] for _ in range(2))
        want = [tuple(x) for x in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()][:-1]
        assert blocks.matching_blocks(a, b) == want
        assert blocks.changes(a, b) == [x for x in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if x[0] != "equal"]
    long = [r.choice("xy") for _ in range(3000)]
    assert blocks.matching_blocks(long, long[:1500] + ["z"] + long[1500:]) == [(0, 0, 1500), (1500, 1501, 1500)]
    rows = spark.createDataFrame([("the cat sat", "the bat sat down"), ("a", None), ("", "")], "a string, b string")
    words = lambda c: F.filter(F.split(c, " "), lambda x: x != "")
    got = rows.select(blocks.word_blocks(words("a"), words("b")).alias("m"), blocks.word_changes(words("a"), words("b")).alias("c")).collect()
    assert [tuple(x) for x in got[0].m] == [(0, 0, 1), (2, 2, 1)] and [tuple(x) for x in got[0].c] == [("replace", "cat", "bat"), ("insert", "", "down")]
    assert got[1].m is None and got[1].c is None and got[2].m == [] and got[2].c == []


def test_archives_by_member(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("r/B/one.docx", docx("first", "second  line"), zipfile.ZIP_DEFLATED)
        z.writestr("r/B/one.png", png(2, 2), zipfile.ZIP_STORED)
        z.writestr("r/B/two.docx", docx("two"), zipfile.ZIP_DEFLATED)
        z.writestr("r/B/odd.png", b"x" * 100, zipfile.ZIP_BZIP2)
        z.mkdir("r/C")
    raw = bytearray((tmp_path / "a.zip").read_bytes())
    at = zipfile.ZipFile(io.BytesIO(bytes(raw))).getinfo("r/B/two.docx").header_offset + 60
    raw[at] ^= 0xFF
    (tmp_path / "a.zip").write_bytes(bytes(raw))
    (tmp_path / "bad.zip").write_bytes(b"no archive at all")
    whole = archives.archive_entries(spark, str(tmp_path / "*.zip"))
    assert {r.name: len(r.content) for r in whole.collect()} == {"r/B/one.docx": len(docx("first", "second  line")), "r/B/one.png": len(png(2, 2))}
    errors = {(r.name or r.archive.rsplit("/", 1)[-1]): r.error for r in archives.archive_entries(spark, str(tmp_path / "*.zip"), broken=True).where("error IS NOT NULL").collect()}
    assert set(errors) == {"r/B/two.docx", "r/B/odd.png", "bad.zip"} and all(errors.values())
    assert archives.archive_members(spark, str(tmp_path / "*.zip")).where("name IS NOT NULL").count() == 4
    assert [r.gt_text for r in archives.archive_pages(whole).collect()] == ["first second line"]
    from pairloom.sources.readers import docx_text

    rows = spark.createDataFrame([(docx("a &amp; b", "c"),), (b"broken",), (None,)], "content binary").select(docx_text(F.col("content")).alias("t"))
    assert [r.t for r in rows.collect()] == ["a & b c", None, None]


def test_sizes_of_all_kinds_of_images(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png(9, 9))
    (tmp_path / "b.gif").write_bytes(b"GIF89a" + struct.pack("<HH", 300, 2) + b"\0" * 9)
    (tmp_path / "c.bmp").write_bytes(b"BM" + b"\0" * 16 + struct.pack("<ii", 5, -7) + b"\0" * 8)
    (tmp_path / "d.JPG").write_bytes(b"\xff\xd8\xff\xe0\0\x04ab\xff\xff\xc4\0\x03a\xff\xc2\0\x11\x08" + struct.pack(">HH", 11, 4) + b"\0" * 9)
    (tmp_path / "e.jpeg").write_bytes(b"\xff\xd8\xff\xe0\0\x04ab")
    (tmp_path / "f.txt").write_bytes(b"GIF89a" + b"\1" * 20)
    assert [(r.path.rsplit("/", 1)[-1], r.width, r.height) for r in archives.images_by_area(spark, str(tmp_path)).collect()] == [("c.bmp", 5, 7), ("d.JPG", 4, 11), ("a.png", 9, 9), ("b.gif", 300, 2)]


def test_stream_remembers_by_what_is_written(spark, tmp_path):
    inbox, out, check = (tmp_path / n for n in ("in", "out", "check"))
    inbox.mkdir()
    put = lambda name, *ids: (inbox / name).write_text("".join(f'{{"sample_id": "{i}", "dataset": "d", "ocr_text": "كتاب {i}", "gt_text": "g"}}\n' for i in ids))
    run = lambda checkpoint: correct_stream(arriving(spark, str(inbox), within="1 hour"), str(out), str(checkpoint)).awaitTermination()
    keys = lambda: sorted(r.sample_id for r in spark.read.parquet(str(out)).collect())
    put("1.json", "a", "b", "a")
    run(check)
    assert keys() == ["a", "b"]
    put("2.json", "b", "c")
    run(check)
    assert keys() == ["a", "b", "c"]
    # a new checkpoint has no state: everything arrives once more, and nothing that is there is written again
    put("3.json", "c", "e")
    run(tmp_path / "check2")
    assert keys() == ["a", "b", "c", "e"]
    put("4.json", "e", "f")
    run(tmp_path / "check2")
    assert keys() == ["a", "b", "c", "e", "f"]


def test_replayed_batch_replaces_itself(spark, tmp_path):
    from pairloom.streaming import resume

    out = str(tmp_path / "out")
    spark.createDataFrame([("a", "d")], resume.KEYS).write.parquet(f"{out}/batch=0")
    spark.createDataFrame([("b", "d")], resume.KEYS).write.parquet(f"{out}/batch=1")
    assert [r.sample_id for r in resume.written_before(spark, out, 1).collect()] == ["a"] and resume.written_before(spark, out, 0).count() == 0
    assert resume.written_before(spark, str(tmp_path / "none"), 0) is None
    with pytest.raises(zipfile.BadZipFile):
        archives.member_bytes(io.BytesIO(b"PK\x03\x04"), 0, 1, 0, 0)

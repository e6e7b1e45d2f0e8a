"""Chat, neighbours, archives, the pipeline, and the registered queries."""

import base64
import hashlib
import io
import json
import math
import random

import numpy as np
import pytest

import corpus_pipeline
from pairloom.llm import warc
from pairloom.llm.chat import CHAT_SCHEMAS, conversation_calls, link_tool_calls
from pairloom.llm.neighbours import nearest_of_queries
from pairloom.llm.store import new_path

CALLS = "conv_id long, call_id string, turn long, name string, arguments string, depends_on array<string>, status string, k int"
RESULTS = "conv_id long, call_id string, turn long, content string, kind string"
SCHEMAS = {"add": {"properties": {"a": "integer", "b": "number", "note": "string", "list": "array"}, "required": ["a", "b"]}, "noop": {}}


def test_tool_calls_are_linked_ordered_and_validated(spark):
    calls = [
        (1, "c1", 0, "add", '{"b": 2.5, "a": 1}', [], "x", 1), (1, "c2", 2, "add", '{"a": 1.5, "b": "x", "zz": 1}', ["c1"], "x", 1), (1, "c3", 4, "noop", "{}", ["c1", "c2", "c2", "nowhere", None], "x", 1),
        (1, "c1", 9, "noop", "{}", [], "x", 1), (2, "x", 0, "noop", "{}", ["y"], "x", 1), (2, "y", 1, "noop", "{}", ["x"], "x", 1), (2, "z", 2, "noop", "{}", ["y"], "x", 1), (2, "w", 3, "gone", "{}", None, "x", 1),
        (3, None, 0, "noop", None, [], "x", 1), (None, "c1", 0, "noop", "[1]", [], "x", 1), (4, "q", 0, None, "not json", [], "x", 1),
    ]
    results = [(1, "c1", 1, "three", "k"), (1, "c1", 7, "again", "k"), (1, "lost", 3, "?", "k"), (3, None, 1, "who", "k"), (2, "x", 4, None, "k")]
    rows = link_tool_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), SCHEMAS).collect()
    by = {(r.conv_id, r.call_id, r.turn, r.kind): r for r in rows}
    assert len(by) == len(rows)
    one = by[1, "c1", 0, "call"]
    assert (one.status, one.depth, one.valid) == ("linked", 0, True)
    assert one.json == '{"arguments":{"a":1,"b":2.5},"call_id":"c1","content":"three","conv_id":1,"depth":0,"kind":"call","name":"add","status":"linked","turn":0}'
    two = by[1, "c2", 2, "call"]
    assert (two.status, two.depth, two.valid, two.faults) == ("open", 1, False, "a: not integer; b: not number; zz: unknown")
    assert (by[1, "c3", 4, "call"].depth, by[1, "c3", 4, "call"].valid) == (2, True)
    assert by[1, "c1", 9, "call"].status == by[1, "c1", 7, "result"].status == "repeated" and by[1, "lost", 3, "result"].status == "orphan"
    assert [by[2, k, t, "call"].depth for k, t in (("x", 0), ("y", 1), ("z", 2), ("w", 3))] == [None, None, None, 0]
    assert by[2, "x", 0, "call"].status == "linked" and by[2, "w", 3, "call"].faults == "name: no such tool"
    assert by[3, None, 0, "call"].status == "open" and by[3, None, 0, "call"].valid is False and by[3, None, 1, "result"].status == "orphan"
    assert by[None, "c1", 0, "call"].faults == "arguments: not an object" and by[4, "q", 0, "call"].valid is False
    assert all(json.loads(r.json) == json.loads(json.dumps(json.loads(r.json), sort_keys=True)) for r in rows)


def test_nested_schemas_odd_field_names_and_one_form_of_numbers(spark):
    place = {"type": "object", "properties": {"lat": "number", "tags": {"type": "array", "items": {"type": "string"}}}, "required": ["lat"]}
    schemas = {
        "go": {"properties": {"user.name": "string", "it's": "integer", "to": place, "mode": {"enum": ["foot", 1.5, None]}, "stops": {"type": "array", "items": place}}, "required": ["user.name"]},
        "free": {"additionalProperties": True},
    }
    cases = [
        ('{"user.name": "x", "it\'s": 2.0}', "", '{"it\'s":2,"user.name":"x"}'), ('{"user": {"name": 1}}', "user.name: missing; user: unknown", '{"user":{"name":1}}'),
        ('{"user.name": "x", "to": {"lat": "n", "tags": ["a", 3]}}', "to.lat: not number; to.tags[1]: not string", None), ('{"user.name": "x", "mode": "car"}', "mode: not one of the values", None),
        ('{"user.name": "x", "mode": 15e-1}', "", '{"mode":1.5,"user.name":"x"}'), ('{"user.name": "x", "mode": null}', "", None),
        ('{"user.name": "x", "stops": [{"lat": 1}, {"up": 2}, 4]}', "stops[1].lat: missing; stops[1].up: unknown; stops[2]: not object", None),
        ('{"user.name": "x", "it\'s": 2.5}', "it's: not integer", None), ('{"user.name": "a", "user.name": "b"}', "arguments: not an object", None),
    ]
    same = ["100", "1e2", "100.0", "1.0E+2"], ["0", "-0", "0.0", "0e5", "-0.0"], ["0.0000001", "1e-7"], ["1000000000000000000", "1e18"], ["1e40"], ["-2.50", "-2.5"], ["1e-30"]
    texts = ['"1.0"', '"a\\\\", 1.0 e2"'.replace('", ', '\\", '), '"1e2 \\n\\\\\\" 3.0"']
    calls = [(1, f"c{i}", i, "go", text, [], "", 0) for i, (text, _, _) in enumerate(cases)]
    calls += [(2, f"{i}-{k}", k, "free", '{"n": [%s]}' % n, [], "", 0) for i, group in enumerate(same) for k, n in enumerate(group)] + [(3, f"s{i}", i, "free", '{"t": %s, "z": 1.0}' % t, [], "", 0) for i, t in enumerate(texts)]
    rows = {(r.conv_id, r.call_id): r for r in link_tool_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame([], RESULTS), schemas).collect()}
    for i, (text, faults, form) in enumerate(cases):
        got = rows[1, f"c{i}"]
        assert (got.faults, got.valid) == (faults, not faults)
        assert form is None or got.json.startswith('{"arguments":' + form + ",")
    for i, group in enumerate(same):
        forms = {rows[2, f"{i}-{k}"].json.split(',"call_id"')[0] for k in range(len(group))}
        assert len(forms) == 1 and json.loads(forms.pop() + "}")["arguments"]["n"] == [float(group[0])]
    for i, t in enumerate(texts):
        assert json.loads(rows[3, f"s{i}"].json)["arguments"] == {"t": json.loads(t), "z": 1} and '"z":1}' in rows[3, f"s{i}"].json


def test_long_chains_repeated_rows_and_rows_without_identifiers(spark):
    calls = [(1, f"c{i}", i, "noop", "{}", [f"c{i - 1}"], "", 0) for i in range(12)] + [(1, "r", 5, "noop", "{}", ["c3"], "", 0), (1, "r", 5, "noop", "{}", ["c2"], "", 0)] + [(None, None, 0, "noop", "{}", [], "", 0)] * 3
    calls += [(9, "same", 1, "noop", "{}", [], "", 0)] * 5 + [(8, "long", 0, "noop", json.dumps({"t": "x\n" * 200_000}), [], "", 0)]
    results = [(None, "q", 1, "a", "")] * 2 + [(9, "same", 2, "r", "")] * 4
    rows = link_tool_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), SCHEMAS).collect()
    assert len(rows) == len(calls) + len(results) - 1
    assert {r.call_id: r.depth for r in rows if r.conv_id == 1 and r.status == "open"} == {f"c{i}": i for i in range(12)} | {"r": 3}
    assert sorted((r.kind, r.status) for r in rows if r.conv_id == 9) == [("call", "linked")] + [("call", "repeated")] * 4 + [("result", "repeated")] * 3
    assert sorted((r.kind, r.status) for r in rows if r.conv_id is None) == [("call", "open")] * 3 + [("result", "orphan")] * 2
    assert [r.faults for r in rows if r.conv_id == 8] == ["t: unknown"] and len(next(r.json for r in rows if r.conv_id == 8)) > 600_000


def test_conversations_and_empty_tables(spark):
    talk = spark.createDataFrame([(1, 0, "system", "be brief", "x"), (1, 1, "user", 'say "hi"\n', "x"), (1, 2, "assistant", "hi", "x"), (2, 0, "user", None, "x"), (3, 5, None, "?", "x")], "conv_id long, turn long, role string, text string, name string")
    rows = {(r.conv_id, r.call_id): r for r in link_tool_calls(*conversation_calls(talk), CHAT_SCHEMAS).collect()}
    assert rows[1, "t1"].depth == 1 and json.loads(rows[1, "t1"].json)["arguments"] == {"text": 'say "hi"\n', "turn": 1} and json.loads(rows[1, "t1"].json)["content"] == "hi"
    assert rows[2, "t0"].valid is False and rows[3, "t4"].status == "orphan" and rows[1, "t0"].status == "open"
    none = spark.createDataFrame([], talk.schema)
    assert link_tool_calls(*conversation_calls(none), CHAT_SCHEMAS).count() == 0


def brute_nearest(rows, every, k):
    ok = {i: np.array(v, float) for i, v in rows if i is not None and v and None not in v and all(math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, v in ok.items():
        if q % every == 0:
            out[q] = sorted((float(np.sqrt(((w - v) ** 2).sum())), i) for i, w in ok.items() if i != q)[:k]
    return out


def test_nearest_rows(spark):
    r = random.Random(1)
    rows = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(150)]
    rows += [(i, rows[3][1]) for i in range(200, 240)] + [(300, None), (400, [0.0] * 8), (500, [float("nan")] + [1.0] * 7), (600, [None] + [1.0] * 7), (700, [float("inf")] * 8), (800, []), (None, rows[0][1]), (900, rows[5][1])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, node string").repartition(3)
    want = brute_nearest([(i, [None if x is None else float(np.float32(x)) for x in v] if v else v) for i, v in rows], 100, 10)
    got = {}
    for x in nearest_of_queries(df).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.score, x.vec_id))
    assert set(got) == set(want)
    for q in want:
        assert [i for _, i in got[q]] == [i for _, i in want[q]] and np.allclose([s for s, _ in got[q]], [s for s, _ in want[q]], atol=1e-12)
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(x.rank, x.vec_id, round(x.score, 6)) for x in nearest_of_queries(few).orderBy("rank").collect()] == [(1, 2, 1.0), (2, 1, 1.414214)]
    assert nearest_of_queries(spark.createDataFrame([], df.schema)).count() == 0


def test_graph_recall_with_small_leaves(spark):
    """Many leaves, so that descent and search have to find what the start missed."""
    from pyspark.sql import functions as F

    from pairloom.llm import neighbours as n

    r = np.random.default_rng(3)
    x = r.standard_normal((1500, 12))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node long, v array<double>").repartition(3)
    codes = df.mapInArrow(n._codes, "node long, code binary, scale double")
    graph = n.neighbour_graph(codes, 1500, trees=2, leaf=64, degree=16, descents=2)
    asked = df.where("node % 50 = 0").select("node")
    found = {a.node: a.ids[:10] for a in n.search(asked, codes, graph, degree=16, width=32, beam=64, rounds=4).select("node", F.slice("ids", 1, 10).alias("ids")).collect()}
    hits = sum(len(set(ids) & set(np.argsort(((x - x[q]) ** 2).sum(1))[1:11].tolist())) for q, ids in found.items())
    assert len(found) == 30 and hits >= 0.9 * 300


def test_recall_with_production_parameters_on_many_leaves(spark):
    """9,000 vectors around 300 centres, so that the start graph has several leaves and the descents and the search are at work."""
    r = np.random.default_rng(8)
    x = (r.standard_normal((300, 24))[r.integers(0, 300, 9000)] + 0.6 * r.standard_normal((9000, 24))).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for row in nearest_of_queries(rows).collect():
        got.setdefault(row.query_id, set()).add(row.vec_id)
    hits = 0
    for q in range(0, 9000, 100):
        gap = ((x.astype(np.float64) - x[q].astype(np.float64)) ** 2).sum(1)
        gap[q] = np.inf
        hits += len(got[q] & set(np.argsort(gap, kind="stable")[:10].tolist()))
    assert hits >= 0.95 * 900


def test_recall_within_a_hot_cluster_of_near_copies(spark):
    """A third of the rows are distinct vectors within a thousandth of their norm."""
    r = np.random.default_rng(5)
    x = r.standard_normal((6000, 64)).astype(np.float32)
    x[:2000] = x[0] + 0.001 * r.standard_normal((2000, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)
    got = {}
    for row in nearest_of_queries(df).where("query_id < 2000").collect():
        got.setdefault(row.query_id, set()).add(row.vec_id)
    y = x.astype(float)
    hits = sum(len(ids & set(np.argsort(((y - y[q]) ** 2).sum(1))[1:11].tolist())) for q, ids in got.items())
    assert len(got) == 20 and hits >= 0.9 * 200


PAGES = "page_id long, url string, html string, same string, revisit boolean"


def test_archives_round_trip(spark):
    r = random.Random(3)
    html = ["<p>é " + "".join(r.choice("abcdef \n") for _ in range(n)) for n in (0, 5, 300, 70_000, 300_000)]
    rows = [(i, f"http://h/{i}?q=ä b\r\nX: y", html[i % 5]) for i in range(40)] + [(100, None, None), (101, "", ""), (None, "u", html[1]), (None, "u", "only here"), (39, "again", html[4])]
    df = spark.createDataFrame([(*x, "s", True) for x in rows], PAGES).repartition(3)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        last = max((j for j, _, g in rows if (g or "") == (h or "") and j is not None), default=None)
        revisit = last is not None and i != last
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", last if revisit else None))
    for size in (1000, 50_000, 8 << 20):
        manifest = warc.write_warc(df, new_path(spark, "t"))
        back = warc.read_warc(manifest, range_bytes=size)
        got = [(x.page_id, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to) for x in back.collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    urls = {x.page_id: x.url for x in back.collect()}
    assert urls[0] == rows[0][1] and urls[100] is None
    assert all(x.payload.decode() == html[x.page_id % 5] for x in back.where("record_type = 'response' AND page_id < 40").collect())
    folder = manifest.first().file.rsplit("/", 1)[0]
    assert warc.read_warc(warc.list_archives(spark, folder)).count() == len(rows)
    assert warc.round_trip(spark.createDataFrame([], df.schema)).count() == 0


def test_small_payloads_can_all_be_responses(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    got = {x.page_id: x.record_type for x in warc.round_trip(df, min_revisit_bytes=3).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_reader_is_not_fooled_by_magic_bytes():
    noise = b"\x1f\x8b\x08" * 5 + warc.gzip_member(b"not a record", 6) + b"\x1f\x8b\x08\x00"
    records = [warc.gzip_member(warc.record(i, "u", b"x" * i, None, False, "2000-01-01T00:00:00Z"), 6) for i in (1, 5000, 3)]
    raw = noise + records[0] + noise + records[1] + records[2] + noise
    for cut in (1, 7, 64, 10_000):
        found = [(o, warc.parsed(d)["page_id"]) for s in range(0, len(raw), cut) for o, d in warc.members(io.BytesIO(raw), s, min(s + cut, len(raw)))]
        assert [p for _, p in found] == [1, 5000, 3]
    with pytest.raises(EOFError):
        list(warc.members(io.BytesIO(records[1][:-20]), 0, 10))


def test_records_with_long_urls_are_read(spark):
    url = "data:" + "".join(random.Random(1).choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(300_000))
    urls = ["u", url, "é" * 30_000, "v"]
    raw = b"".join(warc.gzip_member(warc.record(i, u, b"x", None, False, "2000-01-01T00:00:00Z"), 6) for i, u in enumerate(urls))
    for cut in (1000, 70_000, len(raw)):
        found = [warc.parsed(d) for s in range(0, len(raw), cut) for _, d in warc.members(io.BytesIO(raw), s, min(s + cut, len(raw)))]
        assert [(x["page_id"], x["url"]) for x in found] == list(enumerate(urls))
    manifest = spark.createDataFrame([("a", 2)], "file string, records long")
    with pytest.raises(ValueError):
        warc.check_counts(spark.createDataFrame([("a",)], "file string"), manifest)


def test_pipeline(spark, tmp_path):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    text = lambda n: " ".join(word() for _ in range(n))
    item, passage, near = text(40), text(60), text(200).split(" ")
    copy = list(near)
    copy[7] = "zzzzz"
    docs = [(i, text(80), "en", "s", 1) for i in range(20)]
    docs += [(30, "123 456", "en", "s", 1), (31, None, "en", "s", 1), (40, " ".join(near), "en", "s", 1), (41, " ".join(copy), None, "s", 1), (50, text(20) + " " + passage + " tail", "en", "s", 1), (51, passage + " " + text(30), "en", "s", 1), (60, text(10) + "  " + item, "en", "s", 1), (None, text(50), "en", "s", 1), (5, docs[5][1], "en", "s", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id int, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = sorted((x.doc_id for x in got), key=str)
    assert ids == sorted([*range(20), 40, 50, 51, None], key=str)
    stages = dict(corpus_pipeline.STAGES)
    cut = {x.doc_id: x.text for x in stages["repeats"](spark, spark.read.parquet(f"{tmp_path}/documents.parquet").where("doc_id IN (50, 51, 3)"), str(tmp_path)).collect()}
    assert cut[50] == docs[24][1].replace(passage + " ", "") and cut[51] == docs[25][1].replace(passage + " ", "") and cut[3] == docs[3][1]
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_queries_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 11)} <= {x.split("_")[0] for x in names} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)

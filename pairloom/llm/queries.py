"""The driver's queries over these operators, with production parameters, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.chat import CHAT_SCHEMAS, conversation_calls, link_tool_calls
from pairloom.llm.decontamination import contaminated
from pairloom.llm.filter_audit import audit_filters
from pairloom.llm.language_id import identify_held_out
from pairloom.llm.licenses import find_licenses
from pairloom.llm.neighbours import nearest_of_queries
from pairloom.llm.ngram_join import similar_groups
from pairloom.llm.pieces import encode_texts
from pairloom.llm.simhash_groups import simhash_groups
from pairloom.llm.store import table
from pairloom.llm.substring_dedup import remove_repeats
from pairloom.llm.toxicity import score_toxicity
from pairloom.llm.vector_codes import ROUNDS, code_report
from pairloom.llm.warc import round_trip

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: words, removed words and the digest of what stays (35-word windows that start anywhere else go)."""
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "n_removed", "kept_sha256")


SQL["op1_substring_dedup"] = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, i, array_to_string(ws[i : i + 34], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)),
dup AS (SELECT win FROM s GROUP BY win HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM s JOIN dup USING (win)),
word AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS x FROM w),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""


@query
def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: size of its shingle set, the smallest doc_id that links reach, its class and its number of links."""
    return similar_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per page, as read back from the archives written."""
    return round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# DuckDB has SHA-1 as hex only; base32 is spelt out five bits at a time.
SQL["op10_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
m AS (SELECT html, max(page_id) AS latest FROM p GROUP BY html),
d AS (SELECT page_id, latest, octet_length(encode(html)) AS payload_bytes,
 array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
   1 + CAST(('0b' || substr(array_to_string(list_transform(range(1, 41), lambda j: substr('0000000100100011010001010110011110001001101010111100110111101111',
   1 + 4 * (instr('0123456789abcdef', substr(sha1(html), CAST(j AS INTEGER), 1)) - 1), 4)), ''), CAST(5 * i + 1 AS INTEGER), 5)) AS INTEGER), 1)), '') AS payload_digest
 FROM p JOIN m USING (html))
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id = latest THEN 'response' ELSE 'revisit' END AS record_type,
 CASE WHEN page_id <> latest THEN latest END AS refers_to FROM d
"""


@query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: the language predicted for its whole text."""
    return identify_held_out(table(spark, sf_dir, "documents"))


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: the score of its whole text."""
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows found of each row whose vec_id is divisible by 100."""
    return nearest_of_queries(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


@query
def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: number and digest of its pieces, and whether they decode to its text."""
    encoded = encode_texts(table(spark, sf_dir, "documents"), ["doc_id"])
    return encoded.select("doc_id", F.size("piece_ids").cast("long").alias("n_pieces"), "pieces_sha256", F.col("decodes").alias("round_trip"))


@query
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and benchmark item that its text holds: the best window and its weighted similarity."""
    found = contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select("doc_id", "item_id", "first_word", "n_words", "similarity")


# Exact search without fingerprints: all windows of an item's length of the documents that share a shingle with it.
SQL["op6_decontamination"] = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
ds AS (SELECT doc_id, len(w) AS n, CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) ELSE [len(w) || '|' || array_to_string(w, ' ')] END AS s FROM d WHERE len(w) > 0),
bs AS (SELECT item_id, len(w) AS len, CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) ELSE [len(w) || '|' || array_to_string(w, ' ')] END AS s FROM b WHERE len(w) > 0),
pair AS (SELECT DISTINCT doc_id, item_id FROM (SELECT doc_id, unnest(s) AS x FROM ds) JOIN (SELECT item_id, unnest(s) AS x FROM bs) USING (x)),
win AS (SELECT doc_id, item_id, len, least(n, len) AS n_words, ds.s AS ds, bs.s AS bs, unnest(range(0, greatest(n - len, 0) + 1)) AS first_word FROM pair JOIN ds USING (doc_id) JOIN bs USING (item_id)),
own AS (SELECT doc_id, item_id, first_word, n_words, bs, ds[first_word + 1 : first_word + greatest(n_words - 4, 1)] AS ws FROM win),
c AS (SELECT *, list_sum(list_transform(list_distinct(bs), lambda x: least(len(list_filter(bs, lambda y: y = x)), len(list_filter(ws, lambda y: y = x))))) AS common FROM own),
ok AS (SELECT *, len(bs) + len(ws) - common AS total FROM c WHERE 100 * common >= 75 * (len(bs) + len(ws) - common))
SELECT doc_id, item_id, CAST(first_word AS INTEGER) AS first_word, CAST(n_words AS INTEGER) AS n_words, similarity FROM (
  SELECT *, common / total AS similarity, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY common / total DESC, first_word) AS k FROM ok) WHERE k = 1
"""


@query
def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per call, or result without one, of all conversations, with its canonical JSON."""
    return link_tool_calls(*conversation_calls(table(spark, sf_dir, "conversations")), CHAT_SCHEMAS)


SQL["op4_chat_formatting"] = """
WITH c AS (SELECT conv_id, 't' || turn AS call_id, turn, role, text, CASE role WHEN 'system' THEN 'configure' ELSE 'ask' END AS name FROM conversations WHERE role IN ('system', 'user')),
r AS (SELECT conv_id, 't' || (turn - 1) AS call_id, turn, text AS content FROM conversations WHERE role NOT IN ('system', 'user') OR role IS NULL),
j AS (SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, c.turn AS call_turn, r.turn AS result_turn, role, text, name, content, c.conv_id IS NOT NULL AS is_call, r.conv_id IS NOT NULL AS has_result
  FROM c FULL JOIN r ON c.conv_id = r.conv_id AND c.call_id = r.call_id),
d AS (SELECT j.*, CASE WHEN is_call THEN CASE WHEN role = 'user' AND call_turn > 0 AND z.conv_id IS NOT NULL THEN 1 ELSE 0 END END AS depth, coalesce(call_turn, result_turn) AS turn,
  CASE WHEN is_call THEN 'call' ELSE 'result' END AS kind, CASE WHEN NOT is_call THEN 'orphan' WHEN has_result THEN 'linked' ELSE 'open' END AS status
  FROM j LEFT JOIN (SELECT DISTINCT conv_id FROM c WHERE call_id = 't0') z ON z.conv_id = j.conv_id)
SELECT conv_id, call_id, CAST(depth AS INTEGER) AS depth, turn, kind, name, status, CASE WHEN is_call THEN text IS NOT NULL END AS valid,
  CASE WHEN is_call THEN CASE WHEN text IS NULL THEN 'text: missing' ELSE '' END END AS faults,
  '{' || CASE WHEN is_call THEN '"arguments":{' || concat_ws(',', '"text":' || to_json(text), CASE WHEN role = 'user' THEN '"turn":' || call_turn END) || '},' ELSE '' END || '"call_id":"' || call_id || '"'
  || coalesce(',"content":' || to_json(content), '') || ',"conv_id":' || conv_id || coalesce(',"depth":' || depth, '') || ',"kind":"' || kind || '"' || coalesce(',"name":"' || name || '"', '')
  || ',"status":"' || status || '","turn":' || turn || '}' AS json
FROM d
"""


@query
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per license notice in the documents."""
    return find_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op11_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its fingerprint and the smallest doc_id that links of at most four differing bits reach."""
    return simhash_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per vector: its code, its error, the error of its label, and the digest of the codebooks."""
    return code_report(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"))


def _codes_sql(rounds: int) -> str:
    """All vectors against all entries in each round; a distance and its entry are one number, so that ties go to the smaller index."""
    nearest = lambda k: f"a{k} AS MATERIALIZED (SELECT vec_id, label, pos, any_value(x) AS x, min(CAST(xx - 2 * list_inner_product(x, c) + cc AS BIGINT) * 256 + entry) AS m FROM p JOIN k{k} USING (pos) GROUP BY vec_id, label, pos)"  # noqa: E731
    books = lambda k: (  # noqa: E731
        f"n{k} AS (SELECT pos, entry, list(c ORDER BY i) AS c FROM (SELECT pos, m % 256 AS entry, i, floor(sum(x[i]) / count(*)) AS c FROM (SELECT pos, m, x, unnest(range(1, len(x) + 1)) AS i FROM a{k - 1}) GROUP BY pos, m % 256, i) GROUP BY pos, entry),\n"
        f"k{k} AS MATERIALIZED (SELECT pos, entry, c, list_inner_product(c, c) AS cc FROM (SELECT o.pos, o.entry, coalesce(n{k}.c, o.c) AS c FROM k{k - 1} o LEFT JOIN n{k} USING (pos, entry)))"
    )
    return f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT vec_id, label, CAST(pos AS INTEGER) AS pos, e[pos * len(e) // 4 + 1 : (pos + 1) * len(e) // 4] AS x FROM v CROSS JOIN (SELECT unnest(range(0, 4)) AS pos)),
p AS MATERIALIZED (SELECT *, list_inner_product(x, x) AS xx FROM s),
k0 AS MATERIALIZED (SELECT pos, entry, x AS c, xx AS cc FROM (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY vec_id) - 1 AS entry FROM p) WHERE entry < 256),
{nearest(0)},
{",".join(f"{chr(10)}{books(k)},{chr(10)}{nearest(k)}" for k in range(1, rounds + 1))},
r AS (SELECT vec_id, label, string_agg(printf('%02x', m % 256), '' ORDER BY pos) AS code, CAST(sum(m // 256) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id, label),
h AS (SELECT sha256(string_agg(CAST(CAST(z AS BIGINT) AS VARCHAR), ',' ORDER BY pos, entry, i)) AS codebooks_sha256 FROM (SELECT pos, entry, unnest(c) AS z, unnest(range(0, len(c))) AS i FROM k{rounds}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM r CROSS JOIN h
"""


SQL["op12_vector_codes"] = _codes_sql(ROUNDS)


@query
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per source, order of the five filters and step: what stays, goes, would have gone anyway, and whose fault it is."""
    return audit_filters(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), table(spark, sf_dir, "labels"))


SQL["op13_filter_audit"] = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[ 	-]+'), lambda x: x <> '') AS ws, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS again FROM d),
f AS (SELECT doc_id, part, CASE WHEN len(ws) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 65 * len(ws) THEN 2 ELSE 0 END + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END
  + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN again THEN 16 ELSE 0 END AS fails FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, fails),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS y),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.y, b.y, c.y, d.y, e.y] AS ys FROM x a, x b, x c, x d, x e WHERE a.y + b.y + c.y + d.y + e.y = 31 AND len(list_distinct([a.y, b.y, c.y, d.y, e.y])) = 5),
s AS (SELECT filter_order, step, ys[step] AS own, CAST(list_sum(ys[1 : step]) AS INTEGER) AS upto FROM (SELECT filter_order, ys, unnest(range(1, 6)) AS step FROM o)),
r AS (SELECT part, filter_order, step, own, sum(n) FILTER (WHERE fails & upto = 0) AS kept, sum(n) FILTER (WHERE fails & upto = own) AS removed, sum(n) FILTER (WHERE fails & own > 0 AND fails & upto > own) AS redundant,
  sum(n) FILTER (WHERE fails = own) AS unique_fails, sum(good) FILTER (WHERE fails & upto = own) AS good_lost, sum(toxic) FILTER (WHERE fails & upto = own) AS toxic_lost FROM c CROSS JOIN s GROUP BY part, filter_order, step, own)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
 CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(coalesce(sum(removed) OVER (PARTITION BY part, own), 0) AS BIGINT) AS shapley FROM r
"""

"""Registered queries of the text operators over the whole given tables, and their SQL where there is one."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.llm import (
    chosenpath, collocations, decontaminate, forest, langid, licenses, mixing, packing, pii, prefixes, rendezvous, segments, toolcalls,
)
from lexspan.llm.common import small_batches

SHARDS = 16
NEIGHBOURS = 20
QUERY_EVERY = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> tuple[str, str]:
    """Path and pre-tokenizer pattern of the vocabulary that packing uses by default."""
    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(table(spark, sf_dir, "documents"), *vocabulary())


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs.select("doc_id", "text", "lang")))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vector"))
    return forest.search(rows, rows.where(F.col("id") % QUERY_EVERY == 0), NEIGHBOURS)


def op5_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = toolcalls.conversation_calls(table(spark, sf_dir, "conversations"))
    rows = toolcalls.formatted(calls, results, toolcalls.TOOLS)
    return rows.select("call_id", "status", "n_results", "depth", "errors", "json")


def op6_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.scores(table(spark, sf_dir, "documents"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS)],
        F.sha2(pii.listed(F.col("spans")).cast("binary"), 256).alias("base_sha256"),
        pii.listed(F.concat("spans", "new")).alias("spans"),
    )


def op8_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rendezvous.sizes(table(spark, sf_dir, "documents"))
    placed = rendezvous.place(rows, "doc_id", rendezvous.even(SHARDS), rendezvous.even(SHARDS + 1))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start", "similarity")


def op10_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosenpath.join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.trie(table(spark, sf_dir, "conversations"))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_packing, op2_license_scan, op3_language_id, op4_nearest_neighbours, op5_tool_calls,
        op6_context_mixing, op7_personal_data, op8_rendezvous_sharding, op9_decontamination, op10_chosen_path_join,
        op11_prefix_trie, op12_sentencepiece, op13_collocations,
    )
}

# Every window like an item, found by joining all shingles; starts from those that share one.
LEAKS = """
WITH docs AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents),
items AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
ds AS (SELECT doc_id, len(w) AS total, i AS pos, array_to_string(w[i + 1 : i + 5], ' ') AS s FROM docs, range(0, len(w) - 4) r(i)),
bs AS (SELECT item_id, len(w) AS size, array_to_string(w[i + 1 : i + 5], ' ') AS s FROM items, range(0, len(w) - 4) r(i)),
bag AS (SELECT item_id, size, s, count(*) AS weight FROM bs GROUP BY ALL),
hits AS (SELECT DISTINCT doc_id, total, pos, item_id, size FROM ds JOIN bs USING (s)),
wins AS (SELECT DISTINCT doc_id, total, item_id, size, start FROM hits, range(greatest(0, pos - size + 5), pos + 1) r(start)),
held AS (SELECT w.doc_id, w.item_id, w.size, w.start, least(w.size, w.total - w.start) - 4 AS n, d.s, count(*) AS held
  FROM wins w JOIN ds d ON d.doc_id = w.doc_id AND d.pos BETWEEN w.start AND w.start + w.size - 5 GROUP BY ALL),
both_ AS (SELECT doc_id, h.item_id, start, any_value(n) AS n, any_value(h.size) - 4 AS m, sum(least(held, weight)) AS c
  FROM held h JOIN bag b ON b.item_id = h.item_id AND b.s = h.s GROUP BY doc_id, h.item_id, start),
scored AS (SELECT doc_id, item_id, start, c / (n + m - c) AS similarity FROM both_)
SELECT doc_id, item_id, CAST(arg_min(start, (-similarity, start)) AS INT) AS start, max(similarity) AS similarity
FROM scored WHERE similarity >= 0.8 GROUP BY doc_id, item_id
"""

# Exact similarity join on shingle sets, and its components.
LINKS = """
WITH RECURSIVE docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), ' '), lambda x: x <> '') AS w
  FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 5], ' ') AS s FROM docs, range(0, greatest(len(w) - 4, least(len(w), 1))) r(i)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM common JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE c >= 0.8 * (nx.n + ny.n - c) - 1e-9),
reach AS (SELECT doc_id, doc_id AS seen FROM documents UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON l.x = r.seen),
class AS (SELECT doc_id, min(seen) AS class_id FROM reach GROUP BY 1),
deg AS (SELECT x AS doc_id, count(*) AS n_links FROM links GROUP BY 1)
SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links FROM class LEFT JOIN deg USING (doc_id)
"""

TOOL_CALLS = """
WITH calls AS (
  SELECT conv_id || ':' || turn AS call_id, any_value(conv_id) AS conv_id, any_value(turn) AS turn, min(text) AS prompt
  FROM conversations WHERE role = 'user' GROUP BY 1),
results AS (
  SELECT conv_id || ':' || (turn - 1) AS call_id, min(text) AS content, count(*) AS n_results
  FROM conversations WHERE role = 'assistant' GROUP BY 1),
runs AS (SELECT *, turn // 2 - row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS run FROM calls),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn % 2, run ORDER BY turn) - 1 AS depth FROM runs),
joined AS (
  SELECT call_id, conv_id, turn, prompt, depth, content, coalesce(n_results, 0) AS n_results,
    CASE WHEN p.call_id IS NULL THEN 'orphan' WHEN n_results IS NULL THEN 'unanswered' WHEN n_results > 1 THEN 'ambiguous' ELSE 'linked' END AS status,
    CASE WHEN p.call_id IS NULL THEN NULL WHEN prompt IS NULL OR trim(prompt) = '' THEN 'reply.prompt: filled' ELSE '' END AS errors
  FROM placed p FULL JOIN results r USING (call_id))
SELECT call_id, status, n_results, depth, errors,
  '{' || CASE WHEN status <> 'orphan' THEN '"arguments":{"conversation":' || conv_id || coalesce(',"prompt":' || CAST(to_json(prompt) AS VARCHAR), '') || ',"turn":' || turn || '},' ELSE '' END
  || '"call_id":"' || call_id || '"' || coalesce(',"content":' || CAST(to_json(content) AS VARCHAR), '')
  || coalesce(',"errors":"' || errors || '"', '') || CASE WHEN status <> 'orphan' THEN ',"name":"reply"' ELSE '' END
  || ',"status":"' || status || '"' || CASE WHEN status <> 'orphan' THEN ',"waits_for":"' || conv_id || ':' || (turn - 2) || '"' ELSE '' END || '}' AS json
FROM joined
"""

# The whole trie by lists: the checksum of a decimal number bit by bit, then every prefix of every rebuilt conversation.
PREFIXES = """
WITH own AS (
  SELECT conv_id AS c, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
sums AS (
  SELECT c, turns, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda acc, byte: list_reduce(list_prepend(xor(acc, byte), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
      lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)), 4294967295) % 9 AS h
  FROM own),
built AS (
  SELECT s.c, coalesce(b.turns[1 : s.h], []) || s.turns[s.h + 1 :] AS turns FROM sums s LEFT JOIN own b ON b.c = s.c - s.c % 5),
member AS (SELECT c, turns[1 : d] AS path, d, len(turns) AS total FROM built, range(0, len(turns) + 1) r(d)),
node AS (
  SELECT path, d, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE d = total), '') AS ends
  FROM member GROUP BY path, d),
kids AS (SELECT path[1 : d - 1] AS path, count(*) AS n_children FROM node WHERE d > 0 GROUP BY 1),
full_ AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * strlen(n.path[d].t) END AS own
  FROM node n LEFT JOIN kids k ON k.path = n.path),
sub AS (
  SELECT f.path[1 : up] AS path, sum(own) AS saved, sum((n_children = 0)::INT) AS leaves FROM full_ f, range(0, f.d + 1) r(up) GROUP BY 1)
SELECT f.conv_id, f.d AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, leaves::BIGINT AS n_leaves,
  saved::BIGINT AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM full_ f JOIN sub s ON s.path = f.path LEFT JOIN full_ p ON f.d > 0 AND p.path = f.path[1 : f.d - 1]
"""

PHRASES = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
listed AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (
  SELECT lang, size, array_to_string(w[i : i + size - 1], ' ') AS phrase, count(*) AS f
  FROM listed, range(1, 6) s(size), range(1, len(w) - size + 2) r(i) GROUP BY ALL),
totals AS (SELECT lang, sum(f) AS n FROM grams WHERE size = 1 GROUP BY 1),
cand AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM grams WHERE size > 1 AND f >= 100),
inside AS (
  SELECT lang, array_to_string(w[i : i + k - 1], ' ') AS phrase, max(a) AS over_ FROM cand, range(2, size) s(k), range(1, size - k + 2) r(i) GROUP BY 1, 2),
kept AS (SELECT c.* FROM cand c LEFT JOIN inside i ON i.lang = c.lang AND i.phrase = c.phrase WHERE over_ IS NULL OR 100 * over_ < 100 * a),
cuts AS (
  SELECT c.lang, c.phrase, a, n, k, l.f AS l, r.f AS r, (1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f) AS score
  FROM kept c, range(1, size) s(k), grams l, grams r, totals t
  WHERE l.lang = c.lang AND l.phrase = array_to_string(w[1 : k], ' ') AND r.lang = c.lang AND r.phrase = array_to_string(w[k + 1 :], ' ') AND t.lang = c.lang),
best AS (SELECT lang, phrase, a, n::BIGINT AS n, arg_min(struct_pack(l := l, r := r, score := score), (score, k)) AS cut FROM cuts GROUP BY ALL),
ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY cut.score DESC, a DESC, phrase) AS rank, phrase, a, cut.l AS l, cut.r AS r, n, cut.score::BIGINT AS score FROM best)
SELECT * FROM ranked WHERE rank <= 2000
"""

ORACLES = {"op11_prefix_trie": PREFIXES, "op13_collocations": PHRASES, "op5_tool_calls": TOOL_CALLS, "op9_decontamination": LEAKS, "op10_chosen_path_join": LINKS}

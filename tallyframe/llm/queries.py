"""The registered queries of the operators and of the pipeline, with their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_join

    return jaccard_join(_documents(spark, sf_dir))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .sentencepiece_codec import round_trip

    return round_trip(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import edited_fingerprints

    return edited_fingerprints(_documents(spark, sf_dir))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import embedding_dedup

    return embedding_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import substring_dedup

    out = substring_dedup(_documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import language_fold

    return language_fold(_documents(spark, sf_dir))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import sanitise

    out = sanitise(_documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


#: (verdict, host, path)
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import rule_table, url_filter

    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"), rule_table(spark, URL_RULES))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .chat import chat_digest

    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    more = spark.sql("SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)")
    return chat_digest(rows.unionByName(more), public_tokenizers.path("byte_bpe_50k.json"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    return pack(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversation_trie import trie_digest

    return trie_digest(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import Scratch
    from .merkle import build, lower_cased_third, proofs

    return proofs(build(_documents(spark, sf_dir), Scratch(spark), lower_cased_third()))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe_codec import round_trip

    return round_trip(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_fingerprints": op2_fingerprints,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_language_id": op5_language_id,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_pii": op7_pii,
    "op8_url_filter": op8_url_filter,
    "op9_chat": op9_chat,
    "op10_packing": op10_packing,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_merkle": op12_merkle,
    "op13_bpe": op13_bpe,
}

OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS sh
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, least(len(ws), 1)) + 1)) AS i FROM w)),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (
  SELECT x.a, x.b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS k FROM s p JOIN s q ON p.sh = q.sh AND p.doc_id <> q.doc_id GROUP BY ALL) x
  JOIN c ca ON ca.doc_id = x.a JOIN c cb ON cb.doc_id = x.b
  WHERE 100 * x.k >= 75 * (ca.n + cb.n - x.k)),
r(doc_id, reached) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.reached = e.a),
m AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(c.n, 0) AS n_shingles, m.component_id
FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id JOIN m ON m.doc_id = d.doc_id
"""

OP3_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r(vec_id, reached) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.reached = l.a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
m AS (SELECT vec_id, min(reached) AS component_id FROM r GROUP BY vec_id)
SELECT m.vec_id, coalesce(n.n, 0) AS n_links, m.component_id, m.vec_id = m.component_id AS kept
FROM m LEFT JOIN n ON n.a = m.vec_id
"""

OP4_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 19), ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 19, 0) + 1)) AS i FROM w)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM dup),
g AS (SELECT doc_id, list(j) AS js, count(*) AS n FROM gone GROUP BY doc_id),
k AS (
  SELECT x.doc_id, string_agg(x.v, ' ' ORDER BY x.j) AS kept
  FROM (SELECT doc_id, unnest(ws) AS v, unnest(range(1, len(ws) + 1)) AS j FROM w) x
  LEFT JOIN gone ON gone.doc_id = x.doc_id AND gone.j = x.j
  WHERE gone.j IS NULL GROUP BY x.doc_id)
SELECT w.doc_id, len(w.ws) AS n_words, coalesce(g.n, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN g ON g.doc_id = w.doc_id LEFT JOIN k ON k.doc_id = w.doc_id
"""

OP8_SQL = r"""
WITH u AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
r(verdict, host, path) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
f AS (
  SELECT u.page_id, r.host || r.path AS rule, r.verdict, row_number() OVER (PARTITION BY u.page_id ORDER BY length(r.host || r.path) DESC) AS n
  FROM u JOIN r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path))
SELECT u.page_id, u.host, u.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM u LEFT JOIN f ON f.page_id = u.page_id AND f.n = 1
"""

OP9_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (
  SELECT *, length(role) + length(text)
    + length(regexp_replace(role || chr(0) || text, '\\|<\||</?s>|\[/?INST\]', '\0+', 'g')) - length(role) - length(text) - 1
    + length('<|role|><|text|><|end|>') AS chars
  FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

#: CRC-32 of a column's decimal digits.
_CRC32 = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({0}::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, k: xor(a >> 1, 3988292384::BIGINT * (a & 1)))), 4294967295)"""


OP11_SQL = f"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {_CRC32.format("conv_id")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
b AS (
  SELECT c.conv_id, i, role, text FROM c JOIN t ON t.conv_id = c.base AND i < h
  UNION ALL SELECT c.conv_id, i, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND i >= h),
p AS (
  SELECT conv_id, row_number() OVER w AS d, text, string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER w AS k FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY i)
  UNION ALL SELECT conv_id, 0, '', '' FROM c),
n AS (SELECT d, k, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(length(text)) AS saved FROM p GROUP BY d, k),
q AS (SELECT p.conv_id, p.d, n.conv_id AS node FROM p JOIN n ON n.d = p.d AND n.k = p.k),
up AS (SELECT n.conv_id, n.d, q.node AS parent FROM n JOIN q ON q.conv_id = n.conv_id AND q.d = n.d - 1),
kids AS (SELECT parent AS conv_id, d - 1 AS d, count(*) AS n_children FROM up GROUP BY ALL),
own AS (SELECT n.conv_id, n.d, saved, n_children IS NULL AS leaf FROM n LEFT JOIN kids ON kids.conv_id = n.conv_id AND kids.d = n.d),
sums AS (SELECT q.node AS conv_id, q.d, sum(leaf::BIGINT) AS n_leaves, sum(saved) AS saved_tokens FROM own JOIN q ON q.conv_id = own.conv_id AND q.d <= own.d GROUP BY ALL),
e AS (
  SELECT q.node AS conv_id, q.d, string_agg(x.conv_id::VARCHAR, ',' ORDER BY x.conv_id) AS ids
  FROM (SELECT conv_id, max(d) AS d FROM p GROUP BY conv_id) x JOIN q ON q.conv_id = x.conv_id AND q.d = x.d GROUP BY ALL)
SELECT n.conv_id, n.d AS depth, up.parent AS parent_conv_id, n.n_convs, coalesce(kids.n_children, 0) AS n_children, sums.n_leaves::BIGINT AS n_leaves,
  sums.saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM n JOIN sums ON sums.conv_id = n.conv_id AND sums.d = n.d LEFT JOIN up ON up.conv_id = n.conv_id AND up.d = n.d
LEFT JOIN kids ON kids.conv_id = n.conv_id AND kids.d = n.d LEFT JOIN e ON e.conv_id = n.conv_id AND e.d = n.d
"""


def _field(c: str) -> str:
    return f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"


def _tree(name: str, leaves: str) -> str:
    """All nodes ``(g, lvl, p, n, h)`` of trees over rows ``(g, p, n, h)`` and the siblings ``(g, lvl, p, l, r)`` of all but the roots."""
    return f"""
{name} AS (
  SELECT g, 0::BIGINT AS lvl, p, n, h FROM ({leaves})
  UNION ALL SELECT g, lvl + 1, p // 8, max((n + 7) // 8), sha256(string_agg(h, '' ORDER BY p)) FROM {name} WHERE n > 1 GROUP BY g, lvl, p // 8),
{name}_sib AS (
  SELECT a.g, a.lvl, a.p, coalesce(string_agg(CASE WHEN b.p < a.p THEN b.h END, '' ORDER BY b.p), '') AS l, coalesce(string_agg(CASE WHEN b.p > a.p THEN b.h END, '' ORDER BY b.p), '') AS r
  FROM {name} a JOIN {name} b ON a.g = b.g AND a.lvl = b.lvl AND a.p // 8 = b.p // 8 WHERE a.n > 1 GROUP BY a.g, a.lvl, a.p)"""


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP12_SQL = f"""
WITH RECURSIVE f AS (
  SELECT doc_id, lang, sha256({" || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))}) AS leaf,
    CASE WHEN {_CRC32.format("doc_id")} % 3 = 0 THEN sha256({" || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", _LOWER))}) END AS other
  FROM documents),
l0 AS (
  SELECT *, row_number() OVER (ORDER BY lang NULLS FIRST, doc_id NULLS FIRST, leaf) AS id, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY lang) AS n FROM f),
{_tree("t", "SELECT g, p, n, leaf AS h FROM l0")},
{_tree("u", "SELECT 0::BIGINT AS g, g AS p, count(*) OVER () AS n, h FROM t WHERE n = 1")},
steps AS (
  SELECT id, lvl AS k, l, r FROM l0 JOIN t_sib s ON s.g = l0.g AND s.p = l0.p // pow(8, s.lvl)::BIGINT
  UNION ALL SELECT id, 100 + lvl, l, r FROM l0 JOIN u_sib s ON s.p = l0.g // pow(8, s.lvl)::BIGINT),
numbered AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k) AS i FROM steps),
fold AS (
  SELECT id, 0::BIGINT AS i, coalesce(other, leaf) AS h FROM l0
  UNION ALL SELECT fold.id, fold.i + 1, sha256(l || h || r) FROM fold JOIN numbered s ON s.id = fold.id AND s.i = fold.i + 1),
proof AS (SELECT id, sha256(string_agg(l || r, '' ORDER BY i)) AS proof FROM numbered GROUP BY id),
folded AS (SELECT id, arg_max(h, i) AS h FROM fold GROUP BY id)
SELECT l0.doc_id, l0.leaf, t.h AS subroot, u.h AS root, coalesce(proof, sha256('')) AS proof_sha256, folded.h AS folded_root, folded.h = u.h AS verified
FROM l0 JOIN t ON t.g = l0.g AND t.n = 1 JOIN u ON u.n = 1 JOIN folded USING (id) LEFT JOIN proof USING (id)
"""

ORACLES: dict[str, str] = {
    "op3_embedding_dedup": OP3_SQL,
    "op4_substring_dedup": OP4_SQL,
    "op6_jaccard_join": OP6_SQL,
    "op8_url_filter": OP8_SQL,
    "op9_chat": OP9_SQL,
    "op11_conversation_trie": OP11_SQL,
    "op12_merkle": OP12_SQL,
}

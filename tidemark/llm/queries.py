"""The registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import ann, chat, fingerprints, langid, licenses, mixing, prefix_trie, secret_scan, sentencepiece_codec, sharding, simhash, warc, whitening
from tidemark.llm._common import table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_texts(table(spark, sf_dir, "documents"))


def op3_shard_by_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"))


def op4_format_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op5_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"), fold=True)


def op6_scan_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan_secrets(table(spark, sf_dir, "documents")))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def labelled(docs: DataFrame) -> DataFrame:
    """Rows that the language model may learn from."""
    return docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.learned(labelled(docs)))
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.capture_histories(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured")


def op11_scan_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan_licenses(table(spark, sf_dir, "documents")))


def op12_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.ranked(table(spark, sf_dir, "conversations"))
    return prefix_trie.with_ends(*prefix_trie.prefix_trie(prefix_trie.rebuilt(turns)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_mix_sources, op2_sentencepiece, op3_shard_by_bytes, op4_format_chats, op5_imatch, op6_scan_secrets, op7_nearest, op8_simhash, op9_language, op10_warc, op11_scan_licenses, op12_whiten, op13_prefix_trie)
}

#: Means stay below 64 in these tables and no row shares id and text with another, so each count is one draw: the least k whose distribution function reaches the number.
MIX_SQL = """WITH RECURSIVE n AS (SELECT source, count(*) AS n, pow(count(*), 0.5) AS w FROM documents GROUP BY 1),
rates AS (SELECT source, (SELECT CAST(sum(n) AS DOUBLE) FROM n) * w / (SELECT sum(w) FROM n) / n AS mean FROM n),
pmf AS (SELECT source, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS cdf FROM rates UNION ALL SELECT source, mean, k + 1, p * mean / (k + 1), cdf + p * mean / (k + 1) FROM pmf WHERE k < mean + 12 * sqrt(mean) + 20),
u AS (SELECT *, (CAST('0x' || substr(md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(md5(text), '') || ':1'), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0 AS u FROM documents),
counted AS (SELECT u.doc_id, u.text, u.lang, u.source, u.n_chars, (SELECT count(*) FROM pmf WHERE pmf.source IS NOT DISTINCT FROM u.source AND pmf.cdf < u.u) AS c FROM u)
SELECT doc_id, text, lang, source, n_chars, CAST(unnest(range(1, c + 1)) AS INTEGER) AS copy FROM counted"""

#: CRC-32 of the UTF-8 bytes, four bits at a time by the table that its polynomial gives.
SHARD_SQL = """WITH bits AS (SELECT range AS i, list_reduce([CAST(range AS BIGINT), 1, 2, 3, 4], lambda c, x: xor(c >> 1, (c & 1) * 3988292384)) AS t FROM range(16)),
tab AS (SELECT list(t ORDER BY i) AS t FROM bits),
d AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0) + 16 AS size,
  CASE WHEN coalesce(text, '') = '' THEN 0 ELSE xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, octet_length(encode(text)) * 2 + 1), lambda i: CAST('0x' || substr(hex(encode(text)), CAST(i + 1 - 2 * ((i + 1) % 2) AS INTEGER), 1) AS BIGINT))),
    lambda c, x: xor(c >> 4, tab.t[CAST((xor(c, x) & 15) + 1 AS INTEGER)])), 4294967295) END AS text_crc32 FROM documents, tab),
o AS (SELECT *, sum(size) OVER (ORDER BY doc_id, text_crc32, size ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS total FROM d),
s AS (SELECT *, CAST(least(39, ((2 * upto - size) * 40) // (2 * total)) AS INTEGER) AS shard FROM o)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s"""

NEAREST_SQL = """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM pairs) WHERE r <= 20"""

WARC_SQL = """WITH p AS (SELECT page_id, lower(coalesce(url, '')) AS url, coalesce(html, '') AS html FROM pages),
f AS (SELECT html, min(page_id) AS first FROM p WHERE octet_length(encode(html)) >= 100 GROUP BY 1),
u AS (SELECT page_id, html, regexp_replace(regexp_replace(url, '^[a-z][a-z0-9+.-]*://', ''), '#.*$', '') AS bare FROM p),
h AS (SELECT *, regexp_replace(regexp_replace(regexp_extract(bare, '^[^/?]*'), ':(80|443)$', ''), '^www\\d*\\.', '') AS host, regexp_replace(bare, '^[^/?]*', '') AS rest FROM u)
SELECT h.page_id, CAST(octet_length(encode(h.html)) AS BIGINT) AS payload_bytes, sha256(h.html) AS payload_digest, CASE WHEN f.first < h.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.first < h.page_id THEN f.first END AS refers_to, array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN rest = '' THEN '/' ELSE rest END AS url_key,
  strftime(TIMESTAMP '2024-01-01 00:00:00' + to_microseconds(h.page_id // 1000), '%Y-%m-%dT%H:%M:%S.%f') || lpad(CAST(h.page_id % 1000 AS VARCHAR), 3, '0') || 'Z' AS captured
FROM h LEFT JOIN f ON f.html = h.html"""

CRC = """CASE WHEN {0} = '' THEN 0 ELSE xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, octet_length(encode({0})) * 2 + 1), lambda i: CAST('0x' || substr(hex(encode({0})), CAST(i + 1 - 2 * ((i + 1) % 2) AS INTEGER), 1) AS BIGINT))),
    lambda c, x: xor(c >> 4, tab.t[CAST((xor(c, x) & 15) + 1 AS INTEGER)])), 4294967295) END"""

#: Phrases only, as these tables hold no identifier tags. Words stand between two spaces each, so that neighbouring places share none.
LICENSE_SQL = f"""WITH phrases(kind, phrase, label, level) AS (VALUES {", ".join(f"('{kind}', '  {p.replace(' ', '  ')}  ', '{label}', {licenses.restricts(label)}::DOUBLE)" for kind, held in (("base", licenses.BASE), ("notice", licenses.NOTICES)) for p, label in held.items())}),
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
t AS (SELECT doc_id, len(words) AS n_words, '  ' || array_to_string(words, '    ') || '  ' AS held FROM w),
t2 AS (SELECT doc_id, n_words, replace(held, '    ', '  ') AS one, held FROM t),
hits AS (SELECT doc_id, kind, label, level, replace(phrase, '  ', '    ') AS p4 FROM t2 JOIN phrases ON contains(one, phrase)),
places AS (SELECT doc_id, label, substr(p4, 3, length(p4) - 4) AS p, held FROM hits JOIN t2 USING (doc_id) WHERE kind = 'base'),
counted AS (SELECT doc_id, (length(held) - length(replace(held, p, ''))) // length(p) AS n, (length(substr(held, 1, strpos(held, p) - 1)) - length(replace(substr(held, 1, strpos(held, p) - 1), ' ', ''))) // 4 AS first,
  (length(held) - strpos(reverse(held), reverse(p)) - length(p) + 1) AS last_at, held FROM places),
base AS (SELECT doc_id, sum(n) AS n_base, min(first) AS first_word, max((length(substr(held, 1, last_at)) - length(replace(substr(held, 1, last_at), ' ', ''))) // 4) AS last_word FROM counted GROUP BY 1),
named AS (SELECT doc_id, coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (kind = 'base'), '') AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(level) AS score FROM hits GROUP BY 1)
SELECT doc_id, n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM t LEFT JOIN base USING (doc_id) LEFT JOIN named USING (doc_id)"""

TRIE_SQL = f"""WITH bits AS (SELECT range AS i, list_reduce([CAST(range AS BIGINT), 1, 2, 3, 4], lambda c, x: xor(c >> 1, (c & 1) * 3988292384)) AS t FROM range(16)),
tab AS (SELECT list(t ORDER BY i) AS t FROM bits),
t AS (SELECT conv_id, list(coalesce(role, '') || chr(31) || coalesce(text, '') ORDER BY turn NULLS FIRST) AS turns FROM conversations GROUP BY 1),
h AS (SELECT conv_id, turns, {CRC.format("CAST(conv_id AS VARCHAR)")} % 9 AS h FROM t, tab),
r AS (SELECT c.conv_id, list_concat(coalesce(list_slice(b.turns, 1, c.h), []), list_slice(c.turns, c.h + 1, len(c.turns))) AS turns FROM h c LEFT JOIN t b ON b.conv_id = c.conv_id - c.conv_id % 5),
m AS (SELECT conv_id, len(turns) AS size, unnest(range(0, len(turns) + 1)) AS depth, list_transform(turns, lambda x: md5(x)) AS path, turns FROM r),
n AS (SELECT list_slice(path, 1, depth) AS node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(CASE WHEN depth = 0 THEN 0 ELSE octet_length(encode(turns[depth])) - strpos(turns[depth], chr(31)) END) AS bytes,
  coalesce(sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (depth = size)), sha256('')) AS ends_sha256 FROM m GROUP BY 1, 2),
k AS (SELECT n.node, count(c.node) AS n_children FROM n LEFT JOIN n c ON c.depth = n.depth + 1 AND list_slice(c.node, 1, n.depth) = n.node GROUP BY 1),
s AS (SELECT list_slice(node, 1, d) AS node, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * bytes) AS saved FROM (SELECT n.*, n_children, unnest(range(0, depth + 1)) AS d FROM n JOIN k ON n.node = k.node) GROUP BY 1)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n JOIN k ON n.node = k.node JOIN s ON n.node = s.node LEFT JOIN n p ON n.depth > 0 AND p.node = list_slice(n.node, 1, n.depth - 1)"""

ORACLE_SQL: dict[str, str] = {"op1_mix_sources": MIX_SQL, "op3_shard_by_bytes": SHARD_SQL, "op7_nearest": NEAREST_SQL, "op10_warc": WARC_SQL, "op11_scan_licenses": LICENSE_SQL, "op13_prefix_trie": TRIE_SQL}

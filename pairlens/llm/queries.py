"""The queries of this subpackage and, where SQL expresses them, their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat, langid, media, mixing, neardup, ngram_join, packing, periodic, sharding, suffix, swap_packing, warc, whitening
from .common import table

#: The tokenizer file whose ids op10 and op11 pack.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), 3, 90, 100)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sharding.shard_documents(table(spark, sf_dir, "documents"), 16)
    return d.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(media.store(table(spark, sf_dir, "documents")))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(langid.fold(F.col("doc_id")) != 2).select("text", "lang"))
    return langid.identify(docs, model).select("doc_id", (langid.fold(F.col("doc_id")) == 2).alias("held_out"), "lang_pred", "score")


def op6_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "embeddings"), 0.95)


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.sql(f"SELECT -1L AS conv_id, turn, role, '{said}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.digests(chat.format_chats(rows))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents"), 200).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = warc.derivatives(warc.responses(table(spark, sf_dir, "pages")))
    return d.select("page_id", "warc_type", "record_id", "refers_to", "target_uri", "warc_date", "content_type", "block_digest", "payload_digest", "content_length", F.sha2(F.col("record").cast("binary"), 256).alias("record_sha256"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), TOKENIZER)


def op11_swap_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return swap_packing.pack_documents(table(spark, sf_dir, "documents"), TOKENIZER)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.detect_runs(table(spark, sf_dir, "documents"), turn=True, full=False)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), 4).withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard, op2_sharding, op3_mixing, op4_flac_media, op5_language_id, op6_embedding_near_duplicates, op7_chat_formatting, op8_suffix_dedup, op9_warc_derivatives, op10_packing, op11_swap_packing, op12_periodic_runs, op13_whitening)}

_UUID = "'<urn:uuid:' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] || '>'"


def _uuid_sql(text: str) -> str:
    return f"(SELECT {_UUID} FROM (SELECT md5({text}) AS h))"


def _plain_sql() -> str:
    """The text of a page in the steps of ``warc.plain_text``."""
    t = "regexp_replace(payload, '(?is)<!--.*?-->|<script\\b[^>]*>.*?</script\\s*>|<style\\b[^>]*>.*?</style\\s*>|<head\\b[^>]*>.*?</head\\s*>', ' ', 'g')"
    t = f"regexp_replace({t}, '(?i)<br\\s*/?>|</(?:p|div|li|ul|ol|h[1-6]|tr|table|article|section|nav|header|footer|title)\\s*>', chr(10), 'g')"
    t = f"regexp_replace({t}, '(?s)<[a-zA-Z/!][^>]*>', '', 'g')"
    found = "regexp_extract(x, '^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);', 1)"
    code = f"CASE WHEN {found}[2:2] IN ('x', 'X') THEN ('0x' || {found}[3:])::INT ELSE {found}[2:]::INT END"
    sound = f"({code} BETWEEN 1 AND 55295 OR {code} BETWEEN 57344 AND 1114111)"
    char = f"CASE WHEN {found} = '' THEN NULL WHEN {found}[1:1] = '#' THEN CASE WHEN {sound} THEN chr({code}) END ELSE names[{found}] END"
    t = f"array_to_string(list_transform(string_split({t}, '&'), lambda x, i: CASE WHEN i = 1 THEN x ELSE coalesce(({char}) || x[length({found}) + 2:], '&' || x) END), '')"
    t = f"regexp_replace(regexp_replace({t}, '[ \\t\\r]+', ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g')"
    return f"regexp_replace({t}, '^[ \\n]+|[ \\n]+$', '', 'g')"


_CRLF = "chr(13) || chr(10)"
_ENTITIES = "MAP {" + ", ".join(f"'{k}': '" + v.replace("'", "''") + "'" for k, v in warc.entities().items()) + "}"
ORACLE: dict[str, str] = {
    "op6_embedding_near_duplicates": """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
ok AS (SELECT * FROM v WHERE len(list_filter(x, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(x, lambda e: e <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id""",
    "op7_chat_formatting": f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
w AS (SELECT *, lag(role) OVER o IS DISTINCT FROM role AS first, lead(role) OVER o IS DISTINCT FROM role AS last, length(regexp_replace(text, '<(\\\\*)\\|', '<\\1\\\\|', 'g')) AS body, length(regexp_replace(role, '<(\\\\*)\\|', '<\\1\\\\|', 'g')) AS head FROM c WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text)),
s AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said, coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
 sum(body + CASE WHEN first THEN head + {len(chat.OPEN) + len(chat.BODY)} ELSE {len(chat.NEXT)} END + CASE WHEN last THEN {len(chat.CLOSE)} ELSE 0 END)::BIGINT AS formatted_chars FROM w GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM s""",
    "op9_warc_derivatives": f"""WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS payload, row_number() OVER (PARTITION BY page_id, coalesce(url, ''), coalesce(html, '')) - 1 AS k FROM pages),
t AS (SELECT p.*, {_ENTITIES} AS names, {_uuid_sql("'response' || chr(10) || coalesce(page_id::VARCHAR, '') || chr(10) || url || chr(10) || sha256(payload)")} AS own FROM p),
r AS (SELECT *, 'HTTP/1.1 200 OK' || {_CRLF} || 'Content-Type: text/html; charset=utf-8' || {_CRLF} || 'Content-Length: ' || strlen(payload) || {_CRLF} || {_CRLF} AS header, CASE WHEN k = 0 THEN own ELSE {_uuid_sql("own || chr(10) || k")} END AS rid, {_plain_sql()} AS plain FROM t),
i AS (SELECT *, {_uuid_sql("'metadata' || chr(10) || rid")} AS mid, {_uuid_sql("'conversion' || chr(10) || rid")} AS cid FROM r),
k AS (SELECT page_id, url, 'response' AS warc_type, rid AS record_id, NULL AS refers_to, 'application/http; msgtype=response' AS content_type, header || payload AS block, 'sha256:' || sha256(payload) AS payload_digest FROM i
 UNION ALL SELECT page_id, url, 'metadata', mid, rid, 'application/warc-fields', 'source-status: 200' || {_CRLF} || 'source-payload-digest: sha256:' || sha256(payload) || {_CRLF} || 'conversion-record-id: ' || cid || {_CRLF} || 'conversion-block-digest: sha256:' || sha256(plain) || {_CRLF} || 'source-content-type: text/html; charset=utf-8' || {_CRLF} || 'source-content-length: ' || strlen(payload) || {_CRLF}, NULL FROM i
 UNION ALL SELECT page_id, url, 'conversion', cid, rid, 'text/plain', plain, NULL FROM i),
d AS (SELECT *, 'sha256:' || sha256(block) AS block_digest, strlen(block) AS content_length FROM k)
SELECT page_id, warc_type, record_id, refers_to, url AS target_uri, '{warc.DATE}' AS warc_date, content_type, block_digest, payload_digest, content_length,
 sha256('WARC/1.1' || {_CRLF} || 'WARC-Type: ' || warc_type || {_CRLF} || 'WARC-Record-ID: ' || record_id || {_CRLF} || 'WARC-Date: {warc.DATE}' || {_CRLF} || coalesce('WARC-Refers-To: ' || refers_to || {_CRLF}, '') || 'WARC-Target-URI: ' || url || {_CRLF} || 'WARC-Block-Digest: ' || block_digest || {_CRLF} || coalesce('WARC-Payload-Digest: ' || payload_digest || {_CRLF}, '') || 'Content-Type: ' || content_type || {_CRLF} || 'Content-Length: ' || content_length || {_CRLF} || {_CRLF} || block || {_CRLF} || {_CRLF}) AS record_sha256 FROM d""",
}

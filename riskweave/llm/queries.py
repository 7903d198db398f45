"""Registered queries of the subpackage and, where SQL can say it, the same
result as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm import ann, chat
from riskweave.llm import exact_dedup as dedup
from riskweave.llm import hard_negatives, langid, ngram_join, packing, piece_codec, pii, quality, urlfilter, vector_codes, warc
from riskweave.llm.frames import stored, table
from riskweave.session import scratch_path


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.fit_on(docs))
    return found.withColumn("held_out", langid.remainder(3) == 1).select(
        "doc_id", "held_out", "lang_pred", "score", "bits_per_byte")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.find(docs, pii.train_on(docs))


# Rules of the query: (verdict, host, path).
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
             ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), urlfilter.Filter(URL_RULES))


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies; the same on all executors."""
    import public_tokenizers
    return public_tokenizers.path(name)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_copies")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id bigint, turn bigint, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digest_conversations(chat.format_turns(turns))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup.exact_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.digest_documents(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(50)) == 0)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = quality.fit_on(docs, table(spark, sf_dir, "labels"), langid.remainder(5) != 0)
    return quality.score(docs, machine).select(
        "doc_id", (langid.remainder(5) == 0).alias("held_out"), "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write_archive(table(spark, sf_dir, "pages"), scratch_path(spark, "archive"))
    records, _ = stored(warc.read_archive(spark, path, with_payload=False).drop("payload"), "warc-records")
    return warc.resolved(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.report(*vector_codes.compress(table(spark, sf_dir, "embeddings")))


OP7_SQL = """
WITH low AS (
    SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
    FROM documents
)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(norm) AS text_sha256
FROM low WINDOW same AS (PARTITION BY norm)
"""

def _terms(terms: tuple) -> str:
    """Weighted sum over the distinct terms between boundaries, as SQL."""
    bounded = r"(^|[^\p{L}\p{N}])%s([^\p{L}\p{N}]|$)"
    return " + ".join(f"regexp_matches(low, '{bounded % t}')::INT" for t in terms)


OP3_SQL = f"""
WITH rest AS (
    SELECT page_id, lower(coalesce(url, '')) AS low,
           CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
    FROM pages
), cut AS (
    SELECT page_id, low, regexp_extract(rest, '^[^/?#]*') AS raw_host,
           regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
    FROM rest
), named AS (
    SELECT page_id, low, path, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           {_terms(urlfilter.STRICT_TERMS)} AS strict_hits, {_terms(urlfilter.SOFT_TERMS)} AS soft_hits
    FROM cut
), rules(verdict, rule_host, rule_path) AS (
    VALUES {", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)}
), fit AS (
    SELECT page_id, host, path, strict_hits, soft_hits, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
           arg_max(verdict, length(rule_host || rule_path)) AS verdict
    FROM named LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
    GROUP BY ALL
)
SELECT page_id, host, path, rule, strict_hits::INT AS strict_hits, soft_hits::INT AS soft_hits,
       coalesce(verdict, CASE WHEN strict_hits >= 1 OR soft_hits >= 2 THEN 'block' ELSE 'allow' END) AS verdict
FROM fit
"""

OP6_SQL = r"""
WITH rows AS (
    SELECT conv_id, turn, role, text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM rows
), marked AS (
    SELECT *, CASE role WHEN 'user' THEN ' [/INST]' WHEN 'assistant' THEN ' </s>'
                        WHEN 'system' THEN chr(10) || '<</SYS>>' || chr(10) ELSE ' [/ROLE]' END AS closing,
           CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 6 WHEN 'system' THEN 18
                     ELSE 16 + length(regexp_replace(role, '(\\|\])', '\\\1', 'g')) END AS marks
    FROM turns
), sized AS (
    SELECT *, marks + CASE WHEN contains(text || left(closing, length(closing) - 1), closing) OR regexp_matches(text, '(?s)\\.')
                           THEN length(regexp_replace(text, '(\\|\[/?INST\]|\[/?ROLE|</?s>|<</?SYS>>)', '\\\1', 'g'))
                           ELSE length(text) END AS chars
    FROM marked
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
""".replace("\\", "\\")

SOUND = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

OP11_SQL = f"""
WITH kept AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings WHERE label IS NOT NULL AND {SOUND}
), scored AS (
    SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_inner_product(a.v, r.v)::BIGINT AS score
    FROM kept a JOIN kept r ON r.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER first::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW first AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER first <= 5
"""

OP12_SQL = """
WITH records AS (
    SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), kept AS (
    SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS keeper FROM records
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM kept
"""


def _lloyd_sql() -> str:
    """The rounds written out as one table of entries and one of assignments each."""
    square = "list_inner_product({0}, {0})"
    steps = [f"""kept AS MATERIALIZED (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)) AS v, len(embedding) // 8 AS w
    FROM embeddings WHERE {SOUND}
), parts AS MATERIALIZED (
    SELECT vec_id, label, p, v[p * w + 1:p * w + w] AS part FROM kept, range(8) AS positions(p)
), entries0 AS MATERIALIZED (
    SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS entry, part AS mean FROM parts
    QUALIFY row_number() OVER (PARTITION BY p ORDER BY vec_id) <= 16
)"""]
    for k in range(7):
        steps.append(f"""assigned{k} AS MATERIALIZED (
    SELECT vec_id, any_value(label) AS label, p, any_value(part) AS part, min(struct_pack(d := d, entry := entry)) AS best
    FROM (SELECT vec_id, label, p, part, entry, {square.format("part")} - 2 * list_inner_product(part, mean) + {square.format("mean")} AS d
          FROM parts JOIN entries{k} USING (p)) compared GROUP BY vec_id, p
)""")
        if k < 6:
            steps.append(f"""sums{k} AS (
    SELECT p, entry, list(mean ORDER BY place) AS mean FROM (
        SELECT p, best.entry AS entry, place, floor(sum(part[place]) / count(*)) AS mean
        FROM assigned{k}, unnest(range(1, len(part) + 1)) AS places(place) GROUP BY ALL) means GROUP BY p, entry
), entries{k + 1} AS MATERIALIZED (
    SELECT p, entry, coalesce(n.mean, o.mean) AS mean FROM entries{k} o LEFT JOIN sums{k} n USING (p, entry)
)""")
    return "WITH " + ", ".join(steps) + """, coded AS (
    SELECT vec_id, any_value(label) AS label, string_agg(format('{:02x}', best.entry), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error
    FROM assigned6 GROUP BY vec_id
), books AS (
    SELECT sha256(string_agg(array_to_string(list_transform(mean, lambda x: x::BIGINT::VARCHAR), ','), ',' ORDER BY p, entry)) AS codebooks_sha256
    FROM entries6
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded, books
"""


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_pii": op2_pii,
    "op3_url_filter": op3_url_filter,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_ngram_join": op5_ngram_join,
    "op6_chat_format": op6_chat_format,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_nearest": op9_nearest,
    "op10_quality": op10_quality,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_warc": op12_warc,
    "op13_vector_codes": op13_vector_codes,
}

ORACLE = {
    "op3_url_filter": OP3_SQL,
    "op6_chat_format": OP6_SQL,
    "op7_exact_dedup": OP7_SQL,
    "op11_hard_negatives": OP11_SQL,
    "op12_warc": OP12_SQL,
    "op13_vector_codes": _lloyd_sql(),
}

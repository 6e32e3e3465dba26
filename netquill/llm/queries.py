"""The queries of this subpackage, with the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, filter_audit, fingerprints, language_id, mil_quality, packing, quality_rules, sharding, simhash, suffix_dedup, toxicity, whitening
from ._common import crc_mod
from .training import learn_rows

#: The tokenizer file of op8, found through the package that ships the vocabularies.
TOKENIZER = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    return got.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept_bytes", 256).alias("kept_sha256"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = sharding.assign_shards(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judged(mil_quality.score_quality(docs, mil_quality.fit_quality(docs, quality_labels(spark, sf_dir)), ["doc_id"]), 5, 0)


def quality_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where(learn_rows(5, 0)).select("doc_id", F.col("quality").alias("label"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    texts, held_out = docs.select("doc_id", "text"), crc_mod(F.col("doc_id"), 4) == 2
    model = language_id.fit_languages(texts, docs.where(learn_rows(4, 2)).select("doc_id", "lang"))
    return language_id.identify(texts, model, ["doc_id"]).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.exact_groups(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labelled = table(spark, sf_dir, "labels").where(learn_rows(4, 2)).select("doc_id", F.col("toxic").alias("label"))
    return judged(toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labelled), ["doc_id"]), 4, 2)


def judged(scored: DataFrame, modulus: int, held_out: int) -> DataFrame:
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), modulus) == held_out).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = bpe.encode_decode(docs, public_tokenizers.path(TOKENIZER), keep=["doc_id"])
    return got.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"), keep=["doc_id"]).select("doc_id", "fingerprint", "component_id")


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))
    digests = {c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_sha256", "edited_fingerprint")}
    return got.withColumns(digests).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_sharding": op2_sharding,
    "op3_quality_rules": op3_quality_rules,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_language_id": op5_language_id,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_bpe": op8_bpe,
    "op9_packing": op9_packing,
    "op10_simhash": op10_simhash,
    "op11_fingerprints": op11_fingerprints,
    "op12_whitening": op12_whitening,
    "op13_filter_audit": op13_filter_audit,
}

EXACT_SQL = r"""
WITH d AS (
    SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256, row_number() OVER () AS rid
    FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, row_number() OVER w = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id, rid)
"""

#: CRC-32 (polynomial 0xEDB88320) byte by byte from a table made by its rule.
SHARDING_SQL = r"""
WITH RECURSIVE bits(b, v, i) AS (
    SELECT range, range::BIGINT, 0 FROM range(256)
    UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, i + 1 FROM bits WHERE i < 8),
crc AS (SELECT list(v ORDER BY b) AS t FROM bits WHERE i = 8),
d AS (SELECT doc_id, source, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (
    SELECT doc_id, coalesce('+' || source, '-') AS stratum, (length(h) // 2 + 16)::BIGINT AS size,
        xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::BIGINT, 2))::BIGINT)),
            lambda a, b: xor(a >> 8, t[xor(a, b) % 256 + 1])), 4294967295::BIGINT) AS text_crc32
    FROM d, crc),
k AS (SELECT *, ('0x' || substr(md5(concat_ws(':', '17', coalesce(doc_id::VARCHAR, ''), text_crc32::VARCHAR)), 1, 15))::BIGINT AS u, count(*) OVER () AS total FROM c),
b AS (SELECT *, greatest(1, ceil(total / 4096))::BIGINT AS buckets FROM k),
f AS (SELECT *, (row_number() OVER (PARTITION BY stratum ORDER BY (u >> 20) % buckets, u, doc_id, text_crc32, size) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY stratum) AS fraction FROM b),
p AS (SELECT *, row_number() OVER (ORDER BY floor(fraction * buckets), fraction, stratum, u, doc_id, text_crc32, size) - 1 AS pos, total // 40 AS q, total % 40 AS r FROM f),
s AS (SELECT *, CASE WHEN pos < r * (q + 1) THEN pos // (q + 1) ELSE r + (pos - r * (q + 1)) // greatest(q, 1) END AS shard FROM p)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard::INTEGER AS shard, (pos - CASE WHEN shard < r THEN shard * (q + 1) ELSE r * (q + 1) + (shard - r) * q END)::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM s
"""

SQL: dict[str, str] = {"op2_sharding": SHARDING_SQL, "op3_quality_rules": quality_rules.rules_sql(), "op6_exact_dedup": EXACT_SQL, "op13_filter_audit": filter_audit.audit_sql()}

"""The queries of this subpackage: each applies one operator to its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import darts, decontaminate, langid, lines, mixing, passages, quality, sharding, toxicity, urls
from tessera.llm.common import held_out, kept, read, words

SHARDS = 16


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels").select("doc_id", "toxic"))
    out = toxicity.score(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op2_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = darts.classes(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "class_id")


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"))
    docs = kept(docs, "sizes")  # so texts are read once
    targets = mixing.source_targets(docs, "source", "size")
    out = mixing.with_copies(docs, "doc_id", "source", targets)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, "page_id", "url", urls.fit(urls.rule_labels(pages, "url"), "url", "y"))


def op5_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.report(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = read(spark, sf_dir, "documents").select("doc_id", (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    docs = sharding.assign_shards(docs, "doc_id", [1.0] * SHARDS)
    docs = docs.withColumn("grown_shard", sharding.place(F.col("doc_id"), [1.0] * (SHARDS + 1)))
    out = sharding.number_slots(docs, "doc_id", "shard", ["doc_id", "size", "text_crc32", "shard", "grown_shard"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = decontaminate.hashed(read(spark, sf_dir, "documents"), "doc_id", "text")
    return decontaminate.search(table, decontaminate.build(spark, table, read(spark, sf_dir, "benchmark")))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = langid.predict(docs.select("doc_id", "text"), langid.fit(docs.where(~held_out(F.col("doc_id")))))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality.fit(docs, read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "text", "quality")
    return quality.judge(docs, "doc_id", "text", rules)


def op10_near_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_report(read(spark, sf_dir, "documents").select("doc_id", "text"), exact_words=1)


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_dart_minhash, op3_source_mix, op4_url_filter, op5_paragraph_dedup, op6_rendezvous_shards, op7_decontaminate, op8_language, op9_quality_rules, op10_near_line_dedup)}
ORACLES = {
    "op3_source_mix": r"""
        WITH d AS (SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size,
          (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS u FROM documents),
        p AS (SELECT source, sum(size)::BIGINT AS s FROM d GROUP BY source),
        w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM p),
        l AS (SELECT *, (sum(s) OVER () - coalesce(sum(3 * s) OVER o, 0))::BIGINT / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0))::BIGINT AS level FROM w
          WINDOW o AS (ORDER BY 3 * s / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        t AS (SELECT *, max(CASE WHEN 3 * s > level * weight THEN level END) OVER () AS top FROM l),
        g AS (SELECT source, s, least(3 * s, coalesce(top * weight, 3 * s))::DOUBLE AS target FROM t),
        r AS (SELECT source, s, target, CASE WHEN s > 0 THEN least(target / s, 3.0) ELSE 0.0 END AS rate FROM g)
        SELECT doc_id, size, s AS source_size, target, (size * (floor(rate) + (u < rate - floor(rate))::INT))::BIGINT AS taken, d.source AS source, (floor(rate) + (u < rate - floor(rate))::INT)::INT AS copies
        FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source""",
}

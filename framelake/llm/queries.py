"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, exact_dedup, filter_audit, language_id, mixing, near_dedup, packing, pii, quality_classifier, quality_rules, secret_scan, sharding, warc
from .common import documents

#: Only a stand-in: a real deployment passes its own secret.
PSEUDONYM_SECRET = "rotate-me"


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(documents(spark, sf_dir))
    base = [r.kind for r in secret_scan.BASE_RULES]

    def shown(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def number(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    based = shown(F.filter("spans", lambda s: s["kind"].isin(*base)))
    return found.select("doc_id", *map(number, base), F.sha2(based, 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(documents(spark, sf_dir), labels(spark, sf_dir).where("quality = 1"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(documents(spark, sf_dir))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document (page_id null) and per page (doc_id null)."""
    docs, pages = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/pages.parquet")
    model = language_id.TextModel.learn(docs, "lang", "doc_id", "text")
    rows = language_id.document_rows(docs).unionByName(language_id.page_rows(pages), allowMissingColumns=True)
    return language_id.identify(rows, model).withColumnRenamed("accepted", "kept")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality_classifier(documents(spark, sf_dir), labels(spark, sf_dir))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(documents(spark, sf_dir), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(documents(spark, sf_dir).select("doc_id", "text"), PSEUDONYM_SECRET)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir), labels(spark, sf_dir))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to archives and read back, with their places in the order of (URL key, time)."""
    index = warc.archived(warc.page_captures(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    number = lambda c: F.expr(f"try_cast({c} AS long)")
    return index.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"), "url_key", "position")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.link_counts(documents(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (op1_secret_scan, op2_exact_dedup, op3_quality_rules, op4_near_dedup, op5_language_id, op6_quality_classifier, op7_sharding, op8_packing, op9_pii, op10_mixing, op11_filter_audit, op12_warc, op13_alignment, pipeline)
}

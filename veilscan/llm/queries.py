"""The queries of this subpackage, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import find

    return find(spread(table(spark, sf_dir, "findings").select("finding_id", "context", "matched_text")), "finding_id", "context", "matched_text").select("finding_id", "secret").distinct()


def p1_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import redact

    return redact(spread(table(spark, sf_dir, "findings").select("finding_id", "context", "matched_text")), "finding_id", "context", "matched_text").where("n_secrets > 0")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .history import repeated_findings

    return repeated_findings(table(spark, sf_dir, "findings"))


def _scanned_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of extracted, each a scope of its own, and pages of image_results, whose scope is their directory."""
    a = table(spark, sf_dir, "extracted").select(F.lit("extracted").alias("source_table"), F.col("content_id").alias("record_id"), F.concat(F.lit("text:"), F.col("content_id")).alias("scope"), F.lit(False).alias("page"), "text")
    directory = F.regexp_extract(F.coalesce("file_path", F.lit("")), "^(.*)/[^/]*$", 1)
    b = table(spark, sf_dir, "image_results").select(F.lit("image_results").alias("source_table"), F.col("image_id").alias("record_id"), F.concat(F.lit("scan:"), directory).alias("scope"), F.lit(True).alias("page"), F.col("extracted_text").alias("text"))
    return spread(a.unionByName(b))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .scanned import noise

    return noise(_scanned_texts(spark, sf_dir))


def p3_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .scanned import reflowed

    return reflowed(_scanned_texts(spark, sf_dir))


def _personal_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    extracted = table(spark, sf_dir, "extracted").select(F.lit("extracted").alias("source_table"), F.col("content_id").alias("record_id"), "text")
    return spread(extracted.unionByName(table(spark, sf_dir, "findings").select(F.lit("findings").alias("source_table"), F.col("finding_id").alias("record_id"), F.col("context").alias("text"))))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import document_number, find, lexicon_of

    found = find(_personal_texts(spark, sf_dir), lexicon_of(table(spark, sf_dir, "name_lexicon")))
    numbers = table(spark, sf_dir, "parsed_mrz").select(F.lit("parsed_mrz").alias("source_table"), F.col("mrz_id").alias("record_id"), F.lit("identity_number").alias("pii_kind"), document_number(F.col("document_number")).alias("pii_value"))
    return found.select("source_table", "record_id", "pii_kind", "pii_value").unionByName(numbers.where(F.col("pii_value").isNotNull())).distinct()


def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import document_number, lexicon_of, redact

    redacted = redact(_personal_texts(spark, sf_dir), lexicon_of(table(spark, sf_dir, "name_lexicon")))
    number = F.col("document_number")
    documents = table(spark, sf_dir, "parsed_mrz").select(F.lit("parsed_mrz").alias("source_table"), F.col("mrz_id").alias("record_id"), F.when(document_number(number).isNotNull(), "[IDENTITY_NUMBER]").otherwise(number).alias("redacted"))
    return redacted.unionByName(documents)


def _decoded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of extracted and contexts of findings with their pool: the field and the format of the file."""
    extracted, findings = table(spark, sf_dir, "extracted"), table(spark, sf_dir, "findings")
    ending = F.regexp_extract(F.lower("file_path"), r"\.([a-z0-9]{1,10})(?: \([^()]*\))?\s*$", 1)
    a = extracted.select(F.struct(F.lit("extracted").alias("source_table"), F.col("content_id").alias("record_id")).alias("id"), F.concat(F.lit("text/"), F.lower("file_format")).alias("pool"), "text")
    b = findings.select(F.struct(F.lit("findings").alias("source_table"), F.col("finding_id").alias("record_id")).alias("id"), F.concat(F.lit("context/"), ending).alias("pool"), F.col("context").alias("text"))
    return spread(a.unionByName(b)).select(F.to_json("id").alias("id"), "pool", "text")


def p5_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mojibake import damaged

    parsed = F.from_json("id", "source_table string, record_id long")
    return damaged(_decoded_texts(spark, sf_dir)).withColumn("id", parsed).select("id.source_table", "id.record_id", "chain", F.when(F.col("chain").isNotNull(), F.col("repaired")).alias("repaired"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_repaired(spark, sf_dir).select("source_table", "record_id").distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topn import top_n_by_group

    return top_n_by_group(table(spark, sf_dir, "findings"), "file_path", "risk_score", "finding_id", 3, least=0, most=100).select("file_path", "finding_id")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokenize import encode

    return encode(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text")


def p8_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .leakage import leaks

    return leaks(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_aligned(spark, sf_dir).select("doc_id", "item_id").distinct()


def p9_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repetition import repetition

    return repetition(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_repetition(spark, sf_dir).where("share >= 0.4").select("doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_redacted, p2_found, p3_found, p3_text, p4_found, p4_redacted, p5_found, p5_repaired, p6_found, p7_ids, p8_found, p8_aligned, p9_found, p9_repetition)}

ORACLE: dict[str, str] = {
    "p6_found": """
        SELECT file_path, finding_id
        FROM (SELECT file_path, finding_id,
                     row_number() OVER (PARTITION BY file_path ORDER BY risk_score DESC, finding_id) AS k
              FROM findings
              WHERE file_path IS NOT NULL AND risk_score IS NOT NULL AND NOT isnan(risk_score)
                AND risk_score BETWEEN 0 AND 100)
        WHERE k <= 3""",
}

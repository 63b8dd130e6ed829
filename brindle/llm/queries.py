"""One query per training-data operator, over its whole table with production parameters, and SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import table
from brindle.llm.decontaminate import decontaminate
from brindle.llm.html_text import extract_main_text
from brindle.llm.jaccard_join import ngram_jaccard_join
from brindle.llm.language_id import fit, identify_language
from brindle.llm.licenses import license_scan
from brindle.llm.line_dedup import line_dedup
from brindle.llm.packing import pack
from brindle.llm.pii import find_pii
from brindle.llm.quality import quality_rules
from brindle.llm.warc_audit import fixity_audit, warc_digests, warc_records


def op1_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents"), width=4, percent=85)


def op3_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op5_warc_fixity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits a replica with planted damage: by the hash of their digests, 1 in 16 records has its first byte altered and 1 in
    16 can't be read. The replica's digests are taken from its own bytes."""
    a = warc_records(table(spark, sf_dir, "pages"), body=True)
    mark = F.substring("digest", 1, 1)
    bytes_of_b = F.when(mark == "0", F.concat(F.lit("~"), F.substring("record", 2, 2**31 - 1))).otherwise(F.col("record"))
    b = a.filter(mark != "1").withColumn("record", bytes_of_b)
    return fixity_audit(a, warc_digests(b))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", "removed", F.length("text").cast("long").alias("n_chars_kept"), F.sha2("text", 256).alias("text_sha256"))


def op8_crf_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False)))
    return identify_language(docs, fit(docs.filter("NOT held_out")))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_pii_bootstrap,
        op2_ngram_jaccard_join,
        op3_html_main_text,
        op4_license_scan,
        op5_warc_fixity_audit,
        op6_benchmark_decontamination,
        op7_line_dedup,
        op8_crf_language_id,
        op9_best_fit_packing,
        op10_quality_rules,
    )
}
#: Of the ten, the audit's outcome can be told by SQL; the others are tested against brute force in tests/llm.
ORACLES: dict[str, str] = {
    "op5_warc_fixity_audit": """
WITH r AS (
  SELECT page_id,
         'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
         || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, ''))
         || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record
  FROM pages),
d AS (SELECT page_id, strlen(record) AS length, sha256(record) AS digest, sha256('~' || substr(record, 2)) AS altered FROM r),
p AS (SELECT *, coalesce(page_id // 1000, -1 - CAST('0x' || substr(digest, 1, 4) AS BIGINT)) AS archive FROM d),
o AS (SELECT archive, digest, altered, CAST(coalesce(sum(length) OVER (PARTITION BY archive ORDER BY page_id NULLS FIRST, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM p)
SELECT archive, "offset", CASE WHEN digest LIKE '1%' THEN 'missing' ELSE 'corrupt' END AS status, digest AS digest_a,
       CASE WHEN digest LIKE '1%' THEN '' ELSE altered END AS digest_b
FROM o WHERE digest LIKE '0%' OR digest LIKE '1%'
""",
}

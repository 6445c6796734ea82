"""The registered queries of the text operators, over the whole tables, and their SQL."""

from __future__ import annotations

import os
from zlib import crc32

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm import (
    alignment,
    archive,
    classlm,
    decontamination,
    language,
    neardup,
    periodic,
    personal,
    pieces,
    repetition,
    units,
    weaklabels,
    wordpiece,
)
from tillroll.session import apply_runtime_settings, run_folder

PACKAGE_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepared(spark: SparkSession) -> SparkSession:
    """The session with skewed joins split, whose Python workers find this package where the driver found it."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", PACKAGE_ROOT)
    return apply_runtime_settings(spark)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{folder}/{name}.parquet")


def op1_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.benchmark_matches(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op2_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return weaklabels.quality(table(spark, folder, "documents"))


def op3_warc_archive(spark: SparkSession, folder: str) -> DataFrame:
    """Every page archived, and its record read back."""
    pages = table(spark, folder, "pages")
    target = run_folder(spark, "archive")
    archive.write_archive(pages, target)
    records = archive.read_records(spark, target, pages.schema["page_id"].dataType.simpleString())
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return repetition.quality_measures(table(spark, folder, "documents"))


def op5_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return personal.personal_spans(table(spark, folder, "documents"))


def op6_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of repeated sentences; lines and paragraphs are the other units."""
    return units.without_repeats(
        table(spark, folder, "documents"),
        unit="sentence",
        least_words=units.SENTENCE_WORDS,
        run_words=units.RUN_WORDS,
    )


def op7_class_model(spark: SparkSession, folder: str) -> DataFrame:
    return classlm.corpus_scores(table(spark, folder, "documents"))


def op8_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    groups = neardup.near_groups(table(spark, folder, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return wordpiece.token_counts(table(spark, folder, "documents"))


def op10_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every text, and the digest of the text that decoding gives back."""
    return coded_and_decoded(table(spark, folder, "documents"))


def coded_and_decoded(docs: DataFrame) -> DataFrame:
    return pieces.encode(docs).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded_sha256")


def op11_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = language.fit(docs, learn_from=F.coalesce(~held_out, F.lit(True)))
    return language.predict(docs, model).withColumn("held_out", F.coalesce(held_out, F.lit(False)))


def op12_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.token_alignment(table(spark, folder, "documents"))


def repeating(doc_id: object, words: list[bytes]) -> list[bytes]:
    """The words of a document, of every tenth id by its checksum made to repeat from some word on."""
    checksum = crc32(str(doc_id).encode())
    n, g = len(words), checksum // 10
    if doc_id is None or checksum % 10 or not n:
        return words
    start = g % n
    period = 1 + (n - start) // (3 + g % 8)
    return words[:start] + [words[start + i % period] for i in range(n - start)]


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic.periodic_runs(table(spark, folder, "documents"), rewrite=repeating)
    best = periodic.strongest("runs")
    lines = F.transform("runs", lambda run: F.concat_ws(",", run["start"], run["length"], run["period"]))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform(lines, lambda line: F.concat(line, F.lit("\n")))), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_warc_archive": op3_warc_archive,
    "op4_quality_rules": op4_quality_rules,
    "op5_personal_data": op5_personal_data,
    "op6_line_dedup": op6_line_dedup,
    "op7_class_model": op7_class_model,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_language_id": op11_language_id,
    "op12_tokenizer_alignment": op12_tokenizer_alignment,
    "op13_periodic_runs": op13_periodic_runs,
}

# Five hexadecimal digits of the digest make four characters of base 32.
WARC_SQL = """
WITH bodies AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
digests AS (
  SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha1(body) AS hex,
         max(page_id) OVER (PARTITION BY body) AS owner
  FROM bodies
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
    (CAST('0x' || substr(hex, 1 + 5 * CAST(i // 4 AS INTEGER), 5) AS INTEGER) >> (15 - 5 * CAST(i % 4 AS INTEGER))) & 31
  AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> owner THEN owner END AS refers_to
FROM digests
"""

SENTENCES_SQL = r"""
WITH sentences AS (
  SELECT doc_id, text, unnest(found) AS sentence, generate_subscripts(found, 1) AS spot
  FROM (SELECT doc_id, text, regexp_extract_all(text, '[^.!?\n]*[.!?\n]+[\x20\x09-\x0D]*|[^.!?\n]+') AS found
        FROM documents WHERE text IS NOT NULL)
),
placed AS (
  SELECT *, CAST(sum(length(sentence)) OVER (PARTITION BY doc_id ORDER BY spot) AS BIGINT) AS stop,
         regexp_extract_all(translate(sentence, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM sentences
),
numbered AS (
  SELECT doc_id, stop - length(sentence) AS start, stop, len(words) AS n_words,
         row_number() OVER (PARTITION BY doc_id ORDER BY spot) AS place,
         row_number() OVER (PARTITION BY array_to_string(words, ' ') ORDER BY doc_id, spot) AS nth
  FROM placed WHERE len(words) >= 3
),
repeats AS (SELECT *, place - row_number() OVER (PARTITION BY doc_id ORDER BY place) AS run FROM numbered WHERE nth > 1),
runs AS (
  SELECT doc_id, min(start) AS start, max(stop) AS stop FROM repeats GROUP BY doc_id, run HAVING sum(n_words) >= 30
),
gaps AS (
  SELECT *, coalesce(lag(stop) OVER (PARTITION BY doc_id ORDER BY start), 0) AS before FROM runs
),
kept AS (
  SELECT g.doc_id,
    string_agg(substr(d.text, CAST(before + 1 AS BIGINT), CAST(start - before AS BIGINT)), '' ORDER BY start) AS head,
    max(stop) AS last,
    string_agg(start || ':' || stop, ',' ORDER BY start) AS removed, count(*) AS n_removed
  FROM gaps g JOIN documents d ON d.doc_id = g.doc_id GROUP BY g.doc_id
)
SELECT d.doc_id, CASE WHEN k.doc_id IS NULL THEN d.text ELSE k.head || substr(d.text, CAST(k.last + 1 AS BIGINT)) END AS text,
       coalesce(k.removed, '') AS removed, coalesce(k.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""

ORACLES = {"op3_warc_archive": WARC_SQL, "op6_line_dedup": SENTENCES_SQL}

"""The queries of the corpus operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import bpe, decontaminate, exact, html, licenses, phrases, quality, simhash, spelling, tokenfiles, toxicity, warc
from tablewright.llm.common import held_out


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = tokenfiles.write_coded(_table(spark, sf_dir, "documents"), tokenizer())
    return tokenfiles.read_coded(spark, manifest)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    rules = quality.fit(documents, _table(spark, sf_dir, "labels"))
    return quality.apply(documents, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    model = toxicity.fit(documents, _table(spark, sf_dir, "labels"))
    return toxicity.score(documents, model).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS n, sha1(html) AS d FROM p),
m AS (SELECT d, max(page_id) AS last FROM q WHERE n >= 1000 GROUP BY d)
SELECT page_id, n AS payload_bytes, q.d AS payload_digest,
       CASE WHEN m.last > page_id AND n >= 1000 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN m.last > page_id AND n >= 1000 THEN m.last END AS refers_to
FROM q LEFT JOIN m ON m.d = q.d
"""


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), tokenizer())


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer()
    separator = len(bpe.Coder.of(path).bytes_of)
    manifest = tokenfiles.write_flat(_table(spark, sf_dir, "documents"), path, separator)
    return tokenfiles.counts(manifest, separator)


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_copies(_table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(_table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_token_files, op2_simhash, op3_quality_rules, op4_toxicity, op5_warc, op6_bpe, op7_decontamination, op8_token_counts, op9_html, op10_licenses, op11_exact_dedup, op12_spelling_variants, op13_collocations)
}

ORACLES: dict[str, str] = {"op5_warc": OP5_SQL, "op10_licenses": licenses.oracle(), "op11_exact_dedup": exact.ORACLE, "op13_collocations": phrases.ORACLE}

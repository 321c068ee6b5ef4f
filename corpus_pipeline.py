"""A corpus pipeline of five stages; each takes (spark, docs, sf_dir) and is written and read again
before the next. All stages but the last return the columns of documents.

toxicity        documents predicted toxic go
quality rules   documents that fail the base rules or a learned rule go
simhash         of each group of near copies (Jaccard 0.8 or more on five words) the row with the least id stays
decontaminate   documents with a benchmark passage go
bpe             n_tokens and digests of what is left
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import bpe, decontaminate, quality, simhash, toxicity
from tablewright.llm.common import new_folder
from tablewright.llm.registry import tokenizer

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, keep=COLUMNS).where("predicted = 0").select(*COLUMNS)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rules = quality.fit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return quality.apply(docs, rules, keep=COLUMNS).where("kept").select(*COLUMNS)


def _keyed(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows with a key of their own, read from files, so that it's the same at each reading."""
    docs.withColumn("_key", F.monotonically_increasing_id()).write.parquet(path := new_folder(spark, "keyed"))
    return spark.read.parquet(path)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of copies, which share 0.8 or more of their runs of five words, stays:
    that with the least id, a null one last; of rows that share the id, the first."""
    docs = _keyed(spark, docs)
    groups = docs.select("_key", "doc_id").join(simhash.near_copies(docs, "_key"), "_key")
    stay = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_key")).alias("first")).select("first._key")
    return docs.join(stay, "_key", "left_semi").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = _keyed(spark, docs)
    found = decontaminate.contamination(docs, _table(spark, sf_dir, "benchmark"), doc_id="_key")
    return docs.join(found.where("contaminated").select("_key"), "_key", "left_anti").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs, tokenizer())


STAGES = [("toxicity", drop_toxic), ("quality rules", drop_low_quality), ("simhash near-dedup", drop_near_copies), ("benchmark decontamination", drop_contaminated), ("bpe encoding and decoding", encode)]

#: No SQL for trained models, XXH64 and BPE: tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            assert tuple(out.columns) == COLUMNS
        out.write.parquet(path := new_folder(spark, f"stage{k}"))
        docs = spark.read.parquet(path)
    return docs.select(F.col("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")

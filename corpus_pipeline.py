"""The corpus pipeline: quality, repeated lines, near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all the stage before it kept; all but the last return the
columns of documents, with the decisions carried out. `run` applies them to the documents table; between two
stages the rows are written to the shared folder and read again.

Defined results, of every stage: an empty table gives an empty table; columns besides doc_id and text pass through,
whatever their names (n_chars is counted anew where texts change). Null and empty texts are rejected by the first
stage, since they have no words; later stages keep them as they are. Rows with a null id are never dropped, since no
verdict names them. Of rows that share an id, one stage's verdict on the id counts for all, but for near duplicates,
which are told apart by their texts: one row of equal ones stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import jaccard_join, line_dedup, packing, quality_classifier, secrets
from tracewright.llm.common import materialize
from tracewright.llm.queries import table, tokenizer_file


def _recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def _chosen(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Rows of docs whose id is not among the rejected; rows with a null id stay."""
    rejected = verdicts.where("not kept").select(F.col("doc_id").alias("_rejected")).distinct()
    return docs.join(rejected, F.col("doc_id") == F.col("_rejected"), "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return _chosen(docs, quality_classifier.classify(docs, table(spark, sf_dir, "labels")))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later places of three-line windows are cut out of the texts."""
    return _recounted(line_dedup.line_dedup(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row with the smallest id of each group of near copies stays."""
    verdicts, _ = materialize(jaccard_join.jaccard_join(docs, keyed=True), "near")
    ids = verdicts.where("doc_id is not null").groupBy("doc_id").agg(F.bool_or("kept").alias("any"), F.bool_and("kept").alias("all")).withColumnRenamed("doc_id", "_id")
    rejected, _ = materialize(ids.where("not all").select("_id", "any"), "rejected")
    # only rows in a bucket of some rejected id are shuffled; at most FILTER rows are broadcast
    bucket = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(jaccard_join.FILTER))
    met = F.broadcast(rejected.select(bucket("_id").alias("_bucket")).distinct())
    same, near = F.col("doc_id") == F.col("_id"), bucket("doc_id") == F.col("_bucket")
    whole = docs.join(met, near, "left_anti").unionByName(docs.join(met, near, "left_semi").join(rejected, same, "left_anti"))
    # ids with kept and rejected rows: repeated rows, or several texts under one id
    twice = rejected.where("any")
    met = F.broadcast(twice.select(bucket("_id").alias("_bucket")).distinct())
    mixed = docs.join(met, near, "left_semi").join(twice, same, "left_semi").withColumn("_key", jaccard_join.text_key(F.coalesce("text", F.lit(""))))
    kept = verdicts.where("kept").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_k")).distinct()
    mixed = mixed.join(kept, same & (F.col("_key") == F.col("_k")), "left_semi").dropDuplicates(["doc_id", "_key"]).drop("_key")
    return whole.unionByName(mixed)


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts give way to marks."""
    return _recounted(secrets.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and place."""
    return packing.best_fit_pack(docs, tokenizer_file("byte_bpe_50k.json"), tokenizer_file("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", repeated_lines),
    ("ngram_jaccard_join", near_duplicates),
    ("secret_scans", secret_spans),
    ("best_fit_packing", pack),
]

#: SQL can't express the classifier, MinHash pruning, the scanner or the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

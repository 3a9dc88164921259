"""A corpus pipeline of five stages, each one operator of graphloom.llm.

Every stage works on all documents that its predecessor kept, and all but the
last return the columns of ``documents``.

Defined results, for every stage: a null text is a document without words and
without lines, which no stage but the first can reject; rows with a null id are
documents of their own; repeated rows have one fate, but of rows equal in id and
text the third stage keeps one; an empty table passes as an empty table; further
columns pass all stages but the last unchanged, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bpe, cotrain, decontaminate, jaccard_join, line_dedup
from graphloom.llm.ship import ship
from graphloom.llm.store import cut

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier does not reject; it learns from the labels of documents that are still there."""
    ship(spark)
    model = cotrain.fit(docs, _table(spark, sf_dir, "labels"))
    return cotrain.score(docs, model).where("kept").select(*docs.columns)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that stand, or nearly stand, earlier; what is left without any line that counts goes."""
    out = line_dedup.dedup_lines(docs)
    counted = F.exists(F.split("text", "\n"), lambda x: x.rlike(r"\S"))
    kept = out.where(F.col("_gone").isNull() | counted)
    size = F.when(F.col("_gone").isNull(), F.col("n_chars")).otherwise(F.length("text"))
    return kept.withColumn("n_chars", size.cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each class of near copies."""
    ship(spark)
    classes = jaccard_join.join(docs)
    copies = classes.where("component_id < doc_id").select("doc_id").distinct()
    kept = docs.join(copies, "doc_id", "left_anti")
    # rows that agree in id and text are copies of each other too, though their id is their class
    return kept.dropDuplicates(["doc_id", "text"]).select(*docs.columns) if _repeats(docs) else kept.select(*docs.columns)


def _repeats(docs: DataFrame) -> bool:
    return not docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty()


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    ship(spark)
    return decontaminate.decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the texts that are left (none for a null text), and the digest of what they decode to."""
    ship(spark)
    out = bpe.decode(bpe.encode(docs, TOKENIZER), TOKENIZER)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_classifier", good_documents),
    ("line_dedup", without_repeated_lines),
    ("jaccard_join", one_of_each_group),
    ("decontamination", without_benchmark),
    ("bpe", encoded),
]

#: A trained classifier decides in the first stage: SQL cannot say what it keeps.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is a table that the next stage reads."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

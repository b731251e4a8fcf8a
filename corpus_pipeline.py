"""From raw documents to token ids, in five stages.

Each stage takes what its predecessor kept, written as Parquet and read again.
Nulls, empty texts and repeated rows are handled as the operators state.  Rows that
share a doc_id are documents of their own: near-dedup drops those with equal texts
or near copies, and unlike ones stay.  An empty table gives an empty table.  Further
columns of documents, whatever their names, are carried to the last stage.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import _common as C
from corvane.llm import bpe, decontaminate, neardup, quality, substring

ACCEPT = 0.5
PERCENT = 80

#: The quality model and the segment tree are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


#: The column that keeps doc_id while rows have ids of their own.
OWN = "_corpus_pipeline_doc_id"


def fresh(docs: DataFrame, name: str) -> str:
    """name, made unlike all columns of docs."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs but those whose doc_id is in dropped; rows with a null id stay."""
    gone = fresh(docs, "_gone")
    return docs.join(dropped.select(F.col("doc_id").alias(gone)), F.col("doc_id") == F.col(gone), "left_anti")


def by_row(stage):
    """stage on rows with ids of their own, in the order of doc_id and text, where a doc_id is repeated."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            return stage(spark, docs, sf_dir)
        row = F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id())
        keyed = C.settle(docs.orderBy("doc_id", F.xxhash64("text")).withColumn(OWN, F.col("doc_id")).withColumn("doc_id", row), "rows")
        return stage(spark, keyed, sf_dir).withColumn("doc_id", F.col(OWN)).select(*docs.columns)

    return run


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts."""
    known = quality.columns_of(docs)
    model = quality.train(known, C.table(spark, sf_dir, "labels"))
    names = tuple(fresh(docs, c) for c in quality.SCORES)
    return quality.score(docs, model, names).where(F.col(names[2]) >= ACCEPT).select(*docs.columns)


@by_row
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies; of one doc_id's equal texts, one."""
    if OWN in docs.columns:  # by_row: also texts that have no words
        first = docs.where("doc_id is not null").groupBy(OWN, F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), F.col("text").isNull()).agg(F.min("doc_id").alias("_first"))
        at = fresh(docs, "_first")
        kept = docs.join(first.select(F.col("_first").alias(at)), F.col("doc_id") == F.col(at), "left_semi")
        docs = C.settle(docs.where("doc_id is null").unionByName(kept), "documents")
    classes = neardup.dedup(docs, PERCENT)
    return without(docs, classes.where("not kept"))


@by_row
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that earlier texts have; a text that loses all of them goes."""
    runs = C.settle(substring.repeated(C.ids_and_texts(docs)), "runs")
    cut = substring.strip(docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text"), runs, substring.WINDOW).where("n_removed = 0 or kept != ''")
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    changed = {"text": text, "n_chars": F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(F.col("row.n_chars"))}
    return cut.select(*[changed[c].cast(docs.schema[c].dataType).alias(c) if c in changed else F.col("row")[c].alias(c) for c in docs.columns])


@by_row
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    found = decontaminate.decontaminate(docs, C.table(spark, sf_dir, "benchmark"))
    return without(docs, found.where("contaminated"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and a digest of the text that they decode to."""
    return bpe.encode(docs).select("doc_id", "n_tokens", "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", good_quality),
    ("minhash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", decontaminated),
    ("bpe encoding", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = C.settle(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs

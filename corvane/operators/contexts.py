"""Contexts (one line of a text is one window), their words and sentences, all within the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import fixed
from corvane.functions import text as T


def let(value: Column, body) -> Column:
    """body(value), with value computed once: an expression named twice in a lambda is computed twice."""
    return F.transform(F.array(value), body)[0]


def held(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once: filters on them stay above, where Spark would copy their text below."""
    struct = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.explode_outer(F.array(struct)).alias("_held")).select(*df.columns, *[F.col(f"_held.{n}").alias(n) for n in columns])


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its scan has fewer parts than that, as with one small file; no shuffle otherwise."""
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def contexts(docs: DataFrame, trim: bool = True) -> DataFrame:
    """(doc_id, line, source, lang, context): one row for each line that is not blank.

    A line is normalised inside the array that is exploded, so later filters on the
    context cannot make Spark compute it twice.
    """
    lines = F.transform(F.split("text", "\n"), lambda x: T.normalise(x, trim))
    out = spread(docs.select("doc_id", "source", "lang", "text")).select("doc_id", "source", "lang", F.posexplode_outer(lines).alias("line", "context"))
    return out.where(F.col("context").isNotNull() & (F.trim("context") != "")).select("doc_id", "line", "source", "lang", "context")


def with_word(ctx: DataFrame, words: list[str]) -> DataFrame:
    """Contexts in which one of the words may be a token; a test on the text, ahead of any token."""
    return ctx.where(F.col("context").rlike(rf"(?iu)(?<![{T.LETTER}])(?:{'|'.join(words)})(?![{T.LETTER}])"))


def words(ctx: DataFrame, pattern: str = T.TOKEN, abbreviations: list[str] = fixed.ABBREVIATIONS) -> DataFrame:
    """ctx with tok, the lowered tokens, and sent, the number of each one's sentence."""
    own = held(ctx, sents=T.sentences(F.col("context"), pattern, abbreviations))
    return own.withColumn("tok", F.flatten("sents")).withColumn("sent", F.flatten(F.transform("sents", lambda s, i: F.array_repeat(i, F.size(s))))).drop("sents")


def token_rows(ctx: DataFrame, pattern: str = T.TOKEN) -> DataFrame:
    """(doc_id, line, idx, tok, sent): sent counts the sentence ends before the token."""
    both = F.arrays_zip("tok", "sent")
    rows = words(ctx, pattern).select("doc_id", "line", F.posexplode_outer(both).alias("idx", "t")).where("t is not null")
    return rows.select("doc_id", "line", "idx", F.col("t.tok").alias("tok"), F.col("t.sent").alias("sent"))

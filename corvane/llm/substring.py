"""Substring deduplication on a de Bruijn graph of word windows, compacted by joins.

The edges of the graph are the windows of ``window`` words, its nodes their
overlaps of one word less.  Windows that follow one another and share a minimizer
(the least hash of their ``anchor_words``-grams) are cut out together: such a run has
its minimizer, the hash of its words, and its source coordinate (doc_id, start,
number of windows).

1. Runs whose minimizer occurs once in the corpus hold no repeated window; a join
   with the repeated minimizers drops them.
2. Equal runs are one class, whose source is its first occurrence.
3. Where one minimizer has several classes, these may share some windows only: the
   classes' first occurrences are opened into single windows, which a join on two
   independent 64-bit hashes compares.
4. Repeated classes and windows are the edges that are left.  Their ends give the
   nodes, with the numbers of edges in and out.  Through a node that has one of
   each, a join links the edge that ends there and the one that starts there, if
   their source coordinates follow one another, which verifies that their words stand
   side by side.  As linked edges lie end to end in one source, paths are compacted
   in the order of source coordinates: a path starts where an edge has no link.
5. An edge that has an earlier source is repeated.  A document's edges of one path
   that stand as they do in the path are one long span; spans go back to the texts,
   where the covered words are removed.

No step collects a group: classes and windows are counted with partial sums, and
each join has two plain tables for sides, so that Spark splits a hot path.

A null text has no words.  A text shorter than the window keeps all of them.
Rows that share a doc_id count as one document and each of them loses the words
found for that id.  Rows with a null doc_id are no sources and keep their words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm import _common as C

WINDOW = 20
ANCHOR_WORDS = 6
PLACE_BITS = 27
#: An edge by its source coordinate; kind is 0 for a class of runs, 1 for a single window.
EDGE = ["doc_id", "start", "n", "kind"]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each width values, by doubling."""
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if width > done else x


def doc_of(ends: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(ends) - 1), np.diff(ends))


def window_starts(ends: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Document and place of each window's first word."""
    count = np.maximum(0, np.diff(ends) - window + 1)
    doc = np.repeat(np.arange(len(count)), count)
    before = np.cumsum(count) - count
    return doc, np.arange(int(count.sum())) - before[doc] + ends[:-1][doc]


def paths(text: pa.Array, window: int, anchor_words: int) -> tuple[np.ndarray, ...]:
    """Of each run of windows with one minimizer: (document, start in it, windows, minimizer, hash)."""
    words, index, ends = C.index_words(text)
    if len(index) >= 1 << PLACE_BITS:
        raise ValueError("a text has too many words for one slice")
    doc, at = window_starts(ends, window)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    grams = C.SpanHash(words, index, 1).spans(np.arange(len(index) - anchor_words + 1), anchor_words)
    place = np.uint64((1 << PLACE_BITS) - 1)
    keys = (grams & ~place) | np.arange(len(grams), dtype=np.uint64)
    anchor = (sliding_min(keys, window - anchor_words + 1)[at] & place).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])]))
    n = np.diff(np.append(first, len(at)))
    start = at[first]
    whole = C.SpanHash(words, index, 2).spans(start, n + window - 1)
    return doc[first], start - ends[:-1][doc[first]], n, grams[anchor[first]], whole


def all_paths(docs: DataFrame, window: int, anchor_words: int) -> DataFrame:
    def step(batch):
        doc, start, n, anchor, whole = paths(batch.column("text"), window, anchor_words)
        ids = np.asarray(batch.column("doc_id"), np.int64)[doc]
        return pa.RecordBatch.from_arrays([pa.array(C.signed(anchor)), pa.array(C.signed(whole)), pa.array(ids), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], ["anchor", "path", "doc_id", "start", "n"])

    return C.map_arrow(docs, step, "anchor long, path long, doc_id long, start int, n int")


def anchor_counts(docs: DataFrame, window: int, anchor_words: int) -> DataFrame:
    def step(batch):
        found, n = np.unique(paths(batch.column("text"), window, anchor_words)[3], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(C.signed(found)), pa.array(n.astype(np.int64))], ["anchor", "times"])

    return C.map_arrow(docs, step, "anchor long, times long")


def opened(docs: DataFrame, runs: DataFrame, window: int) -> DataFrame:
    """(w1, w2, doc_id, start) of the single windows of runs (doc_id, runs array<struct<start, n>>)."""

    def step(batch):
        words, index, ends = C.index_words(batch.column("text"))
        lists = batch.column("runs")
        size = np.asarray(pc.list_value_length(lists), np.int64)
        flat = lists.flatten()
        start, n = (np.asarray(flat.field(c), np.int64) for c in ("start", "n"))
        doc = np.repeat(np.repeat(np.arange(len(size)), size), n)
        place = np.repeat(start, n) + np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
        at = place + ends[:-1][doc]
        ok = at + window <= ends[1:][doc]  # a repeated doc_id may name a shorter text
        doc, place, at = doc[ok], place[ok], at[ok]
        h1, h2 = (C.SpanHash(words, index, seed).spans(at, window) for seed in (3, 4))
        ids = np.asarray(batch.column("doc_id"), np.int64)[doc]
        return pa.RecordBatch.from_arrays([pa.array(C.signed(h1)), pa.array(C.signed(h2)), pa.array(ids), pa.array(place.astype(np.int32))], ["w1", "w2", "doc_id", "start"])

    return C.map_arrow(docs.join(runs, "doc_id"), step, "w1 long, w2 long, doc_id long, start int")


def overlaps(docs: DataFrame, runs: DataFrame, window: int) -> DataFrame:
    """(edge, head, tail): hashes of the nodes that runs (doc_id, runs array<struct<start, n, kind>>) start and end at."""

    def step(batch):
        words, index, ends = C.index_words(batch.column("text"))
        lists = batch.column("runs")
        size = np.asarray(pc.list_value_length(lists), np.int64)
        flat = lists.flatten()
        start, n, kind = (np.asarray(flat.field(c), np.int64) for c in ("start", "n", "kind"))
        doc = np.repeat(np.arange(len(size)), size)
        at = start + ends[:-1][doc]
        ok = at + n + window - 1 <= ends[1:][doc]  # a repeated doc_id may name a shorter text
        doc, start, n, kind, at = doc[ok], start[ok], n[ok], kind[ok], at[ok]
        hashes = C.SpanHash(words, index, 5)
        head, tail = hashes.spans(at, window - 1), hashes.spans(at + n, window - 1)
        ids = np.asarray(batch.column("doc_id"), np.int64)[doc]
        return pa.RecordBatch.from_arrays([pa.array(ids), *(pa.array(x.astype(np.int32)) for x in (start, n, kind)), pa.array(C.signed(head)), pa.array(C.signed(tail))], [*EDGE, "head", "tail"])

    return C.map_arrow(docs.join(runs, "doc_id"), step, "doc_id long, start int, n int, kind int, head long, tail long")


def compacted(docs: DataFrame, edges: DataFrame, window: int) -> DataFrame:
    """edges (EDGE) with path, the start of their nonbranching path in the source: edges of one kind do not overlap there."""
    lists = edges.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n", "kind")).alias("runs"))
    ends = C.settle(overlaps(docs, lists, window), "overlaps")
    edge = F.struct(*EDGE)
    one = lambda node, name: ends.groupBy(F.col(node).alias("node")).agg(F.count(F.lit(1)).alias("degree"), F.min(edge).alias(name)).where("degree = 1").drop("degree")
    links = one("tail", "before").join(one("head", "after"), "node")
    links = links.where("before.doc_id = after.doc_id and before.kind = after.kind and before.start + before.n = after.start").select("after.*", F.lit(True).alias("linked"))
    along = Window.partitionBy("doc_id", "kind").orderBy("start", "n")
    path = F.last(F.when(F.col("linked").isNull(), F.col("start")), ignorenulls=True).over(along)
    out = C.settle(ends.select(*EDGE).distinct().join(links, EDGE, "left").withColumn("path", path).drop("linked"), "paths")
    C.discard(ends)
    return out


def spans_of(runs: DataFrame, paths_: DataFrame) -> DataFrame:
    """(doc_id, start, n): runs (at, from_, and the EDGE that they repeat) that stand in a document as in their path, end to end, are one."""
    source = paths_.select(*EDGE, "path")
    path = F.coalesce("path", "start")
    own = runs.join(source, EDGE, "left").select("at", "from_", "n", F.struct("doc_id", path.alias("path"), "kind").alias("path"), (F.col("from_") - (F.col("start") - path)).alias("shift"))
    # As long as a document's part of one path.
    whole = own.groupBy("at", "path", "shift").agg(F.min("from_").alias("a"), F.max(F.col("from_") + F.col("n")).alias("b"), F.sum("n").alias("total"), F.collect_set(F.struct(F.col("from_").alias("start"), "n")).alias("runs"))
    one = F.array(F.struct(F.col("a").alias("start"), (F.col("b") - F.col("a")).alias("n")))
    spans = F.when(F.col("total") == F.col("b") - F.col("a"), one).otherwise(F.col("runs"))
    return whole.select(F.col("at").alias("doc_id"), F.explode(spans).alias("s")).select("doc_id", "s.start", "s.n")


def repeated(docs: DataFrame, window: int = WINDOW, anchor_words: int = ANCHOR_WORDS) -> DataFrame:
    """(doc_id, start, n): spans of n windows each of which also starts earlier, as a settled table."""
    docs = docs.where(F.col("doc_id").isNotNull())
    counts = anchor_counts(docs, window, anchor_words).groupBy("anchor").agg(F.sum("times").alias("times"))
    shared = C.settle(counts.where("times > 1").select("anchor"), "anchors")
    runs = C.settle(all_paths(docs, window, anchor_words).join(shared, "anchor"), "paths")
    classes = runs.groupBy("anchor", "path", "n").agg(F.min(F.struct("doc_id", "start")).alias("source"), F.count(F.lit(1)).alias("times"))
    classes = C.settle(classes, "classes")
    branching = C.settle(classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("anchor"), "branching")
    firsts = classes.join(branching, "anchor").select(F.col("source.doc_id").alias("doc_id"), F.struct(F.col("source.start").alias("start"), "n").alias("run")).groupBy("doc_id").agg(F.collect_list("run").alias("runs"))
    single = C.settle(opened(docs, firsts, window).distinct(), "windows")
    sources = C.settle(single.groupBy("w1", "w2").agg(F.min(F.struct("doc_id", "start")).alias("source"), F.count(F.lit(1)).alias("times")).where("times > 1").drop("times"), "sources")
    later = F.col("source") != F.struct("doc_id", "start")
    again = classes.where("times > 1").select("anchor", "path", "n", "source")
    repeats = again.select("source", "n", F.lit(0).alias("kind")).unionByName(sources.select("source", F.lit(1).alias("n"), F.lit(1).alias("kind")))
    edges = repeats.select("source.doc_id", "source.start", "n", "kind").distinct()
    place = [F.col("doc_id").alias("at"), F.col("start").alias("from_"), "source.doc_id", "source.start"]
    whole = runs.join(again, ["anchor", "path", "n"]).where(later).select(*place, "n", F.lit(0).alias("kind"))
    opened_ = single.join(sources, ["w1", "w2"]).where(later).select(*place, F.lit(1).alias("n"), F.lit(1).alias("kind"))
    found = C.settle(whole.unionByName(opened_), "found")
    C.discard(shared, branching)
    paths_ = compacted(docs, edges, window)
    out = C.settle(spans_of(found, paths_), "spans")
    C.discard(runs, classes, single, sources, found, paths_)
    return out


def covered(runs: DataFrame, window: int) -> DataFrame:
    """(doc_id, runs): the runs of each document, one list for each."""
    return runs.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("start", "n"))).alias("runs"))


def strip(docs: DataFrame, runs: DataFrame, window: int) -> DataFrame:
    """docs (doc_id, text, and others) with n_words, n_removed and kept: the words left, joined by one space."""
    joined = docs.join(covered(runs, window), "doc_id", "left")
    names, fields = joined.columns[:-1], ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields[:-1])

    def step(batch):
        words, index, ends = C.index_words(batch.column("text"))
        lists = batch.column("runs")
        size = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
        flat = lists.flatten()
        start, n = (np.asarray(flat.field(c), np.int64) for c in ("start", "n"))
        doc = np.repeat(np.arange(len(size)), size)
        a = np.minimum(start + ends[:-1][doc], ends[1:][doc])
        b = np.minimum(start + n + window - 1 + ends[:-1][doc], ends[1:][doc])
        depth = np.zeros(len(index) + 1, np.int64)
        np.add.at(depth, a, 1)
        np.add.at(depth, b, -1)
        kept = np.cumsum(depth[:-1]) == 0
        out = []
        for i, j in zip(ends, ends[1:]):
            out.append(b" ".join([words[w] for w in index[i:j][kept[i:j]].tolist()]))
        total = np.concatenate([[0], np.cumsum(~kept)])
        columns = [*batch.columns[:-1], pa.array(np.diff(ends), pa.int64()), pa.array(total[ends[1:]] - total[ends[:-1]], pa.int64()), pa.array(out, pa.binary()).cast(pa.string())]
        return pa.RecordBatch.from_arrays(columns, [*names, "n_words", "n_removed", "kept"])

    return C.map_arrow(joined, step, f"{fields}, n_words long, n_removed long, kept string")


def dedup(docs: DataFrame, window: int = WINDOW, anchor_words: int = ANCHOR_WORDS) -> DataFrame:
    """(doc_id, text, n_words, n_removed, kept)."""
    docs = C.ids_and_texts(docs)
    return strip(docs, repeated(docs, window, anchor_words), window)


def query_of(docs: DataFrame) -> DataFrame:
    return dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    return query_of(C.table(spark, sf_dir, "documents"))


SQL = r"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS s FROM d, unnest(range(1, greatest(len(w) - 20, -1) + 2)) AS t(i)),
n AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS rn FROM win),
gone AS (SELECT DISTINCT doc_id, p FROM n, unnest(range(i, i + 20)) AS t(p) WHERE rn > 1),
words AS (SELECT doc_id, p, w[p] AS x FROM d, unnest(range(1, len(w) + 1)) AS t(p)),
kept AS (SELECT words.doc_id, string_agg(x, ' ' ORDER BY p) AS s FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY words.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g USING (doc_id) LEFT JOIN kept USING (doc_id)"""

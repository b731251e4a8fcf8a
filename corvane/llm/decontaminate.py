"""Benchmark decontamination by winnowing, in DataFrame and SQL functions only.

A text's fingerprints are the least k-gram hash of each run of ``window - k + 1``
successive k-grams, so two texts that share ``window`` words share a fingerprint.
Documents' fingerprints are joined with those of the benchmark; around each place
where one matches, the windows that contain the k-gram are joined with the
items' windows on their words, which extends hits exactly and refutes collisions.

An item shorter than the window is itself one window; each length that occurs
among such items (at most window - 1 of them) has its own pass, with k as long as
the item, so every k-gram is a fingerprint.

Items with the same words form one class, so repeated items do not multiply hits.
A document's hits are spans within it: what is collected for one document is
bounded by its own text and the list of items its result must name.

A null text has no words.  Items without words or with a null id take no part: an
item that cannot be named makes no hits, in the SQL alike.
Rows that share a doc_id, null included, count as one document with the hits of
all of them, and each of them is returned with its own number of words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import _common as C

WINDOW = 10
GRAM = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: F.Column) -> F.Column:
    """Lower-cased (A-Z only) words; what lies between them is any other ASCII character."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), "")


def steps(n: F.Column) -> F.Column:
    """1 .. n, or nothing."""
    return F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<int>"))


def let(value: F.Column, body) -> F.Column:
    """body(value), with value computed once: a lambda's own text is computed anew for each element."""
    return F.transform(F.array(value), body)[0]


def gram_hashes(words: F.Column, k: int) -> F.Column:
    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.transform(steps(F.size(h) - (k - 1)), lambda i: F.xxhash64(F.slice(h, i, k))))


def fingerprints(words: F.Column, k: int, window: int) -> F.Column:
    """The distinct fingerprints: the least hash of each window - k + 1 successive k-grams."""
    run = window - k + 1
    least = gram_hashes(words, k)
    if run > 1:
        least = let(least, lambda h: F.transform(steps(F.size(h) - (run - 1)), lambda i: F.array_min(F.slice(h, i, run))))
    return F.array_distinct(least)


def windows_of(items: DataFrame, length: int) -> DataFrame:
    """(class, window, wid): the distinct windows of items; wid is a digest of length and window."""
    starts = steps(F.size("words") - (length - 1))
    own = items.select("class", F.explode(F.array_distinct(F.transform(starts, lambda i: F.concat_ws(" ", F.slice("words", i, length))))).alias("window"))
    return own.withColumn("wid", F.md5(F.concat_ws(" ", F.lit(str(length)), F.col("window")).cast("binary")))


def hits_of_length(docs: DataFrame, items: DataFrame, length: int, k: int) -> DataFrame:
    """(doc_id, pos, length, wid): windows of one length that begin at word pos of a document and that items (class, words) have."""
    windows = windows_of(items, length).select("window", "wid").distinct()
    prints = C.settle(items.select(F.explode(fingerprints(F.col("words"), k, length)).alias("fp")).distinct(), "item_prints")
    own = docs.select("doc_id", F.explode(fingerprints(words_of(F.col("text")), k, length)).alias("fp"))
    matched = C.settle(own.join(prints, "fp").groupBy("doc_id").agg(F.collect_set("fp").alias("fps")), "matched")
    near = docs.join(matched.withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id")))
    none = F.array().cast("array<int>")

    def starts_near(words, grams):
        """Starts of the windows that contain a matching k-gram."""
        at = F.filter(steps(F.size(grams)), lambda p: F.array_contains("fps", F.element_at(grams, p)))
        last = F.size(words) - (length - 1)
        low, high = (lambda p: F.greatest(p - (length - k), F.lit(1))), (lambda p: F.least(p, last))
        return F.array_distinct(F.flatten(F.transform(at, lambda p: F.when(low(p) <= high(p), F.sequence(low(p), high(p))).otherwise(none))))

    def windows_near(words):
        starts_of = let(gram_hashes(words, k), lambda grams: starts_near(words, grams))
        return F.transform(starts_of, lambda i: F.struct(i.alias("pos"), F.concat_ws(" ", F.slice(words, i, length)).alias("window")))

    spans = near.select("doc_id", F.explode(let(words_of(F.col("text")), windows_near)).alias("span"))
    return spans.select("doc_id", "span.pos", "span.window").join(windows, "window").select("doc_id", "pos", F.lit(length).alias("length"), "wid")


def covered_words(spans: F.Column) -> F.Column:
    """How many words an array of (pos, length), sorted, covers."""
    begin = F.struct(F.lit(1).alias("upto"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, s: F.struct(
        F.greatest(acc["upto"], s["pos"] + s["length"]).alias("upto"),
        (acc["n"] + F.greatest(F.lit(0), s["pos"] + s["length"] - F.greatest(acc["upto"], s["pos"])).cast("long")).alias("n"),
    )
    return F.aggregate(spans, begin, step, lambda acc: acc["n"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, contaminated); items lists the item_ids as sorted strings."""
    docs = C.ids_and_texts(docs)
    named = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text").cast("string")).alias("words")).where("item_id is not null and size(words) > 0")
    named = C.settle(named.groupBy("words").agg(F.array_sort(F.collect_set("item_id")).alias("ids")).withColumn("class", F.xxhash64("words")), "items")
    lengths = sorted({min(r.n, window) for r in named.select(F.least(F.size("words"), F.lit(window)).alias("n")).distinct().collect()})
    hits = owners = None
    for length in lengths:
        items = named.where(F.size("words") == length if length < window else F.size("words") >= window).select("class", "words")
        found = hits_of_length(docs, items, length, min(gram, length) if length == window else length)
        hits = found if hits is None else hits.unionByName(found)
        owned = windows_of(items, length).select("wid", "class")
        owners = owned if owners is None else owners.unionByName(owned)
    counted = docs.select("doc_id", F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    if hits is None:
        none = counted.withColumns({"n_hit": F.lit(0).cast("long"), "n_items": F.lit(0).cast("long"), "items": F.array().cast("array<string>")})
        return none.withColumn("contaminated", F.lit(False))
    hits = C.settle(hits.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("pos", "length"))).alias("spans"), F.collect_set("wid").alias("wids")), "hits")
    # A window is looked up once for each document, however often it stands there and however many items share it.
    own = hits.select("doc_id", F.explode("wids").alias("wid")).join(C.settle(owners, "owners"), "wid").select("doc_id", "class").distinct()
    items = own.join(named.select("class", "ids"), "class")
    items = items.groupBy(F.col("doc_id").alias("_id")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("items"))
    per_doc = hits.select("doc_id", covered_words(F.col("spans")).alias("n_hit")).join(items, F.col("doc_id").eqNullSafe(F.col("_id"))).select("_id", "n_hit", "items")
    out = counted.join(per_doc, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def query_of(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    out = decontaminate(docs, benchmark)
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def query(spark, sf_dir: str) -> DataFrame:
    return query_of(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))


SQL = r"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win FROM b, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS t(i) WHERE len(w) > 0),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i AS pos, array_to_string(w[i : i + n - 1], ' ') AS win FROM d, ns, unnest(range(1, greatest(len(w) - n, -1) + 2)) AS t(i) WHERE len(w) >= n),
h AS (SELECT doc_id, dw.n, pos, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, n, pos FROM h), unnest(range(pos, pos + n)) AS t(p) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)"""

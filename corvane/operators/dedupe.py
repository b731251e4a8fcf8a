"""Identity and grouping of hits and contexts.

A row of the matrix is a context, known by (doc_id, line); rows are in that order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import contexts as X
from corvane.operators.tables import components, numbered, settle

ROW = ["doc_id", "line"]


def match_ids(found: DataFrame) -> DataFrame:
    """M001, M002 ... within a row, by (position, term, form)."""
    order = Window.partitionBy(*ROW).orderBy("idx", "term", "form")
    return found.withColumn("match_id", F.format_string("M%03d", F.row_number().over(order)))


def hit_keys(found: DataFrame, doc_key: Column) -> DataFrame:
    """occurrence_id and hit_key of hits (canonical_term, form, off_node, off_term)."""
    occurrence = F.concat(doc_key, F.lit("::ROW_"), F.col("line").cast("string"))
    key = F.concat_ws("|", occurrence, "canonical_term", "form", F.col("off_node").cast("string"), F.col("off_term").cast("string"))
    return found.withColumns({"occurrence_id": occurrence, "hit_key": key})


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in an order; only the least row is kept while grouping, so a hot key is no hot task."""
    rest = [c for c in df.columns if c not in order]
    least = df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min_by(F.struct(*order, *rest), F.struct(*order)).alias("r"))
    return least.select(*[F.col("r")[c].alias(c) for c in df.columns])


def exact(found: DataFrame) -> DataFrame:
    """The first row of each hit_key."""
    return first_by(found, ["hit_key"], [*ROW, "idx", "term"])


def first_of_context(ctx: DataFrame) -> DataFrame:
    """The first row of each distinct context."""
    first = F.min(F.struct("doc_id", "line")).alias("f")
    return ctx.groupBy("context").agg(first, F.count(F.lit(1)).alias("times")).select("f.doc_id", "f.line", "context", "times")


def rollup(found: DataFrame) -> DataFrame:
    """One row for each row of the matrix: its hits, terms, forms, motives and longest context."""
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), "; ")
    out = found.groupBy(*ROW).agg(
        F.count(F.lit(1)).alias("n_hits"),
        F.sum(F.col("nuclear").cast("long")).alias("n_nuclear"),
        joined("term").alias("terms"),
        joined("form").alias("forms"),
        F.bool_or("nuclear").alias("any_nuclear"),
        joined(F.when(F.trim("motive") != "", F.col("motive"))).alias("motives"),
        joined("match_id").alias("match_ids"),
        F.max_by("context", F.struct(F.length("context"), -F.col("idx"))).alias("canonical_context"),
    )
    return out


def consensus(found: DataFrame, path: Column | None = None) -> DataFrame:
    """Hits of one token signature (and dependency path) whose nuclear differs take the majority; a tie is not nuclear.

    A row turned off keeps its motive, or has the first one of the rows that won, or
    indeterminada.  Only signatures that differ are joined back.  Hits are written
    first, so that they are found once and not again for the counts.
    """
    keyed = settle(found, "found").withColumn("_sig", F.sha2(F.concat_ws("\u0001", F.array_join("tok", " "), path if path is not None else F.lit("")), 256))
    order = F.struct(*ROW, "idx")
    first = F.min(F.when(~F.col("nuclear"), F.struct(order.alias("o"), F.col("motive").alias("m"))))["m"]
    groups = keyed.groupBy("_sig").agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col("nuclear").cast("long")).alias("_yes"), first.alias("_motive")).where("_yes > 0 and _yes < _n")
    groups = groups.select(F.col("_sig").alias("_of"), (2 * F.col("_yes") > F.col("_n")).alias("_verdict"), "_motive")
    out = keyed.join(groups, F.col("_sig") == F.col("_of"), "left")
    filled = lambda c: F.when(F.trim(c) != "", F.col(c))
    motive = F.when(F.col("_of").isNull(), F.col("motive")).when(F.col("_verdict"), "").otherwise(F.coalesce(filled("motive"), filled("_motive"), F.lit("indeterminada")))
    return out.withColumns({"nuclear": F.coalesce("_verdict", "nuclear"), "motive": motive}).drop("_sig", "_of", "_verdict", "_motive")


def grams(rows: DataFrame, size: int = 8, *carried: str) -> DataFrame:
    """(ROW, carried, gram): the distinct grams of each row's tokens, cut from the array in the row.

    A gram travels as two 64-bit hashes with different seeds, not as its words.
    """
    starts = F.when(F.size("tok") >= size, F.sequence(F.lit(1), F.greatest(F.size("tok") - (size - 1), F.lit(1)))).otherwise(F.array().cast("array<int>"))
    pair = lambda part: F.struct(F.xxhash64(part).alias("g1"), F.xxhash64(F.lit(1), part).alias("g2"))
    own = X.let(F.transform("tok", lambda t: F.xxhash64(t)), lambda h: F.array_distinct(F.transform(starts, lambda i: X.let(F.slice(h, i, size), pair))))
    return rows.select(*ROW, *carried, F.explode_outer(own).alias("gram")).where("gram is not null")


def citation_pairs(rows: DataFrame, size: int = 8, most: int | None = 30) -> DataFrame:
    """(a_doc, b_doc): star edges among documents that share a gram found in 2 .. most rows (in any number, if most is null)."""
    own = grams(rows, size)
    shared = own.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("a_doc")).where("n >= 2" + (f" and n <= {most}" if most else ""))
    return own.join(shared, "gram").where("doc_id != a_doc").select("a_doc", F.col("doc_id").alias("b_doc")).distinct()


def row_components(edges: DataFrame) -> DataFrame:
    """(ROW, first): components of edges (a, b) between rows, by their first row."""
    return components(edges).select("id.doc_id", "id.line", F.col("component").alias("first"))


def weighted(found: DataFrame) -> DataFrame:
    """The rows that hits stand in, with their number."""
    return found.groupBy(*ROW).agg(F.count(F.lit(1)).alias("weight"), F.first("tok").alias("tok"))


def citation_groups(found: DataFrame, size: int = 8, most: int | None = None) -> DataFrame:
    """(ROW, citation): C0001 ... for rows linked across documents by grams that 2 .. most hits share (2 or more, if most is null)."""
    own = settle(grams(weighted(found), size, "weight"), "grams")
    shared = own.groupBy("gram").agg(F.sum("weight").alias("n"), F.min(F.struct(*ROW)).alias("a"), F.count(F.lit(1)).alias("k")).where("k > 1 and n >= 2" + (f" and n <= {most}" if most else ""))
    edges = own.join(shared.select("gram", "a"), "gram").select("a", F.struct(*ROW).alias("b")).where("a != b").distinct()
    return named_groups(row_components(edges), "C", "citation", "docs > 1")


def passage_groups(found: DataFrame, size: int = 8) -> DataFrame:
    """(ROW, passage): P0001 ... for rows of one document that share a gram, however common it is."""
    own = settle(grams(weighted(found), size), "grams")
    shared = own.groupBy("doc_id", "gram").agg(F.min("line").alias("first"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    edges = own.join(shared, ["doc_id", "gram"]).where("line != first").select(F.struct("doc_id", F.col("first").alias("line")).alias("a"), F.struct(*ROW).alias("b")).distinct()
    return named_groups(row_components(edges), "P", "passage", "true")


def named_groups(members: DataFrame, letter: str, name: str, keep: str) -> DataFrame:
    """Groups numbered in the order of their first rows, as a letter and at least four digits."""
    groups = members.groupBy("first").agg(F.count_distinct("doc_id").alias("docs")).where(keep).select("first")
    ranked = numbered(groups, "first", "_no").select("first", F.concat(F.lit(letter), F.lpad(F.col("_no").cast("string"), 4, "0")).alias(name))
    return members.join(ranked, "first").drop("first")


def path_preference(path: Column) -> Column:
    """Catalogued files before others, dated names before others, copies marked by a double underscore last."""
    base = F.regexp_extract(F.regexp_replace(path, r"\\", "/"), r"([^/]*)$", 1)
    return F.when(path.contains("todos os textos"), 4).otherwise(0) + F.when(base.rlike(r"^\([0-9]{4}\)"), 2).otherwise(0) - F.when(base.contains("__"), 1).otherwise(0)


def with_citations(found: DataFrame, path: Column, size: int = 8, most: int | None = None) -> DataFrame:
    """found with citation; of one term and form in a citation of several documents the best row stays nuclear.

    Best: nuclear, then by path, then the longer context, then the earlier row.
    """
    h = found.join(citation_groups(found, size, most), ROW, "left").withColumn("_pref", path_preference(path))
    key = ["citation", "canonical_term", "form"]
    best = F.max_by(F.struct(*ROW, "idx"), F.struct("nuclear", "_pref", F.length("context"), (-F.col("doc_id")).alias("d"), (-F.col("line")).alias("l"), (-F.col("idx")).alias("i")))
    groups = h.where("citation is not null").groupBy(*key).agg(best.alias("_best"), F.count_distinct("doc_id").alias("_docs")).where("_docs > 1").drop("_docs")
    h = h.join(groups, key, "left")
    lost = F.coalesce(F.col("_best") != F.struct(*ROW, "idx"), F.lit(False))
    motive = F.when(lost & (F.coalesce(F.trim("motive"), F.lit("")) == ""), "citacao_repetida").otherwise(F.col("motive"))
    tag = F.when(F.col("citation").isNotNull(), F.concat(F.lit("citacao_entre_doc_ids:"), F.col("citation"))).otherwise("")
    return h.withColumns({"motive": motive, "nuclear": F.col("nuclear") & ~lost, "duplicate": tag}).drop("_pref", "_best")


def fused(found: DataFrame, size: int = 8) -> DataFrame:
    """found (after with_citations) with passage, merged and fusion tags; of one term and form in a passage the best row stays.

    Best: nuclear, then the longer context, then the earlier row.
    """
    h = found.join(passage_groups(found, size), ROW, "left")
    key = ["passage", "canonical_term", "form"]
    place = F.struct(*ROW, "idx")
    best = F.max_by(place, F.struct("nuclear", F.length("context"), (-F.col("line")).alias("l"), (-F.col("idx")).alias("i")))
    groups = h.where("passage is not null").groupBy(*key).agg(best.alias("_best"), F.count(F.lit(1)).alias("_k"), F.min(place).alias("_first")).where("_k > 1")
    groups = numbered(groups.withColumn("_order", F.struct("passage", "_first")), "_order", "_no").withColumn("fusion", F.concat(F.lit("J"), F.lpad(F.col("_no").cast("string"), 4, "0"))).drop("_first", "_order", "_no")
    h = h.join(groups, key, "left")
    is_best = F.col("_best") == place
    lost = F.coalesce(~is_best, F.lit(False))
    motive = F.when(lost & (F.coalesce(F.trim("motive"), F.lit("")) == ""), "janela_sobreposta").otherwise(F.col("motive"))
    tag = lambda name, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(name), F.col(c)))
    tags = F.concat_ws("; ", F.when(F.col("duplicate") != "", F.col("duplicate")), tag("passagem_sobreposta:", "passage"), tag("janela_sobreposta:", "fusion"))
    return h.withColumns({"motive": motive, "nuclear": F.col("nuclear") & ~lost, "merged": F.when(F.coalesce(is_best, F.lit(False)), F.col("_k")).otherwise(1), "duplicate": tags}).drop("_best", "_k")


def duplicates_report(found: DataFrame, doc_key: Column, path: Column) -> DataFrame:
    """(kind, key, n, fused, detail): documents known by several paths, and passages with their hits, fused windows and terms."""
    joined = lambda c, sep: F.array_join(F.array_sort(F.collect_set(c)), sep)
    none = F.lit(0).cast("long").alias("fused")
    paths = found.select(doc_key.alias("key"), path.alias("p")).distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n"), joined("p", " | ").alias("detail")).where("n > 1")
    fused_rows = F.sum((F.col("motive") == "janela_sobreposta").cast("long")).alias("fused")
    passages = found.where("passage is not null").groupBy(F.col("passage").alias("key")).agg(F.count(F.lit(1)).alias("n"), fused_rows, joined("canonical_term", "; ").alias("detail"))
    return passages.select(F.lit("passagem_sobreposta").alias("kind"), "key", "n", "fused", "detail").unionByName(paths.select(F.lit("mesmo_doc_id_varios_caminhos").alias("kind"), "key", "n", none, "detail"))


MODES = ("nenhuma", "ocorrencia", "ocorrencia_termo", "obra_termo", "contexto", "candidatos")


def dedupe_mode(found: DataFrame, mode: str) -> DataFrame:
    """The first hit by mode: of a row, of a row and term, of a document and term, of a context, or (candidatos) of a context among flagged hits.

    Without any flagged hit, candidatos is contexto.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; there are {', '.join(MODES)}")
    term = "canonical_term" if "canonical_term" in found.columns else "term"
    order = [*ROW, "idx", "term"]
    if mode == "nenhuma":
        return found
    if mode in ("contexto", "candidatos"):
        flagged = F.lit(True)
        if mode == "candidatos" and "duplicate" in found.columns:
            flag = ~F.lower(F.trim(F.coalesce("duplicate", F.lit("")))).isin("", "nan", "none", "nat", "false", "0")
            any_flag = found.agg(F.coalesce(F.bool_or(flag), F.lit(False)).alias("_any"))
            found = found.join(F.broadcast(any_flag), F.lit(True))  # one row
            flagged = ~F.col("_any") | flag
        keyed = found.withColumn("_flag", flagged).withColumn("_key", F.sha2(F.trim("context"), 256)).drop("_any")
        first = first_by(keyed.where("_flag"), ["_key"], order)
        return first.unionByName(keyed.where("not _flag")).drop("_flag", "_key")
    keys = {"ocorrencia": ROW, "ocorrencia_termo": [*ROW, term], "obra_termo": ["doc_id", term]}[mode]
    return first_by(found, keys, order)


def domains(docs: DataFrame, rules: dict[str, str], default: str) -> DataFrame:
    """The first rule that matches a document's path."""
    path = F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    out = None
    for rule, value in rules.items():
        out = F.when(path.rlike(rule), value) if out is None else out.when(path.rlike(rule), value)
    return docs.select("doc_id", T.doc_key(path).alias("doc_key"), out.otherwise(default).alias("domain"))

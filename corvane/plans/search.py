"""Boolean and proximity searches over the driver's documents, and what is counted of them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.functions import fixed
from corvane.functions import text as T
from corvane.operators import query as Q
from corvane.plans import profile as P
from corvane.plans.base import HITS, LINES, QTOKEN, ctx, hits, literal, long_line, quoted, register, words_sql

QT = rf"""{LINES}, {words_sql(QTOKEN)}, qt AS (SELECT doc_id, line, idx AS i, tok, sent FROM tok), lists AS (SELECT doc_id, line, list(tok ORDER BY i) AS t FROM qt GROUP BY ALL),
ql AS (SELECT doc_id, line, bool_or(tok = 'the') AS has_the, bool_or(tok = 'of') AS has_of, bool_or(tok IN ('thing', 'nicht')) AS has_either FROM qt GROUP BY ALL)"""



def glued(x: str) -> str:
    return f"(length({x}) > 22 OR (length({x}) >= 10 AND regexp_matches({x}, '({'|'.join(fixed.GLUED_ENDS)})$')))"


LIGHT = fixed.DETERMINERS + fixed.QUERY_DEGREES + fixed.QUERY_NEGATIONS
LOOSE = LIGHT + ["as", "by", "to"]


def outside(words) -> str:
    return f"len(list_filter(m, lambda w: w NOT IN {quoted(words)}))"


def inside(words) -> str:
    return f"len(list_filter(m, lambda w: w IN {quoted(words)}))"


RELATION = f"""CASE WHEN gap = 0 THEN 'identico' WHEN gap = 1 OR (gap <= 3 AND {outside(LIGHT)} = 0) THEN 'caracterizacao_atributiva'
  WHEN {inside(fixed.COPULAS)} > 0 AND {outside(fixed.COPULAS + LOOSE)} <= 1 THEN 'caracterizacao_predicativa'
  WHEN gap <= 3 AND {inside(fixed.SPECIFYING)} = 1 AND {outside(fixed.SPECIFYING + fixed.DETERMINERS + fixed.QUERY_DEGREES)} = 0 THEN 'especificacao_preposicional'
  WHEN {inside(fixed.CHARACTERISING)} > 0 AND {outside(fixed.CHARACTERISING + fixed.COPULAS + LOOSE)} <= 1 THEN 'definicao_metalinguistica' END"""


def matches(pattern: str, x: str = "tok") -> str:
    return f"(regexp_matches({x}, '{literal(T.query_pattern(pattern))}') AND NOT {glued(x)})"


def pairs_sql(left: str, right: str, most: int | None, strict: bool) -> str:
    """pair (doc_id, line, i, j, d, rel): pairs of single words that stay."""
    near = f" AND gap <= {most}" if most is not None else ""
    keep = " WHERE rel IS NOT NULL" if strict else ""
    return rf"""{QT},
side_a AS (SELECT * FROM qt WHERE {matches(left)}), side_b AS (SELECT * FROM qt WHERE {matches(right)}),
met AS (SELECT a.doc_id, a.line, a.i, b.i AS j, a.tok AS ta, b.tok AS tb, abs(a.i - b.i) AS gap, t[least(a.i, b.i) + 2 : greatest(a.i, b.i)] AS m FROM side_a a JOIN side_b b ON a.doc_id = b.doc_id AND a.line = b.line{" AND a.sent = b.sent" if strict else ""} JOIN lists l ON a.doc_id = l.doc_id AND a.line = l.line WHERE true{near}),
pair AS (SELECT * FROM (SELECT doc_id, line, i, j, ta, tb, gap AS d, {RELATION} AS rel FROM met){keep})"""


PAIRS_OUT = "SELECT doc_id, line, count(*) AS pairs, CAST(sum(d) AS BIGINT) AS total, array_to_string(list_sort(list_distinct(list_concat(list(ta), list(tb)))), ',') AS forms, coalesce(array_to_string(list_sort(list_distinct(list(rel))), ','), '') AS rels FROM pair GROUP BY doc_id, line"


def run_pairs(query: str, strict: bool = True):
    def run(spark, sf_dir):
        found = Q.search(ctx(spark, sf_dir), query, same_sentence=strict, need_syntax=strict)
        total = F.aggregate("dists", F.lit(0).cast("long"), lambda n, d: n + d)
        return long_line(found).select("doc_id", "line", F.size("dists").cast("long").alias("pairs"), total.alias("total"), F.array_join(F.array_sort("forms"), ",").alias("forms"), F.array_join(F.array_sort("rels"), ",").alias("rels"))

    return run


def run_rows(query: str, strict: bool = True):
    def run(spark, sf_dir):
        return long_line(Q.search(ctx(spark, sf_dir), query, same_sentence=strict, need_syntax=strict)).select("doc_id", "line")

    return run


register("q_near", f"WITH {pairs_sql('the', 'th*', 3, True)} {PAIRS_OUT}")(run_pairs("the NEAR/3 th*"))
register("q_near_plain", f"WITH {pairs_sql('the', 'th*', 3, False)} {PAIRS_OUT}")(run_pairs("the NEAR/3 th*", False))
register("q_near_lower", f"WITH {pairs_sql('?s', 'of', 5, True)} {PAIRS_OUT}")(run_pairs("?s near/5 of"))
register("q_and", f"WITH {pairs_sql('nicht', '*er', None, True)} SELECT DISTINCT doc_id, line FROM pair")(run_rows("nicht AND *er"))
register("q_and_plain", f"WITH {QT} SELECT doc_id, line FROM qt GROUP BY doc_id, line HAVING bool_or(tok = 'is') AND bool_or({matches('*ing')})")(run_rows("is and *ing", False))
register("q_or_not", f"WITH {QT} SELECT doc_id, line FROM ql WHERE has_either AND NOT has_the")(run_rows("(thing OR nicht) AND NOT the"))
register("q_nor", f"WITH {QT} SELECT doc_id, line FROM ql WHERE NOT (has_the OR has_of)")(run_rows("the NOR of"))
register("q_phrase", f"WITH {QT} SELECT DISTINCT a.doc_id, a.line FROM qt a JOIN qt b ON a.doc_id = b.doc_id AND a.line = b.line WHERE b.i = a.i + 1 AND a.tok IN ('of', 'in') AND b.tok = 'the'")(run_rows('"of the" OR "in the"'))

FORMS = rf"""{pairs_sql("the", "th*", 3, True)},
form AS (SELECT DISTINCT doc_id, line, unnest([ta, tb]) AS f FROM pair), own AS (SELECT * FROM form WHERE f <> 'the'),
freq AS (SELECT f AS form, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM own GROUP BY f)"""


def fields(spark, sf_dir):
    """Rows of a search cut down to the forms of its field."""
    return Q.search(ctx(spark, sf_dir), "the NEAR/3 th*", node_patterns=["the"])


def frequencies(spark, sf_dir):
    rows = fields(spark, sf_dir).select("doc_id", F.explode_outer("forms").alias("form"))
    return rows.groupBy("form").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_docs"))


@register("g_search_forms", f"WITH {FORMS} SELECT *, round(n / CAST(sum(n) OVER () AS DOUBLE), 4) AS share FROM freq")
def g_search_forms(spark, sf_dir):
    return frequencies(spark, sf_dir).withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 4))


@register("g_search_docs", f"WITH {FORMS} SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, line FROM own) GROUP BY doc_id")
def g_search_docs(spark, sf_dir):
    return fields(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


INVENTORY = {"thi": ["thi*"], "tho": ["tho*", "the?"], "none": ["zzz*"]}


@register(
    "g_inventory",
    f"""WITH {FORMS}, inv AS (SELECT * FROM (VALUES {", ".join(f"('{k}', '{', '.join(v)}', '{'|'.join(literal(T.query_pattern(p)) for p in v)}')" for k, v in INVENTORY.items())}) t(label, patterns, rx))
SELECT label, patterns, coalesce(string_agg(form, ', ' ORDER BY form), '—') AS forms, count(form) AS n_forms, CAST(coalesce(sum(n), 0) AS BIGINT) AS n, CASE WHEN count(form) > 0 THEN 'sim' ELSE 'não' END AS attested FROM inv LEFT JOIN freq ON regexp_matches(form, rx) AND NOT {glued("form")} GROUP BY label, patterns""",
)
def g_inventory(spark, sf_dir):
    """The field's labels against the forms that the search found."""
    return inventory(frequencies(spark, sf_dir), INVENTORY)


def inventory(freq, field):
    """(label, patterns, forms, n_forms, n, attested) of a field over form frequencies (form, n)."""
    f = F.col("form")
    own = F.array_compact(F.array(*[F.when(Q.matches_any(f, ps), F.lit(k)) for k, ps in field.items()]))
    found = freq.select("form", "n", F.explode_outer(own).alias("label")).where("label is not null").groupBy("label").agg(F.array_join(F.array_sort(F.collect_set("form")), ", ").alias("forms"), F.count(F.lit(1)).alias("n_forms"), F.sum("n").alias("n"))
    labels = freq.sparkSession.createDataFrame([(k, ", ".join(v)) for k, v in field.items()], "label string, patterns string")
    out = labels.join(found, "label", "left")
    zero = F.lit(0).cast("long")
    return out.select("label", "patterns", F.coalesce("forms", F.lit("—")).alias("forms"), F.coalesce("n_forms", zero).alias("n_forms"), F.coalesce("n", zero).alias("n"), F.when(F.col("n_forms") > 0, "sim").otherwise("não").alias("attested"))


@register("g_search_pairs", f"WITH {FORMS} SELECT a.f AS form_a, b.f AS form_b, count(*) AS n FROM own a JOIN own b ON a.doc_id = b.doc_id AND a.line = b.line AND a.f < b.f GROUP BY ALL ORDER BY n DESC, form_a, form_b LIMIT 200")
def g_search_pairs(spark, sf_dir):
    """Forms that one row has together: the 200 most frequent pairs."""
    sets = fields(spark, sf_dir).select(F.array_sort(F.array_distinct("forms")).alias("f"))
    pairs = F.flatten(F.transform("f", lambda a, i: F.transform(F.slice(F.col("f"), i + 2, F.greatest(F.size("f") - i - 1, F.lit(0))), lambda b: F.struct(a.alias("form_a"), b.alias("form_b")))))
    rows = sets.select(F.explode_outer(pairs).alias("p")).where("p is not null")
    return rows.groupBy("p.form_a", "p.form_b").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "form_a", "form_b").limit(200)


@register(
    "g_search_summary",
    f"""WITH {FORMS}, h AS (SELECT round(sum(-p * ln(p)), 4) AS h, CASE WHEN count(*) > 1 THEN round(sum(-p * ln(p)) / ln(count(*)), 4) END AS j, count(*) AS forms FROM (SELECT n / CAST(sum(n) OVER () AS DOUBLE) AS p FROM freq))
SELECT h AS shannon, j AS pielou, forms, (SELECT quantile_cont(d, 0.5) FROM pair SEMI JOIN own USING (doc_id, line)) AS median_distance, (SELECT round(avg(d), 3) FROM pair SEMI JOIN own USING (doc_id, line)) AS mean_distance FROM h""",
)
def g_search_summary(spark, sf_dir):
    """Diversity of the forms found, and the distances they stand at."""
    p = frequencies(spark, sf_dir).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy()))
    h = p.agg(F.sum(-F.col("p") * F.ln("p")).alias("h"), F.count(F.lit(1)).alias("forms"))
    d = fields(spark, sf_dir).select(F.explode_outer("dists").alias("d")).agg(F.percentile("d", 0.5).alias("median_distance"), F.round(F.avg("d"), 3).alias("mean_distance"))
    out = h.join(F.broadcast(d), F.lit(True))  # one row each
    return out.select(F.round("h", 4).alias("shannon"), F.round(F.when(F.col("forms") > 1, F.col("h") / F.ln("forms")), 4).alias("pielou"), "forms", "median_distance", "mean_distance")


@register(
    "q_snippet",
    rf"""WITH {QT}, s AS (SELECT doc_id, line, greatest(min(i) - 12, 0) AS a, max(i) + 13 AS b FROM qt WHERE tok = 'nicht' GROUP BY ALL), w AS (SELECT s.doc_id, s.line, a, least(b, len(t)) AS b, t FROM s JOIN lists l ON s.doc_id = l.doc_id AND s.line = l.line)
SELECT doc_id, line, CASE WHEN a > 0 THEN '…' ELSE '' END || array_to_string(list_transform(range(a, b), lambda k: CASE WHEN t[k + 1] = 'nicht' AND (k = a OR t[k] <> 'nicht') THEN '«' ELSE '' END || t[k + 1] || CASE WHEN t[k + 1] = 'nicht' AND (k + 1 >= b OR t[k + 2] <> 'nicht') THEN '»' ELSE '' END), ' ') || CASE WHEN b < len(t) THEN '…' ELSE '' END AS snippet FROM w""",
)
def q_snippet(spark, sf_dir):
    found = Q.search(ctx(spark, sf_dir), "nicht")
    return long_line(found).select("doc_id", "line", Q.snippet(F.col("context"), F.col("tok"), F.col("spans")).alias("snippet"))


@register("q_labels", f"WITH {HITS}, l AS (SELECT doc_id, line, list(term) AS t FROM hits GROUP BY ALL) SELECT doc_id, line FROM l WHERE (list_contains(t, 'erble') OR list_contains(t, 'onin')) AND NOT list_contains(t, 'ther')")
def q_labels(spark, sf_dir):
    """Rows by the labels of their hits."""
    rows = hits(spark, sf_dir).groupBy("doc_id", "line").agg(F.collect_set("term").alias("t"))
    return long_line(rows.where(Q.label_query("(erble or onin) AND NOT ther", list(P.FIELD), F.col("t")))).select("doc_id", "line")

"""Excerpts, pages, sources and addresses over the driver's documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import appendix as E
from corvane.operators import biblio as B
from corvane.plans.base import AGREED, agreed, long_line, register, table
from corvane.plans.bibliography import WORKS, works

URLS = ["file:///E:/a%20b/T{0}.pdf", "file:///home/x%2By/T{0}.pdf", "C:\\Corpus\\sub\\T{0}.pdf", "plain {0}"]


def urls(i):
    return F.replace(F.element_at(F.array(*map(F.lit, URLS)), (i % 4 + 1).cast("int")), F.lit("{0}"), i.cast("string"))


@register("t_file_urls", r"""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'E:\a b\T' || doc_id || '.pdf' WHEN 1 THEN '/home/x+y/T' || doc_id || '.pdf' WHEN 2 THEN 'C:\Corpus\sub\T' || doc_id || '.pdf' ELSE 'plain ' || doc_id END AS path,
  CASE doc_id % 4 WHEN 0 THEN 'E:\a b\T' || doc_id || '.pdf' WHEN 1 THEN '/home/x+y/T' || doc_id || '.pdf' WHEN 2 THEN '/data/sub/T' || doc_id || '.pdf' ELSE 'plain ' || doc_id END AS moved FROM documents""")
def t_file_urls(spark, sf_dir):
    """File addresses as paths, and paths under another root."""
    u = urls(F.col("doc_id"))
    return table(spark, sf_dir, "documents").select("doc_id", E.file_path(u).alias("path"), E.moved(u, ["c:/corpus"], "/data").alias("moved"))


@register("t_pages", "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '12' WHEN 1 THEN '3–' || (doc_id + 4) WHEN 2 THEN 'x' ELSE CASE WHEN n_chars BETWEEN 1 AND 9999 THEN CAST(n_chars AS VARCHAR) END END AS page FROM documents")
def t_pages(spark, sf_dir):
    """Pages from the columns that may have them."""
    i = F.col("doc_id")
    page = F.when(i % 5 == 0, "p. 12").when(i % 5 == 1, F.concat(F.lit("pp. 3 – "), (i + 4).cast("string"))).when(i % 5 == 2, "x").when(i % 5 == 3, "—")
    return table(spark, sf_dir, "documents").select("doc_id", E.page_of(("pagina", page), ("n", F.col("n_chars"))).alias("page"))


@register("r_sources", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN doc_id || ' x. (n.d.).' WHEN 1 THEN 'A reference.' ELSE 'See https://doi.org/10.1000/x' END AS source FROM documents")
def r_sources(spark, sf_dir):
    i = F.col("doc_id")
    ref = F.when(i % 3 == 1, "A reference ").when(i % 3 == 2, "See https://doi.org/10.1000/x")
    return table(spark, sf_dir, "documents").select("doc_id", E.source(ref, F.concat(F.lit("d/"), i.cast("string"), F.lit("_x.pdf"))).alias("source"))


@register("g_appendix", f"WITH {AGREED} SELECT doc_id, line, idx, row_number() OVER (ORDER BY lower(form), form, source, context, doc_id, line, idx) AS place FROM agreed WHERE nuclear")
def g_appendix(spark, sf_dir):
    """The order of nuclear hits in an appendix grouped by form."""
    from corvane.operators.tables import settle

    h = settle(agreed(spark, sf_dir).where("nuclear").select("doc_id", "line", "idx", "form", "source", "context"), "nuclear")
    return long_line(E.ordered(h, "form", "source")).select("doc_id", "line", "idx", "place")


@register("t_excerpts")
def t_excerpts(spark, sf_dir):
    """Excerpts of hits, and what to look for in a file to find them."""
    h = agreed(spark, sf_dir)
    return long_line(h).select("doc_id", "line", "idx", E.excerpt(F.col("context"), F.lit(""), F.col("form"), F.col("node")).alias("excerpt"), E.probes(F.col("context")).alias("probes"))


@register("g_report", f"WITH {WORKS} SELECT 'kind' AS measure, tipo AS key, count(*) AS n FROM works GROUP BY tipo UNION ALL SELECT 'with_link', '', count(*) FILTER (doi_ou_url <> '') FROM works UNION ALL SELECT 'complete', '', count(*) FILTER (tipo <> 'desconhecido' AND titulo <> '' AND autores <> '' AND (tipo <> 'artigo' OR contentor <> '' OR doi_ou_url <> '')) FROM works")
def g_report(spark, sf_dir):
    """A text report's counts of a bibliography, from one pass over it."""
    w = works(spark, sf_dir)
    row = lambda m, k: F.struct(F.lit(m).alias("measure"), k.alias("key"))
    rows = w.select(F.explode(F.array_compact(F.array(row("kind", F.col("tipo")), F.when(F.col("doi_ou_url") != "", row("with_link", F.lit(""))), F.when(B.is_complete(w), row("complete", F.lit("")))))).alias("r"))
    return rows.groupBy("r.measure", "r.key").agg(F.count(F.lit(1)).alias("n"))

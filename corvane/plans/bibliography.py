"""Bibliographic fields over the driver's pages, and citations over works made of its documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import biblio as B
from corvane.plans.base import AGREED, agreed, literal, register, table, file_path

ENTITIES = "replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"
TITLE = "trim(regexp_replace(regexp_replace(" + ENTITIES.format(r"regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)") + r", '<[^>]+>', '', 'g'), '\s+', ' ', 'g'))"


@register("t_html", r"SELECT page_id, " + ENTITIES.format(r"trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g'))") + r""" AS title,
  lower(regexp_extract(html, '(10\.[0-9]{4,9}/[^\s"<>]+)', 1)) AS doi, regexp_extract(html, '\b((?:1[5-9]|20)[0-9]{2})\b', 1) AS year FROM pages""")
def t_html(spark, sf_dir):
    html = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", T.html_title(html).alias("title"), T.doi(html).alias("doi"), T.year(html).alias("year"))


def tag(name: str) -> str:
    return f"""coalesce(nullif(trim(regexp_extract(page, '(?i)<meta[^>]+(?:name|property)\\s*=\\s*["'']{name}["''][^>]+content\\s*=\\s*["'']([^"'']+)["'']', 1)), ''), '')"""


@register("r_pages", f"""WITH p AS (SELECT page_id, {TITLE} AS own, CASE WHEN page_id % 3 = 0 THEN '<meta name="citation_author" content="Ana Maria Silva"><meta content="Vol" name="citation_journal_title"><meta name="citation_volume" content="7"><meta name="citation_date" content="2001/05">' ELSE '' END || html AS page, url FROM pages)
SELECT page_id, own AS title, CASE WHEN page_id % 3 = 0 THEN 'Silva, A. M.' ELSE '' END AS authors, {tag("citation_volume")} AS volume, regexp_extract({tag("citation_date")}, '((?:19|20)[0-9]{{2}})', 1) AS year, CASE WHEN page_id % 3 = 0 THEN 'Vol' ELSE '' END AS container, CASE WHEN page_id % 3 = 0 THEN 'journal-article' ELSE 'webpage' END AS kind FROM p""")
def r_pages(spark, sf_dir):
    """What the heads of pages say; every third page is given meta tags."""
    tags = '<meta name="citation_author" content="Ana Maria Silva"><meta content="Vol" name="citation_journal_title"><meta name="citation_volume" content="7"><meta name="citation_date" content="2001/05">'
    pages = table(spark, sf_dir, "pages").withColumn("html", F.concat(F.when(F.col("page_id") % 3 == 0, tags).otherwise(""), F.col("html")))
    return B.parse_html(pages).select("page_id", "title", F.array_join("authors", "; ").alias("authors"), "volume", "year", "container", "kind")


SMALL = ", ".join(f"'{w}'" for w in B.SMALL)
CAPITAL = "CASE substr(w, 1, 1) WHEN 'ß' THEN 'SS' ELSE upper(substr(w, 1, 1)) END"  # DuckDB has a capital for it
WORD = f"CASE WHEN regexp_matches(w, '^\\p{{Lu}}{{2,5}}$') THEN w WHEN i = 1 THEN {CAPITAL} || lower(substr(w, 2)) ELSE lower(w) END"


@register("r_titles", f"""WITH t AS (SELECT page_id, {TITLE} || CASE WHEN page_id % 2 = 0 THEN ': the DNA OF a Text' ELSE '' END AS t FROM pages),
parts AS (SELECT page_id, k, regexp_split_to_array(trim(p[k]), ' ') AS w, k > 1 AND starts_with(p[k], ' ') AS spaced FROM (SELECT page_id, string_split(t, ':') AS p FROM t), unnest(range(1, len(p) + 1)) AS u(k)),
cased AS (SELECT page_id, k, CASE WHEN spaced THEN ' ' ELSE '' END || array_to_string(list_transform(w, lambda w, i: {WORD}), ' ') AS s FROM parts)
SELECT t.page_id, string_agg(s, ':' ORDER BY k) AS sentence, array_to_string(list_transform(string_split(any_value(t), ' '), lambda w, i: CASE WHEN i > 1 AND lower(w) IN ({SMALL}) THEN lower(w) ELSE {CAPITAL} || substr(w, 2) END), ' ') AS headline FROM cased JOIN t USING (page_id) GROUP BY t.page_id""")
def r_titles(spark, sf_dir):
    """Titles in sentence case, with subtitles and acronyms, and in title case."""
    t = B.parse_html(table(spark, sf_dir, "pages").select("page_id", "html", "url")).select("page_id", F.concat("title", F.when(F.col("page_id") % 2 == 0, ": the DNA OF a Text").otherwise("")).alias("t"))
    return t.select("page_id", B.sentence_case(F.col("t")).alias("sentence"), B.title_case(F.col("t")).alias("headline"))


@register("r_page_references", f"""WITH t AS (SELECT page_id, url, {TITLE} AS t FROM pages) SELECT page_id, {CAPITAL.replace('w', 't')} || lower(substr(t, 2)) || '. (n.d.). ' || url AS reference FROM t WHERE NOT regexp_matches(t, ':') AND NOT regexp_matches(t, '(^| )\\p{{Lu}}{{2,5}}( |$)')""")
def r_page_references(spark, sf_dir):
    """References of pages, which have a title and an address."""
    pages = B.parse_html(table(spark, sf_dir, "pages").select("page_id", "html", "url")).withColumn("doi", F.lit(""))
    rows = pages.select("page_id", F.col("title").alias("t"), B.reference(pages).alias("reference"))
    return rows.where(~F.col("t").rlike(":") & ~F.col("t").rlike(r"(^| )\p{Lu}{2,5}( |$)")).select("page_id", "reference")


AUTHORS = ["", "Silva, A.", "Silva, A.; Costa, B.", "Ávila, C.; Silva, A.; Costa, B."]
KINDS = ["artigo", "livro", "capitulo", "tese", "desconhecido"]


def works(spark, sf_dir):
    """Works made of documents: their fields follow from doc_id, titles from texts."""
    i = F.col("doc_id")
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (by + 1).cast("int"))
    some = lambda n, value: F.when(i % n == 0, "").otherwise(value)
    title = F.trim(F.regexp_replace(F.substring(F.coalesce("text", F.lit("")), 1, 24), r"[^A-Za-z]+", " "))
    out = table(spark, sf_dir, "documents").select(
        "doc_id",
        file_path().alias("path"),
        pick(AUTHORS, i % 4).alias("autores"),
        some(7, (1990 + i % 3).cast("string")).alias("ano"),
        title.alias("titulo"),
        pick(KINDS, i % 5).alias("tipo"),
        some(3, F.lit("Revista")).alias("contentor"),
        some(2, F.lit("4")).alias("volume"),
        some(4, F.lit("2")).alias("numero"),
        some(9, F.lit("1–9")).alias("paginas"),
        some(11, F.lit("Press")).alias("editora"),
        F.when(i % 6 == 0, "10.1000/x").otherwise("").alias("doi_ou_url"),
        some(8, F.lit("2nd ed.")).alias("edicao"),
    )
    return out


def pick_sql(values, by: str) -> str:
    return "([" + ", ".join(f"'{v}'" for v in values) + f"])[{by} + 1]"


def some_sql(n: int, value: str) -> str:
    return f"CASE WHEN doc_id % {n} = 0 THEN '' ELSE {value} END"


WORKS = f"""works AS (SELECT doc_id, source || '/' || doc_id || '.txt' AS path, {pick_sql(AUTHORS, "doc_id % 4")} AS autores, {some_sql(7, "CAST(1990 + doc_id % 3 AS VARCHAR)")} AS ano, trim(regexp_replace(substr(coalesce(text, ''), 1, 24), '[^A-Za-z]+', ' ', 'g')) AS titulo, {pick_sql(KINDS, "doc_id % 5")} AS tipo,
  {some_sql(3, "'Revista'")} AS contentor, {some_sql(2, "'4'")} AS volume, {some_sql(4, "'2'")} AS numero, {some_sql(9, "'1–9'")} AS paginas, {some_sql(11, "'Press'")} AS editora, CASE WHEN doc_id % 6 = 0 THEN '10.1000/x' ELSE '' END AS doi_ou_url, {some_sql(8, "'2nd ed.'")} AS edicao FROM documents)"""
WHO = "CASE doc_id % 4 WHEN 0 THEN '' WHEN 3 THEN 'Ávila' ELSE 'Silva' END"
SUFFIXED = f"""{WORKS}, s AS (SELECT *, {WHO} AS who, coalesce(nullif(ano, ''), 'n.d.') AS y, lower(coalesce(nullif(titulo, ''), path)) AS tk FROM works),
u AS (SELECT *, CASE WHEN who = '' AND y = 'n.d.' THEN '' WHEN count(*) OVER (PARTITION BY who, y) > 1 THEN chr(CAST(96 + row_number() OVER (PARTITION BY who, y ORDER BY tk, doc_id) AS INTEGER)) ELSE '' END AS suffix FROM s)"""


@register("r_citations", f"WITH {SUFFIXED} SELECT doc_id, suffix, CASE doc_id % 4 WHEN 0 THEN '(Autor desconhecido, ' || y || suffix || ')' WHEN 1 THEN 'Silva, ' || y || suffix WHEN 2 THEN 'Silva & Costa, ' || y || suffix ELSE 'Ávila et al., ' || y || suffix END AS citation FROM u")
def r_citations(spark, sf_dir):
    """Short citations with the letters that tell works of one name and year apart."""
    d = B.with_year_suffixes(works(spark, sf_dir))
    return d.select("doc_id", "suffix", B.short_citation(F.col("autores"), F.col("ano"), F.col("suffix")).alias("citation"))


def closed_sql(s: str) -> str:
    return f"CASE WHEN regexp_matches({s}, '[.!?/»\"]$') THEN {s} ELSE {s} || '.' END"


def ends_sql(s: str) -> str:
    return f"CASE WHEN doi_ou_url <> '' THEN {s} || '.' ELSE {closed_sql(s)} END"


IN = "'In *' || contentor || '*' || CASE WHEN paginas <> '' THEN ' (pp. 1-9)' ELSE '' END"
BOOK = "'*' || titulo || '*' || CASE WHEN edicao <> '' THEN ' (' || edicao || ')' ELSE '' END"
NUMBER = "CASE WHEN numero <> '' THEN '(' || numero || ')' ELSE '' END || CASE WHEN paginas <> '' THEN ', 1-9' ELSE '' END"
MORE = "(editora <> '' OR doi_ou_url <> '')"
BODY = f"""CASE tipo
 WHEN 'artigo' THEN concat_ws(' ', CASE WHEN titulo <> '' THEN {closed_sql("titulo")} END, CASE WHEN contentor <> '' AND volume <> '' THEN {ends_sql("('*Revista, 4*' || " + NUMBER + ")")} WHEN contentor <> '' THEN {ends_sql("'*Revista*'")} END)
 WHEN 'livro' THEN concat_ws(' ', CASE WHEN titulo <> '' THEN CASE WHEN {MORE} THEN {BOOK} || '.' ELSE {closed_sql("(" + BOOK + ")")} END END, CASE WHEN editora <> '' THEN {ends_sql("editora")} END)
 WHEN 'capitulo' THEN concat_ws(' ', CASE WHEN titulo <> '' THEN {closed_sql("titulo")} END, CASE WHEN contentor <> '' THEN CASE WHEN {MORE} THEN {IN} || '.' ELSE {closed_sql("(" + IN + ")")} END END, CASE WHEN editora <> '' THEN {ends_sql("editora")} END)
 WHEN 'tese' THEN CASE WHEN titulo <> '' THEN '*' || titulo || '* ' || CASE WHEN editora <> '' THEN '[Doctoral dissertation, Press].' ELSE '[Doctoral dissertation].' END WHEN editora <> '' THEN '[Doctoral dissertation, Press].' END
 ELSE CASE WHEN titulo <> '' THEN {ends_sql("titulo")} ELSE {closed_sql("CAST(doc_id AS VARCHAR)")} END END"""


@register("r_references", f"""WITH {WORKS}, b AS (SELECT *, trim(concat_ws(' ', coalesce(nullif(autores, ''), 'Autor desconhecido') || ' (' || coalesce(nullif(ano, ''), 'n.d.') || ').', nullif(trim({BODY}), ''))) AS w FROM works)
SELECT doc_id, CASE WHEN doi_ou_url <> '' THEN CASE WHEN w LIKE '%.' THEN w ELSE {closed_sql("w")} END || ' https://doi.org/' || doi_ou_url ELSE {closed_sql("w")} END AS reference,
  tipo <> 'desconhecido' AND titulo <> '' AND autores <> '' AND (tipo <> 'artigo' OR contentor <> '' OR doi_ou_url <> '') AS complete FROM b""")
def r_references(spark, sf_dir):
    """APA 7 references by kind of work, and whether they are complete."""
    d = works(spark, sf_dir)
    return d.select("doc_id", B.draft_reference(d).alias("reference"), B.is_complete(d).alias("complete"))


@register("r_sorted", f"WITH {WORKS} SELECT doc_id, row_number() OVER (ORDER BY CASE doc_id % 4 WHEN 0 THEN lower(titulo) WHEN 3 THEN 'avila' ELSE 'silva' END, coalesce(nullif(ano, ''), '9999'), lower(titulo), doc_id) AS place FROM works")
def r_sorted(spark, sf_dir):
    """The places of works in a reference list."""
    from corvane.operators.tables import numbered

    keyed = B.reference_list(works(spark, sf_dir)).select("doc_id", F.struct("author_key", "year_key", "title_key", "doc_id").alias("key"))
    return numbered(keyed, "key", "place").select("doc_id", "place")


@register("r_duplicates", f"WITH {WORKS} SELECT doc_id, CASE WHEN autores <> '' AND ano <> '' AND titulo <> '' AND min(doc_id) OVER w <> doc_id THEN CAST(min(doc_id) OVER w AS VARCHAR) ELSE '' END AS duplicado_de FROM works WINDOW w AS (PARTITION BY autores, ano, lower(titulo))")
def r_duplicates(spark, sf_dir):
    """Works of the same authors, year and title."""
    return B.with_duplicates(works(spark, sf_dir)).select("doc_id", "duplicado_de")


@register("r_file_names", r"""WITH f AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Silva_2001_' || source WHEN 1 THEN 'Silva_Bento_1999_on_' || source ELSE source || '_1987' END || '.pdf' AS name FROM documents)
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Silva, A.' WHEN 1 THEN 'Silva, B.' ELSE '' END AS author, regexp_extract(name, '((?:19|20)[0-9]{2})', 1) AS year, CASE doc_id % 3 WHEN 0 THEN regexp_extract(name, '2001_(.*)[.]pdf', 1) WHEN 1 THEN 'on ' || regexp_extract(name, 'on_(.*)[.]pdf', 1) ELSE replace(replace(name, '.pdf', ''), '_', ' ') END AS title FROM f""")
def r_file_names(spark, sf_dir):
    """Author, year and title from file names."""
    m = F.col("doc_id") % 3
    name = F.concat(F.when(m == 0, F.concat(F.lit("Silva_2001_"), "source")).when(m == 1, F.concat(F.lit("Silva_Bento_1999_on_"), "source")).otherwise(F.concat("source", F.lit("_1987"))), F.lit(".pdf"))
    return table(spark, sf_dir, "documents").select("doc_id", B.from_file_name(name).alias("f")).select("doc_id", "f.*")


def kinds_sql(blob: str) -> str:
    tests = []
    for name, rx in B.KINDS:
        rx = rx.replace("(?iu)", "(?i)").replace("(?<![a-z])tese(?![a-z])", "(?:^|[^a-z])tese(?:[^a-z]|$)")
        tests.append(f"WHEN regexp_matches({blob}, '{literal(rx)}') THEN '{name}'")
    return "CASE " + " ".join(tests) + " ELSE 'desconhecido' END"


@register("r_kinds", f"SELECT doc_id, {kinds_sql('doc_id || chr(46) || chr(116) || chr(120) || chr(116) || chr(10) || text')} AS kind, regexp_extract(text, '(?i)\\b(?:vol\\.?|volume)\\s*([0-9]+[A-Za-z]?)\\b', 1) AS volume, regexp_extract(text, '\\b((?:19|20)[0-9]{{2}})\\b', 1) AS year FROM documents WHERE text IS NOT NULL")
def r_kinds(spark, sf_dir):
    """What documents would be as works, and the volume and year that they name."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", B.kind(file_path(), t).alias("kind"), B.volume(t).alias("volume"), B.year(t).alias("year"))


@register("g_inventory_works", f"WITH {AGREED}, p AS (SELECT source AS doc_key, source || '/' || doc_id || '.txt' AS path, count(*) AS n, count(*) FILTER (nuclear) AS yes FROM agreed GROUP BY ALL) SELECT doc_key, arg_min(path, struct_pack(n := -n, p := path)) AS path, CAST(sum(n) AS BIGINT) AS n_hits, CAST(sum(yes) AS BIGINT) AS n_nuclear FROM p GROUP BY doc_key")
def g_inventory_works(spark, sf_dir):
    """Of each source its most frequent path, hits and nuclear hits."""
    return B.inventory(agreed(spark, sf_dir), file_path(), F.col("source")).drop("kind")


@register("d_unique_works", "SELECT key, min(page_id) AS page_id FROM (SELECT page_id, regexp_replace(regexp_extract(lower(url), '([^/\\\\]*)$', 1), '[.][^.]*$', '') AS k, lower(url) AS u, coalesce(nullif(k, ''), u) AS key FROM pages) WHERE key <> '' GROUP BY key")
def d_unique_works(spark, sf_dir):
    """Pages that stand for one work by the end of their address, the first of each."""
    p = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("path"), "url")
    return B.unique_works(p, order="page_id").select("key", "page_id")


@register("r_draft")
def r_draft(spark, sf_dir):
    """A bibliography with the evidence of each field, from documents' texts and made-up paths."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    path = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("(2001)_"), F.substring(F.regexp_replace("text", "[^A-Za-z]+", "_"), 1, 20), F.lit(".pdf"))).otherwise(file_path())
    none = F.lit(None).cast("string")
    return B.draft(docs.select("doc_id", path.alias("path"), F.col("text").alias("page1"), none.alias("footer"), none.alias("meta_title"), none.alias("meta_author")))

"""Bibliography: fields from page text, HTML and file names, each with its evidence; citations and APA 7 references.

Everything is a Column expression over stored text; nothing is fetched.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators.contexts import let

# Patterns that tell kinds of works, in order, and fields of citations.
GROVE = r"(?iu)grove\s+music\s+online|oxford\s+music\s+online"
THESIS = r"(?iu)thesis|dissertation|doutoramento|doutorado|(?<![a-z])tese(?![a-z])|ph\.?\s*d\.?|m\.?\s*phil|mestrado|master'?s\s+thesis"
PROCEEDINGS = r"(?iu)proceedings|actas|atas|conference|symposium|congresso|colloquium|workshop"
ARTICLE = r"(?iu)journal|revista|article|artigo|vol\.?\s*[0-9]|pp\.?\s*[0-9]"
BOOK = r"(?iu)oxford\s+university\s+press|cambridge\s+university\s+press|routledge|springer|handbook|edited\s+by"
KINDS = [("grove", GROVE), ("tese", THESIS), ("actas", PROCEEDINGS), ("artigo", ARTICLE), ("livro", BOOK)]
DOI = r"(?i)\b(10\.[0-9]{4,9}/[-._;()/:A-Z0-9]+)\b"
DOI_URL = r"(?i)https?://(?:dx\.)?doi\.org/(10\.[0-9]{4,9}/[-._;()/:A-Z0-9]+)"
YEAR = r"\b((?:19|20)[0-9]{2})\b"
VOLUME = r"(?iu)\b(?:vol\.?|volume)\s*([0-9]+[A-Za-z]?)\b"
ISSUE = r"(?iu)\b(?:no\.?|n[ºo]\.?|number|issue)\s*([0-9]+)\b"
PAGES = r"(?iu)\bpp?\.\s*([0-9]+\s*[-–—]\s*[0-9]+)\b"
DATED_FILE = r"(?i)^\(((?:19|20)[0-9]{2})\)_(.+?)$"
JOURNAL = r"(?imu)^([A-ZÀ-Ý][^,\n]{2,80}?),\s*(?:Vol\.?\s*([0-9]+)(?:,\s*)?)?(?:No\.?\s*([0-9]+)(?:,\s*)?)?(?:pp?\.?\s*([0-9]+\s*[-–—]\s*[0-9]+)(?:,\s*)?)?((?:19|20)[0-9]{2})?\s*$"
GROVE_DATE = r"(?iu)(?:article\s+published\s+online|published\s+online|last\s+updated|revised)\s*:?\s*(?:[0-9]{1,2}\s+)?[A-Za-zç]+\s+((?:19|20)[0-9]{2})"
AUTHOR_LINE = r"(?u)^([A-ZÀ-Ý][\wÀ-ÿ'’\-]+,\s*[A-ZÀ-Ý](?:\.\s*[A-ZÀ-Ý]\.)*)\s*$"
JUNK = ["microsoft word", "document1", "untitled", "scanner", "adobe pdf", "full text", "downloaded", "admin", "user"]
SMALL = "a an the and but or for nor on at to from by of in with as".split()
FIELDS = "autores ano titulo tipo contentor volume numero paginas editora doi_ou_url edicao".split()
EVIDENCE = "pdf_meta pagina1 rodape nome_ficheiro manifesto doi_org vazio".split()
STRONG = "pagina1 rodape manifesto doi_org".split()


def text(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit(""))


def blank(c: Column) -> Column:
    """Null where there is nothing."""
    return F.when(text(c) != "", F.trim(c))


def doi(value: Column) -> Column:
    """A DOI from its address, else from the text; marks that end a sentence are no part of it."""
    found = F.coalesce(blank(F.regexp_extract(value, DOI_URL, 1)), blank(F.regexp_extract(value, DOI, 1)), F.lit(""))
    return F.regexp_replace(found, r"[).,;]+$", "")


def year(value: Column) -> Column:
    return F.regexp_extract(value, YEAR, 1)


def volume(value: Column) -> Column:
    return F.regexp_extract(value, VOLUME, 1)


def issue(value: Column) -> Column:
    return F.regexp_extract(value, ISSUE, 1)


def pages(value: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(value, PAGES, 1), "[—–]", "-")


def journal_line(value: Column) -> Column:
    """struct(journal, volume, issue, pages, year) of a line like a journal's."""
    group = lambda i: F.regexp_extract(value, JOURNAL, i)
    return F.struct(F.trim(group(1)).alias("journal"), group(2).alias("volume"), group(3).alias("issue"), F.regexp_replace(group(4), "[—–]", "-").alias("pages"), group(5).alias("year"))


def kind(path: Column, page: Column | None = None) -> Column:
    """What a work probably is, by the first pattern found in its file name or first page."""
    blob = F.concat_ws("\n", T.basename(path), page if page is not None else F.lit(""))
    out = None
    for name, rx in KINDS:
        out = F.when(blob.rlike(rx), name) if out is None else out.when(blob.rlike(rx), name)
    return out.otherwise("desconhecido")


def sentence_case(title: Column) -> Column:
    """The first word of title and subtitles with a capital, short words all in capitals as they are, the rest small."""
    clean = F.trim(F.regexp_replace(F.coalesce(title, F.lit("")), r"\s+", " "))

    def word(w, i):
        first = F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 20)))
        return F.when(w.rlike(r"^\p{Lu}{2,5}$"), w).when(i == 0, first).otherwise(F.lower(w))

    def part(p, i):
        lead = F.when((i > 0) & p.startswith(" "), " ").otherwise("")
        return F.concat(lead, F.array_join(F.transform(F.split(F.trim(p), " "), word), " "))

    return F.array_join(F.transform(F.split(clean, ":"), part), ":")


def title_case(name: Column) -> Column:
    """A periodical's name: small words small, others with a capital, except that the first word always has one."""
    words = F.split(F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"\s+", " ")), " ")
    return F.array_join(F.transform(words, lambda w, i: F.when((i > 0) & F.lower(w).isin(SMALL), F.lower(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20)))), " ")


def initialled(name: Column) -> Column:
    """``Given Family`` as ``Family, G.``; a single name as it is."""
    words = F.array_remove(F.split(F.translate(F.trim(name), ",", " "), r"\s+"), "")
    initials = F.array_join(F.transform(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lit("."))), " ")
    return F.when(F.size(words) >= 2, F.concat(F.element_at(words, -1), F.lit(", "), initials)).otherwise(F.trim(name))


def family_initials(family: Column, given: Column, name: Column) -> Column:
    """``Family, G. H.`` from the parts of a name; without a family, what there is."""
    parts = F.filter(F.split(text(given), r"[\s\-]+"), lambda p: p.rlike(r"^\p{L}"))
    initials = F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lit("."))), " ")
    whole = F.regexp_replace(F.trim(F.concat(text(family), F.lit(", "), initials)), ",$", "")
    return F.when((text(family) == "") & (text(given) != ""), text(given)).when(text(family) == "", text(name)).otherwise(whole)


def join_authors(names: Column) -> Column:
    """Authors as APA 7 joins them: an ampersand before the last, and 19, an ellipsis and the last of over 20."""
    own = F.filter(F.transform(names, lambda n: F.trim(n)), lambda n: n != "")

    def join(a):
        n, last = F.size(a), F.element_at(a, -1)
        return F.when(n == 0, "").when(n == 1, a[0]).when(n <= 20, F.concat(F.array_join(F.slice(a, 1, n - 1), ", "), F.lit(", & "), last)).otherwise(F.concat(F.array_join(F.slice(a, 1, 19), ", "), F.lit(", … "), last))

    return let(F.coalesce(own, F.array().cast("array<string>")), join)


def meta(html: Column, *names: str) -> Column:
    """The content of the first of some meta tags, with its attributes in either order."""
    found = []
    for n in names:
        key = rf"""(?:name|property)\s*=\s*["']{re.escape(n)}["']"""
        content = r"""content\s*=\s*["']([^"']+)["']"""
        found += [blank(F.regexp_extract(html, rf"(?i)<meta[^>]+{key}[^>]+{content}", 1)), blank(F.regexp_extract(html, rf"(?i)<meta[^>]+{content}[^>]+{key}", 1))]
    return F.coalesce(*found, F.lit(""))


def all_meta(html: Column, name: str) -> Column:
    rx = rf"""(?i)<meta[^>]+(?:name|property)\s*=\s*["']{re.escape(name)}["'][^>]+content\s*=\s*["']([^"']+)["']"""
    return F.filter(F.transform(F.regexp_extract_all(html, F.lit(rx), F.lit(1)), lambda v: F.trim(v)), lambda v: v != "")


def parse_html(df: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """df with what a page's head says of its work: title, authors, year, container, volume, issue, pages, doi, publisher, kind."""
    h = F.col(html)
    get = lambda *names: T.unescape(meta(h, *names))
    raw = F.regexp_extract(h, r"(?is)<title[^>]*>(.*?)</title>", 1)
    title = F.trim(F.regexp_replace(F.regexp_replace(T.unescape(raw), "<[^>]+>", ""), r"\s+", " "))
    authors = F.when(F.size(all_meta(h, "citation_author")) > 0, all_meta(h, "citation_author")).otherwise(all_meta(h, "dc.creator"))
    date = get("citation_publication_date", "citation_date", "dc.date")
    first, last = get("citation_firstpage"), get("citation_lastpage")
    container = get("citation_journal_title", "og:site_name", "dc.publisher")
    return df.withColumns(
        {
            "title": F.coalesce(blank(get("citation_title", "dc.title", "DC.Title", "og:title")), title),
            "authors": F.transform(authors, lambda a: initialled(T.unescape(a))),
            "year": F.coalesce(blank(year(date)), F.when(date.rlike("^[0-9]{4}"), F.substring(date, 1, 4)), F.lit("")),
            "container": container,
            "volume": get("citation_volume"),
            "issue": get("citation_issue"),
            "pages": F.when((first != "") & (last != ""), F.concat(first, F.lit("–"), last)).otherwise(first),
            "publisher": get("citation_publisher", "dc.publisher"),
            "doi": F.coalesce(blank(doi(get("citation_doi", "dc.identifier"))), blank(doi(F.substring(h, 1, 8000))), F.lit("")),
            "kind": F.when(container != "", "journal-article").otherwise("webpage"),
            "found_in": F.lit("html"),
        }
    )


CROSSREF = "struct<author:array<struct<family:string,given:string,name:string>>,title:array<string>,`container-title`:array<string>,volume:string,issue:string,page:string,publisher:string,type:string,`published-print`:struct<`date-parts`:array<array<int>>>,`published-online`:struct<`date-parts`:array<array<int>>>,issued:struct<`date-parts`:array<array<int>>>,created:struct<`date-parts`:array<array<int>>>>"
CROSSREF_KINDS = {"journal-article": "journal-article", "proceedings-article": "proceedings-article", "book-chapter": "book-chapter", "book": "book", "monograph": "book", "edited-book": "book", "dissertation": "dissertation", "report": "report", "posted-content": "webpage"}


def parse_crossref(df: DataFrame, column: str = "json") -> DataFrame:
    """df with the same fields from stored Crossref answers; they are null where the answer is no JSON."""
    m = F.from_json(F.col(column), f"message {CROSSREF}")["message"]
    dates = [m[k]["date-parts"][0][0] for k in ("published-print", "published-online", "issued", "created")]
    container = F.coalesce(F.get(m["container-title"], F.lit(0)), F.lit(""))
    named = F.create_map(*[F.lit(x) for kv in CROSSREF_KINDS.items() for x in kv])
    authors = F.filter(F.transform(m["author"], lambda a: family_initials(a["family"], a["given"], a["name"])), lambda a: a != "")
    return df.withColumns(
        {
            "title": F.coalesce(F.get(m["title"], F.lit(0)), F.lit("")),
            "authors": F.coalesce(authors, F.array().cast("array<string>")),
            "year": F.coalesce(*[d.cast("string") for d in dates], F.lit("")),
            "container": container,
            "volume": F.coalesce(m["volume"], F.lit("")),
            "issue": F.coalesce(m["issue"], F.lit("")),
            "pages": F.translate(F.coalesce(m["page"], F.lit("")), "-", "–"),
            "publisher": text(m["publisher"]),
            "kind": F.coalesce(named[F.lower(m["type"])], F.when(container != "", "journal-article").otherwise("book")),
            "found_in": F.lit("crossref"),
        }
    )


def from_file_name(path: Column) -> Column:
    """struct(author, year, title) of a name like Surname_Year_Title; else the whole name is the title."""
    stem = F.regexp_replace(T.basename(F.regexp_replace(path, r"\?.*$", "")), r"\.[^.]*$", "")
    label = F.trim(F.regexp_replace(F.url_decode(F.regexp_replace(stem, r"\+|%(?![0-9A-Fa-f]{2})", "_")), "[_-]", " "))
    rx = r"^([A-ZÁÉÍÓÚÄËÏÖÜ][\w'’]+)(?:\s+([A-Z][\w'’]+))?\s+([0-9]{4})\s+(.+)$"
    one, two = F.regexp_extract(label, rx, 1), F.regexp_extract(label, rx, 2)
    initial = F.when((two != "") & ~F.lower(two).isin("and", "e"), F.substring(two, 1, 1)).otherwise("A")
    hit = one != ""
    return F.struct(
        F.when(hit, F.concat(one, F.lit(", "), initial, F.lit("."))).otherwise("").alias("author"),
        F.when(hit, F.regexp_extract(label, rx, 3)).otherwise(year(label)).alias("year"),
        F.when(hit, F.regexp_extract(label, rx, 4)).otherwise(label).alias("title"),
    )


def reference(df: DataFrame) -> Column:
    """An APA 7 reference of fields as parse_html and parse_crossref name them; ``*`` marks italics."""
    c = lambda n: text(F.col(n)) if n in df.columns else F.lit("")
    authors, yr, kind_ = join_authors(F.col("authors")), F.coalesce(blank(c("year")), F.lit("n.d.")), F.lower(c("kind"))
    title, place = sentence_case(c("title")), c("container")
    ital = lambda s: F.concat(F.lit("*"), s, F.lit("*"))
    dot = lambda s: F.concat(s, F.lit("."))
    journal, chapter, book = kind_.isin("journal-article", "article", "proceedings-article"), kind_.isin("book-chapter", "chapter"), kind_.isin("book", "monograph", "report", "dissertation", "pdf")
    when = F.concat(F.lit("("), yr, F.lit(")."))
    head = F.when(authors != "", F.concat(authors, F.lit(" "), when)).when(title == "", when).when(kind_.isin("book", "report", "pdf"), F.concat(ital(title), F.lit(". "), when)).otherwise(F.concat(title, F.lit(". "), when))
    second = F.when((authors == "") | (title == ""), None).when(book, dot(ital(title))).otherwise(dot(title))
    range_ = F.translate(c("pages"), "-", "–")
    number = F.when(c("volume") != "", F.concat(F.lit(", "), ital(c("volume")), F.when(c("issue") != "", F.concat(F.lit("("), c("issue"), F.lit(")"))).otherwise(""))).otherwise("")
    in_journal = F.when(place != "", F.concat(ital(title_case(place)), number, F.when(range_ != "", F.concat(F.lit(", "), range_)).otherwise(""), F.lit(".")))
    in_book = F.when(place != "", F.concat(F.lit("In "), ital(sentence_case(place)), F.when(range_ != "", F.concat(F.lit(" (pp. "), range_, F.lit(")"))).otherwise(""), F.lit(".")))
    by = F.when(c("publisher") != "", dot(c("publisher")))
    third = F.when(journal, in_journal).when(chapter, in_book).when(book, by).when(kind_.isin("webpage", "web") & (place != ""), dot(place))
    number_ = F.regexp_replace(c("doi"), "(?i)^https://doi.org/", "")
    link = F.when(number_ != "", F.concat(F.lit("https://doi.org/"), number_)).when((c("url") != "") & ~F.lower(c("url")).startswith("file:"), c("url"))
    out = F.concat_ws(" ", head, second, third, F.when(chapter, by), link)
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def compared(value: Column) -> Column:
    """Small letters, single blanks, no punctuation."""
    return F.regexp_replace(F.regexp_replace(F.lower(text(value)), r"\s+", " "), r"[^\p{L}\p{N}_\s]", "")


def sort_key(value: Column) -> Column:
    """Small letters without diacritics."""
    return F.translate(F.lower(text(value)), *folded_letters())


def folded_letters() -> tuple[str, str]:
    """Letters with diacritics and what they are without, by canonical decomposition."""
    import unicodedata

    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x250) if len(unicodedata.normalize("NFD", chr(c))) > 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def authors_of(value: Column) -> Column:
    return F.filter(F.split(text(value), r"\s*;\s*"), lambda a: F.trim(a) != "")


def surname(author: Column) -> Column:
    return F.when(author.contains(","), F.trim(F.substring_index(author, ",", 1))).otherwise(F.element_at(F.split(F.trim(author), r"\s+"), -1))


def short_citation(authors: Column, yr: Column, suffix: Column | None = None) -> Column:
    """One surname, two with an ampersand, or the first et al., and the year."""
    y = F.concat(F.coalesce(blank(yr), F.lit("n.d.")), F.coalesce(suffix, F.lit("")) if suffix is not None else F.lit(""))

    def cite(a):
        who = F.when(F.size(a) == 1, surname(a[0])).when(F.size(a) == 2, F.concat(surname(a[0]), F.lit(" & "), surname(F.get(a, F.lit(1))))).otherwise(F.concat(surname(a[0]), F.lit(" et al.")))
        return F.when(F.size(a) == 0, F.concat(F.lit("(Autor desconhecido, "), y, F.lit(")"))).otherwise(F.concat(who, F.lit(", "), y))

    return let(authors_of(authors), cite)


def closed(s: Column) -> Column:
    """With a full stop, unless it ends as a sentence or address does."""
    return F.when(s.rlike(r"""[.!?/»"]$"""), s).otherwise(F.concat(s, F.lit(".")))


def draft_reference(df: DataFrame) -> Column:
    """An APA 7 reference of a draft row (FIELDS, path) by its kind; what is missing is not made up."""
    c = lambda n: text(F.col(n))
    some = lambda n, value: F.when(c(n) != "", value)
    ital = lambda s: F.concat(F.lit("*"), s, F.lit("*"))
    dot = lambda s: F.concat(s, F.lit("."))
    link = F.when(F.lower(c("doi_ou_url")).startswith("http"), c("doi_ou_url")).when(c("doi_ou_url").startswith("10."), F.concat(F.lit("https://doi.org/"), c("doi_ou_url"))).otherwise(c("doi_ou_url"))
    linked = link != ""
    head = F.concat(F.coalesce(blank(c("autores")), F.lit("Autor desconhecido")), F.lit(" ("), F.coalesce(blank(c("ano")), F.lit("n.d.")), F.lit(")."))
    title, range_ = some("titulo", closed(c("titulo"))), F.regexp_replace(c("paginas"), "[—–]", "-")
    ends = lambda s: F.when(linked, dot(s)).otherwise(closed(s))
    publisher = some("editora", ends(c("editora")))
    number = F.concat(F.when(c("numero") != "", F.concat(F.lit("("), c("numero"), F.lit(")"))).otherwise(""), F.when(range_ != "", F.concat(F.lit(", "), range_)).otherwise(""))
    journal = some("contentor", F.when(c("volume") != "", ends(F.concat(ital(F.concat(c("contentor"), F.lit(", "), c("volume"))), number))).otherwise(ends(ital(c("contentor")))))
    inside = F.concat(F.lit("In "), ital(c("contentor")), F.when(range_ != "", F.concat(F.lit(" (pp. "), range_, F.lit(")"))).otherwise(""))
    more = (c("editora") != "") | linked
    chapter = some("contentor", F.when(more, dot(inside)).otherwise(closed(inside)))
    book = F.concat(ital(c("titulo")), F.when(c("edicao") != "", F.concat(F.lit(" ("), c("edicao"), F.lit(")"))).otherwise(""))
    place = F.when(c("editora") != "", F.concat(F.lit("[Doctoral dissertation, "), c("editora"), F.lit("]"))).otherwise("[Doctoral dissertation]")
    thesis = F.when(c("titulo") != "", F.concat(ital(c("titulo")), F.lit(" "), place, F.lit("."))).when(c("editora") != "", dot(place))
    entry = F.concat_ws(" ", title, dot(F.concat(F.lit("In "), ital(F.coalesce(blank(c("contentor")), F.lit("Grove Music Online"))))), ends(F.coalesce(blank(c("editora")), F.lit("Oxford University Press"))))
    stem = F.translate(F.regexp_replace(T.basename(c("path")), r"\.[^.]*$", ""), "_", " ")
    unknown = F.when(c("titulo") != "", ends(c("titulo"))).when(c("path") != "", closed(stem))
    kind_ = F.lower(F.coalesce(blank(c("tipo")), F.lit("desconhecido")))
    body = (
        F.when(kind_ == "artigo", F.concat_ws(" ", title, journal))
        .when(kind_ == "verbete", entry)
        .when(kind_ == "livro", F.concat_ws(" ", some("titulo", F.when(more, dot(book)).otherwise(closed(book))), publisher))
        .when(kind_.isin("capitulo", "actas"), F.concat_ws(" ", title, chapter, publisher))
        .when(kind_ == "tese", thesis)
        .when(kind_ == "relatorio", F.concat_ws(" ", some("titulo", F.when(more, dot(ital(c("titulo")))).otherwise(closed(ital(c("titulo"))))), publisher))
        .otherwise(unknown)
    )
    whole = F.trim(F.concat_ws(" ", head, blank(body)))
    return F.when(linked, F.concat(F.when(whole.endswith("."), whole).otherwise(closed(whole)), F.lit(" "), link)).otherwise(closed(whole))


def is_complete(df: DataFrame) -> Column:
    """A known kind, authors, a title, and for entries and articles where they stand."""
    c = lambda n: text(F.col(n))
    kind_ = F.lower(c("tipo"))
    base = ~kind_.isin("", "desconhecido") & (c("titulo") != "") & (c("autores") != "")
    return base & F.when(kind_ == "verbete", (c("contentor") != "") | (c("editora") != "")).when(kind_ == "artigo", (c("contentor") != "") | (c("doi_ou_url") != "")).otherwise(True)


def nth_letter(n: Column) -> Column:
    """The n-th character from a on, by code point; where there is no such character (surrogates, the end of Unicode), the number after a hyphen."""
    code = 96 + n
    char = F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 8, "0")), "UTF-32")
    return F.when((code < 0xD800) | ((code > 0xDFFF) & (code <= 0x10FFFF)), char).otherwise(F.concat(F.lit("-"), n.cast("string")))


def with_year_suffixes(df: DataFrame) -> DataFrame:
    """df (doc_id, autores, ano, titulo, path) with suffix: a, b, c ... in the order of titles where a surname and year have several works."""
    who = F.coalesce(surname(F.get(authors_of(F.col("autores")), F.lit(0))), F.lit(""))
    keyed = df.withColumns({"_who": who, "_year": F.coalesce(blank(F.col("ano")), F.lit("n.d.")), "_title": sort_key(F.coalesce(blank(F.col("titulo")), F.col("path")))})
    by = Window.partitionBy("_who", "_year")
    open_ = (F.col("_who") == "") & (F.col("_year") == "n.d.")
    # Works without surname and year are one key and need no place: they are set apart first.
    rest = keyed.where(~open_).withColumn("_k", F.count(F.lit(1)).over(by)).withColumn("_r", F.row_number().over(by.orderBy("_title", "doc_id")))
    rest = rest.withColumn("suffix", F.when(F.col("_k") > 1, nth_letter(F.col("_r"))).otherwise("")).drop("_k", "_r")
    return rest.unionByName(keyed.where(open_).withColumn("suffix", F.lit(""))).drop("_who", "_year", "_title")


def reference_list(draft: DataFrame) -> DataFrame:
    """(doc_id, citation, reference, kind, complete, author_key, year_key, title_key): sort by the keys, then doc_id."""
    d = with_year_suffixes(draft)
    cited = d.withColumn("citation", short_citation(F.col("autores"), F.col("ano"), F.col("suffix")))
    dated = cited.withColumn("_ano", F.col("ano")).withColumn("ano", F.when(F.col("suffix") != "", F.concat(F.coalesce(blank(F.col("ano")), F.lit("n.d.")), F.col("suffix"))).otherwise(F.col("ano")))
    first = F.get(authors_of(F.col("autores")), F.lit(0))
    return dated.select(
        "doc_id",
        "citation",
        draft_reference(dated).alias("reference"),
        F.coalesce(blank(F.col("tipo")), F.lit("desconhecido")).alias("kind"),
        is_complete(dated).alias("complete"),
        sort_key(F.coalesce(surname(first), F.col("titulo"))).alias("author_key"),
        F.coalesce(blank(F.col("_ano")), F.lit("9999")).alias("year_key"),
        sort_key(F.col("titulo")).alias("title_key"),
    )


def is_junk(value: Column) -> Column:
    v = F.lower(text(value))
    return (F.length(v) < 3) | F.exists(F.array(*map(F.lit, JUNK)), lambda j: F.contains(v, j))


def agrees(value: Column, page: Column) -> Column:
    """Whether a value, or half of its longer words, stands on the page."""

    def test(x):
        m, p = x["m"], x["p"]
        words = F.filter(F.split(m, " "), lambda w: F.length(w) >= 5)
        found = F.size(F.filter(words, lambda w: F.contains(p, w)))
        return (m != "") & (p != "") & (F.contains(p, m) | ((F.size(words) > 0) & (found >= F.greatest(F.lit(1), F.floor(F.size(words) / 2)))))

    return let(F.struct(compared(value).alias("m"), compared(page).alias("p")), test)


def draft(docs: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """FIELDS of docs (doc_id, path, page1, footer, meta_title, meta_author), each with evidencia_<field>, and flags.

    The first source that has a field gives it: encyclopaedia entries, the file
    name, metadata that the page bears out, footer, first page, manifest, kind.
    """
    page, foot = F.coalesce("page1", F.lit("")), F.coalesce("footer", F.lit(""))
    both = F.concat_ws("\n", page, foot)
    grove = both.rlike(GROVE) | F.col("path").rlike(GROVE)
    stem = F.regexp_replace(T.basename(F.col("path")), r"\.[^.]*$", "")
    lines = F.filter(F.transform(F.split(page, r"\n"), lambda x: F.trim(x)), lambda x: x != "")
    of_entry = F.filter(lines, lambda x: F.length(x).between(3, 120) & ~F.lower(x).rlike(r"^http|doi\.org|published online|last updated") & ~x.rlike(GROVE) & ~x.rlike(r"(?iu)^(?:by|por)\s"))
    after = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(GROVE), i)), lambda i: i.isNotNull())
    entry = F.coalesce(F.get(F.filter(F.transform(lines, lambda x, i: F.when((i > F.coalesce(F.get(after, F.lit(0)), F.lit(-1))) & F.array_contains(of_entry, x), x)), lambda x: x.isNotNull()), F.lit(0)), F.get(of_entry, F.lit(0)))
    author = F.get(F.filter(lines, lambda x: x.rlike(AUTHOR_LINE)), F.lit(0))
    j_foot, j_page = journal_line(foot), journal_line(page)
    plain = lambda name, fn: [(F.when(~grove, F.coalesce(blank(j_foot[name]), F.when(j_foot["journal"] == "", blank(fn(foot))))), "rodape"), (F.when(~grove, F.coalesce(blank(j_page[name]), F.when(j_page["journal"] == "", blank(fn(page))))), "pagina1")]
    meta_ok = lambda c: F.when(~is_junk(F.col(c)) & agrees(F.col(c), page), F.col(c))
    of_doi = lambda c: F.when(doi(c) != "", F.concat(F.lit("https://doi.org/"), doi(c)))
    title_like = F.get(F.filter(lines, lambda x: F.length(x).between(8, 140) & ~F.lower(x).startswith("http") & ~(x.endswith(".") & (F.length(x) > 70)) & ~x.rlike(AUTHOR_LINE) & ~x.rlike(GROVE) & ~x.rlike(JOURNAL)), F.lit(0))
    told = {name: F.col(f"m.{name}") if manifest is not None else F.lit(None).cast("string") for name in FIELDS}
    known = kind(F.col("path"), page)
    sources = {
        "autores": [(F.when(grove, author), "pagina1"), (initialled(meta_ok("meta_author")), "pdf_meta"), (F.when(~grove, author), "pagina1")],
        "ano": [(F.when(grove, blank(F.regexp_extract(both, GROVE_DATE, 1))), "pagina1"), (F.when(~grove, blank(F.regexp_extract(stem, DATED_FILE, 1))), "nome_ficheiro"), (F.when(~grove, F.coalesce(blank(j_foot["year"]), F.when(j_foot["journal"] == "", blank(year(foot))))), "rodape"), (F.when(~grove, blank(j_page["year"])), "pagina1")],
        "titulo": [(F.when(grove, entry), "pagina1"), (blank(F.translate(F.regexp_extract(stem, DATED_FILE, 2), "_", " ")), "nome_ficheiro"), (meta_ok("meta_title"), "pdf_meta"), (F.when(~grove, title_like), "pagina1")],
        "tipo": [(F.when(grove, F.lit("verbete")), "pagina1"), (F.when(~grove & (j_foot["journal"] != ""), F.lit("artigo")), "rodape"), (F.when(~grove & (j_page["journal"] != ""), F.lit("artigo")), "pagina1")],
        "contentor": [(F.when(grove, F.lit("Grove Music Online")), "pagina1"), (F.when(~grove, blank(j_foot["journal"])), "rodape"), (F.when(~grove, blank(j_page["journal"])), "pagina1")],
        "volume": plain("volume", volume),
        "numero": plain("issue", issue),
        "paginas": plain("pages", pages),
        "editora": [(F.when(grove, F.lit("Oxford University Press")), "pagina1")],
        "doi_ou_url": [(F.when(grove, of_doi(both)), "pagina1"), (of_doi(foot), "rodape"), (of_doi(page), "pagina1")],
        "edicao": [],
    }
    last = {"tipo": [(F.when(known != "desconhecido", F.when(known == "grove", "verbete").otherwise(known)), "nome_ficheiro"), (F.lit("desconhecido"), "nome_ficheiro")]}
    out = docs.withColumn("_key", F.regexp_replace(T.basename(F.lower("path")), r"\.[^.]*$", ""))
    if manifest is not None:
        out = out.join(manifest.select(F.col("key").alias("_of"), F.struct(*FIELDS).alias("m")), F.col("_key") == F.col("_of"), "left")
    columns = {}
    for name in FIELDS:
        choices = [F.when(blank(v).isNotNull(), F.struct(blank(v).alias("v"), F.lit(e).alias("e"))) for v, e in [*sources[name], (told[name], "manifesto"), *last.get(name, [])]]
        columns[f"_{name}"] = F.coalesce(*choices, F.struct(F.lit("").alias("v"), F.lit("vazio").alias("e")))
    out = out.withColumns(columns)
    out = out.select("doc_id", "path", *[F.col(f"_{n}.v").alias(n) for n in FIELDS], *[F.col(f"_{n}.e").alias(f"evidencia_{n}") for n in FIELDS])
    return with_duplicates(out.withColumns({"confianca": confidence(out)["c"], "verificar": confidence(out)["v"], "caso_titulo": title_flag(F.col("titulo"))}))


def confidence(df: DataFrame) -> Column:
    """struct(c, v): how sure a draft row is (alta, media, baixa), and whether to verify it."""
    filled = lambda names: F.size(F.filter(F.array(*[F.struct(F.col(n).alias("v"), F.col(f"evidencia_{n}").alias("e")) for n in FIELDS]), lambda x: (x["v"] != "") & x["e"].isin(names)))
    row = lambda c, v: F.struct(F.lit(c).alias("c"), v.alias("v"))
    yes = F.lit("sim")
    sure = F.when(F.col("autores") != "", "nao").otherwise("sim")
    return F.when((F.col("tipo") == "desconhecido") | (F.col("titulo") == ""), row("baixa", yes)).when((filled(STRONG) >= 3) & (F.col("ano") != ""), row("alta", sure)).when(filled([e for e in EVIDENCE if e != "vazio"]) >= 2, row("media", yes)).otherwise(row("baixa", yes))


def title_flag(title: Column) -> Column:
    """por_rever where most longer words have a capital, ok otherwise; nothing for short titles."""
    words = F.filter(F.regexp_extract_all(F.coalesce(title, F.lit("")), F.lit("[A-Za-zÀ-ÿ]{3,}"), F.lit(0)), lambda w: ~F.lower(w).isin("and", "the", "for", "with", "from", "into", "that", "this"))
    return let(words, lambda w: F.when(F.size(w) < 3, "").when(F.size(F.filter(w, lambda x: x.rlike(r"^\p{Lu}"))) / F.size(w) >= 0.7, "por_rever").otherwise("ok"))


def with_duplicates(df: DataFrame) -> DataFrame:
    """df with duplicado_de: the first document of the same authors, year and title, empty for that one itself."""
    key = F.when((F.col("autores") != "") & (F.col("ano") != "") & (F.col("titulo") != ""), F.concat_ws("|", compared(F.col("autores")), "ano", compared(F.col("titulo"))))
    keyed = df.withColumn("_key", key)
    first = keyed.where("_key is not null").groupBy(F.col("_key").alias("_of")).agg(F.min("doc_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    out = keyed.join(first, F.col("_key") == F.col("_of"), "left")
    return out.withColumn("duplicado_de", F.when(F.col("_first") != F.col("doc_id"), F.col("_first").cast("string")).otherwise("")).drop("_key", "_of", "_first")


def bad_evidence(df: DataFrame) -> DataFrame:
    """(doc_id, field): values without evidence, and evidence that is none; empty if all is well."""
    rows = F.filter(F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).alias("v"), F.col(f"evidencia_{n}").alias("e")) for n in FIELDS]), lambda x: ((text(x["v"]) != "") & (F.coalesce(x["e"], F.lit("vazio")) == "vazio")) | ~F.coalesce(x["e"], F.lit("vazio")).isin(EVIDENCE))
    return df.select("doc_id", F.explode_outer(rows).alias("r")).where("r is not null").select("doc_id", "r.field")


def inventory(h: DataFrame, path: Column, key: Column) -> DataFrame:
    """(doc_key, path, n_hits, n_nuclear, kind) of hits: a document's most frequent path, the first on ties."""
    paths = h.groupBy(key.alias("doc_key"), path.alias("path")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("nuclear").cast("long")).alias("yes"))
    best = F.min_by("path", F.struct((-F.col("n")).alias("n"), F.col("path").alias("p")))
    out = paths.groupBy("doc_key").agg(best.alias("path"), F.sum("n").alias("n_hits"), F.sum("yes").alias("n_nuclear"))
    return out.withColumn("kind", kind(F.col("path")))


def unique_works(df: DataFrame, path: str = "path", url: str = "url", order: str = "doc_id") -> DataFrame:
    """The first row of each work, known by its file name or else its address; rows with neither do not count."""
    key = F.coalesce(blank(F.regexp_replace(T.basename(F.lower(F.col(path))), r"\.[^.]*$", "")), blank(F.lower(F.col(url))))
    first = df.withColumn("_key", key).where("_key is not null").groupBy("_key").agg(F.min_by(F.struct(*df.columns), F.col(order)).alias("r"))
    return first.select(F.col("_key").alias("key"), "r.*")


def counts(df: DataFrame) -> DataFrame:
    """(measure, key, n): what a draft holds, by kind, confidence and evidence."""
    n = F.count(F.lit(1)).alias("n")
    line = lambda name, c: df.groupBy(F.col(c).alias("key")).agg(n).select(F.lit(name).alias("measure"), "key", "n")
    return line("tipo", "tipo").unionByName(line("confianca", "confianca")).unionByName(line("evidencia_titulo", "evidencia_titulo"))

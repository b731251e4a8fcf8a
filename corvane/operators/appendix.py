"""What an appendix of excerpts needs: cleaned excerpts, search probes, pages, sources, addresses, and their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import fixed
from corvane.operators.contexts import let
from corvane.operators.tables import numbered

ENDS = r"""[.!?]["']?\s*$"""
WORD = r"[\p{L}\p{N}_]"


def unwrapped(text: Column) -> Column:
    """An excerpt without quotation marks and ellipses around it."""
    t = F.trim(F.translate(F.coalesce(text, F.lit("")), "«»“”", ""))
    t = F.trim(F.regexp_replace(t, r"""^(["'])(.*)\1$""", "$2"))
    t = F.trim(F.regexp_replace(t, r"(?:\.{3}|…)+", "…"))
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"^(?:…[ \t\-–—]*)+", ""), r"(?:[ \t\-–—]*…)+$", ""))


def protected(*forms: Column) -> Column:
    """Forms of at least two letters, and their words, that cleaning must not lose."""
    own = F.filter(F.array(*[F.lower(F.trim(F.coalesce(f, F.lit("")))) for f in forms]), lambda f: ~f.isin("", "nan", "none"))
    return F.array_distinct(F.filter(F.flatten(F.transform(own, lambda f: F.concat(F.array(f), F.split(f, r"\s+")))), lambda p: F.length(p) >= 2))


def has(text: Column, form: Column) -> Column:
    """Whether a form stands at the beginning of a word of a text."""
    return F.regexp_like(F.lower(text), F.concat(F.lit(rf"(?<!{WORD})\Q"), form, F.lit(r"\E")))


def cleaned(text: Column, keep: Column) -> Column:
    """An excerpt without what its window cut off: a short tail after the last comma, a stub, and up to three function words.

    A cut that would lose a protected form is not made; a whole sentence is not cut.
    """
    last = lambda t: F.element_at(F.split(t, " "), -1)
    bare = lambda w: F.regexp_replace(F.regexp_replace(w, r"(?:\.{3}|…)+", ""), rf"^(?:(?!{WORD}).)+|(?:(?!{WORD}).)+$", "")
    shorter = lambda t: F.array_join(F.slice(F.split(t, " "), 1, F.size(F.split(t, " ")) - 1), " ")
    safe = lambda t, cut: F.forall(keep, lambda p: ~has(t, p) | has(cut, p))
    short = lambda u: u.isin(fixed.SHORT_WORDS)

    def tail(t):
        rest, cut = F.trim(F.regexp_extract(t, r"^(.*)[,;:] (.*)$", 2)), F.rtrim(F.regexp_extract(t, r"^(.*)[,;:] (.*)$", 1))
        ok = ~t.rlike(ENDS) & (rest != "") & (F.size(F.split(rest, " ")) <= 3) & ~rest.rlike("[.!?]$") & ~F.exists(keep, lambda p: has(rest, p))
        return F.when(ok & safe(t, cut), cut).otherwise(t)

    def stub(t):
        u = F.lower(bare(last(t)))
        ok = ~last(t).rlike("[.!?]$") & (u != "") & (F.length(u) <= 3) & ~short(u) & ~F.array_contains(keep, u)
        return F.when(ok & safe(t, shorter(t)), shorter(t)).otherwise(t)

    def peel(first):
        def step(t):
            u = F.lower(bare(last(t)))
            ok = (t != "") & ~last(t).rlike("[.!?]$") & (u != "") & short(u) & ~F.array_contains(keep, u)
            ok = ok & ~t.rlike(ENDS) if first else ok
            return F.when(ok & safe(t, shorter(t)), shorter(t)).otherwise(t)

        return step

    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    for step in (tail, stub, peel(True), peel(False), peel(False)):
        t = let(t, step)
    return F.regexp_replace(t, "[ ,;:]+$", "")


def excerpt(context: Column, page: Column, *forms: Column) -> Column:
    """A cleaned window in quotation marks, and the page after it where there is one."""
    keep = protected(*forms)

    def build(raw):
        core = let(cleaned(raw, keep), lambda c: F.when(c != "", c).otherwise(raw))
        return let(core, lambda c: F.when(raw == "", '"… …"').otherwise(F.concat(F.lit('"… '), c, F.when(c.rlike(ENDS), "").otherwise("…"), F.lit('"'))))

    cite = F.when(F.coalesce(page, F.lit("")) != "", F.concat(F.lit(" (p. "), page, F.lit(")"))).otherwise("")
    return F.concat(let(unwrapped(context), build), cite)


def probes(text: Column) -> Column:
    """Parts of an excerpt to look for, the longest first: its middle half, both ends, and three long words of the middle."""

    def build(t):
        n = F.length(t)
        a, b = F.floor(n / 4).cast("int"), F.floor(3 * n / 4).cast("int")
        words = F.regexp_extract_all(t, F.lit("[A-Za-zÀ-ÿ]{5,}"), F.lit(0))
        mid = F.floor(F.size(words) / 2).cast("int")
        parts = F.array(
            F.when(n >= 48, F.trim(F.substr(t, a + 1, b - a))),
            F.trim(F.substring(t, 1, 80)),
            F.when(n > 80, F.trim(F.substr(t, n - 79, F.lit(80)))).otherwise(t),
            F.when(F.size(words) >= 3, F.array_join(F.slice(words, mid, 3), " ")),
        )
        ordered = F.transform(F.array_sort(F.transform(F.filter(parts, lambda p: F.length(p) >= 12), lambda p, i: F.struct((-F.length(p)).alias("n"), i.alias("i"), p.alias("p")))), lambda x: x["p"])
        return F.when(n < 12, F.array().cast("array<string>")).otherwise(let(ordered, lambda o: F.filter(o, lambda p, i: F.array_position(F.transform(o, lambda x: F.lower(x)), F.lower(p)) == i + 1)))

    clean = cleaned(unwrapped(text), F.array().cast("array<string>"))
    return let(F.trim(F.regexp_replace(clean, r"\s+", " ")), build)


def page_of(*columns: tuple[str, Column]) -> Column:
    """The first page that columns (name, value) give; a column n is a page only from 1 to 9999."""
    found = []
    for name, value in columns:
        v = F.trim(value.cast("string"))
        if name == "n":
            number = F.floor(v.try_cast("double")).cast("long")
            found.append(F.when(number.between(1, 9999), number.cast("string")))
        else:
            digits = F.regexp_replace(F.regexp_extract(v, r"([0-9]+(?:\s*[–\-]\s*[0-9]+)?)", 1), " ", "")
            found.append(F.when(F.lower(v).isin("", "nan", "none", "—", "-"), None).otherwise(F.when(digits != "", digits).otherwise(v)))
    return F.coalesce(*found)


def source(reference: Column, path: Column) -> Column:
    """A reference, or the file name without one; it ends in a stop unless it ends in an address."""
    stem = F.trim(F.translate(F.regexp_replace(F.regexp_extract(F.translate(path, "\\", "/"), "([^/]*)$", 1), r"\.[^.]*$", ""), "_", " "))
    base = F.rtrim(F.coalesce(F.when(F.trim(reference) != "", F.trim(reference)), F.when(stem != "", F.concat(stem, F.lit(". (n.d.)."))), F.lit("Fonte não identificada. (n.d.).")))
    return F.when(base.rlike(r"(?i)https?://\S+$") | base.endswith("."), base).otherwise(F.concat(base, F.lit(".")))


def file_path(value: Column) -> Column:
    """The path of a file address: decoded, without the slash before a drive; other values as they are."""
    v = F.trim(F.coalesce(value, F.lit("")))
    path = F.url_decode(F.replace(F.regexp_replace(v, "(?i)^file:(?://[^/]*)?", ""), F.lit("+"), F.lit("%2B")))
    drive = F.regexp_extract(path, "^/?([A-Za-z]:.*)$", 1)
    return F.when(~F.lower(v).startswith("file:"), v).when(drive != "", F.translate(drive, "/", "\\")).otherwise(path)


def moved(value: Column, prefixes: list[str], root: str) -> Column:
    """A path whose beginning is one of some folders, in any case, below another root; other paths as they are."""
    raw = F.translate(file_path(value), "\\", "/")
    out = None
    for p in prefixes:
        p = p.replace("\\", "/").rstrip("/")
        rest = F.concat(F.lit(root.rstrip("/")), F.substring(raw, len(p) + 1, 1 << 20))
        hit = (F.lower(raw) == p.lower()) | F.lower(raw).startswith(p.lower() + "/")
        out = F.when(hit, rest) if out is None else out.when(hit, rest)
    return file_path(value) if out is None else out.otherwise(file_path(value))


def ordered(h: DataFrame, group: str, work: str, context: str = "context") -> DataFrame:
    """h with place: groups in the order of their names in small letters, within them by work and context; rows without a group go."""
    name = F.trim(F.col(group).cast("string"))
    rows = h.where((name != "") & (F.lower(name) != "nan")).withColumn("_key", F.struct(F.lower(name).alias("a"), name.alias("b"), F.col(work).alias("c"), F.col(context).alias("d"), F.struct(*[c for c in h.columns if c in ("doc_id", "line", "idx")]).alias("e")))
    return numbered(rows, "_key", "place").drop("_key")

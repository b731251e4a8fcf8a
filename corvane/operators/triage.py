"""Triage of hits: domains, metatext, false friends, noise between node and term; each may take nuclear away.

Stages follow one another and each reads what the one before left: the first motive
stays, and nuclear only ever turns false.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import fixed
from corvane.functions import text as T


def demote(h: DataFrame, when: Column, motive: Column) -> DataFrame:
    """nuclear off where when holds; the motive is written where there is none yet."""
    empty = F.coalesce(F.trim("motive"), F.lit("")) == ""
    return h.withColumns({"motive": F.when(when & empty, motive).otherwise(F.coalesce("motive", F.lit(""))), "nuclear": F.col("nuclear") & ~when})


def domain_of(path: Column, rules: list[tuple[str, str]], valid: list[str] | None = None) -> Column:
    """The domain of the first rule (regex, domain) found in a path, in any case; null if none is. Rules of unknown domains do not count."""
    out = None
    for pattern, domain in rules:
        if valid is None or domain in valid:
            hit = path.rlike(f"(?iu){pattern}")
            out = F.when(hit, domain) if out is None else out.when(hit, domain)
    return F.lit(None).cast("string") if out is None else out


def with_domain(h: DataFrame, path: Column, rules: list[tuple[str, str]], include: list[str], default: str | None = None, valid: list[str] | None = None) -> DataFrame:
    """domain: by rule, else the default, else por_rever; a domain that is not included takes nuclear away."""
    found = domain_of(path, rules, valid)
    domain = F.coalesce(found, F.lit(default)) if default else found
    h = h.withColumn("domain", F.coalesce(domain, F.lit("por_rever")))
    out = (F.col("domain") != "por_rever") & ~F.col("domain").isin(list(include))
    return demote(h, out, F.concat(F.lit("dominio:"), F.col("domain")))


def is_metatext(context: Column) -> Column:
    """Captions, numbered headings, publishing keywords, or two groups of initials."""
    c = F.trim(F.coalesce(context, F.lit("")))
    before, after = r"(?:^|[^\p{L}\p{N}_])", r"(?:[^\p{L}\p{N}_]|$)"
    keyword = c.rlike(f"(?i){before}(?:{fixed.METATEXT_WORDS}){after}") | c.rlike(rf"(?i){before}(?:{fixed.METATEXT_MARKS})[\p{{L}}\p{{N}}_]")
    return c.rlike(fixed.CAPTION) | c.rlike(fixed.HEADING) | keyword | (F.regexp_count(c, F.lit(fixed.INITIALS)) >= 2)


def false_friend(form: Column, friends: dict[str, str] = fixed.FALSE_FRIENDS) -> Column:
    pairs = [F.lit(x) for item in friends.items() for x in item]
    return F.element_at(F.create_map(*pairs), F.lower(F.trim(F.coalesce(form, F.lit(""))))) if pairs else F.lit(None).cast("string")


def is_noise(tok: Column, idx: Column, node: Column) -> Column:
    """A token of over three letters without a vowel stands strictly between node and term."""
    low, high = F.least(idx, node), F.greatest(idx, node)
    return F.exists(F.slice(tok, low + 2, F.greatest(high - low - 1, F.lit(0))), lambda t: (F.length(t) > 3) & ~t.rlike(f"[{fixed.VOWELS}]"))


def triage(h: DataFrame, path: Column, rules: list[tuple[str, str]], include: list[str], default: str | None = None, friends: dict[str, str] = fixed.FALSE_FRIENDS, valid: list[str] | None = None) -> DataFrame:
    """All stages, in order, on hits (context, form, tok, idx, node_idx, nuclear, motive)."""
    h = with_domain(h, path, rules, include, default, valid)
    h = demote(h, is_metatext(F.col("context")), F.lit("metatexto"))
    friend = false_friend(F.col("form"), friends)
    h = demote(h, F.col("nuclear") & friend.isNotNull(), friend)
    return demote(h, is_noise(F.col("tok"), F.col("idx"), F.col("node_idx")), F.lit("ruido_ocr"))


def to_review(h: DataFrame, path: Column) -> DataFrame:
    """(path, n_hits, n_nuclear) of files whose domain is open, the most nuclear first."""
    files = h.where("domain = 'por_rever'").groupBy(path.alias("path")).agg(F.count(F.lit(1)).alias("n_hits"), F.sum(F.col("nuclear").cast("long")).alias("n_nuclear"))
    return files.orderBy(F.desc("n_nuclear"), F.desc("n_hits"), "path")


def genuine(h: DataFrame) -> DataFrame:
    """Nuclear hits; a column attribution, where there is one, decides instead."""
    return h.where(F.lower("attribution").isin("genuína", "genuina")) if "attribution" in h.columns else h.where("nuclear")


def of_relations(h: DataFrame, relations: list[str]) -> DataFrame:
    """Hits of the relations named, in any case; all if none is named."""
    wanted = [r.strip().lower() for r in relations if r.strip()]
    return h.where(F.lower(F.trim("relation")).isin(wanted)) if wanted else h


def checklist(h: DataFrame, friends: dict[str, str] = fixed.FALSE_FRIENDS) -> DataFrame:
    """One row on the state of a reviewed concordance: counts of errors and warnings, and a score of 0 to 100.

    The want of any nuclear row counts 30, not as one of the errors of 25 each.
    """
    empty = lambda c: F.coalesce(F.lower(F.trim(F.col(c).cast("string"))), F.lit("")).isin("", "nan", "none", "nat")
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    nuclear = F.col("nuclear")
    got = h.agg(
        F.count(F.lit(1)).alias("n"),
        count(nuclear).alias("n_nuclear"),
        count(nuclear & F.col("relation").isin(fixed.NOT_NUCLEAR)).alias("bad_relation"),
        count(nuclear & F.lower("form").isin(list(friends))).alias("false_friends"),
        count(nuclear & empty("pole")).alias("no_pole"),
        count(nuclear & empty("axis")).alias("no_axis"),
        count(nuclear & (F.trim("domain") == "por_rever")).alias("open_domain"),
        count(~empty("reviewed")).alias("reviewed"),
    )
    warnings = sum(((F.col(c) > 0).cast("int") for c in ("false_friends", "no_pole", "no_axis", "open_domain")), (F.col("reviewed") < F.col("n")).cast("int"))
    errors = (F.col("bad_relation") > 0).cast("int")
    got = got.withColumns({"warnings": F.when(F.col("n") == 0, 0).otherwise(warnings), "errors": F.when(F.col("n") == 0, 1).otherwise(errors + (F.col("n_nuclear") == 0).cast("int"))})
    score = 100 - 25 * errors - 8 * F.col("warnings") - F.when(F.col("n_nuclear") == 0, 30).otherwise(0)
    return got.withColumn("score", F.when(F.col("n") == 0, 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), score))))


def assert_hits(h: DataFrame, path: Column, nodes: list[str], prefix: str = "", doc_id: str = "doc_id") -> None:
    """Raise if a node word is a canonical term, if paths are no files, or if every row is its own document."""
    share = F.avg(T.looks_like_file(path).cast("double"))
    got = h.agg(F.coalesce(F.bool_or(T.is_node(F.col("canonical_term"), nodes, prefix)), F.lit(False)).alias("bad"), share.alias("share"), F.count(F.lit(1)).alias("n"), F.countDistinct(doc_id).alias("docs")).first()
    if got.bad:
        raise ValueError("a canonical term is a node word")
    if got.n and got.share < 0.2:
        raise ValueError(f"paths are no files (share of files {got.share:.2f})")
    if got.n > 5 and got.docs == got.n and got.share < 0.5:
        raise ValueError("every row has a document of its own, and paths are doubtful")


def assert_relations(h: DataFrame, columns: list[str] = ("relation", "nuclear", "form"), known: list[str] = tuple(fixed.NUCLEAR + fixed.NOT_NUCLEAR)) -> None:
    """Raise if a column is missing or a relation is outside the taxonomy."""
    missing = [c for c in columns if c not in h.columns]
    if missing:
        raise ValueError(f"columns are missing: {missing}")
    unknown = [r[0] for r in h.where(~F.coalesce(F.col("relation"), F.lit("")).isin(list(known))).select("relation").distinct().limit(10).collect()]
    if unknown:
        raise ValueError(f"relations outside the taxonomy: {unknown}")

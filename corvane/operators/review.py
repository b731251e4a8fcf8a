"""Review passes over an annotated concordance, and checks of its mapping; each is a stage that reads the one before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import fixed
from corvane.functions import text as T
from corvane.operators import triage as G
from corvane.operators.dedupe import ROW

#: Motives of an earlier review that are carried over.
STRONG = "termo_nao_relacionado_directamente_com_textura fora_da_classe_uniforme metatexto ruido_ocr citacao_repetida".split()


def empty(c: str) -> Column:
    return F.coalesce(F.lower(F.trim(F.col(c).cast("string"))), F.lit("")).isin("", "nan", "none", "nat")


def coherent(h: DataFrame, not_nuclear: list[str] = fixed.NOT_NUCLEAR) -> DataFrame:
    """A relation that is not nuclear turns nuclear off and is the motive where there is none."""
    return G.demote(h, F.coalesce(F.col("relation").isin(list(not_nuclear)), F.lit(False)), F.col("relation"))


def longest_form(h: DataFrame) -> DataFrame:
    """Of one term in a passage, nuclear more than once, the longest form stays; then the least distance, then the first row."""
    key = ["passage", "term"]
    place = F.struct(*ROW, "idx")
    best = F.min_by(place, F.struct((-F.length("form")).alias("a"), F.coalesce(F.col("distance"), F.lit(99)).alias("b"), place.alias("c")))
    groups = h.where("nuclear and passage is not null").groupBy(*key).agg(best.alias("_best"), F.count(F.lit(1)).alias("_k")).where("_k > 1").drop("_k")
    out = h.join(groups, key, "left")
    lost = F.col("nuclear") & F.coalesce(F.col("_best") != place, F.lit(False))
    return out.withColumns({"nuclear": F.col("nuclear") & ~lost, "motive": F.when(lost, "janela_sobreposta").otherwise(F.col("motive"))}).drop("_best")


def exclude_forms(h: DataFrame, motives: dict[str, str], rules: list[tuple[str, str, str | None, str]] = (), extra_metatext: str | None = None, domain: str = fixed.DOMAIN_DEFAULT) -> DataFrame:
    """Open domains are the default; then nuclear rows go by form, by (form, found in context, unless found, motive), and as metatext."""
    h = h.withColumn("domain", F.when(empty("domain") | (F.trim("domain") == "por_rever"), domain).otherwise(F.col("domain")))
    motive = G.false_friend(F.col("form"), motives)
    h = turned_off(h, motive.isNotNull(), motive)
    for form, found, unless, why in rules:
        when = (F.lower("form") == form) & F.col("context").rlike(f"(?iu){found}")
        h = turned_off(h, when & ~F.col("context").rlike(f"(?iu){unless}") if unless else when, F.lit(why))
    meta = G.is_metatext(F.col("context"))
    return turned_off(h, meta | F.col("context").rlike(f"(?iu){extra_metatext}") if extra_metatext else meta, F.lit("metatexto"))


def turned_off(h: DataFrame, when: Column, motive: Column) -> DataFrame:
    """Nuclear rows for which when holds go, with this motive."""
    hit = F.col("nuclear") & F.coalesce(when, F.lit(False))
    return h.withColumns({"motive": F.when(hit, motive).otherwise(F.col("motive")), "nuclear": F.col("nuclear") & ~hit})


def filled(h: DataFrame, poles: dict[str, str], axes: dict[str, str], default_pole: str = fixed.POLES[0], default_axis: str = fixed.AXES[2]) -> DataFrame:
    """Poles, axes and negation of nuclear rows that have none."""
    of = lambda m: F.element_at(F.create_map(*[F.lit(x) for kv in m.items() for x in kv]), F.col("term")) if m else F.lit(None).cast("string")
    base = F.when(~empty("pole_base"), F.col("pole_base")) if "pole_base" in h.columns else F.lit(None).cast("string")
    fill = lambda c, value: F.when(F.col("nuclear") & empty(c), value).otherwise(F.col(c))
    out = h.withColumns({"pole": fill("pole", F.coalesce(base, of(poles), F.lit(default_pole))), "axis": fill("axis", F.coalesce(of(axes), F.lit(default_axis)))})
    return out.withColumn("negation", fill("negation", F.lit("nao"))) if "negation" in h.columns else out


def carried(h: DataFrame, prior: DataFrame, strong: list[str] = STRONG) -> DataFrame:
    """Strong motives of an earlier review (hit_key, motive), on rows that are nuclear or have no motive."""
    old = prior.where(F.trim("motive").isin(strong)).groupBy(F.col("hit_key").alias("_key")).agg(F.min(F.trim("motive")).alias("_old"))
    out = h.join(old, F.col("hit_key") == F.col("_key"), "left")
    hit = F.col("_old").isNotNull() & (F.col("nuclear") | empty("motive"))
    return out.withColumns({"motive": F.when(hit, F.col("_old")).otherwise(F.col("motive")), "nuclear": F.col("nuclear") & ~hit}).drop("_key", "_old")


def class_rules(h: DataFrame, adverbs: list[str] = ("uniformly",), fixed_terms: list[str] = ("fixed", "fixe", "unchanging")) -> DataFrame:
    """Forms that are adverbs where they were taken for attributes; terms whose open axis is the diachronic one."""
    adverb = F.col("nuclear") & F.lower("form").isin(list(adverbs)) & (F.col("relation") == "atributiva")
    axis = F.col("nuclear") & F.col("term").isin(list(fixed_terms)) & (F.col("axis") == fixed.AXES[2])
    return h.withColumns({"relation": F.when(adverb, "adverbial").otherwise(F.col("relation")), "axis": F.when(axis, fixed.AXES[1]).otherwise(F.col("axis"))})


def stamped(h: DataFrame, reviewer: str, path: Column) -> dict[str, DataFrame]:
    """The reviewed table, what it excludes, and files whose domain is open."""
    out = h.withColumn("reviewed", F.lit(reviewer))
    return {"concordance": out, "excluded": out.where("not nuclear"), "to_review": G.to_review(out, path)}


def auto_review(h: DataFrame, motives: dict[str, str], poles: dict[str, str], axes: dict[str, str], prior: DataFrame | None = None, **rules) -> DataFrame:
    """All passes in order on hits (relation, nuclear, motive, passage, term, form, distance, context, domain, pole, axis)."""
    h = exclude_forms(longest_form(coherent(h)), motives, **rules)
    h = class_rules(filled(h, poles, axes))
    return carried(h, prior) if prior is not None else h


def unknown_patterns(h: DataFrame, field: dict[str, list[str]]) -> DataFrame:
    """(kind, value): patterns of hits that no label has, terms that are no label, and forms that fit no pattern of their term."""
    known = [p for ps in field.values() for p in ps]
    fits = F.lit(False)
    for label, patterns in field.items():
        for p in patterns:
            words = p.split()
            parts = F.split("form", " ")
            hit = F.size(parts) == len(words)
            for i, w in enumerate(words):
                hit = hit & F.coalesce(F.get(parts, F.lit(i)).rlike(loose(w)), F.lit(False))
            fits = fits | ((F.col("canonical_term") == label) & hit)
    rows = F.array_compact(
        F.array(
            F.when(~F.col("query_pattern").isin(known), F.struct(F.lit("pattern").alias("kind"), F.col("query_pattern").alias("value"))),
            F.when(~F.col("canonical_term").isin(list(field)), F.struct(F.lit("term").alias("kind"), F.col("canonical_term").alias("value"))),
            F.when(~fits, F.struct(F.lit("form").alias("kind"), F.col("form").alias("value"))),
        )
    )
    return h.select(F.explode_outer(rows).alias("r")).where("r is not null").select("r.*").where("value != ''").distinct()


def loose(word: str) -> str:
    """A pattern whose truncations stand for up to 14 word characters."""
    core = "".join("\\" + c if not c.isalnum() and c.isascii() else c for c in word.strip("*"))
    star = rf"[{T.WORD}]{{0,14}}"
    return "^" + (star if word.startswith("*") else "") + core + (star if word.endswith("*") else "") + "$"


def without_pole(h: DataFrame, labels: list[str]) -> DataFrame:
    """(term, n): hits of the field's labels that have no pole."""
    return h.where(F.col("term").isin(labels) & empty("pole")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def assert_poles(h: DataFrame, labels: list[str]) -> None:
    bad = [r.term for r in without_pole(h, labels).collect()]  # at most one a label
    if bad:
        raise ValueError(f"terms without a pole: {sorted(bad)}")


def accounting(h: DataFrame, test: str, eligible: Column, rule: str = "") -> DataFrame:
    """(test, n_eligible, n_excluded, percent, rule): how many rows a test leaves out."""
    ok = F.coalesce(eligible, F.lit(False))
    n = h.agg(F.sum(ok.cast("long")).alias("n_eligible"), F.sum((~ok).cast("long")).alias("n_excluded"))
    total = F.col("n_eligible") + F.col("n_excluded")
    return n.select(F.lit(test).alias("test"), "n_eligible", "n_excluded", F.round(F.when(total > 0, 100 * F.col("n_excluded") / total).otherwise(0.0), 2).alias("percent"), F.lit(rule).alias("rule"))

"""A second opinion on a concordance: near-equal windows, the term's link with the node, extra-musical domains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import fixed
from corvane.functions import text as T
from corvane.operators.contexts import let
from corvane.operators.dedupe import path_preference
from corvane.operators.tables import components, settle

SHINGLE, CHARACTERS, LEAST_WORDS = 5, 24, 8
JACCARD, CONTAINMENT, MOST = 0.45, 0.80, 25


def signature(context: Column) -> Column:
    """Distinct 5-word shingles of a window, or, below 8 words, 24-character grams of its letters; a window of fewer is its own gram."""

    def of(words):
        n = F.size(words)
        steps = lambda k: F.when(k > 0, F.sequence(F.lit(1), F.greatest(k, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        shingles = F.transform(steps(n - (SHINGLE - 1)), lambda i: F.array_join(F.slice(words, i, SHINGLE), " "))
        chars = let(F.array_join(words, ""), lambda s: F.when(F.length(s) >= CHARACTERS, F.transform(steps(F.length(s) - (CHARACTERS - 1)), lambda i: F.substr(s, i, F.lit(CHARACTERS)))).otherwise(F.array(s)))
        return F.when(n >= LEAST_WORDS, shingles).otherwise(chars)

    return F.array_distinct(let(F.array_remove(F.split(T.plain(context), " "), ""), lambda w: F.when(F.size(w) > 0, of(w)).otherwise(F.array().cast("array<string>"))))


def duplicate_groups(rows: DataFrame, jaccard: float = JACCARD, containment: float = CONTAINMENT, most: int | None = None) -> DataFrame:
    """(id, first): groups of rows (id, context) whose windows are near-equal, by the least id.

    Near-equal rows share at least two grams (if most is given, two that 2 to most
    rows have) and are alike on all their grams, which travel as 64-bit hashes.  Rows
    with equal grams are one kind, and kinds are compared: through the grams of few
    rows if most is given, otherwise through the rarest grams of the smaller kind.
    """
    hashed = F.array_sort(F.array_distinct(F.transform(signature(F.col("context")), lambda g: F.xxhash64(g))))
    signed = settle(rows.select("id", hashed.alias("sig")), "signatures").where(F.size("sig") > 1)  # a single gram cannot be two
    kinds = settle(signed.groupBy("sig").agg(F.min("id").alias("kind"), F.count(F.lit(1)).alias("w")), "kinds")
    grams = kinds.select("kind", "w", F.size("sig").alias("n"), F.explode("sig").alias("gram"))
    # A common gram is counted before its rows are gathered.
    counts = grams.groupBy("gram").agg(F.sum("w").alias("k"), F.count(F.lit(1)).alias("kinds")).where("k > 1" + (f" and k <= {most}" if most else ""))
    held = settle(grams.join(counts, "gram"), "grams")
    pairs = few_pairs(held) if most else prefix_pairs(held, min(containment, 2 * jaccard / (1 + jaccard)))
    side = lambda c: kinds.select(F.col("kind").alias(c), F.col("sig").alias(f"sig_{c}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b")
    both, n, m = F.size(F.array_intersect("sig_a", "sig_b")), F.size("sig_a"), F.size("sig_b")
    alike = met.where((both >= 2) & ((both / (n + m - both) >= jaccard) | (both / F.least(n, m) >= containment))).select("a", "b")
    # Rows of one kind are equal: those that have two grams of the sort that counts are linked with the first of them.
    linked = held.groupBy("kind").agg(F.count(F.lit(1)).alias("own"), F.first("w").alias("w")).where("own > 1 and w > 1").select("kind")
    equal = signed.join(kinds.where("w > 1").join(linked, "kind").select("sig", F.col("kind").alias("a")), "sig").where("id != a").select("a", F.col("id").alias("b"))
    return components(settle(alike.unionByName(equal), "links")).select("id", F.col("component").alias("first"))


def few_pairs(grams: DataFrame) -> DataFrame:
    """(a, b): kinds that share two of the grams (kind, gram), each gram being of few kinds."""
    pair = lambda ids: F.flatten(F.transform(ids, lambda a, i: F.transform(F.slice(ids, i + 2, F.greatest(F.size(ids) - i - 1, F.lit(0))), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    shared = grams.where("kinds > 1").groupBy("gram").agg(F.array_sort(F.collect_set("kind")).alias("ids"))
    return shared.select(F.explode(pair(F.col("ids"))).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("k")).where("k >= 2").select("a", "b")


def prefix_pairs(grams: DataFrame, share: float) -> DataFrame:
    """(a, b): kinds that may have share of the smaller one's n grams in common, from grams (kind, n, gram, kinds).

    The smaller one then has one of the common grams among its rarest n - share * n + 1,
    those without a partner counted first; only these are looked up among all grams.
    """
    least = F.greatest(F.ceil(F.col("n") * F.lit(share - 1e-6)), F.lit(2))
    shared = grams.where("kinds > 1").select("kind", "n", "gram", "kinds")
    own = shared.groupBy("kind", "n").agg(F.array_sort(F.collect_list(F.struct("kinds", "gram"))).alias("g"))
    # Grams of no other kind are the rarest of all, and take their places ahead.
    places = F.col("n") - least + 1 - (F.col("n") - F.size("g"))
    rare = own.where(places > 0).select(F.col("kind").alias("x"), F.col("n").alias("nx"), F.explode(F.slice("g", F.lit(1), places.cast("int"))).alias("e")).select("x", "nx", F.col("e.gram").alias("gram"))
    met = rare.join(shared.select("gram", F.col("kind").alias("y"), F.col("n").alias("ny")), "gram").where("x != y and nx <= ny")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def grouped(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """rows (id, nuclear, passage, path, context) with first, tracked (all of a group are one passage) and kept.

    Of the nuclear rows of a group the one with the best path, then the longest
    window, then the least id is kept; the others are not.
    """
    h = rows.join(groups, "id", "left")
    known = groups.join(rows.select("id", "nuclear", "passage", "path", "context"), "id").groupBy("first").agg(
        (F.count(F.lit(1)) == F.count("passage")).alias("_all"), F.countDistinct("passage").alias("_passages"), F.max(F.when(F.col("nuclear"), F.struct(path_preference(F.col("path")).alias("p"), F.length("context").alias("n")))).alias("_top")
    )
    h = h.join(known, "first", "left")
    score = F.struct(path_preference(F.col("path")).alias("p"), F.length("context").alias("n"))
    leading = h.where(F.col("nuclear") & (score == F.col("_top"))).groupBy(F.col("first").alias("_f")).agg(F.min("id").alias("_keep"))
    h = h.join(leading, F.col("first") == F.col("_f"), "left")
    lost = F.col("nuclear") & F.col("_keep").isNotNull() & (F.col("id") != F.col("_keep"))
    return h.withColumns({"tracked": F.col("_all") & (F.col("_passages") == 1), "kept": ~lost}).drop("_all", "_passages", "_top", "_f", "_keep")


def classify(context: Column, form: Column, node: str, heads: list[str] = fixed.OTHER_HEADS) -> Column:
    """struct(relation, evidence): how a form is linked with the node in its window, by the first pattern that is found.

    node is a regex of folded node words.  Coordination counts only with a head that
    is no texture; what fits no pattern is unresolved.
    """
    gap = r"(?:\w+\s+){0,3}"
    c, t = F.concat(F.lit(" "), T.plain(context), F.lit(" ")), T.plain(form)
    pattern = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    coordinated = [
        pattern(t, rf"\s+of\s+(?:\w+\s+){{0,6}}?{node}\s+(?:and|e|,)\s+((?:\w+\s*){{1,3}})"),
        pattern(t, rf"s?\s+of\s+((?:\w+\s*,?\s*){{1,6}})\band\s+{gap}{node}"),
        pattern(rf"{node}\s+(?:is|are|was|were)?\s*", t, r"(?:ed|d|s)?\s+with\s+((?:\w+\s*){1,4})"),
        pattern(t, rf"(?:ed|d|s|ing)?\s+(?:\w+\s+){{0,2}}with\s+(?:\w+\s+){{0,2}}{node}\s+and\s+((?:\w+\s*){{1,3}})"),
    ]
    later = [
        ("into_texture", pattern(t, rf"(?:ed|s)?\s+(?:in)?to\s+(?:a|an|the|one)?\s*{gap}{node}")),
        ("with_texture", pattern(t, rf"(?:ed|s)?\s+with\s+(?:a|an|the)?\s*{gap}{node}")),
        ("direct", pattern(t, rf"\s+(?:of|de|d)\s+{gap}{node}")),
        ("direct", pattern(rf"{node}\s+{gap}", t)),
        ("direct", pattern(t, rf"\s+{gap}{node}")),
        ("direct", pattern(rf"{node}\s+(?:is|are|as)\s+(?:\w+\s+){{0,2}}", t)),
    ]
    extract = lambda p, group: F.call_function("regexp_extract", c, p, F.lit(group))
    result = lambda name, evidence: F.struct(F.lit(name).alias("relation"), F.trim(evidence).alias("evidence"))
    out = F.when((t == "") | ~F.contains(c, t), result("absent", F.lit("matched form not found in window")))
    head = lambda x: F.arrays_overlap(F.split(F.trim(x), r"\s+"), F.array(*map(F.lit, heads)))
    for p in coordinated:
        out = out.when(F.regexp_like(c, p) & head(extract(p, 1)), result("coord_heterog", extract(p, 0)))
    for name, p in later:
        out = out.when(F.regexp_like(c, p), result(name, extract(p, 0)))
    out = out.when(~c.rlike(node), result("absent", F.lit("no texture token in window")))
    return F.coalesce(out.otherwise(result("unresolved", F.lit(""))), result("absent", F.lit("matched form not found in window")))


def domain_cue(context: Column, cues: dict[str, list[str]] = fixed.DOMAIN_CUES) -> Column:
    """struct(domain, cue) of the first cue that the folded window contains; null without one."""
    c = T.plain(context)
    out = None
    for domain, words in cues.items():
        for cue in words:
            value = F.struct(F.lit(domain).alias("domain"), F.lit(cue).alias("cue"))
            out = F.when(c.contains(cue), value) if out is None else out.when(c.contains(cue), value)
    return out


def report(h: DataFrame) -> DataFrame:
    """(measure, key, n) of an annotated concordance (id, doc_id, first, tracked, qa_relation, qa_domain, nuclear)."""
    n = F.count(F.lit(1)).alias("n")
    line = lambda df, name, key: df.select(F.lit(name).alias("measure"), F.coalesce(key, F.lit("")).alias("key"), "n")
    relations = line(h.groupBy("qa_relation").agg(n), "relation", F.col("qa_relation"))
    domains = line(h.where("qa_domain is not null").groupBy("qa_domain").agg(n), "domain", F.col("qa_domain"))
    suspect = line(h.agg(F.coalesce(F.sum((F.col("nuclear") & F.col("qa_relation").isin("absent", "coord_heterog")).cast("long")), F.lit(0)).alias("n")), "nuclear_but_suspect", F.lit(""))
    groups = h.where("first is not null").groupBy("first").agg(F.first("tracked").alias("tracked"), (F.min("doc_id") != F.max("doc_id")).alias("cross"), F.count(F.lit(1)).alias("rows"))
    kind = F.when(F.col("tracked"), "tracked").when(F.col("cross"), "cross_document").otherwise("within_document")
    found = groups.groupBy(kind.alias("kind")).agg(n)
    return relations.unionByName(domains).unionByName(suspect).unionByName(line(found, "duplicate_groups", F.col("kind")))

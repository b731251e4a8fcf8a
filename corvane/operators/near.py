"""NEAR extraction: field terms paired with the nearest node of their sentence, found within the row.

``windows`` adds to each context its nodes, terms, pairs, hits, reference node and
counts as arrays; nothing is shuffled, and only hits are exploded.  A term looks for
its node among the few tokens around it first, and through all nodes of its context
only where there is none, so long lines do not cost terms times nodes.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import fixed
from corvane.functions import text as T
from corvane.operators import contexts as X

AROUND = 16


def positions(low: Column, high: Column) -> Column:
    """low .. high, or nothing."""
    return F.when(low <= high, F.sequence(low, F.greatest(low, high))).otherwise(F.array().cast("array<int>"))


def node_indexes(tok: Column, nodes: list[str]) -> Column:
    """Places of all node words."""
    return F.filter(F.transform(tok, lambda t, i: F.when(t.isin(list(nodes)), i)), lambda i: i.isNotNull())


def term_scan(tok: Column, field: dict[str, list[str]]) -> Column:
    """array<struct<idx, n, term>>: at each place the first label, in field order, by its longest pattern that matches."""
    first = "|".join(dict.fromkeys(seq[0] for _, seqs in T.compiled(field) for seq in seqs))

    def label(t, i):
        out = None
        for name, seqs in T.compiled(field):
            for seq in seqs:
                hit = t.rlike(seq[0])
                for k, word in enumerate(seq[1:], 1):
                    hit = hit & F.coalesce(F.get(tok, i + k).rlike(word), F.lit(False))
                value = F.struct(i.alias("idx"), F.lit(len(seq)).alias("n"), F.lit(name).alias("term"))
                out = F.when(hit, value) if out is None else out.when(hit, value)
        return F.when(t.rlike(first), out)

    return F.filter(F.transform(tok, label), lambda t: t.isNotNull())


def spans_gap(idx: Column, n: Column, node: Column) -> Column:
    """Tokens from a node to the nearest end of a span."""
    return F.when(node < idx, idx - node).otherwise(node - (idx + n - 1))


def nearest(terms: Column, nodes: Column, tok: Column, sent: Column, node_words: list[str], same_sentence: bool = True) -> Column:
    """terms with the nearest node by (distance, leftmost, node); without one where no node outside the span is in reach."""
    size = F.size(tok)

    def pair(t):
        idx, n = t["idx"], t["n"]
        end = idx + n - 1
        own = F.get(sent, idx)
        fits = lambda i: ((i < idx) | (i > end)) & ((F.get(sent, i) == own) if same_sentence else F.lit(True))
        ranked = lambda found: F.array_min(F.transform(F.filter(found, fits), lambda i: F.struct(spans_gap(idx, n, i).alias("distance"), F.least(i, idx).alias("left"), i.alias("node"))))
        around = F.filter(positions(F.greatest(idx - AROUND, F.lit(0)), F.least(end + AROUND, size - 1)), lambda i: F.get(tok, i).isin(list(node_words)))
        best = F.when(F.size(nodes) <= AROUND, ranked(nodes)).otherwise(F.coalesce(ranked(around), ranked(nodes)))
        whole = (F.get(sent, end) == own) if same_sentence else F.lit(True)
        return F.struct(idx.alias("idx"), n.alias("n"), t["term"].alias("term"), F.when(whole, best).alias("best"))

    return F.transform(terms, pair)


def close_words(nodes: list[str], field: dict[str, list[str]], near: int) -> str:
    """A regex found in every text with a hit: a node and the beginning of a term, at most near tokens apart.

    It finds some texts without a hit too, as words are not looked at to their ends.
    """
    letter, gap, token = f"[{T.LETTERS}]", f"[^{T.LETTERS}]++", T.LOOPS[T.TOKEN]
    rest = f"(?:[{T.LETTERS}'’]|-{letter})*+"

    def word(w):
        core, before, after = re.escape(w.strip("*")), f"[{T.LETTERS}'’-]*?" if w.startswith("*") else "", rest if w.endswith("*") else f"(?!{letter}){rest}"
        return f"{before}(?{'i' if core.isascii() else 'iu'}:{core}){after}"

    between = f"(?:{gap}{token}){{0,{near - 1}}}{gap}"
    term = "(?:" + "|".join(dict.fromkeys(gap.join(map(word, p.split())) for patterns in field.values() for p in patterns)) + ")"
    node = "(?:" + "|".join(map(word, nodes)) + ")"
    return f"(?<!{letter})(?:{node}{between}{term}|{term}{between}{node})"


def windows(ctx: DataFrame, nodes: list[str], field: dict[str, list[str]], near: int, band: int, same_sentence: bool = True, only_hits: bool = False) -> DataFrame:
    """ctx rows that hold a node (if only_hits, at least those with a hit), with

    tok, sent      tokens and their sentences (doc_id, line, source, lang, context as given)
    nodes          places of nodes
    terms          scanned terms, each with its nearest node (best is null where a boundary shuts all nodes off)
    found          hits: of each term within near, the nearest, the first on ties
    excluded       terms without an admissible node
    ref            the row's reference node: the most frequent among hits, the first on ties, else the leftmost
    far            terms beyond near and within band of ref, of types without a hit
    near_tokens, band_tokens   tokens of ref's sentence within near, and from there to band
    """
    near_each_other = F.col("context").rlike(close_words(nodes, field, near)) if only_hits else F.lit(True)
    rows = X.words(X.with_word(ctx, nodes).where(near_each_other)).withColumn("nodes", node_indexes(F.col("tok"), nodes)).where(F.size("nodes") > 0)
    rows = rows.withColumn("terms", X.let(term_scan(F.col("tok"), field), lambda t: nearest(t, F.col("nodes"), F.col("tok"), F.col("sent"), nodes, same_sentence)))
    close = F.filter("terms", lambda t: t["best"]["distance"] <= near)

    def collapse(c):
        types = F.array_distinct(F.transform(c, lambda t: t["term"]))
        entry = lambda t: F.struct(t["best"]["distance"].alias("distance"), t["best"]["left"].alias("left"), t["idx"].alias("idx"), t["n"].alias("n"), t["term"].alias("term"), t["best"]["node"].alias("node_idx"))
        return F.transform(types, lambda k: F.array_min(F.transform(F.filter(c, lambda t: t["term"] == k), entry)))

    rows = rows.withColumn("found", X.let(close, collapse))
    votes = lambda wins: F.transform(wins, lambda w, i: F.struct(F.size(F.filter(wins, lambda x: x == w)).alias("n"), (-i).alias("first"), w.alias("node")))
    ref = F.when(F.size("found") > 0, F.array_max(X.let(F.transform("found", lambda h: h["node_idx"]), votes))["node"]).otherwise(F.get("nodes", F.lit(0)))
    rows = rows.withColumn("ref", ref)
    at, sent = F.col("ref"), F.col("sent")

    def in_band(t):
        idx, n = t["idx"], t["n"]
        gap = spans_gap(idx, n, at)
        ok = ((at < idx) | (at > idx + n - 1)) & (gap > near) & (gap <= band) & ~F.exists("found", lambda h: h["term"] == t["term"])
        return ok & (F.get(sent, idx) == F.get(sent, at)) & (F.get(sent, idx + n - 1) == F.get(sent, at)) if same_sentence else ok

    def mass(low, high):
        around = positions(F.greatest(at - high, F.lit(0)), F.least(at + high, F.size("tok") - 1))
        return F.size(F.filter(around, lambda k: (F.abs(k - at) > low) & ((F.get(sent, k) == F.get(sent, at)) if same_sentence else F.lit(True))))

    return rows.withColumns(
        {
            "excluded": F.size(F.filter("terms", lambda t: t["best"].isNull())),
            "far": F.filter("terms", in_band),
            "near_tokens": mass(0, near),
            "band_tokens": mass(near, band),
        }
    )


def offset(context: Column, tok: Column, idx: Column) -> Column:
    """The character at which a token starts."""
    zero = F.lit(0)
    total = lambda parts: F.aggregate(parts, zero, lambda n, p: n + F.length(p))
    return total(F.slice(T.gaps(context), 1, idx + 1)) + total(F.slice(tok, 1, idx))


def pairs(rows: DataFrame) -> DataFrame:
    """Every term with its nearest node, at any distance: (doc_id, line, idx, n, term, form, distance, node_idx, node, side)."""
    out = rows.select("doc_id", "line", "tok", F.explode_outer("terms").alias("t")).where("t.best is not null")
    return named(out.select("doc_id", "line", "tok", "t.idx", "t.n", "t.term", "t.best.distance", F.col("t.best.node").alias("node_idx"))).drop("tok")


def named(h: DataFrame) -> DataFrame:
    form = F.array_join(F.slice("tok", F.col("idx") + 1, F.col("n")), " ")
    side = F.when(F.col("idx") < F.col("node_idx"), "esq").when(F.col("idx") > F.col("node_idx"), "dir").otherwise("—")
    return h.withColumns({"form": form, "node": F.get("tok", F.col("node_idx")), "side": side})


HIT = ["doc_id", "line", "idx", "n", "term", "form", "distance", "node_idx", "node", "side"]


def hits(rows: DataFrame, *carried: str) -> DataFrame:
    """One row for each hit (HIT), and the columns of windows that are named."""
    keep = [c for c in carried if c not in ("doc_id", "line")]
    out = rows.select("doc_id", "line", *dict.fromkeys(["tok", *keep]), F.explode_outer("found").alias("h")).where("h is not null")
    out = named(out.select("*", "h.idx", "h.n", "h.term", "h.distance", "h.node_idx").drop("h"))
    return out.select(*HIT, *keep)


def hit_table(rows: DataFrame, field: dict[str, list[str]], near: int) -> DataFrame:
    """hits with what the concordance keeps of them: canonical term, query pattern, offsets, compounds, nodes, censoring."""
    h = hits(rows, "source", "lang", "context", "tok", "nodes", "ref")
    first = None
    for label, patterns in field.items():
        first = F.when(F.col("canonical_term") == label, patterns[0]) if first is None else first.when(F.col("canonical_term") == label, patterns[0])
    h = h.withColumn("canonical_term", T.canonical(F.col("form"), field))
    return h.withColumns(
        {
            "query_pattern": F.coalesce(first, F.col("form")),
            "off_node": offset(F.col("context"), F.col("tok"), F.col("node_idx")),
            "off_term": offset(F.col("context"), F.col("tok"), F.col("idx")),
            "compound": F.col("form").contains("-"),
            "n_nodes": F.size("nodes"),
            "cens_left": F.col("ref") < near,
            "cens_right": F.size("tok") - 1 - F.col("ref") < near,
        }
    ).drop("nodes", "ref")


def band_hits(rows: DataFrame) -> DataFrame:
    """(term, n): terms of the band by type."""
    return rows.select(F.explode_outer("far.term").alias("term")).where("term is not null").groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def token_mass(rows: DataFrame) -> DataFrame:
    """(r1, r2, windows): tokens within near and in the band, over all contexts that hold a node, and how many those are."""
    return rows.agg(F.coalesce(F.sum("near_tokens"), F.lit(0)).alias("r1"), F.coalesce(F.sum("band_tokens"), F.lit(0)).alias("r2"), F.count(F.lit(1)).alias("windows"))


def recomputed(hit_rows: DataFrame, nodes: list[str]) -> DataFrame:
    """hits (HIT, context) with distance2 and side2 computed anew from the context, the form and the node words alone."""
    rows = X.words(hit_rows).withColumn("nodes", node_indexes(F.col("tok"), nodes))
    places = F.filter(F.transform("tok", lambda t, i: i), lambda i: F.array_join(F.slice("tok", i + 1, F.col("n")), " ") == F.col("form"))
    terms = F.transform(places, lambda i: F.struct(i.alias("idx"), F.col("n").alias("n"), F.col("term").alias("term")))
    best = X.let(terms, lambda t: F.array_min(F.transform(F.filter(nearest(t, F.col("nodes"), F.col("tok"), F.col("sent"), nodes), lambda p: p["best"].isNotNull()), lambda p: F.struct(p["best"]["distance"].alias("distance"), p["best"]["left"].alias("left"), p["idx"].alias("idx"), p["best"]["node"].alias("node")))))
    rows = rows.withColumn("again", best)
    side = F.when(F.col("again.idx") < F.col("again.node"), "esq").otherwise("dir")
    return rows.select(*hit_rows.columns, F.col("again.distance").alias("distance2"), side.alias("side2"))


def manifest_hash(paths: DataFrame, column: str = "path") -> DataFrame:
    """SHA-256 of the sorted distinct paths, one a line; the list is as long as the manifest that it stands for."""
    return paths.agg(F.sha2(F.array_join(F.array_sort(F.collect_set(column)), "\n"), 256).alias("manifest_sha256"))


def linear_flags(h: DataFrame, copulas: list[str] = fixed.COPULAS, degrees: list[str] = fixed.DEGREES, modals: list[str] = fixed.MODALS, negations: list[str] = fixed.NEGATIONS, nuclear: list[str] = fixed.NUCLEAR) -> DataFrame:
    """Degree and negation in the three tokens before the term, modality within four, and the heuristic relation.

    ``no`` and ``nos`` are never taken for negations: they also number works.
    """
    idx, node, tok = F.col("idx"), F.col("node_idx"), F.col("tok")
    before = F.slice(tok, F.greatest(idx - 3, F.lit(0)) + 1, F.least(idx, F.lit(3)))
    start = F.greatest(idx - 4, F.lit(0))
    around = F.slice(tok, start + 1, idx + 5 - start)
    low, high = F.least(idx, node), F.greatest(idx, node)
    between = F.slice(tok, low + 2, high - low - 1)
    words = lambda x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    relation = F.when(F.arrays_overlap(between, words(copulas)), "predicativa").when(high - low == 1, "atributiva").otherwise("indeterminada")
    out = h.withColumns(
        {
            "graded": F.arrays_overlap(before, words(degrees)),
            "modal": F.arrays_overlap(around, words(modals)),
            "negated": F.arrays_overlap(before, words([w for w in negations if w not in ("no", "nos")])),
            "relation": relation,
        }
    )
    return out.withColumn("nuclear", F.col("relation").isin(list(nuclear)))

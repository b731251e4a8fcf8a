"""The annotation of hits by dependency trees, over a table of parsed contexts; any parser may fill it.

A parse is an array of tokens (text, off, dep, pos, head), head being a token's
place in the array (its own for a root).  Contexts are parsed once each, however
many hits they have.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import fixed

PARSE = "array<struct<text:string,off:int,dep:string,pos:string,head:int>>"
GENITIVE, ASSOCIATIVE = ("of", "de", "in", "on"), ("with",)
OBJECTS, SUBJECTS = ("dobj", "obj", "oprd", "attr"), ("nsubj", "nsubjpass")
NOMINAL = ("NOUN", "PROPN")


class Tree:
    """One context's tokens, by place."""

    def __init__(self, tokens: list[dict]):
        self.text, self.off, self.dep, self.pos, self.head = ([t[k] for t in tokens] for k in ("text", "off", "dep", "pos", "head"))
        self.below: list[list[int]] = [[] for _ in tokens]
        for i, h in enumerate(self.head):
            if h != i:
                self.below[h].append(i)

    def at(self, off: int) -> int | None:
        return next((i for i, (o, t) in enumerate(zip(self.off, self.text)) if o <= off < o + len(t)), None)

    def within(self, root: int, i: int | None) -> bool:
        """Whether i is root or stands under it."""
        seen = set()
        while i is not None and i not in seen:
            if i == root:
                return True
            seen.add(i)
            i = self.head[i]
        return False

    def lead(self, i: int) -> int:
        """The first of the coordination that i belongs to."""
        seen = set()
        while self.dep[i] == "conj" and self.head[i] != i and i not in seen:
            seen.add(i)
            i = self.head[i]
        return i

    def coordinated(self, i: int) -> list[int]:
        """The other members of a coordination."""
        lead, out, todo = self.lead(i), [], [self.lead(i)]
        while todo:
            j = todo.pop()
            out.append(j)
            todo += [c for c in self.below[j] if self.dep[c] == "conj"]
        return sorted(j for j in out if j != i) if len(out) > 1 else [] if lead == i else [lead]

    def ruled(self, i: int, prepositions) -> Iterator[int]:
        """Objects of prepositions that i, or the first of its coordination, governs."""
        for owner in dict.fromkeys((i, self.lead(i))):
            for p in self.below[owner]:
                if self.dep[p] == "prep" and self.text[p].lower() in prepositions:
                    yield from (o for o in self.below[p] if self.dep[o] in ("pobj", "nmod"))


def genitive(t: Tree, node: int, term: int, prepositions) -> bool:
    if any(t.within(o, node) for o in t.ruled(term, prepositions)):
        return True
    if t.dep[node] not in ("pobj", "nmod"):
        return False
    above = t.head[node]
    owner = t.head[above] if t.dep[above] == "prep" else above
    return owner in (term, t.lead(term))


def shared_modifier(t: Tree, node: int, term: int) -> bool:
    """A term that modifies the node together with other adjectives."""
    if t.pos[node] not in NOMINAL:
        return False
    own = [c for c in t.below[node] if t.dep[c] == "amod"]
    if any(term == c or term in t.coordinated(c) for c in own):
        return True
    between = range(term + 1, node)
    light = ("and", "or", "but", ",", "the", "a", "an")
    return t.pos[term] == "ADJ" and len(between) > 0 and all(t.text[k].lower() in light or t.dep[k] in ("cc", "punct", "det", "amod", "conj") for k in between)


def relation(t: Tree, node: int, term: int, prepositions=GENITIVE) -> tuple[str, str, str, str]:
    """(relation, governor, head of the property, review tag) by the first rule that holds."""
    base = t.lead(term)
    up, dep = t.head[base], t.dep[base]
    joined = t.dep[term] == "conj"
    outer = "" if up == base else t.text[up]
    own = t.text[node]
    under = lambda kinds: [c for c in t.below[up] if t.dep[c] in kinds] if up != base else []
    if genitive(t, node, term, prepositions):
        return "nominal_genitiva", outer, own, "" if t.dep[term] in ("pobj", "nmod", "") else "genitiva_por_complemento"
    if t.dep[node] == "advmod" and t.head[node] == term:
        return "adverbial", outer or t.text[t.head[term]], own, ""
    if dep == "advmod" and t.pos[up] in ("ADJ", "ADV") and up != node:
        return "adverbial_de_grau", t.text[up], t.text[up], ""
    if dep == "advmod" and t.pos[up] == "VERB":
        return "adverbial_verbal", t.text[up], t.text[up], ""
    if dep in ("oprd", "xcomp") and any(t.within(c, node) for c in under(OBJECTS + SUBJECTS)):
        return "predicativa_secundaria", outer or t.text[up], own, ""
    if dep in ("acomp", "attr") and (subjects := under(SUBJECTS)):
        if t.within(subjects[0], node):
            return "predicativa", outer or t.text[up], own, ""
        return "incidental", t.text[subjects[0]], t.text[subjects[0]], ""
    if dep in ("amod", "appos") and up == node:
        return "atributiva", outer or own, own, "atributiva_via_conj" if joined else ""
    if shared_modifier(t, node, term):
        return "atributiva", outer or own, own, "atributiva_coordenada"
    if t.dep[node] in ("amod", "compound") and t.head[node] == term:
        return "nominal_composto", outer or t.text[t.head[term]], own, ""
    if dep == "compound" and up == node:
        return "atributiva", outer or own, own, ""
    if joined and up != node and not t.within(up, node):
        return "coordenada", t.text[up], t.text[up], ""
    return "incidental", t.text[up], t.text[up], ""


def warnings(t: Tree, node: int, term: int, associative=ASSOCIATIVE, prefix: str = fixed.NODE_PREFIX) -> list[str]:
    """Tags of nuclear hits whose node is coordinated with another noun, or whose term is linked with one."""
    other = lambda i: t.pos[i] in NOMINAL and not re.match(prefix, t.text[i], re.I)
    out = [f"coordenacao_heterogenea:{t.text[i]}" for i in t.coordinated(node) if other(i)][:1]
    out += [f"associativa_com_nao_textural:{t.text[i]}" for i in t.ruled(term, associative) if other(i) and not t.within(i, node)][:1]
    return out


def negation(t: Tree, node: int | None, term: int) -> str:
    """directo where a term's own predicate is negated, indirecto where a verb above it is, else nao."""
    base = t.lead(term)
    predicative = t.dep[base] in ("acomp", "attr", "oprd", "xcomp")
    pred = t.head[base] if predicative or t.dep[base] in ("amod", "advmod") else t.head[term]
    for i, word in enumerate(t.text):
        if t.dep[i] != "neg" and word.lower() not in fixed.QUERY_NEGATIONS:
            continue
        over = t.head[i]
        if not (over in (pred, term) or t.within(over, pred) or t.within(over, term)):
            continue
        if over in (pred, t.head[base]) and predicative:
            return "directo"
        if t.within(over, term):
            if t.pos[over] == "VERB" and over != pred:
                return "indirecto"
            if over == pred:
                return "directo"
    return "nao"


def modal(t: Tree, term: int, modals=tuple(fixed.MODALS), reach: int = 5) -> bool:
    """A modal word near the term, above it or below it."""
    return any(w.lower() in modals and (abs(i - term) <= reach or t.within(i, term) or t.within(term, i)) for i, w in enumerate(t.text))


def annotate(tokens: list[dict], off_node: int, off_term: int, prepositions=GENITIVE, associative=ASSOCIATIVE) -> dict:
    """What the concordance shows of one hit."""
    t = Tree(tokens)
    node, term = t.at(off_node), t.at(off_term)
    if node is None or term is None:
        return {"relation": "indeterminada", "orientation": "termo_sobre_outro", "governor": "", "path": "", "nuclear": False, "motive": "indeterminada", "head": "", "tags": "", "negation": "nao", "modal": False}
    rel, governor, head, tag = relation(t, node, term, prepositions)
    nuclear = rel in fixed.NUCLEAR
    orientation = "termo_sobre_outro" if not nuclear else "no_sobre_termo" if rel in ("nominal_composto", "nominal_genitiva", "adverbial") else "termo_sobre_no"
    tags = [tag] if tag else []
    tags += warnings(t, node, term, associative) if nuclear else []
    return {
        "relation": rel,
        "orientation": orientation,
        "governor": head if governor.lower() == t.text[term].lower() else governor,
        "path": f"{t.text[term]}/{t.dep[term]}->{t.text[t.head[term]]}",
        "nuclear": nuclear,
        "motive": "" if nuclear else rel,
        "head": head,
        "tags": "; ".join(tags),
        "negation": negation(t, node, term),
        "modal": modal(t, term),
    }


SHOWN = "relation string, orientation string, governor string, path string, nuclear boolean, motive string, head string, tags string, negation string, modal boolean"


def parsed_contexts(h: DataFrame, parse: Callable[[list[str]], list[list[dict]]], batch: int = 64) -> DataFrame:
    """(context, parse) of the distinct contexts of h; parse takes a batch of texts, and is made ready once a worker by its caller."""

    def run(batches):
        for b in batches:
            texts = b["context"].tolist()
            for i in range(0, len(texts), batch):
                part = texts[i : i + batch]
                yield pd.DataFrame({"context": part, "parse": parse(part)})

    return h.select("context").distinct().mapInPandas(run, f"context string, parse {PARSE}")


def with_dependencies(h: DataFrame, parses: DataFrame, prepositions=GENITIVE, associative=ASSOCIATIVE) -> DataFrame:
    """h (context, off_node, off_term) with the columns SHOWN by the parses (context, parse) of its contexts."""
    names = [c.split()[0] for c in SHOWN.split(", ")]

    @F.pandas_udf(f"struct<{', '.join(':'.join(c.split()) for c in SHOWN.split(', '))}>")
    def shown(parse: pd.Series, node: pd.Series, term: pd.Series) -> pd.DataFrame:
        rows = [annotate(list(p) if p is not None else [], int(a), int(b), prepositions, associative) for p, a, b in zip(parse, node, term)]
        return pd.DataFrame(rows, columns=names)

    joined = h.drop(*names).join(parses.select(F.col("context").alias("_context"), "parse"), F.col("context") == F.col("_context"), "left")
    return joined.withColumn("_d", shown("parse", "off_node", "off_term")).select(*[c for c in h.columns if c not in names], "_d.*", F.lit("dependencias").alias("classified_by"))

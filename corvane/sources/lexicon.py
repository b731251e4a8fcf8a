"""Word lists, fields and rules from files.  They are small and are read by the driver; anything wrong is an error."""

from __future__ import annotations

from pathlib import Path

from corvane.functions import fixed
from corvane.functions import text as T

SOURCES = ("path", "janela", "ambos", "sistema")


class LexiconError(ValueError):
    """A lexicon file is missing, empty or malformed."""


def rows_of(path: str | Path, header: str, columns: int) -> list[list[str]]:
    """The rows below an optional header line; blank lines and # comments do not count."""
    path = Path(path)
    if not path.is_file():
        raise LexiconError(f"lexicon is missing: {path}")
    try:
        text = path.read_text(encoding="utf-8-sig")
    except UnicodeDecodeError as e:
        raise LexiconError(f"lexicon is not UTF-8: {path}") from e
    lines = [x.strip() for x in text.splitlines()]
    lines = [x for x in lines if x and not x.startswith("#")]
    if not lines:
        raise LexiconError(f"lexicon has no entries: {path}")
    if lines[0].split("\t")[0] == header:
        lines = lines[1:]
    if not lines:
        raise LexiconError(f"lexicon has no entries below its header: {path}")
    out = []
    for i, line in enumerate(lines, 1):
        parts = [p.strip() for p in line.split("\t")]
        if len(parts) != columns or not all(parts):
            raise LexiconError(f"{path}: row {i} needs {columns} values: {line!r}")
        out.append(parts)
    return out


def read_words(path: str | Path) -> list[str]:
    """One column of words."""
    return list(dict.fromkeys(w for (w,) in rows_of(path, "token", 1)))


def read_nodes(path: str | Path) -> dict[str, list[str]]:
    """Node words by language."""
    out: dict[str, list[str]] = {}
    for lang, form in rows_of(path, "lingua", 2):
        forms = out.setdefault(lang.lower(), [])
        if form.lower() not in forms:
            forms.append(form.lower())
    return out


def read_cues(path: str | Path) -> dict[str, list[str]]:
    """Cues by domain, in the order of the file."""
    out: dict[str, list[str]] = {}
    for domain, cue in rows_of(path, "dominio", 2):
        cues = out.setdefault(domain, [])
        if cue.lower() not in cues:
            cues.append(cue.lower())
    return out


def read_friends(path: str | Path) -> dict[str, str]:
    """Motives by form."""
    return {form.lower(): motive for form, motive in rows_of(path, "forma", 2)}


def read_domains(path: str | Path) -> dict[str, str]:
    """Where each domain may come from."""
    out = {}
    for domain, source in rows_of(path, "dominio", 2):
        if source not in SOURCES:
            raise LexiconError(f"{path}: unknown source {source!r} of {domain}")
        out[domain] = source
    return out


def path_domains(sources: dict[str, str] = fixed.DOMAIN_SOURCES) -> list[str]:
    return [d for d, s in sources.items() if s in ("path", "ambos")]


def read_rules(path: str | Path) -> list[tuple[str, str]]:
    """(pattern, domain) in order; what follows # on a line, and lines without a tab, do not count. A missing file has no rules."""
    path = Path(path)
    if not path.is_file():
        return []
    out = []
    for line in path.read_text(encoding="utf-8-sig").splitlines():
        line = line.split("#", 1)[0].strip()
        if "\t" in line:
            pattern, domain = (x.strip() for x in line.split("\t", 1))
            if pattern and domain:
                out.append((pattern, domain.lower()))
    return out


def rules_path(own: str | Path, canonical: str | Path) -> tuple[Path, str | None]:
    """The file of path rules that counts, and a warning: the canonical one, or one's own where only that has rules.

    Files that both have rules must have the same ones.
    """
    own, canonical = Path(own), Path(canonical)
    a, b = set(read_rules(own)), set(read_rules(canonical))
    if a and b and a != b:
        raise LexiconError(f"rules differ: {own} ({len(a)}) and {canonical} ({len(b)})")
    if a and b:
        return canonical, f"{own} repeats {canonical}"
    return (own, f"{own} is used in place of {canonical}") if a else (canonical, None)


def parse_field(text: str, known: dict[str, list[str]] | None = None, prefix: str = fixed.NODE_PREFIX, nodes: list[str] = ()) -> tuple[dict[str, list[str]], dict[str, str], list[str]]:
    """A field from lines ``label [: pole] = pattern, pattern``: (patterns by label, pole by label, warnings).

    A line whose label is a node word gives its patterns to the labels of known that
    have them, or to labels of their stems.
    """
    field: dict[str, list[str]] = {}
    poles: dict[str, str] = {}
    warnings = []
    node = lambda w: T.is_node_word(w, prefix, nodes)
    for line in text.splitlines():
        line = line.split("#", 1)[0].strip()
        if "=" not in line:
            continue
        label, right = (x.strip() for x in line.split("=", 1))
        label, _, pole = (x.strip() for x in label.partition(":"))
        patterns = [p.strip() for p in right.split(",") if p.strip()]
        if not patterns:
            continue
        pole = {"E": "E", "V": "V"}.get(pole[:1].upper())
        if not node(label):
            field[label] = patterns
            poles |= {label: pole} if pole else {}
            continue
        warnings.append(f"{label} is a node word; its patterns are taken for the field: {patterns}")
        for p in (p for p in patterns if not node(p)):
            own = stem(p)
            own = next((k for k, ps in (known or {}).items() if p in ps or own in map(stem, ps)), own)
            if p not in field.setdefault(own, []):
                field[own].append(p)
            poles |= {own: pole} if pole else {}
    bad = [k for k in field if node(k)]
    if bad:
        raise LexiconError(f"labels are node words: {bad}")
    return field, poles, warnings


def stem(pattern: str) -> str:
    return pattern.strip().lower().strip("*")


def effective(field: dict[str, list[str]], stable: list[str], variable: list[str], synchronic: list[str], diachronic: list[str]) -> list[tuple[str, str, str, str]]:
    """(label, patterns, pole, axis) of a field, as run."""
    pole = lambda k: fixed.POLES[0] if k in stable else fixed.POLES[1] if k in variable else ""
    axis = lambda k: fixed.AXES[0] if k in synchronic and k not in diachronic else fixed.AXES[1] if k in diachronic and k not in synchronic else fixed.AXES[2]
    return [(k, ", ".join(v), pole(k), axis(k)) for k, v in field.items()]


def infer_pole(label: str, patterns: list[str], stable: list[str], variable: list[str]) -> str | None:
    """The pole of a label, else of its patterns: by their stems, or by a pole word that a stem begins, or that begins it."""
    for name, words in (("E", stable), ("V", variable)):
        if label in words:
            return name
    for s in map(stem, patterns):
        for test in (lambda w: s == w, lambda w: w.startswith(s) or s.startswith(w[: max(4, len(s))])):
            for name, words in (("E", stable), ("V", variable)):
                if any(test(w) for w in words):
                    return name
    return None


def field_text(field: dict[str, list[str]], poles: dict[str, str], prefix: str = fixed.NODE_PREFIX) -> str:
    """A field as parse_field reads it, without node words."""
    lines = []
    for label, patterns in field.items():
        own = [p for p in patterns if not T.is_node_word(p, prefix)]
        if own and not T.is_node_word(label, prefix):
            lines.append(f"{label}{f':{poles[label]}' if poles.get(label) else ''} = {', '.join(own)}")
    return "\n".join(lines) + "\n"


LANGUAGES = {"en": ["of"], "pt": ["de", "do", "da"], "fr": ["de", "du", "des"], "de": ["von"]}


def language(code: str, nodes: dict[str, list[str]] = fixed.NODES) -> dict:
    """What a run of one language uses: its nodes and genitive prepositions; ``todas`` has the nodes of all."""
    if code == "todas":
        return {"code": code, "nodes": sorted({w for v in nodes.values() for w in v}), "prepositions": LANGUAGES["en"]}
    if code not in nodes:
        raise LexiconError(f"unknown language {code!r}; there are {sorted(nodes)} and todas")
    return {"code": code, "nodes": nodes[code], "prepositions": LANGUAGES.get(code, LANGUAGES["en"])}


def merged(default: dict, own: dict | None, query: str = "") -> dict:
    """Captions: own over default, group by group; ``{query}`` in a text is the query."""
    out = {k: dict(v) if isinstance(v, dict) else v for k, v in default.items()}
    for k, v in (own or {}).items():
        out[k] = out[k] | v if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    fill = lambda v: v.replace("{query}", query) if isinstance(v, str) else {a: fill(b) for a, b in v.items()} if isinstance(v, dict) else v
    return {k: fill(v) for k, v in out.items()}

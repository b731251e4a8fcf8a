"""Text functions as Column expressions: normalising, tokens, patterns, identity, bibliographic fields."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions import fixed

LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Word characters that a token can have.
WORD = LETTER + "0-9_"
TOKEN = f"[{LETTER}](?:[{LETTER}'’]|-[{LETTER}])*"
QUERY_TOKEN = f"[{LETTER}][{LETTER}'’]*"
#: Word characters and white space of any script, spelled out as engines differ on the short forms.
ANY_WORD = r"[\p{L}\p{N}_]"
SPACE = r"[\t\n\x{0B}\f\r \x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: Texts of letters and signs below 256 whose only white space is the blank: these need no search for other kinds.
SINGLE_SPACED = "^[" + "".join(rf"\x{{{c:02X}}}" for c in (*range(0x20, 0x7F), *range(0xA1, 0x100))) + r"]*+\z"
#: LETTER one by one: Java looks single letters up in a table, and tries ranges one after the other.
LETTERS = "".join(c for c in map(chr, range(0x100)) if re.fullmatch(f"[{LETTER}]", c))
#: The same tokens by simple loops, which Java matches faster.
LOOPS = {TOKEN: f"[{LETTERS}][{LETTERS}'’]*+(?:-[{LETTERS}][{LETTERS}'’]*+)*+", QUERY_TOKEN: f"[{LETTERS}][{LETTERS}'’]*+"}
#: No character: it stands for a sentence end where the text has none of its own.
MARK = "\uffff"
STOPS = r"""[.!?;]+["'”’)\]]*""" + SPACE


def normalise(text: Column, trim: bool = True) -> Column:
    """Line ends to blanks, words broken by a hyphen glued, white space collapsed."""
    glued = F.regexp_replace(F.regexp_replace(text, r"[\n\r]", " "), rf"({ANY_WORD})-{SPACE}+({ANY_WORD})", "$1$2")
    out = F.when(text.rlike(SINGLE_SPACED) & ~text.contains("  ") & ~text.contains("- "), text).otherwise(F.regexp_replace(glued, f"{SPACE}+", " "))
    return F.trim(out) if trim else out


def tokens(text: Column, pattern: str = TOKEN) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(LOOPS.get(pattern, pattern)), F.lit(0)), lambda t: F.lower(t))


def gaps(text: Column, pattern: str = TOKEN) -> Column:
    """What stands before each token; one more for the end."""
    loops = LOOPS.get(pattern, pattern)
    return F.when(text.contains(MARK), F.split(text, loops)).otherwise(F.split(F.regexp_replace(text, loops, MARK), MARK))


def boundary(abbreviations: list[str] = fixed.ABBREVIATIONS) -> str:
    """The end of a sentence, but not after an abbreviation that touches the stop, nor an ellipsis."""
    words = "|".join(re.escape(a) for a in sorted(abbreviations, key=len, reverse=True))
    return rf"""(?=[.!?;])(?<![.!?;])(?<!(?<![A-Za-zÀ-ÿ.])(?iu:{words}))(?!\.\.\.)[.!?;]++["'”’)\]]*+{SPACE}"""


def sentences(text: Column, pattern: str = TOKEN, abbreviations: list[str] = fixed.ABBREVIATIONS) -> Column:
    """The tokens of each sentence: no token reaches across a boundary, so each is cut out by itself.

    Split compiles its regex for each row, replace does so once: ends are replaced by a
    mark, and the text is split at that.
    """
    whole, ends = F.concat(text, F.lit(" ")), boundary(abbreviations)
    pieces = F.when(text.contains(MARK), F.split(whole, ends)).otherwise(F.split(F.regexp_replace(whole, ends, MARK), MARK))
    return F.transform(pieces, lambda s: tokens(s, pattern))


def extract_pattern(p: str) -> str:
    """A truncated pattern (``p*``, ``*p``, ``*p*`` or exact) as an anchored regex for lowered tokens."""
    core = re.escape(p.strip("*")) if p.strip("*") else ""
    inner = rf"[{WORD}-]{{0,20}}"
    if p.startswith("*") and p.endswith("*"):
        return f"^{inner}{core}{inner}$"
    if p.endswith("*"):
        return rf"^{core}[{WORD}]{{0,20}}$"
    if p.startswith("*"):
        return rf"^(?:[{WORD}-]*-)?{core}$"
    return f"^{re.escape(p)}$"


def query_pattern(p: str) -> str:
    """A query wildcard: ``*`` up to 14 word characters, ``?`` one."""
    return "^" + "".join(rf"[{WORD}]{{0,14}}" if c == "*" else f"[{WORD}]" if c == "?" else re.escape(c) for c in p.lower()) + "$"


def glued(form: Column, suffixes: list[str] = fixed.GLUED_ENDS) -> Column:
    """Words run together: over 22 letters, or 10 and more with one of some words for an end."""
    return (F.length(form) > 22) | ((F.length(form) >= 10) & form.rlike("(?:" + "|".join(suffixes) + ")$"))


def stem(p: Column) -> Column:
    """A pattern without its wildcards at both ends; of a form without any, the form."""
    return F.regexp_replace(F.lower(F.trim(p)), r"^\*(.*?)\*?$|^(.*?)\*$", "$1$2")


def word_sequence(pattern: str) -> list[str]:
    """The regexes of a pattern's words."""
    return [extract_pattern(w) for w in pattern.split()]


def compiled(field: dict[str, list[str]]) -> list[tuple[str, list[list[str]]]]:
    """Labels in field order, each with its patterns' word regexes, the longest first."""
    return [(label, sorted((word_sequence(p) for p in patterns), key=len, reverse=True)) for label, patterns in field.items()]


def canonical(form: Column, field: dict[str, list[str]], node_prefix: str = "", nodes: list[str] = ()) -> Column:
    """The first label whose pattern matches a form (patterns of several words: equals it); else the form's stem.

    Labels that are node words are passed over.
    """
    out = None
    for label, patterns in field.items():
        if is_node_word(label, node_prefix, nodes):
            continue
        hit = F.lit(False)
        for p in patterns:
            hit = hit | (form == p.lower() if len(p.split()) > 1 else form.rlike(extract_pattern(p)))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return stem(form) if out is None else out.otherwise(stem(form))


def is_node_word(word: str, prefix: str = fixed.NODE_PREFIX, nodes: list[str] = ()) -> bool:
    w = word.lower().strip().strip("*")
    return bool(w) and (w in nodes or bool(prefix) and w.startswith(prefix))


def is_node(form: Column, nodes: list[str], prefix: str = "") -> Column:
    """Whether a form is a node word: one of a list, or with the nodes' beginning."""
    w = F.lower(F.regexp_replace(F.trim(form), r"^\*+|\*+$", ""))
    return F.when(w == "", False).otherwise(w.isin(list(nodes)) | (w.startswith(prefix) if prefix else F.lit(False)))


def first_label(form: Column, field: dict[str, list[str]]) -> Column:
    """The first label, in field order, one of whose patterns matches the form."""
    out = None
    for label, patterns in field.items():
        hit = form.rlike("|".join(extract_pattern(p) for p in patterns))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(F.lit(None).cast("string")) if out is not None else F.lit(None).cast("string")


def pole(label: Column, stable: list[str], variable: list[str], negated: Column | None = None, names: tuple[str, str] = ("E", "V")) -> Column:
    """The pole of a label; where negated (directly) holds, the other one."""
    low, high = names
    base = F.when(label.isin(list(stable)), low).when(label.isin(list(variable)), high)
    if negated is None:
        return base
    return F.when(F.coalesce(negated, F.lit(False)), F.when(base == low, high).when(base == high, low)).otherwise(base)


def axis(label: Column, synchronic: list[str], diachronic: list[str], names: tuple[str, str, str] = ("sincronico", "diacronico", "ambos")) -> Column:
    one, two, both = names
    return F.when(label.isin(list(synchronic)) & label.isin(list(diachronic)), both).when(label.isin(list(synchronic)), one).when(label.isin(list(diachronic)), two).otherwise(both)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def doc_key(path: Column) -> Column:
    """16 hex digits of the SHA-256 of the lower-cased file name, or of the whole path if it has no dot."""
    base = basename(F.lower(path))
    return F.substring(F.sha2(F.when(base.contains("."), base).otherwise(F.lower(path)).cast("binary"), 256), 1, 16)


def hyperlink(url: Column, path: Column) -> Column:
    return F.coalesce(F.when(F.trim(url) != "", F.trim(url)), F.concat(F.lit("file:///"), F.regexp_replace(path, r"\\", "/")))


def first_contained(text: Column, cues: dict[str, list[str]]) -> Column:
    """The first domain, in order, one of whose cues the normalised and lowered text contains."""
    out, low = None, F.lower(normalise(text))
    for value, words in cues.items():
        for cue in words:
            out = F.when(low.contains(cue), value) if out is None else out.when(low.contains(cue), value)
    return out.otherwise("") if out is not None else F.lit("")


FILE = r"(?i)\.(pdf|txt|docx?|html?|xhtml|rtf|odt|epub|xml|tei)(?:\b|$)"


def looks_like_file(value: Column) -> Column:
    v = F.trim(F.coalesce(value, F.lit("")))
    return ~F.lower(v).isin("", "nan", "none") & (v.rlike(FILE) | F.lower(v).startswith("file:"))


def folding() -> tuple[str, str, dict[str, str]]:
    """By the rule of compatibility decomposition: characters that fold to one of ASCII, those, and what others fold to."""
    one, to, more = [], [], {}
    for code in (*range(0x80, 0x2200), *range(0xFB00, 0xFB07)):
        c = chr(code)
        flat = unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()
        if len(flat) == 1:
            one.append(c)
            to.append(flat)
        elif len(flat) > 1:
            more[c] = flat
    return "".join(one), "".join(to), more


#: Quotation marks that count as their plain forms.
QUOTES = ("’‘“”", "''\"\"")
FOLDED = folding()
PLAIN = (FOLDED[0] + QUOTES[0], FOLDED[1] + QUOTES[1])
#: Characters that fold to several; the others of this kind are too rare to be looked for one by one, and go by their class.
SEVERAL = {c: FOLDED[2][c] for c in "ﬀﬁﬂﬃﬄ…½¼¾№™" if c in FOLDED[2]}


def plain(text: Column) -> Column:
    """Lower-case ASCII: ligatures and diacritics folded, what then is not ASCII dropped, all but letters and digits as single blanks."""
    for c, flat in SEVERAL.items():
        text = F.replace(text, F.lit(c), F.lit(flat))
    folded = F.regexp_replace(F.translate(text, *PLAIN), r"[^\x00-\x7F]+", "")
    return F.trim(F.regexp_replace(F.lower(folded), "[^a-z0-9]+", " "))


def fused(text: Column) -> Column:
    """plain without blanks, so that joined and hyphenated spellings are one."""
    return F.replace(plain(text), F.lit(" "), F.lit(""))


def truthy(text: Column) -> Column:
    return F.lower(F.trim(text.cast("string"))).isin("1", "true", "verdadeiro", "yes", "sim", "t", "y")


def empty_to_null(text: Column) -> Column:
    return F.when(~F.lower(F.trim(text)).isin("", "nan", "none", "nat"), text)


def doi(text: Column) -> Column:
    return F.lower(F.regexp_extract(text, r"(10\.[0-9]{4,9}/[^\s\"<>]+)", 1))


def year(text: Column) -> Column:
    return F.regexp_extract(text, r"\b((?:1[5-9]|20)[0-9]{2})\b", 1)


def html_title(html: Column) -> Column:
    raw = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    return unescape(F.trim(F.regexp_replace(raw, r"\s+", " ")))


def html_meta(html: Column, name: str) -> Column:
    return unescape(F.regexp_extract(html, rf'(?is)<meta\s+(?:name|property)="{re.escape(name)}"\s+content="([^"]*)"', 1))


def unescape(text: Column) -> Column:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def sentence_case(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 1 << 20)))


def bad_tags(tags: Column, exact: list[str] = fixed.TAGS, prefixes: list[str] = fixed.TAG_PREFIXES) -> Column:
    """The segments of a list of review tags that are none."""
    known = lambda t: F.exists(F.array(*map(F.lit, exact)), lambda e: e == t) | F.exists(F.array(*map(F.lit, prefixes)), lambda p: t.startswith(p) & (F.length(t) > F.length(p)))
    return F.filter(F.split(F.trim(F.coalesce(tags, F.lit(""))), r"\s*;\s*"), lambda t: (t != "") & ~known(t))


def join_tags(*tags: Column) -> Column:
    """Tags joined by a semicolon, empty ones left out."""
    return F.concat_ws("; ", *[F.when(F.trim(t) != "", F.trim(t)) for t in tags])

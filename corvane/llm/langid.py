"""Language identification of mixed texts.

The script of a word's letters narrows its candidate languages to those that use
the script in training.  Each candidate scores the word by its character trigrams.
Viterbi over the words of a text, with a penalty for each switch, labels spans; the
text's language is the one that holds most letters.

Training counts trigrams in a bounded sample of labelled rows: rows are chosen by
a hash of doc_id, at most about TRAIN_A_LANGUAGE for each language.  The trigram
table has BUCKETS columns for each language, whatever the corpus holds.

Null texts and texts without letters are ``und`` with the score 0, as is every text
if nothing was learned.  Repeated rows are labelled alike.  A null doc_id counts
as the empty text when rows are dealt to training.  Ties go to the language whose
name sorts first, and to staying in a language.  A very long text is labelled whole,
in a slice of its own.  Further columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import _common as C

TRAIN_A_LANGUAGE = 4000
BUCKETS = 1 << 16
SWITCH = 8.0
ALPHA = 0.5
LEAST_SHARE = 0.002  # of a language's letters in a script it uses
CELLS = 1 << 22  # of one Viterbi batch

#: First and last code points of scripts; other letters are of script 0.
SCRIPTS = (
    (0x0041, 0x024F), (0x1E00, 0x1EFF),  # Latin
    (0x0370, 0x03FF), (0x1F00, 0x1FFF),  # Greek
    (0x0400, 0x052F),  # Cyrillic
    (0x0530, 0x058F),  # Armenian
    (0x0590, 0x05FF),  # Hebrew
    (0x0600, 0x077F), (0x08A0, 0x08FF),  # Arabic
    (0x0900, 0x097F),  # Devanagari
    (0x0980, 0x09FF),  # Bengali
    (0x0B80, 0x0BFF),  # Tamil
    (0x0E00, 0x0E7F),  # Thai
    (0x10A0, 0x10FF),  # Georgian
    (0x1100, 0x11FF), (0xAC00, 0xD7AF),  # Hangul
    (0x3040, 0x30FF),  # Kana
    (0x3400, 0x9FFF), (0x20000, 0x2FA1F),  # Han
)
SCRIPT_IDS = np.array([1, 1, 2, 2, 3, 4, 5, 6, 6, 7, 8, 9, 10, 11, 12, 12, 13, 14, 14])
N_SCRIPTS = 15


def scripts_of(points: np.ndarray) -> np.ndarray:
    """The script of each code point, -1 for what is no letter."""
    out = np.full(len(points), -1, np.int8)
    for i, p in enumerate(points.tolist()):
        if chr(p).isalpha():
            out[i] = next((SCRIPT_IDS[k] for k, (a, b) in enumerate(SCRIPTS) if a <= p <= b), 0)
    return out


class Words:
    """Trigram buckets and scripts of distinct words."""

    def __init__(self, words: list[bytes]):
        text = "\n" + "\n".join(w.decode() for w in words) + "\n" if words else "\n\n"
        points = np.frombuffer(text.lower().encode("utf-32-le"), "<u4").astype(np.int64)
        known, inverse = np.unique(points, return_inverse=True)
        script = scripts_of(known)[inverse]
        word = np.cumsum(points == 10) - 1
        letter = script >= 0
        shown = np.where(letter, points, 0)
        mid = np.flatnonzero(letter)
        tri = (shown[mid - 1].astype(np.uint64) << np.uint64(42)) | (shown[mid].astype(np.uint64) << np.uint64(21)) | shown[mid + 1].astype(np.uint64)
        self.n = len(words)
        self.word = word[mid]
        self.gram = (C.mix(C.mix(tri)) % np.uint64(BUCKETS)).astype(np.int64)
        self.script_of_letter = script[mid].astype(np.int64)
        self.letters = np.bincount(self.word, minlength=self.n)
        by = np.bincount(self.word * N_SCRIPTS + self.script_of_letter, minlength=self.n * N_SCRIPTS).reshape(self.n, N_SCRIPTS)
        self.script = by.argmax(1)


class Model:
    def __init__(self, langs: list[str], grams: np.ndarray, scripts: np.ndarray):
        self.langs = langs
        total = grams.sum(1, keepdims=True)
        self.logp = np.log((grams + ALPHA) / (total + ALPHA * BUCKETS)).astype(np.float32)
        share = scripts / np.maximum(1, scripts.sum(1, keepdims=True))
        self.uses = share.T >= LEAST_SHARE  # script x language

    def scores(self, words: Words) -> np.ndarray:
        """Log-probabilities of words x languages; what the script rules out is far below."""
        out = np.stack([np.bincount(words.word, lp[words.gram], words.n) for lp in self.logp], 1)
        allowed = self.uses[words.script]
        allowed |= ~allowed.any(1, keepdims=True)
        return np.where(allowed, out, out.min(1, keepdims=True) - 1000).astype(np.float32)


def viterbi(scores: np.ndarray, ends: np.ndarray, switch: float) -> np.ndarray:
    """The best label of each row; texts are the rows between ends, labelled side by side."""
    labels = np.zeros(len(scores), np.int64)
    size = np.diff(ends)
    order = np.argsort(-size, kind="stable")
    order = order[size[order] > 0]
    n_labels = scores.shape[1]
    at = 0
    while at < len(order):
        steps = int(size[order[at]])
        part = order[at : at + max(1, CELLS // (steps * n_labels))]
        at += len(part)
        length = size[part]
        grid = ends[:-1][part][None, :] + np.minimum(np.arange(steps)[:, None], length[None, :] - 1)
        value = scores[grid[0]].copy()
        stay = np.ones((steps, len(part), n_labels), bool)
        source = np.zeros((steps, len(part)), np.int64)
        for t in range(1, steps):
            live = int(np.searchsorted(-length, -t, side="left"))  # lengths fall
            old = value[:live]
            source[t, :live] = old.argmax(1)
            reach = old.max(1, keepdims=True) - np.float32(switch)
            stay[t, :live] = old >= reach
            value[:live] = np.maximum(old, reach) + scores[grid[t, :live]]
        label, rows = value.argmax(1), np.arange(len(part))
        for t in range(steps - 1, -1, -1):
            here = t < length
            labels[grid[t][here]] = label[here]
            label = np.where(stay[t, rows, label], label, source[t])
    return labels


def train(docs: DataFrame) -> Model:
    """Learn from docs (doc_id, text, lang), all of which may be used."""
    rows = docs.where("lang is not null")
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return Model([], np.zeros((0, BUCKETS)), np.zeros((0, N_SCRIPTS)))
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, TRAIN_A_LANGUAGE / counts[k]))])
    chosen = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.element_at(share, F.col("lang")) * (1 << 20))
    code = {k: i for i, k in enumerate(langs)}

    def step(batch):
        words, index, ends = C.index_words(batch.column("text"))
        own = Words(words)
        lang = np.array([code[x] for x in batch.column("lang").to_pylist()])
        lang_of = np.repeat(lang, np.diff(ends))
        out = []
        for k in np.unique(lang):
            times = np.bincount(index[lang_of == k], minlength=len(words))[own.word].astype(float)
            grams = np.bincount(own.gram, times, BUCKETS)
            scripts = np.bincount(own.script_of_letter, times, N_SCRIPTS)
            n = np.concatenate([grams, scripts]).astype(np.int64)
            at = np.flatnonzero(n)
            out.append((np.full(len(at), k), at, n[at]))
        columns = map(np.concatenate, zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["lang", "cell", "n"])

    got = C.map_arrow(chosen.select("text", "lang"), step, "lang long, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros((len(langs), BUCKETS + N_SCRIPTS))
    table[np.asarray(got.column("lang")), np.asarray(got.column("cell"))] = np.asarray(got.column("n"))
    return Model(langs, table[:, :BUCKETS], table[:, BUCKETS:])


def label_texts(model: Model, text: pa.Array, switch: float = SWITCH) -> tuple[list[str], np.ndarray, pa.ListArray]:
    """Language, score and spans (first word, words, language) of each text."""
    n = len(text)
    words, index, ends = C.index_words(text)
    own = Words(words)
    letters = own.letters[index] if len(index) else np.zeros(0, np.int64)
    spoken = letters > 0
    new_ends = np.concatenate([[0], np.cumsum(spoken)])[ends]
    at = np.flatnonzero(spoken)
    n_langs = len(model.langs)
    if not len(at) or not n_langs:
        empty = pa.array([[]] * n, pa.list_(pa.struct([("word", pa.int64()), ("words", pa.int64()), ("lang", pa.string())])))
        return ["und"] * n, np.zeros(n), empty
    labels = viterbi(model.scores(own)[index[at]], new_ends, switch)
    doc = np.repeat(np.arange(n), np.diff(new_ends))
    held = np.bincount(doc * n_langs + labels, letters[at], n * n_langs).reshape(n, n_langs)
    total = held.sum(1)
    best = held.argmax(1)
    score = np.where(total > 0, held[np.arange(n), best] / np.maximum(total, 1), 0.0)
    names = [model.langs[b] if t else "und" for b, t in zip(best.tolist(), total.tolist())]
    first = np.concatenate([[True], (labels[1:] != labels[:-1]) | (doc[1:] != doc[:-1])])
    begin = at[first]
    span_doc = doc[first]
    stop = np.append(begin[1:], len(index))
    stop = np.minimum(stop, ends[1:][span_doc])
    begin_in = np.where(np.concatenate([[True], span_doc[1:] != span_doc[:-1]]), ends[:-1][span_doc], begin)
    offsets = np.searchsorted(span_doc, np.arange(n + 1))
    spans = pa.StructArray.from_arrays([pa.array(begin_in - ends[:-1][span_doc]), pa.array(stop - begin_in), pa.array(model.langs, pa.string()).take(pa.array(labels[first]))], ["word", "words", "lang"])
    return names, score, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans)


def predict(docs: DataFrame, model: Model, switch: float = SWITCH) -> DataFrame:
    """(doc_id, lang_pred, score, spans); only texts are looked at."""

    def step(batch):
        names, score, spans = label_texts(model, batch.column("text"), switch)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(score, pa.float64()), spans], ["doc_id", "lang_pred", "score", "spans"])

    return C.map_arrow(C.ids_and_texts(docs), step, "doc_id long, lang_pred string, score double, spans array<struct<word: long, words: long, lang: string>>")


def held_out(mod: int, rest: int) -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % mod == rest


def query_of(docs: DataFrame) -> DataFrame:
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = train(known.where(~held_out(4, 2)))
    return predict(docs, model).select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return query_of(C.table(spark, sf_dir, "documents"))

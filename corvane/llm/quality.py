"""Quality classifier by co-training.

Two classifiers see different views of a document: its text (hashed words and the
shape of the text) and its page metadata (source, language, length).  In each
round, each labels a pool of unlabelled rows, and the labels it is most sure of
go to the other's training set.  Then each view is calibrated on labelled rows that
it was not trained on, and the calibrated log-odds are added, less the prior
counted twice: a view that tells nothing adds nothing.

A document is good if its quality is 1 and it is not toxic.  Models are fitted on
the driver on samples by a hash, at most about LABELLED and POOL rows; all
documents are scored.  Rows of one doc_id in labels: the least quality and the
highest toxicity count.  Of documents that share a doc_id the sample has one, and
of equal rows the pool has one, so no id or text can flood the driver.

Null texts are empty, null metadata a value of its own.  Without labelled rows of
both kinds every document is accepted with the score 1.  Repeated rows get equal
scores, each for itself; nothing is ranked, so ties need no rule.  A very long text
is scored whole, in a slice of its own.  Further columns stay as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import _common as C

LABELLED = 8000
POOL = 4000
ROUNDS = 3
SHARE = 0.05  # of the pool that each class gains from a view in a round
WORD_BUCKETS = 1 << 18
META_BUCKETS = 1 << 12
LEAST_DOCS = 4  # in which a word stands, to have a weight
LEAST_Z = 4.0  # standard errors between its documents' share of good ones and that of all
PREFIX = 5  # bytes
STEPS = 100
L2 = 0.3
STRIP = b".,;:!?\"'()[]|*-"
SLICE = 2 << 20  # bytes of text that are scored at a time
VIEWED = ("text", "source", "lang", "n_chars")
SCORES = ("p_text", "p_meta", "score")


class Sparse:
    """Rows of column numbers, all of value 1, and dense columns beside them."""

    def __init__(self, column: np.ndarray, ends: np.ndarray, dense: np.ndarray):
        self.column, self.ends, self.dense = column, ends, dense

    def __len__(self) -> int:
        return len(self.ends) - 1

    def rows(self, keep: np.ndarray) -> Sparse:
        size = np.diff(self.ends)
        column, _ = C.gather(self.column, self.ends, keep)
        return Sparse(column, np.concatenate([[0], np.cumsum(size[keep])]), self.dense[keep])


def stacked(parts: list[Sparse]) -> Sparse:
    before = np.concatenate([[0], np.cumsum([len(p.column) for p in parts])])
    ends = np.concatenate([[0], *(p.ends[1:] + b for p, b in zip(parts, before))]).astype(np.int64)
    return Sparse(np.concatenate([p.column for p in parts]), ends, np.concatenate([p.dense for p in parts]))


def text_view(text: pa.Array) -> Sparse:
    """Distinct words and word beginnings of each text, in buckets, and numbers on its shape."""
    words, index, ends = C.index_words(text, lower=True)
    n = len(text)
    bare = [w.strip(STRIP) for w in words]
    bucket, prefix = ((C.hash_words(x, seed) % np.uint64(WORD_BUCKETS)).astype(np.int32) for x, seed in ((bare, 11), ([w[:PREFIX] for w in bare], 13)))
    column, own = [np.zeros(0, np.int32)], np.zeros(n + 1, np.int64)
    dense = np.zeros((n, 8))
    for i in range(n):
        at = index[ends[i] : ends[i + 1]]
        found = np.unique(np.concatenate([bucket[at], prefix[at]]))
        column.append(found)
        own[i + 1] = own[i] + len(found)
        raw = text[i].as_buffer() if text[i].is_valid else b""
        by = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        size = max(1, len(raw))
        letters = max(1, by[65:91].sum() + by[97:123].sum() + by[128:].sum())
        dense[i] = by[65:91].sum() / letters, by[48:58].sum() / size, by[33] / size, by[124] / size, by[10] / size, (by[33:48].sum() + by[58:65].sum()) / size, np.log1p(len(raw)), len(found) / max(1, len(at))
    return Sparse(np.concatenate(column), own, dense)


def meta_view(source: pa.Array, lang: pa.Array, n_chars: pa.Array) -> Sparse:
    """The values of source, lang and both, in buckets, and the length."""
    rows = list(zip(source.to_pylist(), lang.to_pylist()))
    keys = [f"{kind}={value}".encode() for s, l in rows for kind, value in (("s", s), ("l", l), ("sl", (s, l)))]
    bucket = (C.hash_words(keys, 12) % np.uint64(META_BUCKETS)).astype(np.int64)
    size = np.log1p(np.maximum(0, np.asarray(pc.fill_null(n_chars, 0), np.float64)))
    return Sparse(bucket, np.arange(len(rows) + 1) * 3, np.stack([size, size**2 / 10], 1))


class Logistic:
    """Logistic regression on a Sparse view, by adaptive gradient steps with an L2 penalty."""

    def __init__(self, columns: int, l2: float):
        self.columns, self.l2, self.w = columns, l2, None

    def fit(self, x: Sparse, y: np.ndarray, weight: np.ndarray) -> Logistic:
        self.mean, self.sd = x.dense.mean(0), x.dense.std(0) + 1e-6
        row = np.repeat(np.arange(len(x)), np.diff(x.ends))
        n, good, share = np.bincount(x.column, minlength=self.columns), np.bincount(x.column, y[row], self.columns), y.mean()
        tells = np.abs(good - n * share) >= LEAST_Z * np.sqrt(n * share * (1 - share))
        use = ((n >= LEAST_DOCS) & tells)[x.column]
        row, column = row[use], x.column[use]
        dense = np.clip((x.dense - self.mean) / self.sd, -5, 5)
        w, v, b = np.zeros(self.columns), np.zeros(dense.shape[1]), 0.0
        gw, gv, gb = np.full(self.columns, 1e-8), np.full(dense.shape[1], 1e-8), 1e-8
        for _ in range(STEPS):
            z = np.bincount(row, w[column], len(x)) + dense @ v + b
            error = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
            d = np.bincount(column, error[row], self.columns) + self.l2 * w
            dv, db = dense.T @ error + self.l2 * v, error.sum()
            gw, gv, gb = gw + d * d, gv + dv * dv, gb + db * db
            w, v, b = w - 0.5 * d / np.sqrt(gw), v - 0.5 * dv / np.sqrt(gv), b - 0.5 * db / np.sqrt(gb)
        self.w, self.v, self.b = w.astype(np.float32), v, b
        return self

    def logits(self, x: Sparse) -> np.ndarray:
        row = np.repeat(np.arange(len(x)), np.diff(x.ends))
        return np.bincount(row, self.w[x.column], len(x)) + np.clip((x.dense - self.mean) / self.sd, -5, 5) @ self.v + self.b


def calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift of log-odds (Platt), by Newton steps with a small penalty."""
    a, b = 1.0, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        r, s = p - y, p * (1 - p) + 1e-9
        g = np.array([r @ z + 0.1 * a, r.sum() + 0.1 * b])
        h = np.array([[s @ (z * z) + 0.1, s @ z], [s @ z, s.sum() + 0.1]])
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = a - step[0], b - step[1]
    return max(0.0, float(a)), float(b)


class CoTrained:
    def __init__(self, views: list[Sparse], y: np.ndarray, pool: list[Sparse], rounds: int = ROUNDS):
        """views and pool: the text view and the metadata view of labelled and unlabelled rows."""
        part = np.arange(len(y)) % 4
        fit, hold = np.flatnonzero(part != 3), np.flatnonzero(part == 3)
        sizes, n_pool = (WORD_BUCKETS, META_BUCKETS), len(pool[0])
        given: list[dict[int, int]] = [{}, {}]
        many = int(np.ceil(SHARE * n_pool))
        for r in range(rounds + 1):
            self.models = []
            for k in range(2):
                got = np.array(sorted(given[k]), np.int64)
                mine, extra = views[k].rows(fit), pool[k].rows(got)
                both = stacked([mine, extra])
                target = np.concatenate([y[fit], [given[k][i] for i in got.tolist()]])
                self.models.append(Logistic(sizes[k], L2).fit(both, target, np.concatenate([np.ones(len(fit)), np.full(len(got), 0.5)])))
            self.scale = [calibrate(m.logits(views[k].rows(hold)), y[hold]) for k, m in enumerate(self.models)]
            if r == rounds or not n_pool:
                break
            for k in range(2):
                z = self.view_logits(k, pool[k])
                order = np.argsort(z, kind="stable")
                for i in order[:many][z[order[:many]] < -2.0].tolist():
                    given[1 - k].setdefault(i, 0)
                for i in order[::-1][:many][z[order[::-1][:many]] > 2.0].tolist():
                    given[1 - k].setdefault(i, 1)
        share = min(max(float(y.mean()), 1e-6), 1 - 1e-6)
        self.prior = float(np.log(share / (1 - share)))

    def view_logits(self, k: int, x: Sparse) -> np.ndarray:
        return self.scale[k][0] * self.models[k].logits(x) + self.scale[k][1]

    def combine(self, views: list[Sparse]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities by the text, by the metadata and by both."""
        z = [np.clip(self.view_logits(k, views[k]), -30, 30) for k in range(2)]
        return tuple(1 / (1 + np.exp(-np.clip(x, -40, 40))) for x in (z[0], z[1], z[0] + z[1] - self.prior))


def columns_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("long").alias("n_chars"))


def views_of(batch: pa.RecordBatch) -> list[Sparse]:
    return [text_view(batch.column("text")), meta_view(*(batch.column(c) for c in ("source", "lang", "n_chars")))]


def views_of_all(t: pa.Table) -> list[Sparse]:
    """The views of a sample, a few hundred rows at a time: the driver never holds all words of it."""
    parts = [views_of(b) for b in t.combine_chunks().to_batches(max_chunksize=400)] or [views_of(pa.RecordBatch.from_pylist([], t.schema))]
    return [stacked(list(x)) for x in zip(*parts)]


def train(docs: DataFrame, labels: DataFrame) -> CoTrained | None:
    known = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("known_id")).agg(((F.min("quality") == 1) & (F.max("toxic") == 0)).cast("int").alias("y"))
    n_known, n_docs = known.count(), docs.count()
    of = [F.col(c) for c in VIEWED]
    one = F.min_by(F.struct(*of), F.xxhash64(*of)).alias("row")
    chosen = known.where(F.pmod(F.xxhash64("known_id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, LABELLED / max(1, n_known))))
    labelled = docs.join(chosen, F.col("doc_id") == F.col("known_id")).groupBy("doc_id").agg(one, F.first("y").alias("y"))
    rows = labelled.select("doc_id", "row.*", "y").toArrow().sort_by("doc_id")
    if not rows.num_rows or len(set(rows.column("y").to_pylist())) < 2:
        return None
    drawn = docs.withColumn("place", F.xxhash64("doc_id", "text", F.lit("pool"))).where(F.pmod("place", F.lit(1 << 20)) < int((1 << 20) * min(1.0, POOL / max(1, n_docs))))
    other = drawn.join(known, F.col("doc_id") == F.col("known_id"), "left_anti").groupBy("place").agg(one)
    pool = other.select("place", "row.*").toArrow().sort_by("place")
    y, known_views = np.asarray(rows.column("y"), np.float64), views_of_all(rows)
    del rows
    return CoTrained(known_views, y, views_of_all(pool))


def score(docs: DataFrame, model: CoTrained | None, names: tuple[str, str, str] = SCORES) -> DataFrame:
    """docs with the probabilities that a document is good, by its text, its metadata and both, under names.

    Columns of docs that have one of the names are replaced.
    """
    docs = docs.drop(*names)
    if model is None:
        return docs.withColumns({c: F.lit(1.0) for c in names})
    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def step(batch):
        scores = model.combine(views_of(batch))
        return pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(s, pa.float64()) for s in scores)], [*batch.schema.names, *names])

    return C.map_arrow(docs, step, fields + "".join(f", `{c}` double" for c in names), most=SLICE)


def query(spark, sf_dir: str) -> DataFrame:
    docs = columns_of(C.table(spark, sf_dir, "documents"))
    scored = score(docs, train(docs, C.table(spark, sf_dir, "labels")))
    return scored.select("doc_id", "p_text", "p_meta", "score", (F.col("score") >= 0.5).alias("accepted"))

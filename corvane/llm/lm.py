"""Scoring texts by a causal self-attention model, beside a smoothed unigram base.

Documents are packed in blocks of bounded text size: the block's distinct words
with their training counts, and the word numbers of its documents.  Each word of
the corpus is encoded once, where a sort brings its rows together, and its count
and ids go back to the blocks that hold it.  Only (block, word) rows are shuffled:
a word has one row a block, so a frequent word is no hot key.

Then each text's subword ids are written out once, and further passes over them
gather what the model learns, all from every training document: which frequent ids
stand beside an id (k-means over them gives the classes) and how often an id follows
each class.  The network, one attention layer that predicts the class of the next
subword, is trained in numpy on all windows of all training documents: up to STEPS
batches on the driver, repeated until there are STEPS, and more of them where they
lie, each once.  There each task trains on its own windows, in rounds that start from
one network, and networks are averaged between rounds; so the figures follow how the
rows are dealt to tasks.  Within a
class a subword has its share of the class's count, over all and after each class.
A text is scored in windows of WINDOW positions that overlap by OVERLAP; a window
scores the positions that follow its overlap, so each subword, and the end, is
scored once.

A null text is empty, and has the end only.  Repeated rows are scored, and
counted, each for itself.  If nothing is learned from, all counts are 0 and the
model is uniform over subwords.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import _common as C
from corvane.llm import bpe
from corvane.llm.langid import held_out

BLOCK_BYTES = 12 << 20
WINDOW = 32
OVERLAP = 4
WIDTH = 16
CLASSES = 96
BACK_OFF = 20.0  # pairs that an id's share over all classes counts for
TOP_IDS = 2048  # ids with an input vector of their own
CHUNK = 128  # windows scored at a time, so that arrays stay in the cache
STEPS = 1000  # at least
BATCH = 128
SHARE = 1  # of all training windows that the network is fitted on
ROUNDS = (1 / 64, 1 / 64, 1 / 32, 1 / 16, 1 / 8, 1 / 4, 1 / 2)  # shares of each task's windows, between which networks are averaged
BUFFER = 1 << 16  # windows that a task trains on at a time
FREQUENT = 128  # ids whose places beside an id tell its class


def frequent_column(count: np.ndarray) -> np.ndarray:
    """Of each id, its column among the FREQUENT ones; FREQUENT for all others."""
    frequent = np.argsort(-count, kind="stable")[:FREQUENT]
    column = np.full(len(count), FREQUENT)
    column[frequent] = np.arange(len(frequent))
    return column


def classes_of(count: np.ndarray, beside: np.ndarray, k: int) -> np.ndarray:
    """Class of each id: k-means over which frequent ids stand beside it; ids too rare for that share the last two."""
    known = np.flatnonzero(count >= 5)
    out = np.full(len(count), k - 1)
    out[: len(count) // 2] = k - 2
    if len(known) < 2 * k:
        return out
    x = np.ascontiguousarray(beside[:, known].T)
    np.sqrt(x, out=x)
    x /= np.maximum(1e-6, np.linalg.norm(x, axis=1, keepdims=True))
    centre = x[np.argsort(-count[known], kind="stable")[: k - 2]].copy()
    for _ in range(8):
        best = (x @ centre.T).argmax(1)
        for c in range(k - 2):
            own = x[best == c]
            if len(own):
                centre[c] = own.mean(0) / max(1e-6, np.linalg.norm(own.mean(0)))
    out[known] = best
    return out


class Attention:
    """One causal attention layer over class predictions; all arrays are float32."""

    def __init__(self, n_inputs: int, classes: int, rng):
        d = WIDTH
        shapes = {"E": (n_inputs, d), "P": (WINDOW, d), "Q": (d, d), "K": (d, d), "V": (d, d), "O": (d, d), "U": (d, classes), "b": (classes,)}
        self.p = {k: (rng.normal(0, 0.02 if k == "b" else 0.3 / np.sqrt(d) * 2, s)).astype(np.float32) for k, s in shapes.items()}
        self.ones = np.ones(max(WINDOW, classes), np.float32)
        self.mask = np.triu(np.full((WINDOW, WINDOW), -30, np.float32), 1)

    def forward(self, x: np.ndarray):
        p, t = self.p, x.shape[1]
        e = p["E"][x] + p["P"][:t]
        times = lambda x, w: (x.reshape(-1, x.shape[-1]) @ w).reshape(*x.shape[:-1], -1)  # noqa: E731  one product, not one a window
        q, k, v = times(e, p["Q"]), times(e, p["K"]), times(e, p["V"])
        a = q @ k.transpose(0, 2, 1)
        a *= np.float32(1 / np.sqrt(WIDTH))
        np.clip(a, -20, 20, out=a)
        a += self.mask[:t, :t]
        np.exp(a, out=a)
        a *= self.mask[:t, :t] == 0
        a /= a @ self.ones[: a.shape[2], None]
        c = a @ v
        h = e + times(c, p["O"])
        z = times(h, p["U"])
        z += p["b"]
        np.clip(z, -40, 40, out=z)
        return e, q, k, v, a, c, h, z

    def log_probs(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural log-probability of each class y after the inputs x up to it."""
        z = self.forward(x)[-1]
        own = np.take_along_axis(z, y[:, :, None], 2)[:, :, 0]
        np.exp(z, out=z)
        return own - np.log(z @ self.ones[: z.shape[2]])

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray):
        p, t, s = self.p, x.shape[1], np.float32(1 / np.sqrt(WIDTH))
        e, q, k, v, a, c, h, z = self.forward(x)
        flat = lambda m: m.reshape(-1, m.shape[-1])
        d = flat(np.exp(z, out=z))
        weight = weight.ravel() / max(1.0, weight.sum())
        d *= (weight / (d @ self.ones[: d.shape[1]]))[:, None]
        d[np.arange(len(d)), y.ravel()] -= weight
        g = {"U": flat(h).T @ d, "b": d.sum(0)}
        dh = (d @ p["U"].T).reshape(h.shape)
        g["O"] = flat(c).T @ flat(dh)
        dc = (flat(dh) @ p["O"].T).reshape(h.shape)
        da, dv = dc @ v.transpose(0, 2, 1), a.transpose(0, 2, 1) @ dc
        da -= (dc * c).sum(2, keepdims=True)  # the sum of a * da over what is attended to
        da *= a
        da *= s
        dq, dk = da @ k, da.transpose(0, 2, 1) @ q
        for name, m in (("Q", dq), ("K", dk), ("V", dv)):
            g[name] = flat(e).T @ flat(m)
        de = dh + (flat(dq) @ p["Q"].T + flat(dk) @ p["K"].T + flat(dv) @ p["V"].T).reshape(h.shape)
        g["P"] = np.zeros_like(p["P"])
        g["P"][:t] = de.sum(0)
        g["E"] = np.stack([np.bincount(x.ravel(), flat(de)[:, j], len(p["E"])) for j in range(WIDTH)], 1).astype(np.float32)
        return g


class Adam:
    """A network and the state of its training; one vector where they travel."""

    def __init__(self, net: Attention):
        self.net, self.t = net, 0.0
        self.m = {k: np.zeros_like(v) for k, v in net.p.items()}
        self.r = {k: np.zeros_like(v) for k, v in net.p.items()}

    def step(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, done: float) -> None:
        """done: the share of the whole training up to here; the rate falls over its second half."""
        self.t += 1
        rate = np.float32(0.02 * min(1.0, 2 * max(0.0, 1 - done)))
        first, second = np.float32(1 - 0.9**self.t), np.float32(1 - 0.98**self.t)
        for k, v in self.net.gradients(x, y, weight).items():
            m = self.m[k] = 0.9 * self.m[k] + 0.1 * v
            r = self.r[k] = 0.98 * self.r[k] + 0.02 * v * v
            self.net.p[k] -= rate * (m / first) / (np.sqrt(r / second) + np.float32(1e-8))

    def vector(self) -> np.ndarray:
        return np.concatenate([[self.t], *(v.ravel() for d in (self.net.p, self.m, self.r) for v in d.values())]).astype(np.float64)

    def load(self, vector: np.ndarray) -> None:
        self.t, at = float(vector[0]), 1
        for d in (self.net.p, self.m, self.r):
            for k, v in d.items():
                d[k] = vector[at : at + v.size].reshape(v.shape).astype(np.float32)
                at += v.size


def pairs_of(ids: np.ndarray, ends: np.ndarray, end_id: int):
    """Of every subword of the texts, and each text's end: what stands before it, and itself; some at a time."""
    stream = np.concatenate([np.array([end_id], ids.dtype), np.insert(ids, ends[1:], end_id)])
    for at in range(0, len(stream) - 1, 1 << 19):
        part = stream[at : at + (1 << 19) + 1]
        yield part[:-1], part[1:]


def beside_keys(ids: np.ndarray, ends: np.ndarray, end_id: int, column: np.ndarray):
    """Cells of the (2 * (FREQUENT + 1), ids) table: the columns before an id, then those after it."""
    for before, after in pairs_of(ids, ends, end_id):
        yield column[before] * len(column) + after
        yield (column[after] + FREQUENT + 1) * len(column) + before


def pair_keys(ids: np.ndarray, ends: np.ndarray, end_id: int, cls: np.ndarray):
    """Cells of the (CLASSES, ids) table: the class before an id."""
    for before, after in pairs_of(ids, ends, end_id):
        yield cls[before].astype(np.int64) * len(cls) + after


def windows_in(n: np.ndarray) -> np.ndarray:
    """How many windows texts of n positions have."""
    return 1 + np.maximum(0, -(-(n - WINDOW) // (WINDOW - OVERLAP)))


def of_round(n: int, begin: float, end: float) -> np.ndarray:
    """Which of n windows a round takes that goes from the share begin to the share end; rounds from 0 to 1 take each once."""
    return np.random.default_rng(n).permutation(n)[int(n * begin) : int(n * end)]


def slices_of(ids: np.ndarray, ends: np.ndarray, end_id: int, pick=None):
    """Of each window, or those that pick takes of their number: WINDOW + 1 ids, its text, its first position, and the positions from there to the text's end."""
    n = (np.diff(ends) + 1).astype(np.int32)  # with the end
    many = windows_in(n)
    doc = np.repeat(np.arange(len(n), dtype=np.int32), many)
    begin = ((np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)) * (WINDOW - OVERLAP)).astype(np.int32)
    if pick is not None:
        own = pick(len(doc))
        doc, begin = doc[own], begin[own]
    # One stream with an end before each text's first id; every window is a slice of it.
    stream = np.insert(ids, ends[:-1], end_id)
    stream = np.append(stream, np.full(WINDOW + 1, end_id)).astype(np.int32)
    place = (ends[:-1][doc] + doc + begin).astype(np.int64)
    return np.lib.stride_tricks.sliding_window_view(stream, WINDOW + 1)[place], doc, begin, n[doc] - begin


class Texts:
    """What the model learns from texts at hand."""

    def __init__(self, texts: list[np.ndarray], end_id: int, rng):
        self.ids, self.end_id, self.rng = np.concatenate([*texts, np.zeros(0, np.int64)]).astype(np.int64), end_id, rng
        self.ends = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
        self.some, self.steps, self.spread = len(texts) > 0, STEPS, False

    def table(self, keys, marks: np.ndarray, rows: int) -> np.ndarray:
        cells = rows * len(marks)
        return sum((np.bincount(x, minlength=cells) for x in keys(self.ids, self.ends, self.end_id, marks)), np.zeros(cells)).reshape(rows, -1).astype(np.float32)

    def batches(self):
        slices, _, begin, left = slices_of(self.ids, self.ends, self.end_id)
        for _ in range(self.steps):
            pick = self.rng.integers(0, len(slices), BATCH)
            yield slices[pick], begin[pick], left[pick], np.ones(BATCH, np.float32)


class Model:
    """Classes, their predictor, and the shares of ids within classes."""

    def __init__(self, source, counts: np.ndarray, end_id: int, seed: int = 5):
        """source: Texts, or a Corpus, or a list of texts' ids."""
        rng = np.random.default_rng(seed)
        if isinstance(source, list):
            source = Texts(source, end_id, rng)
        self.end_id, n_ids, self.trained = end_id, len(counts), source.some
        self.cls = np.zeros(n_ids, np.int32)
        if not self.trained:
            return
        self.cls = classes_of(counts, source.table(beside_keys, frequent_column(counts), 2 * (FREQUENT + 1)), CLASSES).astype(np.int32)
        top = np.argsort(-counts, kind="stable")[:TOP_IDS]
        self.input = self.cls.copy()
        self.input[top] = CLASSES + np.arange(len(top))
        self.start = CLASSES + TOP_IDS
        self.net = Attention(CLASSES + TOP_IDS + 1, CLASSES, rng)
        self.fit(source)
        # The share of an id in its class: over all training documents, and after each class.
        smooth = counts + 0.1
        share = (smooth / np.bincount(self.cls, smooth, CLASSES)[self.cls]).astype(np.float32)
        pairs = source.table(pair_keys, self.cls, CLASSES)
        of_class = np.stack([np.bincount(self.cls, row, CLASSES) for row in pairs]).astype(np.float32)
        pairs += np.float32(BACK_OFF) * share
        pairs /= (of_class + np.float32(BACK_OFF))[:, self.cls]
        self.log_share = np.log(pairs, out=pairs)

    def fit(self, source) -> None:
        adam = Adam(self.net)
        if source.spread:
            source.fit(self, adam)
            return
        for t, (slices, begin, left, times) in enumerate(source.batches(), 1):
            x, y, real, _ = self.positions(slices, begin, left)
            adam.step(x, self.cls[y], real * times[:, None], t / (source.steps + 1))

    def positions(self, slices: np.ndarray, begin: np.ndarray, left: np.ndarray):
        """Of windows: inputs, targets, which positions are scored, and the class before each target."""
        column = np.arange(WINDOW, dtype=np.int32)
        real = (column < left[:, None]) & ((column >= OVERLAP) | (begin[:, None] == 0))
        prior, y = slices[:, :-1], np.where(column < left[:, None] - 1, slices[:, 1:], np.int32(self.end_id))
        x = self.input[prior]
        x[begin == 0, 0] = self.start
        return x, y, real, self.cls[prior]

    def windows(self, ids: np.ndarray, ends: np.ndarray):
        """Inputs, targets, which positions are scored, the text of each window, and the class before each target."""
        slices, doc, begin, left = slices_of(ids, ends, self.end_id)
        x, y, real, before = self.positions(slices, begin, left)
        return x, y, real, doc, before

    def score(self, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """log10 of the probability of each text and its end."""
        out = np.zeros(len(ends) - 1)
        if not self.trained:
            return (np.diff(ends) + 1) * -np.log10(len(self.cls))
        stride = WINDOW - OVERLAP
        at = 0
        while at < len(out):  # about 16,000 windows at a time, or one text
            stop = max(at + 1, int(np.searchsorted(ends, ends[at] + 16_000 * stride, side="right")) - 1)
            x, y, real, doc, b = self.windows(ids[ends[at] : ends[stop]], ends[at : stop + 1] - ends[at])
            for i in range(0, len(x), CHUNK):
                p, q = x[i : i + CHUNK], y[i : i + CHUNK]
                got = self.net.log_probs(p, self.cls[q]) + self.log_share[b[i : i + CHUNK], q]
                out[at:stop] += np.bincount(doc[i : i + CHUNK], np.where(real[i : i + CHUNK], got, 0).sum(1), stop - at)
            at = stop
        return out / np.log(10)


BLOCKS = "block long, words array<string>, times array<long>, doc_ids array<long>, held array<boolean>, ends array<long>, index binary"


def blocks_of(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, held) packed; times are the counts in texts that are not held out."""
    names = [x.split()[0] for x in BLOCKS.split(", ")]

    def pack(batches):
        number = 0
        for whole in C.text_slices(batches):
            sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(whole.column("text")), 0), np.int64)) // BLOCK_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), whole.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                part = whole.slice(a, b - a)
                words, index, ends = C.index_words(part.column("text"), lower=True)
                held = np.asarray(part.column("held"), bool)
                used = ~np.repeat(held, np.diff(ends))
                times = np.bincount(index[used], minlength=len(words))
                row = [TaskContext.get().partitionId() << 32 | number], [[w.decode() for w in words]], [times], [part.column("doc_id").to_pylist()], [held.tolist()], [ends], [zstandard.compress(index.astype("<i4").tobytes(), 1)]
                kinds = pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary()
                number += 1
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], names)

    return docs.mapInArrow(pack, BLOCKS)


def width(path: str) -> str:
    """The type that ids travel in: two bytes where the vocabulary fits."""
    return "<u2" if max(bpe.load(path).tokens) < 65536 else "<u4"


NUMBERED = "of long, data binary, id_counts binary, tokens long, types long"
ENTRIES = 1 << 17  # entries that are sorted by block at a time


def numbered(words: DataFrame, path: str) -> DataFrame:
    """Entries of words (word, block, place): of each block, every word's number, training count and subword ids.

    place holds a word's training count in its block, and its number in the lower 32 bits.

    Rows of one word come together by a sort, so it is counted and encoded once; a
    word has one row a block at most, however frequent it is.  Rows without a block
    hold the sums of a task.
    """
    kind = width(path)

    def packed(ids, lists, count, of, block, pos):
        """One row for each block: positions, counts, lengths and ids."""
        order = np.argsort(block, kind="stable")
        block, pos, of = block[order], pos[order], of[order]
        cut = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]]))
        rows = []
        for a, b in zip(cut, cut[1:]):
            own, size = C.gather(ids, lists, of[a:b])
            head = np.array([b - a], "<u4").tobytes()
            rows.append(zstandard.compress(head + pos[a:b].astype("<u4").tobytes() + count[of[a:b]].astype("<u8").tobytes() + size.astype("<u4").tobytes() + own.astype(kind).tobytes(), 1))
        return pa.RecordBatch.from_arrays([pa.array(block[cut[:-1]], pa.int64()), pa.array(rows, pa.binary()), pa.nulls(len(rows), pa.binary()), *(pa.array(np.zeros(len(rows), np.int64)) for _ in range(2))], [x.split()[0] for x in NUMBERED.split(", ")])

    def step(batches):
        model = bpe.load(path)
        id_counts = np.zeros(max(model.tokens) + 1, np.int64)
        tokens = types = 0
        held: list[pa.Table] = []
        rows = 0

        def finish(part: pa.Table):
            nonlocal tokens, types
            coded = part.column("word").combine_chunks().dictionary_encode()
            of = np.asarray(coded.indices, np.int64)
            place = np.asarray(part.column("place"))
            count = np.bincount(of, place >> 32, len(coded.dictionary)).astype(np.int64)
            ids, lists = bpe.flat_lists(model.new_ids(coded.dictionary.to_pylist()))
            id_counts[:] += np.bincount(ids, np.repeat(count, np.diff(lists)), len(id_counts)).astype(np.int64)
            tokens, types = tokens + int(count.sum()), types + int((count > 0).sum())
            return packed(ids, lists, count, of, np.asarray(part.column("block")), place & 0xFFFFFFFF)

        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            rows += batch.num_rows
            last = batch.column("word")[batch.num_rows - 1].as_py() if batch.num_rows else None
            if rows >= ENTRIES and batch.column("word")[0].as_py() != last:
                table = pa.concat_tables(held)
                whole = rows - int(pc.sum(pc.equal(batch.column("word"), last)).as_py())
                yield finish(table.slice(0, whole))
                held = [table.slice(whole)]
                rows -= whole
        if rows:
            yield finish(pa.concat_tables(held))
        sums = [None], [None], [zstandard.compress(id_counts.astype("<u8").tobytes())], [tokens], [types]
        kinds = pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(sums, kinds)], [x.split()[0] for x in NUMBERED.split(", ")])
        del model, held
        bpe.load.cache_clear()
        C.trim()

    return words.repartition("word").sortWithinPartitions("word").mapInArrow(step, NUMBERED)


def entries(data: list[bytes], kind: str):
    """Of the words of a block, by number: training counts, subword ids, and where each word's start."""
    pos, count, size, ids = [], [], [], []
    for raw in map(zstandard.decompress, data):
        n = int(np.frombuffer(raw, "<u4", 1)[0])
        pos.append(np.frombuffer(raw, "<u4", n, 4))
        count.append(np.frombuffer(raw, "<u8", n, 4 + 4 * n))
        size.append(np.frombuffer(raw, "<u4", n, 4 + 12 * n))
        ids.append(np.frombuffer(raw, kind, -1, 4 + 16 * n))
    if not pos:
        return np.zeros(0, np.int64), np.zeros(0, kind), np.zeros(1, np.int64)
    order = np.argsort(np.concatenate(pos), kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.concatenate(size), dtype=np.int64)])
    flat, sizes = C.gather(np.concatenate(ids), starts, order)
    return np.concatenate(count)[order].astype(np.int64), flat, np.concatenate([[0], np.cumsum(sizes)])


STREAMS = "doc_ids array<long>, held array<boolean>, seen array<long>, base array<double>, ends array<long>, ids binary, windows long"


def training_part(row):
    """ids and ends of a stream's training documents."""
    ids, ends, used = row
    keep = np.repeat(used, np.diff(ends))
    return ids[keep], np.concatenate([[0], np.cumsum(np.diff(ends)[used])]).astype(np.int64)


def rows_of(batch: pa.RecordBatch, kind: str):
    """Of each stream: its row number, its texts' ids, their ends, and which texts train."""
    for i in range(batch.num_rows):
        ids = np.frombuffer(zstandard.decompress(batch.column("ids")[i].as_py()), kind)
        yield i, ids, np.asarray(batch.column("ends")[i].values, np.int64), ~np.asarray(batch.column("held")[i].values, bool)


TABLE = "r int, part int, data binary"


def table_rows(rows, part: int):
    """Rows of a table with counts, each as one value."""
    for r, n in rows:
        at = np.flatnonzero(n)
        if len(at):
            data = zstandard.compress(np.diff(at, prepend=0).astype("<u4").tobytes() + n[at].astype("<u8").tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([part], pa.int32()), pa.array([data], pa.binary())], ["r", "part", "data"])


def table_row(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.decompress(data)
    k = len(raw) // 12
    return np.cumsum(np.frombuffer(raw, "<u4", k)), np.frombuffer(raw, "<u8", k, 4 * k).astype(np.int64)


STATES = "part int, used long, data binary"


class Corpus:
    """What the model learns from the streams of all training documents, summed by Spark."""

    def __init__(self, streams: DataFrame, end_id: int, kind: str):
        self.streams, self.end_id, self.kind = streams, end_id, kind
        (self.n,) = streams.select(F.coalesce(F.sum("windows"), F.lit(0))).first()
        self.share, self.used = SHARE, 0
        self.parts = max(1, round(self.n * self.share / BATCH))
        self.some, self.steps, self.spread = self.n > 0, max(STEPS, self.parts), self.parts > STEPS

    def table(self, keys, marks: np.ndarray, rows: int) -> np.ndarray:
        """Counts of all cells; bounded by the tokenizer's vocabulary.

        A task sends each row of its table as one compressed value; rows are added up
        in two steps, as a stream, so no task holds more than one of them.
        """
        end_id, kind, width = self.end_id, self.kind, len(marks)

        def count(batches):
            total = np.zeros(rows * width, np.int64)
            for batch in batches:
                for _, *row in rows_of(batch, kind):
                    for key in keys(*training_part(row), end_id, marks):
                        np.add.at(total, key, 1)
            yield from table_rows(enumerate(total.reshape(rows, width)), TaskContext.get().partitionId())
            del total
            C.trim()

        def add(batches):
            at, total = None, np.zeros(width, np.int64)
            for batch in batches:
                for r, data in zip(batch.column("r").to_pylist(), batch.column("data").to_pylist()):
                    if r != at:
                        if at is not None:
                            yield from table_rows([(at, total)], TaskContext.get().partitionId())
                        at, total = r, np.zeros(width, np.int64)
                    ids, n = table_row(data)
                    total[ids] += n
            if at is not None:
                yield from table_rows([(at, total)], TaskContext.get().partitionId())

        sent = self.streams.select("held", "ends", "ids").mapInArrow(count, TABLE)
        for by in (("r", F.col("part") % 16), ("r",)):
            sent = sent.repartition(*by).sortWithinPartitions("r").mapInArrow(add, TABLE)
        out = np.zeros((rows, width), np.float32)
        got = sent.select("r", "data").toArrow()
        for r, data in zip(got.column("r").to_pylist(), got.column("data").to_pylist()):
            ids, n = table_row(data)
            out[r, ids] += n
        return out

    def fit(self, model: Model, adam: Adam) -> None:
        """Train on every window of all training documents once, where they lie; used counts them.

        Each task starts a round from the same network and goes through its own windows
        of it; networks and moments are averaged by windows, in two steps, so the driver
        gets 16 at most.  Rounds are short at first, while networks still move apart.
        """
        end_id, kind, size, most = self.end_id, self.kind, BATCH, BUFFER

        def train(batches, begin, end):
            part = TaskContext.get().partitionId()
            rng, held, used = np.random.default_rng(part), [], 0

            def learn():
                nonlocal used
                slices, first, left = (np.concatenate(c) for c in zip(*held))
                held.clear()
                order = rng.permutation(len(slices))
                for at in range(0, len(order), size):
                    own = order[at : at + size]
                    x, y, real, _ = model.positions(slices[own], first[own], left[own])
                    adam.step(x, model.cls[y], real.astype(np.float32), begin + (end - begin) * at / len(order))
                used += len(order)

            for batch in batches:
                for _, *row in rows_of(batch, kind):
                    slices, _, first, left = slices_of(*training_part(row), end_id, lambda n: of_round(n, begin, end))
                    if len(slices):
                        held.append((slices, first, left))
                    if sum(len(x[0]) for x in held) >= most:
                        learn()
            if held:
                learn()
            if used:
                yield state(part, used, adam.vector() * used)
            C.trim()

        def state(part, used, vector):
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([used], pa.int64()), pa.array([vector.tobytes()], pa.binary())], ["part", "used", "data"])

        def add(batches):
            part, used, total = None, 0, 0.0
            for batch in batches:
                for p, n, data in zip(*(batch.column(c).to_pylist() for c in ("part", "used", "data"))):
                    part, used, total = p if part is None else part, used + n, total + np.frombuffer(data)
            if used:
                yield state(part, used, total)

        for k, share in enumerate(ROUNDS):
            begin = sum(ROUNDS[:k])
            sent = self.streams.select("held", "ends", "ids").mapInArrow(lambda batches, a=begin, b=begin + share: train(batches, a, b), STATES)
            got = sent.repartition(F.col("part") % 16).sortWithinPartitions("part").mapInArrow(add, STATES).toArrow().sort_by("part")
            n = int(pc.sum(got.column("used")).as_py() or 0)
            if n:
                adam.load(sum(np.frombuffer(x) for x in got.column("data").to_pylist()) / n)
                self.used += n

    def dealt(self) -> DataFrame:
        """(part, windows, times): all windows by a hash of what they hold and where, equal ones once, in parts of about BATCH."""
        end_id, kind, parts = self.end_id, self.kind, self.parts
        odd = np.random.default_rng(7).integers(0, 1 << 62, WINDOW + 3, np.uint64) * np.uint64(2) + np.uint64(1)

        def deal(batches):
            for batch in batches:
                for i, *row in rows_of(batch, kind):
                    slices, doc, begin, left = slices_of(*training_part(row), end_id)
                    ids = np.asarray(pc.fill_null(batch.column("doc_ids")[i].values, -1), np.int64)[row[2]]
                    h = C.mix(ids.view(np.uint64))[doc] + begin.astype(np.uint64) * odd[-1] + left.astype(np.uint64) * odd[-2]
                    for j in range(WINDOW + 1):
                        h += slices[:, j].astype(np.uint64) * odd[j]
                    h = C.mix(C.mix(h))
                    w = np.column_stack([slices, begin == 0, np.minimum(left, WINDOW + 1)]).astype("<u4")
                    part = (C.mix(h >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(C.signed(h)), pa.array([x.tobytes() for x in w], pa.binary())], ["part", "h", "w"])

        def pack(batches):
            for batch in batches:
                lists = [x.values for x in batch.column("own")]
                columns = [batch.column("part"), pa.array([b"".join(x.field("w").to_pylist()) for x in lists], pa.binary()), pa.array([np.asarray(x.field("times"), np.float32).tobytes() for x in lists], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["part", "windows", "times"])

        one = self.streams.select("doc_ids", "held", "ends", "ids").mapInArrow(deal, "part long, h long, w binary").groupBy("part", "h", "w").agg(F.count(F.lit(1)).alias("times"))
        groups = one.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("h", "w", "times"))).alias("own"))
        return groups.mapInArrow(pack, "part long, windows binary, times binary")

    def batches(self):
        """One batch a step: each part once, or again until there are STEPS."""
        parts, kept, done = C.settle(self.dealt(), "dealt").orderBy("part"), [], 0

        def arrays(r):
            w = np.frombuffer(r.windows, "<u4").reshape(-1, WINDOW + 3).astype(np.int32)
            return w[:, : WINDOW + 1], 1 - w[:, -2], w[:, -1], np.frombuffer(r.times, np.float32)

        for r in parts.toLocalIterator():
            if self.parts <= STEPS:
                kept.append(arrays(r))
            done += 1
            yield arrays(r)
        while kept and done < self.steps:
            for x in kept[: self.steps - done]:
                done += 1
                yield x


def score(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs (doc_id, text, held) scored: (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)."""
    path = path or bpe.default_path()
    blocks = C.settle(blocks_of(docs), "blocks")
    (n_used,) = blocks.select(F.coalesce(F.sum(F.size(F.filter("held", lambda h: ~h))), F.lit(0))).first()
    words = blocks.select("block", F.posexplode(F.arrays_zip("words", "times")).alias("pos", "w")).select(F.col("w.words").alias("word"), "block", F.shiftleft("w.times", 32).bitwiseOR(F.col("pos").cast("long")).alias("place"))
    counts, kind = C.settle(numbered(words, path), "counts"), width(path)
    sums = counts.where("of is null")
    total, distinct = sums.select(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    total, distinct = total + n_used, distinct + (n_used > 0)
    end_id = max(bpe.load(path).tokens)

    def by_id(batches):
        n = np.zeros(end_id + 1, np.int64)
        for batch in batches:
            for raw in batch.column("id_counts").to_pylist():
                n += np.frombuffer(zstandard.decompress(raw), "<u8").astype(np.int64)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["id", "n"])

    # Bounded by the tokenizer's vocabulary.
    of_ids = sums.select("id_counts").mapInArrow(by_id, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    id_counts = np.zeros(end_id + 1)
    id_counts[np.asarray(of_ids.column("id"), np.int64)] = np.asarray(of_ids.column("n"))
    id_counts[end_id] += n_used
    known = counts.where("of is not null").select("of", "data")

    def join(block: pa.Table, c: pa.Table) -> pa.Table:
        ends = np.asarray(block.column("ends").combine_chunks().flatten(), np.int64)
        held = np.asarray(block.column("held").combine_chunks().flatten(), bool)
        index = np.frombuffer(zstandard.decompress(block.column("index")[0].as_py()), "<i4")
        count, ids, id_ends = entries(c.column("data").to_pylist(), kind)
        n, scale = np.diff(ends), np.log10(total + distinct + 1)
        doc = np.repeat(np.arange(len(n)), n)
        base = np.bincount(doc, (np.log10(count + 1.0) - scale)[index], len(n)) + np.log10(n_used + 1.0) - scale
        seen = np.bincount(doc, (count > 0)[index], len(n)).astype(np.int64) + int(n_used > 0)
        by_word = np.concatenate([[0], np.cumsum(np.diff(id_ends)[index])])
        flat = np.empty(by_word[-1], kind)
        for at in range(0, len(index), 1 << 20):
            own = C.gather(ids, id_ends, index[at : at + (1 << 20)])[0]
            flat[by_word[at] : by_word[at] + len(own)] = own
        id_ends = by_word[ends]
        windows = int(windows_in(np.diff(id_ends)[~held] + 1).sum())
        row = [block.column("doc_ids")[0].as_py()], [held.tolist()], [seen], [base], [id_ends], [zstandard.compress(flat.tobytes(), 3)], [windows], [n + 1]
        kinds = pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.binary(), pa.int64(), pa.list_(pa.int64())
        return pa.Table.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], names)

    names = [*(x.split()[0] for x in STREAMS.split(", ")), "n"]
    packed = blocks.select("block", "doc_ids", "held", "ends", "index")
    streams = C.settle(packed.groupBy("block").cogroup(known.groupBy("of")).applyInArrow(join, f"{STREAMS}, n array<long>"), "streams")
    C.discard(blocks, counts)
    model = Model(Corpus(streams, end_id, kind), id_counts, end_id)
    C.release(blocks.sparkSession)

    def finish(batches):
        for batch in batches:
            for i, ids, ends, used in rows_of(batch, kind):
                doc_ids, seen, base, n = (batch.column(x)[i].values for x in ("doc_ids", "seen", "base", "n"))
                columns = [doc_ids, pa.array(~used), n, seen, pa.array(np.full(len(used), total, np.int64)), base, pa.array(model.score(ids, ends))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
        C.trim()

    return streams.mapInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def query_of(docs: DataFrame) -> DataFrame:
    return score(C.ids_and_texts(docs).withColumn("held", held_out(7, 2)))


def query(spark, sf_dir: str) -> DataFrame:
    return query_of(C.table(spark, sf_dir, "documents"))

"""MinHash near-deduplication with odd sketches.

A text's set holds the distinct shingles of its lower-cased words.  Texts with
equal sets form a class, represented by its smallest doc_id.  MinHash samples of
the representatives give band keys, and the samples are folded into an odd sketch:
a bitmap in which each sample flips one bit.  The XOR of two sketches counts the
samples in which they differ, which estimates high similarities precisely; a pair
stays a candidate unless the estimate is ``SIGMAS`` standard deviations below the
threshold.  Candidates are confirmed on the full sets.

Within a bucket (the rows of one band key) pairs are not listed.  First all are
compared with the bucket's smallest id.  After joining what that links, only
buckets of three rows or more that still hold several components are left; blocks
of their members are compared sketch by sketch inside one task.  Pairs that pass
are held against odd sketches of the full sets: the XOR count never exceeds the
sets' difference, so a count above what the threshold allows refutes a pair for
certain.  Only what is left, of different components, comes out to be confirmed.
Nothing is capped: every pair of a bucket is confirmed, refuted, or known to be
connected.  Tables are joined by shuffles alone: all of them grow with the rows, and
a broadcast goes through the driver.

With 32 bands of 4 samples, a pair at a similarity of 0.8 shares no bucket with a
probability of 5e-8, at 0.85 of 6e-11.

A text without words, or null, has an empty set and is linked with nothing; a text
with fewer words than a shingle has one shingle, all its words.  Rows that share a
doc_id count as one document with the links of all of them.  A row with a null
doc_id is linked with nothing: its component_id is null, and it is kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import _common as C
from corvane.llm._graph import SALTS, components

SHINGLE = 5
BANDS = 32
ROWS = 4
SKETCH_BITS = 512
SIGMAS = 6.0
MEMBERS_A_BLOCK = 512
PAIRS_A_SET = 256  # compared with one copy of a set
BLOCK_BYTES = 8 << 20  # of sketches of full sets


def shingle_sets(text: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    words, index, ends = C.index_words(text, lower=True)
    size = np.diff(ends)
    hashes = C.SpanHash(words, index, 5)
    whole = hashes.spans(ends[:-1], size)
    grams = hashes.spans(np.arange(max(0, len(index) - k + 1)), k)
    return [np.unique(grams[a : a + n - k + 1]) if n >= k else whole[i : i + 1][: int(n > 0)] for i, (a, n) in enumerate(zip(ends, size))]


def multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20260101)
    return rng.integers(0, 1 << 31, n, np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, n, np.uint32)


def minhash(sets: list[np.ndarray], samples: int) -> np.ndarray:
    """The least of each permuted 32-bit hash over each set; sets are not empty."""
    a, b = multipliers(samples)
    out = np.full((len(sets), samples), 0xFFFFFFFF, np.uint32)
    for i, s in enumerate(sets):
        x = (C.mix(s) >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(x), 2048):  # stays in the cache
            np.minimum(out[i], (x[None, at : at + 2048] * a[:, None] + b[:, None]).min(1), out=out[i])
    return out


def band_keys(samples: np.ndarray, rows: int) -> np.ndarray:
    n = samples.shape[1] // rows
    value = np.zeros((len(samples), n), np.uint64)
    for r in range(rows):
        value = C.mix(value * np.uint64(0x9E3779B97F4A7C15) + samples[:, r::rows][:, :n].astype(np.uint64) + np.uint64(1))
    return C.mix(value + np.arange(n, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def odd_sketch(samples: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """Parities of how many samples fall on each bit, as 64-bit words."""
    n, k = samples.shape
    place = C.mix(C.mix(samples.astype(np.uint64) + (np.arange(k, dtype=np.uint64) << np.uint64(32)))) % np.uint64(bits)
    flat = np.bincount((np.arange(n)[:, None] * bits + place.astype(np.int64)).ravel(), minlength=n * bits) & 1
    return np.packbits(flat.astype(np.uint8), bitorder="little").view("<u8").reshape(n, bits // 64)


def most_xor(threshold: float, samples: int, bits: int, sigmas: float = SIGMAS) -> int:
    """The largest XOR count that a pair at the threshold may show.

    With d differing samples, 2d balls fall on the bits; the expected count is
    bits / 2 * (1 - (1 - 2 / bits) ** 2d).
    """
    d = samples * (1 - threshold) + sigmas * np.sqrt(samples * threshold * (1 - threshold))
    mean = bits / 2 * (1 - (1 - 2 / bits) ** (2 * d))
    return int(mean + sigmas * np.sqrt(min(2 * d, bits / 4)))


def whole_sketch(s: np.ndarray) -> bytes:
    """An odd sketch of a full set: about 4 to 8 bits for each shingle, a power of two in all."""
    bits = max(256, 1 << int(4 * len(s) - 1).bit_length())
    flat = np.bincount((C.mix(s) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flat.astype(np.uint8), bitorder="little").tobytes()


class Members:
    """Rows of a block: ids, components, set sizes, MinHash sketches, and the sketches of full sets by their length."""

    def __init__(self, members: pa.Scalar):
        rows = members.values
        self.ids, self.own, self.n = (np.asarray(rows.field(c), np.int64) for c in ("doc_id", "component", "n_shingles"))
        self.sketch = np.asarray(rows.field("sketch").flatten(), np.int64).view(np.uint64).reshape(len(rows), -1)
        raw = rows.field("odd").to_pylist()
        self.words = np.array([len(x) // 8 for x in raw], np.int64)
        self.row = np.zeros(len(raw), np.int64)
        self.odd = {}
        for w in np.unique(self.words).tolist():
            at = np.flatnonzero(self.words == w)
            self.row[at] = np.arange(len(at))
            self.odd[w] = np.frombuffer(b"".join(raw[i] for i in at), "<u8").reshape(len(at), w)


def fold(x: np.ndarray, words: int) -> np.ndarray:
    while x.shape[1] > words:
        half = x.shape[1] // 2
        x = x[:, :half] ^ x[:, half:]
    return x


def unrefuted(x: Members, y: Members, most: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in x and y of pairs of different components that no sketch rules out."""
    found = []
    for at in range(0, len(x.ids), 64):
        part = slice(at, at + 64)
        differ = np.zeros((len(x.ids[part]), len(y.ids)), np.uint16)
        for w in range(x.sketch.shape[1]):
            differ += np.bitwise_count(x.sketch[part, w, None] ^ y.sketch[None, :, w])
        small, large = np.minimum(x.n[part, None], y.n[None, :]), np.maximum(x.n[part, None], y.n[None, :])
        p, q = np.nonzero((differ <= most) & (x.own[part, None] != y.own[None, :]) & (100 * small >= percent * large))
        p += at
        allowed = (x.n[p] + y.n[q]) * (100 - percent) // (100 + percent)
        keep = np.zeros(len(p), bool)
        kind = x.words[p] << 32 | y.words[q]
        for k in np.unique(kind).tolist():
            pair = np.flatnonzero(kind == k)
            wx, wy = k >> 32, k & 0xFFFFFFFF
            step = max(1, (1 << 18) // max(wx, wy))
            for i in range(0, len(pair), step):
                own = pair[i : i + step]
                a, b = (fold(m.odd[w][m.row[r[own]]], min(wx, wy)) for m, w, r in ((x, wx, p), (y, wy, q)))
                keep[own] = np.bitwise_count(a ^ b).sum(1) <= allowed[own]
        found.append((p[keep], q[keep]))
    return tuple(np.concatenate(c) for c in zip(*found))


def signatures(docs: DataFrame, k: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, h1, h2, bands, sketch, odd); the last five are null for an empty set."""

    def step(batch):
        sets = shingle_sets(batch.column("text"), k)
        sizes = np.array([len(s) for s in sets], np.int64)
        real = np.flatnonzero(sizes)
        full = [sets[i] for i in real]
        samples = minhash(full, bands * rows)
        row = np.full(len(sets), -1)
        row[real] = np.arange(len(real))
        take = pa.array(row, mask=row < 0)
        h1 = pa.array([int(C.signed(C.mix(s).sum(keepdims=True))[0]) for s in full], pa.int64())
        h2 = pa.array([int(C.signed(C.mix(C.mix(s) + np.uint64(7)).sum(keepdims=True))[0]) for s in full], pa.int64())
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(C.signed(np.ascontiguousarray(x).ravel())), x.shape[1]).cast(pa.list_(pa.int64())) for x in (band_keys(samples, rows), odd_sketch(samples))]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), *(x.take(take) for x in (h1, h2, *lists, pa.array([whole_sketch(s) for s in full], pa.binary())))], ["doc_id", "n_shingles", "h1", "h2", "bands", "sketch", "odd"])

    return C.map_arrow(docs, step, "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>, sketch array<long>, odd binary")


def passing(keys: DataFrame, sketch: DataFrame, most: int, bits: int) -> DataFrame:
    """The pairs (a, b) of rows of keys (key, doc_id, a) whose sketches differ in no more than ``most`` bits; a is the bucket's least id.

    A bucket's sketch is looked up once and handed to its rows in SALTS portions, so
    neither a large bucket nor an id that leads many of them is a hot key.
    """
    lead = keys.select("key", "a").distinct().join(C.merged(sketch.select(F.col("doc_id").alias("a"), F.col("sketch").alias("sa"))), "a")
    lead = lead.select("key", "a", "sa", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = keys.where("doc_id != a").select("key", F.col("doc_id").alias("b"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
    two = rows.join(C.merged(lead), ["key", "salt"]).select("a", "b", "sa").dropDuplicates(["a", "b"]).join(C.merged(sketch.select(F.col("doc_id").alias("b"), F.col("sketch").alias("sb"))), "b")
    differ = sum((F.bit_count(F.col("sa")[i].bitwiseXOR(F.col("sb")[i])) for i in range(bits // 64)), F.lit(0))
    return two.where(differ <= most).select("a", "b")


def confirm(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union, on full sets."""

    def sets(batch):
        own = [s.astype("<u8").tobytes() for s in shingle_sets(batch.column("text"), k)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(own, pa.binary())], ["doc_id", "set"])

    def alike(x, y) -> bool:
        x, y = (x, y) if len(x) <= len(y) else (y, x)
        both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
        return 100 * both >= percent * (len(x) + len(y) - both)

    def compare_rows(batch):
        keep = [alike(*(np.frombuffer(z.as_buffer(), "<u8") for z in pair)) for pair in zip(batch.column("set_a"), batch.column("set_b"))]
        return batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def compare(batches):
        a, own = None, None
        for batch in batches:
            found = []
            for i, b in enumerate(batch.column("b").to_pylist()):
                x = np.frombuffer(batch.column("set")[i].as_buffer(), "<u8")
                if b is None:  # the set that those after it are compared with
                    a, own = batch.column("a")[i].as_py(), x.copy()
                    continue
                if batch.column("a")[i].as_py() != a:
                    raise ValueError("a set is missing")
                if alike(x, own):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    wanted = C.settle(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct(), "wanted")
    full = C.settle(C.map_arrow(docs.join(C.merged(wanted), "doc_id"), sets, "doc_id long, set binary"), "sets")
    # Ids that several texts share have several sets; their pairs are joined one by one.
    several = C.settle(full.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("a")), "several")
    # A set travels once for each PAIRS_A_SET of its pairs, ahead of the sets that it is compared with; parts is 0 for several sets.
    counts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PAIRS_A_SET).cast("int").alias("parts"))
    counts = counts.join(C.merged(several.withColumn("plain", F.lit(0))), "a", "left").select("a", F.coalesce("plain", "parts").alias("parts"))
    counts = C.settle(counts, "parts")
    portions = counts.select("a", "parts", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    dealt = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")).join(C.merged(portions), ["a", "salt"])
    dealt = C.settle(dealt.select("a", "b", "parts"), "dealt")
    plain, shared = dealt.where("parts = 0").select("a", "b"), counts.where("parts > 0")
    parted = dealt.where("parts > 0").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    one = plain.join(C.merged(full.select(F.col("doc_id").alias("a"), F.col("set").alias("set_a"))), "a").join(C.merged(full.select(F.col("doc_id").alias("b"), F.col("set").alias("set_b"))), "b")
    joined = one.select("a", "b", "set_a", "set_b").mapInArrow(lambda batches: (compare_rows(batch) for batch in batches), "a long, b long")
    left = shared.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).join(C.merged(full.select(F.col("doc_id").alias("a"), "set")), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "set")
    right = parted.join(C.merged(full.select(F.col("doc_id").alias("b"), "set")), "b").select("a", "part", "b", "set")
    met = left.unionByName(right).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    out = C.settle(met.select("a", "b", "set").mapInArrow(compare, "a long, b long").unionByName(joined).distinct(), "confirmed")
    C.discard(wanted, full, several, counts, dealt)
    return out


def cross_pairs(keys: DataFrame, labels: DataFrame, reps: DataFrame, most: int, percent: int) -> DataFrame:
    """Pairs of different components within the buckets of keys (key, doc_id) that their sketches let pass."""
    labelled = keys.join(C.merged(labels.select("doc_id", "component")), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    sized = labelled.join(C.merged(reps.select("doc_id", "n_shingles", F.length("odd").alias("bytes"))), "doc_id")
    open_keys = sized.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.sum("bytes").alias("bytes"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("size > 2 and lo != hi").select("key", "size", "bytes")
    open_keys = C.settle(open_keys, "open")
    rows = labelled.join(C.merged(open_keys), "key").join(C.merged(reps.select("doc_id", "n_shingles", "sketch", "odd")), "doc_id")
    rows = rows.withColumn("blocks", F.greatest(F.ceil(F.col("size") / MEMBERS_A_BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    blocks = C.settle(rows.groupBy("key", "blocks", "block").agg(F.collect_list(F.struct("doc_id", "component", "n_shingles", "sketch", "odd")).alias("members")), "blocks")
    left = blocks.select("key", "block", "members", F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)).alias("other"))
    met = left.join(C.merged(blocks.select("key", F.col("block").alias("other"), F.col("members").alias("others"))), ["key", "other"])

    def compare(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                x, y = Members(batch.column("members")[i]), Members(batch.column("others")[i])
                p, q = unrefuted(x, y, most, percent)
                pair = np.unique(np.stack([np.minimum(x.ids[p], y.ids[q]), np.maximum(x.ids[p], y.ids[q])]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], ["a", "b"])

    return met.select("members", "others").mapInArrow(compare, "a long, b long").distinct()


def classes(docs: DataFrame, percent: int, k: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row for each row of docs (doc_id, text)."""
    signed = C.settle(signatures(docs, k, bands, rows), "signatures")
    real = signed.where("n_shingles > 0 and doc_id is not null")
    same = C.settle(real.groupBy("n_shingles", "h1", "h2").agg(F.min("doc_id").alias("rep")), "same")
    reps = real.join(C.merged(same.select(F.col("rep").alias("doc_id")).distinct()), "doc_id")
    reps = C.settle(reps.select("doc_id", "n_shingles", "bands", "sketch", "odd"), "representatives")
    sketch = reps.select("doc_id", "sketch")
    keys = reps.select("doc_id", F.explode("bands").alias("key"))
    shared = C.settle(keys.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).where("a != z").select("key", "a"), "buckets")
    keys = C.settle(keys.join(C.merged(shared), "key").select("key", "doc_id", "a"), "keys")
    most = most_xor(percent / 100, bands * rows, SKETCH_BITS)
    first = C.settle(passing(keys, sketch, most, SKETCH_BITS), "pairs")
    # Rows of one doc_id with different texts, and the sets equal to a representative's, are links as they stand.
    twins = real.join(C.merged(same), ["n_shingles", "h1", "h2"]).where("doc_id != rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    edges = C.settle(confirm(first, docs, k, percent), "links")
    labels = components(edges)
    rest = C.settle(cross_pairs(keys.select("key", "doc_id").distinct(), labels.withColumnRenamed("id", "doc_id"), reps, most, percent), "rest")
    if not rest.isEmpty():
        edges = edges.unionByName(confirm(rest, docs, k, percent))
    labels = components(edges.unionByName(twins))
    found = signed.select("doc_id", "n_shingles").join(C.merged(labels.select(F.col("id").alias("doc_id"), "component")), "doc_id", "left")
    return found.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def dedup(docs: DataFrame, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept)."""
    out = classes(C.ids_and_texts(docs), percent)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def query(spark, sf_dir: str) -> DataFrame:
    return dedup(C.table(spark, sf_dir, "documents"), 85)

"""Token ids in binary files, coded by a range asymmetric numeral system (rANS).

One static table of frequencies, counted over all ids, is shared by all blocks.
A block is coded by interleaved lanes, each a 64-bit state; every ``CHECKPOINT``
steps the states and the place in the stream are kept, so a reader may start at
any checkpoint and decodes all of them in parallel.  Each block has a CRC-32 of
its ids, which a reader verifies.

A folder holds ``chunks``, Parquet files whose rows are chunks: whole documents in
ascending doc_id order, with their ids in blocks, and ``table``, one row with the
format's version, the end id and the frequencies; reading needs the folder only.
Spark's committer makes a file appear once, whatever happens to the executor that
writes it.

A null text is empty and so has the end id only.  Null doc_ids sort first.  Rows
that share a doc_id are all kept; among them the order is by their ids.  An empty
table has a table of frequencies without ids.  A very long text is a chunk of its
own.  Further columns are left out.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm import _common as C
from corvane.llm import bpe

BITS = 20  # the frequencies' sum is 2 ** BITS
LOW = np.uint64(1 << 32)  # states lie in [LOW, 2 ** 64)
LANES = 32
CHECKPOINT = 256  # steps; a step codes one id in each lane
BLOCK = 8 * CHECKPOINT * LANES  # ids
CHUNK = 1 << 20  # ids after which a chunk is closed
SLICE = 12 << 20  # bytes of text that are encoded at a time
VERSION = 1
END_ID = 1


def frequencies(counts: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Counts scaled to the sum 2 ** bits; no id that occurs gets 0."""
    counts = np.asarray(counts, np.float64)
    seen = counts > 0
    total = 1 << bits
    if seen.sum() > total:
        raise ValueError("more ids than the table has slots")
    out = np.zeros(len(counts), np.int64)
    if not seen.any():
        return out
    out[seen] = np.maximum(1, np.floor(counts[seen] / counts.sum() * total)).astype(np.int64)
    while (over := int(out.sum()) - total) > 0:  # taken from the largest, which keep at least 1
        big = np.argsort(-out, kind="stable")[: max(1, min(over, int((out > 1).sum())))]
        out[big[: over]] -= 1
    out[np.argmax(out)] -= over
    return out


class Coder:
    def __init__(self, freq: np.ndarray, bits: int = BITS):
        self.bits = bits
        self.freq = np.asarray(freq, np.uint64)
        self.start = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.slot = np.repeat(np.arange(len(freq), dtype=np.uint32), np.asarray(freq, np.int64))

    def encode(self, ids: np.ndarray) -> list[bytes]:
        """The blocks of ids; all blocks are coded at once."""
        n_blocks = -(-len(ids) // BLOCK)
        if not n_blocks:
            return []
        steps = -(-min(len(ids), BLOCK) // LANES)
        padded = np.zeros(n_blocks * steps * LANES, np.uint32)
        if n_blocks > 1:
            steps = BLOCK // LANES
            padded = np.zeros(n_blocks * BLOCK, np.uint32)
        padded[: len(ids)] = ids
        sym = padded.reshape(n_blocks, steps, LANES)
        real = (np.arange(padded.size) < len(ids)).reshape(sym.shape)
        f, s = self.freq[sym], self.start[sym]
        state = np.full((n_blocks, LANES), LOW, np.uint64)
        words = np.zeros(sym.shape, np.uint32)
        sent = np.zeros(sym.shape, bool)
        marks: list[tuple[int, np.ndarray]] = []
        shift, bits = np.uint64(64 - self.bits), np.uint64(self.bits)
        for t in range(steps - 1, -1, -1):
            here, ft = real[:, t], f[:, t]
            full = here & ((state >> shift) >= ft)
            words[:, t], sent[:, t] = (state & np.uint64(0xFFFFFFFF)).astype(np.uint32), full
            state = np.where(full, state >> np.uint64(32), state)
            safe = np.where(here, ft, np.uint64(1))
            q = state // safe
            state = np.where(here, (q << bits) + (state - q * safe) + s[:, t], state)
            if t % CHECKPOINT == 0:
                marks.append((t, state.copy()))
        marks.reverse()
        out = []
        for b in range(n_blocks):
            n = min(BLOCK, len(ids) - b * BLOCK)
            used = -(-n // LANES)
            own = [(t, m[b]) for t, m in marks if t < used]
            ends = np.concatenate([[0], np.cumsum(sent[b].sum(1))])
            crc = zlib.crc32(np.ascontiguousarray(ids[b * BLOCK : b * BLOCK + n], "<u4").tobytes())
            head = struct.pack("<III", n, crc, len(own))
            points = b"".join(struct.pack("<I", int(ends[t])) + m.astype("<u8").tobytes() for t, m in own)
            out.append(head + points + words[b][sent[b]].astype("<u4").tobytes())
        return out

    def decode(self, blocks: list[bytes]) -> np.ndarray:
        """The ids of blocks; all checkpoints of all blocks are decoded side by side."""
        sizes, crcs, at, states, left, streams, base = [], [], [], [], [], [], 0
        width = 4 + 8 * LANES
        for raw in blocks:
            n, crc, k = struct.unpack_from("<III", raw)
            sizes.append(n)
            crcs.append(crc)
            for i in range(k):
                o = 12 + i * width
                at.append(base + struct.unpack_from("<I", raw, o)[0])
                states.append(np.frombuffer(raw, "<u8", LANES, o + 4))
                left.append(min(CHECKPOINT * LANES, n - i * CHECKPOINT * LANES))
            streams.append(np.frombuffer(raw, "<u4", offset=12 + k * width))
            base += len(streams[-1])
        if not sizes:
            return np.zeros(0, np.uint32)
        stream = np.concatenate([*streams, np.zeros(1, np.uint32)])
        place, state, left = np.array(at, np.int64), np.array(states, np.uint64), np.array(left, np.int64)
        steps = -(-int(left.max()) // LANES)
        out = np.zeros((len(left), steps, LANES), np.uint32)
        mask, bits, lane = np.uint64((1 << self.bits) - 1), np.uint64(self.bits), np.arange(LANES)
        for t in range(steps):
            here = t * LANES + lane[None, :] < left[:, None]
            slot = state & mask
            sym = np.where(here, self.slot[slot.astype(np.int64)], 0)
            out[:, t] = sym
            state = np.where(here, self.freq[sym] * (state >> bits) + slot - self.start[sym], state)
            low = here & (state < LOW)
            n_low = np.cumsum(low, 1)
            word = stream[np.where(low, place[:, None] + n_low - 1, len(stream) - 1)]
            state = np.where(low, (state << np.uint64(32)) | word.astype(np.uint64), state)
            place += n_low[:, -1]
        ids = out.reshape(len(left), -1)[np.arange(steps * LANES)[None, :] < left[:, None]]
        end = np.cumsum(sizes)
        for a, b, crc in zip(end - np.array(sizes), end, crcs):
            if zlib.crc32(np.ascontiguousarray(ids[a:b], "<u4").tobytes()) != crc:
                raise ValueError("a block's checksum does not match")
        return ids


def token_rows(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """(doc_id, n, ids): ids by the tokenizers library with end_id last, compressed for transport.

    A row with n = -1 for each task holds how often each id occurs in its rows.
    """
    names = ["doc_id", "n", "ids"]

    def run(batches):
        pack, counts = zstandard.ZstdCompressor(level=1), np.zeros(0, np.int64)
        for batch in C.text_slices(batches, most=SLICE):
            ids, ends = bpe.load(path).library_texts(batch.column("text"))
            ids = np.insert(ids, ends[1:], np.uint32(end_id))
            ends = ends + np.arange(len(ends))
            own = np.bincount(ids, minlength=len(counts))
            own[: len(counts)] += counts
            counts = own
            wide = "<u2" if int(ids.max(initial=0)) < 65536 else "<u4"
            raw, mark, at = memoryview(ids.astype(wide).tobytes()), wide[-1].encode(), (ends * int(wide[-1])).tolist()
            sent = [mark + pack.compress(raw[a:b]) for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(ends), pa.int64()), pa.array(sent, pa.binary())], names)
        if len(counts):
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([-1], pa.int64()), pa.array([pack.compress(counts.astype("<u8").tobytes())], pa.binary())], names)
        C.trim()

    return C.ids_and_texts(docs).mapInArrow(run, "doc_id long, n long, ids binary")


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(raw[1:]), f"<u{raw[:1].decode()}").astype(np.uint32)


def count_ids(batches):
    """(id, n) of the counts of tasks."""
    total = np.zeros(0, np.int64)
    for batch in batches:
        for raw in batch.column("ids").to_pylist():
            own = np.frombuffer(zstandard.decompress(raw), "<u8").astype(np.int64)
            total = np.pad(total, (0, max(0, len(own) - len(total))))
            total[: len(own)] += own
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["id", "n"])


CHUNK_SCHEMA = "part int, chunk int, start long, n_ids long, doc_ids array<long>, lengths array<long>, blocks array<binary>"


TABLE_SCHEMA = "version int, end_id int, bits int, ids array<int>, freq array<int>"


def write(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID, ids_a_file: int = 1 << 22) -> None:
    """Write the files of docs into a new folder.

    start is a chunk's first id within its file; files follow one another by part.
    """
    spark = docs.sparkSession
    rows = C.settle(token_rows(docs, path or bpe.default_path(), end_id), "ids")
    # Bounded by the vocabulary: one number for each id that occurs.
    counted = rows.where("n < 0").select("ids").mapInArrow(count_ids, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    at, n = (np.asarray(counted.column(c), np.int64) for c in ("id", "n"))
    counts = np.zeros(int(at.max(initial=-1)) + 1, np.int64)
    counts[at] = n
    freq = frequencies(counts)
    files = max(1, -(-int(n.sum()) // ids_a_file), spark.sparkContext.defaultParallelism)

    def encode(batches):
        coder, part = Coder(freq), TaskContext.get().partitionId()
        chunk = start = 0
        doc_ids, ids = [], []

        def flush():
            nonlocal chunk, start
            lengths = [len(x) for x in ids]
            blocks = coder.encode(np.concatenate(ids))
            row = [part], [chunk], [start], [sum(lengths)], [doc_ids], [lengths], [blocks]
            chunk, start = chunk + 1, start + sum(lengths)
            kinds = pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], CHUNK_NAMES)

        size = 0
        for batch in batches:
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
                doc_ids.append(doc_id)
                ids.append(unpacked(raw))
                size += len(ids[-1])
                if size >= CHUNK:
                    yield flush()
                    doc_ids, ids, size = [], [], 0
        if ids:
            yield flush()

    ordered = rows.where("n >= 0").select("doc_id", "ids").repartitionByRange(files, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids")
    ordered.mapInArrow(encode, CHUNK_SCHEMA).write.parquet(f"{folder}/chunks")
    known = np.flatnonzero(freq)
    spark.createDataFrame([(VERSION, end_id, BITS, known.tolist(), freq[known].tolist())], TABLE_SCHEMA).coalesce(1).write.parquet(f"{folder}/table")
    C.discard(rows)


CHUNK_NAMES = [x.split()[0] for x in CHUNK_SCHEMA.split(", ")]


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids, crc) from the files of a folder; start counts the ids of all files before too."""
    (table,) = spark.read.schema(TABLE_SCHEMA).parquet(f"{folder}/table").collect()
    if table.version != VERSION:
        raise ValueError(f"files of version {table.version}, not {VERSION}")
    freq = np.zeros(max(table.ids, default=-1) + 1, np.int64)
    freq[table.ids] = table.freq
    bits = table.bits
    chunks = spark.read.schema(CHUNK_SCHEMA).parquet(f"{folder}/chunks")
    sizes = chunks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # One row for each file.
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))

    def decode(batches):
        coder = Coder(freq, bits)
        for batch in batches:
            for i in range(batch.num_rows):
                lengths = np.asarray(batch.column("lengths")[i].values, np.int64)
                ids = coder.decode(batch.column("blocks")[i].as_py())
                ends = np.concatenate([[0], np.cumsum(lengths)])
                raw = [ids[a:b].astype("<u4").tobytes() for a, b in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays([batch.column("doc_ids")[i].values, pa.array(ends[:-1] + batch.column("start")[i].as_py(), pa.int64()), pa.array(lengths, pa.int64()), pa.array(raw, pa.binary()), pa.array(np.full(len(lengths), batch.column("part")[i].as_py()), pa.int32())], ["doc_id", "start", "n_tokens", "ids", "part"])

    rows = chunks.select("part", "start", "doc_ids", "lengths", "blocks").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary, part int")
    rows = rows.withColumn("crc", F.crc32("ids"))
    return rows.join(F.broadcast(before), "part").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids", "crc")


def query_of(docs: DataFrame) -> DataFrame:
    folder = f"{C.shared_dir(docs.sparkSession)}/token-files-{uuid.uuid4().hex}"
    write(docs, folder)
    return read(docs.sparkSession, folder).select("doc_id", "start", "n_tokens", F.col("crc").alias("ids_crc32"))


def query(spark, sf_dir: str) -> DataFrame:
    return query_of(C.table(spark, sf_dir, "documents"))

"""What the operators share: tables, the shared folder, word splitting and hashing."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that one Arrow batch is cut into before Python touches it, by their text bytes.
SLICE_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; one of our own only where the session names none."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = tempfile.mkdtemp(prefix="corvane-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    This cuts the lineage, survives lost executors, and lets Spark drop the
    shuffle files that only df needed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    schema = df.schema
    del df
    release(spark)
    out = spark.read.schema(schema).parquet(path)
    out.settled_at = path  # kept by this object only, not by what is derived from it
    return out


def discard(*settled: DataFrame) -> None:
    """Delete tables that settle wrote, once nothing that is still to run reads them."""
    for df in settled:
        if not hasattr(df, "settled_at"):
            continue
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.settled_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def merged(df: DataFrame) -> DataFrame:
    """df as a side of a join that both sides are shuffled for.

    Spark takes tables for small by their compressed files, before rows are exploded,
    and would collect them on the driver to broadcast them, however they grow.
    """
    return df.hint("merge")


def trim() -> None:
    """Give memory that Python and Arrow no longer use back to the system; workers are used again."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def ids_and_texts(docs: DataFrame) -> DataFrame:
    """The two columns most operators need; other columns, whatever their names, are left out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into slices of about most bytes of text, so memory follows the longest text, not the row count."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        part = np.cumsum(sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def text_bytes(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class SpanHash:
    """Hashes of any span of a word sequence from prefix sums of a polynomial modulo 2 ** 64."""

    def __init__(self, words: list[bytes], index: np.ndarray, seed: int):
        base = xxhash.xxh64_intdigest(b"base", seed) | 1
        n = len(index)
        terms = hash_words(words, seed)[index] if n else np.zeros(0, np.uint64)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(terms * powers(base, n), out=self.prefix[1:])
        self.back = powers(pow(base, -1, 1 << 64), n + 1)

    def spans(self, start: np.ndarray, length) -> np.ndarray:
        """Of words start .. start + length - 1; equal spans have equal hashes wherever they stand."""
        value = (self.prefix[start + length] - self.prefix[start]) * self.back[start]
        return mix(value + mix(np.atleast_1d(length).astype(np.uint64) + np.uint64(1)))


def index_array(texts: pa.Array | list[bytes], lower: bool = False) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of texts: the distinct words, the index of every word, and where each text starts.

    lower maps A-Z, and nothing else, to lower case.  A null text is empty.
    """
    if isinstance(texts, list):
        texts = pa.array(texts, pa.binary()).cast(pa.string())
    texts = pc.fill_null(texts, "")
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    coded = parts.flatten().dictionary_encode()
    index = np.asarray(coded.indices).astype(np.int32, copy=False)
    ends = np.asarray(parts.offsets).astype(np.int64)
    ends = ends - ends[0]
    words = coded.dictionary
    empty = pc.index(words, "").as_py()
    if empty >= 0:  # stands for white space at an end of a text
        real = index != empty
        ends = np.concatenate([[0], np.cumsum(real)])[ends]
        index = index[real]
        index -= index > empty
        words = pa.concat_arrays([words.slice(0, empty), words.slice(empty + 1)])
    return words, index, ends


def index_words(texts: pa.Array | list[bytes], lower: bool = False) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """As index_array, with the words in UTF-8."""
    words, index, ends = index_array(texts, lower)
    return words.cast(pa.binary()).to_pylist(), index, ends


def hash_words(words: list[bytes], seed: int = 0) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def gather(lists_flat: np.ndarray, lists_start: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate the lists named by index; also the length of each."""
    size = (lists_start[1:] - lists_start[:-1])[index]
    end = np.cumsum(size)
    total = int(end[-1]) if len(end) else 0
    at = np.arange(total, dtype=np.int64) + np.repeat(lists_start[:-1][index] - (end - size), size)
    return lists_flat[at], size


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer for 64-bit hashes."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def map_arrow(df: DataFrame, step: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, column: str = "text", most: int = SLICE_BYTES) -> DataFrame:
    """Apply step to slices of bounded text size."""

    def run(batches):
        for batch in text_slices(batches, column, most):
            out = step(batch)
            if out is not None and out.num_rows:
                yield out
        trim()

    return df.mapInArrow(run, schema)


def crc_mod(column: str, mod: int) -> F.Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % mod

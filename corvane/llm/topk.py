"""Exact top-k inner-product search over impact-ordered segments.

A block of vectors is indexed by component: the integers of one component are
cut into levels, and the vectors of one level form a posting segment.  For a
query, the segment of component j and level l has the impact q_j * level, less
the least impact of that component, so impacts are never negative.  Segments are
processed by descending impact (score at a time) into one accumulator for each
vector.

What a vector can still gain is bounded by the components in which it has not been
met: each gives at most the impact of its next segment, and quantisation hides at
most a level's width.  Processing stops when no more than a share FEW of a block's
vectors can reach the k-th best lower bound, or the k-th best score that the query
has elsewhere; every possible member is then scored exactly.

Blocks stay where they are and queries, the smaller side, go to them in blocks of
their own.  All queries search one block first; their k-th best scores there go with
them to the other blocks.  A task takes its blocks one after the other, indexes each
once, and carries each query's k best scores on; what it emits is merged by score.

Vectors that are null, or hold null, NaN or infinite components, take no part.
Missing components of a shorter vector count as 0.  Null ids take no part.  Rows that
share a vec_id are rows of their own, as candidates and as queries; a query leaves
out itself only.  Ties go to the smaller vec_id; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm._common import gather, settle, table

VECTORS_A_BLOCK = 4096
QUERIES_A_BLOCK = 256
LEVELS = 128
CHECKS = (0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)  # shares of the postings after which a search looks whether it may stop
FEW = 1 / 8  # of a block's vectors, that may be members when it stops


def integers(df: DataFrame, scale: int) -> DataFrame:
    """(row, vec_id, v) with v = floor(scale * x) for each component; row tells rows of one id apart."""
    x = F.col("embedding").cast("array<double>")
    bad = lambda y: y.isNull() | F.isnan(y) | (F.abs(y) == float("inf"))
    ok = df.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & ~F.exists("x", bad))
    v = ok.select("vec_id", F.transform("x", lambda y: F.floor(y * scale).cast("long")).alias("v"))
    # Equal rows are counted, not gathered, and dealt out again.
    copies = v.groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("n")).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return copies.select(F.xxhash64("vec_id", "v", "copy").alias("row"), "vec_id", "v")


class ImpactIndex:
    """The segments of one block of integer vectors, by component and level."""

    def __init__(self, vectors: np.ndarray, levels: int = LEVELS):
        self.vectors = vectors
        n, dims = vectors.shape
        low, high = (vectors.min(0), vectors.max(0)) if n else (np.zeros(dims, np.int64),) * 2
        self.width = np.maximum(1, -(-(high - low + 1) // levels))
        self.low = low
        level = (vectors - low) // self.width
        self.levels = np.ascontiguousarray(level.T.astype(np.int16 if levels < 1 << 15 else np.int64))
        order = np.argsort(level, axis=0, kind="stable").astype(np.int32)
        lev, start, count = [], [], []
        for j in range(dims):
            found, first = np.unique(level[order[:, j], j], return_index=True)
            lev.append(found)
            start.append(first + j * n)
            count.append(len(found))
        none = np.zeros(0, np.int64)
        self.level = np.concatenate([none, *lev]).astype(np.int64)
        self.dim = np.repeat(np.arange(dims), count)
        self.first = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)  # segment of each component
        self.ids = order.T.ravel()
        self.ends = np.concatenate([none, *start, [n * dims]]).astype(np.int64)
        self.size = np.diff(self.ends)
        self.scanned = 0  # postings processed by the last search

    def search(self, q: np.ndarray, k: int, skip: int = -1, bar: float = -np.inf, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Positions and exact scores of the k best vectors but skip, no worse than bar; ties to the smaller of own (positions, if none)."""
        n, dims = self.vectors.shape
        none = np.zeros(0, np.int64)
        self.scanned = 0
        if not n - (skip >= 0):
            return none, none
        floor = q[self.dim] * (self.low[self.dim] + self.level * self.width[self.dim])
        up = q >= 0
        least = floor[np.where(up, self.first[:-1], self.first[1:] - 1)]
        impact = floor - least[self.dim]
        order = np.argsort(-impact, kind="stable")
        hidden = q * (self.width - 1)
        above, below, base = int(np.maximum(hidden, 0).sum()), int(np.minimum(hidden, 0).sum()), int(least.sum())
        cost = np.cumsum(self.size[order])
        many = np.diff(self.first)
        done = np.zeros(dims, np.int64)  # segments of each component that are processed
        got = np.zeros(n)
        possible, at = np.arange(n), 0
        for share in CHECKS:
            cut = int(np.searchsorted(cost, cost[-1] * share)) + 1
            part = order[at:cut]
            at = cut
            ids, size = gather(self.ids, self.ends, part)
            got += np.bincount(ids, np.repeat(impact[part], size), n)
            self.scanned += len(ids)
            done += np.bincount(self.dim[part], minlength=dims)
            lower = got + (base + below)
            if skip >= 0:
                lower[skip] = -np.inf
            if n > k:
                bar = max(bar, np.partition(lower, n - k)[n - k])
            # Of each component: the next segment, the most that a vector not met in it can gain there.
            left = done < many
            following = np.where(up, self.first[1:] - 1 - done, self.first[:-1] + done)[left]
            next_, edge = impact[following], self.level[following].astype(self.levels.dtype)
            rising, falling = (np.flatnonzero(left & x) for x in (~up, up))
            at_, value = np.zeros(dims, np.int64), np.zeros(dims, np.float32)
            at_[left], value[left] = np.arange(len(edge)), next_
            gain = np.zeros(n, np.float32)
            for own_, compare in ((falling, np.less_equal), (rising, np.greater_equal)):
                gain += value[own_] @ compare(self.levels[own_], edge[at_[own_], None]).astype(np.float32)
            gain += np.float32(1e-4) * next_.sum()  # for rounding
            possible = np.flatnonzero(got + (base + above) + gain >= bar)
            if len(possible) <= FEW * n:
                break
        possible = possible[possible != skip]
        exact = self.vectors[possible] @ q
        keep = exact >= bar if np.isfinite(bar) else np.ones(len(exact), bool)
        possible, exact = possible[keep], exact[keep]
        best = np.lexsort((possible if own is None else own[possible], -exact))[:k]
        return possible[best], exact[best]


def pack(df: DataFrame, salt: str, rows: int, total: int) -> DataFrame:
    """Rows of df in blocks of about ``rows``: (block, members)."""
    blocks = max(1, -(-total // rows))
    return df.groupBy(F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(blocks)).alias("block")).agg(F.sort_array(F.collect_list(F.struct("vec_id", "row", "v", "bar"))).alias("members"))


def unpack(members: pa.Scalar) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    rows = members.values
    ids, own = (np.asarray(rows.field(c), np.int64) for c in ("vec_id", "row"))
    bar = np.asarray(pc.fill_null(rows.field("bar"), -(1 << 62)), np.int64).astype(float)
    lists = rows.field("v")
    sizes = np.asarray(pc.list_value_length(lists), np.int64)
    out = np.zeros((len(ids), int(sizes.max(initial=0))), np.int64)
    flat = np.asarray(lists.flatten(), np.int64)
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = flat
    return ids, own, out, bar


def search_blocks(k: int):
    """Rows of a task: of each block its vectors first, then the query blocks that it meets."""

    def run(batches):
        ids = own = vectors = index = block = None
        place: dict[tuple[int, int], int] = {}
        best: dict[int, np.ndarray] = {}  # of each query block, the k best scores of its queries so far
        for batch in batches:
            for i in range(batch.num_rows):
                q_block = batch.column("q_block")[i].as_py()
                if q_block < 0:
                    block = batch.column("block")[i].as_py()
                    ids, own, vectors, _ = unpack(batch.column("members")[i])
                    index = None
                    place = {(a, b): p for p, (a, b) in enumerate(zip(ids.tolist(), own.tolist()))}
                    continue
                if batch.column("block")[i].as_py() != block:  # no vector fell into that block
                    continue
                q_ids, q_own, queries, bar = unpack(batch.column("members")[i])
                dims = max(vectors.shape[1], queries.shape[1])
                queries = np.pad(queries, ((0, 0), (0, dims - queries.shape[1])))
                if index is None or index.vectors.shape[1] < dims:
                    vectors = np.pad(vectors, ((0, 0), (0, dims - vectors.shape[1])))
                    index = ImpactIndex(vectors)
                top = best.setdefault(q_block, np.full((len(q_ids), k), -np.inf))
                rows = []
                for j, q in enumerate(queries):
                    at, score = index.search(q, k, place.get((int(q_ids[j]), int(q_own[j])), -1), max(top[j, 0], bar[j]), ids)
                    top[j] = np.sort(np.concatenate([top[j], score]))[-k:]
                    rows.append((np.full(len(at), q_ids[j]), np.full(len(at), q_own[j]), ids[at], own[at], score))
                if rows:
                    columns = [pa.array(np.concatenate(x), pa.int64()) for x in zip(*rows)]
                    yield pa.RecordBatch.from_arrays(columns, ["query_id", "query_row", "vec_id", "row", "score"])

    return run


FOUND = "query_id long, query_row long, vec_id long, row long, score long"


def met(blocks: DataFrame, asked: DataFrame, n_asked: int, n_blocks: int, first: int, k: int) -> DataFrame:
    """FOUND: what blocks (block, members), numbered from first to n_blocks - 1, hold for the queries asked."""
    packed = pack(asked, "q", QUERIES_A_BLOCK, n_asked).withColumnRenamed("block", "q_block")
    # Each block of vectors meets each block of queries once; what is copied is the queries.
    spread = packed.select(F.explode(F.sequence(F.lit(first).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("block"), "members", "q_block")
    rows = blocks.withColumn("q_block", F.lit(-1).cast("long")).unionByName(spread)
    tasks = max(1, min(n_blocks - first, blocks.sparkSession.sparkContext.defaultParallelism * 4))
    rows = rows.repartition(tasks, "block").sortWithinPartitions("block", "q_block")
    return rows.select("block", "q_block", "members").mapInArrow(search_blocks(k), FOUND)


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id", "query_row").orderBy(F.col("score").desc(), F.col("vec_id"), F.col("row"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of vectors with the highest score for each row of queries."""
    none = F.lit(None).cast("long").alias("bar")
    base, asked = (integers(x, scale).select("row", "vec_id", "v", none) for x in (vectors, queries))
    total, n_asked = base.count(), asked.count()
    n_blocks = max(1, -(-total // VECTORS_A_BLOCK))
    blocks = pack(base, "v", VECTORS_A_BLOCK, total)
    found = met(blocks.where("block = 0"), asked, n_asked, 1, 0, k)
    if n_blocks > 1:
        found = settle(found, "first_block")
        bars = ranked(found, k).where(F.col("rank") == k).select(F.col("query_row").alias("row"), F.col("query_id").alias("vec_id"), F.col("score").alias("known"))
        asked = asked.join(bars, ["row", "vec_id"], "left").select("row", "vec_id", "v", F.col("known").alias("bar"))
        found = found.unionByName(met(blocks.where("block > 0"), asked, n_asked, n_blocks, 1, k))
    return ranked(found, k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.where(F.col("vec_id") % 100 == 0))


SQL = """WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""

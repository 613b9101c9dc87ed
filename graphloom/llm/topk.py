"""Exact top-k inner products by block-at-a-time pruning.

Vectors become integers floor(scale * x). Candidates are cut into document
ranges (blocks of consecutive vec_ids) with a forward index (the block's matrix)
and, per term, the block's largest and smallest value. The summed term maxima
of a block bound its scores for a query. A task takes its blocks in descending
order of that bound, scores whole blocks through their forward indexes, and
stops when the bound falls below the query's k-th best so far (or equals it
with no smaller vec_id in the block). Queries are taken in rounds of at most
``round_queries``, the only thing that is broadcast; each round starts from a
k-th best that a first look at every task's most promising block gives.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm.common import pick
from graphloom.storage import materialize

BLOCK = 1024
#: Queries of a round: at most this many vectors are broadcast at once.
ROUND_QUERIES = 16384
_SAFE = 2.0**52
_BIG = 2.0**62
_INDEX = "dims int, ids binary, matrix binary, wide boolean"


def quantized(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, v) with v the array of floor(scale * x) as doubles; vectors that are null,
    empty or hold a null or non-finite component are left out, as are null vec_ids."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(math.inf)))
    slim = pick(vectors, "vec_id", "embedding").filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0))
    ok = slim.filter(F.coalesce(finite, F.lit(False)))
    # floor of a double through bigint would overflow for huge values: they are whole numbers already
    made = F.transform(x, lambda e: F.when(F.abs(e * scale) < F.lit(_SAFE), F.floor(e * scale).cast("double")).otherwise(e * scale))
    return ok.select(F.col("vec_id").cast("long").alias("vec_id"), made.alias("v"))


def _blocks(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dims, ids, rows, n = None, [], [], 0

        def packed() -> pa.RecordBatch:
            matrix = np.concatenate(rows)
            wide = bool(np.abs(matrix).max(initial=0) >= 2.0**31)
            body = matrix.astype("<f8" if wide else "<i4").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([dims], pa.int32()), pa.array([np.concatenate(ids).tobytes()]), pa.array([body], pa.binary()), pa.array([wide])], ["dims", "ids", "matrix", "wide"])

        for batch in batches:
            lists = batch.column(1)
            offsets = lists.offsets.to_numpy()
            values = lists.values.to_numpy(zero_copy_only=False)
            names = batch.column(0).to_numpy()
            widths = np.diff(offsets)
            at = 0
            while at < len(names):
                if dims is not None and widths[at] != dims and rows:
                    yield packed()
                    ids, rows, n = [], [], 0
                dims = int(widths[at])
                other = np.flatnonzero(widths[at:] != dims)
                end = at + min(size - n, int(other[0]) if len(other) else len(names) - at)
                ids.append(names[at:end])
                rows.append(values[offsets[at] : offsets[end]].reshape(-1, dims))
                n += end - at
                at = end
                if n == size:
                    yield packed()
                    ids, rows, n = [], [], 0
        if rows:
            yield packed()

    return run


def _exact(block: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products; Python integers where doubles or 64 bits would not be exact."""
    most = np.abs(block).max(initial=0) * np.abs(q).max(initial=0) * max(1, len(q))
    if most < _SAFE:
        return (block @ q).astype(np.int64)
    if most < _BIG:
        return block.astype(np.int64) @ q.astype(np.int64)
    whole = [int(x) for x in q]
    low, high = -(1 << 63), (1 << 63) - 1
    return np.array([min(max(sum(int(a) * b for a, b in zip(row, whole)), low), high) for row in block], np.int64)


def _merge(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if len(ids) > 4 * k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        ids, scores = ids[scores >= kth], scores[scores >= kth]
    best = np.lexsort((ids, -scores.astype(np.float64) if np.abs(scores).max(initial=0) < _SAFE else np.argsort(np.argsort(-scores.astype(object), kind="stable"), kind="stable")))[:k] if len(ids) else np.empty(0, np.int64)
    return ids[best], scores[best]


def _searcher(queries, k: int, first_only: bool):
    """queries.value: list of (vec_id, values, smallest score that can still count, or None)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = []
        for batch in batches:
            for dims, ids, body, wide in zip(*(batch.column(i).to_pylist() for i in range(4))):
                matrix = np.frombuffer(body, "<f8" if wide else "<i4").reshape(-1, dims)
                names = np.frombuffer(ids, np.int64)
                blocks.append((names, matrix, names.min()))
        out_q, out_i, out_s = [], [], []
        for dims in sorted({b[1].shape[1] for b in blocks}):
            own = [b for b in blocks if b[1].shape[1] == dims]
            high = np.stack([b[1].max(axis=0) for b in own]).astype(np.float64)
            low = np.stack([b[1].min(axis=0) for b in own]).astype(np.float64)
            for name, values, floor in queries.value:
                if len(values) != dims:
                    continue
                q = np.asarray(values)
                bounds = high @ np.maximum(q, 0) + low @ np.minimum(q, 0)
                if np.abs(bounds).max() >= _SAFE:  # rounded sums: a bound may be too high, never too low
                    bounds += np.abs(bounds) * 1e-9
                ids, scores = np.empty(0, np.int64), np.empty(0, np.int64)
                for b in np.argsort(-bounds, kind="stable")[: 1 if first_only else None].tolist():
                    names, matrix, smallest = own[b]
                    if floor is not None and bounds[b] < floor:
                        break
                    if len(ids) == k:
                        if bounds[b] < scores[-1]:
                            break
                        if bounds[b] == scores[-1] and smallest > ids[-1]:
                            continue
                    made = _exact(matrix.astype(np.float64), q)
                    keep = names != name
                    ids, scores = _merge(np.concatenate((ids, names[keep])), np.concatenate((scores, made[keep])), k)
                out_q.append(np.full(len(ids), name, np.int64))
                out_i.append(ids)
                out_s.append(scores)
        if out_q:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_q, out_i, out_s)], ["query_id", "vec_id", "score"])

    return run


def build_index(vectors: DataFrame, *, scale: int = 1024, block: int = BLOCK) -> DataFrame:
    """The blocks of every usable vector, in ranges of vec_id."""
    usable = quantized(vectors, scale).withColumn("dims", F.size("v"))
    ranged = usable.repartitionByRange("dims", "vec_id").sortWithinPartitions("dims", "vec_id").select("vec_id", "v")
    return materialize(ranged.mapInArrow(_blocks(block), _INDEX), "topk-index")


def top_k(index: DataFrame, queries: DataFrame, *, k: int = 10, round_queries: int = ROUND_QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k highest inner products,
    ties to the smaller vec_id; candidates with the query's own vec_id take no part.

    ``queries`` is a result of ``quantized``. A query scores only candidates of
    its own length; with fewer than k candidates it gets all. Repeated query ids
    are answered once, for the smallest vector; repeated candidates each count.
    Scores beyond 64 bits are cut to the nearest long. An empty index or no
    query gives an empty result.
    """
    spark = index.sparkSession
    once = materialize(queries.groupBy("vec_id").agg(F.min("v").alias("v")), "topk-queries")
    n = once.count()
    rounds = max(1, -(-n // round_queries))
    found = None
    for i in range(rounds):
        own = once if rounds == 1 else once.filter(F.pmod(F.xxhash64("vec_id"), F.lit(2 * rounds)).between(2 * i, 2 * i + 1))
        asked = [(r.vec_id, r.v, None) for r in own.toLocalIterator()]
        if not asked:
            continue
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))

        def local(first_only: bool, asked=asked) -> DataFrame:
            search = _searcher(spark.sparkContext.broadcast(asked), k, first_only)
            hits = index.mapInArrow(search, "query_id long, vec_id long, score long")
            return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

        kth = {r.query_id: r.score for r in local(True).filter(F.col("rank") == k).select("query_id", "score").toLocalIterator()}
        asked = [(name, v, kth.get(name)) for name, v, _ in asked]
        part = materialize(local(False, asked).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "topk")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return found


def search(vectors: DataFrame, *, every: int = 100, k: int = 10, scale: int = 1024) -> DataFrame:
    """``top_k`` of the rows whose vec_id is divisible by ``every``, against all rows."""
    return top_k(build_index(vectors, scale=scale), quantized(vectors, scale).filter(F.col("vec_id") % every == 0), k=k)

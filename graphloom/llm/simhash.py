"""SimHash near-duplicates: exact linking of 64-bit fingerprints through vantage-point trees.

Equal fingerprints are collapsed before any search. A routing tree of vantage
points, built on a bounded sample of fingerprints, cuts the space into shards;
every distinct fingerprint has one home shard. By the triangle bound it can
link only into shards whose region its ball of ``radius`` overlaps, so it also
visits those (of each two shards only the one with the smaller number). Inside
a shard a further vantage point orders the home fingerprints, and a visitor is
compared only with those whose distance to it differs by at most ``radius``.
A shard reports one link per visitor and local cluster, not all pairs.
Components come from contraction of these links. The sample decides how well
the work is spread, never which links are found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import apart, pick, small_batches
from graphloom.operators.components import connected_components
from graphloom.storage import materialize

#: Fingerprints sampled for the routing tree (its size is bounded by this).
TREE_SAMPLE = 65536
#: Distinct fingerprints that a shard is planned for.
SHARD = 2048
_PACK = 1 << 18
_CELLS = 1 << 21


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    import xxhash

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(parts) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        view, digest = memoryview(joined), xxhash.xxh64_intdigest
        hashes = [digest(view[a:b], seed) for a, b in zip(starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist())]
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(bits), 255):
        ones += bits[i : i + 255].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.fromiter((fingerprint(t.as_py(), shingle, seed) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], ["doc_id", "fp"])

    return run


def build_tree(sample: np.ndarray, leaves: int) -> list[tuple]:
    """Nodes (pivot, limit, inner, outer) or (shard,); inner holds distances up to the limit."""
    nodes: list[tuple] = []
    shards = 0

    def grow(own: np.ndarray, want: int) -> int:
        nonlocal shards
        at = len(nodes)
        nodes.append(())
        if want > 1 and len(own) > 1:
            for pivot in own[:: max(1, len(own) // 4)][:4]:
                far = np.bitwise_count(own ^ pivot).astype(np.int64)
                limit = int(np.median(far))
                limit -= int((far > limit).sum() == 0)
                inner = far <= limit
                if 0 < inner.sum() < len(own):
                    left = max(1, round(want * inner.mean()))
                    nodes[at] = (int(pivot), limit, grow(own[inner], min(left, want - 1)), grow(own[~inner], max(1, want - left)))
                    return at
        nodes[at] = (shards,)
        shards += 1
        return at

    grow(sample, leaves)
    return nodes


def _walk(nodes: list[tuple], fps: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, whether at home, fingerprints) of the shards that the fingerprints reach."""
    home = np.empty(len(fps), np.int64)
    todo = [(0, np.arange(len(fps)))]
    while todo:
        at, own = todo.pop()
        if len(nodes[at]) == 1:
            home[own] = nodes[at][0]
            continue
        pivot, limit, inner, outer = nodes[at]
        near = np.bitwise_count(fps[own] ^ np.uint64(pivot)) <= limit
        todo += [(inner, own[near]), (outer, own[~near])]
    todo = [(0, np.arange(len(fps)))]
    while todo:
        at, own = todo.pop()
        if not len(own):
            continue
        if len(nodes[at]) == 1:
            here = home[own] == nodes[at][0]
            yield nodes[at][0], True, fps[own[here]]
            yield nodes[at][0], False, fps[own[home[own] > nodes[at][0]]]
            continue
        pivot, limit, inner, outer = nodes[at]
        far = np.bitwise_count(fps[own] ^ np.uint64(pivot)).astype(np.int64)
        todo += [(inner, own[far <= limit + radius]), (outer, own[far > limit - radius])]


def _router(nodes, radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def packed() -> Iterator[pa.RecordBatch]:
            rows = [(s, not at_home, x.tobytes()) for s, at_home, x in _walk(nodes.value, np.concatenate(held), radius) if len(x)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.bool_(), pa.binary()))], ["shard", "visits", "fps"])

        for batch in batches:
            held.append(batch.column(0).to_numpy().view(np.uint64))
            if sum(map(len, held)) >= _PACK:
                yield from packed()
                held = []
        if held:
            yield from packed()

    return run


def _near(a: np.ndarray, b: np.ndarray, far_a: np.ndarray, far_b: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (into a, into b) at most ``radius`` apart; b is sorted by far_b."""
    order = np.argsort(far_a, kind="stable")
    cuts = np.searchsorted(far_a[order], np.arange(66))
    for d in range(65):
        own = order[cuts[d] : cuts[d + 1]]
        lo, hi = np.searchsorted(far_b, (d - radius, d + radius + 1))
        if not len(own) or lo == hi:
            continue
        step = max(1, _CELLS // int(hi - lo))
        for i in range(0, len(own), step):
            part = own[i : i + step]
            x, y = np.nonzero(np.bitwise_count(a[part][:, None] ^ b[None, lo:hi]) <= radius)
            if len(x):
                yield part[x], y + lo


def _joined(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Labels after uniting x[i] with y[i]; a label is the smallest index of its cluster."""
    while True:
        a, b = label[x], label[y]
        apart = a != b
        if not apart.any():
            return label
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def _linker(radius: int):
    def links(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, homes, home, far, label = None, [], None, None, None
        pivot = np.uint64(0)

        def settle() -> Iterator[pa.RecordBatch]:
            nonlocal home, far, label, pivot
            home = np.concatenate(homes) if homes else np.empty(0, np.uint64)
            pivot = home[0] if len(home) else np.uint64(0)
            far = np.bitwise_count(home ^ pivot).astype(np.int64)
            order = np.argsort(far, kind="stable")
            home, far, label = home[order], far[order], np.arange(len(home))
            for x, y in _near(home, home, far, far, radius):
                label = _joined(label, x, y)
            low = np.flatnonzero(label != np.arange(len(home)))
            if len(low):
                yield links(home[low], home[label[low]])

        for batch in batches:
            for s, visits, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                own = np.frombuffer(raw.as_py(), np.uint64)
                if s != shard:
                    if shard is not None and label is None:
                        yield from settle()
                    shard, homes, label = s, [], None
                if not visits:
                    homes.append(own)
                    continue
                if label is None:
                    yield from settle()
                if len(home):
                    for x, y in _near(own, home, np.bitwise_count(own ^ pivot).astype(np.int64), far, radius):
                        pairs = np.unique(np.stack([x, label[y]], 1), axis=0)
                        yield links(own[pairs[:, 0]], home[pairs[:, 1]])
        if shard is not None and label is None:
            yield from settle()

    return run


def fingerprints(docs: DataFrame, *, shingle: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp as a signed long) of every row; null or empty text has fingerprint 0."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return pick(docs, "doc_id", "text").mapInArrow(_fingerprints(shingle, seed), f"doc_id {kind}, fp long")


def linked(nodes: DataFrame, radius: int, shard: int = SHARD) -> DataFrame:
    """Links (u, v) between distinct fingerprints that suffice for the components of all links."""
    spark = nodes.sparkSession
    n = nodes.count()
    # the share of hashes that gives a sample of this size, so that no task sends more than its part of it
    share = F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) / float(1 << 30) < min(1.0, TREE_SAMPLE / max(n, 1))
    found = nodes.filter(share).select("fp").toArrow()["fp"].to_numpy().astype(np.int64)
    sample = np.random.default_rng(5).permutation(np.sort(found)).view(np.uint64)
    leaves = max(1, min(-(-n // shard), len(sample) // 8 or 1))
    tree = spark.sparkContext.broadcast(build_tree(sample, leaves))
    routed = nodes.select("fp").mapInArrow(_router(tree, radius), "shard int, visits boolean, fps binary")
    dealt = routed.repartition("shard").sortWithinPartitions("shard", "visits")
    return dealt.mapInArrow(_linker(radius), "u long, v long")


def simhash_components(docs: DataFrame, *, shingle: int = 4, seed: int = 42, radius: int = 4) -> DataFrame:
    """One row per input row: doc_id, fp (signed long), component_id (the smallest doc_id
    reachable over links of at most ``radius`` differing bits, the own one included).

    Null and empty texts have fingerprint 0 and link like any other. Null
    doc_ids never become a component_id unless a component holds no other;
    repeated rows each give a row. An empty table gives an empty result; other
    columns are ignored.
    """
    fps = materialize(fingerprints(docs, shingle=shingle, seed=seed), "simhash")
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    groups = connected_components(materialize(linked(nodes, radius), "simhash-links"))
    labelled = nodes.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    labelled = materialize(labelled, "simhash-labels")
    owner = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    owners = materialize(labelled.join(owner, "component").select("fp", "component_id"), "simhash-owners")
    return fps.join(owners, "fp").select("doc_id", "fp", "component_id")


def one_per_component(docs: DataFrame, **options) -> DataFrame:
    """One row of each component: the one with the smallest doc_id, and of several texts under it the one of the
    smallest hash; rows that repeat both keep one.

    A document with a null doc_id stays only if its component holds no other.
    """
    # null ids come last; the least key of a component is the row that stays
    rows = apart(docs, "doc_id", "text")
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"))
    rows = rows.withColumn("key", key)
    found = simhash_components(rows.select(F.col("key").alias("doc_id"), "text"), **options)
    keep = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("keep")).distinct()
    same = (F.col("key.h") == F.col("keep.h")) & F.col("key.id").eqNullSafe(F.col("keep.id"))
    joined = rows.join(keep, same, "left_semi")
    if rows.groupBy("key").count().filter("count > 1").limit(1).count() > 0:
        joined = joined.dropDuplicates(["key"])
    own = {"doc_id": F.col("doc_id"), "text": F.col("text")}
    return joined.select(*[own.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])

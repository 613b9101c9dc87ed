"""Edges among the members of many queries, by buckets of queries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from graphloom.storage import materialize

#: Queries of a bucket at most, and the buckets that queries spread over at least.
QUERIES, SPREAD = 256, 32
#: Nodes of most buckets, at most, that every task knows.
HOT = 1 << 17
#: Pairs of an edge and a query that are looked up at once.
PAIRS = 1 << 20


def _flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """(row, item) of every item of a column of lists."""
    column = lists.combine_chunks()
    return pc.list_parent_indices(column).to_numpy(zero_copy_only=False), pc.list_flatten(column)


def _packed(items: Column) -> Column:
    """A list of texts as one text and their sizes in bytes (null: none), which is shorter when sent."""
    return F.struct(F.array_join(F.filter(items, lambda x: x.isNotNull()), "").alias("text"), F.transform(items, lambda x: F.octet_length(x)).alias("sizes"))


def _items(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """(row, item) of every item of a column of lists, ``_packed`` or not."""
    if not pa.types.is_struct(column.type):
        return _flat(column)
    row, sizes = _flat(pa.chunked_array([pc.struct_field(c, "sizes") for c in column.chunks]))
    data = b"".join(x.encode() for c in column.chunks for x in pc.struct_field(c, "text").to_pylist() if x)
    offsets = np.concatenate([[0], np.cumsum(sizes.fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)])
    items = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(data))
    return row, pc.if_else(pc.is_valid(sizes), items, pa.scalar(None, pa.large_string()))


def _inside(keep: tuple[str, ...], kind: pa.Schema):
    """Rows (bucket, node, queries, others, turned, *keep_) of a bucket to (query_id, u, v, *keep); the last ones are lists, with an item for each edge the node holds."""

    def run(table: pa.Table) -> pa.Table:
        nodes = table.column("node").combine_chunks()
        holder, others = _items(table.column("others"))
        node, asked = _flat(table.column("queries"))
        coded = pc.dictionary_encode(asked)
        query, n = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(nodes)
        held = np.unique(query * n + node)  # a member that is named twice is one
        queries, begins = held // n, np.zeros(n + 1, np.int64)
        by_node = np.argsort(held % n, kind="stable")
        np.cumsum(np.bincount(held % n, minlength=n), out=begins[1:])
        found = pc.index_in(others, value_set=nodes.cast(others.type))
        known = np.flatnonzero(pc.is_valid(found).to_numpy(zero_copy_only=False))
        a, b = holder[known], found.take(pa.array(known)).to_numpy(zero_copy_only=False).astype(np.int64)
        turned = _items(table.column("turned"))[1].take(pa.array(known)).to_numpy(zero_copy_only=False)
        count = begins[a + 1] - begins[a]
        total = np.concatenate([[0], np.cumsum(count)])
        rows, whose = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        at = 0
        while at < len(a):
            to = max(at + 1, int(np.searchsorted(total, total[at] + PAIRS, "right")) - 1)
            row = np.repeat(np.arange(at, to), count[at:to])
            q = queries[by_node[begins[a[row]] + np.arange(len(row)) - (total[row] - total[at])]]
            key = q * n + b[row]
            place = np.minimum(np.searchsorted(held, key), len(held) - 1)
            own = held[place] == key
            rows.append(row[own])
            whose.append(q[own])
            at = to
        row, q = np.concatenate(rows), np.concatenate(whose)
        flip, first, second = turned[row].astype(bool), a[row], b[row]
        edge = pa.array(known[row])
        columns = [coded.dictionary.take(pa.array(q)), nodes.take(pa.array(np.where(flip, second, first))), nodes.take(pa.array(np.where(flip, first, second)))]
        columns += [_items(table.column(f"{name}_"))[1].take(edge) for name in keep]
        return pa.table([c.cast(f.type) for c, f in zip(columns, kind)], schema=kind)

    return run


def _hot(counts: DataFrame, most: int) -> DataFrame:
    """(node, n) of the nodes of most buckets, at most ``most`` of them."""
    least = None
    left = most
    for r in counts.groupBy("n").count().orderBy(F.desc("n")).toLocalIterator():
        left -= r["count"]
        if left < 0:
            break
        least = r["n"]
    return counts.filter(F.lit(False) if least is None else F.col("n") >= least)


def induced_edges(edges: DataFrame, members: DataFrame, keep: tuple[str, ...] = ("type", "weight")) -> DataFrame:
    """(query_id, u, v, *keep): edges with both ends among a query's members (query_id, node).

    Queries go to buckets of neighbouring ids, at most ``QUERIES`` each. A node
    goes to a bucket once, with its queries there and the edges it holds, and the
    bucket's task looks up which queries have the other ends too. So a
    node that many queries share is sent by bucket, not by query. Each edge is held by one
    end: by the one in fewer buckets where a ``HOT`` node is among the two, so no
    hub holds its edges, else by either, as both are in few.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    of = {f.name: f.dataType for f in edges.schema}
    own = members.select("query_id", "node").filter("query_id is not null and node is not null")
    asked = own.select("query_id").distinct().repartitionByRange("query_id").sortWithinPartitions("query_id")
    asked = materialize(asked.withColumn("place", F.monotonically_increasing_id()), "induced-queries")
    size = min(QUERIES, max(1, -(-asked.count() // SPREAD)))
    placed = own.join(asked.select("query_id", F.floor(F.col("place") / size).alias("bucket")), "query_id").repartition("bucket")
    held = materialize(placed.groupBy("bucket", "node").agg(F.collect_list("query_id").alias("queries")), "induced-members")
    counts = materialize(held.groupBy("node").agg(F.count(F.lit(1)).alias("n")), "induced-counts")
    hot = _hot(counts, HOT)
    n_of = lambda end: F.broadcast(hot.select(F.col("node").alias(end), F.col("n").alias(f"n_{end}")))
    known = edges.select("u", "v", *keep).filter("u is not null and v is not null").join(n_of("u"), "u", "left").join(n_of("v"), "v", "left")
    n_u, n_v = (F.coalesce(f"n_{end}", F.lit(0)) for end in "uv")
    turned = F.when(n_u == n_v, F.pmod(F.xxhash64("u", "v"), F.lit(2)) == 1).otherwise(n_u > n_v)
    end = F.struct(*keep, "turned", F.when(F.col("turned"), F.col("u")).otherwise(F.col("v")).alias("other"))
    sides = known.withColumn("turned", turned).select(F.when(F.col("turned"), F.col("v")).otherwise(F.col("u")).alias("node"), end.alias("end"))
    # sorted lists, one for each column, take less room when they are sent
    lists = sides.groupBy("node").agg(F.sort_array(F.collect_list("end")).alias("ends"))
    short = lambda name: _packed(F.col(f"ends.{name}")) if isinstance(of[name], StringType) else F.col(f"ends.{name}")
    lists = lists.select("node", _packed(F.col("ends.other")).alias("others"), F.col("ends.turned").alias("turned"), *[short(name).alias(f"{name}_") for name in keep])
    sent = held.join(lists, "node", "left").select("bucket", "node", "queries", "others", "turned", *[f"{name}_" for name in keep])
    shape = own.select("query_id").schema.add("u", of["u"]).add("v", of["v"])
    for name in keep:
        shape = shape.add(name, of[name])
    return sent.groupBy("bucket").applyInArrow(_inside(keep, to_arrow_schema(shape)), shape)

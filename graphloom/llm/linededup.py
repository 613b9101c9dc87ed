"""Line dedup: range-partitioned line hashes, streamed in order, answered by keep bitmaps.

Every line of at least ``min_chars`` code points becomes (128-bit key hash,
doc_id, text hash, position). These rows are range-partitioned by hash, then
by descending doc_id and position, so one very common line spreads over many
tasks. Each task streams its groups and remembers one row and one count: the
first document of a group (its largest doc_id) keeps its lines, the lines of
the others are given out as soon as ``min_docs`` documents have been seen (until
then the lines of fewer than ``min_docs`` documents wait). Only the first and
last hash of a task can continue elsewhere. Lines of the first one are given
out as undecided; each task adds one row with what it saw of these two hashes,
and the combined rows, at most two per task, are broadcast to decide them.
Texts never enter that sort; each document that loses lines gets a
zlib-compressed bitmap of those it keeps, made where its positions meet.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from graphloom.llm.common import WHITESPACE, apart, pick, small_batches
from graphloom.storage import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What a task gives out: a line to drop, a line that other tasks decide, or what it saw of a hash that may go on elsewhere.
_LOST, _OPEN, _SEEN = 0, 1, 2


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(WHITESPACE)), UPPER, LOWER)


def _changes(values: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before; nulls are equal."""
    a, b = values[1:], values[:-1]
    differ = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
    if values.null_count:
        differ |= a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False)
    return differ


_COLUMNS = ["h1", "h2", "doc_id", "text_hash", "pos", "n_lines"]


class _Streamer:
    """One task's pass over its sorted rows (``_COLUMNS``)."""

    def __init__(self, min_docs: int):
        self.min_docs = min_docs
        self.before: pa.RecordBatch | None = None  # the row before
        self.first = True  # still in the first group of the task
        self.docs = 0  # documents seen of the running group
        self.top: pa.Array | None = None  # its first document
        self.waiting: list[pa.RecordBatch] = []

    def out(self, rows: pa.RecordBatch, kind: int, docs: int = 0) -> pa.RecordBatch:
        n = rows.num_rows
        extra = [pa.array(np.full(n, kind, np.int32)), pa.array(np.full(n, docs, np.int64)), pa.array(np.full(n, TaskContext.get().partitionId(), np.int32))]
        last = self.before.column(2).slice(0, 1) if kind == _SEEN else pa.nulls(n, rows.schema.field("doc_id").type)
        return pa.RecordBatch.from_arrays([*rows.columns, *extra, last], [*_COLUMNS, "kind", "docs", "task", "last_doc"])

    def seen(self) -> pa.RecordBatch:
        """The running group's hash, first and last document and their number."""
        row = self.before
        cols = [row.column(0), row.column(1), self.top, *(row.column(i) for i in range(3, 6))]
        return self.out(pa.RecordBatch.from_arrays(cols, _COLUMNS), _SEEN, self.docs)

    def take(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lead = self.before is not None
        rows = pa.Table.from_batches([self.before, batch]).combine_chunks().to_batches()[0] if lead else batch
        h1, h2, text, pos = (rows.column(i).to_numpy() for i in (0, 1, 3, 4))
        new_key = np.concatenate(([not lead], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])))
        new_doc = np.concatenate(([not lead], _changes(rows.column(2)))) | new_key
        again = np.concatenate(([False], (text[1:] == text[:-1]) & (pos[1:] == pos[:-1]))) & ~new_doc
        count = np.cumsum(new_doc)
        starts = np.flatnonzero(new_key)
        group = np.cumsum(new_key) - (0 if lead else 1)  # with a row before, 0 is the running group
        base = np.concatenate(([-self.docs] if lead else [], count[starts] - 1)).astype(np.int64)
        nth = count - base[group]  # of the document in its group, from 1
        ends = np.concatenate((starts[1:] if not lead else starts, [len(h1)]))
        size = nth[ends - 1]  # documents of each group, as far as seen
        fresh = ~again
        if lead:
            fresh[0] = False
        loose = np.zeros(len(h1), bool)
        if self.first:
            loose = fresh & (group == 0)
        common = size[group] >= self.min_docs
        lost = fresh & ~loose & (nth > 1) & common
        running = len(size) - 1
        held = fresh & ~loose & (nth > 1) & ~common & (group == running)
        if loose.any():
            yield self.out(rows.filter(pa.array(loose)), _OPEN)
        if self.waiting and lead and size[0] >= self.min_docs:
            yield from (self.out(x, _LOST) for x in self.waiting)
        if lost.any():
            yield self.out(rows.filter(pa.array(lost)), _LOST)
        if not lead:
            self.top = rows.column(2).slice(0, 1)
        if self.first and running > 0:  # the first group of the task is over
            end = int(ends[0])
            self.before, self.docs = rows.slice(end - 1, 1), int(size[0])
            yield self.seen()
            self.first = False
        if running > 0:
            self.top = rows.column(2).slice(int(starts[-1]), 1)
        if running > 0 or size[running] >= self.min_docs:
            self.waiting = []
        if held.any():
            self.waiting.append(rows.filter(pa.array(held)))
        self.docs = int(size[running])
        self.before = rows.slice(len(h1) - 1, 1)

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.before is not None:
            yield from (self.out(x, _OPEN) for x in self.waiting)
            yield self.seen()


def _stream(min_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _Streamer(min_docs)
        for batch in batches:
            if batch.num_rows:
                yield from state.take(batch)
        yield from state.end()

    return run


def _bitmap(n_lines: int, lost: np.ndarray) -> bytes:
    keep = np.ones(n_lines, np.uint8)
    keep[lost] = 0
    return zlib.compress(np.packbits(keep, bitorder="little").tobytes())


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (doc_id, text_hash, pos, n_lines), sorted, a bitmap for each document; holds one batch and one document."""
    rest: pa.RecordBatch | None = None

    def made(rows: pa.RecordBatch, starts: np.ndarray, end: int) -> pa.RecordBatch:
        pos, n_lines = rows.column(2).to_numpy(), rows.column(3).to_numpy()
        lost = [np.unique(pos[a:b]) for a, b in zip(starts.tolist(), [*starts[1:].tolist(), end])]
        at = pa.array(starts)
        cols = [rows.column(0).take(at), rows.column(1).take(at), pa.array(list(map(len, lost)), pa.int64())]
        return pa.RecordBatch.from_arrays([*cols, pa.array([_bitmap(int(n), x) for n, x in zip(n_lines[starts], lost)], pa.binary())], ["doc_id", "text_hash", "n_dropped", "keep_bitmap"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0] if rest is not None else batch
        text = rows.column(1).to_numpy()
        starts = np.flatnonzero(np.concatenate(([True], _changes(rows.column(0)) | (text[1:] != text[:-1]))))
        if len(starts) > 1:
            yield made(rows, starts[:-1], int(starts[-1]))
        rest = rows.slice(int(starts[-1]))
    if rest is not None:
        yield made(rest, np.zeros(1, np.int64), rest.num_rows)


@F.arrow_udf(T.StringType())
def _kept_text(text: pa.Array, bitmap: pa.Array) -> pa.Array:
    def one(t, b):
        if t is None or b is None:
            return None
        lines = t.split("\n")
        keep = np.unpackbits(np.frombuffer(zlib.decompress(b), np.uint8), count=len(lines), bitorder="little")
        return "\n".join([x for x, k in zip(lines, keep.tolist()) if k])

    return pa.array([one(t.as_py(), b.as_py()) for t, b in zip(text, bitmap)], pa.string())


def keep_bitmaps(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """(doc_id, text_hash, n_dropped, keep_bitmap) of the documents that lose lines."""
    slim = pick(docs, "doc_id", "text").withColumn("text_hash", F.xxhash64("text")).withColumn("lines", lines_of(F.col("text")))
    lines = slim.select("doc_id", "text_hash", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("pos", "line"))
    lines = lines.withColumn("key", line_key(F.col("line"))).filter(F.char_length("key") >= min_chars)
    hashed = materialize(lines.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), *_COLUMNS[2:]), "lines")
    order = [F.asc("h1"), F.asc("h2"), F.desc_nulls_last("doc_id"), F.asc("text_hash"), F.asc("pos")]
    ranged = hashed.repartitionByRange(*order).sortWithinPartitions(*order)
    kind = hashed.schema["doc_id"].dataType
    schema = T.StructType([*hashed.schema.fields, T.StructField("kind", T.IntegerType()), T.StructField("docs", T.LongType()), T.StructField("task", T.IntegerType()), T.StructField("last_doc", kind)])
    marks = materialize(ranged.mapInArrow(_stream(min_docs), schema), "line-marks")

    # tasks follow each other in the order of the rows; a document that two of them share counts once
    tasks = Window.partitionBy("h1", "h2").orderBy("task")
    shared = (F.lag("task").over(tasks).isNotNull() & F.lag("last_doc").over(tasks).eqNullSafe(F.col("doc_id"))).cast("long")
    seen = marks.filter(F.col("kind") == _SEEN).select("h1", "h2", "doc_id", (F.col("docs") - shared).alias("docs"))
    common = seen.groupBy("h1", "h2").agg(F.sum("docs").alias("docs"), F.max("doc_id").alias("last")).filter(F.col("docs") >= min_docs)
    names = ["doc_id", "text_hash", "pos", "n_lines"]
    open_ = marks.filter(F.col("kind") == _OPEN).join(F.broadcast(common.select("h1", "h2", "last")), ["h1", "h2"]).filter(~F.col("doc_id").eqNullSafe(F.col("last")))
    lost = marks.filter(F.col("kind") == _LOST).select(*names).unionByName(open_.select(*names))
    dealt = lost.repartition("doc_id", "text_hash").sortWithinPartitions("doc_id", "text_hash", "pos")
    return dealt.mapInArrow(_bitmaps, T.StructType([hashed.schema["doc_id"], T.StructField("text_hash", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("keep_bitmap", T.BinaryType())]))


def _joined(left: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Left join by doc_id and text_hash of the rows and bitmaps; adds n_dropped and keep_bitmap."""
    right = bitmaps.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), F.col("n_dropped").alias("lost"), "keep_bitmap")
    both = left.join(right, left["doc_id"].eqNullSafe(right["d"]) & (left["text_hash"] == right["h"]), "left")
    return both.select(*left.columns, F.coalesce("lost", F.lit(0)).cast("long").alias("n_dropped"), "keep_bitmap")


def line_dedup(docs: DataFrame, *, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """One row per input row: doc_id, text_hash, n_lines, n_dropped and keep_bitmap
    (zlib over little-endian bits, one per line; null if the document keeps every line).

    Null or empty text is one empty line, kept. doc_id may be of any type that
    can be ordered; a null one ranks below every other. Repeated rows get the
    same bitmap; rows that share a doc_id count as one document, each with a
    bitmap of its own. An empty table gives an empty result; other columns are
    ignored.
    """
    slim = pick(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("text_hash"), F.size(lines_of(F.col("text"))).cast("long").alias("n_lines"))
    return _joined(slim, keep_bitmaps(docs, min_chars, min_docs))


def deduped_documents(docs: DataFrame, *, min_chars: int = 40, min_docs: int = 5, counts: bool = False) -> DataFrame:
    """``docs`` with the kept text of each row (and its new n_chars, if there is such a column); see ``line_dedup``.

    With ``counts``, n_lines and n_dropped are added; a ValueError tells that
    ``docs`` has such columns. Other columns pass through, whatever their names.
    Only bitmaps of documents that lose lines travel to the texts; texts that
    keep every line never reach Python.
    """
    if counts and {"n_lines", "n_dropped"} & {c.lower() for c in docs.columns}:
        raise ValueError("the documents have a column n_lines or n_dropped")
    small_batches(docs.sparkSession)
    rows = apart(docs, "doc_id", "text").withColumn("text_hash", F.xxhash64("text"))
    both = _joined(rows, keep_bitmaps(docs, min_chars, min_docs))
    hit = F.col("keep_bitmap").isNotNull()
    kept = F.when(hit, _kept_text(F.when(hit, F.col("text")), "keep_bitmap")).otherwise(F.col("text"))
    both = both.withColumn("kept", kept)
    new = {"doc_id": F.col("doc_id"), "text": F.col("kept")}
    if "n_chars" in docs.columns:
        old = F.col("row").getField("n_chars")
        new["n_chars"] = F.when(hit, F.char_length("kept")).otherwise(old).cast(docs.schema["n_chars"].dataType)
    columns = [new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns]
    added = [F.size(lines_of(F.col("text"))).cast("long").alias("n_lines"), "n_dropped"] if counts else []
    return both.select(*columns, *added)

import random
import zlib
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest

from graphloom.llm import linededup
from tests.llm.data import SCHEMA, frame, rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(data, min_chars=40, min_docs=5):
    holders = defaultdict(set)
    split = [(r[0], (r[1] or "").split("\n")) for r in data]
    key = lambda x: x.strip("\x20\x09\x0a\x0b\x0c\x0d").translate(LOWER)
    for d, lines in split:
        for x in lines:
            if len(key(x)) >= min_chars:
                holders[key(x)].add(d)
    last = {k: max(v, key=lambda d: (d is not None, d or 0)) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for d, lines in split:
        keep = [x for x in lines if key(x) not in last or last[key(x)] == d]
        out.append((str(d), len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out)


def test_line_dedup(spark):
    docs = frame(spark)
    got = linededup.deduped_documents(docs, counts=True)
    assert got.columns == [*docs.columns, "n_lines", "n_dropped"]
    found = got.collect()
    assert sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.text or "") for r in found) == brute(rows())
    assert any(r.n_dropped for r in found) and all(r.n_chars == len(r.text) for r in found if r.n_dropped)
    assert linededup.deduped_documents(docs).columns == docs.columns


def test_bitmaps(spark):
    marks = linededup.line_dedup(frame(spark)).collect()
    want = brute(rows())
    assert sorted((str(r.doc_id), r.n_lines, r.n_dropped) for r in marks) == sorted(w[:3] for w in want)
    for r in marks:
        if r.keep_bitmap is not None:
            assert np.unpackbits(np.frombuffer(zlib.decompress(r.keep_bitmap), np.uint8), bitorder="little")[: r.n_lines].sum() == r.n_lines - r.n_dropped


def test_one_line_over_many_tasks(spark):
    line = "this very common line is in more than half of the documents"
    data = [(i, f"{line}\nown {i}" if i % 2 else f"own {i}", None, None, None, *[None] * 6) for i in range(400)]
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        got = linededup.deduped_documents(frame(spark, data)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {r.doc_id for r in got if line in r.text} == {399}
    assert sha256(sorted(r.text for r in got)[0].encode())


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert linededup.deduped_documents(docs).count() == linededup.line_dedup(docs).count() == 0


def test_random_groups_over_task_borders(spark):
    """Few keys, many documents, repeated rows, nulls: groups of every size around the limit begin and end anywhere."""
    rng = random.Random(4)
    line = lambda k: f"line number {k} of a small stock of lines that are shared"
    data = [(rng.choice([None, rng.randint(0, 60), rng.randint(0, 60)]), "\n".join(line(rng.randint(0, 25)) for _ in range(rng.randint(0, 6)))) for _ in range(220)]
    data += data[:30]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    for n in ("3", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            got = linededup.deduped_documents(docs, counts=True).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.text) for r in got) == brute(data)


def test_state_of_one_hot_line_stays_small(monkeypatch):
    """A line of many documents in one task is given out batch by batch; only the lines of fewer than min_docs documents wait."""
    monkeypatch.setattr(linededup, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": staticmethod(lambda: 0)}))}))
    stream = linededup._Streamer(5)

    def batch(key, docs):
        n = len(docs)
        return pa.RecordBatch.from_arrays([pa.array([key] * n), pa.array([0] * n), pa.array(docs), pa.array([1] * n), pa.array([0] * n, pa.int32()), pa.array([1] * n, pa.int32())], linededup._COLUMNS)

    out = list(stream.take(batch(1, [3, 2])))
    for i in range(50):
        out += stream.take(batch(2, list(range(10_000 - 100 * i, 9_900 - 100 * i, -1))))
        assert sum(x.num_rows for x in stream.waiting) < 5
    out += stream.end()
    kinds = pa.Table.from_batches(out).group_by("kind").aggregate([("pos", "count")]).to_pydict()
    assert dict(zip(kinds["kind"], kinds["pos_count"])) == {linededup._OPEN: 2, linededup._LOST: 4999, linededup._SEEN: 2}


def test_ids_of_text_and_clashing_names(spark):
    names = ["dropped", "d", "h", "_d", "_h", "row", "kept", "text_hash", "n_lines", "keep_bitmap", "_text_hash", "lost", "pos", "key"]
    data = [(str(r[0]) if r[0] is not None else None, r[1], *["x"] * len(names)) for r in rows()]
    docs = spark.createDataFrame(data, "doc_id string, text string, " + ", ".join(f"{n} string" for n in names))
    got = linededup.deduped_documents(docs)
    assert got.columns == docs.columns
    assert sorted((str(r.doc_id), r.text or "") for r in got.collect()) == [(d, t) for d, _, _, t in brute(data)]
    with pytest.raises(ValueError):
        linededup.deduped_documents(docs, counts=True)

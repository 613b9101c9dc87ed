"""Token-id files: independent zstandard frames, a document index and a trailing seek table.

Layout of a file::

    frame 0 | frame 1 | ... | index (skippable frame) | seek table (skippable frame)

Each frame holds the little-endian ids of whole documents, up to about
``frame_ids`` ids (a longer document has a frame of its own). The index lists
frame, number of ids and doc_id of every document. The seek table follows the
public seekable format of zstandard: compressed size, content size and the low
32 bits of the content's XXH64 for each frame, then the number of frames, a
descriptor and a magic number, so readers find it from the end of the file and
decompress only the frames of the documents that they want.

Files are written where the executors share a folder, each task under a name
of its own attempt; only files listed in the returned manifest count.
"""

from __future__ import annotations

import io
import json
import os
import struct
import sys
import unicodedata
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm.bpe import byte_symbols
from graphloom.llm.common import pick, small_batches
from graphloom.llm.pieces import PieceMemo, chunks
from graphloom.storage import materialize, scratch_path

SKIP_INDEX, SKIP_SEEK, SEEK_END = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
CHECKED = 0x80
FRAME_IDS = 1 << 16
_MANIFEST = "part int, path string, n_docs long, n_ids long"


def _checksum(data: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


def write_file(out: BinaryIO, docs: Iterable[tuple[int | None, bytes]], frame_ids: int = FRAME_IDS, width: int = 4, level: int = 3) -> tuple[int, int]:
    """Write (doc_id, ids as little-endian uint32 bytes) in the given order; (documents, ids) written.

    ``width`` is the bytes of a stored id, 2 or 4.
    """
    import zstandard

    packer = zstandard.ZstdCompressor(level=level, write_checksum=True)
    seeks, index, held, n_held, n_ids = [], [], [], 0, 0

    def flush() -> None:
        nonlocal held, n_held
        if held:
            data = b"".join(held)
            packed = packer.compress(data)
            out.write(packed)
            seeks.append((len(packed), len(data), _checksum(data)))
            held, n_held = [], 0

    for doc_id, ids in docs:
        n = len(ids) // 4
        if n_held and n_held + n > frame_ids:
            flush()
        index.append((len(seeks), n, doc_id))
        held.append(ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes())
        n_held += n
        n_ids += n
    flush()
    frames = np.array([x[0] for x in index], "<u4").tobytes()
    counts = np.array([x[1] for x in index], "<u4").tobytes()
    nulls = np.array([x[2] is None for x in index], "u1").tobytes()
    names = np.array([x[2] or 0 for x in index], "<i8").tobytes()
    body = packer.compress(struct.pack("<IB", len(index), width) + frames + counts + nulls + names)
    out.write(struct.pack("<II", SKIP_INDEX, len(body)) + body)
    table = b"".join(struct.pack("<III", *x) for x in seeks) + struct.pack("<IBI", len(seeks), CHECKED, SEEK_END)
    out.write(struct.pack("<II", SKIP_SEEK, len(table)) + table)
    return len(index), n_ids


class TokenFile:
    """Reader of one file; fetches and decompresses only what is asked for."""

    def __init__(self, source: BinaryIO):
        import zstandard

        self.source, self.unpacker = source, zstandard.ZstdDecompressor()
        end = source.seek(0, io.SEEK_END)
        n, flags, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != SEEK_END or flags != CHECKED:
            raise ValueError("no seek table at the end of the file")
        start = end - 9 - 12 * n - 8
        kind, size = struct.unpack("<II", self._at(start, 8))
        if kind != SKIP_SEEK or size != 12 * n + 9:
            raise ValueError("the seek table is damaged")
        table = np.frombuffer(self._at(start + 8, 12 * n), "<u4").reshape(-1, 3).astype(np.int64)
        self.begins = np.concatenate(([0], np.cumsum(table[:, 0])))
        self.sizes, self.sums = table[:, 1], table[:, 2]
        kind, size = struct.unpack("<II", self._at(int(self.begins[-1]), 8))
        if kind != SKIP_INDEX:
            raise ValueError("the index is damaged")
        body = self.unpacker.decompress(self._at(int(self.begins[-1]) + 8, size))
        m, self.width = struct.unpack_from("<IB", body)
        cut = lambda at, kind, size: np.frombuffer(body, kind, m, 5 + at * m)
        self.frames, self.counts = cut(0, "<u4", 4).astype(np.int64), cut(4, "<u4", 4).astype(np.int64)
        nulls, names = cut(8, "u1", 1), cut(9, "<i8", 8)
        self.doc_ids = [None if z else x for z, x in zip(nulls.tolist(), names.tolist())]

    def _at(self, place: int, size: int) -> bytes:
        self.source.seek(place)
        return self.source.read(size)

    def frame(self, i: int) -> bytes:
        """The content of a frame, checked."""
        packed = self._at(int(self.begins[i]), int(self.begins[i + 1] - self.begins[i]))
        data = self.unpacker.decompress(packed)
        if len(data) != self.sizes[i] or _checksum(data) != self.sums[i]:
            raise ValueError(f"frame {i} is damaged")
        return data

    def read(self, doc_ids: Iterable[int | None] | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
        """(doc_id, ids) in file order, of all documents or of the given ones."""
        wanted = None if doc_ids is None else set(doc_ids)
        kind, at, data, place = f"<u{self.width}", -1, b"", 0
        firsts = np.concatenate(([True], self.frames[1:] != self.frames[:-1])) if len(self.frames) else []
        for name, frame, n, first in zip(self.doc_ids, self.frames.tolist(), self.counts.tolist(), firsts):
            place = 0 if first else place
            if wanted is None or name in wanted:
                if frame != at:
                    at, data = frame, self.frame(frame)
                yield name, np.frombuffer(data, kind, n, place)
            place += n * self.width


def _open(folder: str, name: str, mode: str):
    """A file in a shared folder, whatever store it is in."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.removeprefix("file:"))
    if mode == "w":
        store.create_dir(base, recursive=True)
        return store.open_output_stream(f"{base}/{name}", compression=None)
    return store.open_input_file(f"{base}/{name}")


def special_marks(model: str) -> tuple[bytes, ...]:
    return tuple(x["content"].lower().encode() for x in json.loads(model).get("added_tokens") or [])


def library_encoder(model: str) -> Callable[[bytes], bytes]:
    """Encodes a piece with the tokenizers library; ``model`` is the JSON text of a tokenizer.

    A piece of normalized lower-case letters is one word that normalizer and
    pre-tokenizer leave as it is, so its bytes go to the library's BPE model directly.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(model)
    tokenize, letters = tokenizer.model.tokenize, byte_symbols()

    def packed(ids: list[int]) -> bytes:
        made = array("I", ids)
        if sys.byteorder == "big":
            made.byteswap()
        return made.tobytes()

    def encode(piece: bytes) -> bytes:
        if piece.isalpha() and piece.islower():
            return packed([x.id for x in tokenize(piece.decode())])
        text = piece.decode("utf-8", "replace")
        if text.isalpha() and text == text.lower() and unicodedata.is_normalized("NFC", text):
            return packed([x.id for x in tokenize("".join(map(letters.__getitem__, piece)))])
        return packed(tokenizer.encode(text, add_special_tokens=False).ids)

    return encode


_memos: dict[tuple, PieceMemo] = {}


def _writer(model, folder: str, end_id: int, frame_ids: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _memos.get(("library", hash(model.value)))
        if memo is None:
            memo = _memos[("library", hash(model.value))] = PieceMemo(None, special_marks(model.value), single=library_encoder(model.value))
        end = np.array([end_id], "<u4").tobytes()
        rows = ((d, t or b"") for b in batches for d, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()))

        def docs() -> Iterator[tuple[int | None, bytes]]:
            for chunk in chunks(rows):
                for (d, _), ids in zip(chunk, memo.texts([t for _, t in chunk])):
                    yield d, ids + end

        task = TaskContext.get()
        first = next(found := docs(), None)
        if first is None:
            return
        name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}.zst"

        def rest() -> Iterator[tuple[int | None, bytes]]:
            yield first
            yield from found

        with _open(folder, name, "w") as out:
            n_docs, n_ids = write_file(out, rest(), frame_ids, width)
        yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()], pa.int32()), pa.array([name]), pa.array([n_docs]), pa.array([n_ids])], ["part", "path", "n_docs", "n_ids"])

    return run


def encode_to_files(docs: DataFrame, model_path: str, *, end_id: int = 1, frame_ids: int = FRAME_IDS, folder: str | None = None) -> tuple[str, DataFrame]:
    """Encode every whole text, add ``end_id`` and write token files in ascending doc_id order.

    Returns the folder and the manifest (part, path, n_docs, n_ids), one row per
    file. Null text is empty: only the end id. doc_ids are integers (other types:
    a ValueError); null ones come first; rows that repeat a doc_id are ordered by
    text, and many of them spread over files. An empty table writes no file;
    other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with open(model_path, encoding="utf-8") as f:
        text = f.read()
    if docs.schema["doc_id"].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError("token files hold integer doc_ids")
    made = json.loads(text)
    largest = max([end_id, *made["model"]["vocab"].values(), *(t["id"] for t in made.get("added_tokens") or ())])
    width = 2 if largest < 1 << 16 else 4
    folder = folder or scratch_path(spark, "tokens")
    model = spark.sparkContext.broadcast(text)
    ordered = pick(docs, "doc_id", "text").withColumn("h", F.substring("text", 1, 16))
    order = [F.asc_nulls_first("doc_id"), F.asc_nulls_first("h")]
    ordered = ordered.repartitionByRange(*order).sortWithinPartitions(*order, F.asc_nulls_first("text")).drop("h")
    return folder, materialize(ordered.mapInArrow(_writer(model, folder, end_id, frame_ids, width), _MANIFEST), "manifest")


def _reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with _open(folder, name, "r") as source:
                    rows = [(d, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for d, ids in TokenFile(source).read()]
                n = np.array([x[1] for x in rows], np.int64)
                starts = start + np.concatenate(([0], np.cumsum(n)[:-1]))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int64()), pa.array(starts.astype(np.int64)), pa.array(n), pa.array([x[2] for x in rows], pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_files(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read back from the files.

    The running sum over the manifest has one row per file.
    """
    before = F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    placed = manifest.select("part", "path", F.coalesce(before, F.lit(0)).cast("long").alias("start"))
    files = max(1, manifest.count())
    return placed.repartitionByRange(files, "part").select("path", "start").mapInArrow(_reader(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")

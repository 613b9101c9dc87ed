"""BPE encoding by a pair occurrence index, and decoding.

The distinct pieces of a chunk of texts are laid end to end as one array of
symbols with links to the neighbours inside each word. An index maps every
pair with a merge rule to all its positions; active ranks are applied in
ascending order, each to all its positions at once, and the lists of the pairs
that a merge makes or breaks are brought up to date. Words never influence
each other, so taking the lowest active rank of all words first gives each
word the result of taking its own lowest rank first.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from graphloom.llm.common import pick, small_batches
from graphloom.llm.pieces import PieceMemo, chunks


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class PairIndexBpe:
    """Encoder and decoder of a word-level byte BPE vocabulary (end-of-word suffix,
    lower case, white space dropped), given as the JSON text of a tokenizer."""

    def __init__(self, model: str):
        import regex

        spec = json.loads(model)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens") or []}
        size = 1 + max([*self.vocab.values(), *self.special.values()])
        self.tokens: list[bytes | None] = [None] * size
        for token, i in [*self.vocab.items(), *self.special.items()]:
            self.tokens[i] = token.encode()
        self.size = size
        suffix = spec["model"].get("end_of_word_suffix") or ""
        letters = byte_symbols()
        self.model, self.library, self.letters = model, None, {c: b for b, c in enumerate(letters)}
        self.inner = np.array([self.vocab[c] for c in letters], np.int64)
        self.final = np.array([self.vocab[c + suffix] for c in letters], np.int64)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        left = np.array([self.vocab[a] for a, _ in merges], np.int64)
        right = np.array([self.vocab[b] for _, b in merges], np.int64)
        self.left, self.right, self.made = left, right, np.array([self.vocab[a + b] for a, b in merges], np.int64)
        keys = left * size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
        self.marks = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def split(self, piece: str) -> list[bytes | int]:
        """The words of a piece in UTF-8, and the ids of special tokens in it."""
        if self.marks is None or not self.marks.search(piece):
            return self._plain(piece)
        out: list[bytes | int] = []
        at = 0
        for m in self.marks.finditer(piece):
            out += [*self._plain(piece[at : m.start()]), self.special[m[0]]]
            at = m.end()
        return out + self._plain(piece[at:])

    def _plain(self, text: str) -> list[bytes | int]:
        if text.isascii():
            return [w.encode() for w in self.words.findall(text.lower())]
        if "Cn" in map(unicodedata.category, text):
            return self._by_library(text)
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return [w.encode() for w in self.words.findall(text)]

    def _by_library(self, text: str) -> list[bytes | int]:
        """Splits a piece with characters newer than Python's Unicode tables: those of the
        library decide what is a letter and what its lower case is."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.model)
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(map(self.letters.__getitem__, w)) for w, _ in found]

    def _lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], -1) if len(self.keys) else np.full(len(key), -1)

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word."""
        if not words:
            return []
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(sizes)
        sym = self.inner[raw]
        last = ends[sizes > 0] - 1
        sym[last] = self.final[raw[last]]
        n = len(sym)
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        nxt[last] = -1
        prv[(ends - sizes)[sizes > 0]] = -1

        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(places: np.ndarray, ranks: np.ndarray) -> None:
            hit = ranks >= 0
            if not hit.all():
                places, ranks = places[hit], ranks[hit]
            if not len(places):
                return
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            begins = [0, *cuts.tolist()]
            for r, i, j in zip(ranks[begins].tolist(), begins, [*begins[1:], len(ranks)]):
                if r in index:
                    index[r].append(places[i:j])
                else:
                    index[r] = [places[i:j]]
                    heapq.heappush(active, r)

        at = np.flatnonzero(nxt >= 0)
        add(at, self._lookup(sym[at], sym[nxt[at]]))
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            a, b = self.left[r], self.right[r]
            q = nxt[at]
            ok = (sym[at] == a) & (q >= 0)
            ok &= sym[q] == b
            at, q = at[ok], q[ok]
            if a == b and len(at) > 1:  # in a run of overlapping pairs every other one merges, from the left
                chained = np.concatenate(([False], q[:-1] == at[1:]))
                run = np.cumsum(~chained) - 1
                place = np.arange(len(at)) - np.flatnonzero(~chained)[run]
                at, q = at[place % 2 == 0], q[place % 2 == 0]
            if not len(at):
                continue
            sym[at], sym[q] = self.made[r], -1
            after = nxt[q]
            nxt[at] = after
            has = after >= 0
            prv[after[has]] = at[has]
            before = prv[at]
            before = before[before >= 0]
            places = np.concatenate((before, at[has]))
            if len(places):
                add(places, self._lookup(sym[places], sym[nxt[places]]))
        alive = sym >= 0
        ids = sym[alive].astype("<u4")
        kept = np.concatenate(([0], np.cumsum(alive)))
        return [ids[i:j] for i, j in zip(kept[ends - sizes].tolist(), kept[ends].tolist())]

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of distinct pieces, as little-endian unsigned 32-bit integers."""
        parts = [self.split(p.decode("utf-8", "replace")) for p in pieces]
        words = list({w for own in parts for w in own if not isinstance(w, int)})
        ids = dict(zip(words, [x.tobytes() for x in self.encode_words(words)]))
        return [b"".join([ids[w] if not isinstance(w, int) else w.to_bytes(4, "little") for w in own]) for own in parts]

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids in UTF-8: their tokens, separated by spaces; unknown ids are left out."""
        tokens = self.tokens
        try:
            return b" ".join(map(tokens.__getitem__, ids.tolist()))
        except (IndexError, TypeError):
            return b" ".join(tokens[i] for i in ids.tolist() if i < len(tokens) and tokens[i] is not None)


_encoders: dict[int, tuple[PairIndexBpe, PieceMemo]] = {}


def _coder(model, with_ids: bool, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        key = hash(model.value)
        if key not in _encoders:
            bpe = PairIndexBpe(model.value)
            _encoders[key] = (bpe, PieceMemo(bpe.encode_pieces, tuple(m.lower().encode() for m in bpe.special)))
        bpe, memo = _encoders[key]
        rows = ((d, t or b"") for b in batches for d, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()))
        for chunk in chunks(rows):
            n, a, b, kept, size = [], [], [], [], 0
            names: list = []

            def packed() -> pa.RecordBatch:
                cols = [pa.array(names, kind), pa.array(n, pa.int64()), pa.array(a), pa.array(b)]
                return pa.RecordBatch.from_arrays([*cols, *([pa.array(kept, pa.binary())] if with_ids else [])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])])

            for (d, _), ids in zip(chunk, memo.texts([t for _, t in chunk])):
                names.append(d)
                n.append(len(ids) // 4)
                a.append(sha256(ids).hexdigest())
                b.append(sha256(bpe.decode(np.frombuffer(ids, "<u4"))).hexdigest())
                if with_ids:
                    kept.append(ids)
            yield packed()

    return run


def bpe_round_trip(docs: DataFrame, model_path: str, *, with_ids: bool = False) -> DataFrame:
    """Encode every whole text and decode it again: doc_id, n_tokens, ids_sha256 (of the ids as
    little-endian unsigned 32-bit integers), decoded_sha256, and the ids themselves on request.

    Null and empty texts have no ids and decode to the empty text. doc_ids may be
    of any type; null ones and repeated rows are kept as they are; an empty table gives an empty
    result; other columns are ignored. One pass, no shuffle.
    """
    small_batches(docs.sparkSession)
    with open(model_path, encoding="utf-8") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = docs.schema["doc_id"].dataType
    schema = f"doc_id {kind.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary" if with_ids else "")
    return pick(docs, "doc_id", "text").mapInArrow(_coder(model, with_ids, to_arrow_type(kind)), schema)

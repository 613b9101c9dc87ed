"""Encoding of texts piece by piece.

ASCII white space is a hard border of the word-level, lower-casing tokenizers
handled here (it is dropped, and no rule looks across it), so a text's ids are
those of its white-space-separated pieces in a row. Pieces repeat, so each
worker encodes a piece once and remembers it, in two generations of bounded
size: when the young one is full it becomes the old one, whose members come
back when they are met again.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable, Iterator

#: Remembered pieces of a generation; longer pieces are encoded each time they occur.
MEMO_PIECES = 300_000
MEMO_BYTES = 64
#: Bytes of text that are taken together.
CHUNK_BYTES = 16 << 20


#: ASCII signs: no rule joins them to the letters before them.
_SIGNS = bytes(c for c in range(0x21, 0x7F) if not chr(c).isalnum())


def _core(piece: bytes) -> bytes | None:
    """The word of a piece that is a letters-only word with signs behind it, which are encoded one after the other."""
    core = piece.rstrip(_SIGNS)
    if core and len(core) < len(piece):
        if core.isalpha():
            return core
        if not core.isascii() and unicodedata.normalize("NFC", core.decode("utf-8", "replace")).lower().isalpha():
            return core
    return None


class _Known(dict):
    """Pieces with their ids; asks its memo for a piece that it lacks."""

    __slots__ = ("memo",)

    def __missing__(self, piece: bytes) -> bytes:
        return self.memo._one(piece)


class PieceMemo:
    """``encode`` maps a list of distinct pieces (UTF-8) to their ids as bytes, ``single`` does
    so for one piece; with it a text is encoded in one go, else a chunk's new pieces come together.

    ``marks``: special tokens in lower case. A text whose lower case holds none
    of them, and no mark that could compose with a letter (U+0300 to U+033F), is
    lower-cased at once, as the tokenizer would do it later, so that spellings
    share a piece.
    """

    def __init__(self, encode: Callable[[list[bytes]], list[bytes]], marks: tuple[bytes, ...] = (), limit: int = MEMO_PIECES, single: Callable[[bytes], bytes] | None = None):
        self.encode, self.marks, self.limit, self.single = encode, marks, limit, single
        self.young = self._new()
        self.old: dict[bytes, bytes] = {}

    def _new(self) -> dict[bytes, bytes]:
        made = _Known() if self.single else {}
        if self.single:
            made.memo = self
        return made

    def _one(self, piece: bytes) -> bytes:
        ids = self.old.get(piece) if self.old else None
        if ids is None:
            core = _core(piece)
            ids = self.single(piece) if core is None else self.young[core] + self.young[piece[len(core) :]]
        if len(piece) <= MEMO_BYTES:
            self.young[piece] = ids
        return ids

    def _folded(self, text: bytes) -> bytes:
        low = text.lower()
        return text if b"\xcc" in text or any(m in low for m in self.marks) else low

    def _learn(self, missing: set[bytes]) -> None:
        young, old = self.young, self.old
        signed, new = [], set()
        for w in missing:
            if w in old:
                young[w] = old[w]
                continue
            core = _core(w)
            if core is not None:
                signed.append((w, core))
            for part in (w,) if core is None else (core, w[len(core) :]):
                if part in old:
                    young[part] = old[part]
                elif part not in young:
                    new.add(part)
        found = list(new)
        young.update(zip(found, self.encode(found)))
        for w, core in signed:
            young[w] = young[core] + young[w[len(core) :]]

    def texts(self, texts: list[bytes]) -> Iterator[bytes]:
        """The ids of each text, in order."""
        if self.single:
            for t in texts:
                if len(self.young) > self.limit:
                    self.old = dict(self.young)
                    self.young = self._new()
                yield b"".join(map(self.young.__getitem__, self._folded(t).split()))
            return
        texts = [self._folded(t) for t in texts]
        if len(self.young) > self.limit:
            self.young, self.old = {}, self.young
        young = self.young
        missing: set[bytes] = set()
        for t in texts:
            missing.update(set(t.split()).difference(young))
        self._learn(missing)
        get = young.__getitem__
        for t in texts:
            yield b"".join(map(get, t.split()))
        for w in missing:
            if len(w) > MEMO_BYTES:
                core = w.rstrip(_SIGNS)
                for part in (w, core, w[len(core) :]):
                    if len(part) > MEMO_BYTES:
                        young.pop(part, None)


def chunks(rows: Iterable[tuple], size: int = CHUNK_BYTES) -> Iterator[list[tuple]]:
    """Rows whose last member is a text, in lists of about ``size`` bytes of text."""
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += len(row[-1])
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held

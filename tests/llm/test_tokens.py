import io
import random
import struct
import zlib
from hashlib import sha256

import numpy as np
import pytest

from graphloom.llm import bpe, tokenfile
from graphloom.llm.pieces import PieceMemo
from graphloom.llm.queries import word_bpe
from tests.llm.data import SCHEMA, frame, rows


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(word_bpe())
    t.no_truncation()
    t.no_padding()
    return t


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def awkward(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    parts = ["the", "The", "it's", "don't", "I'LL", " ", "\n", "\t", " ", "é", "é", "É", "ß", "İ", "Σς", "123", "4", "a1b2", "<|endoftext|>", "<|EndOfText|>", "<|startoftext|>", "中文字", "\U0001f600", "...", "!?", "-", "̸", "≠", "'s", "'", "ﬁ", "Ǆ", "‍", "͸", "word,", "word.", "été,"]
    return ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(n)]


def test_pair_index_agrees_with_the_library(library):
    model = bpe.PairIndexBpe(open(word_bpe(), encoding="utf-8").read())
    memo = PieceMemo(model.encode_pieces, tuple(m.lower().encode() for m in model.special), limit=50)
    texts = awkward(1, 400) + [r[1] or "" for r in rows()]
    for text, got in zip(texts, memo.texts([t.encode() for t in texts])):
        want = ids_of(library, text)
        assert np.frombuffer(got, "<u4").tolist() == want, text
        assert model.decode(np.array(want, np.uint32)).decode() == library.decode(want, skip_special_tokens=False)


def test_signs_behind_words_agree_with_the_library(library):
    model = bpe.PairIndexBpe(open(word_bpe(), encoding="utf-8").read())
    marks = tuple(m.lower().encode() for m in model.special)
    memos = [PieceMemo(model.encode_pieces, marks, limit=30), PieceMemo(None, marks, limit=30, single=tokenfile.library_encoder(library.to_str()))]
    rng = random.Random(7)
    words = ["word", "été", "Σίσυφος", "x" * 70, "中文", "a1", "", "it's", "<|endoftext|>", "İ"]
    signs = [".", ",", "'", "***", "###", "%%%", ".&&&", ">", "<|", "'s", "=\u0338", "!" * 70, "“"]
    texts = [" ".join(rng.choice(words) + "".join(rng.choices(signs, k=rng.randrange(4))) for _ in range(8)) for _ in range(400)]
    for memo in memos:
        for text, got in zip(texts, memo.texts([t.encode() for t in texts]), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == ids_of(library, text), text
        assert all(len(piece) <= 64 for piece in (*memo.young, *memo.old))


def test_round_trip_query(spark, library):
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.bpe_round_trip(frame(spark), word_bpe()).collect())
    want = []
    for r in rows():
        ids = ids_of(library, r[1])
        want.append((str(r[0]), len(ids), sha256(packed(ids)).hexdigest(), sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.bpe_round_trip(spark.createDataFrame([], SCHEMA), word_bpe()).count() == 0


def test_files_round_trip(spark, library):
    folder, manifest = tokenfile.encode_to_files(frame(spark), word_bpe(), frame_ids=200)
    got = tokenfile.read_files(spark, folder, manifest).orderBy("start").collect()
    order = sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    start = 0
    for r, want in zip(got, order, strict=True):
        ids = [*ids_of(library, want[1]), 1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (want[0], start, len(ids), zlib.crc32(packed(ids)))
        start += len(ids)
    folder, manifest = tokenfile.encode_to_files(spark.createDataFrame([], SCHEMA), word_bpe())
    assert tokenfile.read_files(spark, folder, manifest).count() == 0


def test_readers_decompress_only_what_is_asked():
    out = io.BytesIO()
    docs = [(i if i != 3 else None, packed(list(range(i)))) for i in range(50)]
    assert tokenfile.write_file(out, docs, frame_ids=60, width=2) == (50, sum(range(50)))
    file = tokenfile.TokenFile(out)
    seen = []
    inner = file.frame
    file.frame = lambda i: seen.append(i) or inner(i)
    assert [(d, x.tolist()) for d, x in file.read([40, None])] == [(None, [0, 1, 2]), (40, list(range(40)))]
    assert len(seen) == 2 < len(file.sizes)
    raw = bytearray(out.getvalue())
    raw[int(file.begins[1]) + 12] ^= 255
    with pytest.raises(Exception):
        list(tokenfile.TokenFile(io.BytesIO(bytes(raw))).read())
    with pytest.raises(ValueError):
        tokenfile.TokenFile(io.BytesIO(b"0" * 40))

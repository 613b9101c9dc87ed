"""Language identification by cross-parsing entropy.

Labelled text of each language becomes a suffix automaton. A text is parsed
against every language from left to right into longest matches: a phrase ends
where the automaton has no transition, and the next one begins there. With c
phrases, N training characters and n characters of text, c * log2(N) / n
estimates the bits per character that the language's text needs to describe
the new one (Ziv and Merhav 1993). So that languages of little text can be held
against those of much, a phrase also costs the bits of its length (the entropy
of lengths of mean n / c) and a letter that the language lacks those of a code
point. The language that needs fewest bits wins.

Greedy parsing never follows suffix links, so each automaton is kept as one
flat transition table whose missing transitions already hold the restart. A
batch of texts is cut into segments, and all segments step through all
languages at once. A segment is parsed again from the state in which the one
before it ended, until all fit together, so that phrases run across the cuts as
if the text had been parsed in one go.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from graphloom.llm.common import pick, small_batches
from graphloom.llm.pieces import chunks
from graphloom.storage import materialize

#: Characters of training text of one language, and of all together.
TRAIN_CHARS = 1 << 15
TRAIN_TOTAL = 1 << 18
#: Letters that have a column in the transition tables: the most frequent of the training text. The transitions
#: by all its other letters are few and kept as a sorted list.
MAX_CLASSES = 96
SEGMENT = 1024
#: Bytes of text parsed together.
BATCH_BYTES = 4 << 20
#: Bits of a letter that the training text lacks.
LITERAL = math.log2(0x110000)
UNKNOWN = "und"
_PAD, _SPACE, _OTHER = 0, 1, 2

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """For every code point, whether it is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _letters


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")


def _clean(points: np.ndarray) -> np.ndarray:
    """Letters stay; every run of other characters becomes one space, also at both ends."""
    points = np.concatenate(([32], np.where(letters()[points], points, 32), [32])).astype("<u4")
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != 32) | (points[:-1] != 32)
    return points[keep]


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton of all substrings of a sequence; state 0 is the start."""
    goes: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        cur = len(goes)
        goes.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in goes[p]:
            goes[p][c] = cur
            p = link[p]
        if p >= 0:
            q = goes[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(goes)
                goes.append(dict(goes[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and goes[p].get(c) == q:
                    goes[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return goes


@dataclass
class CrossParser:
    """The automata of all languages; ``table`` holds place of the next state, or its complement after a restart."""

    langs: list[str]
    classes: np.ndarray  # code points, sorted
    table: np.ndarray
    starts: np.ndarray
    bits: np.ndarray  # log2 of each language's training length
    rare: np.ndarray  # code points of the other letters, sorted; their codes follow those of ``classes``
    rare_keys: np.ndarray  # place of a state * number of rare letters + letter, sorted
    rare_goes: np.ndarray  # what ``table`` would hold there
    rare_first: np.ndarray  # by language and rare letter, what it would hold without a transition
    lacking: np.ndarray  # by language and code, whether its training text lacks the letter

    @classmethod
    def fit(cls, texts: dict[str, list[str]]) -> CrossParser:
        """``texts``: training texts by language."""
        clean = {k: np.concatenate([_clean(_points(t)) for t in v]) for k, v in sorted(texts.items()) if v}
        clean = {k: v for k, v in clean.items() if (v != 32).any()}
        seen, counts = np.unique(np.concatenate([*clean.values(), np.array([32], "<u4")]), return_counts=True)
        seen, counts = seen[seen != 32], counts[seen != 32]
        kept = np.sort(seen[np.lexsort((seen, -counts))[:MAX_CLASSES]])
        rare = np.setdiff1d(seen, kept)
        width = len(kept) + 3
        tables, starts, at = [], [], 0
        keys, targets, firsts, lacking = [], [], [], []
        for points in clean.values():
            goes = suffix_automaton(cls._codes(kept, rare, points).tolist())
            own = np.empty((len(goes), width), np.int32)
            without = np.ones(width + len(rare), bool)
            without[[_PAD, _SPACE, *goes[0]]] = False
            lacking.append(without)
            first = np.full(width, ~np.int32(at), np.int32)  # a character that the language lacks is a phrase of its own
            lone = np.full(len(rare), ~np.int32(at), np.int32)
            for c, to in goes[0].items():
                (first if c < width else lone)[c if c < width else c - width] = ~np.int32(at + to * width)
            own[:] = first
            rows = np.repeat(np.arange(len(goes)), [len(g) for g in goes])
            cols = np.fromiter((c for g in goes for c in g), np.int64, len(rows))
            ends = at + width * np.fromiter((t for g in goes for t in g.values()), np.int64, len(rows))
            few = cols >= width
            own[rows[~few], cols[~few]] = ends[~few]
            keys.append((at + width * rows[few]) * len(rare) + cols[few] - width)
            targets.append(ends[few])
            firsts.append(lone)
            own[:, _OTHER] = ~np.int32(at)
            own[:, _PAD] = at + width * np.arange(len(goes))
            tables.append(own.ravel())
            starts.append(at)
            at += own.size
        table = np.concatenate(tables) if tables else np.empty(0, np.int32)
        keys, targets = np.concatenate([np.empty(0, np.int64), *keys]), np.concatenate([np.empty(0, np.int64), *targets])
        order = np.argsort(keys)
        firsts = np.array(firsts, np.int32).reshape(len(clean), len(rare))
        return cls(list(clean), kept, table, np.array(starts, np.int32), np.log2([max(2, len(v)) for v in clean.values()]), rare, keys[order], targets[order].astype(np.int32), firsts, np.array(lacking, bool).reshape(len(clean), width + len(rare)))

    @staticmethod
    def _codes(kept: np.ndarray, rare: np.ndarray, points: np.ndarray) -> np.ndarray:
        """Codes of training text, whose letters are all known."""
        codes = np.full(len(points), _SPACE, np.int64)
        for letters_, begin in ((kept, 3), (rare, 3 + len(kept))):
            held = np.isin(points, letters_)
            codes[held] = np.searchsorted(letters_, points[held]) + begin
        return codes

    def _rare_step(self, before: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """Entries for rare letters, by language and segment, from the places of the states before."""
        default = self.rare_first[:, letter]
        if not len(self.rare_keys):
            return default
        key = before.astype(np.int64) * len(self.rare) + letter
        at = np.minimum(np.searchsorted(self.rare_keys, key), len(self.rare_keys) - 1)
        return np.where(self.rare_keys[at] == key, self.rare_goes[at], default)

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases and lacking letters by text and language, and each text's characters (0: without a letter)."""
        if not texts:
            return np.zeros((0, len(self.langs)), np.int64), np.zeros((0, len(self.langs)), np.int64), np.zeros(0, np.int64)
        lookup = np.full(sys.maxunicode + 1, _SPACE, np.int32) if not hasattr(self, "_lookup") else self._lookup
        if not hasattr(self, "_lookup"):
            lookup[letters()] = _OTHER
            lookup[self.classes] = np.arange(len(self.classes), dtype=np.int32) + 3
            lookup[self.rare] = np.arange(len(self.rare), dtype=np.int32) + 3 + len(self.classes)
            self._lookup = lookup
        codes, sizes = [], []
        for t in texts:
            own = lookup[_points(t)]
            keep = np.ones(len(own), bool)
            keep[1:] = (own[1:] != _SPACE) | (own[:-1] != _SPACE)
            own = own[keep]
            if not (own != _SPACE).any():
                own = own[:0]
            else:
                own = np.concatenate(([_SPACE] if own[0] != _SPACE else [], own, [_SPACE] if own[-1] != _SPACE else [])).astype(np.int32)
            codes.append(own)
            sizes.append(len(own))
        n = np.array(sizes, np.int64)
        segments = -(-n // SEGMENT)
        total = int(segments.sum())
        if not total or not self.langs:
            none = np.zeros((len(texts), len(self.langs)), np.int64)
            return none, none, n
        flat = np.zeros(total * SEGMENT, np.int32)
        firsts = np.cumsum(segments) - segments
        for begin, own in zip(firsts * SEGMENT, codes):
            flat[begin : begin + len(own)] = own
        rows = flat.reshape(total, SEGMENT)
        entry = np.repeat(self.starts[:, None], total, axis=1)
        count, end = self._parsed(rows, entry)
        follows = np.ones(total, bool)
        follows[firsts[segments > 0]] = False
        follows = np.flatnonzero(follows)
        while True:
            changed = follows[(end[:, follows - 1] != entry[:, follows]).any(axis=0)]
            if not len(changed):
                break
            entry[:, changed] = end[:, changed - 1]
            count[:, changed], end[:, changed] = self._parsed(rows[changed], entry[:, changed])
        ends = np.cumsum(segments)

        def by_text(of: np.ndarray) -> np.ndarray:
            sums = np.concatenate((np.zeros((len(self.langs), 1), np.int64), np.cumsum(of, axis=1, dtype=np.int64)), axis=1)
            return (sums[:, ends] - sums[:, ends - segments]).T

        lacking = np.array([own[rows].sum(axis=1) for own in self.lacking])
        return by_text(count) + (n > 0)[:, None], by_text(lacking), n

    def _parsed(self, rows: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases that end inside segments (``rows`` of codes) and the states at their ends, by language and segment."""
        total, width = len(rows), len(self.classes) + 3
        flat = rows.ravel()
        odd = np.flatnonzero(flat >= width)
        letter = flat[odd] - width
        flat = np.where(flat >= width, _OTHER, flat)
        order = np.argsort(odd % SEGMENT, kind="stable")
        odd, letter = odd[order], letter[order]
        until = np.searchsorted(odd % SEGMENT, np.arange(SEGMENT + 1)).tolist()
        grid = np.ascontiguousarray(flat.astype(np.uint8).reshape(total, SEGMENT).T)
        state = entry.copy()
        count = np.zeros((len(self.langs), total), np.int32)
        table, sign = self.table, np.empty_like(state)
        for i, row in enumerate(grid):
            a, b = until[i], until[i + 1]
            if a < b:
                where = odd[a:b] // SEGMENT
                stepped = self._rare_step(state[:, where], letter[a:b])
            state += row
            np.take(table, state, out=state, mode="clip")
            if a < b:
                state[:, where] = stepped
            np.right_shift(state, 31, out=sign)
            count -= sign
            state ^= sign
        return count, state

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and bits per character in that language of each text."""
        c, lacking, n = self.phrases(texts)
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        p = np.minimum(1.0, c / np.maximum(n, 1)[:, None])  # one in so many characters ends a phrase
        with np.errstate(divide="ignore", invalid="ignore"):
            lengths = np.where((p > 0) & (p < 1), -np.log2(p) - (1 - p) / p * np.log2(1 - p), 0.0)
        bits = c * (self.bits + lengths) + lacking * LITERAL
        best = bits.argmin(axis=1)
        low = bits[np.arange(len(texts)), best]
        shares = np.exp2(-np.minimum((bits - low[:, None]) / 4, 1000))
        found = n > 0
        score = np.where(found, 1 / shares.sum(axis=1), 0.0)
        return [self.langs[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), found.tolist())], score, np.where(found, low / np.maximum(n, 1), 0.0)


def training_texts(docs: DataFrame, per_lang: int = TRAIN_CHARS, total: int = TRAIN_TOTAL) -> dict[str, list[str]]:
    """A bounded sample of whole texts by language: distinct texts in the order of a hash,
    as many as fit into ``per_lang`` characters (fewer if all languages would exceed ``total``).

    Texts longer than that budget are left out; a language that has no shorter
    one learns from pieces spread over its shortest text. Texts are thinned by
    the hash and copies collapsed before they are ordered, so a language that
    holds most rows is never gathered.
    """
    h = F.xxhash64(F.lit(6), "text")
    slim = pick(docs, "text", "lang").filter("lang is not null and text is not null").withColumn("n", F.length("text"))
    # copies share a hash, so only distinct texts say which share of the hashes fills a budget
    once = materialize(slim.select("lang", h.alias("h"), "n").groupBy("lang", "h").agg(F.max("n").alias("n")), "language-texts")
    n_langs = once.select("lang").distinct().count()
    if not n_langs:
        return {}
    budget = max(64, min(per_lang, total // n_langs))
    short = once.filter((F.col("n") > 0) & (F.col("n") <= budget))
    sums = materialize(short.groupBy("lang").agg(F.sum("n").alias("chars")), "language-sums")
    share = (F.pmod(h, F.lit(1 << 30)) / float(1 << 30)).alias("share")
    thinned = slim.filter((F.col("n") > 0) & (F.col("n") <= budget)).join(F.broadcast(sums) if n_langs <= 10_000 else sums, "lang")
    thinned = thinned.filter(share < 32.0 * budget / F.col("chars")).withColumn("h", h).dropDuplicates(["lang", "text"])
    order = Window.partitionBy("lang").orderBy("h", "text")
    filled = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))
    chosen = thinned.withColumn("filled", filled).filter(F.col("filled") <= budget).select("lang", "filled", "text")
    without = once.filter("n > 0").join(sums, "lang", "left_anti").groupBy("lang").agg(F.min(F.struct("n", "h")).alias("least")).select("lang", "least.h")
    long = slim.withColumn("h", h).join(F.broadcast(without) if n_langs <= 10_000 else without, ["lang", "h"]).dropDuplicates(["lang"])
    size = min(SEGMENT, budget)
    places = F.sequence(F.lit(0), F.lit(budget // size - 1))
    spread = F.array_join(F.transform(places, lambda i: F.substring("text", (F.floor(i * F.col("n") / (budget // size)) + 1).cast("int"), F.lit(size))), " ")
    out: dict[str, list[str]] = {}
    for row in chosen.unionByName(long.select("lang", F.lit(0).alias("filled"), spread.alias("text"))).orderBy("lang", "filled").toLocalIterator():
        out.setdefault(row.lang, []).append(row.text)
    return out


def _predictor(parser, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: CrossParser = parser.value
        rows = ((d, t.as_py() or "") for b in batches for d, t in zip(b.column(0).to_pylist(), b.column(1)))
        for chunk in chunks(rows, BATCH_BYTES):
            langs, score, bits = model.predict([t for _, t in chunk])
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in chunk], kind), pa.array(langs, pa.string()), pa.array(score), pa.array(bits)], ["doc_id", "lang_pred", "score", "bits_per_char"])

    return run


def identify(docs: DataFrame, parser: CrossParser) -> DataFrame:
    """One row per input row: doc_id, lang_pred, score (0 to 1) and bits_per_char.

    Null text and text without a letter: ``und`` with score 0; so is everything
    if no language was learned. Ties go to the language first in code point
    order. doc_ids may be of any type; null ones and repeated rows are kept as
    they are; an empty table gives an empty result; other columns are ignored. One pass, no shuffle; what
    is broadcast is bounded by the training characters.
    """
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(parser)
    kind = docs.schema["doc_id"].dataType
    return pick(docs, "doc_id", "text").mapInArrow(_predictor(model, to_arrow_type(kind)), f"doc_id {kind.simpleString()}, lang_pred string, score double, bits_per_char double")


def held_out(doc_id, folds: int, fold: int):
    """Whether crc32 of the doc_id as text leaves the remainder ``fold``; a null doc_id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def language_id(docs: DataFrame, *, folds: int = 4, fold: int = 2) -> DataFrame:
    """Learn from the labelled documents of all folds but one and ``identify`` every document; adds ``held_out``."""
    parser = CrossParser.fit(training_texts(docs.filter(~held_out(docs["doc_id"], folds, fold))))
    return identify(docs, parser).withColumn("held_out", held_out(F.col("doc_id"), folds, fold))

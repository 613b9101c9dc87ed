"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Examples are a bounded sample of labelled documents. Terms are words and the
first 4 to 7 letters of longer words (their stems), in lower case, and each of
these again for every rate (one in 32 words, one in 64, ... one in 1024) that its
repeats in a text reach. Those that tell the classes apart (chi-square over the
examples, more common in toxic ones, seen there in several contexts so that
copies of one text don't count) make up the vocabulary. Their document
frequencies are counted over all documents. Examples and texts are vectors of
(1 + ln tf) * ln((1 + n) / (1 + df)) over it (tf is 1 for a rate), and cosines
are taken between these vectors.

The inverted index lists, by term, the examples that hold it in blocks of
``BLOCK`` consecutive numbers, with each block's largest weight. A text scores
the block of its highest summed maxima first, and then only blocks whose summed
maxima reach the k-th best cosine found there: the k nearest are exact, ties to
the example with the smaller number. The votes, weighted by cosine, are smoothed by the
share of toxic examples that hold no term at all.

A second vote is taken by the k nearest examples, at a cosine of ``FLOOR`` or
more, over every word, whether it tells the classes apart or not, so that a copy
of an example is found by its words even if no term is in it. The frequent words
of a text, as far as their part of its vector is no longer than ``SKIPPED`` of
the floor, can't bring an example over it alone: only the lists of the other words are
read, and the few examples that still can reach the floor get their whole cosine. Weights are squared
cosines. A logistic curve fitted to the examples' own leave-one-out votes of both
kinds turns them into a probability.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from graphloom.llm.common import pick, small_batches
from graphloom.llm.language import held_out, letters
from graphloom.storage import materialize

#: Labelled examples of each class, at most: the ones with the smallest hash of their doc_id.
MAX_EXAMPLES = 4096
#: Terms of the vocabulary, at most: those with the highest chi-square.
MAX_TERMS = 4096
#: Chi-square that a term must reach (chance passes it about once in ten million), how much more common than in
#: other examples it must be in toxic ones, and the contexts there that must hold it.
MIN_CHI2, MIN_RATIO, MIN_CONTEXTS = 28.0, 4.0, 3
STEMS = (4, 5, 6, 7)
#: Binary logarithms of the rates: a term repeats at a rate if it is at least one in 2 ** level words.
LEVELS = range(5, 11)
BLOCK = 64
NEIGHBOURS = 15
#: Weight of the prior in the vote, in units of cosine.
PRIOR_MASS = 0.25
#: Cosine over all words from which an example votes.
FLOOR = 0.5
#: Length of a text's part in frequent words whose lists needn't be read, in units of the floor.
SKIPPED = 0.8
#: Counters of a task are given out when they hold so many terms.
_FLUSH = 400_000
#: Characters of texts that are read together.
TOGETHER = 1 << 19
#: Words of a package of document frequencies.
_RANGE = 1 << 14
_WORD = regex.compile(r"\p{L}+")


def word_terms(word: str) -> list[str]:
    return [word, *[f"{word[:n]}*" for n in STEMS if len(word) > n]]


def levels(tf: int, n_words: int) -> range:
    """The rates that a term reaches."""
    if tf < 2:
        return range(0)
    return range(max(LEVELS.start, math.ceil(math.log2(n_words / tf))), LEVELS.stop)


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every term: toxic (a) and other (b) examples that hold it, and hashes of up to
    ``MIN_CONTEXTS`` contexts (word and the word before) in toxic ones. The term '' counts the examples."""
    a: Counter = Counter()
    b: Counter = Counter()
    contexts: dict[str, set[int]] = {}

    def packed() -> pa.RecordBatch:
        names = [*a, *(t for t in b if t not in a)]
        seen = [sorted(contexts.get(t.partition("%")[0], ())) if t in a else [] for t in names]
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([a[t] for t in names], pa.int64()), pa.array([b[t] for t in names], pa.int64()), pa.array(seen, pa.list_(pa.int64()))], ["term", "a", "b", "contexts"])

    for batch in batches:
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = _WORD.findall((text or "").lower())
            before = dict(zip(words[:0:-1], words[-2::-1]))
            tf: dict[str, int] = {}
            for w, n in Counter(words).items():
                context = zlib.crc32(f"{before.get(w, '')} {w}".encode()) if label else 0
                for t in word_terms(w):
                    tf[t] = tf.get(t, 0) + n
                    if label:
                        if (own := contexts.get(t)) is None:
                            contexts[t] = {context}
                        elif len(own) < MIN_CONTEXTS:
                            own.add(context)
            side = a if label else b
            side.update(tf.keys())
            for t, n in tf.items():
                if n >= 2:
                    for k in levels(n, len(words)):
                        side[f"{t}%{k}"] += 1
            side[""] += 1
            if len(a) + len(b) > _FLUSH:
                yield packed()
                a.clear(), b.clear(), contexts.clear()
    yield packed()


#: Odd multipliers of the places in a word, from a fixed generator.
_PLACES = np.random.default_rng(11).integers(0, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _runs(joined: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of a text: where each begins in it, its place among the letters, its length; and sums over the
    letters times multipliers of their places, from which the hash of every word and stem is a difference."""
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    inside = letters()[points]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    begins, lengths = edges[::2], edges[1::2] - edges[::2]
    first = np.cumsum(lengths) - lengths
    places = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    sums = np.zeros(len(places) + 1, np.uint64)
    np.cumsum((points[inside].astype(np.uint64) + np.uint64(1)) * _PLACES[places % len(_PLACES)], out=sums[1:])
    return begins, first, lengths, sums


def _mixed(sums: np.ndarray) -> np.ndarray:
    """Hashes, as signed integers, of differences of sums."""
    x = sums ^ (sums >> np.uint64(29))
    return ((x * np.uint64(0xBF58476D1CE4E5B9)) ^ (x >> np.uint64(32))).view(np.int64)


def hash_of(word: str) -> int:
    """The hash of a word in lower case."""
    _, first, lengths, sums = _runs(word)
    return int(_mixed(sums[first + lengths] - sums[first])[0])


class _Numbers:
    """hash -> number, for arrays."""

    def __init__(self, found: dict[int, int]):
        keys = np.array(sorted(found), np.int64)
        self.keys, self.numbers = keys, np.array([found[k] for k in keys.tolist()], np.int64)

    def of(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are known, and their numbers."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = self.keys.searchsorted(hashes)
        at[at == len(self.keys)] = 0
        hit = np.flatnonzero(self.keys[at] == hashes)
        return hit, self.numbers[at[hit]]


class Vocabulary:
    """The numbers of a list of terms, and what texts have of them and of words."""

    def __init__(self, terms: list[str]):
        number = {t: i for i, t in enumerate(terms)}
        base: dict[str, int] = {}  # a term that is only wanted at some rate has a number from len(terms) on
        self.rates: dict[int, dict[int, int]] = {}
        self.size = len(terms)
        for t, i in number.items():
            plain, _, level = t.partition("%")
            at = base.setdefault(plain, number.get(plain, len(terms) + len(base)))
            if level:
                self.rates.setdefault(at, {})[int(level)] = i
        self.words = _Numbers({hash_of(t): i for t, i in base.items() if not t.endswith("*")})
        self.stems = [(n, _Numbers({hash_of(t[:-1]): i for t, i in base.items() if t.endswith("*") and len(t) == n + 1})) for n in STEMS]
        #: A word with a term begins like it.
        self.heads = _Numbers({hash_of(t[: STEMS[0]].removesuffix("*")): 0 for t in base})
        self.numbered = max([self.size, *base.values()], default=0) + 1

    def read(self, texts: list[str]) -> Iterator[tuple[dict[int, int], np.ndarray, np.ndarray]]:
        """Of each text its term counts, in which a rate counts once, and its words' hashes, sorted, and counts."""
        some: list[str] = []
        for i, text in enumerate(texts, 1):
            if len(text) > TOGETHER:
                yield from self._rated(self._read(some))
                some = []
                yield from self._rated([self._long(text.lower())])
                continue
            some.append(text.lower())
            if i == len(texts) or sum(map(len, some)) >= TOGETHER:
                yield from self._rated(self._read(some))
                some = []
        yield from self._rated(self._read(some))

    def _long(self, text: str) -> tuple[dict[int, int], np.ndarray, np.ndarray]:
        """A text too long to be read at once: pieces that end where a word does."""
        tf: Counter = Counter()
        hashes, counts, begin = [], [], 0
        while begin < len(text):
            end = min(len(text), begin + TOGETHER)
            while end < len(text) and text[end].isalpha() and text[end - 1].isalpha():
                end += 1
            for own, h, n in self._read([text[begin:end]]):
                tf.update(own)
                hashes.append(h)
                counts.append(n)
            begin = end
        found, place = np.unique(np.concatenate(hashes), return_inverse=True)
        return dict(tf), found, np.bincount(place, np.concatenate(counts), len(found)).astype(np.int64)

    def _rated(self, found) -> Iterator[tuple[dict[int, int], np.ndarray, np.ndarray]]:
        for tf, hashes, counts in found:
            if tf:
                total = int(counts.sum())
                for t, n in [x for x in tf.items() if x[1] >= 2 and x[0] in self.rates]:
                    of = self.rates[t]
                    tf.update((of[k], 1) for k in levels(n, total) if k in of)
                tf = {t: n for t, n in tf.items() if t < self.size}
            yield tf, hashes, counts

    def _read(self, texts: list[str]) -> Iterator[tuple[dict[int, int], np.ndarray, np.ndarray]]:
        if not texts:
            return
        begins, first, lengths, sums = _runs(" ".join(texts))
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        doc = np.searchsorted(ends, begins, side="right")
        hashes = _mixed(sums[first + lengths] - sums[first])
        head = _mixed(sums[first + np.minimum(lengths, STEMS[0])] - sums[first])
        near = self.heads.of(head)[0]
        keys = []
        if len(near):
            hit, terms = self.words.of(hashes[near])
            keys.append(doc[near[hit]] * self.numbered + terms)
            for n, own in self.stems:
                long = near[lengths[near] > n]
                hit, terms = own.of(_mixed(sums[first[long] + n] - sums[first[long]]))
                keys.append(doc[long[hit]] * self.numbered + terms)
        pairs, tf = np.unique(np.concatenate(keys) if keys else np.empty(0, np.int64), return_counts=True)
        owner, terms = np.divmod(pairs, self.numbered)
        at = np.searchsorted(owner, np.arange(len(texts) + 1)).tolist()
        cut = np.searchsorted(doc, np.arange(len(texts) + 1)).tolist()
        for i in range(len(texts)):
            own = np.sort(hashes[cut[i] : cut[i + 1]])
            new = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else np.empty(0, np.int64)
            a, b = at[i], at[i + 1]
            yield dict(zip(terms[a:b].tolist(), tf[a:b].tolist())), own[new], np.diff(new, append=len(own))


class WordExamples:
    """The examples' vectors over all their words, and the exact cosines of texts with them from ``floor`` on.

    Words, runs of letters in lower case, are known by 64-bit hashes. A word that no example holds weighs like one of a single document.
    """

    def __init__(self, hashes: np.ndarray, df: np.ndarray, n_docs: int, vectors: list[tuple[np.ndarray, np.ndarray]], floor: float = FLOOR):
        """``hashes``: all words of the examples, sorted, and their document frequencies; ``vectors``: see ``Vocabulary.read``."""
        self.hashes, self.n, self.floor = hashes, len(vectors), floor
        self.idf = np.log((1 + n_docs) / (1 + df.astype(np.float64)))
        self.unknown = max(0.0, math.log((1 + n_docs) / 2))
        made = [self.unit(*v) for v in vectors]
        sizes = np.array([len(x[0]) for x in made], np.int64)
        self.begins = np.concatenate(([0], np.cumsum(sizes)))
        self.words = np.concatenate([np.empty(0, np.int32), *[x[0].astype(np.int32) for x in made]])
        self.own = np.concatenate([np.empty(0, np.float32), *[x[1].astype(np.float32) for x in made]])
        order = np.argsort(self.words, kind="stable")
        self.examples = np.repeat(np.arange(self.n, dtype=np.int32), sizes)[order]
        self.weights = self.own[order]
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(self.words, minlength=len(hashes))))).astype(np.int64)

    def unit(self, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words that examples hold and their weights in the vector, whose length is 1 over all words."""
        if not len(self.hashes):
            return np.empty(0, np.int64), np.empty(0)
        at = self.hashes.searchsorted(hashes)
        at[at == len(self.hashes)] = 0
        known = self.hashes[at] == hashes
        raw = (1 + np.log(counts)) * np.where(known, self.idf[at], self.unknown)
        norm = math.sqrt(float(raw @ raw))
        return at[known], raw[known] / norm if norm else raw[known]

    def nearest(self, hashes: np.ndarray, counts: np.ndarray, k: int, skip: int = -1) -> list[tuple[float, int]]:
        """The k highest (cosine, example) of at least the floor; ties (to 5 places) to the smaller number."""
        at, w = self.unit(hashes, counts)
        begin = self.starts[at]
        size = self.starts[at + 1] - begin
        by_size = (-size).argsort()
        tail = (w[by_size] ** 2).cumsum()
        cut = int(tail.searchsorted((self.floor * SKIPPED) ** 2))
        rest = math.sqrt(tail[cut - 1]) if cut else 0.0
        read = by_size[cut:]
        if not len(read) or math.sqrt(tail[-1]) < self.floor:
            return []
        begin, size = begin[read], size[read]
        ends = size.cumsum()
        places = (begin - ends + size).repeat(size)
        places += np.arange(len(places))
        part = np.bincount(self.examples[places], weights=w[read].repeat(size) * self.weights[places], minlength=self.n)
        if skip >= 0:
            part[skip] = 0
        near = (part >= self.floor - rest - 1e-6).nonzero()[0]
        if not len(near):
            return []
        line = np.zeros(len(self.hashes), np.float32)
        line[at] = w
        whole = np.array([float(line[self.words[a:b]] @ self.own[a:b]) for a, b in zip(self.begins[near], self.begins[near + 1])])
        cosine = np.minimum(np.round(whole, 5), 1.0)
        hit = np.flatnonzero(cosine >= self.floor)
        best = hit[np.lexsort((near[hit], -cosine[hit]))[:k]]
        return list(zip(cosine[best].tolist(), near[best].tolist()))


@dataclass
class NearestExamples:
    """The index over the examples' vectors, and how votes become a score."""

    terms: list[str]
    idf: np.ndarray
    labels: np.ndarray  # of all examples by number
    doc_ids: list
    weights: np.ndarray  # by label: labelled documents for each example
    prior: float
    k: int = NEIGHBOURS
    slope: float = 8.0
    offset: float = -4.0
    words: WordExamples | None = None
    word_slope: float = 0.0
    share: float = 0.0  # of toxic documents

    def build(self, vectors: list[dict[int, int]]) -> NearestExamples:
        """``vectors``: term counts of the examples, in order of their numbers."""
        lists: list[list[tuple[int, float]]] = [[] for _ in self.terms]
        for i, tf in enumerate(vectors):
            for t, w in self.vector(tf).items():
                lists[t].append((i, w))
        self.blocks = -(-len(vectors) // BLOCK)
        self.most = np.zeros((len(self.terms), self.blocks))
        self.posts = []
        for t, own in enumerate(lists):
            numbers = np.array([i for i, _ in own], np.int64)
            weights = np.array([w for _, w in own], np.float64)
            np.maximum.at(self.most[t], numbers // BLOCK, weights)
            self.posts.append((numbers, weights))
        return self

    def vector(self, tf: dict[int, int]) -> dict[int, float]:
        raw = {t: (1 + math.log(n)) * float(self.idf[t]) for t, n in sorted(tf.items()) if self.idf[t] > 0}
        norm = math.sqrt(math.fsum(x * x for x in raw.values()))
        return {t: x / norm for t, x in raw.items()} if norm else {}

    def _scored(self, q: dict[int, float], blocks: np.ndarray) -> np.ndarray:
        """Cosines of the examples of some blocks; others are 0."""
        out = np.zeros(self.blocks * BLOCK)
        for t, w in q.items():
            numbers, weights = self.posts[t]
            if len(blocks) == 1:
                i, j = np.searchsorted(numbers, (blocks[0] * BLOCK, (blocks[0] + 1) * BLOCK))
                out[numbers[i:j]] += w * weights[i:j]
            else:
                out[numbers] += w * weights
        if len(blocks) < self.blocks:
            inside = np.zeros(self.blocks, bool)
            inside[blocks] = True
            out[~np.repeat(inside, BLOCK)] = 0
        return np.minimum(out, 1.0)

    def nearest(self, tf: dict[int, int], skip: int = -1) -> list[tuple[float, int]]:
        """The k highest (cosine, example), zero cosines left out.

        The block of the highest bound is scored first; its k-th best tells which others can matter.
        """
        q = self.vector(tf)
        if not q:
            return []
        bound = np.array(list(q.values())) @ self.most[list(q)] * (1 + 1e-12)
        first = int(bound.argmax())
        scores = self._scored(q, np.array([first]))
        if skip >= 0:
            scores[skip] = 0
        part = scores[first * BLOCK : (first + 1) * BLOCK]
        kth = -np.partition(-part, self.k - 1)[self.k - 1] if self.k <= BLOCK else 0.0
        rest = np.flatnonzero((bound > 0) & (bound >= kth))
        if len(rest) > 1 or rest[0] != first:
            scores = self._scored(q, rest)
            if skip >= 0:
                scores[skip] = 0
        hit = np.flatnonzero(scores)
        best = hit[np.lexsort((hit, -scores[hit]))[: self.k]]
        return list(zip(scores[best].tolist(), best.tolist()))

    def vote(self, near: list[tuple[float, int]]) -> float:
        own = [(c * float(self.weights[self.labels[i]]), self.labels[i]) for c, i in near]
        ground = PRIOR_MASS * float(self.weights.min())
        return (math.fsum(c for c, label in own if label) + ground * self.prior) / (math.fsum(c for c, _ in own) + ground)

    def word_vote(self, near: list[tuple[float, int]]) -> float:
        own = [(c * c * float(self.weights[self.labels[i]]), self.labels[i]) for c, i in near]
        ground = PRIOR_MASS * float(self.weights.min())
        return (math.fsum(c for c, label in own if label) + ground * self.share) / (math.fsum(c for c, _ in own) + ground)

    def word_neighbours(self, hashes: np.ndarray, counts: np.ndarray) -> list[tuple[float, int]]:
        """The nearest examples over all words of a text."""
        return self.words.nearest(hashes, counts, self.k) if self.words is not None and len(hashes) else []

    def score(self, vote: float, word_vote: float) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.slope * vote + self.word_slope * word_vote + self.offset))))

    def calibrate(self, votes: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> NearestExamples:
        """Fit the curve by weighted Newton steps, with Platt's smoothed targets and slopes of at least 0.

        ``votes``: a column of votes over terms and one of votes over words.
        """
        pos, neg = float(weight[labels == 1].sum()), float(weight[labels == 0].sum())
        if not pos or not neg:
            p = min(max((pos + 1) / (pos + neg + 2), 1e-3), 1 - 1e-3)
            self.slope, self.word_slope, self.offset = 0.0, 0.0, math.log(p / (1 - p))
            return self
        target = np.where(labels == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))

        def fitted(columns: list[int]) -> np.ndarray:
            x = np.column_stack([votes[:, columns], np.ones(len(votes))])
            ridge = np.array([1e-3] * len(columns) + [0.0])
            b = np.array([8.0] * len(columns) + [-4.0])

            def loss(b: np.ndarray) -> float:
                z = x @ b
                return float((weight * (np.logaddexp(0, z) - target * z)).sum() + (ridge * b * b).sum())

            now = loss(b)
            for _ in range(50):
                p = 1 / (1 + np.exp(-np.clip(x @ b, -500, 500)))
                g, h = weight * (p - target), weight * np.maximum(p * (1 - p), 1e-9)
                step = np.linalg.solve((x * h[:, None]).T @ x + np.diag(2 * ridge + 1e-9), x.T @ g + 2 * ridge * b)
                size = 1.0
                while size > 1e-4 and loss(b - size * step) > now:
                    size /= 2
                b = b - size * step
                before, now = now, loss(b)
                if before - now < 1e-9:
                    break
            return b

        columns = [0, 1]
        b = fitted(columns)
        while columns and b[:-1].min() < 0:
            columns.pop(int(b[:-1].argmin()))
            b = fitted(columns)
        slopes = dict(zip(columns, b.tolist()))
        self.slope, self.word_slope, self.offset = slopes.get(0, 0.0), slopes.get(1, 0.0), float(b[-1])
        return self


def sample_examples(docs: DataFrame, labels: DataFrame, bound: int) -> DataFrame:
    """(example, label, text): at most ``bound`` labelled documents of each class.

    Labels are ordered by hash before any text is touched; only the chosen ids,
    2 * ``bound`` at most, are joined to the documents.
    """
    clean = pick(labels, "doc_id", "toxic").filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    h = F.xxhash64(F.lit(5), "doc_id")
    chosen = None
    for c in (0, 1):
        own = clean.filter(F.col("label") == c).orderBy(h, "doc_id").limit(bound)
        chosen = own if chosen is None else chosen.unionByName(own)
    chosen = materialize(chosen.coalesce(1), "toxic-chosen").select(F.col("doc_id").alias("example"), "label")
    slim = pick(docs, "doc_id", "text")
    found = slim.join(F.broadcast(chosen), slim["doc_id"] == chosen["example"])
    return found.groupBy("example").agg(F.max("label").alias("label"), F.max(F.coalesce("text", F.lit(""))).alias("text"))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    vocabulary = Vocabulary([])
    for batch in batches:
        found = list(vocabulary.read([t or "" for t in batch.column(1).to_pylist()]))
        lists = [pa.array([x[i] for x in found], pa.list_(pa.int64())) for i in (1, 2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *lists], ["example", "words", "counts"])


def _frequencies(terms, words):
    """Document frequencies of a task: of terms one row each (-1: documents), of words packages of ``_RANGE``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, df, n = Vocabulary(terms.value), Counter(), 0
        hashes = words.value
        seen = np.zeros(len(hashes), np.int32)
        for batch in batches:
            n += batch.num_rows
            for tf, found, _ in vocabulary.read([t or "" for t in batch.column(0).to_pylist()]):
                df.update(tf.keys())
                if len(hashes):
                    at = hashes.searchsorted(found)
                    at[at == len(hashes)] = 0
                    seen[at[hashes[at] == found]] += 1
        parts = [(i, seen[i * _RANGE : (i + 1) * _RANGE]) for i in range(-(-len(seen) // _RANGE))]
        parts = [x for x in parts if x[1].any()]
        numbers = [*[-2 - t for t in df], *[i for i, _ in parts], -1]
        counts = [*[[x] for x in df.values()], *[x for _, x in parts], [n]]
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(counts, pa.list_(pa.int64()))], ["part", "df"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the packages that a task holds all of, sorted by number."""
    part, total = None, None
    for batch in batches:
        for p, df in zip(batch.column(0).to_pylist(), batch.column(1)):
            own = df.values.to_numpy()
            if p == part:
                total = total + own
                continue
            if part is not None:
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total], pa.list_(pa.int64()))], ["part", "df"])
            part, total = p, own
    if part is not None:
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total], pa.list_(pa.int64()))], ["part", "df"])


def _term_vectors(terms):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(terms.value)
        for batch in batches:
            found = [x[0] for x in vocabulary.read([t or "" for t in batch.column(2).to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([list(x.items()) for x in found], pa.map_(pa.int32(), pa.int64()))], ["example", "label", "tf"])

    return run


def fit(docs: DataFrame, labels: DataFrame, *, max_examples: int = MAX_EXAMPLES, max_terms: int = MAX_TERMS, k: int = NEIGHBOURS) -> NearestExamples:
    """Learn from the labelled documents. What reaches the driver and is broadcast is bounded by the words of
    2 * ``max_examples`` documents and by ``max_terms``; frequencies are counted over all documents."""
    spark = docs.sparkSession
    small_batches(spark)
    kind = labels.schema["doc_id"].dataType.simpleString()
    totals = {r.toxic: r["count"] for r in labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("toxic").count().toLocalIterator()}
    examples = materialize(sample_examples(docs, labels, max_examples), "toxic-examples")
    counted = examples.select("label", "text").mapInArrow(_statistics, "term string, a long, b long, contexts array<long>")
    by = counted.groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.size(F.array_distinct(F.flatten(F.collect_list("contexts")))).alias("contexts"))
    by = materialize(by, "toxic-terms")
    sizes = by.filter("term = ''").first()
    pos, neg = (int(sizes["a"]), int(sizes["b"])) if sizes else (0, 0)
    n = pos + neg
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    c, d = F.lit(float(pos)) - a, F.lit(float(neg)) - b
    chi2 = n * (a * d - b * c) * (a * d - b * c) / F.greatest((a + c) * (b + d) * (a + b) * (c + d), F.lit(1e-9))
    useful = by.filter((F.col("term") != "") & (F.col("contexts") >= MIN_CONTEXTS) & (a * max(neg, 1) >= MIN_RATIO * b * max(pos, 1)))
    chosen = useful.withColumn("chi2", chi2).filter(F.col("chi2") >= MIN_CHI2).orderBy(F.desc("chi2"), "term").limit(max_terms)
    terms = sorted(r.term for r in chosen.select("term").toLocalIterator())
    shared = spark.sparkContext.broadcast(terms)

    held = {}
    for r in examples.select("example", "text").mapInArrow(_word_counts, f"example {kind}, words array<long>, counts array<long>").toLocalIterator():
        held[r.example] = (np.array(r.words, np.int64), np.array(r.counts, np.float64))
    hashes = np.unique(np.concatenate([np.empty(0, np.int64), *[x[0] for x in held.values()]]))
    shared_words = spark.sparkContext.broadcast(hashes)
    parts = pick(docs, "text").mapInArrow(_frequencies(shared, shared_words), "part int, df array<long>")
    sums = parts.repartition("part").sortWithinPartitions("part").mapInArrow(_summed, "part int, df array<long>")
    df = {r.part: r.df for r in sums.toLocalIterator()}
    n_docs = df.get(-1, [0])[0]
    idf = np.array([math.log((1 + n_docs) / (1 + df.get(-2 - i, [0])[0])) for i in range(len(terms))])
    word_df = np.zeros(len(hashes), np.int64)
    for part, own_df in df.items():
        if part >= 0:
            word_df[part * _RANGE : part * _RANGE + len(own_df)] = own_df

    vectors = examples.select("example", "label", "text").mapInArrow(_term_vectors(shared), f"example {kind}, label int, tf map<int,long>")
    own = sorted(((r.example, r.label, dict(r.tf)) for r in vectors.toLocalIterator()), key=lambda x: x[0])
    tags = np.array([x[1] for x in own], np.int64)
    weights = np.array([totals.get(0, 0) / neg if neg else 1.0, totals.get(1, 0) / pos if pos else 1.0])
    bare = np.array([not x[2] for x in own], bool)
    own_weights = weights[tags] if n else np.empty(0)
    share = float((own_weights * tags).sum() / own_weights.sum()) if n else 0.0
    prior = (float((own_weights * tags)[bare].sum()) + share) / (float(own_weights[bare].sum()) + 1) if n else 0.0
    model = NearestExamples(terms, idf, tags, [x[0] for x in own], weights, prior, k, share=share).build([x[2] for x in own])
    model.words = WordExamples(hashes, word_df, n_docs, [held[x[0]] for x in own])
    votes = np.array([(model.vote(model.nearest(x[2], skip=i) if x[2] else []), model.word_vote(model.words.nearest(*held[x[0]], k, skip=i))) for i, x in enumerate(own)]).reshape(-1, 2)
    return model.calibrate(votes, tags, own_weights)


class _Judge:
    """Votes for texts; texts with the same terms share their neighbours over terms."""

    def __init__(self, index: NearestExamples):
        self.index, self.vocabulary = index, Vocabulary(index.terms)
        self.memo: dict[tuple, list] = {}

    def __call__(self, texts: list[str | None]) -> Iterator[tuple[float, list, list]]:
        for tf, hashes, counts in self.vocabulary.read([t or "" for t in texts]):
            key = tuple(sorted(tf.items()))
            if key not in self.memo:
                if len(self.memo) > 20_000:
                    self.memo.clear()
                self.memo[key] = self.index.nearest(tf)
            near, other = self.memo[key], self.index.word_neighbours(hashes, counts)
            yield self.index.score(self.index.vote(near), self.index.word_vote(other)), near, other


def _scorer(model, evidence: int, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: NearestExamples = model.value
        judge = _Judge(index)
        for batch in batches:
            scores, seen = [], []
            for score, near, other in judge(batch.column(1).to_pylist()):
                scores.append(score)
                best: dict[int, float] = {}
                for c, i in [*near[:evidence], *other[:evidence]]:
                    best[i] = max(c, best.get(i, 0.0))
                first = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:evidence]
                seen.append([{"doc_id": index.doc_ids[i], "cosine": c, "toxic": int(index.labels[i])} for i, c in first])
            rows = pa.list_(pa.struct([("doc_id", kind), ("cosine", pa.float64()), ("toxic", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(seen, rows)], ["doc_id", "score", "evidence"])

    return run


def score(docs: DataFrame, model: NearestExamples, *, evidence: int = 3) -> DataFrame:
    """One row per input row: doc_id, score and evidence (the nearest labelled examples with their cosine and label;
    the higher of the cosines over terms and over all words).

    Texts without a term and without an example at ``FLOOR``, null and empty ones
    among them, get the score of votes of the priors alone, without evidence.
    doc_ids may be of any type. Null doc_ids and repeated rows are kept as they
    are; an empty table gives an empty result; other columns are ignored.
    Without labelled examples every score is 0.5. One pass, no shuffle.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType
    return pick(docs, "doc_id", "text").mapInArrow(
        _scorer(shared, evidence, to_arrow_type(kind)),
        f"doc_id {kind.simpleString()}, score double, evidence array<struct<doc_id:{kind.simpleString()},cosine:double,toxic:int>>",
    )


def toxicity(docs: DataFrame, labels: DataFrame, *, folds: int = 3, fold: int = 1, threshold: float = 0.7) -> DataFrame:
    """Learn from the labels of all folds but one and ``score`` every document; adds held_out and predicted.

    Labels that are null or neither 0 nor 1 are ignored; a doc_id labelled both
    ways counts as toxic; of documents that share a doc_id the largest text is the example.
    """
    model = fit(docs, labels.filter(~held_out(labels["doc_id"], folds, fold)))
    scored = score(docs, model)
    return scored.withColumn("held_out", held_out(F.col("doc_id"), folds, fold)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` whose text scores below ``threshold``, learned from all labels; all columns stay as they are.

    The score depends on the text only, so texts are scored in the pass that filters them.
    """
    model = fit(docs, labels)
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _Judge(shared.value)
        for batch in batches:
            keep = [score < threshold for score, _, _ in judge(batch.column(batch.schema.get_field_index("text")).to_pylist())]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model predicts the characters of a text, its words joined by single spaces,
and its end from up to ``order`` - 1 characters before them; contexts run across
spaces, so the order of words matters. Each language has its own model, trained on
its trusted texts. Counts are tables keyed by (language, n-gram): raw counts for the
highest order and for n-grams at a text's begin, numbers of distinct left neighbours
for the rest, with three discounts per order (Chen and Goodman 1998).

Scoring never ships the model to the documents. Each task writes its texts in
chunks to shared storage and asks for the distinct n-grams of a chunk. The
distinct questions of all chunks are answered order by order through joins of
the sharded count tables, and the answers go back by chunk, so all that moves
grows with the distinct n-grams of the chunks. A document is kept if its
perplexity lies between fences, quantiles of trusted texts of its language that
the model was not trained on; short texts, whose perplexity varies more by
chance, have wider fences.
"""

from __future__ import annotations

import math
import statistics
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from graphloom.llm.common import n_words, pick, small_batches
from graphloom.llm.pieces import chunks
from graphloom.llm.tokenfile import _open
from graphloom.storage import materialize, scratch_path

ORDER = 4
#: Bytes of text in a chunk.
CHUNK = 24 << 20
#: One trusted text in so many, by a hash of the text, is kept from the model and sets the fences.
FOLDS = 5
#: Quantiles of the held-out trusted texts' deviations from their language's median log perplexity (low, high).
QUANTILES = (0.002, 0.995)
#: Where few texts are held out these lie beyond the sample: they are at least as far out as on the normal curve that
#: goes through the sample's 5 and 95 % quantiles.
INNER = (0.05, 0.95)
#: At this many predicted characters a text's log perplexity varies as much by chance as by its kind:
#: deviations are scaled by sqrt(n / (n + SHORT)).
SHORT = 2000
#: Distinct held-out trusted texts that a language needs to have fences, and to have its own quantiles: with
#: fewer than ``OWN`` it takes those of all languages, if they are wider, which need ``POOL`` texts.
MIN_TRUSTED, POOL, OWN = 3, 30, 1000
#: Trusted doc_ids up to this number are broadcast; beyond it they are joined by key.
MAX_BROADCAST_IDS = 1_000_000
_GRAMS = "lang string, gram string, n long"
_ASKED = "chunk long, lang string, grams array<string>"
#: Begins and ends a text.
EDGE = "\n"
#: Bits of a character's number in a packed n-gram.
_BITS = 16
#: Characters whose n-grams are packed at once.
_SLICE = 1 << 20
#: Log probabilities travel as multiples of 2 ** -24, together with the n-gram's place in its question.
_SCALE, _PLACE = float(1 << 24), 1 << 32


def normal(text: str | None) -> str:
    """The words of a text with single spaces between them, and its edges; empty without a word."""
    words = " ".join((text or "").split())
    return f"{EDGE}{words}{EDGE}" if words else ""


def text_grams(s: str, order: int = ORDER) -> list[str]:
    """The n-grams that predict each character of a ``normal`` text but the first, the predicted character last."""
    return [s[max(0, i + 1 - order) : i + 1] for i in range(1, len(s))]


def _slices(texts: list[str], order: int) -> Iterator[list[tuple[int, int, str]]]:
    """(number of the text, characters that are only context, piece), about ``_SLICE`` characters at a time."""
    held, n = [], 0
    for i, s in enumerate(texts):
        for a in range(0, len(s), _SLICE):
            lead = min(a, order - 1)
            held.append((i, lead, s[a - lead : a + _SLICE]))
            n += len(held[-1][2])
            if n >= _SLICE:
                yield held
                held, n = [], 0
    if held:
        yield held


def _points(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<u4")


def alphabet(texts: list[str], order: int = ORDER) -> np.ndarray | None:
    """The code points of texts, in order. None if they are too many to number in a packed n-gram."""
    seen = np.zeros(0x110000, bool)
    for part in _slices(texts, order):
        seen[_points("".join(x[2] for x in part))] = True
    found = np.flatnonzero(seen)
    return found if len(found) < 1 << _BITS and order * _BITS <= 64 else None


def packed_grams(part: list[tuple[int, int, str]], chars: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of the pieces of a slice as integers, at every predicted character, and how many each piece has.

    A character's number is its place in ``chars`` from 1, the predicted one in
    the lowest bits; longer n-grams are larger.
    """
    number = np.zeros(int(chars[-1]) + 1, np.uint64)
    number[chars] = np.arange(1, len(chars) + 1, dtype=np.uint64)
    own = number[_points("".join(x[2] for x in part))]
    sizes = np.fromiter((len(x[2]) for x in part), np.int64, len(part))
    offset = np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    keys = own.copy()
    for j in range(1, order):
        before = np.zeros_like(own)
        before[j:] = own[:-j]
        before[offset < j] = 0
        keys |= before << np.uint64(_BITS * j)
    lead = np.maximum(1, np.fromiter((x[1] for x in part), np.int64, len(part)))
    return keys[offset >= np.repeat(lead, sizes)], np.maximum(sizes - lead, 0)


def unpacked(keys: np.ndarray, chars: np.ndarray, order: int = ORDER) -> list[str]:
    """The n-grams of keys in ascending order, as text."""
    sizes = sum((keys >> np.uint64(_BITS * j) > 0).astype(np.int64) for j in range(order))
    texts: list[str] = []
    for size in range(1, order + 1):
        own = keys[sizes == size]
        points = [chars[((own >> np.uint64(_BITS * (size - 1 - p))) & np.uint64((1 << _BITS) - 1)).astype(np.int64) - 1] for p in range(size)]
        texts += map("".join, zip(*[map(chr, x.tolist()) for x in points]))
    return texts


def counted_keys(texts: list[str], chars: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The distinct packed n-grams, in ascending order, and how often each occurs."""
    keys, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
    for part in _slices(texts, order):
        own, n = np.unique(packed_grams(part, chars, order)[0], return_counts=True)
        both, at = np.unique(np.concatenate([keys, own]), return_inverse=True)
        keys, counts = both, np.bincount(at, np.concatenate([counts, n]), len(both)).astype(np.int64)
    return keys, counts


def counted_grams(texts: list[str], order: int = ORDER) -> tuple[list[str], list[int]]:
    """The distinct n-grams of ``normal`` texts, in an order that the texts decide, and how often each occurs."""
    chars = alphabet(texts, order)
    if chars is None:
        found = sorted(Counter(g for s in texts for g in text_grams(s, order)).items())
        return [g for g, _ in found], [n for _, n in found]
    keys, counts = counted_keys(texts, chars, order)
    return unpacked(keys, chars, order), counts.tolist()


def text_scores(texts: list[str], logp: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Log probability of each text; ``logp`` are those of ``counted_grams(texts)``."""
    chars = alphabet(texts, order)
    if chars is None:
        known = dict(zip(counted_grams(texts, order)[0], logp.tolist()))
        return np.array([math.fsum([known[g] for g in text_grams(s, order)]) for s in texts])
    held, out = counted_keys(texts, chars, order)[0], np.zeros(len(texts))
    for part in _slices(texts, order):
        keys, sizes = packed_grams(part, chars, order)
        sums = np.concatenate(([0.0], np.cumsum(logp[held.searchsorted(keys)])))
        ends = np.cumsum(sizes)
        np.add.at(out, [x[0] for x in part], sums[ends] - sums[ends - sizes])
    return out


def _by_lang(langs: list, texts: list[str]) -> dict[str | None, list[int]]:
    """Numbers of the texts that have a word, by language."""
    found: dict[str | None, list[int]] = {}
    for i, (lang, s) in enumerate(zip(langs, texts)):
        if s:
            found.setdefault(lang, []).append(i)
    return found


def _trainer(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((x, t or "") for b in batches for x, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        for chunk in chunks(rows, CHUNK):
            texts = [normal(t) for _, t in chunk]
            for lang, own in _by_lang([x for x, _ in chunk], texts).items():
                names, counts = counted_grams([texts[i] for i in own], order)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(names), pa.string()), pa.array(names, pa.string()), pa.array(counts, pa.int64())], ["lang", "gram", "n"])

    return run


def _keyed(df: DataFrame) -> DataFrame:
    """A null language is a language of its own; joins need a value for it."""
    return df.withColumn("lang", F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")))


class KneserNey:
    """Tables of the model, written to shared storage: by order n, ``grams[n]`` (lang, gram, num: the
    discounted count) and ``contexts[n]`` (lang, context, total, left: what the discounts leave for lower orders)."""

    def __init__(self, grams: dict[int, DataFrame], contexts: dict[int, DataFrame], order: int):
        self.grams, self.contexts, self.order = grams, contexts, order

    @classmethod
    def train(cls, trusted: DataFrame, order: int = ORDER) -> KneserNey:
        """``trusted``: lang and text."""
        small_batches(trusted.sparkSession)
        raw = _keyed(pick(trusted, "lang", "text").mapInArrow(_trainer(order), _GRAMS)).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        raw = materialize(raw, "kn-raw")
        counts = {order: raw.filter(F.length("gram") == order)}
        for k in range(order - 1, 0, -1):
            left = counts[k + 1].groupBy("lang", F.expr("substring(gram, 2)").alias("gram")).agg(F.count(F.lit(1)).alias("n"))
            anchored = raw.filter((F.length("gram") == k) & F.col("gram").startswith(EDGE))
            both = left
            counts[k] = materialize(both.unionByName(anchored) if k > 1 else both, f"kn-counts-{k}")
        grams, contexts = {}, {}
        for k, own in counts.items():
            of = lambda i: F.sum(F.when(F.col("n") == i, 1).otherwise(0)).alias(f"n{i}")
            seen = own.groupBy("lang").agg(*[of(i) for i in (1, 2, 3, 4)])
            y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
            usual = lambda i: F.coalesce(F.when((F.col(f"n{i}") > 0) & (F.col("n1") > 0), i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}")), F.lit(0.5 * i))
            discounts = seen.select("lang", *[F.greatest(F.least(usual(i), F.lit(float(i))), F.lit(0.1)).alias(f"d{i}") for i in (1, 2, 3)])
            discount = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
            cut = own.join(F.broadcast(discounts), "lang").withColumn("d", F.least(discount, F.col("n").cast("double")))
            cut = materialize(cut.select("lang", "gram", F.expr(f"substring(gram, 1, {k - 1})").alias("context"), "n", "d"), f"kn-{k}")
            grams[k] = cut.select("lang", "gram", (F.col("n") - F.col("d")).alias("num"))
            contexts[k] = materialize(cut.groupBy("lang", "context").agg(F.sum("n").cast("double").alias("total"), F.sum("d").alias("left"), F.count(F.lit(1)).alias("types")), f"kn-contexts-{k}")
        return cls(grams, contexts, order)

    def answer(self, asked: DataFrame) -> DataFrame:
        """(lang, gram, logp) of distinct (lang, gram), for languages that the model knows.

        A gram of length k needs the probabilities of its suffixes; each order
        is answered for the distinct suffixes of that length, so a join key has
        at most as many rows as there are characters.
        """
        level = {self.order: asked.filter(F.length("gram") == self.order).select("lang", "gram")}
        for k in range(self.order - 1, 0, -1):
            below = level[k + 1].select("lang", F.expr("substring(gram, 2)").alias("gram"))
            level[k] = materialize(below.unionByName(asked.filter(F.length("gram") == k).select("lang", "gram")).distinct(), f"kn-asked-{k}")
        lower = None
        found = None
        for k in range(1, self.order + 1):
            own = level[k].withColumn("context", F.expr(f"substring(gram, 1, {k - 1})")).join(self.grams[k], ["lang", "gram"], "left")
            own = own.join(self.contexts[k], ["lang", "context"], "left" if k > 1 else "inner")
            if lower is None:
                # the base is uniform over the characters seen and one unseen
                own = own.withColumn("below", 1 / (F.col("types") + 1.0))
            else:
                own = own.withColumn("suffix", F.expr("substring(gram, 2)")).join(lower.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("below")), ["lang", "suffix"])
            p = F.when(F.col("total").isNull(), F.col("below")).otherwise((F.coalesce("num", F.lit(0.0)) + F.col("left") * F.col("below")) / F.col("total"))
            lower = materialize(own.select("lang", "gram", p.alias("p")), f"kn-p-{k}")
            found = lower if found is None else found.unionByName(lower)
        return asked.select("lang", "gram").join(found, ["lang", "gram"]).select("lang", "gram", F.log("p").alias("logp"))


def _packer(folder: str, order: int, kind: pa.DataType):
    """Writes the texts of each chunk to shared storage and asks for its n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((d, x, t or "") for b in batches for d, x, t in zip(*(b.column(i).to_pylist() for i in range(3))))
        for part in chunks(rows, CHUNK):
            name = uuid.uuid4().int >> 65
            texts, langs = [normal(t) for _, _, t in part], [x for _, x, _ in part]
            docs = pa.table({"doc_id": pa.array([d for d, _, _ in part], kind), "lang": pa.array(langs, pa.string()), "text": pa.array(texts, pa.large_string())})
            with _open(folder, f"{name:x}", "w") as out, pa.ipc.new_stream(out, docs.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 9))) as sink:
                sink.write_table(docs)
            asked = {lang: counted_grams([texts[i] for i in own], order)[0] for lang, own in _by_lang(langs, texts).items()}
            asked = asked or {None: []}
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(asked), pa.int64()), pa.array(list(asked), pa.string()), pa.array(list(asked.values()), pa.list_(pa.string()))], ["chunk", "lang", "grams"])

    return run


def _scorer(folder: str, order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, own_langs, answers in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                with _open(folder, f"{name:x}", "r") as source:
                    docs = pa.ipc.open_stream(source).read_all()
                texts, langs = docs.column("text").to_pylist(), docs.column("lang").to_pylist()
                told = dict(zip(own_langs, answers.values))
                sums: list[float | None] = [None] * len(langs)
                for lang, own in _by_lang(langs, texts).items():
                    key = "" if lang is None else f"={lang}"
                    if key in told:
                        packed = np.sort(told[key].values.to_numpy())
                        for i, x in zip(own, text_scores([texts[i] for i in own], (packed % _PLACE) / -_SCALE, order).tolist()):
                            sums[i] = x
                counts = pa.array([max(0, len(s) - 1) for s in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([docs.column("doc_id").combine_chunks(), docs.column("lang").combine_chunks(), pa.array(sums, pa.float64()), counts], ["doc_id", "lang", "logp", "n_predicted"])

    return run


def perplexities(docs: DataFrame, model: KneserNey) -> DataFrame:
    """One row per input row: doc_id, lang, logp, n_predicted and perplexity per predicted character
    (null without a word, or if the model has no text of the language).

    Log probabilities are rounded to multiples of 2 ** -24 on the way back.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder, kind = scratch_path(spark, "kn-chunks"), docs.schema["doc_id"].dataType
    asked = materialize(_keyed(pick(docs, "doc_id", "lang", "text").mapInArrow(_packer(folder, model.order, to_arrow_type(kind)), _ASKED)), "kn-asked")
    one = asked.select("chunk", "lang", F.posexplode("grams").alias("place", "gram"))
    # bucketed by question: the distinct questions and the join with their answers need no further shuffle
    buckets, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"kn_questions_{uuid.uuid4().hex}"
    dealt = one.repartition(buckets, "lang", "gram").write.bucketBy(buckets, "lang", "gram").sortBy("lang", "gram")
    try:
        dealt.option("path", scratch_path(spark, "kn-questions")).saveAsTable(name)
        one = spark.table(name)
        answers = model.answer(materialize(one.select("lang", "gram").distinct(), "kn-distinct"))
        told = F.col("place").cast("long") * _PLACE + F.round(F.least(-F.col("logp"), F.lit(200.0)) * _SCALE).cast("long")
        back = one.join(answers, ["lang", "gram"]).select("chunk", "lang", told.alias("told")).groupBy("chunk", "lang").agg(F.collect_list("told").alias("told"))
        every = asked.select("chunk", "lang").join(back, ["chunk", "lang"], "left")
        ready = every.groupBy("chunk").agg(F.filter(F.collect_list(F.struct("lang", "told")), lambda x: x["told"].isNotNull()).alias("own"))
        ready = ready.select("chunk", F.col("own.lang").alias("langs"), F.col("own.told").alias("told"))
        scored = ready.mapInArrow(_scorer(folder, model.order), f"doc_id {kind.simpleString()}, lang string, logp double, n_predicted long")
        return materialize(scored.withColumn("perplexity", F.when(F.col("n_predicted") > 0, F.exp(-F.col("logp") / F.col("n_predicted")))), "kn-scored")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_ids whose labels all say good quality."""
    clean = pick(labels, "doc_id", "quality").filter("doc_id is not null and quality is not null")
    return clean.groupBy("doc_id").agg(F.min("quality").alias("q")).filter("q = 1").select("doc_id")


def quality_by_perplexity(docs: DataFrame, labels: DataFrame, *, order: int = ORDER, quantiles: tuple[float, float] = QUANTILES, short: int = SHORT) -> DataFrame:
    """One row per input row: doc_id, lang, n_predicted, perplexity, low, high (its fences) and kept.

    Trusted are the documents labelled of good quality; one distinct text of them in ``FOLDS`` sets
    the fences, the others train the model (and count for the lower fence only). A document without a word (null and empty texts among
    them) has no perplexity and isn't kept. One whose language has fewer than ``MIN_TRUSTED`` distinct
    held-out texts (or all languages fewer than ``POOL``) can't be judged and is kept. A null lang is a language of its own. doc_ids may be
    of any type; null ones and repeated rows are judged like others; an empty table gives an empty
    result; other columns are ignored.
    """
    ids = materialize(trusted_ids(labels), "kn-trusted")
    if ids.count() <= MAX_BROADCAST_IDS:
        ids = F.broadcast(ids)
    slim = pick(docs, "doc_id", "lang", "text")
    trusted = slim.join(ids, "doc_id", "left_semi").filter(n_words(F.col("text")) > 0)
    judge = F.pmod(F.xxhash64(F.lit(3), "text"), F.lit(FOLDS)) == 0
    model = KneserNey.train(trusted.filter(~judge), order)
    held = materialize(trusted.filter(judge).select("doc_id", "lang", F.xxhash64("text").alias("h")), "kn-held")
    held = held.groupBy("lang", "h").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    scored = perplexities(slim, model)
    scored = scored.withColumn("x", F.log("perplexity")).withColumn("scale", F.sqrt(F.col("n_predicted") / (F.col("n_predicted") + F.lit(float(short)))))
    everyone = scored.filter("x is not null").join(ids, "doc_id", "left_semi").join(held.withColumn("held", F.lit(True)), "doc_id", "left")
    reference = materialize(everyone.select("lang", "x", "scale", F.coalesce("held", F.lit(False)).alias("held")), "kn-reference")
    middle = reference.filter("held").groupBy("lang").agg(F.percentile_approx("x", F.lit(0.5), F.lit(10_000)).alias("mid"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= MIN_TRUSTED)
    middle = middle.select(F.col("lang").alias("_lang"), "mid", "n")
    deviation = (F.col("x") - F.col("mid")) * F.col("scale")
    spread = materialize(reference.join(F.broadcast(middle), F.col("lang").eqNullSafe(F.col("_lang"))).select("_lang", "mid", "n", deviation.alias("d"), F.when(F.col("held"), deviation).alias("of_held")), "kn-spread")
    # texts that the model was trained on are more predictable, which is no fault: they count for the lower fence
    (low, low_in), (high, high_in) = ([F.percentile_approx(c, F.lit(x), F.lit(10_000)) for x in pair] for c, pair in zip(("d", "of_held"), zip(quantiles, INNER)))
    tail = [statistics.NormalDist().inv_cdf(x) / statistics.NormalDist().inv_cdf(y) for x, y in zip(quantiles, INNER)]
    q = F.array(F.least(low, low_in * tail[0]), F.greatest(high, high_in * tail[1]))
    pooled = spread.agg(q.alias("all"), F.count("of_held").alias("pool")).filter(F.col("pool") >= POOL)
    fences = spread.groupBy("_lang", "mid", "n").agg(q.alias("q")).crossJoin(F.broadcast(pooled))  # the pooled quantiles are one row
    edge_of = lambda i, wider: F.when(F.col("n") < OWN, wider(F.col("q")[i], F.col("all")[i])).otherwise(F.col("q")[i])
    fences = fences.select("_lang", "mid", F.least(edge_of(0, F.least), F.lit(0.0)).alias("below"), F.greatest(edge_of(1, F.greatest), F.lit(0.0)).alias("above"))
    out = scored.join(F.broadcast(materialize(fences, "kn-fences")), F.col("lang").eqNullSafe(F.col("_lang")), "left")  # a row for each language with fences
    kept = (F.col("n_predicted") > 0) & F.coalesce(deviation.between(F.col("below"), F.col("above")), F.lit(True))
    edge = lambda side: F.when(F.col("scale") > 0, F.exp(F.col("mid") + F.col(side) / F.col("scale")))
    return out.select("doc_id", "lang", "n_predicted", "perplexity", edge("below").alias("low"), edge("above").alias("high"), kept.alias("kept"))

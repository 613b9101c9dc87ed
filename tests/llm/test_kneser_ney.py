import math
import random
from collections import Counter, defaultdict

import pytest

from graphloom.llm import kneser_ney as kn
from tests.llm.data import SCHEMA, frame, rows


def brute_model(texts, order=4):
    """Interpolated modified Kneser-Ney over plain dicts; a function gram -> probability."""
    raw = Counter(g for t in texts for g in kn.text_grams(kn.normal(t), order))
    counts = {order: {g: n for g, n in raw.items() if len(g) == order}}
    for k in range(order - 1, 0, -1):
        c = Counter(g[1:] for g in counts[k + 1])
        own = c | {g: n for g, n in raw.items() if len(g) == k and k > 1 and g.startswith("\n")}
        counts[k] = own
    tables = {}
    for k, own in counts.items():
        n = Counter(own.values())
        d = {}
        for i in (1, 2, 3):
            y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else None
            usual = i - (i + 1) * y * n[i + 1] / n[i] if n[i] and n[1] else 0.5 * i
            d[i] = max(min(usual, float(i)), 0.1)
        total, left, types = defaultdict(float), defaultdict(float), Counter()
        for g, c in own.items():
            total[g[:-1]] += c
            left[g[:-1]] += min(d[min(c, 3)], c)
            types[g[:-1]] += 1
        tables[k] = (own, d, total, left, types)

    def p(g):
        own, d, total, left, types = tables[len(g)]
        below = p(g[1:]) if len(g) > 1 else 1 / (types[""] + 1)
        h = g[:-1]
        if not total[h]:
            return below
        c = own.get(g, 0)
        return ((c - min(d[min(c, 3)], c) if c else 0) + left[h] * below) / total[h]

    return p


def brute_perplexity(p, text):
    grams = kn.text_grams(kn.normal(text))
    return (math.exp(-math.fsum(math.log(p(g)) for g in grams) / len(grams)), len(grams)) if grams else (None, 0)


def test_probabilities_sum_to_one():
    texts = [r[1] for r in rows() if r[1] and len(r[1]) < 3000]
    p = brute_model(texts)
    chars = {c for t in texts for c in t if not c.isspace()} | {" ", "\n"}
    for h in ("", "t", " th", "riv", "the", "\n"):
        assert sum(p(h + c) for c in chars) <= 1.0001
    assert sum(p("the" + c) for c in chars) > 0.9


def test_perplexities_match_brute_force(spark):
    data = rows()
    trusted = [r for r in data if r[0] is not None and r[0] % 2 == 0]
    docs = frame(spark, data)
    model = kn.KneserNey.train(frame(spark, trusted))
    got = sorted(((str(r.doc_id), str(r.lang), r.n_predicted, r.perplexity) for r in kn.perplexities(docs, model).collect()), key=str)
    models = {lang: brute_model([r[1] or "" for r in trusted if r[2] == lang]) for lang in ("en", "fr", None)}
    want = sorted(((str(r[0]), str(r[2]), *brute_perplexity(models[r[2]], r[1])[::-1]) for r in data), key=str)
    assert len(got) == len(want)
    key = lambda x: (x[0], x[1], x[2], x[3] or 0)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
        assert a[:3] == b[:3] and (a[3] is None) == (b[3] is None)
        assert a[3] is None or a[3] == pytest.approx(b[3], rel=1e-5)


def test_packing(monkeypatch):
    import numpy as np

    rng = random.Random(1)
    texts = [kn.normal(" ".join("".join(rng.choices("abcdé中\U0001f600#", k=rng.randint(1, 9))) for _ in range(rng.randint(0, 30)))) for _ in range(200)]
    many = [kn.normal("".join(map(chr, range(0x10000 + i, 0x10000 + i + 700)))) for i in range(0, 70_000, 600)]  # more characters than can be numbered
    assert kn.alphabet(many) is None
    for own in (texts, many):
        want = Counter(g for s in own for g in kn.text_grams(s))
        logp = {g: rng.uniform(-9, 0) for g in sorted(want)}
        for size in (1 << 20, 50):  # also when texts are cut
            monkeypatch.setattr(kn, "_SLICE", size)
            grams, counts = kn.counted_grams(own)
            assert dict(zip(grams, counts)) == want and len(grams) == len(want)
            got = kn.text_scores(own, np.array([logp[g] for g in grams]))
            assert got == pytest.approx([sum(logp[g] for g in kn.text_grams(s)) for s in own])


def test_order_of_words_matters(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("lang = 'en'").limit(200)
    model = kn.KneserNey.train(docs)
    text = "the river runs by the old stone house and the garden is green in the spring " * 3
    rng = random.Random(2)
    words = text.split()
    mixed = " ".join(rng.sample(words, len(words)))
    one = spark.createDataFrame([(1, text, "en"), (2, mixed, "en")], "doc_id long, text string, lang string")
    a, b = sorted(kn.perplexities(one, model).collect(), key=lambda r: r.doc_id)
    assert a.n_predicted == b.n_predicted and a.perplexity != b.perplexity
    trained = kn.KneserNey.train(spark.createDataFrame([("en", text)] * 3, "lang string, text string"))
    a, b = sorted(kn.perplexities(one, trained).collect(), key=lambda r: r.doc_id)
    assert a.perplexity < b.perplexity


def test_junk_goes_and_prose_stays(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = kn.quality_by_perplexity(docs, labels).join(labels, "doc_id").collect()
    good, bad = [r for r in got if r.quality == 1], [r for r in got if r.quality == 0]
    assert sum(r.kept for r in good) > 0.98 * len(good) and sum(r.kept for r in bad) < 0.3 * len(bad)


def test_awkward_rows(spark):
    docs = frame(spark)
    labels = spark.createDataFrame([(i, int(i % 5 > 0), "x") for i in range(12, 60) if i % 3 < 2] + [(None, 1, "x"), (5, None, "x")], "doc_id long, quality int, lang string")
    got = kn.quality_by_perplexity(docs, labels).collect()
    assert len(got) == len(rows())
    for r in got:
        if r.n_predicted == 0:
            assert not r.kept and r.perplexity is None
        elif r.lang is None:  # no trusted text without a language
            assert r.kept and r.perplexity is None
        else:
            assert r.low is None or r.kept == (r.low <= r.perplexity <= r.high)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert all(r.kept == (r.n_predicted > 0) for r in kn.quality_by_perplexity(docs, none).collect())
    assert kn.quality_by_perplexity(spark.createDataFrame([], SCHEMA), labels).count() == 0


def test_few_trusted_texts_reject_nothing(spark):
    prose = [r[1] for r in rows() if r[0] is not None and 12 <= r[0] < 42]
    data = [(i, t, "one" if i < 15 else "copies") for i, t in enumerate(prose)] + [(100 + i, prose[20], "copies") for i in range(12)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(3, 1)] + [(100 + i, 1) for i in range(12)], "doc_id long, quality int")
    assert all(r.kept for r in kn.quality_by_perplexity(docs, labels).collect())

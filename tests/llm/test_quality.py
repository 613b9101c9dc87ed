import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from graphloom.llm import quality_rules
from tests.llm.data import SCHEMA, frame, rows, words


def brute(text):
    w = words(text)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = set()
    for i in range(len(w) - 7):
        if windows[tuple(w[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if x.strip("\x20\x09\x0a\x0b\x0c\x0d")]
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


def test_counts(spark):
    got = quality_rules.quality(frame(spark)).collect()
    key = lambda r: (str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
    assert sorted(map(key, got)) == sorted((str(r[0]), *brute(r[1])) for r in rows())
    assert not any(r.kept and r.base_failed for r in got)
    assert all(0 <= r.quality <= 1 for r in got)
    assert quality_rules.quality(spark.createDataFrame([], SCHEMA)).count() == 0


def em(patterns, rounds=1000):
    """The same estimate over plain lists: (votes, n)."""
    import math

    rules = range(len(patterns[0][0]))
    q = [0.1 if 0 in v else 0.98 for v, _ in patterns]
    before = None
    for _ in range(rounds + 1):
        g, b = sum(x * n for x, (_, n) in zip(q, patterns)), sum((1 - x) * n for x, (_, n) in zip(q, patterns))
        share = (g + 9) / (g + b + 10)
        good, bad = [], []
        for j in rules:
            seen = defaultdict(float)
            for x, (v, n) in zip(q, patterns):
                seen["g", v[j]] += x * n
                seen["b", v[j]] += (1 - x) * n
            good.append((seen["g", 1] + 49.95) / (seen["g", 0] + seen["g", 1] + 50))
            bad.append((seen["b", 0] + 1 / 3) / (seen["b", 0] + seen["b", 1] + 1))
        now = [share, *good, *bad]
        q = []
        for v, _ in patterns:
            odds = math.log(share / (1 - share)) + sum(math.log(a / (1 - c)) if x == 1 else math.log((1 - a) / c) if x == 0 else 0 for x, a, c in zip(v, good, bad))
            q.append(1 / (1 + math.exp(-odds)))
        if before and max(abs(x - y) for x, y in zip(now, before)) < 1e-6:
            break
        before = now
    return q


def test_posterior_matches_plain_em(spark):
    got = quality_rules.quality(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    votes = [c for c in got.columns if c.startswith("vote_")]
    table = got.filter("not base_failed").groupBy(*votes).agg(F.count(F.lit(1)).alias("n"), F.first("quality").alias("q")).collect()
    want = em([(tuple(r[v] for v in votes), r.n) for r in table])
    for r, q in zip(table, want):
        assert r.q == pytest.approx(q, abs=1e-5)


@pytest.mark.parametrize("scale", [1, 50])
def test_planted_accuracies_are_recovered(spark, scale):
    """Independent rules of known accuracy, far from the priors, at two sizes of the corpus."""
    import itertools

    share, right, wrong = 0.7, [0.8, 0.85, 0.9, 0.82, 0.88], [0.6, 0.7, 0.8, 0.65, 0.75]
    said = 0.9  # the rest abstains
    table = []
    for v in itertools.product((-1, 0, 1), repeat=5):
        p = [1.0, 1.0]
        for x, g, b in zip(v, right, wrong):
            p[0] *= 1 - said if x < 0 else said * (g if x else 1 - g)
            p[1] *= 1 - said if x < 0 else said * (1 - b if x else b)
        table.append((*v, round(200_000 * scale * (share * p[0] + (1 - share) * p[1]))))
    names = [f"r{j}" for j in range(5)]
    got = quality_rules.estimate(spark.createDataFrame(table, ", ".join(f"{n} int" for n in names) + ", n long"), names)
    assert got[0] == pytest.approx(share, abs=0.01)
    assert got[1] == pytest.approx(right, abs=0.01) and got[2] == pytest.approx(wrong, abs=0.01)


def test_junk_goes_and_prose_stays(spark):
    folder = "/root/testdata/sf0.01"
    got = quality_rules.quality(spark.read.parquet(f"{folder}/documents.parquet")).withColumnRenamed("quality", "posterior").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    prose = [r for r in got if r.quality == 1 and not r.base_failed]
    junk = [r for r in got if r.quality == 0]
    assert sum(r.kept for r in prose) > 0.98 * len(prose) and sum(r.kept for r in junk) < 0.1 * len(junk)

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from graphloom.llm import mixing
from tests.llm.data import SCHEMA, frame, rows, words


def brute_targets(sizes, weights, cap):
    """Share out round after round."""
    left, open_, target = float(sum(sizes.values())), {s for s in sizes if sizes[s]}, dict.fromkeys(sizes, 0.0)
    while open_:
        level = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if level * weights[s] > cap * sizes[s]}
        if not full:
            return target | {s: level * weights[s] for s in open_}
        for s in full:
            target[s] = float(cap * sizes[s])
            left -= target[s]
        open_ -= full
    return target


def test_mix(spark):
    docs = frame(spark)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows())
    sizes = defaultdict(int)
    for r in rows():
        sizes[r[3]] += len(words(r[1]))
    order = sorted([s for s in sizes if s is not None]) + [None]
    target = brute_targets(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 3)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 16 * len(sizes)
    assert sorted(r.size for r in got) == sorted(len(words(r[1])) for r in rows())
    again = mixing.mix(docs.repartition(7)).collect()
    key = lambda r: (str(r.doc_id), r.text_hash, r.taken, r.size)
    assert sorted(map(key, again)) == sorted(map(key, got))


def test_many_shards(spark):
    docs = frame(spark)
    got = mixing.mix(docs, shard_words=200, shard_docs=5, block_words=4)
    sums = got.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("x"), F.sum("size").alias("s")).collect()
    for r in sums:
        assert abs(r.t - r.x) <= 4 * 25 and r.t <= 3 * r.s


def test_mixed_documents_hold_what_was_taken(spark):
    docs = frame(spark)
    plan = mixing.mix(docs).groupBy("doc_id").agg(F.sum("taken").alias("t")).collect()
    made = mixing.mixed_documents(docs)
    assert made.columns == docs.columns
    have = defaultdict(int)
    for r in made.collect():
        have[r.doc_id] += len(words(r.text))
        assert r.n_chars == len(r.text)
    assert {r.doc_id: r.t for r in plan if r.t} == dict(have)


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(docs).count() == 0 and mixing.mixed_documents(docs).count() == 0
    assert [r.taken for r in mixing.mix(frame(spark, [rows()[0]])).collect()] == [0]


def test_highest_quotients(spark):
    import random

    rng = random.Random(2)
    for _ in range(5):
        shares = [rng.choice([0, 1, 5, 5, 100, 1000]) for _ in range(rng.randint(1, 12))]
        seats = rng.randint(0, 40)
        df = spark.createDataFrame([(1, i, s, seats) for i, s in enumerate(shares)], "g int, k int, s long, n long")
        got = {r.k: r.out for r in mixing.sainte_lague(df, ["g"], ["k"], "s", "n", "out").collect()}
        want = dict.fromkeys(range(len(shares)), 0)
        for _ in range(seats if sum(shares) else 0):
            best = max((i for i in want if shares[i]), key=lambda i: (shares[i] / (2 * want[i] + 1), -i))
            want[best] += 1
        assert got == want


def plan_by_hand(data, cycle=(5, 2, 1), block_words=16, cap=3, seed=17):
    """What each row gives, for sources of one shard each: seats one by one, words laid end to end, blocks picked."""
    import math

    sizes = [len(words(t)) for _, t, _ in data]
    order = sorted({s for _, _, s in data if s is not None}) + ([None] if any(s is None for _, _, s in data) else [])
    total = {s: sum(n for n, r in zip(sizes, data) if r[2] == s) for s in order}
    target = brute_targets(total, {s: cycle[i % 3] for i, s in enumerate(order)}, cap)
    least = min((t for t in target.values() if t > 0), default=1.0)
    block = int(min(block_words, 2 ** math.floor(math.log2(max(least / mixing.FINE, 1)))))
    quota = dict.fromkeys(order, 0)
    for _ in range(math.floor(sum(sizes) / block + 0.5)):
        best = max((s for s in order if target[s] > 0), key=lambda s: (target[s] / (2 * quota[s] + 1), -order.index(s)))
        quota[best] += 1
    return target, {s: min(quota[s] * block, cap * total[s]) for s in order}


def test_small_sources_come_near_their_targets(spark):
    """Sources of 1 to 40 words beside large ones: every quota is met to the word."""
    data = [(i, " ".join(["w"] * i), f"s{i:02d}") for i in range(1, 41)] + [(100 + i, " ".join(["v"] * 300), "t") for i in range(30)] + [(None, "u u u", None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    target, want = plan_by_hand(data)
    got = {r.source: r for r in mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()}
    assert {s: r.taken for s, r in got.items()} == want
    for s, r in got.items():
        assert r.target == pytest.approx(target[s]) and abs(r.taken - r.target) <= max(1.0, 0.01 * r.target)


def test_taken_of_each_document(spark):
    """The spans and copies of every document, worked out over the words of its shard laid end to end."""
    data = [(i, " ".join(f"w{i}" for _ in range(i % 37)), "abc"[i % 3]) for i in range(120)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    _, quota = plan_by_hand(data)
    rows_ = docs.select("doc_id", "source", F.xxhash64("text").alias("th")).withColumn("h", F.xxhash64(F.lit(17), "doc_id", "th", F.lit(1).cast("long"))).collect()
    shifts = {r.source_id: r.x for r in spark.range(1, 4).select(F.col("id").alias("source_id"), F.xxhash64(F.lit(18), F.col("id"), F.lit(0).cast("long")).alias("x")).collect()}
    want = {}
    for n, s in enumerate("abc", 1):
        own = sorted((r for r in rows_ if r.source == s), key=lambda r: (r.h, r.doc_id))
        line = [r.doc_id for r in own for _ in range(len(words(data[r.doc_id][1])))]
        copies, rest = divmod(quota[s], len(line))
        blocks = len(line) // 16
        stride, shift = mixing.STRIDES[shifts[n] % 4], shifts[n] % blocks
        full, part = divmod(rest, 16)
        for i, d in enumerate(line):
            b = i // 16
            place = (b * stride + shift) % blocks
            hit = (full >= blocks and i % 16 < part) if b >= blocks else place < full or (place == full and i % 16 < part)
            want[d] = want.get(d, 0) + copies + hit
    got = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    assert {d: t for d, t in got.items() if t} == {d: t for d, t in want.items() if t}
    assert sum(got.values()) == sum(quota.values())


def test_repeated_rows_and_clashing_names(spark):
    names = ["copies", "spans", "row", "made", "no", "text_hash", "size", "target", "block", "_mix_no", "_h", "taken", "repeat", "shard"]
    data = [(str(r[0]) if r[0] is not None else None, r[1], r[3], *["x"] * len(names)) for r in rows()]
    data += [data[30]] * 40 + [(None, None, None, *["x"] * len(names))] * 40
    docs = spark.createDataFrame(data, "doc_id string, text string, source string, " + ", ".join(f"{n} string" for n in names))
    plan = mixing.mix(docs)
    assert plan.count() == len(data)
    made = mixing.mixed_documents(docs)
    assert made.columns == docs.columns
    have = defaultdict(int)
    for r in made.collect():
        have[r.doc_id] += len(words(r.text))
        assert r.spans == "x"
    assert {r.doc_id: r.t for r in plan.groupBy("doc_id").agg(F.sum("taken").alias("t")).collect() if r.t} == dict(have)

import math

import numpy as np
import pytest

from graphloom.llm import topk


def brute(data, every, k):
    ok = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in data if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for qi, q in ok:
        if qi % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, c)), ci) for ci, c in ok if ci != qi and len(c) == len(q))[:k]
            out += [(qi, n + 1, ci, -s) for n, (s, ci) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("n", [0, 3, 400])
def test_search(spark, n):
    rng = np.random.default_rng(n)
    data = [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(n)]
    if n > 100:
        data[10:20] = [(i, data[5][1]) for i in range(10, 20)]  # ties
        data[30] = (30, None)
        data[31] = (31, [])
        data[32] = (32, [1.0, None, *[0.0] * 4])
        data[33] = (33, [float("nan"), *[0.0] * 5])
        data[34] = (34, [float("inf"), *[0.0] * 5])
        data[35] = (35, [1.0, 2.0])
        data += [(None, [0.0] * 6), (-20, [-1.0] * 6)]
    df = spark.createDataFrame([(*r, "clash") for r in data], "vec_id long, embedding array<float>, score string")
    got = topk.top_k(topk.build_index(df, block=16), topk.quantized(df).filter("vec_id % 10 = 0"), k=10, round_queries=7)
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == brute(data, 10, 10)


def test_wide_values(spark):
    data = [(0, [3e5, -2e5]), (1, [3e5, 1.0]), (2, [-3e5, 7.0]), (100, [1e6, 1e5])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = topk.search(df).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == brute(data, 100, 10)

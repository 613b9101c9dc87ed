import re

import numpy as np
import xxhash

from graphloom.llm import simhash
from tests.llm.data import SCHEMA, frame, rows


def brute_fingerprint(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius=4):
    ids = list(range(len(fps)))
    root = lambda i: i if ids[i] == i else root(ids[i])
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                ids[root(i)] = root(j)
    return [root(i) for i in range(len(fps))]


def want(data):
    fps = [brute_fingerprint(r[1]) for r in data]
    roots = brute_components(fps)
    least = {}
    for r, c in zip(data, roots):
        if r[0] is not None:
            least[c] = min(least.get(c, r[0]), r[0])
    return sorted((str(r[0]), f, str(least.get(c))) for r, f, c in zip(data, fps, roots))


def test_components(spark):
    got = simhash.simhash_components(frame(spark)).collect()
    assert sorted((str(r.doc_id), r.fp % (1 << 64), str(r.component_id)) for r in got) == want(rows())


def test_one_per_component(spark):
    docs = frame(spark)
    kept = simhash.one_per_component(docs)
    assert kept.columns == docs.columns
    groups = {c for _, _, c in want(rows())}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(groups)


def test_links_of_planted_fingerprints(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    near = [b ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, 1 + i % 6, replace=False))) for i, b in enumerate(base)]
    fps = np.unique(np.concatenate([base, np.array(near, np.uint64)]))
    nodes = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    links = simhash.linked(nodes, 4, shard=16).collect()
    at = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    ids = list(range(len(fps)))
    root = lambda i: i if ids[i] == i else root(ids[i])
    for u, v in links:
        assert (int(fps[at[u]]) ^ int(fps[at[v]])).bit_count() <= 4
        ids[root(at[u])] = root(at[v])
    mine = [root(i) for i in range(len(fps))]
    theirs = brute_components([int(x) for x in fps])
    assert len(set(zip(mine, theirs))) == len(set(mine)) == len(set(theirs))


def test_empty(spark):
    assert simhash.simhash_components(spark.createDataFrame([], SCHEMA)).count() == 0
    assert simhash.one_per_component(spark.createDataFrame([], SCHEMA)).count() == 0


def test_each_component_keeps_one_row_without_or_under_one_id(spark):
    texts = [f"{w} stands alone {w * 2} here {w * 3} now {w * 4} again" for w in ("alpha", "bravo", "chess", "delta", "ember")]
    data = [(i, t, "en", "a", len(t), *["clash"] * 2, 7, *["clash"] * 3) for i, t in [(None, texts[0]), (None, texts[1]), (None, texts[2]), (None, texts[2]), (7, texts[3]), (7, texts[4]), (7, texts[2])]]
    kept = simhash.one_per_component(frame(spark, data)).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted([("None", texts[0]), ("None", texts[1]), ("7", texts[2]), ("7", texts[3]), ("7", texts[4])])


def test_ids_of_text_and_clashing_names(spark):
    names = ["_keep", "_rank", "_hash", "keep", "key", "row", "h", "id", "fp", "component", "least", "u", "v"]
    data = [(str(r[0]) if r[0] is not None else None, r[1], *["x"] * len(names)) for r in rows()]
    docs = spark.createDataFrame(data, "doc_id string, text string, " + ", ".join(f"{n} string" for n in names))
    kept = simhash.one_per_component(docs)
    assert kept.columns == docs.columns
    groups = brute_components([brute_fingerprint(r[1]) for r in data])
    got = kept.collect()
    assert len(got) == len(set(groups)) and all(r.key == "x" for r in got)
    least = {}
    for r, c in zip(data, groups):
        if r[0] is not None:
            least[c] = min(least.get(c, r[0]), r[0])
    assert sorted(str(r.doc_id) for r in got) == sorted(str(least.get(c)) for c in set(groups))

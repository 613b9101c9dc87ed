import math
import random

import numpy as np

from graphloom.llm import toxicity
from tests.llm.data import SCHEMA, frame, rows


def test_nearest_is_exact():
    rng = random.Random(3)
    terms = [f"t{i}" for i in range(40)]
    idf = np.array([rng.uniform(0, 5) for _ in terms])
    vectors = [{t: rng.randint(1, 4) for t in rng.sample(range(40), rng.randint(0, 6))} for _ in range(700)]
    labels = np.array([rng.randint(0, 1) for _ in vectors])
    model = toxicity.NearestExamples(terms, idf, labels, np.arange(700), np.ones(2), 0.1, 15).build(vectors)
    unit = [model.vector(v) for v in vectors]
    for q in vectors[:150] + [{}]:
        own = model.vector(q)
        scored = [(min(1.0, sum(w * u.get(t, 0.0) for t, w in own.items())), i) for i, u in enumerate(unit)]
        want = sorted([x for x in scored if x[0] > 0], key=lambda x: (-round(x[0], 12), x[1]))[:15]
        got = model.nearest(q)
        assert [i for _, i in sorted(got, key=lambda x: (-round(x[0], 12), x[1]))] == [i for _, i in want]
        assert all(math.isclose(a, b) for (a, _), (b, _) in zip(got, want))


def test_learns_from_other_folds_only(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.toxicity(docs, labels)
    assert got.count() == docs.count()
    seen = got.join(labels, "doc_id").filter("held_out").collect()
    toxic, clean = [r for r in seen if r.toxic == 1], [r for r in seen if r.toxic == 0]
    assert sum(r.predicted for r in toxic) >= 0.7 * len(toxic) and sum(r.predicted for r in clean) <= 0.03 * len(clean)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in seen)
    used = {e.doc_id for r in got.select("evidence").collect() for e in r.evidence}
    import zlib

    assert used and all(zlib.crc32(str(d).encode()) % 3 != 1 for d in used)


def planted():
    data = [r for r in rows() if r[0] != 20]
    return [(r[0], f"{r[1]} vile{'s' * (i % 3)} vile words vile" if i % 4 == 0 and r[1] and 12 <= i < 70 else r[1], *r[2:]) for i, r in enumerate(data)]


def test_awkward_rows(spark):
    data = planted()
    docs = frame(spark, data)
    labels = spark.createDataFrame([(r[0], int("vile" in (r[1] or "")), "clash") for r in data] + [(999, 1, ""), (3, None, ""), (None, 1, ""), (4, 7, "")], "doc_id long, toxic int, text string")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(data)
    text = {r[0]: r[1] for r in data}
    assert all(r.predicted == int("vile" in (text[r.doc_id] or "")) for r in got if r.doc_id is not None)
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in data if "vile" not in (r[1] or ""))


def test_nothing_to_learn(spark):
    docs = frame(spark)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.toxicity(docs, none).collect()} == {0.5}
    assert toxicity.toxicity(spark.createDataFrame([], SCHEMA), none).count() == 0


def test_cosines_over_all_words_are_exact():
    rng = random.Random(6)
    names = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    texts = [rng.choices(names[: rng.choice([8, 60])], k=rng.randint(0, 9)) for _ in range(300)]
    vector = lambda words: next(toxicity.Vocabulary([]).read([" ".join(words)]))[1:]
    hashed = {w: int(vector([w])[0][0]) for w in [*names, "unknown"]}
    hashes = np.array(sorted({hashed[w] for t in texts for w in t}))
    back = {h: w for w, h in hashed.items()}
    df = {w: rng.randint(1, 400) for w in names}
    index = toxicity.WordExamples(hashes, np.array([df[back[h]] for h in hashes.tolist()]), 500, [vector(t) for t in texts])

    def unit(t):
        raw = {w: (1 + math.log(t.count(w))) * math.log(501 / (1 + df.get(w, 1))) for w in sorted(set(t))}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        return {w: x / norm for w, x in raw.items()} if norm else {}

    units = [unit(t) for t in texts]
    found = 0
    for q in texts[:150] + [["unknown"], ["wab", "unknown"]]:
        own = unit(q)
        scored = [(min(1.0, round(sum(w * u.get(t, 0.0) for t, w in own.items()), 5)), i) for i, u in enumerate(units)]
        want = sorted([x for x in scored if x[0] >= toxicity.FLOOR], key=lambda x: (-x[0], x[1]))[:15]
        got = index.nearest(*vector(q), 15)
        assert len(got) == len(want) and all(math.isclose(a, b, abs_tol=2e-5) for (a, _), (b, _) in zip(got, want))
        found += len(got)
    assert found > 300


def test_score_is_that_of_brute_force(spark):
    """Terms, frequencies, both votes and the curve, worked out anew over plain dicts."""
    import re
    from collections import Counter

    from pyspark.sql import functions as F

    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    tables = {r.doc_id: re.findall(r"[^\W\d_]+", (r.text or "").lower()) for r in docs.collect()}
    tag = {r.doc_id: r.toxic for r in labels.collect() if r.doc_id in tables}

    def tf(words):
        count = Counter()
        for w in words:
            count.update([w, *[f"{w[:k]}*" for k in (4, 5, 6, 7) if len(w) > k]])
        return dict(count) | {f"{t}%{k}": 1 for t, n in count.items() if n >= 2 for k in range(5, 11) if n * 2**k >= len(words)}

    counts = {d: tf(w) for d, w in tables.items()}
    term_df, word_df = Counter(t for c in counts.values() for t in c), Counter(w for x in tables.values() for w in set(x))
    known = {w for d in tag for w in tables[d]}
    terms = set(model.terms)

    def unit(raw):
        norm = math.sqrt(sum(x * x for x in raw.values()))
        return {k: x / norm for k, x in raw.items()} if norm else {}

    by_term = {d: unit({t: (1 + math.log(n)) * math.log(1001 / (1 + term_df[t])) for t, n in c.items() if t in terms}) for d, c in counts.items()}
    by_word = {d: unit({w: (1 + math.log(n)) * math.log(1001 / (1 + (word_df[w] if w in known else 1))) for w, n in Counter(x).items()}) for d, x in tables.items()}
    ids = sorted(tag)
    cosine = lambda a, b: sum(w * b[k] for k, w in a.items() if k in b)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    share = sum(tag.values()) / len(tag)
    bare = [d for d in ids if not by_term[d]]
    prior = (sum(tag[d] for d in bare) + share) / (len(bare) + 1)
    for d in list(tables)[::9]:
        votes = []
        for vectors, floor, power, ground in ((by_term, 1e-12, 1, prior), (by_word, toxicity.FLOOR, 2, share)):
            near = sorted(((round(cosine(vectors[d], vectors[e]), 5), e) for e in ids), key=lambda x: (-x[0], x[1]))
            near = [(min(c, 1.0) ** power, tag[e]) for c, e in near[:15] if c >= floor]
            votes.append((sum(c for c, t in near if t) + 0.25 * ground) / (sum(c for c, _ in near) + 0.25))
        want = 1 / (1 + math.exp(-(model.slope * votes[0] + model.word_slope * votes[1] + model.offset)))
        assert abs(got[d] - want) < 0.02, d


def test_copies_without_a_term_are_found(spark):
    """Texts whose words no other group holds: no term tells the classes apart, only the whole text does."""
    data, labels = [], []
    for g in range(80):
        text = " ".join("q" + chr(97 + g % 26) + chr(97 + g // 26) + chr(97 + w) + "zz" for w in range(12))
        for c in range(3):
            data.append((3 * g + c, text, "en", "a", len(text), *["clash"] * 2, 7, *["clash"] * 3))
            if c:
                labels.append((3 * g + c, int(g % 4 == 0)))
    docs = frame(spark, data)
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, known)
    assert model.terms == []
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert all((got[3 * g].score >= 0.7) == (g % 4 == 0) and len(got[3 * g].evidence) >= 2 for g in range(80))
    assert {r.doc_id for r in toxicity.without_toxic(docs, known).collect()} == {r[0] for r in data if r[0] // 3 % 4}


def test_texts_are_read_like_regular_expressions_do(monkeypatch):
    """Words, counts, stems and rates of texts of all kinds, also when they are cut into pieces."""
    import regex

    from tests.llm.data import rows as awkward

    texts = [r[1] or "" for r in awkward()] + ["", "Ünïcödé stems stemsa stemsab STEMS²x", "vile" * 9 + " vile vile"]
    terms = ["vile", "stem*", "stems*", "stems", "the", "rive*", "rive*%5", "vile%5", "long*"]
    want = []
    for t in texts:
        words = regex.findall(r"\p{L}+", t.lower())
        tf = {}
        for i, term in enumerate(terms):
            plain, _, level = term.partition("%")
            n = sum(w == plain if not plain.endswith("*") else len(w) >= len(plain) and w.startswith(plain[:-1]) for w in words)
            if n and (not level or (n >= 2 and n * 32 >= len(words))):
                tf[i] = 1 if level else n
        want.append((tf, {toxicity.hash_of(w): words.count(w) for w in set(words)}))
    for together in (1 << 19, 50):
        monkeypatch.setattr(toxicity, "TOGETHER", together)
        got = [(tf, dict(zip(h.tolist(), n.tolist()))) for tf, h, n in toxicity.Vocabulary(terms).read(texts)]
        assert got == want

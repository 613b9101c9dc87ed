import math
import random

import numpy as np
from pyspark.sql import functions as F

from graphloom.llm import language
from tests.llm.data import SCHEMA, frame, rows


def clean(text):
    out = []
    for c in " " + "".join(text.lower()) + " ":
        c = c if c.isalpha() else " "
        if c != " " or not out or out[-1] != " ":
            out.append(c)
    return "".join(out)


def brute_phrases(training, text):
    """Greedy longest matches; a character that the training text lacks ends a phrase."""
    s = clean(text)
    if not any(c.isalpha() for c in s):
        return 0, 0
    phrase, n = "", 1
    for c in s:
        if phrase + c in training:
            phrase += c
        else:
            n += 1
            phrase = c if c in training else ""
    return n, len(s)


def test_phrases_match_brute_force():
    rng = random.Random(4)
    train = {"x": ["ab abba baab", "caba"], "y": ["dede ed", "ünü"]}
    parser = language.CrossParser.fit(train)
    joined = {k: "".join(clean(t) for t in v) for k, v in train.items()}
    texts = ["", "123 !", "abba", "ABBA", "dedede", "zzz", "中", "a" * 3000, "abba baab" * 900] + ["".join(rng.choices("abcdeü zq1", k=rng.randint(1, 60))) for _ in range(200)]
    counts, lacking, sizes = parser.phrases(texts)
    for t, c, n in zip(texts, counts, sizes):
        for k, got in zip(parser.langs, c):
            want, size = brute_phrases(joined[k], t)
            assert n == size and (size == 0 or got == want), (t, k)
    langs, score, bits = parser.predict(texts)
    assert langs[:2] == ["und", "und"] and langs[2] == langs[3] == "x" and langs[4] == "y"
    for t, lang, c, gone, n in zip(texts, langs, counts, lacking, sizes):
        if n:
            assert gone.tolist() == [sum(x not in joined[k] for x in clean(t)) for k in parser.langs]
            cost = {}
            for k, x, g in zip(parser.langs, c.tolist(), gone.tolist()):
                p = min(1.0, x / n)
                of_length = -math.log2(p) - (1 - p) / p * math.log2(1 - p) if p < 1 else 0.0
                cost[k] = x * (math.log2(len(joined[k])) + of_length) + g * math.log2(0x110000)
            assert lang == min(cost, key=cost.get)


def test_automaton_holds_all_substrings():
    text = [1, 2, 1, 1, 2, 3]
    goes = language.suffix_automaton(text)

    def has(seq):
        state = 0
        for c in seq:
            if c not in goes[state]:
                return False
            state = goes[state][c]
        return True

    for i in range(6):
        for j in range(i, 7):
            assert has(text[i:j])
    assert not has([3, 1]) and not has([2, 2])


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) > 0.98 * len(got)


def test_awkward_rows(spark):
    got = language.language_id(frame(spark)).collect()
    assert len(got) == len(rows())
    text = {r[0]: r[1] for r in rows()}
    for r in got:
        if r.doc_id is not None:
            assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text[r.doc_id] or ""))
            assert 0 <= r.score <= 1 and r.lang_pred in ("en", "fr", "und")
    assert language.language_id(spark.createDataFrame([], SCHEMA)).count() == 0
    unlabelled = frame(spark, [(*r[:2], None, *r[3:]) for r in rows()])
    assert {r.lang_pred for r in language.language_id(unlabelled).collect()} == {"und"}


def test_copies_do_not_crowd_out_a_language(spark):
    copies = spark.range(20_000).select(F.lit("ab " * 66).alias("text"), F.lit("xx").alias("lang"))
    others = spark.createDataFrame([(f"{chr(97 + i) * 3} " * 50, "xx") for i in range(20)], "text string, lang string")
    got = language.training_texts(copies.unionByName(others), per_lang=640)
    assert 440 < sum(map(len, got["xx"])) <= 640 and all(t in {r.text for r in copies.unionByName(others).distinct().collect()} for t in got["xx"])


def test_rare_letters_match_brute_force():
    rng = random.Random(5)
    wide = [chr(0x4E00 + i) for i in range(400)]
    make = lambda letters, n: "".join(rng.choices(letters + [" "], k=n))
    train = {"x": [make(wide[:300], 900), "ab abba"], "y": [make(wide[150:], 900)], "z": ["zaza"]}
    parser = language.CrossParser.fit(train)
    joined = {k: "".join(clean(t) for t in v) for k, v in train.items()}
    texts = [train["x"][0][40:70], train["y"][0][:1500], "\u9fa5\u9fa4", *[make(wide + ["a", "b", "q"], rng.randint(1, 2500)) for _ in range(40)]]
    counts, lacking, sizes = parser.phrases(texts)
    for t, c, n in zip(texts, counts, sizes):
        for k, got in zip(parser.langs, c):
            assert (got, n) == brute_phrases(joined[k], t)
    assert parser.predict([train["x"][0][40:70], train["y"][0][40:70]])[0] == ["x", "y"]


def test_matches_run_across_segments():
    """Text that the training holds as a whole is one phrase, however long."""
    rng = random.Random(8)
    long = "".join(rng.choices("abcdefgh ", k=4000))
    parser = language.CrossParser.fit({"x": [long], "y": ["dede ed"]})
    for text in (long, long[700:3900], long[:3000] + "zz" + long[900:]):
        counts, _, sizes = parser.phrases(["ab", text, "cd"])
        assert (counts[1][0], sizes[1]) == brute_phrases(clean(long), text)
    assert parser.phrases([long])[0][0][0] == 1


def test_large_alphabets_and_uncommon_languages(spark):
    """Languages of 2000 letters each beside one of few; one that has a single text many times; one with long texts only."""
    rng = random.Random(9)
    some = lambda a: "".join(rng.choices([chr(a + i) for i in range(2000)] + [" "] * 300, k=250))
    data = [(some(0x4E00), "zh") for _ in range(120)] + [(some(0xAC00), "ko") for _ in range(120)]
    data += [("the river and the stone are quiet in the morning " * 4, "en")] * 200 + [("det er en lang tekst om vinteren " * 3000, "da")] * 3
    docs = spark.createDataFrame([(i, *x) for i, x in enumerate(data)], "doc_id long, text string, lang string")
    copies = spark.range(60_000).select((F.col("id") + 1_000_000).alias("doc_id"), F.lit("mitä kuuluu tänään kaikki hyvin").alias("text"), F.lit("fi").alias("lang"))
    parser = language.CrossParser.fit(language.training_texts(docs.unionByName(copies)))
    assert parser.langs == ["da", "en", "fi", "ko", "zh"]
    fresh = [some(0x4E00) for _ in range(40)] + [some(0xAC00) for _ in range(40)]
    want = ["zh"] * 40 + ["ko"] * 40 + ["fi", "da", "en"]
    assert parser.predict([*fresh, "hyvin kuuluu", "en lang tekst", "quiet stone"])[0] == want


def test_ids_of_text(spark):
    docs = spark.createDataFrame([("a", "the river and the stone", "en"), (None, "?", None)], "doc_id string, text string, lang string")
    assert sorted((str(r.doc_id), r.lang_pred) for r in language.identify(docs, language.CrossParser.fit({"en": ["the stone"]})).collect()) == [("None", "und"), ("a", "en")]

"""The pipeline's stages against plain Python, each on what the stage before kept."""

from collections import Counter
from hashlib import sha256

from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import toxicity
from graphloom.llm.queries import word_bpe
from graphloom.storage import materialize
from tests.llm import test_lines, test_simhash
from tests.llm.data import SCHEMA, rows, words

FOLDER = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "simhash", "mixing", "bpe"]
    plain = lambda df: [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]

    clean = materialize(stages["toxicity"](spark, docs, FOLDER), "t")
    scored = toxicity.toxicity(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    assert {r[0] for r in plain(clean)} == {r.doc_id for r in scored.filter("predicted = 0").collect()} != {r[0] for r in plain(docs)}
    assert set(plain(clean)) <= set(plain(docs))

    lines = materialize(stages["line_dedup"](spark, clean, FOLDER), "l")
    assert sorted((str(r[0]), r[1] or "") for r in plain(lines)) == [(d, t) for d, _, _, t in test_lines.brute(plain(clean))]

    single = materialize(stages["simhash"](spark, lines, FOLDER), "s")
    groups = {c for _, _, c in test_simhash.want(plain(lines))}
    assert {str(r[0]) for r in plain(single)} == groups and set(plain(single)) <= set(plain(lines))

    mixed = materialize(stages["mixing"](spark, single, FOLDER), "m")
    assert mixed.columns == docs.columns
    whole = {r[0]: words(r[1]) for r in plain(single)}
    for d, text, *_ in plain(mixed):
        own = words(text)
        assert own == whole[d] or set(own) <= set(whole[d])
    copies = Counter(r[0] for r in plain(mixed))
    assert max(copies.values()) <= 4

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(word_bpe())
    encoded = stages["bpe"](spark, mixed, FOLDER).collect()
    want = Counter((r[0], sha256(b"".join(i.to_bytes(4, "little") for i in library.encode(r[1], add_special_tokens=False).ids)).hexdigest()) for r in plain(mixed))
    assert Counter((r.doc_id, r.ids_sha256) for r in encoded) == want
    run = corpus_pipeline.run(spark, FOLDER).select("doc_id", "ids_sha256").collect()
    assert Counter(map(tuple, run)) == want


def test_awkward_rows(spark, tmp_path):
    for name, data in (("full", rows()), ("none", [])):
        folder = str(tmp_path / name)
        spark.createDataFrame(data, SCHEMA).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(3, 0), (14, 1)] if data else [], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for stage, f in corpus_pipeline.STAGES[:-1]:
            out = materialize(f(spark, docs, folder), stage)
            assert out.columns == docs.columns
            docs = out
        assert corpus_pipeline.run(spark, folder).agg(F.count(F.lit(1))).first()[0] == docs.count()

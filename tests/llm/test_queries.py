"""Registered queries with SQL give the rows that DuckDB gives, and all return the columns of their contract."""

from collections import Counter

import duckdb
import pytest

from graphloom.llm import queries

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": "doc_id size source_size target taken", "op2": "doc_id start n_tokens ids_crc32", "op3": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op4": "doc_id n_tokens ids_sha256 decoded_sha256", "op5": "doc_id held_out score predicted", "op6": "doc_id held_out lang_pred score", "op7": "query_id rank vec_id score",
    "op8": "doc_id n_lines n_dropped kept_sha256", "op9": "doc_id fingerprint component_id", "op10": "doc_id perplexity kept",
}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = queries.QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    out = duck.sql(queries.SQL[name])
    at = [out.columns.index(c) for c in cols]
    assert Counter(map(tuple, df.select(*cols).collect())) == Counter(tuple(r[i] for i in at) for r in out.fetchall())


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_columns(spark, name):
    df = queries.QUERIES[name](spark, FOLDER)
    assert set(COLUMNS[name.split("_")[0]].split()) <= set(df.columns)
    table = "embeddings" if name.startswith("op7") else "documents"
    n = spark.read.parquet(f"{FOLDER}/{table}.parquet").count()
    assert df.count() == n or table == "embeddings"

import pytest

import graphloom
from graphloom.operators.answer import format_answer
from graphloom.sources.catalog import from_star_schema
from graphloom.stages import Build


def test_build_by_stages(spark, tmp_path):
    from_star_schema(spark, "/root/testdata/sf0.001").limit(60).repartition(2).write.parquet(str(tmp_path / "catalog"))
    build = Build(spark, str(tmp_path / "out"), [str(tmp_path / "catalog")], limit=40)
    build.run("all")
    stats = {(r.metric, r.key): r.value for r in build.audit().collect()}
    assert stats[("nodes_by_type", "product")] == 40 and stats[("nodes_by_type", "feature")] > 0 and 0 < stats[("largest_component", "")] <= 1
    members = build.load("communities").filter("level = 0")
    assert members.count() == build.load("nodes").count() == members.select("member").distinct().count()
    assert build.load("summaries").count() == members.select("community_id").distinct().count()
    build.run("enrich")  # the cache holds every vector now
    build.run("evaluate")
    rows = build.load("eval_queries").collect()
    assert len(rows) == 24 and all(r.answer_nonempty in (True, False) for r in rows)
    assert {r.system for r in build.load("eval_by_type").collect()} == {"baseline", "routed"}
    with pytest.raises(SystemExit):
        build.run("nothing")


def test_public_names():
    assert all(callable(getattr(graphloom, n)) for n in graphloom.__all__)
    with pytest.raises(AttributeError):
        graphloom.missing


def test_format_answer():
    text = format_answer({"query_type": "multi_hop", "fallback": True, "answer": "A", "sources": list("abcdefg"), "paths": ["x --> y"]})
    assert text.split("\n") == ["[multi_hop, by local search]", "A", "Sources:", "- a", "- b", "- c", "- d", "- e", "Paths:", "- x --> y"]

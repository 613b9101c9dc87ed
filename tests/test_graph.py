import pytest
from pyspark.sql import functions as F

from graphloom import schema
from graphloom.operators import communities, construct, features, graph, linking, retrieve, similarity, summaries
from graphloom.operators.components import connected_components


def catalog(spark, rows):
    """rows: dicts with some of the catalog's columns."""
    import re

    names = [c.split()[0] for c in re.split(r", (?=\w+ (?:string|array|map|double|bigint))", schema.CATALOG)]
    return spark.createDataFrame([tuple({"row_ord": i, **r}.get(n) for n in names) for i, r in enumerate(rows)], schema.CATALOG)


def log(spark, rows):
    return spark.createDataFrame(rows, "u string, v string, type string, weight double, seq bigint")


def edges(spark, pairs, kind="similar_to"):
    return spark.createDataFrame([(min(a, b), max(a, b), kind, None, i) for i, (a, b) in enumerate(pairs)], schema.EDGES)


def nodes(spark, ids, kinds=None, names=None):
    return spark.createDataFrame([(n, (kinds or {}).get(n, "product"), (names or {}).get(n, n), None, None, None, i) for i, n in enumerate(ids)], schema.NODES)


def test_upsert_merges(spark):
    rows = construct.upsert(log(spark, [("a", "b", "bought_together", 2.0, 1), ("b", "a", "also_bought", 1.0, 2), ("a", "b", "similar_to", 0.9, 3), ("c", "c", "x", None, 4)])).collect()
    assert sorted(tuple(r) for r in rows) == [("a", "b", "similar_to", 0.9, 1), ("c", "c", "x", None, 4)]
    assert construct.upsert(log(spark, [])).count() == 0


def test_also_buy_cap_comes_first(spark):
    c = catalog(spark, [{"parent_asin": "p", "also_buy": [f"x{i}" for i in range(10)] + ["q", "p"]}, {"parent_asin": "q", "bought_together": ["q", "p", "gone"]}])
    assert construct.also_bought(c).count() == 0
    assert sorted((r.u, r.v) for r in construct.bought_together(c).collect()) == [("q", "p"), ("q", "q")]


@pytest.mark.parametrize("paths, member, parent, names", [([["A"], ["B"]], 2, 0, {"A", "B"}), ([["A", "B"]], 2, 1, {"A", "B"}), ([["A", "a"]], 2, 1, {"a"})])
def test_categories(spark, paths, member, parent, names):
    c = catalog(spark, [{"parent_asin": "p", "categories": paths}])
    assert (construct.in_category(c).count(), construct.category_parent(c).count()) == (member, parent)
    assert {r.name for r in construct.category_nodes(c).collect()} == names


def test_flat_categories(spark):
    c = catalog(spark, [{"parent_asin": "p"}]).withColumn("categories", F.array(F.lit("A"), F.lit("B")))
    assert (construct.in_category(c).count(), construct.category_parent(c).count()) == (2, 0)


def test_brands_and_repeated_products(spark):
    c = catalog(spark, [{"parent_asin": "p", "title": "old", "store": "Visit the Acme Store"}, {"parent_asin": "p", "title": "new", "store": "ACME"}, {"parent_asin": None, "store": "Lost"}, {"parent_asin": "r"}])
    assert [tuple(r) for r in construct.brand_nodes(c).collect()] == [("brand:acme", "ACME")]
    n, e = construct.build_graph(c)
    assert {(r.node_id, r.name) for r in n.collect()} == {("p", "new"), ("r", ""), ("brand:acme", "ACME")}
    assert e.count() == 1
    empty = construct.build_graph(catalog(spark, []))
    assert empty[0].count() == empty[1].count() == 0


def hub(spark):
    products = [f"p{i:02d}" for i in range(1, 36)]
    return products, edges(spark, [("brand", p) for p in products], "has_brand")


@pytest.mark.parametrize("seed, hops, size", [("brand", 1, 31), ("p01", 2, 31), ("p35", 2, 32)])
def test_capped_search(spark, seed, hops, size):
    _, e = hub(spark)
    seeds = spark.createDataFrame([(1, seed, 1)], "query_id int, node string, seed_rank int")
    assert graph.subgraph_nodes(graph.adjacency(e), seeds, hops).count() == size
    assert graph.subgraph_nodes(graph.adjacency(e), seeds, hops, max_nodes=5).count() == 5


def test_paths(spark):
    e = edges(spark, [("s", "a"), ("a", "t"), ("s", "b"), ("b", "t"), ("t", "u")])
    seeds = spark.createDataFrame([(1, "s", 1)], "query_id int, node string, seed_rank int")
    members = graph.subgraph_nodes(graph.adjacency(e), seeds, 2)
    paths = graph.shortest_paths(members, e, seeds, 2)
    assert {r.node: r.path for r in paths.collect()} == {"s": ["s"], "a": ["s", "a"], "b": ["s", "b"], "t": ["s", "a", "t"]}
    told = graph.describe_paths(paths, nodes(spark, list("sabtu"), names={"s": "S" * 50}), e)
    assert {r.node: r.described for r in told.collect()}["t"] == "S" * 40 + " --[similar_to]--> a --[similar_to]--> t"


def test_components(spark):
    pairs = [(1, 2), (2, 3), (5, 6), (7, 7), (9, None)] + [(100 + i, 101 + i) for i in range(60)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 7: 7} | {100 + i: 100 for i in range(61)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
    n, e = nodes(spark, ["a", "b", "c"]), edges(spark, [("a", "b")])
    assert tuple(graph.largest_component(n, e).first()) == (2, 3, 2 / 3)


def test_statistics(spark):
    n = nodes(spark, ["p", "q", "brand:x"], {"brand:x": "brand"})
    e = edges(spark, [("p", "brand:x"), ("q", "brand:x"), ("p", "p")])
    rows = {(r.metric, r.key): r.value for r in graph.statistics(n, e).collect()}
    assert rows[("avg_product_degree", "")] == 2.0 and rows[("top_brands_by_degree", "brand:x")] == 2.0 and rows[("nodes_by_type", "product")] == 2.0
    assert "average product degree: 2" in graph.format_statistics(graph.statistics(n, e))


def test_communities(spark):
    clique = lambda ids: [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :]]
    ids = [f"n{i:02d}" for i in range(12)]
    e = edges(spark, clique(ids[:6]) + clique(ids[6:]) + [(ids[0], ids[6])])
    n = nodes(spark, [*ids, "alone"])
    got = communities.detect_communities(n, e, resolution=1.0, largest_share=0.6).collect()
    level0 = {r.member: r.community_id for r in got if r.level == 0}
    assert set(level0) == {*ids, "alone"}  # every node once
    assert len(set(level0[i] for i in ids[:6])) == len(set(level0[i] for i in ids[6:])) == 1 and len(set(level0.values())) == 3
    assert {int(r.member) for r in got if r.level == 1} == set(level0.values())
    labels = spark.createDataFrame([(m, str(c)) for m, c in level0.items()], "node string, community string")
    alone = spark.createDataFrame([(m, m) for m in level0], "node string, community string")
    w = graph.weighted_edges(e)
    assert communities.modularity(w, labels) > communities.modularity(w, alone) and communities.modularity(w, labels) > 0.4
    assert communities.detect_communities(nodes(spark, []), edges(spark, [])).count() == 0


def test_contraction_counts_edges(spark):
    e = spark.createDataFrame([("a", "b", "x", 5.0, 1), ("a", "c", "x", 0.2, 2), ("b", "c", "x", 0.9, 3)], schema.EDGES)
    labels = spark.createDataFrame([("a", "0"), ("b", "0"), ("c", "1")], "node string, community string")
    assert [tuple(r) for r in communities.contract(e, labels).collect()] == [("0", "1", 2)]


def test_small_cluster(spark):
    groups = spark.createDataFrame([(0, "x"), (0, "y"), (1, "b")], "community_id bigint, member string")
    n = nodes(spark, ["x", "y", "b"], {"b": "brand"})
    rows = {r.community_id: r for r in summaries.summarize(n, edges(spark, [("x", "b")]), groups).collect()}
    assert rows[0].summary == "Small cluster: x; y" and rows[0].num_products == 2
    assert rows[1].product_ids == ["b"] and rows[1].key_brands == ["b"]


def test_pool(spark):
    kinds = {"brand:k": "brand", "brand:c": "brand"}
    n = nodes(spark, ["A", "B", "C", "D", "brand:k", "brand:c"], kinds)
    e = spark.createDataFrame(
        [("A", "brand:k", "has_brand", None, 1), ("B", "brand:k", "has_brand", None, 2), ("D", "brand:k", "has_brand", None, 3), ("C", "brand:c", "has_brand", None, 4), ("A", "B", "similar_to", 0.9, 5), ("A", "C", "similar_to", 0.9, 6)],
        schema.EDGES,
    )
    hits = spark.createDataFrame([("q", "A", 0.8, 1), ("q", "B", 0.6, 2), ("q", "missing", 0.5, 3)], "query_id string, id string, score double, rank int")
    got = {r.node: (round(r.base, 2), r.bonus, round(r.score, 2), r.source, r.via_edge) for r in retrieve.pool(hits, n, graph.adjacency(e)).collect()}
    assert got == {"A": (0.8, 0.15, 0.95, "vector", "similar_to"), "B": (0.6, 0.15, 0.75, "vector", "similar_to"), "C": (0.4, 0.15, 0.55, "graph", "similar_to"), "D": (0.4, 0.1, 0.5, "graph", "has_brand")}
    best = retrieve.local_search(hits, n, graph.adjacency(e), top_k=2).orderBy("rank").collect()
    assert [r.node for r in best] == ["A", "B"]

    class Broken:
        def rerank(self, query, texts):
            raise MemoryError

    class Backwards:
        def rerank(self, query, texts):
            return list(range(len(texts)))

    asked = spark.createDataFrame([("q", "x")], "query_id string, query string")
    ranks = lambda r: [x.node for x in retrieve.local_search(hits, n, graph.adjacency(e), top_k=4, queries=asked, reranker=r).orderBy("rank").collect()]
    assert ranks(Broken()) == ["A", "B", "C", "D"] and ranks(Backwards()) == ["D", "C", "B", "A"]


def test_knn_matches_brute_force(spark):
    import numpy as np

    v = np.random.default_rng(3).normal(size=(60, 8)).astype(np.float32)
    v[7] = v[3]
    df = spark.createDataFrame([(f"v{i:02d}", x.tolist()) for i, x in enumerate(v)] + [(None, [0.0] * 8), ("void", None)], "id string, embedding array<float>")
    got = {}
    for r in similarity.knn(df, df, 4, block=7).collect():
        got[(r.id, r.rank)] = r.nbr
    for i in range(60):
        s = v.astype(float) @ v[i].astype(float)
        order = [j for j in sorted(range(60), key=lambda j: (-round(s[j], 12), j)) if j != i][:4]
        assert [got[(f"v{i:02d}", k + 1)] for k in range(4)] == [f"v{j:02d}" for j in order]


def test_multi_hop(spark):
    n = nodes(spark, ["p1", "p2", "p3", "brand:sony"], {"brand:sony": "brand"}, {"p1": "Sony Camera", "p2": "Strap", "p3": "Lens", "brand:sony": "Sony"})
    e = edges(spark, [("p1", "brand:sony"), ("p2", "brand:sony"), ("p2", "p3")], "has_brand")
    asked = spark.createDataFrame([(1, "what fits Sony"), (2, "x"), (3, "y")], "query_id int, query string")
    entities = spark.createDataFrame([(1, 0, " Sony "), (2, 0, "zzzz qqqq"), (3, 0, "  ")], "query_id int, entity_rank int, entity string")
    found, notes = linking.multi_hop(asked, n, e, entities)
    assert {(r.node, r.hop_distance) for r in found.collect()} == {("p2", 1), ("p3", 2)}
    assert {r.query_id: r.note for r in notes.collect()} == {2: linking.NO_SEEDS, 3: linking.NO_ENTITIES}
    links = linking.link(n, spark.createDataFrame([(1, 0, "camera sony")], "query_id int, entity_rank int, entity string")).collect()
    assert [r.node for r in links] == ["p1", "brand:sony"] or [r.node for r in links][0] in ("p1", "brand:sony")


def sequential(n, edges, resolution, seed=0):
    """Louvain: one node after the other takes its best community; communities become nodes, until nothing gains."""
    import random
    from collections import defaultdict

    rng = random.Random(seed)
    label, graph_edges = list(range(n)), [(u, v, w) for u, v, w in edges]
    while True:
        near, k = defaultdict(lambda: defaultdict(float)), defaultdict(float)
        for u, v, w in graph_edges:
            k[u] += w
            k[v] += w
            if u != v:
                near[u][v] += w
                near[v][u] += w
        two_m, own = sum(k.values()), {x: x for x in k}
        total = dict(k)
        moved, any_moved = True, False
        while moved:
            moved = False
            for x in rng.sample(sorted(k), len(k)):
                to = defaultdict(float)
                for y, w in near[x].items():
                    to[own[y]] += w
                total[own[x]] -= k[x]
                gain = lambda c: to[c] - resolution * k[x] * total[c] / two_m
                best = max([own[x], *to], key=lambda c: (gain(c), c == own[x]))
                if gain(best) > gain(own[x]) + 1e-12:
                    own[x], moved, any_moved = best, True, True
                total[own[x]] += k[x]
        if not any_moved:
            return label
        label = [own.get(c, c) for c in label]
        merged = defaultdict(float)
        for u, v, w in graph_edges:
            merged[min(own[u], own[v]), max(own[u], own[v])] += w
        graph_edges = [(u, v, w) for (u, v), w in merged.items()]


def test_communities_are_as_good_as_sequential_ones(spark):
    import random

    rng = random.Random(12)
    n, resolution = 90, 1.0
    data = [(u, v, 1.0) for u in range(n) for v in range(u) if rng.random() < (0.35 if u % 5 == v % 5 else 0.03)]
    e = spark.createDataFrame(data, "u long, v long, w double")
    every = spark.range(n).select(F.col("id").alias("node"))
    ours = communities.modularity(e, communities.partition(every, e, resolution), resolution)
    theirs = []
    for seed in range(3):
        label = sequential(n, data, resolution, seed)
        theirs.append(communities.modularity(e, spark.createDataFrame(list(enumerate(label)), "node long, community long"), resolution))
    assert ours > 0.97 * max(theirs) > 0.2


def test_linked_products_and_some_reviews(spark):
    from graphloom.sources.catalog import linked_only, sample_reviews

    shape = "parent_asin string, title string, details map<string,string>, categories array<array<string>>, bought_together array<string>, also_buy array<string>"
    rows = [
        ("a", "A", {}, [], ["x"], None), ("b", "B", {"Brand": "k"}, None, None, None), ("c", "C", {}, [["t"]], [], []), ("d", "D", None, [], [], ["y"]),
        ("e", "E", {"Size": "1"}, [], [], []), ("f", "", {"Brand": "k"}, [["t"]], ["x"], ["y"]), ("g", None, {"Brand": "k"}, [], [], []), ("h", "H", None, None, None, None),
    ]
    assert sorted(r.parent_asin for r in linked_only(spark.createDataFrame(rows, shape)).collect()) == ["a", "b", "c", "d"]
    reviews = spark.createDataFrame([(p, i) for p, n in (("a", 5), ("b", 2)) for i in range(n)], "parent_asin string, review_ord int")
    assert sorted(map(tuple, sample_reviews(reviews.repartition(3)).collect())) == [("a", 0), ("a", 1), ("a", 2), ("b", 0), ("b", 1)]


def test_induced_edges_around_a_hub(spark):
    e = edges(spark, [("hub", f"p{i}") for i in range(30)] + [("p1", "p2"), ("p3", "p3")], "has_brand")
    members = spark.createDataFrame([(q, "hub") for q in range(8)] + [(q, f"p{q}") for q in range(8)] + [(1, "p2"), (3, "p3")], "query_id int, node string")
    got = sorted((r.query_id, r.u, r.v) for r in graph.induced_edges(e, members).collect())
    ends = {(r.u, r.v) for r in e.collect()}
    own = {q: {n for x, n in map(tuple, members.collect()) if x == q} for q in range(8)}
    assert got == sorted((q, u, v) for q in own for u, v in ends if u in own[q] and v in own[q])


def sent(spark) -> int:
    """Rows that the session's stages have shuffled so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, none, None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.fixture
def no_broadcast(spark):
    """Joins as on large tables."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_induced_edges_send_a_node_once_a_bucket(spark, no_broadcast):
    import random

    rng = random.Random(3)
    e = edges(spark, [(f"p{i}", f"p{j}") for i in range(50) for j in range(i)])
    members = spark.createDataFrame([(q, f"p{i}") for q in range(64) for i in range(50) if rng.random() < 0.9], "query_id int, node string")
    before = sent(spark)
    n = graph.induced_edges(e, members).count()
    assert 0 < sent(spark) - before < n
    assert n == sum(k * (k - 1) // 2 for (k,) in members.groupBy("query_id").count().select("count").collect())


def test_baskets_meet_at_their_order_once(spark, no_broadcast, tmp_path):
    import shutil
    from collections import Counter

    from graphloom.sources.catalog import from_star_schema

    for t in ("part", "nation", "region"):
        shutil.copy(f"/root/testdata/sf0.001/{t}.parquet", tmp_path / f"{t}.parquet")
    odd = [(1, 1, 3), (1, 1, 3), (1, 2, 4), (1, 2, 4), (1, 3, None), (1, 4, 5), (None, 1, 3), (None, 2, 9), (2, None, 3), (2, 1, 9), (2, 3, 10_000), (2, 2, None), (3, -1, 6), (3, 0, 6), (3, 1, 7)]
    rows = odd + [(o, n, 20 + n) for o in range(10, 410) for n in range(1, 6)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    before = sent(spark)
    got = {r.row_ord: r for r in from_star_schema(spark, str(tmp_path)).select("row_ord", "bought_together", "also_buy").collect()}
    assert 0 < sent(spark) - before < 2 * len(rows)
    for step, least, name in ((1, 2, "bought_together"), (2, 1, "also_buy")):
        pairs = Counter((a[2], b[2]) for a in rows for b in rows if a[0] is not None and a[1] is not None and b[1] is not None and a[0] == b[0] and b[1] == a[1] + step)
        for p, r in got.items():
            found = sorted(((-n, -1 if o is None else o) for (a, o), n in pairs.items() if a == p and n >= least))
            assert r[name] == [None if o == -1 else f"p:{o}" for _, o in found]


def test_terms_stay_with_their_text(spark, no_broadcast):
    docs = spark.createDataFrame([(f"p{i}", " ".join(f"word{i % 7}x{j}" for j in range(20))) for i in range(300)], "node_id string, text string")
    before = sent(spark)
    n = features.terms(docs).count()
    assert n == 300 * 39 and 0 < sent(spark) - before < n


def test_induced_edges_match_brute_force(spark, monkeypatch):
    import random

    from graphloom.operators import induced

    rng = random.Random(11)
    nodes = ["", "é", "😀x", *map(str, range(3, 30))]
    ends = [(rng.choice([None, *nodes]), nodes[min(rng.randrange(30), rng.randrange(30))], rng.choice(["a", "ß", "", None]), rng.choice([None, 0.5, 2.0])) for _ in range(300)]
    e = spark.createDataFrame(ends, "u string, v string, type string, weight double")
    named = [(rng.choice([None, *range(40)]), rng.choice([None, *nodes])) for _ in range(600)]  # some twice
    members = spark.createDataFrame(named, "query_id long, node string").repartition(3)
    own = {(q, n) for q, n in named if q is not None and n is not None}
    told = sorted(((q, *x) for q in range(40) for x in ends if (q, x[0]) in own and (q, x[1]) in own), key=repr)
    for queries, hot, pairs in ((256, 1 << 17, 1 << 20), (3, 9, 2)):
        monkeypatch.setattr(induced, "QUERIES", queries)
        monkeypatch.setattr(induced, "HOT", hot)
        monkeypatch.setattr(induced, "PAIRS", pairs)
        assert sorted(map(tuple, graph.induced_edges(e, members).collect()), key=repr) == told
    assert graph.induced_edges(e, members.limit(0), ("weight",)).collect() == [] == graph.induced_edges(e.limit(0), members).collect()


def test_lookup_matches_brute_force(spark):
    import random

    from graphloom.functions.fuzzy import token_set_ratio
    from graphloom.operators import lookup

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcé😀") for _ in range(rng.randrange(1, 5)))
    texts = [" ".join(word() for _ in range(rng.randrange(0, 6))) for _ in range(150)] * 2 + [None, "", "  a  b "]
    needles = [" ".join(word() for _ in range(rng.randrange(1, 4))) for _ in range(60)] + ["", None, "a", "a", "b a", " "]
    t = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    n = spark.createDataFrame([(x,) for x in needles], "needle string")
    got = lookup.containing(t, "t", n).collect()
    told = {(i, x) for i, text in enumerate(texts) for x in needles if x and text is not None and x in text}
    assert {(r.i, r.needle) for r in got} == told and len(got) == len(told)
    for cutoff in (80.0, 45.0, 0.0):
        near = lookup.resembling(t, "t", n, cutoff).collect()
        ratio = {(i, x): token_set_ratio(x, text) for i, text in enumerate(texts) for x in needles if x and text is not None}
        assert {(r.i, r.needle): r.ratio for r in near} == {k: v for k, v in ratio.items() if v >= cutoff and v > 0}
    none = n.filter("needle = 'zz'")
    assert lookup.containing(t, "t", none).count() == 0 == lookup.resembling(t, "t", none, 80.0).count()


def test_lookup_in_rounds(spark, monkeypatch):
    from graphloom.operators import lookup

    whole = lookup.rounds
    monkeypatch.setattr(lookup, "rounds", lambda needles: whole(needles, 3))
    t = spark.createDataFrame([("x1 x2 x3 x4 x5 x6 x7",)], "t string")
    n = spark.createDataFrame([(f"x{i}",) for i in range(1, 9)], "needle string")
    assert {r.needle for r in lookup.containing(t, "t", n).collect()} == {f"x{i}" for i in range(1, 8)}


def test_drawn_nodes_start_at_the_first_of_each_entity(spark):
    names = {f"p{i}": f"Camera {i}" for i in range(8)} | {"b": None}
    n = nodes(spark, [*names], {"b": "brand"}, names)
    e = edges(spark, [("p0", "b"), ("p1", "b")], "has_brand")
    asked = spark.createDataFrame([(1, "camera", 1), (1, "CAMERA 7", 2), (1, "ca", 3), (2, "zzz", 1)], "query_id int, entity string, entity_rank int")
    got = {r.node: r.ord for r in graph.query_nodes(n, graph.adjacency(e), asked).collect()}
    assert got == {"p0": 1, "b": 2, "p1": 3, "p2": 4, "p3": 5, "p4": 6}


def test_paths_match_brute_force(spark):
    import random

    rng = random.Random(3)
    names = [f"n{i:02d}" for i in range(20)]
    pairs = sorted({tuple(sorted(rng.sample(names, 2))) for _ in range(30)} | {("hub", x) for x in names[:12]} | {("n03", "n03")})
    e = edges(spark, pairs)
    members = {(q, x) for q in range(4) for x in ["hub"] * (q != 3) + names if x == "hub" or rng.random() < 0.8}
    seeds = {(q, x): i for q in range(4) for i, x in enumerate(rng.sample(names, 2), 1)}
    m = spark.createDataFrame(sorted(members), "query_id int, node string")
    s = spark.createDataFrame([(q, x, i) for (q, x), i in seeds.items()], "query_id int, node string, seed_rank int")
    for length in (0, 1, 3):
        want = {}
        for q in range(4):
            found = {x: (i, [x]) for (p, x), i in seeds.items() if p == q and (q, x) in members}
            front = dict(found)
            for _ in range(length):
                new = {}
                for a, b in [*pairs, *[(b, a) for a, b in pairs]]:
                    if a in front and (q, b) in members and b not in found:
                        new[b] = min(new.get(b, (9, [])), (front[a][0], [*front[a][1], b]))
                front = new
                found |= new
            want |= {(q, x): way[1] for x, way in found.items()}
        got = graph.shortest_paths(m, e, s, length).collect()
        assert {(r.query_id, r.node): r.path for r in got} == want and len(got) == len(want)


def test_knn_of_copies_ties_and_extremes(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    base = rng.integers(-2, 3, (40, 6)).astype(np.float32)
    rows = [base[i % 40] for i in range(130)] + [base[0]] * 60 + [np.float32([1e25, 0, 0, 0, 0, 1]), np.float32([np.nan, 1, 1, 1, 1, 1])]
    df = spark.createDataFrame([(f"p:{i}", [float(x) for x in v]) for i, v in enumerate(rows)], "id string, embedding array<float>")
    for some in (df.filter("id not in ('p:190', 'p:191')"), df):
        got: dict[str, list] = {}
        for r in similarity.knn(some, some, 4, block=16).collect():
            got.setdefault(r.id, []).append((r["rank"], r.nbr, r.score))
        own = {r.id: np.array(r.embedding, np.float64) for r in some.collect()}
        for i, a in own.items():
            all_ = sorted((-float(a @ b), j) for j, b in own.items() if j != i and not np.isnan(a @ b))
            assert sorted(got.get(i, [])) == [(n + 1, j, -s) for n, (s, j) in enumerate(all_[:4])], i


def test_knn_tasks_give_no_more_than_they_must():
    """Many equal scores: a task used to give every tie of every query."""
    import numpy as np
    import pyarrow as pa

    v = np.ones((300, 8), "<f4")
    table = pa.table({"ids": pa.array([[f"p:{i:03}" for i in range(300)]], pa.list_(pa.string())), "matrix": pa.array([v.tobytes()], pa.binary())})
    out = similarity._pair_top(5)(table, table)
    assert out.num_rows == 300 * 5
    assert set(out.column("to").to_pylist()) == {f"p:{i:03}" for i in range(5)}


def _plans(monkeypatch, module):
    """The plans of what a module materializes."""
    found, write = [], module.materialize
    monkeypatch.setattr(module, "materialize", lambda df, label: (found.append(df._jdf.queryExecution().executedPlan().toString()), write(df, label))[1])
    return found


def test_neighbourhoods_meet_by_node_alone(spark, monkeypatch):
    """What a query has seen and what it meets come together once, not by joins keyed by the query."""
    e = edges(spark, [("p1", "b"), ("p2", "b"), ("p2", "p3"), ("p4", "p3"), ("p3", "p3")], "has_brand")
    seeds = spark.createDataFrame([(1, "p1", 1), (2, "p4", 1)], "query_id int, node string, seed_rank int")
    with monkeypatch.context() as m:
        plans = _plans(m, graph)
        members = graph.subgraph_nodes(graph.adjacency(e), seeds, 2)
    joins = [line for p in plans for line in p.split("\n") if "Join" in line]
    assert joins and not [j for j in joins if "query_id" in j]
    assert sorted((r.query_id, r.node, r.depth, r.ord) for r in members.collect()) == [(1, "b", 1, 2), (1, "p1", 0, 1), (1, "p2", 2, 3), (2, "p2", 2, 3), (2, "p3", 1, 2), (2, "p4", 0, 1)]


def test_a_round_joins_the_edges_of_free_nodes_alone(spark, monkeypatch):
    from graphloom.operators import communities

    pairs = [(f"n{i:03}", f"n{(i * 7 + 1) % 200:03}", 1.0) for i in range(200)]
    e = spark.createDataFrame(pairs, "u string, v string, w double")
    with monkeypatch.context() as m:
        plans = _plans(m, communities)
        labels = communities._move(e, 1.0, 2, 5)
    assert labels.count() == len({x for p in pairs for x in p[:2]}) == labels.select("node").distinct().count()
    rounds = [p for p in plans if "moved" in p]
    assert rounds and all(line.index("xxhash64") for p in rounds for line in p.split("\n") if "Filter" in line and "nbr" in line and "NOT (node" in line)


def test_a_bounded_graph_is_moved_in_one_task(spark, monkeypatch):
    import random

    rng = random.Random(3)
    pairs = {tuple(sorted((i, j))): rng.choice([1.0, 2.0, 0.37]) for i in range(60) for j in [rng.choice([i % 4 + 4 * rng.randrange(15), rng.randrange(60)]) for _ in range(3)]}
    e = spark.createDataFrame([(f"n{i:02}", f"n{j:02}", w) for (i, j), w in pairs.items()], "u string, v string, w double")
    every = spark.createDataFrame([(f"n{i:02}",) for i in range(62)], "node string")
    found = {}
    for small in (0, 30, communities.SMALL):  # by joins, by joins until the contracted graph is bounded, in a task
        monkeypatch.setattr(communities, "SMALL", small)
        found[small] = sorted(map(tuple, communities.partition(every, e, 1.0, levels=2, rounds=2, polish=1).collect()))
    assert found[0] == found[30] == found[communities.SMALL] and 2 < len({c for _, c in found[0]}) < 40
    monkeypatch.setattr(communities, "_move", None)
    assert communities.partition(every, e.filter("w > 9"), 1.0).count() == communities.partition(every, e, 1.0).count() == 62


def test_edge_lines_join_names_after_the_cut(spark):
    from graphloom.operators import summaries

    n = nodes(spark, ["p1", "p2", "p3"], {}, {"p1": "One", "p2": "Two", "p3": "Three"})
    e = edges(spark, [("p1", "p2"), ("p2", "p3")], "similar_to")
    groups = spark.createDataFrame([(7, "p1"), (7, "p2"), (7, "p3")], "community_id bigint, member string")
    lines = summaries.edge_lines(n, e, groups)
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Window ["), "names come above the window in the plan"
    assert sorted(r.line for r in lines.collect()) == ["- One --[similar_to]--> Two", "- Two --[similar_to]--> Three"]


def test_nodes_do_not_wait_for_the_search_of_neighbours(spark, monkeypatch):
    from graphloom.plans import inputs

    monkeypatch.setattr(similarity, "knn", None)
    built = inputs.build(spark, "/root/testdata/sf0.001")
    kinds = {r.type: r["count"] for r in built.nodes.groupBy("type").count().collect()}
    assert kinds["product"] == spark.read.parquet("/root/testdata/sf0.001/part.parquet").count() and kinds["feature"] > 0
    assert built.nodes.select("node_id").distinct().count() == sum(kinds.values())


def test_paths_are_told_as_they_grow(spark):
    e = edges(spark, [("s", "a"), ("a", "b"), ("s", "c"), ("c", "b"), ("b", "d"), ("s", "s")], "has_brand")
    n = nodes(spark, ["s", "a", "b", "c"], {}, {"s": "S" * 50, "a": "", "b": None, "c": "Cam"})  # d is no node
    seeds = spark.createDataFrame([(1, "s", 1), (2, "b", 1), (2, "a", 2)], "query_id int, node string, seed_rank int")
    members = graph.subgraph_nodes(graph.adjacency(e), seeds, 3)
    told = graph.shortest_paths(members, e, seeds, 3, n)
    paths = graph.shortest_paths(members, e, seeds, 3)
    assert sorted(map(str, told.select("query_id", "node", "path", "described").collect())) == sorted(map(str, graph.describe_paths(paths, n, e).select("query_id", "node", "path", "described").collect()))
    assert told.count() == 10 and told.filter("described is null").count() == 0


def test_only_near_products_are_scored(spark, monkeypatch):
    e = edges(spark, [("s", f"p{i}") for i in range(4)] + [("p0", "q0"), ("p1", "q1")], "has_brand")
    ids = ["s", "p0", "p1", "p2", "p3", "q0", "q1"]
    n = nodes(spark, ids, {"s": "brand"}, {i: f"name {i}" for i in ids})
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, embedding array<double>")
    entities = spark.createDataFrame([(1, 1, "name s")], "query_id int, entity_rank int, entity string")
    vectors = spark.createDataFrame([(x, [0.1 * i, 1.0]) for i, x in enumerate(ids)], "id string, embedding array<double>")
    for limit, expect in ((2, ["p3", "p2"]), (4, ["p3", "p2", "p1", "p0"]), (5, ["p3", "p2", "p1", "p0", "q1"])):
        with monkeypatch.context() as m:
            plans = _plans(m, linking)
            found, _ = linking.multi_hop(asked, n, e, entities, embeddings=vectors, limit=limit, fuzzy=False)
            assert [r.node for r in found.orderBy("rank").collect()] == expect
        assert any("nearer" in p and "nearer" in p[p.index("LeftOuter") :] for p in plans), "the cut by distance comes before the vectors"

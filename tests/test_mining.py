"""Baskets, rules, networks, similarity and clusters against plain computations."""

import itertools
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from commitlore.operators import baskets, clusters, communities, impact, neighbours, network, similarity


def files_of(spark, commits):
    rows = [(str(h), i, f) for h, names in enumerate(commits) for i, f in enumerate(names)]
    return spark.createDataFrame(rows, "hash string, pos long, file string")


def changes_of(spark, commits):
    return files_of(spark, commits).withColumnRenamed("file", "path")


def some_commits(n=120, seed=5, hot=False):
    rng = np.random.default_rng(seed)
    names = [f"f{i:02d}.py" for i in range(14)]
    out = [list(dict.fromkeys(rng.choice(names, rng.integers(1, 6)))) for _ in range(n)]
    if hot:
        # one commit with a third of all mentions
        out.append([f"only_here_{i}.txt" for i in range(sum(map(len, out)) // 2)] + names[:5])
    return [[str(f) for f in c] for c in out]


def pair_counts(commits, ordered=True):
    counts = Counter()
    for c in commits:
        firsts = list(dict.fromkeys(c))
        for a, b in itertools.combinations(firsts, 2):
            counts[(a, b) if ordered else tuple(sorted((a, b)))] += 1
    return counts


@pytest.mark.parametrize("ordered", [True, False])
@pytest.mark.parametrize("hot", [True, False])
def test_pairs(spark, ordered, hot):
    commits = some_commits(hot=hot)
    expected = pair_counts(commits, ordered)
    files = files_of(spark, commits)
    got = {(r["file_a"], r["file_b"]): r["commits"] for r in baskets.co_change_pairs(files, 0.03, ordered).collect()}
    assert got == {p: n for p, n in expected.items() if n >= 0.03 * len(commits)}
    got = {(r["file_a"], r["file_b"]): r["commits"] for r in baskets.co_change_pairs(files, ordered=ordered).collect()}
    assert got == expected
    top = [(r["file_a"], r["file_b"], r["commits"]) for r in baskets.top_pairs(files, 12, ordered, seeds=4).collect()]
    assert top == [(*p, n) for p, n in sorted(expected.items(), key=lambda x: (-x[1], x[0]))[:12]]


def test_pairs_of_a_commit_of_several_blocks(spark):
    names = [f"f{i}.py" for i in range(2 * baskets.BLOCK_FILES + 3)]
    got = {(r["file_a"], r["file_b"]): r["commits"] for r in baskets.co_change_pairs(files_of(spark, [names, names[:2], names[:1]])).collect()}
    assert got == pair_counts([names, names[:2], names[:1]])


def test_equal_lists_of_several_blocks_count_together(spark, monkeypatch):
    monkeypatch.setattr(baskets, "BLOCK_FILES", 3)
    names = [f"f{i}" for i in range(11)]
    commits = [names, names, names[::-1], names[:4], ["only"], names[:2] * 2]
    expected = {}
    for commit in commits:
        for a, b in itertools.combinations(list(dict.fromkeys(commit)), 2):
            expected[(a, b)] = expected.get((a, b), 0) + 1
    rows = baskets.co_change_pairs(files_of(spark, commits)).collect()
    assert len(rows) == len(expected) and {(r["file_a"], r["file_b"]): r["commits"] for r in rows} == expected


def test_a_commit_of_thousands_of_files(spark):
    files = spark.range(2000).selectExpr("'big' as hash", "id as pos", "concat('f', id) as file").unionByName(
        spark.createDataFrame([("a", 0, "f1"), ("a", 1, "f2"), ("b", 0, "f1"), ("b", 1, "f2")], "hash string, pos long, file string"))
    assert baskets.co_change_pairs(files).count() == 2000 * 1999 // 2
    assert [tuple(r) for r in baskets.top_pairs(files, 1).collect()] == [("f1", "f2", 3)]


def test_fewer_pairs_than_asked_for(spark):
    files = files_of(spark, [["a", "b"], ["a", "b"], ["c"]])
    assert [tuple(r) for r in baskets.top_pairs(files).collect()] == [("a", "b", 2)]


def test_pairs_are_symmetric(spark):
    commits = some_commits()
    both = pair_counts(commits, False)
    got = baskets.top_pairs(files_of(spark, commits), 1000, ordered=False).collect()
    assert {(r["file_a"], r["file_b"]): r["commits"] for r in got} == dict(both)


def supports(commits):
    sets = [frozenset(c) for c in commits]
    items = sorted(set().union(*sets))
    out = {}
    for k in range(1, 5):
        for combo in itertools.combinations(items, k):
            n = sum(set(combo) <= s for s in sets)
            if n:
                out[combo] = n
    return out


@pytest.mark.parametrize("bits", [12, 1])
def test_itemsets_and_rules(spark, monkeypatch, bits):
    monkeypatch.setattr(baskets, "MASK_BITS", bits)
    commits = some_commits(60)
    commits[0] += [".hidden", "dir/"]
    visible = [[f for f in c if f.startswith("f")] for c in commits]
    expected = {k: n for k, n in supports(visible).items() if n >= 0.05 * len(visible)}
    members = baskets.file_memberships(changes_of(spark, commits))
    found = baskets.frequent_itemsets(members, 0.05)
    got = {tuple(r["items"]): r["freq"] for r in found.collect()}
    assert got == expected
    rules = baskets.association_rules(found).collect()
    share = {k: n / len(visible) for k, n in expected.items()}
    wanted = {
        (a, tuple(x for x in items if x not in a))
        for items in share if len(items) > 1
        for k in range(1, len(items)) for a in itertools.combinations(items, k)
        if round(share[items] / share[a] / share[tuple(x for x in items if x not in a)], 9) >= 1
    }
    assert {(tuple(r["antecedents"]), tuple(r["consequents"])) for r in rules} == wanted
    for r in rules:
        assert r["lift"] == pytest.approx(r["confidence"] / r["consequent_support"])
        assert r["leverage"] == pytest.approx(r["support"] - r["antecedent_support"] * r["consequent_support"])


def test_splits_of_a_long_set_come_in_blocks(spark):
    names = [f"f{i:02d}" for i in range(16)]
    sets = [[n] for n in names] + [names]
    found = spark.createDataFrame([(s, len(s), 1, 0.5) for s in sets], "items array<string>, size int, freq long, support double")
    assert baskets.rule_support_lookup(found).count() == 0  # of both parts only one item each is known
    all_sets = [list(c) for k in range(1, 15) for c in itertools.combinations(names[:14], k)]
    found = spark.createDataFrame([(s, len(s), 1, 0.5) for s in all_sets if len(s) in (1, 13, 14)], "items array<string>, size int, freq long, support double")
    longest = baskets.rule_support_lookup(found).filter("size(antecedents) + size(consequents) = 14")
    assert longest.count() == 2 * 14


def test_support_falls_back(spark):
    # no file in 1 % of the commits, but some in half a percent
    commits = [[f"n{i}", f"n{i + 1}"] for i in range(0, 600, 2)] + [["a", "b"], ["a", "b"]]
    members = baskets.file_memberships(changes_of(spark, commits), min_count=1, max_files=None)
    low = baskets.frequent_itemsets(members, 0.01, 0.005)
    assert {tuple(r["items"]) for r in low.collect()} == {("a",), ("b",), ("a", "b")}
    assert baskets.frequent_itemsets(members, 0.01, None).isEmpty()


def test_basket_thresholds(spark):
    lonely = changes_of(spark, [["a"], ["a"], ["b"]])
    assert baskets.file_baskets(lonely).isEmpty()  # a single frequent file is not enough
    tied = changes_of(spark, [["b", "a", "c"], ["c", "a", "b"]])
    assert [r["files"] for r in baskets.file_baskets(tied, max_files=2).collect()] == [["a", "b"]] * 2
    assert baskets.file_baskets(changes_of(spark, [["x"]]).filter("false")).isEmpty()


def test_cooccurrence(spark):
    rows = baskets.cooccurrence_with_top(baskets.file_baskets(changes_of(spark, [["a", "b"], ["a", "b"], ["a", "c"], ["c", "a"], ["c", "a"]])))
    got = {(r["file"], r["partner"]): r["commits"] for r in rows.collect()}
    assert got == {("a", "c"): 3, ("a", "b"): 2, ("b", "a"): 2, ("c", "a"): 3}


def test_network_of_rules(spark):
    rules = spark.createDataFrame(
        [(["a"], ["b"], 2.0, 0.5, 0.1), (["a", "c"], ["b"], 3.0, 0.6, 0.05)],
        "antecedents array<string>, consequents array<string>, lift double, confidence double, support double",
    )
    found = network.association_network(rules)
    assert {(r["src"], r["dst"]): r["lift"] for r in found["edges"].collect()} == {("a", "b"): 3.0, ("c", "b"): 3.0}
    assert tuple(found["metrics"].first()) == (3, 2, pytest.approx(2 / 6))
    assert {r["node"]: (r["node_type"], r["degree"]) for r in found["nodes"].collect()} == {
        "a": ("antecedent", 1), "c": ("antecedent", 1), "b": ("consequent", 2),
    }


def test_influenced_files(spark):
    rules = spark.createDataFrame(
        [("{'a.py'}", "{'b.py'}"), ("{'a.py', 'z'}", "{'c.py'}"), ("{'a.py'}", "{'c.py', 'd'}"), ("{'q'}", "{'r'}"), ("{'a.py'}", "{'a.py'}"), ("{'axpy'}", "{'k'}")],
        "source string, target string",
    )
    assert [r["file"] for r in impact.influenced_files(rules, "a.py").collect()] == ["b.py", "c.py"]
    assert [r["file"] for r in impact.influenced_files(rules, "a.py", regex=True).collect()] == ["b.py", "c.py", "k"]


# --- vectors -------------------------------------------------------------------


def vectors(spark, data):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "id long, v array<double>")


@pytest.mark.parametrize("block, pivots", [(1024, 64), (7, 64), (16, 1)])
def test_similarity_graph(spark, monkeypatch, block, pivots):
    monkeypatch.setattr(similarity, "BLOCK_ROWS", block)
    monkeypatch.setattr(similarity, "MAX_PIVOTS", pivots)
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", block)
    rng = np.random.default_rng(2)
    data = np.concatenate([rng.normal(c, 0.3, (30, 3)) for c in (0, 2, 5)] + [np.zeros((25, 3))])
    nodes = similarity.vector_nodes(vectors(spark, data), "id", "v")
    assert nodes.agg(F.max("copies")).first()[0] == 25  # equal vectors are one node
    unique = {tuple(v): i for i, v in reversed(list(enumerate(data)))}
    ids, m = list(unique.values()), np.array(list(unique))
    d = np.sqrt(((m[:, None] - m[None]) ** 2).sum(-1))
    every = np.sqrt(((data[:, None] - data[None]) ** 2).sum(-1))  # copies count as rows
    sigma = np.median(every[np.triu_indices(len(data), 1)])
    cut = np.quantile(np.exp(-(every**2) / (2 * sigma**2)), 0.9)
    sim = np.exp(-(d**2) / (2 * sigma**2))
    found_sigma, found_cut = similarity.similarity_scale(nodes)
    assert (found_sigma, found_cut) == (pytest.approx(sigma), pytest.approx(cut))
    expected = {
        (min(ids[i], ids[j]), max(ids[i], ids[j])) for i in range(len(m)) for j in range(i) if sim[i, j] > cut
    }
    edges = similarity.similarity_graph(nodes, found_sigma, found_cut).collect()
    assert len(edges) == len(expected) and {(r["src"], r["dst"]) for r in edges} == expected


@pytest.mark.parametrize("block", [1024, 9])
def test_exact_silhouette(spark, monkeypatch, block):
    monkeypatch.setattr(similarity, "BLOCK_ROWS", block)
    rng = np.random.default_rng(4)
    data = rng.normal(0, 1, (41, 3))
    labels = np.array([0] * 20 + [1] * 20 + [2])
    d = np.sqrt(((data[:, None] - data[None]) ** 2).sum(-1))
    scores = []
    for i, own in enumerate(labels):
        same = (labels == own) & (np.arange(41) != i)
        if not same.any():
            scores.append(0.0)
            continue
        a, b = d[i, same].mean(), min(d[i, labels == o].mean() for o in set(labels) - {own})
        scores.append((b - a) / max(a, b))
    df = vectors(spark, data).withColumn("label", F.when(F.col("id") < 20, 0).when(F.col("id") < 40, 1).otherwise(2))
    assert similarity.silhouette_exact(df, "id", "v", "label").first()[0] == pytest.approx(np.mean(scores))


@pytest.mark.parametrize("block, pivots, k", [(1024, 4096, 4), (6, 4096, 4), (5, 1, 9), (7, 4096, 200)])
def test_nearest_neighbours(spark, monkeypatch, block, pivots, k):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", block)
    monkeypatch.setattr(neighbours, "MAX_PIVOTS", pivots)
    rng = np.random.default_rng(3)
    data = np.concatenate([rng.normal(c, 0.3, (30, 3)) for c in (0, 2, 5)] + [rng.integers(0, 3, (60, 3)).astype(float)])
    nodes = similarity.vector_nodes(vectors(spark, data), "id", "v")
    unique = {tuple(v): i for i, v in reversed(list(enumerate(data)))}
    expected = set()
    for v, i in unique.items():
        near = sorted((float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), j) for w, j in unique.items() if j != i)[:k]
        expected |= {(i, j, rank + 1) for rank, (_, j) in enumerate(near)}
    found = neighbours.nearest_neighbours(nodes, k).collect()
    assert len(found) == len(expected) and {(r["node"], r["neighbour"], r["rank"]) for r in found} == expected
    count = nodes.agg(F.max("copies")).first()[0]
    assert count > 1
    graph = neighbours.neighbour_graph(nodes, k).collect()
    copies = {r["node"]: r["copies"] for r in nodes.collect()}
    assert {(r["src"], r["dst"]): r["weight"] for r in graph} == {
        **{(min(i, j), max(i, j)): copies[i] * copies[j] for i, j, _ in expected}, **{(i, i): c * (c - 1) / 2 for i, c in copies.items() if c > 1}}


def test_scale_is_linear_and_counts_copies(spark):
    rng = np.random.default_rng(8)
    data = rng.integers(0, 3, (50, 2)).astype(float) + 1000
    d2 = ((data[:, None] - data[None]) ** 2).sum(-1)
    nodes = similarity.vector_nodes(vectors(spark, data), "id", "v")
    assert neighbours.mean_square_scale(nodes) == pytest.approx(math.sqrt(d2.sum() / (50 * 49)))
    none = similarity.vector_nodes(vectors(spark, data).filter("id < 0"), "id", "v")
    assert neighbours.mean_square_scale(none) == 0.0 and similarity.similarity_scale(none) == (0.0, 1.0)
    assert neighbours.nearest_neighbours(none).collect() == [] and neighbours.neighbour_graph(none).collect() == []
    same = similarity.vector_nodes(vectors(spark, np.ones((7, 2))), "id", "v")
    assert [tuple(r) for r in neighbours.neighbour_graph(same).collect()] == [(0, 0, 1.0, 21.0)]


def plain_quality(edges, label, resolution=1.0):
    total = sum(w for _, _, w in edges)
    inside, deg = {}, {}
    for a, b, w in edges:
        for x in (a, b):
            deg[label[x]] = deg.get(label[x], 0) + w
        if label[a] == label[b]:
            inside[label[a]] = inside.get(label[a], 0) + w
    return sum(inside.get(c, 0) / total - resolution * (deg[c] / (2 * total)) ** 2 for c in deg)


def test_no_move_betters_communities(spark):
    rng = np.random.default_rng(12)
    edges = [(int(a), int(b), float(rng.integers(1, 4))) for a, b in rng.integers(0, 60, (110, 2))]
    edges += [(100, a, 1.0) for a in range(0, 60, 2)] + [(200, 200, 5.0), (300, 301, 2.0), (301, 300, 1.0)]
    df = spark.createDataFrame(edges, "src long, dst long, weight double")
    rows = communities.graph_communities(df).collect()
    found = {r["node"]: r["community"] for r in rows}
    assert len(rows) == len(found) == len({x for a, b, _ in edges for x in (a, b)}) and found[200] == 200
    best = plain_quality(edges, found)
    for node in found:
        for other in set(found.values()):
            assert plain_quality(edges, {**found, node: other}) <= best + 1e-9
    for a, b in itertools.combinations(set(found.values()), 2):
        assert plain_quality(edges, {n: a if c == b else c for n, c in found.items()}) <= best + 1e-9
    for name in set(found.values()):  # connected, and named by the least member
        members = {n for n, c in found.items() if c == name}
        reached, todo = {name}, [name]
        while todo:
            n = todo.pop()
            for a, b, _ in edges:
                for x, y in ((a, b), (b, a)):
                    if x == n and y in members and y not in reached:
                        reached.add(y)
                        todo.append(y)
        assert reached == members and name == min(members)
    row = communities.community_quality(df, spark.createDataFrame(list(found.items()), "node long, community long")).first()
    assert row["nodes_that_gain"] == 0 and row["modularity"] == pytest.approx(best) and row["nodes"] == len(found)


@pytest.mark.parametrize("links", [1 << 18, 400])
def test_blocks_of_nodes_settle_in_few_rounds(spark, monkeypatch, links):
    rng = np.random.default_rng(5)
    pairs = {(min(a, b), max(a, b)) for a, b in rng.integers(0, 120, (420, 2)).tolist() if a != b} | {(0, i) for i in range(1, 90)}
    df = spark.createDataFrame([(a, b, 1.0) for a, b in sorted(pairs)], "src long, dst long, weight double")
    made, rounds = communities.best_moves, []
    monkeypatch.setattr(communities, "_BLOCK_LINKS", links)
    monkeypatch.setattr(communities, "best_moves", lambda *a: (rounds.append(1), made(*a))[1])
    found = communities.graph_communities(df) if links > 400 else communities.settled(communities._Graph(communities.stage(df.withColumnRenamed("weight", "w"))), df.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("community", F.col("node")), 1.0)[0]
    if links > 400:
        assert len(rounds) <= 10
    monkeypatch.undo()
    row = communities.community_quality(df, found).first()
    assert row["nodes"] == 120 and row["nodes_that_gain"] == 0 and row["modularity"] > 0.1


def test_graphs_without_edges_have_no_communities(spark):
    assert communities.graph_communities(spark.createDataFrame([], "src long, dst long, weight double")).collect() == []


def test_communities_of_two_cliques(spark):
    clique = [(a, b) for a, b in itertools.combinations(range(6), 2)]
    edges = [(a, b, 1.0) for a, b in clique] + [(a + 10, b + 10, 1.0) for a, b in clique] + [(0, 10, 1.0)]
    df = spark.createDataFrame(edges, "src long, dst long, weight double")
    found = {r["node"]: r["community"] for r in communities.graph_communities(df).collect()}
    assert len(set(found.values())) == 2 and len({found[i] for i in range(6)}) == 1
    labels = spark.createDataFrame(list(found.items()), "node long, label long")
    m, deg = 31, 31
    assert network.graph_modularity(df, labels).first()[0] == pytest.approx(2 * (15 / m - (deg / (2 * m)) ** 2))


def test_kmeans_finds_clusters(spark):
    rng = np.random.default_rng(1)
    data = np.concatenate([rng.normal(c, 0.1, (30, 2)) for c in (0, 5, 10)])
    found = clusters.kmeans_sweep(clusters.as_vectors(vectors(spark, data), "v"), max_clusters=4, restarts=2)
    assert found["best_k"] == 3 and sorted(r["rows"] for r in found["sizes"].collect()) == [30, 30, 30]
    assert "error" in clusters.kmeans_sweep(clusters.as_vectors(vectors(spark, data[:3]), "v"))


def test_balance(spark):
    one = spark.createDataFrame([(0,)] * 4, "cluster int")
    assert clusters.cluster_balance(one).first()["balance"] == 1.0
    two = one.union(spark.createDataFrame([(1,)] * 4, "cluster int"))
    assert clusters.cluster_balance(two).first()["balance"] == pytest.approx(1.0)


def test_principal_components(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(0, 1, (100, 4)) @ rng.normal(0, 1, (4, 4))
    df = spark.createDataFrame([tuple(map(float, r)) for r in base], "a double, b double, c double, d double")
    z = (base - base.mean(0)) / base.std(0)
    _, s, vt = np.linalg.svd(z, full_matrices=False)
    ratios = [r["ratio"] for r in clusters.pca_variance(df, df.columns).collect()]
    assert np.allclose(ratios, (s**2 / (s**2).sum())[:3])
    first = [abs(r["pc1"]) for r in clusters.pca_projection(df, df.columns, keep=df.columns).collect()]
    assert np.allclose(sorted(first), sorted(abs(z @ vt[0])))


def test_mining_counts_equal_baskets_once(spark, monkeypatch):
    """Sets grow from kinds of baskets, not from commits; both forms of pairs come from the lists that the first files have."""
    commits = [["a", "b", "c"]] * 200 + [["a", "b"]] * 150 + [["c", "d"]] * 40 + [["e"]] * 30 + [["a", "d", "e", "f"]] * 5
    changes = changes_of(spark, commits)
    members = baskets.file_memberships(changes)
    grown, sets = baskets._grown, []
    monkeypatch.setattr(baskets, "_grown", lambda s, *a: (sets.append(s.count()), grown(s, *a))[1])
    found = {tuple(r["items"]): (r["size"], r["freq"]) for r in baskets.frequent_itemsets(members, 0.01).collect()}
    assert sets == [5]
    want = Counter(x for c in commits for k in range(1, 5) for x in itertools.combinations(sorted(c), k))
    assert found == {k: (len(k), n) for k, n in want.items() if n >= 0.01 * len(commits)}
    files = changes.select("hash", "pos", F.col("path").alias("file"))
    made, counted = baskets._counted_baskets, []
    monkeypatch.setattr(baskets, "_counted_baskets", lambda m: (counted.append(1), made(m))[1])
    assert [tuple(r) for r in baskets.top_pairs(files, 2).collect()] == [("a", "b", 350), ("a", "c", 200)] and len(counted) == 1
    for seeds in (1, 2, 3, 64):  # also if the first files do not hold all that can lead
        rows = baskets.top_pairs(files, 4, ordered=False, seeds=seeds).collect()
        assert [tuple(r) for r in rows] == [("a", "b", 350), ("a", "c", 200), ("b", "c", 200), ("c", "d", 40)]

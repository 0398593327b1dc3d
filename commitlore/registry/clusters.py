"""Similarity graphs, clusterings and their evaluation."""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window, functions as F

from commitlore.operators import clusters, communities, neighbours, similarity
from commitlore.operators.features import expanded_vector, feature_table
from commitlore.registry.base import COMMITS, query, rounded
from commitlore.schema import DMM_COLUMNS, SIZE_COLUMNS
from commitlore.session import stage
from commitlore.sources.sample_views import VIEW_COLUMNS, commits, table

_V = "v AS (SELECT vec_id, label, embedding::double[] AS e FROM embeddings)"
_DIST = f"""{_V},
d AS (SELECT a.vec_id AS x, b.vec_id AS y, a.label AS la, b.label AS lb, list_distance(a.e, b.e) AS d FROM v a JOIN v b ON a.vec_id <> b.vec_id)"""
_GRAPH = f"""{_DIST},
sigma AS (SELECT median(d) AS s FROM d WHERE x < y),
sims AS (SELECT x, y, la, lb, exp(-d * d / (2 * s * s)) AS sim FROM d, sigma),
cut AS (SELECT quantile_cont(sim, 0.9) AS c FROM (SELECT sim FROM sims UNION ALL SELECT 1.0 FROM v)),
edges AS (SELECT x AS src, y AS dst, la, lb, sim FROM sims, cut WHERE x < y AND sim > c)"""


def _embeddings(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


def _graph(spark, sf_dir):
    """Pairs of rows: those of equal vectors too."""
    rows = _embeddings(spark, sf_dir)
    nodes = stage(similarity.vector_nodes(rows, "vec_id", "embedding"))
    named = rows.filter("vec_id is not null").select(F.col("vec_id").alias("node"), F.col("embedding").cast("array<double>").alias("vec"))
    return similarity.similarity_graph(named, *similarity.similarity_scale(nodes))


@query("similarity_scale", f"""WITH {_GRAPH} SELECT round(s, 6) AS sigma, round(c, 6) AS threshold FROM sigma, cut""")
def similarity_scale(spark, sf_dir):
    nodes = similarity.vector_nodes(_embeddings(spark, sf_dir), "vec_id", "embedding")
    found = similarity.similarity_scale(nodes)
    return rounded(spark.createDataFrame([found], "sigma double, threshold double"), "sigma", "threshold")


@query("similarity_graph", f"WITH {_GRAPH} SELECT src, dst, round(sim, 6) AS similarity FROM edges")
def similarity_graph(spark, sf_dir):
    return rounded(_graph(spark, sf_dir), "similarity")


@query("similarity_modularity", f"""WITH {_GRAPH},
m AS (SELECT cast(count(*) AS double) AS m FROM edges),
c AS (SELECT label, sum(i) AS i, sum(w) AS d FROM (
        SELECT la AS label, (la = lb)::int AS i, 1 AS w FROM edges UNION ALL SELECT lb, 0, 1 FROM edges) GROUP BY 1)
SELECT round(sum(i / m - (d / (2 * m)) ^ 2), 6) AS modularity FROM c, m""")
def similarity_modularity(spark, sf_dir):
    from commitlore.operators.network import labelled_modularity

    labels = _embeddings(spark, sf_dir).select(F.col("vec_id").alias("node"), "label")
    nodes = stage(similarity.vector_nodes(_embeddings(spark, sf_dir), "vec_id", "embedding").join(labels, "node"))
    links = stage(similarity.linked_labels(nodes, *similarity.similarity_scale(nodes)))
    return rounded(labelled_modularity(links), "modularity")


@query("graph_communities")
def graph_communities(spark, sf_dir):
    nodes = stage(similarity.vector_nodes(_embeddings(spark, sf_dir), "vec_id", "embedding"))
    return communities.graph_communities(neighbours.neighbour_graph(nodes))


# Vectors of three small whole numbers, many of them equal: rows (vec_id, e), nodes of distinct vectors, and what holds between them.
_COPIES = """r AS (SELECT vec_id, [floor(embedding[1]::double * 8), floor(embedding[2]::double * 8), floor(embedding[3]::double * 8)] AS e FROM embeddings),
n AS (SELECT e, min(vec_id) AS node, count(*) AS copies FROM r GROUP BY e)"""
_COPIES_GRAPH = f"""{_COPIES},
d AS (SELECT a.vec_id AS x, b.vec_id AS y, list_distance(a.e, b.e) AS d FROM r a JOIN r b ON a.vec_id < b.vec_id),
sigma AS (SELECT median(d) AS s FROM d),
cut AS (SELECT quantile_cont(sim, 0.9) AS c, any_value(s) AS s FROM (
  SELECT exp(-d * d / (2 * s * s)) AS sim, s FROM d, sigma UNION ALL SELECT exp(-d * d / (2 * s * s)), s FROM d, sigma UNION ALL SELECT 1.0, s FROM r, sigma))"""
_COPIES_NEAREST = f"""{_COPIES},
p AS (SELECT a.node, b.node AS neighbour, list_distance(a.e, b.e) AS distance FROM n a JOIN n b ON a.node <> b.node),
k AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY distance, neighbour) AS rank FROM p QUALIFY rank <= 15)"""


def _few_vectors(spark, sf_dir):
    e = F.col("embedding").cast("array<double>")
    vec = F.array(*[F.floor(F.element_at(e, i) * 8).cast("double") for i in (1, 2, 3)])
    return similarity.vector_nodes(_embeddings(spark, sf_dir).select("vec_id", vec.alias("vec")), "vec_id", "vec")


@query("similarity_scale_of_copies", f"WITH {_COPIES_GRAPH} SELECT round(s, 6) AS sigma, round(c, 6) AS threshold FROM cut")
def similarity_scale_of_copies(spark, sf_dir):
    found = similarity.similarity_scale(_few_vectors(spark, sf_dir))
    return rounded(spark.createDataFrame([found], "sigma double, threshold double"), "sigma", "threshold")


@query("similarity_graph_of_copies", f"""WITH {_COPIES_GRAPH},
g AS (SELECT a.node AS src, b.node AS dst, exp(-(list_distance(a.e, b.e) ^ 2) / (2 * s * s)) AS sim, (a.copies * b.copies)::double AS weight, c
      FROM n a JOIN n b ON a.node < b.node, cut)
SELECT src, dst, round(sim, 6) AS similarity, weight FROM g WHERE sim > c + 1e-12
UNION ALL SELECT node, node, 1.0, copies * (copies - 1) / 2 FROM n WHERE copies > 1""")
def similarity_graph_of_copies(spark, sf_dir):
    nodes = stage(_few_vectors(spark, sf_dir))
    sigma, cut = similarity.similarity_scale(nodes)
    return rounded(neighbours.weighted(similarity.similarity_graph(nodes, sigma, cut + 1e-12), nodes), "similarity")


@query("nearest_neighbours", f"""WITH {_DIST}, k AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY d, y) AS rank FROM d QUALIFY rank <= 15)
SELECT x AS node, y AS neighbour, round(d, 6) AS distance, rank::int AS rank FROM k""")
def nearest_neighbours(spark, sf_dir):
    nodes = similarity.vector_nodes(_embeddings(spark, sf_dir), "vec_id", "embedding")
    return rounded(neighbours.nearest_neighbours(nodes), "distance")


@query("neighbour_graph", f"""WITH {_COPIES_NEAREST},
sums AS (SELECT unnest([1, 2, 3]) AS i, unnest(e) AS v FROM r),
sigma AS (SELECT sqrt(2 * sum(v)) AS s FROM (SELECT var_samp(v) AS v FROM sums GROUP BY i)),
g AS (SELECT DISTINCT least(node, neighbour) AS src, greatest(node, neighbour) AS dst, distance FROM k)
SELECT src, dst, round(exp(-distance * distance / (2 * s * s)), 6) AS similarity, (a.copies * b.copies)::double AS weight
FROM g JOIN n a ON a.node = src JOIN n b ON b.node = dst, sigma
UNION ALL SELECT node, node, 1.0, copies * (copies - 1) / 2 FROM n WHERE copies > 1""")
def neighbour_graph(spark, sf_dir):
    return rounded(neighbours.neighbour_graph(stage(_few_vectors(spark, sf_dir))), "similarity")


@query("community_quality", f"""WITH {_COPIES_NEAREST}
SELECT count(*) AS nodes, true AS better_than_alone, 0 AS nodes_that_gain FROM n""")
def community_quality(spark, sf_dir):
    edges = stage(neighbours.neighbour_graph(stage(_few_vectors(spark, sf_dir))))
    found = communities.community_quality(edges, communities.graph_communities(edges))
    return found.select("nodes", (F.col("modularity") > 0).alias("better_than_alone"), F.col("nodes_that_gain").cast("int").alias("nodes_that_gain"))


_SILHOUETTE = """
per AS (SELECT x, la, lb, avg(d) AS m FROM d GROUP BY ALL),
ab AS (SELECT x, la, max(m) FILTER (la = lb) AS a, min(m) FILTER (la <> lb) AS b FROM per GROUP BY ALL)"""


@query("silhouette_rows", f"""WITH {_DIST},{_SILHOUETTE}
SELECT x AS node, la AS label, round(coalesce((b - a) / greatest(a, b), 0), 6) AS silhouette FROM ab""")
def silhouette_rows(spark, sf_dir):
    return rounded(similarity.silhouette_rows(_embeddings(spark, sf_dir), "vec_id", "embedding", "label"), "silhouette")


@query("silhouette_exact", f"WITH {_DIST},{_SILHOUETTE} SELECT round(avg(coalesce((b - a) / greatest(a, b), 0)), 6) AS silhouette FROM ab")
def silhouette_exact(spark, sf_dir):
    return rounded(similarity.silhouette_exact(_embeddings(spark, sf_dir), "vec_id", "embedding", "label"), "silhouette")


@query("silhouette", f"""WITH {_DIST.replace("list_distance(a.e, b.e) AS d", "list_distance(a.e, b.e) ^ 2 AS d")},{_SILHOUETTE}
SELECT round(avg(coalesce((b - a) / greatest(a, b), 0)), 6) AS silhouette FROM ab""")
def silhouette(spark, sf_dir):
    vectors = clusters.as_vectors(_embeddings(spark, sf_dir), "embedding")
    return rounded(clusters.silhouette(vectors, "label"), "silhouette")


@query("cluster_sizes", "SELECT label, count(*) AS \"rows\" FROM embeddings GROUP BY 1")
def cluster_sizes(spark, sf_dir):
    return clusters.cluster_sizes(_embeddings(spark, sf_dir), "label")


@query("cluster_balance", """WITH c AS (SELECT count(*) / sum(count(*)) OVER () AS p FROM embeddings GROUP BY label)
SELECT count(*) AS n_clusters, round(-sum(p * log2(p + 1e-8)) / log2(count(*)), 6) AS balance FROM c""")
def cluster_balance(spark, sf_dir):
    return rounded(clusters.cluster_balance(_embeddings(spark, sf_dir), "label"), "balance")


@query("cluster_report", f"""WITH {_DIST.replace("list_distance(a.e, b.e) AS d", "list_distance(a.e, b.e) ^ 2 AS d")},{_SILHOUETTE},
c AS (SELECT count(*) / sum(count(*)) OVER () AS p FROM embeddings GROUP BY label)
SELECT 'given' AS method, (SELECT round(avg(coalesce((b - a) / greatest(a, b), 0)), 6) FROM ab) AS silhouette,
       count(*) AS n_clusters, round(-sum(p * log2(p + 1e-8)) / log2(count(*)), 6) AS balance FROM c""")
def cluster_report(spark, sf_dir):
    vectors = clusters.as_vectors(_embeddings(spark, sf_dir), "embedding")
    return rounded(clusters.cluster_report({"given": vectors}, "label"), "silhouette", "balance")


_NUMBERS = [*SIZE_COLUMNS, *DMM_COLUMNS]


@query("clustering_features", f"""WITH {COMMITS},
r AS (SELECT unnest(['deletions', 'insertions', 'lines', 'files', 'dmm_unit_size', 'dmm_unit_complexity', 'dmm_unit_interfacing']) AS feature,
  unnest([false, abs(corr(insertions, deletions)) > 0.95, abs(corr(lines, deletions)) > 0.95 OR abs(corr(lines, insertions)) > 0.95,
    abs(corr(files, deletions)) > 0.95 OR abs(corr(files, insertions)) > 0.95 OR abs(corr(files, lines)) > 0.95, false, false, false]) AS redundant FROM commits),
u AS (UNPIVOT (SELECT hash, deletions::double AS deletions, insertions::double AS insertions, lines::double AS lines, files::double AS files,
  coalesce(dmm_unit_size, (SELECT median(dmm_unit_size) FROM commits)) AS dmm_unit_size,
  coalesce(dmm_unit_complexity, (SELECT median(dmm_unit_complexity) FROM commits)) AS dmm_unit_complexity,
  coalesce(dmm_unit_interfacing, (SELECT median(dmm_unit_interfacing) FROM commits)) AS dmm_unit_interfacing FROM commits)
  ON COLUMNS(* EXCLUDE hash) INTO NAME feature VALUE value)
SELECT feature, count(*) AS "rows", round(avg(value), 6) AS mean FROM u SEMI JOIN (SELECT * FROM r WHERE NOT redundant) USING (feature) GROUP BY 1""")
def clustering_features(spark, sf_dir):
    df = commits(spark, sf_dir, "hash", *_NUMBERS).withColumn("grid_index", F.lit(1)).withColumn("one", F.lit(1))
    chosen = clusters.clustering_features(df, keep=("hash",))
    columns = [c for c in chosen.columns if c != "hash"]
    long = chosen.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])).alias("x")).select("x.*")
    return rounded(long.groupBy("feature").agg(F.count("*").alias("rows"), F.avg("value").alias("mean")), "mean")


def _commit_vectors(spark, sf_dir):
    features = stage(feature_table(stage(commits(spark, sf_dir, *VIEW_COLUMNS)), keep_hash=True))
    table_ = clusters.clustering_features(features, keep=("hash",))
    return clusters.assembled(table_, [c for c in table_.columns if c != "hash"]).select("hash", "features")


@query("kmeans_sweep")
def kmeans_sweep(spark, sf_dir):
    vectors = clusters.as_vectors(_embeddings(spark, sf_dir), "embedding")
    return clusters.kmeans_sweep(vectors)["scores"]


@query("kmeans_settled", """SELECT count(*) AS "rows", 0 AS nearer_elsewhere, true AS centers_are_means, true AS more_clusters_less_inertia FROM embeddings""")
def kmeans_settled(spark, sf_dir):
    """The clustering of the best k: no row has a nearer centre, centres are the means of their rows; inertia falls as k grows."""
    vectors = clusters.as_vectors(_embeddings(spark, sf_dir), "embedding").select("vec_id", "features")
    found = clusters.kmeans_sweep(vectors)
    rows = stage(found["labels"].select("vec_id", vector_to_array("features").alias("x"), "cluster"))
    off = F.aggregate(F.zip_with("x", "center", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    far = rows.crossJoin(F.broadcast(found["centers"].withColumnRenamed("cluster", "other"))).withColumn("d", off)  # ten centres at most
    nearest = far.groupBy("vec_id").agg(F.min("d").alias("least"), F.max(F.when(F.col("cluster") == F.col("other"), F.col("d"))).alias("own"))
    means = rows.select("cluster", F.posexplode("x").alias("i", "v")).groupBy("cluster", "i").agg(F.avg("v").alias("mean"))
    apart = means.join(found["centers"], "cluster").agg(F.max(F.abs(F.col("mean") - F.element_at("center", F.col("i") + 1))).alias("apart"))
    falls = found["scores"].select((F.col("inertia") <= F.coalesce(F.lag("inertia").over(Window.orderBy("k")), F.col("inertia")) * 1.02).alias("falls"))
    return nearest.agg(F.count("*").alias("rows"), F.sum((F.col("own") > F.col("least") + 1e-9).cast("int")).cast("int").alias("nearer_elsewhere")).crossJoin(
        apart.select((F.col("apart") < 0.02).alias("centers_are_means"))).crossJoin(falls.agg(F.min("falls").alias("more_clusters_less_inertia")))


@query("kmeans_commit_sizes")
def kmeans_commit_sizes(spark, sf_dir):
    return clusters.kmeans_sweep(_commit_vectors(spark, sf_dir))["sizes"]


def _wide(spark, sf_dir):
    vectors = clusters.as_vectors(_embeddings(spark, sf_dir), "embedding", "v").select("vec_id", "v")
    size = len(_embeddings(spark, sf_dir).first()["embedding"])
    return expanded_vector(vectors, "v", "e", size), [f"e{i}" for i in range(size)]


@query("pca_projection")
def pca_projection(spark, sf_dir):
    df, columns = _wide(spark, sf_dir)
    return clusters.pca_projection(df, columns, keep=("vec_id",))


@query("pca_variance")
def pca_variance(spark, sf_dir):
    return clusters.pca_variance(*_wide(spark, sf_dir))


@query("pca_loadings")
def pca_loadings(spark, sf_dir):
    return clusters.pca_loadings(*_wide(spark, sf_dir))


@query("fixed_kmeans_profile")
def fixed_kmeans_profile(spark, sf_dir):
    df = commits(spark, sf_dir, "hash", "author", *_NUMBERS)
    return clusters.fixed_kmeans_profile(df, _NUMBERS)["points"]

"""Baskets, frequent sets, rules and file networks."""

from pyspark.sql import functions as F

from commitlore.operators import baskets, network
from commitlore.registry.base import FILE_CHANGES, query, rounded
from commitlore.sources.sample_views import file_changes

# --- SQL pieces ----------------------------------------------------------------

_VISIBLE = f"""{FILE_CHANGES},
visible AS (SELECT hash, pos, split_part(path, '/', -1) AS file FROM file_changes WHERE NOT contains(path, '/.'))"""

_MEMBERS = f"""{_VISIBLE},
frequent AS (SELECT file, count(*) AS mentions FROM visible GROUP BY 1 HAVING count(*) >= 2),
kept AS (SELECT file FROM frequent ORDER BY mentions DESC, file LIMIT 100),
members AS (SELECT DISTINCT hash, file FROM visible SEMI JOIN kept USING (file)),
total AS (SELECT count(DISTINCT hash) AS t FROM members)"""


def _sets_sql(min_support):
    """Sets of one to five files by self joins."""
    unions = []
    for n in range(1, 6):
        names = " || '|' || ".join(f"m{i}.file" for i in range(n))
        joins = " ".join(
            f"JOIN members m{i} ON m{i}.hash = m0.hash AND m{i}.file > m{i - 1}.file" for i in range(1, n)
        )
        unions.append(f"SELECT {names} AS items, {n} AS size, count(*) AS freq FROM members m0 {joins} GROUP BY 1")
    return f"""{_MEMBERS},
itemsets AS (SELECT items, size, freq, freq / t AS support FROM ({" UNION ALL ".join(unions)}), total WHERE freq >= {min_support} * t)"""


# Every split of a set into two parts, by bit masks over its item list.
def _rules_sql(min_support):
    return f"""{_sets_sql(min_support)},
listed AS (SELECT *, string_split(items, '|') AS l FROM itemsets WHERE size >= 2),
splits AS (SELECT l, support, unnest(range(1, (1 << size) - 1)) AS mask FROM listed),
sides AS (SELECT support,
  array_to_string(list_filter(l, lambda x, i: (mask >> (i - 1)) % 2 = 1), '|') AS antecedents,
  array_to_string(list_filter(l, lambda x, i: (mask >> (i - 1)) % 2 = 0), '|') AS consequents FROM splits),
measured AS (SELECT antecedents, consequents, a.support AS sa, c.support AS sc, sides.support AS support
  FROM sides JOIN itemsets a ON a.items = antecedents JOIN itemsets c ON c.items = consequents),
rules AS (SELECT antecedents, consequents, sa AS antecedent_support, sc AS consequent_support, support,
  support / sa AS confidence, support / sa / sc AS lift, support - sa * sc AS leverage,
  (1 - sc) / (1 - support / sa) AS conviction FROM measured WHERE round(support / sa / sc, 9) >= 1),
top_rules AS (SELECT * FROM rules ORDER BY round(lift, 9) DESC, replace(antecedents, '|', chr(1)), replace(consequents, '|', chr(1)) LIMIT 50)"""


_METRICS = ["antecedent_support", "consequent_support", "support", "confidence", "lift", "leverage", "conviction"]
_METRICS_SQL = ", ".join(f"round({m}, 6) + 0.0e0 AS {m}" for m in _METRICS)

# The edges of the strongest rules.
_EDGES = """
picked AS (SELECT * FROM top_rules ORDER BY round(lift, 9) DESC, replace(antecedents, '|', chr(1)), replace(consequents, '|', chr(1)) LIMIT 20),
pairs AS (SELECT src, unnest(string_split(consequents, '|')) AS dst, lift, confidence, support
          FROM (SELECT unnest(string_split(antecedents, '|')) AS src, * FROM picked)),
edges AS (SELECT src, dst, max({lift: lift, confidence: confidence, support: support}) AS b FROM pairs GROUP BY 1, 2)"""

_FIRST = f"""{FILE_CHANGES}, firsts AS (SELECT hash, filename AS file, min(pos) AS pos FROM file_changes GROUP BY 1, 2)"""
_PAIRS = f"""{_FIRST},
pairs AS (SELECT a.file AS file_a, b.file AS file_b, count(*) AS commits
          FROM firsts a JOIN firsts b ON a.hash = b.hash AND a.pos < b.pos GROUP BY 1, 2)"""


def _files(spark, sf_dir):
    return file_changes(spark, sf_dir).select("hash", "pos", F.col("filename").alias("file"))


def _members(spark, sf_dir):
    return baskets.file_memberships(file_changes(spark, sf_dir))


def _rules(spark, sf_dir, min_support=baskets.MIN_SUPPORT):
    return baskets.association_rules(baskets.frequent_itemsets(_members(spark, sf_dir), min_support))


def _shown(df):
    names = {c: F.concat_ws("|", c) for c in ("items", "antecedents", "consequents") if c in df.columns}
    return df.withColumns(names)


# --- baskets -------------------------------------------------------------------


@query("distinct_files", f"WITH {_VISIBLE} SELECT DISTINCT file FROM visible")
def distinct_files(spark, sf_dir):
    return baskets.distinct_files(file_changes(spark, sf_dir))


@query("min_frequency_files", f"WITH {_VISIBLE} SELECT file, count(*) AS mentions FROM visible GROUP BY 1 HAVING count(*) >= 2")
def min_frequency_files(spark, sf_dir):
    return baskets.min_frequency_files(baskets.visible_files(file_changes(spark, sf_dir)))


@query("top_files_cap", f"""WITH {_VISIBLE}
SELECT file, count(*) AS mentions FROM visible GROUP BY 1 HAVING count(*) >= 2 ORDER BY 2 DESC, 1 LIMIT 10""")
def top_files_cap(spark, sf_dir):
    return baskets.top_files_cap(baskets.min_frequency_files(baskets.visible_files(file_changes(spark, sf_dir))), 10)


@query("basket_membership", f"WITH {_MEMBERS} SELECT * FROM members")
def basket_membership(spark, sf_dir):
    return _members(spark, sf_dir)


@query("basket_membership_by_path", f"""WITH {FILE_CHANGES},
dirs AS (SELECT hash, regexp_extract(path, '^(.*)/[^/]*$', 1) AS d FROM file_changes),
frequent AS (SELECT d, count(*) AS n FROM dirs GROUP BY 1 HAVING count(*) >= 2)
SELECT DISTINCT hash, d AS file FROM dirs SEMI JOIN frequent USING (d)""")
def basket_membership_by_path(spark, sf_dir):
    from commitlore.functions.text import directory

    # directories in place of files, and no cap
    dirs = file_changes(spark, sf_dir).select("hash", "pos", directory("path").alias("file"))
    return baskets.basket_membership(dirs, baskets.min_frequency_files(dirs))


@query("file_baskets", f"""WITH {_MEMBERS} SELECT hash, string_agg(file, '|' ORDER BY file) AS files FROM members GROUP BY 1""")
def file_baskets(spark, sf_dir):
    return baskets.file_baskets(file_changes(spark, sf_dir)).withColumn("files", F.concat_ws("|", "files"))


@query("basket_totals", f"WITH {_MEMBERS} SELECT count(DISTINCT file) AS total_files, count(DISTINCT hash) AS total_commits FROM members")
def basket_totals(spark, sf_dir):
    return baskets.basket_totals(_members(spark, sf_dir))


@query("file_frequencies", f"""WITH {_MEMBERS}
SELECT file, count(*) AS commits, round(count(*) / any_value(t), 6) AS rate FROM members, total GROUP BY 1""")
def file_frequencies(spark, sf_dir):
    return rounded(baskets.file_frequencies(_members(spark, sf_dir)), "rate")


@query("cooccurrence_with_top", f"""WITH {_MEMBERS},
top AS (SELECT file, count(*) AS modifications FROM members GROUP BY 1 HAVING count(*) > 1 ORDER BY 2 DESC, 1 LIMIT 20),
p AS (SELECT a.file, modifications, b.file AS partner, count(*) AS commits
      FROM top a JOIN members m USING (file) JOIN members b ON b.hash = m.hash AND b.file <> a.file GROUP BY 1, 2, 3)
SELECT file, modifications, round(modifications / t, 6) AS rate, partner, commits, cast(rank AS int) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY file ORDER BY commits DESC, partner) AS rank FROM p), total WHERE rank <= 5""")
def cooccurrence_with_top(spark, sf_dir):
    return rounded(baskets.cooccurrence_with_top(baskets.file_baskets(file_changes(spark, sf_dir))), "rate")


# --- pairs ---------------------------------------------------------------------


@query("co_change_pairs", f"""WITH {_PAIRS} SELECT * FROM pairs""")
def co_change_pairs(spark, sf_dir):
    return baskets.co_change_pairs(_files(spark, sf_dir))


@query("co_change_pairs_unordered", f"""WITH {_PAIRS}
SELECT least(file_a, file_b) AS file_a, greatest(file_a, file_b) AS file_b, cast(sum(commits) AS bigint) AS commits
FROM pairs GROUP BY 1, 2""")
def co_change_pairs_unordered(spark, sf_dir):
    return baskets.co_change_pairs(_files(spark, sf_dir), ordered=False)


@query("top_pairs", f"WITH {_PAIRS} SELECT * FROM pairs ORDER BY commits DESC, file_a, file_b LIMIT 20")
def top_pairs(spark, sf_dir):
    return baskets.top_pairs(_files(spark, sf_dir))


@query("co_change_network", f"""WITH {_PAIRS}
SELECT least(file_a, file_b) AS src, greatest(file_a, file_b) AS dst, cast(sum(commits) AS bigint) AS weight,
       substr(least(file_a, file_b), 1, 15) AS src_label, substr(greatest(file_a, file_b), 1, 15) AS dst_label
FROM pairs GROUP BY ALL ORDER BY weight DESC, src, dst LIMIT 20""")
def co_change_network(spark, sf_dir):
    return network.co_change_network(_files(spark, sf_dir))


# --- sets and rules ------------------------------------------------------------


@query("frequent_itemsets", f"WITH {_sets_sql(0.01)} SELECT items, size, freq, round(support, 6) AS support FROM itemsets")
def frequent_itemsets(spark, sf_dir):
    return rounded(_shown(baskets.frequent_itemsets(_members(spark, sf_dir))), "support")


@query("frequent_itemsets_low_support", f"WITH {_sets_sql(0.002)} SELECT items, size, freq, round(support, 6) AS support FROM itemsets")
def frequent_itemsets_low_support(spark, sf_dir):
    return rounded(_shown(baskets.frequent_itemsets(_members(spark, sf_dir), 0.002)), "support")


@query("itemset_statistics", f"""WITH {_sets_sql(0.01)}
SELECT count(*) AS total_itemsets, round(avg(support), 6) AS avg_support, round(max(support), 6) AS max_support FROM itemsets""")
def itemset_statistics(spark, sf_dir):
    df = baskets.itemset_statistics(baskets.frequent_itemsets(_members(spark, sf_dir)))
    return rounded(df, "avg_support", "max_support")


@query("itemset_sizes", f"WITH {_sets_sql(0.002)} SELECT size, count(*) AS itemsets FROM itemsets GROUP BY 1")
def itemset_sizes(spark, sf_dir):
    return baskets.itemset_sizes(baskets.frequent_itemsets(_members(spark, sf_dir), 0.002))


@query("rule_support_lookup", f"""WITH {_rules_sql(0.002)}
SELECT antecedents, consequents, round(sa, 6) AS antecedent_support, round(sc, 6) AS consequent_support, round(support, 6) AS support FROM measured""")
def rule_support_lookup(spark, sf_dir):
    sets = baskets.frequent_itemsets(_members(spark, sf_dir), 0.002)
    return rounded(_shown(baskets.rule_support_lookup(sets)), "antecedent_support", "consequent_support", "support")


@query("association_rules", f"WITH {_rules_sql(0.01)} SELECT antecedents, consequents, {_METRICS_SQL} FROM rules")
def association_rules(spark, sf_dir):
    return rounded(_shown(_rules(spark, sf_dir)), *_METRICS)


@query("association_rules_low_support", f"WITH {_rules_sql(0.002)} SELECT antecedents, consequents, {_METRICS_SQL} FROM rules")
def association_rules_low_support(spark, sf_dir):
    return rounded(_shown(_rules(spark, sf_dir, 0.002)), *_METRICS)


@query("top_rules", f"WITH {_rules_sql(0.01)} SELECT antecedents, consequents, {_METRICS_SQL} FROM top_rules")
def top_rules(spark, sf_dir):
    return rounded(_shown(baskets.top_rules(_rules(spark, sf_dir))), *_METRICS)


@query("strong_rules", f"""WITH {_rules_sql(0.01)} SELECT antecedents, consequents, {_METRICS_SQL} FROM top_rules
ORDER BY round(lift, 9) DESC, replace(antecedents, '|', chr(1)), replace(consequents, '|', chr(1)) LIMIT 10""")
def strong_rules(spark, sf_dir):
    return rounded(_shown(baskets.strong_rules(_rules(spark, sf_dir))), *_METRICS)


_RULE_STATS = ["avg_confidence", "avg_lift", "avg_support", "max_lift", "min_lift"]


@query("rule_statistics", f"""WITH {_rules_sql(0.01)}
SELECT count(*) AS total_rules, round(avg(confidence), 6) AS avg_confidence, round(avg(lift), 6) AS avg_lift,
       round(avg(support), 6) AS avg_support, round(max(lift), 6) AS max_lift, round(min(lift), 6) AS min_lift FROM top_rules""")
def rule_statistics(spark, sf_dir):
    return rounded(baskets.rule_statistics(baskets.top_rules(_rules(spark, sf_dir))), *_RULE_STATS)


# --- networks ------------------------------------------------------------------


@query("rule_edges", f"""WITH {_rules_sql(0.002)},
pairs AS (SELECT src, unnest(string_split(consequents, '|')) AS dst, lift, confidence, support
          FROM (SELECT unnest(string_split(antecedents, '|')) AS src, * FROM rules)),
edges AS (SELECT src, dst, max({{lift: round(lift, 6), confidence: round(confidence, 6), support: round(support, 6)}}) AS b FROM pairs GROUP BY 1, 2)
SELECT src, dst, b.lift AS lift, b.confidence AS confidence, b.support AS support FROM edges""")
def rule_edges(spark, sf_dir):
    rules = rounded(_rules(spark, sf_dir, 0.002), "lift", "confidence", "support")
    return network.rule_edges(rules)


@query("association_network_metrics", f"""WITH {_rules_sql(0.01)},{_EDGES},
n AS (SELECT count(DISTINCT x) AS n FROM (SELECT src AS x FROM edges UNION ALL SELECT dst FROM edges))
SELECT any_value(n) AS nodes, count(*) AS edges, round(count(*) / (any_value(n) * (any_value(n) - 1)), 6) AS density FROM edges, n""")
def association_network_metrics(spark, sf_dir):
    return rounded(network.association_network(_rules(spark, sf_dir))["metrics"], "density")


@query("association_network_nodes", f"""WITH {_rules_sql(0.01)},{_EDGES}
SELECT node, CASE WHEN sum(i) > 0 THEN 'consequent' ELSE 'antecedent' END AS node_type, cast(sum(i) AS bigint) AS in_degree,
       cast(sum(o) AS bigint) AS out_degree, cast(sum(i) + sum(o) AS bigint) AS degree
FROM (SELECT src AS node, 0 AS i, 1 AS o FROM edges UNION ALL SELECT dst, 1, 0 FROM edges) GROUP BY 1""")
def association_network_nodes(spark, sf_dir):
    return network.association_network(_rules(spark, sf_dir))["nodes"]


@query("node_degrees", f"""WITH {_PAIRS}, edges AS (SELECT file_a AS src, file_b AS dst FROM pairs)
SELECT node, cast(sum(i) AS bigint) AS in_degree, cast(sum(o) AS bigint) AS out_degree, cast(sum(i) + sum(o) AS bigint) AS degree
FROM (SELECT src AS node, 0 AS i, 1 AS o FROM edges UNION ALL SELECT dst, 1, 0 FROM edges) GROUP BY 1""")
def node_degrees(spark, sf_dir):
    pairs = baskets.co_change_pairs(_files(spark, sf_dir))
    return network.node_degrees(pairs.withColumnsRenamed({"file_a": "src", "file_b": "dst"}))


@query("edge_nodes", f"""WITH {_PAIRS} SELECT DISTINCT node FROM (
  SELECT unnest([file_a, file_b]) AS node FROM pairs)""")
def edge_nodes(spark, sf_dir):
    pairs = baskets.co_change_pairs(_files(spark, sf_dir))
    return network.edge_nodes(pairs.withColumnsRenamed({"file_a": "src", "file_b": "dst"}))


@query("graph_modularity", f"""WITH {_PAIRS},
e AS (SELECT a, b, cast(sum(commits) AS double) AS w FROM (
        SELECT regexp_extract(file_a, '(\\.[a-z]+)$', 1) AS a, regexp_extract(file_b, '(\\.[a-z]+)$', 1) AS b, commits FROM pairs) GROUP BY 1, 2),
m AS (SELECT sum(w) AS m FROM e),
c AS (SELECT label, sum(i) AS i, sum(d) AS d FROM (
        SELECT a AS label, CASE WHEN a = b THEN w ELSE 0 END AS i, w AS d FROM e UNION ALL SELECT b, 0, w FROM e) GROUP BY 1)
SELECT round(sum(i / m - (d / (2 * m)) ^ 2), 6) AS modularity FROM c, m""")
def graph_modularity(spark, sf_dir):
    from commitlore.functions.text import file_extension

    pairs = baskets.co_change_pairs(_files(spark, sf_dir))
    edges = pairs.select(F.col("file_a").alias("src"), F.col("file_b").alias("dst"), F.col("commits").cast("double").alias("weight"))
    labels = network.edge_nodes(edges).select("node", file_extension("node").alias("label"))
    return rounded(network.graph_modularity(edges, labels), "modularity")

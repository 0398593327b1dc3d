"""Quality statistics."""

from commitlore.operators import quality
from commitlore.registry.base import COMMITS, DMM_LONG, query, rounded
from commitlore.schema import DMM_COLUMNS
from commitlore.sources.sample_views import commits


def _dmm(spark, sf_dir):
    return commits(spark, sf_dir, "hash", *DMM_COLUMNS)


@query("dmm_metrics", f"""WITH {DMM_LONG}
SELECT metric, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(stddev_samp(value), 6) AS std,
       round(min(value), 6) AS min, round(max(value), 6) AS max,
       round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.75), 6) AS q75
FROM dmm WHERE value IS NOT NULL GROUP BY 1""")
def dmm_metrics(spark, sf_dir):
    return rounded(quality.dmm_metrics(_dmm(spark, sf_dir)), "mean", "median", "std", "min", "max", "q25", "q75")


_COMPOSITE = f"""{COMMITS},
r AS (SELECT min(dmm_unit_size) a0, max(dmm_unit_size) a1, min(dmm_unit_complexity) b0, max(dmm_unit_complexity) b1,
             min(dmm_unit_interfacing) c0, max(dmm_unit_interfacing) c1 FROM commits)"""


@query("composite_dmm_score", f"""WITH {_COMPOSITE},
s AS (SELECT 0.3e0 * (dmm_unit_size - a0) / (a1 - a0 + 1e-8) + 0.4e0 * (dmm_unit_complexity - b0) / (b1 - b0 + 1e-8)
           + 0.3e0 * (dmm_unit_interfacing - c0) / (c1 - c0 + 1e-8) AS x FROM commits, r)
SELECT round(avg(x), 6) AS mean, round(median(x), 6) AS median, round(stddev_samp(x), 6) AS std FROM s""")
def composite_dmm_score(spark, sf_dir):
    return rounded(quality.composite_dmm_score(_dmm(spark, sf_dir)), "mean", "median", "std")


@query("quality_distribution", f"""WITH {DMM_LONG}
SELECT metric, percentile, round(value, 6) AS value FROM (
  SELECT metric, unnest([10, 25, 50, 75, 90, 95, 99])::int AS percentile,
         unnest(quantile_cont(value, [0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99])) AS value
  FROM dmm WHERE value IS NOT NULL GROUP BY 1)""")
def quality_distribution(spark, sf_dir):
    return rounded(quality.quality_distribution(_dmm(spark, sf_dir)), "value")


@query("quality_classes", f"""WITH {DMM_LONG},
q AS (SELECT metric, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.75) AS q75 FROM dmm GROUP BY 1)
SELECT metric, CASE WHEN value IS NULL THEN 'unknown' WHEN value <= q25 THEN 'high' WHEN value <= q75 THEN 'medium'
               ELSE 'low' END AS quality_class, count(*) AS commits
FROM dmm JOIN q USING (metric) GROUP BY 1, 2""")
def quality_classes(spark, sf_dir):
    return quality.quality_classes(_dmm(spark, sf_dir))


_SCORE = f"""{DMM_LONG},
m AS (SELECT metric, median(value) AS mid, min(value) AS lo, max(value) AS hi FROM dmm GROUP BY 1),
scored AS (SELECT hash, avg(1 - (coalesce(value, mid) - lo) / (hi - lo + 1e-8)) AS s FROM dmm JOIN m USING (metric) GROUP BY 1)"""


@query("quality_score", f"""WITH {_SCORE}
SELECT round(avg(s), 6) AS mean_score, round(median(s), 6) AS median_score, round(stddev_pop(s), 6) AS std_score FROM scored""")
def quality_score(spark, sf_dir):
    return rounded(quality.quality_score(_dmm(spark, sf_dir)), "mean_score", "median_score", "std_score")


@query("quality_score_bands", f"""WITH {_SCORE}
SELECT count(*) FILTER (s >= 0.8) AS excellent, count(*) FILTER (s >= 0.6 AND s < 0.8) AS good,
       count(*) FILTER (s >= 0.4 AND s < 0.6) AS fair, count(*) FILTER (s < 0.4) AS poor FROM scored""")
def quality_score_bands(spark, sf_dir):
    return quality.quality_score_bands(_dmm(spark, sf_dir))


@query("yearly_quality", f"""WITH {COMMITS}
SELECT cast(year(author_date) AS int) AS year, round(avg(dmm_unit_complexity), 6) AS mean,
       round(median(dmm_unit_complexity), 6) AS median, count(dmm_unit_complexity) AS commits
FROM commits GROUP BY 1""")
def yearly_quality(spark, sf_dir):
    return rounded(quality.yearly_quality(commits(spark, sf_dir, "author_date", "dmm_unit_complexity")), "mean", "median")


@query("minmax_scale", f"""WITH {_COMPOSITE}
SELECT hash, round((dmm_unit_size - a0) / (a1 - a0 + 1e-8), 6) AS dmm_unit_size,
       round((dmm_unit_complexity - b0) / (b1 - b0 + 1e-8), 6) AS dmm_unit_complexity,
       round((dmm_unit_interfacing - c0) / (c1 - c0 + 1e-8), 6) AS dmm_unit_interfacing FROM commits, r""")
def minmax_scale(spark, sf_dir):
    return rounded(quality.minmax_scale(_dmm(spark, sf_dir)), *DMM_COLUMNS)


@query("dmm_data_summary", f"""WITH {DMM_LONG}
SELECT metric, count(value) AS non_null, count(*) FILTER (value <> 0) AS non_zero FROM dmm GROUP BY 1""")
def dmm_data_summary(spark, sf_dir):
    return quality.dmm_data_summary(_dmm(spark, sf_dir))

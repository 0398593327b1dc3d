"""Repository configurations and rule tables."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from commitlore.schema import REPO_CONFIG_SCHEMA


def read_repo_configs(spark: SparkSession, path: str) -> DataFrame:
    """JSON with a `repositories` array, or an array of repositories; else an error."""
    listed = T.StructField("repositories", T.ArrayType(REPO_CONFIG_SCHEMA))
    rows = spark.read.schema(T.StructType([listed, *REPO_CONFIG_SCHEMA.fields])).option("multiLine", True).json(path)
    own = F.array(F.struct(*REPO_CONFIG_SCHEMA.names))
    configs = rows.select(F.explode(F.coalesce("repositories", own)).alias("r")).select("r.*").filter(
        F.col("repo_url").isNotNull()
    )
    if configs.isEmpty():
        raise ValueError(f"no repositories in {path}")
    return configs


def configs_from_urls(
    spark: SparkSession, urls, since=None, to=None, branch=None, file_types=None, skip_empty_dmm: bool = True,
) -> DataFrame:
    """The same options for each repository of a list."""
    rows = [(u, since, to, branch, list(file_types) if file_types else None, skip_empty_dmm) for u in urls]
    return spark.createDataFrame(rows, REPO_CONFIG_SCHEMA)


def read_rules(spark: SparkSession, *candidates: str) -> DataFrame:
    """(source, target) of the first candidate file that exists."""
    for path in candidates:
        try:
            return spark.read.options(header=True, quote='"', escape='"').csv(path).select("source", "target")
        except AnalysisException:
            continue
    raise FileNotFoundError(f"none of the rule files can be read: {', '.join(candidates)}")

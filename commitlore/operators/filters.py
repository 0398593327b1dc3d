"""Commit filters and schema-level column selection."""

from pyspark.sql import DataFrame, functions as F, types as T

from commitlore.functions.dates import config_date
from commitlore.functions.numbers import known
from commitlore.functions.text import file_extension, repo_name_from_url
from commitlore.schema import IDENTIFIER_COLUMNS

# Names that mark a column as an identifier, and the rest of the limits.
ID_PATTERNS = ["id", "index", "hash"]
MAX_CORRELATION = 0.95
MIN_ROWS = 10

# Column pairs of one aggregation.
PAIRS_AT_ONCE = 200


def drop_empty_dmm(commits: DataFrame) -> DataFrame:
    return commits.filter(F.col("dmm_unit_size").isNotNull())


def _touching(commits, file_changes, extensions):
    hits = file_changes.filter(file_extension("filename").isin(list(extensions))).select("hash")
    return commits.join(hits, "hash", "left_semi")


def filter_commits(
    commits: DataFrame, since=None, to=None, branch=None, file_types=None,
    file_changes: DataFrame | None = None, skip_empty_dmm: bool = False,
) -> DataFrame:
    """Keep commits in a date range, on a branch, touching a file of a type. All optional."""
    if since is not None:
        commits = commits.filter(F.col("committer_date") >= F.lit(since).cast("timestamp"))
    if to is not None:
        commits = commits.filter(F.col("committer_date") <= F.lit(to).cast("timestamp"))
    if branch is not None:
        commits = commits.filter(on_branch("branches", F.lit(branch)))
    if skip_empty_dmm:
        commits = drop_empty_dmm(commits)
    if file_types:
        commits = _touching(commits, file_changes, file_types)
    return commits


def on_branch(branches, branch):
    """Whether a branch is in a printed set such as {'main', 'dev'}, or is the one named."""
    names = F.transform(
        F.split(F.regexp_replace(branches, r"^\{|\}$", ""), ","),
        lambda x: F.regexp_replace(F.trim(x), r"^'|'$", ""),
    )
    return F.array_contains(names, branch)


def filter_by_repo_config(
    commits: DataFrame, configs: DataFrame, file_changes: DataFrame | None = None, max_broadcast: int = 200_000,
) -> DataFrame:
    """Each repository's own options, joined on the project name.

    Dates that cannot be read count as not given. A commit of a project without a
    config is dropped; one kept by several configs of its project comes out once.
    """
    rules = configs.select(
        repo_name_from_url("repo_url").alias("project_name"),
        config_date("since").alias("_since"), config_date("to").alias("_to"),
        F.col("only_in_branch").alias("_branch"),
        F.col("only_modifications_with_file_types").alias("_types"),
        F.coalesce("skip_empty_dmm", F.lit(True)).alias("_skip"),
    ).distinct()
    if rules.limit(max_broadcast + 1).count() <= max_broadcast:
        rules = F.broadcast(rules)
    kept = commits.join(rules, "project_name").filter(
        (F.col("_since").isNull() | (F.col("committer_date") >= F.col("_since")))
        & (F.col("_to").isNull() | (F.col("committer_date") <= F.col("_to")))
        & (F.col("_branch").isNull() | on_branch("branches", F.col("_branch")))
        & (~F.col("_skip") | F.col("dmm_unit_size").isNotNull())
    )
    if file_changes is not None:
        touched = file_changes.select(
            F.col("hash").alias("_hash"), file_extension("filename").alias("_ext")
        ).distinct()
        typed = F.coalesce(F.size("_types"), F.lit(0)) > 0
        hits = kept.filter(typed).join(
            touched, (F.col("hash") == F.col("_hash")) & F.array_contains("_types", F.col("_ext")), "left_semi"
        )
        kept = kept.filter(~typed).unionByName(hits)
    return kept.select(*commits.columns).dropDuplicates(["hash"])


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def exclude_id_like(columns, patterns=ID_PATTERNS) -> list[str]:
    return [c for c in columns if not any(p in c.lower() for p in patterns)]


def constant_columns(df: DataFrame, columns) -> list[str]:
    """Columns with at most one distinct value, from one min/max pass."""
    if not columns:
        return []
    row = df.agg(
        *[F.coalesce(F.min(known(c)) == F.max(known(c)), F.lit(True)).alias(f"c{i}") for i, c in enumerate(columns)]
    ).first()
    return [c for i, c in enumerate(columns) if row[f"c{i}"]]


def correlations(df: DataFrame, columns) -> dict:
    """Pearson correlation of each column pair (later, earlier), over the rows where both are known.

    Every PAIRS_AT_ONCE pairs are one aggregation, which reads the columns of these pairs only.
    """
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[:i]]
    found = {}
    for start in range(0, len(pairs), PAIRS_AT_ONCE):
        part = pairs[start : start + PAIRS_AT_ONCE]
        row = df.agg(*[F.corr(known(a), known(b)).alias(f"r{k}") for k, (a, b) in enumerate(part)]).first()
        found.update({pair: row[f"r{k}"] for k, pair in enumerate(part)})
    return found


def correlated_columns(df: DataFrame, columns, limit: float = MAX_CORRELATION) -> list[str]:
    """Columns whose absolute correlation with an earlier one exceeds the limit."""
    found = correlations(df, list(columns))
    late = {a for (a, _), r in found.items() if r is not None and abs(r) > limit}
    return [c for c in columns if c in late]


def drop_constant_columns(df: DataFrame, columns=None) -> DataFrame:
    return df.drop(*constant_columns(df, columns or numeric_columns(df)))


def drop_correlated_columns(df: DataFrame, columns=None, limit: float = MAX_CORRELATION) -> DataFrame:
    return df.drop(*correlated_columns(df, columns or numeric_columns(df), limit))


def complete_cases(df: DataFrame, columns) -> DataFrame:
    return df.dropna(subset=list(columns))


def project_model_columns(df: DataFrame) -> DataFrame:
    """Drop identifiers and free text; the list of files stays."""
    return df.drop(*IDENTIFIER_COLUMNS)


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("rows"))


def class_size_guard(df: DataFrame, label: str) -> str | None:
    """Why a classifier cannot be trained, or None when it can."""
    counts = class_distribution(df.filter(F.col(label).isNotNull()), label)
    row = counts.agg(F.count("*").alias("classes"), F.min("rows").alias("fewest")).first()
    if row["classes"] < 2:
        return "only one class"
    if row["fewest"] < 2:
        return "a class has fewer than 2 rows"
    return None


def min_rows_guard(df: DataFrame, rows: int = MIN_ROWS) -> str | None:
    found = df.limit(rows).count()
    return None if found >= rows else f"only {found} rows, {rows} needed"

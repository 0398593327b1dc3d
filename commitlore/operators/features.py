"""Feature transforms: fitted on a table, applied to a table.

A fit makes a bounded number of passes and keeps a handful of numbers, which enter
the transform as literals; the transforms are plain projections.
"""

from pyspark.ml.feature import Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from commitlore.functions.dates import calendar_features, commit_time
from commitlore.functions.numbers import (
    bool_to_int, churn_ratio, known, net_lines, parent_count, quartile_band, safe_numeric,
)
from commitlore.functions.text import msg_length, msg_word_count, tokenize_message
from commitlore.operators import contexts, embeddings
from commitlore.operators.filters import correlations, project_model_columns
from commitlore.operators.quantiles import exact_quantiles
from commitlore.operators.splits import kfold, train_test_split  # noqa: F401
from commitlore.schema import (
    CATEGORY_COLUMNS, DATE_COLUMNS, DMM_COLUMNS, FLAG_COLUMNS, SIZE_COLUMNS,
)
from commitlore.session import reused, stage

# Reach of the outlier fences, embedding settings, columns to standardise.
FENCE_REACH = 1.5
EMBEDDING = {"size": 50, "window": 5, "min_count": 1, "passes": 5}
#: How word vectors are made.
COOCCURRENCE, CONTEXTS, WORD2VEC = "cooccurrence", "contexts", "word2vec"
STANDARDIZED_COLUMNS = [
    *SIZE_COLUMNS, *DMM_COLUMNS, "msg_length", "msg_word_count",
    "author_date_year", "author_date_month", "author_date_day", "author_date_hour",
    "committer_date_year", "committer_date_month", "committer_date_day", "committer_date_hour",
    "net_lines", "churn_ratio", "parent_count",
]

SMALL_DICTIONARY = 200_000
ONE_TASK_DICTIONARY = 2_000_000
SALTS = 32
# A value with more than one row in so many is frequent; there are fewer of those than this.
FREQUENT_SHARE = 1000


def _present(df, columns):
    return [c for c in columns if c in df.columns]


# --- outliers and scaling ------------------------------------------------------


def outlier_fences(df: DataFrame, columns) -> dict:
    """{column: (low, high)} for columns with spread and an interquartile range."""
    columns = list(columns)
    quartiles = exact_quantiles(df, columns, [0.25, 0.75])
    fences = {}
    for c, (q1, q3) in quartiles.items():
        # an interquartile range above 0 implies a standard deviation above 0
        if q1 is not None and q3 > q1:
            reach = FENCE_REACH * (q3 - q1)
            fences[c] = (q1 - reach, q3 + reach)
    return fences


def clip_outliers_iqr(df: DataFrame, columns=(*SIZE_COLUMNS, *DMM_COLUMNS)) -> DataFrame:
    """Clip each column to its fences; missing and odd values count as 0."""
    columns = _present(df, columns)
    cleaned = df.withColumns({c: safe_numeric(c) for c in columns})
    fences = outlier_fences(cleaned, columns)
    return cleaned.withColumns(
        {c: F.least(F.greatest(F.col(c), F.lit(lo)), F.lit(hi)) for c, (lo, hi) in fences.items()}
    )


def moments(df: DataFrame, columns) -> dict:
    """{column: (mean, population std)} from one pass."""
    row = df.agg(
        *[F.struct(F.avg(known(c)).alias("m"), F.stddev_pop(known(c)).alias("s")).alias(c) for c in columns]
    ).first()
    return {c: (row[c]["m"], row[c]["s"]) for c in columns if row[c]["m"] is not None}


def standardized(c: str, mean: float, std: float) -> Column:
    """(x - mean) / population std; a constant column is only centred."""
    return (F.col(c) - F.lit(mean)) / F.lit(std if std else 1.0)


def standardize(df: DataFrame, columns=STANDARDIZED_COLUMNS) -> DataFrame:
    columns = _present(df, columns)
    cleaned = df.withColumns({c: safe_numeric(c) for c in columns})
    fitted = moments(cleaned, columns)
    return cleaned.withColumns({c: standardized(c, *ms) for c, ms in fitted.items()})


# --- dictionaries --------------------------------------------------------------


def label_dictionaries(df: DataFrame, columns) -> dict[str, tuple[DataFrame, int]]:
    """Per column (value, code), code = rank among the sorted distinct values, and their number.

    All columns are read in one pass. A short list is ranked in one task. A long one is
    range partitioned, written out, and ranked per part with the sizes of the parts
    before added on.
    """
    pairs = [
        F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias("value"))
        for c in columns
    ]
    values = df.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").distinct()
    with reused(values):
        sizes = {r["column"]: r["n"] for r in values.groupBy("column").agg(F.count("*").alias("n")).collect()}
        short = [c for c in columns if sizes.get(c, 0) <= ONE_TASK_DICTIONARY]
        rank = F.row_number().over(W.partitionBy("column").orderBy("value")) - 1
        coded = stage(values.filter(F.col("column").isin(short)).select("column", "value", rank.cast("long").alias("code")))
        found = {}
        for c in columns:
            if c in short:
                codes = coded.filter(F.col("column") == c).select("value", "code")
            else:
                codes = _long_dictionary(values.filter(F.col("column") == c).select("value"))
            found[c] = (codes, sizes.get(c, 0))
    return found


def _long_dictionary(values: DataFrame) -> DataFrame:
    parts = stage(values.repartitionByRange("value").withColumn("part", F.spark_partition_id()))
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(W.partitionBy("part").orderBy("value")) - 1
    # one row per partition of the write
    coded = parts.join(F.broadcast(offsets), "part").select("value", (F.col("offset") + rank).cast("long").alias("code"))
    return stage(coded)


def _joined_by_salt(keyed: DataFrame, codes: DataFrame, names) -> DataFrame:
    """Rows with the code of their `_value`, by a shuffle on both sides; a frequent value's rows go to SALTS places.

    The dictionary is longer than its file tells, as text is packed well there, so the join asks for a merge: else the planner
    sends the whole dictionary through the driver. Only codes of frequent values are repeated.
    """
    counts = stage(keyed.groupBy("_value").agg(F.count("*").alias("n")))
    share = (counts.agg(F.sum("n")).first()[0] or 0) // FREQUENT_SHARE
    # fewer than FREQUENT_SHARE rows
    often = F.broadcast(counts.filter(F.col("n") > share).select(F.col("_value").alias("_often"))) if share else None
    salt, places = F.lit(0), F.lit(0)
    if often is not None:
        keyed = keyed.join(often, F.col("_value") == F.col("_often"), "left")
        codes = codes.join(often.select(F.col("_often").alias("_repeated")), F.col("_known") == F.col("_repeated"), "left")
        salt = F.when(F.col("_often").isNotNull(), F.pmod(F.xxhash64(*names), F.lit(SALTS)).cast("int")).otherwise(0)
        places = F.when(F.col("_repeated").isNotNull(), F.lit(SALTS - 1)).otherwise(0)
    spread = codes.withColumn("_s", F.explode(F.sequence(F.lit(0), places)))
    return keyed.withColumn("_salt", salt).join(
        spread.hint("merge"), (F.col("_value") == F.col("_known")) & (F.col("_salt") == F.col("_s"))
    )


def label_encode(df: DataFrame, columns=CATEGORY_COLUMNS) -> DataFrame:
    """Replace each column by its code. Missing values are the word `unknown`."""
    names = df.columns
    for c, (codes, n) in label_dictionaries(df, _present(df, columns)).items():
        codes = codes.select(F.col("value").alias("_known"), F.col("code").alias("_code"))
        keyed = df.withColumn("_value", F.coalesce(F.col(c).cast("string"), F.lit("unknown")))
        if n <= SMALL_DICTIONARY:
            joined = keyed.join(F.broadcast(codes), F.col("_value") == F.col("_known"))
        else:
            joined = _joined_by_salt(keyed, codes, names)
        df = joined.select(*[F.col("_code").alias(c) if x == c else F.col(x) for x in names])
    return df


# --- imputation ----------------------------------------------------------------


def impute_mean(df: DataFrame, columns) -> DataFrame:
    """Missing and infinite values become the column mean, 0 for an empty column."""
    finite = {c: F.when(F.abs(known(c)) != F.lit(float("inf")), known(c)) for c in columns}
    cleaned = df.withColumns(finite)
    means = cleaned.agg(*[F.avg(c).alias(c) for c in columns]).first()
    return cleaned.withColumns({c: F.coalesce(F.col(c), F.lit(float(means[c] or 0.0))) for c in columns})


def impute_median(df: DataFrame, columns) -> DataFrame:
    """Missing values become the exact median; an empty column stays empty."""
    medians = exact_quantiles(df, columns, [0.5])
    return df.withColumns(
        {c: F.coalesce(known(c), F.lit(medians[c][0])) if medians[c][0] is not None else known(c) for c in columns}
    )


# --- labels --------------------------------------------------------------------


def quartile_label(df: DataFrame, column: str, output: str = "label") -> DataFrame:
    """low, medium, high by the column's own quartiles; null without a value."""
    q25, q75 = exact_quantiles(df, [column], [0.25, 0.75])[column]
    band = F.lit(None).cast("string") if q25 is None else quartile_band(known(column), F.lit(q25), F.lit(q75))
    return df.withColumn(output, band)


def dmm_score(df: DataFrame, columns=DMM_COLUMNS) -> DataFrame:
    """Adds the mean of the DMM columns.

    With values in all of them a row needs all three; where a column is empty
    throughout, the others are averaged over what each row has.
    """
    counts = df.agg(*[F.count(known(c)).alias(c) for c in columns]).first()
    used = [c for c in columns if counts[c]]
    if not used:
        return df.withColumn("dmm_score", F.lit(None).cast("double"))
    total, given = F.lit(0.0), F.lit(0)
    for c in used:
        if len(used) == len(columns):
            total = total + known(c)
        else:
            total = total + F.coalesce(known(c), F.lit(0.0))
            given = given + known(c).isNotNull().cast("int")
    if len(used) == len(columns):
        return df.withColumn("dmm_score", total / len(columns))
    return df.withColumn("dmm_score", F.when(given > 0, total / given))


# --- message embeddings --------------------------------------------------------


def message_embeddings(df: DataFrame, column: str = "msg", seed: int = 42, partitions: int = 8, method: str = COOCCURRENCE) -> DataFrame:
    """Adds `embedding`, the mean of the word vectors of a message; zeros without words.

    The caller chooses the method, never the size: "cooccurrence" factorises the table of words near each other and holds no
    vocabulary on the driver, nor does "contexts", which never makes that table, for vocabularies that grow with the texts; "word2vec"
    trains skip-grams and holds all words there, so the caller vouches for their number.
    """
    size, window = EMBEDDING["size"], EMBEDDING["window"]
    if method == CONTEXTS:
        rows = stage(df.withColumn("_row", F.monotonically_increasing_id()))
        blocks = contexts.token_blocks(rows, column)
        vectors, _ = contexts.context_vectors(blocks, size, window, seed)
        means = stage(contexts.text_means(blocks, vectors, size))
        return rows.join(means, "_row").drop("_row").withColumn("embedding", array_to_vector("embedding"))
    if method == COOCCURRENCE:
        weights = embeddings.information_weights(stage(embeddings.cooccurrences(df, column, window)))
        vectors, _ = embeddings.factorised(weights, size, seed)
        out = embeddings.mean_vectors(df, column, vectors, size)
        return out.withColumn("embedding", array_to_vector("embedding"))
    if method != WORD2VEC:
        raise ValueError(f"unknown method {method}")
    tokens = df.withColumn("_tokens", tokenize_message(column))
    with reused(tokens.select("_tokens")) as sentences:
        model = Word2Vec(
            vectorSize=size, windowSize=window, minCount=EMBEDDING["min_count"],
            numPartitions=partitions, maxIter=EMBEDDING["passes"], seed=seed, inputCol="_tokens", outputCol="embedding",
        ).fit(sentences)
    return model.transform(tokens).drop("_tokens")


def expanded_vector(df: DataFrame, column: str, prefix: str, size: int) -> DataFrame:
    """One column per vector element; the vector is opened once a row."""
    opened = df.withColumn("_elements", vector_to_array(F.col(column))).drop(column)
    return opened.select("*", *[F.get("_elements", F.lit(i)).alias(f"{prefix}{i}") for i in range(size)]).drop("_elements")


# --- the whole table -----------------------------------------------------------


def derived_columns(df: DataFrame) -> DataFrame:
    """Calendar parts, clipped numbers, churn, parents, message size, 0/1 flags."""
    for c in _present(df, DATE_COLUMNS):
        at = F.col(c) if dict(df.dtypes)[c].startswith("timestamp") else commit_time(c)
        df = df.withColumns(calendar_features(at, c)).drop(c)
    df = clip_outliers_iqr(df)
    if {"insertions", "deletions"} <= set(df.columns):
        df = df.withColumns({"net_lines": net_lines(), "churn_ratio": churn_ratio()})
    if "parents" in df.columns:
        df = df.withColumn("parent_count", parent_count("parents"))
    if "msg" in df.columns:
        df = df.withColumns({"msg_length": msg_length("msg"), "msg_word_count": msg_word_count("msg")})
    return df.withColumns({c: bool_to_int(c) for c in _present(df, FLAG_COLUMNS)})


def feature_table(
    commits: DataFrame, embed_messages: bool = False, scale: bool = True, keep_hash: bool = False,
) -> DataFrame:
    """The numeric table models and clusterings are fitted on.

    The fits read the table three times (quartiles, moments, dictionaries), each time
    only the columns they need. A table that is costly to compute should be staged first.
    """
    derived = derived_columns(commits)
    if embed_messages and "msg" in derived.columns:
        derived = expanded_vector(message_embeddings(derived), "embedding", "w2v_", EMBEDDING["size"])
    scaled = derived
    if scale:
        vectors = [c for c in derived.columns if c.startswith("w2v_")]
        scaled = standardize(derived, [*STANDARDIZED_COLUMNS, *vectors])
    encoded = label_encode(scaled)
    if keep_hash and "hash" in encoded.columns:
        return project_model_columns(encoded.withColumnRenamed("hash", "_h")).withColumnRenamed("_h", "hash")
    return project_model_columns(encoded)


def correlation_matrix(df: DataFrame, columns=None) -> DataFrame:
    """Long form of the lower triangle: each column against the earlier ones."""
    from commitlore.operators.filters import numeric_columns

    found = correlations(df, list(columns or numeric_columns(df)))
    rows = [(a, b, r) for (a, b), r in found.items()]
    return df.sparkSession.createDataFrame(rows, "feature string, other string, correlation double")

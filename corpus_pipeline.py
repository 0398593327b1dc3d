"""A training corpus from raw documents: language, near copies, benchmark passages, source mix, packed token rows."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commitlore.llm import contamination, langid, mixing, near_dup, packing
from commitlore.llm.common import fold, table
from commitlore.session import stage

#: The model is fitted on rows of `documents` outside this fold; texts without a letter have no language and are rejected.
LANGUAGE_FOLDS, LANGUAGE_HELD_OUT = 3, 1


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language, which becomes their `lang`; texts that are null or have no letter go."""
    model = langid.fit_languages(docs, fold("doc_id", LANGUAGE_FOLDS) != LANGUAGE_HELD_OUT)
    own = docs.withColumnsRenamed({c: f"_own_{c}" for c in docs.columns if c != "text"})  # whatever their names, columns stay
    kept = langid.languages(own, model).filter(F.col("lang_pred") != langid.UNKNOWN)
    return kept.select(*(F.col({"text": "text", "lang": "lang_pred"}.get(c, f"_own_{c}")).alias(c) for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, the one of the smallest doc_id."""
    return near_dup.deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words is in benchmark passages."""
    return contamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as their source's target asks, the last one cut at the budget's word."""
    return mixing.mixed(docs)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of token ids with segment lengths and positions."""
    return packing.pack(docs)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("packing", pack_tokens),
]

#: Learned models, hashed signatures and a tokenizer are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

"""The corpus pipeline: five stages, each over all that its predecessor kept.

``STAGES`` names them in order. A stage takes the session, its predecessor's documents and
the folder of the tables, and returns a DataFrame; ``run`` writes each result as Parquet in
the shared folder and reads it again for the next stage. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioscope.llm import bpe, decontaminate, language, neardup, substrings
from folioscope.llm.common import materialize, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not recognised go (texts without a letter, and those under
    the calibrated rejection threshold). The model learns from the stage's labelled rows."""
    return language.drop_rejected(docs, language.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by SimHash fingerprints at most 4 bits apart, or by a Jaccard similarity of 0.8 or more over
    five-word shingles, which reaches pairs more bits apart, the one with the smallest id stays."""
    return neardup.drop_joint_copies(docs)


def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that also start elsewhere are taken out of the texts."""
    return substrings.drop_substrings(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_leaking(docs, table(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with the digests of the ids and of what they decode to."""
    import public_tokenizers

    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language", identify_language),
    ("near duplicates", near_duplicates),
    ("substrings", repeated_substrings),
    ("decontamination", decontaminated),
    ("byte BPE", byte_bpe),
]

#: No SQL: tokenizer, model and component search are beyond it; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``.

    Null and empty texts and texts without a letter go in the first stage; long texts pass whole;
    of repeated rows and near copies the second keeps one; rows without an id can't be named and
    stay in the second and fourth; columns beyond those of ``documents`` pass through all stages
    but the last, whatever their names; an empty table gives none.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

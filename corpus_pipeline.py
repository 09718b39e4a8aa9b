"""From raw documents to token ids: five stages over whole tables.

Each stage gets what the one before wrote.  All but the last return the columns of
``documents``, and any others that are there, whatever their names (but those that begin
with __dup_ or __mix_, which raise ValueError); the last one returns each row's ids and
digests.  Empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from popnet.llm import bpe, langid, mixing, nearcopies, pii
from popnet.llm.shared import table, written

#: SQL can't express the mixture inference, the knapsack or the encoding.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty texts too), or without a main language, go; repeated rows and other columns stay.

    Learned from the labelled rows that aren't held out; without any, every document goes.
    """
    return langid.speaking(docs, docs.where(~langid.held_out(F.col("doc_id"))).select("text", "lang"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard 0.8 or more) stays: the one with the smallest doc_id.

    Null ids come last; texts without words (null, empty) are one group; of rows that repeat
    both doc_id and text one stays; a text of any length is read whole.
    """
    return nearcopies.representatives(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked in whole texts of any length; n_chars follows the text (0 for null); every row stays, null texts as they are."""
    return pii.mask(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.lit(0)).cast(docs.schema["n_chars"].dataType))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice.

    A null source is a source; documents without words have no size, so they come only as
    often as whole passes over their source take them.
    """
    mixed = mixing.mix(docs).where(F.col("__mix_copies") > 0)
    return mixed.withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.col("__mix_copies").cast("int")))).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document (little-endian unsigned 32-bit integers), and digests of them and of the text they decode to.

    A row per row, null ids and repeats included; a null text has no ids.
    """
    found = bpe.encode(docs)
    return found.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
    ("token_ids", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The pipeline as a query."""
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    """None: see ORACLE_SQL."""
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}

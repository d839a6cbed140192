"""Corpus pipeline: five stages over the table ``documents``, in the order of ``STAGES``.

Each stage is a function ``(spark, docs, sf_dir) -> DataFrame`` over all rows that its predecessor
kept, and all but the last return the columns of ``documents``.  Its own query is counted as part of
``quillfold.llm``.

In every stage further columns of ``documents`` pass through whatever their names, very long texts
are read whole, and an empty table stays empty.  Each stage tells what becomes of nulls and repeats.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quillfold.llm.common import materialise, table  # noqa: E402
from quillfold.llm.decontaminate import drop_contaminated  # noqa: E402
from quillfold.llm.mixing import take_mix  # noqa: E402
from quillfold.llm.near_dedup import NearDup, drop_near_duplicates  # noqa: E402
from quillfold.llm.quality_rules import drop_low_quality  # noqa: E402
from quillfold.llm.toxicity import drop_toxic  # noqa: E402
from quillfold.plans.ship import ship  # noqa: E402


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go.

    Texts that are null, empty or without words score the share of toxic labels; rows with a null id
    are scored but not learnt from; repeated rows score alike.
    """
    ship(spark)
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or a certified cutoff go.

    Texts that are null or have too few words fail the base rules; a null language is a stratum of
    its own; a null id is judged but not learnt from; repeated rows are judged alike.
    """
    ship(spark)
    return drop_low_quality(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8) stays, the smallest id.

    Texts without words and rows with a null id stay; of rows that repeat an id one stays.
    """
    ship(spark)
    return drop_near_duplicates(docs, NearDup(shingle_words=5, percent=80))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of ten benchmark words, or a whole shorter item, go.

    Texts and items that are null or have no words match nothing; ids are not looked at; repeated
    rows fare alike.
    """
    ship(spark)
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: every document as often as it is taken, with its number in ``copy``.

    A null source is a source of its own, the last; a null text has no words; rows equal in id,
    source and size share one decision.
    """
    ship(spark)
    return take_mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
]

#: The models and the sampling cannot be said in SQL; the tests compare each stage with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs)
    return docs


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}

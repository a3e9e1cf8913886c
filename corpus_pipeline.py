"""The corpus pipeline: quality rules, exact dedup, near-dedup, mixing, packing.

Each stage gets what the one before kept, from Parquet, and returns documents
with their columns; the last returns packed pieces. A stage that is called by
itself deletes the intermediate tables of the one called before it, so that
one's rows must have been written by then. ``run`` gives its tables names of
their own and deletes those of a stage once its rows are written, so that any
number of runs stand side by side.

Every stage takes null, empty and very long texts, null and repeated ids,
repeated rows, an empty table and extra columns of any name:

* quality_rules: a text without ten words goes, so null, empty and blank ones do
* exact_dedup: of rows with equal texts (null is empty) one with the largest
  id stays, a null id only where there is no other
* near_dedup: of linked texts the row with the smallest id stays, with rows
  that repeat it; null ids only where there is no other; texts without words are one group
* mixing: all rows stay; a null source is a source of its own
* packing: a row per piece; repeated rows are packed each; an empty text is its end alone
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lexspan.llm import exact_dedup, mixing, packing, quality, scratch, simhash
from lexspan.llm.queries import DEFAULT_TARGET, TARGETS


STEP = "pipeline-step"


def _next(spark: SparkSession) -> str:
    """The tag of a stage called by itself; the tables of the one before go."""
    scratch.forget(spark, f"{STEP}-")
    return STEP


def _quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str, tag: str | None = None) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source."""
    return quality.clean(docs, tag=tag or _next(spark))


def _exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str, tag: str | None = None) -> DataFrame:
    """Of equal texts the row with the largest doc_id."""
    return exact_dedup.ExactGroups(docs, tag=tag or _next(spark)).kept()


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str, tag: str | None = None) -> DataFrame:
    """Of texts linked by 0.8 or more of their five-word shingles the row with the smallest doc_id."""
    return simhash.one_of_each(docs, words=5, tag=tag or _next(spark))


def _mixing(spark: SparkSession, docs: DataFrame, sf_dir: str, tag: str | None = None) -> DataFrame:
    """All documents, in the order of the schedule of their sources by op6's target weights."""
    return mixing.mixed(docs, targets=TARGETS, default=DEFAULT_TARGET, tag=tag or _next(spark))


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str, tag: str | None = None) -> DataFrame:
    """A row per piece with its sequence and offset; sequences follow the order of the mixed rows."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), tag=tag or _next(spark), ordered=True)


STAGES = [
    ("quality_rules", _quality_rules),
    ("exact_dedup", _exact_dedup),
    ("near_dedup", _near_dedup),
    ("mixing", _mixing),
    ("packing", _packing),
]

#: robust estimates, SimHash and tokenizers are beyond SQL; tests/llm/test_pipeline.py holds run() against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of sf_dir, each written and read again; the last stage's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    own = f"pipeline-run-{uuid.uuid4().hex[:12]}"
    for k, (name, stage) in enumerate(STAGES[:-1]):
        kept = scratch.written(stage(spark, docs, sf_dir, tag=f"{own}-{k}"), f"{own}-kept{k}-{name}")
        scratch.forget(spark, f"{own}-{k}-")
        scratch.forget(spark, f"{own}-kept{k - 1}-")
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir, tag=f"{own}-last")

"""From raw documents to packed sequences, in stages that are written as Parquet and read by the next.

Every stage but the last returns the columns of ``documents``.  Where a stage keeps one row of a group, rows get a
number in a stored table first, so that rows with equal or null ids stay apart.  A stage begins by deleting the tables
that the stage before has stored, whose result has been written by then.  A column ``_pipeline_row`` of the documents is
an error.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagwise.llm import decontaminate, exact, langid, minhash, packing, simhash
from lagwise.llm.common import BITMAPS, bitmaps, discard, held_out, in_bitmaps, read, release, step, store

_ROW = "_pipeline_row"
#: The near-duplicate stage also links rows that share so many percent of their word sequences of this length.
WORDS, PERCENT = 5, 80

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _stage(fn: Stage) -> Stage:
    @wraps(fn)
    def begun(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if _ROW in docs.columns:
            raise ValueError(f"documents have a column {_ROW}")
        with step(spark):
            return fn(spark, docs, sf_dir)

    return begun


def _numbered(docs: DataFrame) -> DataFrame:
    return store(docs.withColumn(_ROW, F.monotonically_increasing_id()), "numbered")


def _only(numbered: DataFrame, rows: DataFrame) -> DataFrame:
    """The numbered rows whose number is in ``rows`` (column row).

    Numbers are dense within a task's stretch, so one bit a row tells which stay, and texts are not shuffled.  Only a
    table of so many rows that its bits are too much for a task is joined.
    """
    kept = store(rows.select(F.col("row").alias(_ROW)), "kept")
    release(kept.sparkSession)
    maps = store(bitmaps(kept, _ROW), "bitmaps")
    if maps.count() <= BITMAPS:
        return in_bitmaps(numbered, _ROW, maps).drop(_ROW)
    return numbered.join(kept, _ROW, "left_semi").drop(_ROW)


@_stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language, which also fills a null ``lang``; those without letters go."""
    return langid.keep_known(docs, langid.learn(docs.filter(~held_out(F.col("doc_id")))))


@_stage
def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal up to white space, the row with the smallest doc_id."""
    numbered = _numbered(docs)
    return _only(numbered, exact.exact_groups(numbered, row_col=_ROW).filter("kept"))


@_stage
def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the row with the smallest doc_id.

    Rows are near whose fingerprints differ in at most three bits, as in ``op2``, or whose five-word similarity is 0.8.
    """
    numbered = _numbered(docs)
    prints = store(simhash.near_groups(numbered, row_col=_ROW).select("row", "doc_id", "component"), "prints")
    release(spark)
    alike = store(minhash.similar_groups(numbered, row_col=_ROW, width=WORDS, percent=PERCENT).select("row", "component"), "alike")
    release(spark)
    groups = prints.drop("component").join(minhash.joined_groups(prints.drop("doc_id"), alike), "row")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"].alias("row")
    return _only(numbered, groups.groupBy("component").agg(first))


@_stage
def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage near to a benchmark item."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences along the curve."""
    return packing.pack(docs).drop("row", "ids")


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("simhash_dedup", simhash_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pack", pack),
]

#: Prototypes, fingerprints and token ids are not expressible in SQL; tests/llm checks the stages against plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's result is deleted when the next one's is written."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)

"""The corpus pipeline: quality rules, toxicity, near-duplicates, mixing, packing.

Each stage takes all documents that the one before it kept and returns the
columns of documents, the last one the packed pieces.

Defined results, in every stage: null and empty texts are documents without
words (the rules reject them; alone they are clean, are duplicates of one
another, take no part in a mix, and pack as their end id); a null doc_id or
source is a value like others, and sorts last; rows that repeat are documents
of their own up to the near-duplicates, of which one stays; ties go to the
smallest id, then the smallest hash of the text, then the other columns;
texts are taken whole, however long; an empty table gives an empty one; extra
columns are carried along, whatever their names, but for those that mixing
computes and all of them in packing, which returns pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ionsift.llm import binary_packing, golay_dedup, host_quality, source_mix, toxic_passages
from ionsift.llm.common import new_folder, remove_folder, scratch, table

#: Packing needs a tokenizer, which SQL does not express; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def _kept(df: DataFrame, docs: DataFrame, keep: Column) -> DataFrame:
    return df.where(keep).select(*[f"`{c}`" for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that fail the rules or whose host is rejected; null and empty texts fail, a null host gets no verdict, repeated rows each count."""
    return host_quality.kept_documents(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that are predicted toxic; fitted on the labelled ones among those that are left, but the held-out third.

    Without labels of both kinds the score is the clamped share of toxic
    ones; a text without tokens scores as one without passages.
    """
    labels = table(spark, sf_dir, "labels")
    model = toxic_passages.fit(docs, labels.where(~toxic_passages.held_out(F.col("doc_id"))))
    own = docs.withColumnsRenamed({c: f"__in{i}" for i, c in enumerate(docs.columns)})  # columns named as the computed ones stay
    scored = toxic_passages.toxicity(own, model, text=f"__in{docs.columns.index('text')}")
    return _kept(scored, own, F.col("predicted") == 0).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: the smallest id, null last, then the smallest hash of its text; texts without words are one component."""
    return golay_dedup.one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for every time that a document is taken; null and empty texts are never taken."""
    return source_mix.mixture(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces and their places; ids_crc32 stands for the ids, which packed_sequences() gives when asked.  A document taken twice gives its pieces twice."""
    return binary_packing.packed_sequences(docs, with_ids=False)


STAGES = [("quality_rules", quality_rules), ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written in the shared folder and read again, and the table before it removed.  The last one stays, for the result reads it."""
    df, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        at = new_folder(spark, name)
        with scratch(spark):
            stage(spark, df, sf_dir).write.parquet(at)
        df = spark.read.parquet(at)
        if last:
            remove_folder(spark, last)
        last = at
    return STAGES[-1][1](spark, df, sf_dir)

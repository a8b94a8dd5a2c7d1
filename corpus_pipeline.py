"""From raw documents to a training mix: five stages, each written before the next reads it.

Language ID, line dedup, near-duplicate documents, benchmark decontamination, source mixing.
Every stage takes what the one before it kept and returns the columns of ``documents``; the last
one adds the size of the document, its source's size and target, and the words taken.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from sunledger.llm import common, decontamination, langid, lines, mixing, similar


_SCRATCH: list[str] = []


def stage(step):
    """A stage whose inner folders go when the next stage begins: by then its result is written."""
    @wraps(step)
    def run_step(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.removed(spark, _SCRATCH)
        with common.noted() as paths:
            out = step(spark, docs, sf_dir)
        _SCRATCH.extend(paths)
        return out
    return run_step


@stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or without one likeliest language, go."""
    return langid.keep_known_language(docs, langid.fit(docs))


@stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line up to one edit go; a document stays, if only empty."""
    return lines.without_duplicate_lines(docs)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicate documents one stays, by smallest id (null first).
    Near are sets of five-word shingles with a Jaccard similarity of 0.8 or more: first of the texts that
    the documents had before line dedup, of which a near copy keeps only what differs, then, among
    those that stay, of the texts that line dedup left."""
    return similar.one_of_each(docs, common.table(spark, sf_dir, "documents"))


@stage
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontamination.clean_documents(docs, common.table(spark, sf_dir, "benchmark"))


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the mix takes, with the number of words taken (repeats counted)."""
    return mixing.mix(docs).where("taken > 0")


STAGES = [("language_id", language_id), ("line_dedup", line_dedup),
          ("near_duplicates", near_duplicates), ("decontamination", decontaminate),
          ("mixing", mix_sources)]

# language ID has no SQL form, and every later stage works on what it keeps
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, read = common.table(spark, sf_dir, "documents"), []
    for name, step in STAGES[:-1]:
        out = step(spark, docs, sf_dir)
        with common.noted() as paths:
            docs = common.kept(out, name)
        common.removed(spark, read)  # what this stage read is written anew
        read = paths
    return STAGES[-1][1](spark, docs, sf_dir)

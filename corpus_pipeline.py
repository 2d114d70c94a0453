"""A training corpus in five stages, each by one operator of the package's training-data part.

Stages take (spark, docs, sf_dir) and return a DataFrame; each works on all that the stage before has kept, and all but
the last return the columns of documents. ``run`` writes every stage's result to the shared folder and reads it back, once
if the stage has done so itself.

Toxic documents go; recurring lines go, while their documents stay, with an empty text if nothing else is left; of near
duplicates (five words, similarity 0.8) one document stays; sources are repeated to their weights; the rest is packed into
sequences. Nulls, empty and repeated rows and empty tables have the results that the operators define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cardloom.llm import linededup, mixing, neardup, packing, queries, toxicity
from cardloom.llm.common import Scratch, table, text_batches

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the model, fitted on the labelled ones among them, does not predict to be toxic. They are written here,
    as batches of whole texts that go to Python and come back stay small only while a table is written."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    with text_batches(spark):
        return Scratch(spark, "clean").put(toxicity.score(docs, model, threshold=queries.TOXIC_FROM, keep=COLUMNS).where("predicted = 0").select(*COLUMNS), "documents")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without its recurring lines."""
    return linededup.drop_recurring_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of the smallest doc_id."""
    return neardup.drop_near_duplicates(docs, words=5, percent=80).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target shares of their sources, in a random order."""
    return mixing.mix_sources(docs, queries.MIX_WEIGHTS, queries.MIX_REST, seed=queries.MIX_SEED).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, piece, start, length, bin_id, bin_length, bin_offset): where each document's tokens lie in sequences."""
    return packing.pack_documents(docs, queries.tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_duplicates", drop_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Trained models and packing have no SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        new = stage(spark, docs, sf_dir)
        new = new if hasattr(new, "scratch_path") else s.put(new, name)
        if hasattr(docs, "scratch_path"):
            s.drop(docs)
        docs = new
    return STAGES[-1][1](spark, docs, sf_dir)

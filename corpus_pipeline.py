"""From raw documents to packed training sequences, a stage at a time.

Each stage takes ``(spark, docs, sf_dir)``; what it returns is written as Parquet
in the shared folder and read again as the next one's ``docs``. The classifier and
the tokenizer can't be put in SQL, so ``ORACLE_SQL`` is None; the stages are tested
against brute force on small tables.

All stages keep null texts and null ids as rows of their own, take rows repeated whole as
copies, give an empty table for an empty one, and carry columns of any other name along;
the operators' docstrings say how each treats them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from rostrum.llm import jaccard_join, line_dedup, mixing, packing, toxicity
from rostrum.llm.common import unused_name
from rostrum.session import stage
from rostrum.sources.tables import read_table

KNOWN_WORDS = 300_000  # of packing: its Python workers go on to serve other stages
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go."""
    return toxicity.without_toxic(docs, read_table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, and with them documents that had no other lines.

    ``n_chars``, if there is one, follows the text.
    """
    left, lost = unused_name(docs, "lines_left"), unused_name(docs, "lines_lost")
    rows = line_dedup.without_repeated_lines(docs, left=left, lost=lost)
    rows = rows.where((F.col(left) > 0) | (F.col(lost) == 0))
    if "n_chars" in docs.columns:
        changed = F.when(F.col(lost) > 0, F.length("text")).otherwise(F.col("n_chars"))
        rows = rows.withColumn("n_chars", changed.cast(docs.schema["n_chars"].dataType))
    return rows.select(*[f"`{c}`" for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return jaccard_join.one_of_each_class(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.taken_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences."""
    return packing.packed(docs, TOKENIZER, known_words=KNOWN_WORDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""A training-corpus pipeline of operators in ``factlake.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's docs. Stages work on all rows their predecessor kept. All but the
last return the columns of ``documents``; extra columns are dropped. Rows are told apart by a key of
the row (``row_keys``), so null or repeated doc_ids lose none. Empty tables pass through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.llm import bpe, exact_dedup, language, mixing, ngram_join
from factlake.llm.common import fresh, row_keys, stage, table
from factlake.llm.queries import vocabulary_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what has no language: null texts and texts without a letter."""
    docs = fresh(docs, *COLUMNS)
    model = language.train(docs)
    # Without labelled rows nothing is learned, but letters can still be told.
    told = language.identify(docs, model if model.languages else language.letters_only(), keep=COLUMNS[1:])
    return told.filter(F.col("lang_pred") != language.UNKNOWN).select(*COLUMNS)


def _by_key(rows: DataFrame) -> DataFrame:
    """The rows with their key in place of doc_id."""
    return rows.drop("doc_id").withColumnRenamed("id", "doc_id")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of equal texts the longest row, then the smallest doc_id."""
    rows = row_keys(fresh(docs, *COLUMNS), each=True)
    keep = exact_dedup.exact_dedup(_by_key(rows)).filter("kept").select(F.col("doc_id").alias("id"))
    return rows.join(keep.hint("merge"), "id", "left_semi").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each component of similar documents the smallest doc_id (null last)."""
    rows = row_keys(fresh(docs, *COLUMNS), nulls_first=False, each=True)
    first = ngram_join.ngram_components(_by_key(rows)).filter("doc_id = component_id").select(F.col("doc_id").alias("id"))
    return rows.join(first.hint("merge"), "id", "left_semi").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as its source's target asks for; copies of 0 go."""
    rows = row_keys(fresh(docs, *COLUMNS), each=True)
    copies = mixing.mix_sources(_by_key(rows)).filter("copies > 0").select(F.col("doc_id").alias("id"), "copies")
    taken = rows.join(copies.hint("merge"), "id")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes every document of the mix."""
    return bpe.bpe_round_trip(docs, vocabulary_path(), keep=("lang", "source"))


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources", mix_sources),
    ("BPE", encode_tokens),
]

#: A learned classifier and BPE have no SQL; tests hold the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs

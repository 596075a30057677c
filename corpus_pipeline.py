"""A training corpus from the table of documents, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last return the
columns of documents; the last adds the token ids of each text.

Documents may have further columns of any names; they pass unchanged (but one called ``tokens``, which the last stage
replaces). A null text counts as empty, in all stages. Rows with null, tied or repeated identifiers are rows like
others. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm import bpe, exact_dedup, jaccard, mixing, toxicity
from loomwork.llm.common import apart, table, with_row_numbers, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier, trained on the labelled ones among docs, scores under 0.5."""
    docs, named = apart(docs, ("doc_id", "text"))
    weights = toxicity.model(docs, table(spark, sf_dir, "labels"))
    return named(toxicity.scored(docs, weights, keep=tuple(docs.columns)).filter("score < 0.5"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest doc_id."""
    docs, named = apart(docs, ("doc_id", "text"))
    return named(exact_dedup.exact_dedup(docs, keep="largest").filter("kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates, the document with the smallest doc_id. Texts without words stay."""
    docs, named = apart(docs, ("doc_id", "text"))
    docs = with_row_numbers(docs, "_row")
    firsts = jaccard.jaccard_join(docs, row="_row").filter("first").select(F.col("row").alias("_row"))
    return named(docs.join(firsts, "_row", "left_semi"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a document once for each copy that it takes."""
    return mixing.emitted(docs, mixing.word_count())


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of docs, and the token ids of each text."""
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE", encode),
]

#: SQL expresses neither the classifier nor the encoder; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage{k}")
    return docs

"""Alignment files that keep arriving, as a stream: parsing, the row-wise filters and counts per query. The
operators that order a query's alignments need all of them, so they run on the written table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_paf(spark: SparkSession, folder: str, files_at_once: int = 1000) -> DataFrame:
    """The alignment columns of PAF files in a folder, as they come. Rows with a start after their end go."""
    f = F.split("value", "\t")
    names = ("query", "query_len", "query_start", "query_end", "strand", "ref", "ref_len", "ref_start", "ref_end", "num_match", "aln_len", "mapq")
    lines = spark.readStream.schema("value string").option("maxFilesPerTrigger", files_at_once).format("text").load(folder)
    rows = lines.filter(F.size(f) >= 12).select(*((f[i] if n in ("query", "strand", "ref") else f[i].cast("long")).alias(n) for i, n in enumerate(names)))
    return rows.filter("query_start <= query_end AND ref_start <= ref_end")


def counts_by_query(alns: DataFrame) -> DataFrame:
    return alns.groupBy("query").agg(F.count("*").alias("n_alns"), F.sum("aln_len").alias("bases"), F.max("mapq").alias("best_mapq"))

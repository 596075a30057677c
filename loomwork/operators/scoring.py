"""Best reference and confidence scores of each query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .alignments import ref_span


def union_coverage(alns: DataFrame) -> DataFrame:
    """Per query and reference: covered (bases of the union of reference intervals), low, high, forward and
    reverse (aligned bases by strand) and primary (the longest alignment, the first by position if several)."""
    order = Window.partitionBy("query", "ref").orderBy("ref_start", "ref_end", "line_no")
    reach = F.max("ref_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col("ref_end") - F.greatest("ref_start", F.coalesce(reach, F.col("ref_start"))))
    rank = F.struct(ref_span().alias("span"), (-F.col("ref_start")).alias("a"), (-F.col("ref_end")).alias("b"), (-F.col("line_no")).alias("c"))
    keep = F.struct("query_len", "query_start", "query_end", "strand", "ref_len", "ref_start", "ref_end", "line_no")
    rows = alns.select("query", "ref", "ref_start", "ref_end", "strand", new.alias("_new"), rank.alias("_rank"), keep.alias("_row"))
    return rows.groupBy("query", "ref").agg(
        F.sum("_new").alias("covered"),
        F.min("ref_start").alias("low"),
        F.max("ref_end").alias("high"),
        F.sum(F.when(F.col("strand") == "+", ref_span()).otherwise(0)).alias("forward"),
        F.sum(F.when(F.col("strand") != "+", ref_span()).otherwise(0)).alias("reverse"),
        F.max_by("_row", "_rank").alias("primary"),
    )


def scores(alns: DataFrame) -> DataFrame:
    """Per query: its best reference (most covered bases, then the smallest name), the primary alignment there,
    and the confidences of grouping (share of covered bases), location (covered share of the stretch that the
    alignments span) and orientation (share of aligned bases on the primary's strand). Null where the
    denominator is 0."""
    cover = union_coverage(alns)
    by_query = Window.partitionBy("query")
    best = cover.select(
        "*",
        F.row_number().over(by_query.orderBy(F.desc("covered"), "ref")).alias("_rank"),
        F.sum("covered").over(by_query).alias("_all"),
    ).filter("_rank = 1")
    own = F.when(F.col("primary.strand") == "+", F.col("forward")).otherwise(F.col("reverse"))
    return best.select(
        "query", "ref", "covered",
        F.try_divide(F.col("covered").cast("double"), F.col("_all").cast("double")).alias("grouping"),
        F.try_divide(F.col("covered").cast("double"), (F.col("high") - F.col("low")).cast("double")).alias("location"),
        F.try_divide(own.cast("double"), (F.col("forward") + F.col("reverse")).cast("double")).alias("orientation"),
        "primary.*",
    )


def confident(scored: DataFrame, grouping: float = 0.2, location: float = 0.0, orientation: float = 0.0) -> DataFrame:
    """Queries whose three scores are all above the thresholds."""
    return scored.filter((F.col("grouping") > grouping) & (F.col("location") > location) & (F.col("orientation") > orientation))

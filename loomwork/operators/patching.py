"""Edges between target sequences that query alignments bridge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .alignments import with_end_flags


def bridges(alns: DataFrame, distance: float) -> DataFrame:
    """Edges from consecutive alignments of a query to different targets: u, v (ends of the targets that meet),
    query, my_end, their_start (query bases between the two targets; my_end past their_start: the targets
    overlap), one direction each.

    Whether an alignment shows its target reversed depends on which ends it is near; targets that would overlap
    by more than their length give no edge.
    """
    f = with_end_flags(alns, distance)
    minus = F.col("strand") == "-"
    both = F.col("query_left") & F.col("query_right")
    left_only = F.col("ref_left") & ~F.col("ref_right")
    turned = (
        F.when(F.col("ref_left") & F.col("ref_right"), minus)
        .when(both, minus)
        .when(left_only, F.col("query_left"))
        .otherwise(F.col("query_right"))
    )
    rows = f.withColumn("turned", turned)
    after = F.when(F.col("turned"), F.col("ref_start")).otherwise(F.col("ref_len") - F.col("ref_end"))
    before = F.when(F.col("turned"), F.col("ref_len") - F.col("ref_end")).otherwise(F.col("ref_start"))
    rows = rows.select("query", "query_len", "ref", "ref_len", "turned", (F.col("query_end") + after).alias("out_at"), (F.col("query_start") - before).alias("in_at"), "query_start", "query_end", "line_no", "ref_start", "ref_end")
    order = Window.partitionBy("query").orderBy("query_start", "query_end", "ref", "ref_start", "ref_end", "line_no")
    rows = rows.withColumn("p", F.lag(F.struct("ref", "ref_len", "turned", "out_at")).over(order)).filter("p IS NOT NULL AND p.ref <> ref")
    overlap = F.col("p.out_at") - F.col("in_at")
    rows = rows.filter((overlap <= F.col("ref_len")) & (overlap <= F.col("p.ref_len")))
    return rows.select(
        F.concat("p.ref", F.when(F.col("p.turned"), "_b").otherwise("_e")).alias("u"),
        F.concat("ref", F.when(F.col("turned"), "_e").otherwise("_b")).alias("v"),
        "query", "query_len", F.col("p.out_at").alias("my_end"), F.col("in_at").alias("their_start"),
    )


def single_bridges(edges: DataFrame) -> DataFrame:
    """Edges that are bridged once, in either direction."""
    pair = edges.withColumns({"_a": F.least("u", "v"), "_b": F.greatest("u", "v")})
    n = pair.groupBy("_a", "_b").agg(F.count("*").alias("_n")).filter("_n = 1")
    return pair.join(n, ["_a", "_b"], "left_semi").select(*edges.columns)


def mirrored(edges: DataFrame) -> DataFrame:
    """Each edge in both directions: backwards the query is read from its other end."""
    back = edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "query", "query_len", (F.col("query_len") - F.col("their_start")).alias("my_end"), (F.col("query_len") - F.col("my_end")).alias("their_start"), F.lit("-").alias("strand"))
    return edges.select("u", "v", "query", "query_len", "my_end", "their_start", F.lit("+").alias("strand")).unionByName(back)


def with_known(edges: DataFrame, known: DataFrame, fill_only: bool = False, join_only: bool = False) -> DataFrame:
    """Bridges and the target's own gaps (known: u, v, gap_len). Bridges that compete with a known neighbourhood
    for one of its ends go; fill_only keeps bridges of known gaps, join_only leaves known gaps as they are."""
    if fill_only and join_only:
        raise ValueError("fill only or join only")
    ends = known.select(F.col("u").alias("node")).unionByName(known.select(F.col("v").alias("node"))).distinct()
    pair = known.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), "gap_len")
    rows = edges.withColumns({"a": F.least("u", "v"), "b": F.greatest("u", "v")})
    same = rows.join(pair, ["a", "b"], "left_semi").select("a", "b", F.struct("u", "query", "query_len", "my_end", "their_start").alias("bridge"))
    free = rows.join(ends, F.col("u") == F.col("node"), "left_anti").join(ends, F.col("v") == F.col("node"), "left_anti")
    free = free.select("a", "b", F.struct("u", "query", "query_len", "my_end", "their_start").alias("bridge"), F.lit(None).cast("long").alias("gap_len"))
    gaps = pair.join(same, ["a", "b"], "left").select("a", "b", (F.lit(None).cast(same.schema["bridge"].dataType) if join_only else F.col("bridge")).alias("bridge"), "gap_len")
    out = gaps if fill_only else gaps.unionByName(free)
    return out.select(F.col("a").alias("u"), F.col("b").alias("v"), "bridge", "gap_len")

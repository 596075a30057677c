"""Joins of positions and intervals with intervals.

An interval is put into each bin that it touches and joined on (sequence, bin) and the exact condition; a pair is
reported in one bin only, that where the later of the two starts. Spark joins on equality and can split a bin that
is hot; no pair of rows that share no bin is ever looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BIN = 1 << 14


def _bins(start: Column, end: Column, width: int) -> Column:
    """The bins of a half-open interval; an empty one has the bin of its start."""
    return F.explode(F.sequence(F.floor(start / width), F.floor(F.greatest(start, end - 1) / width)))


def stabbing(points: DataFrame, intervals: DataFrame, width: int = BIN) -> DataFrame:
    """Pairs of points (seq, pos, ...) and intervals (seq, start, end, ...) with start <= pos < end. Columns of
    intervals come back with the prefix ``i_``."""
    boxes = intervals.select(*(F.col(c).alias(f"i_{c}") for c in intervals.columns)).withColumn("_bin", _bins(F.col("i_start"), F.col("i_end"), width))
    own = points.withColumn("_bin", F.floor(F.col("pos") / width))
    return own.join(boxes, (own["seq"] == boxes["i_seq"]) & (own["_bin"] == boxes["_bin"]) & (own["pos"] >= boxes["i_start"]) & (own["pos"] < boxes["i_end"])).drop("_bin")


def unstabbed(points: DataFrame, intervals: DataFrame, width: int = BIN) -> DataFrame:
    """Points that lie in no interval."""
    boxes = intervals.select(F.col("seq").alias("i_seq"), F.col("start").alias("i_start"), F.col("end").alias("i_end"), _bins(F.col("start"), F.col("end"), width).alias("i_bin"))
    own = points.withColumn("_bin", F.floor(F.col("pos") / width))
    return own.join(boxes, (F.col("seq") == F.col("i_seq")) & (F.col("_bin") == F.col("i_bin")) & (F.col("pos") >= F.col("i_start")) & (F.col("pos") < F.col("i_end")), "left_anti").drop("_bin")


def overlapping(left: DataFrame, right: DataFrame, width: int = BIN) -> DataFrame:
    """Pairs of half-open intervals of one sequence that share a base. Columns of right get the prefix ``r_``."""
    a = left.withColumn("_bin", _bins(F.col("start"), F.col("end"), width))
    b = right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns)).withColumn("r__bin", _bins(F.col("r_start"), F.col("r_end"), width))
    meet = (F.col("seq") == F.col("r_seq")) & (F.col("_bin") == F.col("r__bin")) & (F.col("start") < F.col("r_end")) & (F.col("r_start") < F.col("end"))
    once = F.col("_bin") == F.floor(F.greatest("start", "r_start") / width)
    return a.join(b, meet & once).drop("_bin", "r__bin")

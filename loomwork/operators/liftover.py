"""Annotation coordinates on pieces of sequences and on the objects that are laid out from them.

Features have seqid, source, feature, start, end (1-based closed), score, strand, phase, attributes and line_no.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .intervals import overlapping

FEATURE = ("seqid", "source", "feature", "start", "end", "score", "strand", "phase", "attributes", "line_no")


def to_pieces(features: DataFrame, layout: DataFrame, strict: bool = True) -> DataFrame:
    """Features on objects, moved to the pieces that hold them. ``problem`` says why one can't be moved (it spans
    several pieces, or none has it); strict raises instead."""
    pieces = layout.filter("comp IS NOT NULL").select(F.col("obj").alias("seq"), (F.col("obj_beg") - 1).alias("start"), F.col("obj_end").alias("end"), "comp")
    rows = features.select(F.struct(*FEATURE).alias("f"), F.col("seqid").alias("seq"), (F.col("start") - 1).alias("start"), F.col("end").alias("end"), "line_no")
    hits = overlapping(rows, pieces).groupBy("line_no").agg(F.count("*").alias("n"), F.first("r_comp").alias("comp"), F.first("r_start").alias("off"))
    out = rows.join(hits, "line_no", "left").withColumn("problem", F.when(F.col("n") > 1, "spans several pieces").when(F.col("n").isNull(), "on no piece"))
    if strict:
        out = out.withColumn("problem", F.when(F.col("problem").isNotNull(), F.raise_error(F.concat(F.lit("feature in line "), F.col("line_no").cast("string"), F.lit(" "), F.col("problem")))))
    ok = F.col("problem").isNull()
    moved = {"seqid": F.when(ok, F.col("comp")).otherwise(F.col("f.seqid")), "start": F.when(ok, F.col("f.start") - F.col("off")).otherwise(F.col("f.start")), "end": F.when(ok, F.col("f.end") - F.col("off")).otherwise(F.col("f.end"))}
    return out.select(*(moved.get(c, F.col(f"f.{c}")).alias(c) for c in FEATURE), "problem")


def to_objects(features: DataFrame, layout: DataFrame, strict: bool = True) -> DataFrame:
    """Features on components, moved to the objects that hold them; on components laid out reversed they are
    flipped, and any strand other than + becomes +. Of several rows of a component the last in the layout
    counts. ``problem`` marks features of no component; strict raises instead."""
    order = Window.partitionBy("comp").orderBy(F.desc("obj"), F.desc("pid"))
    comps = layout.filter("comp IS NOT NULL").withColumn("_r", F.row_number().over(order)).filter("_r = 1").select("comp", "obj", "obj_beg", "obj_end", F.col("orientation").alias("turn"))
    rows = features.join(comps, features["seqid"] == comps["comp"], "left")
    problem = F.when(F.col("comp").isNull(), F.lit("on no component"))
    if strict:
        problem = F.when(F.col("comp").isNull(), F.raise_error(F.concat(F.lit("no component "), F.col("seqid"))))
    back = F.col("turn") == "-"
    length = F.col("obj_end") - F.col("obj_beg") + 1
    start = F.when(back, length - F.col("end") + 1).otherwise(F.col("start")) + F.col("obj_beg") - 1
    end = F.when(back, length - F.col("start") + 1).otherwise(F.col("end")) + F.col("obj_beg") - 1
    known = F.col("comp").isNotNull()
    moved = {
        "seqid": F.coalesce("obj", "seqid"),
        "start": F.when(known, start).otherwise(F.col("start")),
        "end": F.when(known, end).otherwise(F.col("end")),
        "strand": F.when(back, F.when(F.col("strand") == "+", "-").otherwise("+")).otherwise(F.col("strand")),
    }
    return rows.select(*(moved.get(c, F.col(c)).alias(c) for c in FEATURE), problem.alias("problem"))

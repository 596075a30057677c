"""Checks and summaries of AGP version 2.1 layouts."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fixed values of the AGP 2.1 format.
SEQUENCE_TYPES = ("A", "D", "F", "G", "O", "P", "W")
GAP_COMPONENTS = ("N", "U")
ORIENTATIONS = ("+", "-", "?", "0", "na")
GAP_TYPES = ("scaffold", "contig", "centromere", "short_arm", "heterochromatin", "telomere", "repeat", "contamination")
LINKAGES = ("yes", "no")
EVIDENCE = ("na", "paired-ends", "align_genus", "align_xgenus", "align_trnscpt", "within_clone", "clone_contig", "map", "pcr", "proximity_ligation", "strobe", "unspecified")


def line_violations(lines: DataFrame) -> DataFrame:
    """Rules on raw lines (file, line_no, line): comments in the body, the number of fields, empty fields."""
    comment = F.col("line").startswith("#")
    body = Window.partitionBy("file")
    fields = F.split("line", "\t")
    rows = lines.withColumn("_first", F.min(F.when(~comment, F.col("line_no"))).over(body))
    rules = F.filter(
        F.array(
            F.when(comment & (F.col("line_no") > F.col("_first")), F.lit("comment in the body")),
            F.when(~comment & (F.size(fields) != 9), F.lit("not 9 fields")),
            F.when(~comment & F.exists(fields, lambda x: x == ""), F.lit("empty field")),
        ),
        lambda x: x.isNotNull(),
    )
    return rows.select("file", "line_no", F.explode(rules).alias("rule"))


def violations(layout: DataFrame) -> DataFrame:
    """(obj, line_no, rule) for each rule that a layout row breaks. Rows have line_no, order in the file. A number that
    the reader could not read is null, which breaks a rule of its own."""
    by_obj = Window.partitionBy("obj").orderBy("line_no")
    # an object's lines are contiguous if its line numbers have no hole that another object fills
    ranked = layout.withColumns({"_n": F.row_number().over(by_obj), "_line": F.lag("line_no").over(by_obj), "_pid": F.lag("pid").over(by_obj), "_end": F.lag("obj_end").over(by_obj)})
    gap, seq = F.col("comp_type").isin(*GAP_COMPONENTS), F.col("comp_type").isin(*SEQUENCE_TYPES)
    first = F.col("_n") == 1
    span = F.col("obj_end") - F.col("obj_beg") + 1
    evidence = F.split("linkage_evidence", ";")
    no = F.lit(False)

    def absent(*names: str) -> Column:
        return reduce(or_, (F.col(c).isNull() for c in names))

    checks: list[tuple[Column, str]] = [
        (absent("obj_beg", "obj_end", "pid") | (seq & absent("comp_beg", "comp_end")) | (gap & absent("gap_len")), "not an integer"),
        (~first & (F.col("line_no") != F.col("_line") + 1), "object not contiguous"),
        (first & ((F.col("obj_beg") != 1) | (F.col("pid") != 1)), "object does not start at 1"),
        (~first & (F.col("pid") != F.col("_pid") + 1), "part numbers not sequential"),
        (~first & (F.col("obj_beg") != F.col("_end") + 1), "object intervals not contiguous"),
        ((F.col("obj_beg") <= 0) | (F.col("obj_end") <= 0) | (F.col("pid") <= 0) | (F.col("obj_beg") > F.col("obj_end")), "bad object interval"),
        (~gap & ~seq, "unknown component type"),
        (seq & ((F.col("comp_beg") <= 0) | (F.col("comp_beg") > F.col("comp_end"))), "bad component interval"),
        (seq & (F.col("comp_end") - F.col("comp_beg") + 1 != span), "spans differ"),
        (seq & ~F.col("orientation").isin(*ORIENTATIONS), "unknown orientation"),
        (gap & ((F.col("gap_len") <= 0) | (F.col("gap_len") != span)), "bad gap length"),
        ((F.col("comp_type") == "U") & (F.col("gap_len") != 100), "unknown gap not of 100"),
        (gap & ~F.col("gap_type").isin(*GAP_TYPES), "unknown gap type"),
        (gap & ~F.col("linkage").isin(*LINKAGES), "unknown linkage"),
        (gap & ~F.forall(evidence, lambda x: x.isin(*EVIDENCE)), "unknown evidence"),
        (gap & (F.col("linkage") == "no") & ((F.col("gap_type") == "scaffold") | (F.col("linkage_evidence") != "na")), "evidence without linkage"),
        (gap & (F.col("linkage") == "yes") & F.exists(evidence, lambda x: x == "na"), "linkage without evidence"),
    ]
    rules = F.filter(F.array(*(F.when(F.coalesce(c, no), F.lit(text)) for c, text in checks)), lambda x: x.isNotNull())
    return ranked.select("obj", "line_no", F.explode(rules).alias("rule"))


def require_valid(layout: DataFrame) -> DataFrame:
    """layout, or an error with the first violation."""
    bad = violations(layout).orderBy("line_no", "rule").head(1)
    if bad:
        raise ValueError(f"line {bad[0]['line_no']} ({bad[0]['obj']}): {bad[0]['rule']}")
    return layout


def object_lengths(layout: DataFrame) -> DataFrame:
    return layout.groupBy("obj").agg(F.max_by("obj_end", "pid").alias("length"))


def counts(layout: DataFrame) -> DataFrame:
    return layout.agg(F.count("*").alias("n_lines"), F.countDistinct("obj").alias("n_objects"))


def scaffolding_stats(layout: DataFrame, placed: DataFrame) -> DataFrame:
    """Numbers and bases of placed and unplaced components and of gaps. placed: names of placed components."""
    names = placed.select(F.col("query").alias("comp")).distinct().withColumn("_placed", F.lit(True))
    rows = layout.join(names, "comp", "left")
    seq, put = F.col("comp").isNotNull(), F.coalesce("_placed", F.lit(False))
    size = F.col("obj_end") - F.col("obj_beg") + 1
    total = lambda c, x: F.coalesce(F.sum(F.when(c, x)), F.lit(0)).cast("long")
    one = F.lit(1)
    return rows.agg(
        total(seq & put, one).alias("placed_sequences"), total(seq & put, size).alias("placed_bp"),
        total(seq & ~put, one).alias("unplaced_sequences"), total(seq & ~put, size).alias("unplaced_bp"),
        total(~seq, F.col("gap_len")).alias("gap_bp"), total(~seq, one).alias("gap_sequences"),
    )

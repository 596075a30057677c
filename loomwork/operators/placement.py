"""Order of queries along references, gaps between them, and layout rows with running coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwork.tables import running

#: Bases of a gap of unknown size.
UNKNOWN_GAP = 100


def uncontained_in_ref(placed: DataFrame) -> DataFrame:
    """Placements whose reference interval reaches beyond all that come before it."""
    order = Window.partitionBy("ref").orderBy("ref_start", F.desc("ref_end"), "query")
    reach = F.max("ref_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return placed.withColumn("_reach", reach).filter("_reach IS NULL OR ref_end > _reach").drop("_reach")


def overhangs() -> tuple[Column, Column]:
    """Query bases beyond the primary alignment, to the left and right along the reference."""
    head, tail = F.col("query_start"), F.col("query_len") - F.col("query_end")
    forward = F.col("strand") == "+"
    return F.when(forward, head).otherwise(tail), F.when(forward, tail).otherwise(head)


def with_gaps(placed: DataFrame, infer: bool = True, smallest: int = 100, largest: int = 100_000) -> DataFrame:
    """Each placement with its place in the order, the size estimated for the gap after it (null for the last),
    the gap's size and type (N: known, U: unknown) and, if unknown, whether the estimate was too small or large."""
    left, right = overhangs()
    order = Window.partitionBy("ref").orderBy("ref_start", "ref_end", "query")
    rows = placed.withColumns({"_left": left, "_right": right})
    rows = rows.withColumns({"place": F.row_number().over(order), "_next": F.lead(F.col("ref_start") - F.col("_left")).over(order)})
    rows = rows.withColumn("estimate", F.col("_next") - (F.col("ref_end") + F.col("_right")))
    known = (F.col("estimate") > smallest) & (F.col("estimate") <= largest) & F.lit(infer)
    return rows.withColumns({
        "gap_size": F.when(F.col("estimate").isNotNull(), F.when(known, F.col("estimate")).otherwise(UNKNOWN_GAP)),
        "gap_type": F.when(F.col("estimate").isNotNull(), F.when(known, "N").otherwise("U")),
        "too_small": F.coalesce((F.col("estimate") <= smallest) & F.lit(infer), F.lit(False)),
        "too_large": F.coalesce((F.col("estimate") > largest) & F.lit(infer), F.lit(False)),
    }).drop("_left", "_right", "_next")


def gap_counts(with_gap_rows: DataFrame) -> DataFrame:
    """How many gaps are inferred, too small and too large."""
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    return with_gap_rows.agg(count(F.col("gap_type") == "N").alias("inferred"), count(F.col("too_small")).alias("too_small"), count(F.col("too_large")).alias("too_large"))


def laid_out(parts: DataFrame) -> DataFrame:
    """Layout rows from parts (obj, ord, length and whatever else): pid and the running obj_beg and obj_end,
    1-based closed."""
    order = Window.partitionBy("obj").orderBy("ord")
    end = F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return parts.withColumns({"pid": F.row_number().over(order).cast("long"), "obj_end": end, "obj_beg": end - F.col("length") + 1})


LAYOUT = ("obj", "obj_beg", "obj_end", "pid", "comp_type", "comp", "comp_beg", "comp_end", "orientation", "gap_len", "gap_type", "linkage", "linkage_evidence")


def sequence_part(name: Column, length: Column, strand: Column, order: Column, beg: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct(
        order.cast("long").alias("ord"), length.cast("long").alias("length"), F.lit("W").alias("comp_type"), name.alias("comp"),
        (F.lit(1) if beg is None else beg).cast("long").alias("comp_beg"), (length if beg is None else beg + length - 1).cast("long").alias("comp_end"), strand.alias("orientation"),
        none.cast("long").alias("gap_len"), none.cast("string").alias("gap_type"), none.cast("string").alias("linkage"), none.cast("string").alias("linkage_evidence"),
    )


def gap_part(kind: Column, length: Column, order: Column, gap_type: Column, linkage: Column, evidence: Column) -> Column:
    none = F.lit(None)
    return F.struct(
        order.cast("long").alias("ord"), length.cast("long").alias("length"), kind.alias("comp_type"), none.cast("string").alias("comp"),
        none.cast("long").alias("comp_beg"), none.cast("long").alias("comp_end"), none.cast("string").alias("orientation"),
        length.cast("long").alias("gap_len"), gap_type.alias("gap_type"), linkage.alias("linkage"), evidence.alias("linkage_evidence"),
    )


def scaffold_layout(gapped: DataFrame, suffix: str = "_placed") -> DataFrame:
    """The layout of placed queries: each followed by its gap, but for the last of a reference."""
    seq = sequence_part(F.col("query"), F.col("query_len"), F.col("strand"), 2 * F.col("place"))
    gap = gap_part(F.col("gap_type"), F.col("gap_size"), 2 * F.col("place") + 1, F.lit("scaffold"), F.lit("yes"), F.lit("align_genus"))
    both = F.explode(F.when(F.col("gap_size").isNull(), F.array(seq)).otherwise(F.array(seq, gap)))
    parts = gapped.select(F.concat("ref", F.lit(suffix)).alias("obj"), both.alias("p")).select("obj", "p.*")
    return laid_out(parts).select(*LAYOUT)


def unplaced_layout(sequences: DataFrame, placed: DataFrame, suffix: str = "_placed", concatenate: str | None = None) -> DataFrame:
    """The layout of sequences (name, length) that aren't placed (query): each an object of its own, or all in
    one object of that name, by name, with unknown gaps between them."""
    left = sequences.select("name", "length").join(placed.select(F.col("query").alias("name")), "name", "left_anti")
    if concatenate is None:
        seq = sequence_part(F.col("name"), F.col("length"), F.lit("+"), F.lit(0))
        return laid_out(left.select(F.concat("name", F.lit(suffix)).alias("obj"), seq.alias("p")).select("obj", "p.*")).select(*LAYOUT)
    rows = running(left, ["name"], "_n")
    seq = sequence_part(F.col("name"), F.col("length"), F.lit("+"), 2 * F.col("_n"))
    gap = gap_part(F.lit("U"), F.lit(UNKNOWN_GAP), 2 * F.col("_n") - 1, F.lit("contig"), F.lit("no"), F.lit("na"))
    both = F.explode(F.when(F.col("_n") == 0, F.array(seq)).otherwise(F.array(gap, seq)))
    return laid_out(rows.select(F.lit(concatenate).alias("obj"), both.alias("p")).select("obj", "p.*")).select(*LAYOUT)

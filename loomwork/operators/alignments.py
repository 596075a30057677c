"""Filters and flags on pairwise alignments.

An alignment table has one row per alignment: query, query_len, query_start, query_end, strand, ref, ref_len,
ref_start, ref_end, num_match, aln_len, mapq and line_no (order within a query). Coordinates are 0-based half-open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

COLUMNS = ("query", "query_len", "query_start", "query_end", "strand", "ref", "ref_len", "ref_start", "ref_end", "num_match", "aln_len", "mapq", "line_no")


def ref_span() -> Column:
    return F.col("ref_end") - F.col("ref_start")


def with_min_length(alns: DataFrame, length: int) -> DataFrame:
    return alns.filter(ref_span() >= length)


def with_min_mapq(alns: DataFrame, mapq: int) -> DataFrame:
    return alns.filter(F.col("mapq") >= mapq)


def without_names(alns: DataFrame, queries: DataFrame | None = None, refs: DataFrame | None = None) -> DataFrame:
    """Rows whose query or reference isn't in a one-column table ``name``."""
    for names, column in ((queries, "query"), (refs, "ref")):
        if names is not None:
            alns = alns.join(names.select(F.col("name").alias(column)).distinct(), column, "left_anti")
    return alns.select(*(c for c in alns.columns))


def near(distance: float) -> Column:
    """Bases that count as near an end: a share of the reference's length if under 1."""
    if distance <= 0:
        raise ValueError("the distance must be positive")
    return distance * F.col("ref_len") if distance < 1 else F.lit(distance)


def with_end_flags(alns: DataFrame, distance: float) -> DataFrame:
    """Whether the alignment comes near each end of its reference and of its query. A share counts from the
    reference's length on both sides."""
    d = near(distance)
    return alns.withColumns({
        "ref_left": F.col("ref_start") <= d,
        "ref_right": F.col("ref_len") - F.col("ref_end") <= d,
        "query_left": F.col("query_start") <= d,
        "query_right": F.col("query_len") - F.col("query_end") <= d,
    })


def terminal_only(alns: DataFrame, distance: float) -> DataFrame:
    return with_end_flags(alns, distance).filter("ref_left OR ref_right").select(*alns.columns)


def query_summary(alns: DataFrame, distance: float) -> DataFrame:
    """Per query: n_alns, n_refs and ``internal``: some alignment is near neither query end and does not reach
    both reference ends."""
    flags = with_end_flags(alns, distance)
    cut = ~(F.col("query_left") | F.col("query_right")) & ~(F.col("ref_left") & F.col("ref_right"))
    return flags.groupBy("query").agg(F.count("*").alias("n_alns"), F.countDistinct("ref").alias("n_refs"), F.bool_or(cut).alias("internal"))


def useful_for_patching(alns: DataFrame, length: int, distance: float) -> DataFrame:
    """Long alignments at reference ends of queries with several references and no internal cut."""
    alns = terminal_only(with_min_length(alns, length), distance)
    good = query_summary(alns, distance).filter("n_refs > 1 AND NOT internal").select("query")
    return alns.join(good, "query", "left_semi").select(*alns.columns)


def unique_anchors(alns: DataFrame, length: int, keep_small: bool = False) -> DataFrame:
    """Alignments that alone cover at least ``length`` query bases; with keep_small also those whose interval is
    one stretch that they cover alone. line_no must be unique in a query and positive.

    A sweep over interval ends, by position, row and start before end: where the running depth is 1, the running
    sum of signed row numbers names the alignment that is open. The events of a row's start carry the row, and each
    event gives its stretch to the alignment that is open, so rows and stretches meet in one aggregate: all is dealt
    out by query once, and there is no join.
    """
    row = F.struct(*(F.col(c) for c in alns.columns if c not in ("query", "line_no")))
    event = lambda pos, kind, sign, row: F.struct(F.col(pos).cast("long").alias("pos"), F.lit(kind).alias("kind"), F.lit(sign).cast("long").alias("sign"), row.alias("row"))
    ends = F.array(event("query_start", 0, 1, row), event("query_end", 1, -1, F.lit(None)))
    # one shuffle, unless the rows are dealt out by query already
    events = _by_query(alns).select("query", "line_no", F.explode(ends).alias("e")).select("query", "line_no", "e.*")
    order = Window.partitionBy("query").orderBy("pos", "line_no", "kind")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    swept = events.select(
        "query", "line_no", "row", "pos",
        F.lag("pos").over(order).alias("from"),
        F.sum("sign").over(past).alias("depth"),
        F.sum(F.col("sign") * F.col("line_no")).over(past).alias("open"),
    )
    none = F.lit(None)
    own = F.struct("line_no", none.cast("long").alias("alone"), "row")
    stretch = F.struct(F.col("open").alias("line_no"), (F.col("pos") - F.col("from")).alias("alone"), none.cast(swept.schema["row"].dataType).alias("row"))
    given = F.filter(F.array(F.when(F.col("row").isNotNull(), own), F.when(F.col("depth") == 1, stretch)), lambda x: x.isNotNull())
    met = swept.select("query", F.explode(given).alias("g")).select("query", "g.*").groupBy("query", "line_no")
    found = met.agg(F.sum("alone").alias("_alone"), F.max("alone").alias("_longest"), F.first("row", ignorenulls=True).alias("row"))
    keep = F.coalesce("_alone", F.lit(0)) >= length
    if keep_small:  # stretches lie in their alignment's interval
        keep = keep | F.coalesce(F.col("_longest") == F.col("row.query_end") - F.col("row.query_start"), F.lit(False))
    return found.filter(keep).select(*(F.col(c) if c in ("query", "line_no") else F.col(f"row.{c}").alias(c) for c in alns.columns))


def _by_query(alns: DataFrame) -> DataFrame:
    """alns, dealt out by query before what follows makes more rows of them. A window asks for it, so that Spark shuffles
    only where it must; an explicit repartition always would."""
    at = Window.partitionBy("query").orderBy("line_no")
    return alns.withColumn("_at", F.row_number().over(at)).filter("_at > 0").drop("_at")


def uncontained_in_query(alns: DataFrame) -> DataFrame:
    """Alignments whose query interval lies in no other's. Of equal intervals the first by reference position
    stays."""
    order = Window.partitionBy("query").orderBy("query_start", F.desc("query_end"), "ref", "ref_start", "ref_end", "line_no")
    reach = F.max("query_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return alns.withColumn("_reach", reach).filter("_reach IS NULL OR query_end > _reach").drop("_reach")

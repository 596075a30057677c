"""Break points of queries: candidates, validation by read depth, clean-up, and the pieces they leave."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwork.tables import dealt, written

from .placement import LAYOUT, laid_out, sequence_part


def candidates(alns: DataFrame, from_end: int = 5000, kinds: tuple[str, ...] = ("intra", "inter")) -> DataFrame:
    """Starts of alignments after the first of a query that lie more than ``from_end`` from its ends; intra if the
    alignment before is on the same reference, else inter."""
    order = Window.partitionBy("query").orderBy("query_start", "query_end", "ref", "ref_start", "ref_end", "line_no")
    rows = alns.select("query", "query_len", F.col("query_start").alias("pos"), "ref", F.lag("ref").over(order).alias("_before"))
    rows = rows.filter(F.col("_before").isNotNull() & (F.col("pos") > from_end) & (F.col("pos") < F.col("query_len") - from_end))
    rows = rows.withColumn("kind", F.when(F.col("ref") == F.col("_before"), "intra").otherwise("inter"))
    return rows.filter(F.col("kind").isin(*kinds)).select("query", "query_len", "pos", "kind")


def histogram(depth: DataFrame) -> DataFrame:
    """How many bases (n_bp) have each depth (cov), from stretches."""
    return depth.filter("depth > 0").groupBy(F.col("depth").alias("cov")).agg(F.sum(F.col("end") - F.col("start")).alias("n_bp"))


def median_coverage(histogram: DataFrame) -> DataFrame:
    """One row, ``median``: place (from 0) of the first bin of (cov, n_bp) at which the running sum reaches half;
    the last, catch-all bin doesn't count. The histogram has one row for each coverage value."""
    order = Window.orderBy("cov")
    rows = histogram.select("cov", "n_bp", (F.row_number().over(order) - 1).alias("place"), F.lead("cov").over(order).isNull().alias("_last")).filter("NOT _last")
    rows = rows.select("place", F.sum("n_bp").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.sum("n_bp").over(Window.partitionBy()).alias("total"))
    return rows.filter(2 * F.col("upto") >= F.col("total")).agg(F.min("place").cast("long").alias("median"))


def thresholds(median: DataFrame) -> DataFrame:
    """median with ``low`` and ``high``: five deviations (square roots of the median) below, at least 5, and
    twelve times the median."""
    deviation = F.rint(F.sqrt("median")).cast("long")
    return median.withColumns({"low": F.greatest(F.lit(5).cast("long"), F.col("median") - 5 * deviation), "high": 12 * F.col("median")})


def filled(depth: DataFrame, lengths: DataFrame) -> DataFrame:
    """Stretches (seq, start, end, depth) over the whole of each sequence of lengths (seq, query_len): those of depth
    over 0, and stretches of depth 0 before, between and behind them, or one alone."""
    every = Window.partitionBy("seq")
    order = every.orderBy("start")
    rows = lengths.join(dealt(depth.filter("depth > 0").select("seq", "start", "end", F.col("depth").cast("long").alias("depth"))), "seq", "left")
    rows = rows.withColumns({"_from": F.coalesce(F.lag("end").over(order), F.lit(0)), "_end": F.coalesce(F.max("end").over(every), F.lit(0)), "_last": F.lead("start").over(order).isNull()})
    own = lambda a, b, d: F.struct(F.col(a).cast("long").alias("start"), F.col(b).cast("long").alias("end"), d.cast("long").alias("depth"))
    none, some = F.lit(0), F.col("start").isNotNull()
    # one pass: each stretch with the hole before it, and the last (or a sequence without any) with the rest
    out = F.array(F.when(some & (F.col("_from") < F.col("start")), own("_from", "start", none)), F.when(some, own("start", "end", F.col("depth"))), F.when(F.col("_last") & (F.col("_end") < F.col("query_len")), own("_end", "query_len", none)))
    return rows.select("seq", F.explode(F.filter(out, lambda x: x.isNotNull())).alias("s")).select("seq", "s.*")


def validated(breaks: DataFrame, depth: DataFrame, limits: DataFrame, window: int = 10_000, from_end: int = 1000) -> DataFrame:
    """Break points that the read depth near them confirms. Within half a window, clamped ``from_end`` from the
    query's ends, the lowest depth must be at most ``low`` or the highest at least ``high``; the break moves to
    that position, to the lowest if both hold, to the first of several. depth: stretches (seq, start, end, depth);
    positions without one have depth 0. Windows that the clamp leaves empty confirm nothing. limits: one row with low
    and high.

    Stretches and windows meet in bins of a window's width, so a long stretch is many rows of one sequence, and no
    position is a row of its own."""
    breaks = written(breaks.select("query", "query_len", "pos"), "breaks")  # read twice
    half, width = window // 2, max(1, window)
    rows = breaks.select("query", "query_len", "pos", F.greatest(F.col("pos") - half, F.lit(from_end)).alias("lo"), F.least(F.col("pos") + half, F.col("query_len") - from_end).alias("hi")).distinct().filter("lo < hi")
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / width), F.floor((b - 1) / width)))
    spots = rows.withColumn("_bin", bins(F.col("lo"), F.col("hi")))
    lengths = breaks.select(F.col("query").alias("seq"), "query_len").distinct()
    seen = filled(depth, lengths).select(F.col("seq").alias("d_seq"), F.col("start").alias("d_start"), F.col("end").alias("d_end"), F.col("depth").alias("d"), bins(F.col("start"), F.col("end")).alias("d_bin"))
    near = spots.join(seen, (F.col("query") == F.col("d_seq")) & (F.col("_bin") == F.col("d_bin")) & (F.col("d_end") > F.col("lo")) & (F.col("d_start") < F.col("hi")))
    near = near.withColumn("d_pos", F.greatest("d_start", "lo"))
    found = near.groupBy("query", "query_len", "pos").agg(F.min(F.struct("d", "d_pos")).alias("least"), F.min(F.struct((-F.col("d")).alias("d"), "d_pos")).alias("most"))
    found = found.crossJoin(F.broadcast(limits.select("low", "high").limit(1)))
    moved = F.when(F.col("least.d") <= F.col("low"), F.col("least.d_pos")).when(-F.col("most.d") >= F.col("high"), F.col("most.d_pos"))
    return found.select("query", "query_len", F.col("pos").alias("candidate"), moved.alias("pos")).filter("pos IS NOT NULL")


def spaced(breaks: DataFrame, distance: int) -> DataFrame:
    """Breaks in order of position without those within ``distance`` of the last that was kept. A query's breaks
    are few, so the fold is over their sorted array."""
    points = breaks.groupBy("query", "query_len").agg(F.sort_array(F.collect_set("pos")).alias("_p"))
    kept = F.aggregate("_p", F.expr("cast(array() as array<bigint>)"), lambda acc, p: F.when((F.size(acc) == 0) | (p - F.try_element_at(acc, F.lit(-1)) > distance), F.concat(acc, F.array(p.cast("long")))).otherwise(acc))
    return points.select("query", "query_len", F.explode(kept).alias("pos"))


def pieces_layout(sequences: DataFrame, breaks: DataFrame, suffix: str = "+") -> DataFrame:
    """Layout rows that cut sequences (name, length) at breaks (query, pos): each piece is a component named by
    sequence, start, end and suffix. Sequences without breaks stay whole under their own name."""
    cuts = breaks.groupBy(F.col("query").alias("name")).agg(F.sort_array(F.collect_set("pos")).alias("_p"))
    rows = sequences.select("name", F.col("length").cast("long").alias("length")).join(cuts, "name", "left")
    ends = F.concat("_p", F.array("length"))
    starts = F.concat(F.array(F.lit(0).cast("long")), F.col("_p"))
    spans = F.when(F.col("_p").isNull(), F.array(F.struct(F.lit(0).cast("long").alias("a"), F.col("length").alias("b")))).otherwise(F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda x: F.struct(x["a"].cast("long").alias("a"), x["b"].cast("long").alias("b"))))
    rows = rows.select("name", F.col("_p").isNotNull().alias("_cut"), F.posexplode(spans).alias("_i", "s"))
    piece = F.when(F.col("_cut"), F.concat_ws("_", "name", (F.col("s.a") + 1).cast("string"), F.col("s.b").cast("string"), F.lit(suffix))).otherwise(F.col("name"))
    part = sequence_part(piece, F.col("s.b") - F.col("s.a"), F.lit("+"), F.col("_i"))
    return laid_out(rows.select(F.col("name").alias("obj"), part.alias("p")).select("obj", "p.*")).select(*LAYOUT)

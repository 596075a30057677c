"""The composite commands: scaffold, correct, merge and patch, from tables to tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwork.operators import alignments, breaks, chaining, graph, intervals, links, patching, placement, scoring
from loomwork.operators.agp import scaffolding_stats
from loomwork.tables import dealt, running, written


@dataclass(frozen=True)
class Filters:
    """Smallest unique anchor, whether smaller alignments that stand alone stay, least mapping quality, and the
    distance over which alignments are chained."""

    anchor: int = 1000
    keep_small: bool = True
    mapq: int = 10
    chain: int = 100_000


def filtered(alns: DataFrame, how: Filters) -> DataFrame:
    """Unique anchors of good quality, chained."""
    rows = alignments.unique_anchors(alns, how.anchor, how.keep_small)
    return chaining.chained(alignments.with_min_mapq(rows, how.mapq), how.chain)


@dataclass(frozen=True)
class Scaffold:
    layout: DataFrame
    confidence: DataFrame
    gaps: DataFrame
    stats: DataFrame


def scaffold(alns: DataFrame, sequences: DataFrame, how: Filters = Filters(), grouping: float = 0.2, location: float = 0.0, orientation: float = 0.0, infer_gaps: bool = False, smallest: int = 100, largest: int = 100_000, suffix: str = "_placed", concatenate: str | None = None, skip_queries: DataFrame | None = None, skip_refs: DataFrame | None = None) -> Scaffold:
    """Queries ordered and oriented along references: layout, confidences of the placed, counts of inferred gaps
    and statistics."""
    if smallest <= 0 or largest <= 0:
        raise ValueError("gap sizes must be positive")
    alns = alignments.without_names(alns, skip_queries, skip_refs)
    scored = scoring.confident(scoring.scores(filtered(alns, how)), grouping, location, orientation)
    placed = placement.with_gaps(placement.uncontained_in_ref(scored), infer_gaps, smallest, largest)
    layout = placement.scaffold_layout(placed, suffix).unionByName(placement.unplaced_layout(sequences, placed, suffix, concatenate))
    return Scaffold(layout, placed.select("query", "grouping", "location", "orientation"), placement.gap_counts(placed), scaffolding_stats(layout, placed))


def correct(alns: DataFrame, sequences: DataFrame, how: Filters = Filters(), from_end: int = 5000, kinds: tuple[str, ...] = ("intra", "inter"), depth: DataFrame | None = None, limits: DataFrame | None = None, window: int = 10_000, clamp: int = 1000, spacing: int = 1000, features: DataFrame | None = None) -> DataFrame:
    """The layout that cuts queries at break points; with depth (stretches; and its limits) at those that it confirms,
    and not inside features (seq, start, end)."""
    points = breaks.candidates(filtered(alns, how), from_end, kinds)
    if depth is not None:
        if limits is None:
            raise ValueError("depth needs limits")
        points = breaks.spaced(breaks.validated(points, depth, limits, window, clamp), spacing)
    if features is not None:
        points = intervals.unstabbed(points.withColumn("seq", F.col("query")), features).drop("seq")
    return breaks.pieces_layout(sequences, points.select("query", "pos"))


def merge(layouts: list[tuple[DataFrame, float]], sequences: DataFrame, shortest: int = 100_000, least: float = 0.0, read_links: DataFrame | None = None, gap_size: str = "min", suffix: str = "_placed", skip: DataFrame | None = None) -> DataFrame:
    """One layout from several (with weights), by a matching of greatest weight. With links (u, v, weight) the
    edges take their best-buddy weights, and those without links go. Components of ``skip`` (name) get no edges."""
    if len(layouts) < 2:
        raise ValueError("merging needs two layouts or more")
    edges = None
    for layout, weight in layouts:
        some = graph.realized(graph.adjacencies(layout), weight)
        edges = some if edges is None else edges.unionByName(some)
    if skip is not None:
        edges = graph.without_components(edges, skip)
    one = graph.merged(graph.of_long_components(edges, sequences, shortest))
    if read_links is not None:
        one = graph.reweighted(one, graph.best_buddy(graph.merged(links.as_edges(read_links))))
    elif least > 0:
        one = graph.lightened(one, least)
    one = written(one, "merged")
    paths = graph.walked(graph.cover(one, graph.matched(one), sequences.select("name")))
    return graph.path_layout(paths, one, sequences, gap_size, suffix=suffix)


def patch_edges(alns: DataFrame, targets: DataFrame, how: Filters = Filters(), length: int = 50_000, distance: float = 0.05, fill_only: bool = False, join_only: bool = False) -> DataFrame:
    """Edges between target pieces, from alignments that bridge them and from the target's own gaps (targets: its
    layout): u, v, bridge, gap_len."""
    useful = alignments.useful_for_patching(filtered(alns, how), length, distance)
    edges = patching.single_bridges(patching.bridges(useful, distance))
    known = graph.adjacencies(targets)
    turned = lambda c: F.col(c) == "-"
    end_of_a = F.concat("comp_a", F.when(turned("strand_a"), "_b").otherwise("_e"))
    start_of_b = F.concat("comp_b", F.when(turned("strand_b"), "_e").otherwise("_b"))
    known = known.select(end_of_a.alias("u"), start_of_b.alias("v"), F.col("gap_size").alias("gap_len"))
    return patching.with_known(edges, known, fill_only, join_only)


def patch(alns: DataFrame, targets: DataFrame, sequences: DataFrame, how: Filters = Filters(), length: int = 50_000, distance: float = 0.05, fill_only: bool = False, join_only: bool = False, prefix: str = "scf") -> DataFrame:
    """The layout of target pieces joined over a matching: where a query bridges two, its bases between them are a
    component; where they overlap, the next piece begins later; other neighbours keep their gap."""
    edges = written(patch_edges(alns, targets, how, length, distance, fill_only, join_only), "bridges")
    names = targets.filter("comp IS NOT NULL").select(F.col("comp").alias("name")).distinct()
    sized = sequences.join(dealt(names), "name", "left_semi").select("name", F.col("length").cast("long").alias("length"))
    plain = edges.select("u", "v", F.lit(1.0).alias("weight"))
    paths = graph.walked(graph.cover(plain, graph.matched(plain), names))
    rows = paths.join(dealt(edges), ["u", "v"], "left").join(dealt(sized), F.col("comp") == F.col("name"))
    node = F.concat("comp", F.when(F.col("strand") == "+", "_e").otherwise("_b"))
    along = node == F.col("bridge.u")
    rows = rows.withColumn("_span", F.col("bridge.their_start") - F.col("bridge.my_end"))
    w = Window.partitionBy("root").orderBy("place")
    rows = rows.withColumn("_trim", F.coalesce(F.lag(F.greatest(-F.col("_span"), F.lit(0))).over(w), F.lit(0)))
    seq = placement.sequence_part(F.col("comp"), F.col("length") - F.col("_trim"), F.col("strand"), 2 * F.col("place"), 1 + F.col("_trim"))
    filled = placement.sequence_part(F.col("bridge.query"), F.col("_span"), F.when(along, "+").otherwise("-"), 2 * F.col("place") + 1, F.col("bridge.my_end") + 1)
    gap = placement.gap_part(F.lit("N"), F.col("gap_len"), 2 * F.col("place") + 1, F.lit("scaffold"), F.lit("yes"), F.lit("align_genus"))
    both = F.when(F.col("_span") > 0, F.array(seq, filled)).when(F.col("_span").isNull() & (F.col("gap_len") > 0), F.array(seq, gap)).otherwise(F.array(seq))
    number = running(paths.select("root").distinct(), ["root"], "_k")
    rows = rows.join(dealt(number), "root")
    obj = F.concat(F.lit(prefix), F.lpad(F.col("_k").cast("string"), 8, "0"))
    return placement.laid_out(rows.select(obj.alias("obj"), F.explode(both).alias("p")).select("obj", "p.*")).select(*placement.LAYOUT)

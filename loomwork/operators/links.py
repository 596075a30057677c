"""Proximity links between sequence ends from read pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwork.functions.sequences import half_cutoffs, node_end, sites_upto


def mate_pairs(reads: DataFrame) -> DataFrame:
    """Pairs of a read and the eligible record before it with the same name, the other mate flag and another
    reference: q_name, ref_a, pos_a, ref_b, pos_b. Unmapped and secondary records are skipped. Records of a name
    are neighbours in a name-sorted file, so the order is needed within a name only."""
    order = Window.partitionBy("q_name").orderBy("rec_no")
    mid = F.col("ref_start") + F.floor((F.col("ref_end") - F.col("ref_start")) / 2)
    rows = reads.filter(~F.col("is_unmapped") & ~F.col("is_secondary")).select("q_name", "is_read1", "ref", mid.alias("pos"), F.lag(F.struct("is_read1", "ref", mid.alias("pos"))).over(order).alias("p"))
    rows = rows.filter((F.col("p.is_read1") != F.col("is_read1")) & (F.col("p.ref") != F.col("ref")))
    return rows.select("q_name", F.col("p.ref").alias("ref_a"), F.col("p.pos").alias("pos_a"), F.col("ref").alias("ref_b"), F.col("pos").alias("pos_b"))


def link_counts(pairs: DataFrame, sequences: DataFrame, share: float = 1.0) -> DataFrame:
    """Links by pair of sequence ends: u, v, raw. Pairs with a read between the parts that count are skipped."""
    left, right = half_cutoffs(F.col("length"), share)
    cuts = sequences.select("name", left.alias("l"), right.alias("r"))
    for side in "ab":
        own = cuts.select(F.col("name").alias(f"ref_{side}"), F.col("l").alias(f"l_{side}"), F.col("r").alias(f"r_{side}"))
        pairs = pairs.join(own, f"ref_{side}").withColumn(f"n_{side}", node_end(F.col(f"ref_{side}"), F.col(f"pos_{side}"), F.col(f"l_{side}"), F.col(f"r_{side}")))
    pairs = pairs.filter("n_a IS NOT NULL AND n_b IS NOT NULL")
    return pairs.groupBy(F.least("n_a", "n_b").alias("u"), F.greatest("n_a", "n_b").alias("v")).agg(F.count("*").alias("raw"))


def length_norms(sequences: DataFrame, share: float = 1.0) -> DataFrame:
    """Normalisers of sequence ends without restriction sites: node, norm. For the right end it is the position
    where that part begins, as the format's users expect."""
    left, right = half_cutoffs(F.col("length"), share)
    both = F.array(F.struct(F.concat("name", F.lit("_b")).alias("node"), left.alias("norm")), F.struct(F.concat("name", F.lit("_e")).alias("node"), right.alias("norm")))
    return sequences.select(F.explode(both).alias("x")).select("x.*")


def site_norms(sequences: DataFrame, share: float = 1.0) -> DataFrame:
    """Normalisers from sorted restriction sites (name, length, sites): how many are in each end's part."""
    left, right = half_cutoffs(F.col("length"), share)
    both = F.array(
        F.struct(F.concat("name", F.lit("_b")).alias("node"), sites_upto(F.col("sites"), left).cast("long").alias("norm")),
        F.struct(F.concat("name", F.lit("_e")).alias("node"), (F.size("sites") - sites_upto(F.col("sites"), right)).cast("long").alias("norm")),
    )
    return sequences.select(F.explode(both).alias("x")).select("x.*")


def normalised(links: DataFrame, norms: DataFrame) -> DataFrame:
    """Links with ``weight``: the count over the sum of the ends' normalisers; links where that is 0 go."""
    for side in "uv":
        links = links.join(norms.select(F.col("node").alias(side), F.col("norm").alias(f"_{side}")), side)
    return links.select("u", "v", "raw", F.try_divide(F.col("raw").cast("double"), (F.col("_u") + F.col("_v")).cast("double")).alias("weight")).filter("weight IS NOT NULL")


def as_edges(links: DataFrame) -> DataFrame:
    """Links (u, v, weight) as graph edges with fixed evidence."""
    return links.select("u", "v", "weight", F.lit(False).alias("known"), F.lit(100).cast("long").alias("gap_size"), F.lit("scaffold").alias("gap_type"), F.lit(True).alias("linkage"), F.lit("proximity_ligation").alias("linkage_evidence"))

"""Assembly statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def assembly_stats(lengths: DataFrame, genome_size: int = 0) -> DataFrame:
    """Per assembly (asm, length): n_seqs, total_bp, shortest, longest, auN, N50, N90, L50, L90. With a genome
    size, shares are of that (auNG and so on, under the same names). Nx is the first length, from the longest, at
    which the running sum is over x per cent; null if it never is.

    Lengths are counted first, so the running sums are over distinct lengths. Sequences may be empty; the auN of a
    whole of 0 is null.
    """
    by = lengths.groupBy("asm", "length").agg(F.count("*").alias("n"))
    every = Window.partitionBy("asm")
    down = every.orderBy(F.desc("length"))
    whole = F.lit(genome_size) if genome_size else F.sum(F.col("length") * F.col("n")).over(every)
    upto = down.rowsBetween(Window.unboundedPreceding, 0)
    rows = by.select(
        "asm", "length", "n", whole.cast("double").alias("whole"),
        F.sum(F.col("length") * F.col("n")).over(upto).alias("bp"),
        F.sum("n").over(upto).alias("seqs"),
    )

    def over(share: float):
        # how many of this length it takes to get over the share
        need = F.floor(F.try_divide(share * F.col("whole") - (F.col("bp") - F.col("length") * F.col("n")), F.col("length"))) + 1
        reached = F.col("bp") > share * F.col("whole")
        return F.max(F.when(reached, F.col("length"))), F.min(F.when(reached, F.col("seqs") - F.col("n") + F.greatest(need, F.lit(1))))

    (n50, l50), (n90, l90) = over(0.5), over(0.9)
    square = F.sum(F.col("n") * F.col("length").cast("double") * F.try_divide(F.col("length"), F.col("whole")))
    return rows.groupBy("asm").agg(
        F.sum("n").alias("n_seqs"), F.sum(F.col("n") * F.col("length")).alias("total_bp"), F.min("length").alias("shortest"), F.max("length").alias("longest"),
        F.rint(square).cast("long").alias("au_n"), n50.alias("n50"), n90.alias("n90"), l50.cast("long").alias("l50"), l90.cast("long").alias("l90"),
    )

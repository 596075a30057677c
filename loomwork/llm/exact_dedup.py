"""Exact dedup by content sort, in DataFrame functions only.

Sampled splitters (Spark's range partitioner) deal the normalised texts out, an external sort in each partition
puts equal texts side by side, and a window over the sorted rows compares each text in full with its neighbour's:
it starts a new group where they differ. The splitters are drawn on a short prefix and a 64-bit hash of the text,
as a sample of whole texts would have to fit the driver; equal texts agree in both, so they stay together, and the
sort and the comparison use the whole text.

A text with more copies than ``rows / (2 * partitions)`` would fill a partition alone. Such texts are found by a
count of hashes (combined before the shuffle), at most ``2 * partitions`` of them exist, and their rows are dealt
out over several partitions by a salt from the identifier. Each (text, salt) run is compared as above; the runs of
such a text, few rows, are then put together by a full comparison of their texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table, whole_text

#: Characters of the text in the splitters; the sort goes on with the whole text.
PREFIX = 16


def exact_dedup(docs: DataFrame, text: str = "text", ident: str = "doc_id", keep: str = "smallest", normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """All rows and columns of docs, and ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal if their normalised forms are identical (``normalise``: Column to Column; none by default). A
    null text counts as empty, and all empty texts are one group. In each group the row with the smallest or
    largest identifier stays (``keep``); null identifiers come last, and of rows that tie in the identifier
    exactly one stays. Empty tables give no rows. Columns of docs that have a result column's name are replaced.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    spark = docs.sparkSession
    names = [c for c in docs.columns if c not in ("keep_id", "group_size", "kept", "text_sha256")]
    # own names inside, so that no column of docs clashes; the text itself travels once
    norm = (normalise or (lambda c: c))(whole_text(text))
    bare = normalise is None
    keyed = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names) if not (bare and c == text)), F.col(ident).alias("_ident"), F.col(text).isNull().alias("_null"), norm.alias("_t"))
    keyed = keyed.withColumn("_h", F.xxhash64("_t")).withColumn("_p", F.substring("_t", 1, PREFIX))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    most = max(64, docs.count() // (2 * parts))
    hot = docs.select(F.xxhash64(norm).alias("_h")).groupBy("_h").agg(F.count("*").alias("_n")).filter(F.col("_n") > most)
    salts = F.ceil(F.col("_n") / most).cast("int")
    keyed = keyed.join(F.broadcast(hot), "_h", "left").withColumn("_salt", F.when(F.col("_n").isNotNull(), 1 + F.pmod(F.xxhash64("_ident"), salts)).otherwise(0).cast("int")).drop("_n")
    order = F.col("_ident").desc_nulls_last() if keep == "largest" else F.col("_ident").asc_nulls_last()
    best = F.max if keep == "largest" else F.min

    def runs(rows: DataFrame) -> DataFrame:
        near = Window.partitionBy("_p", "_h", "_salt", "_t").orderBy(order)
        run = near.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        rows = rows.repartitionByRange("_p", "_h", "_salt")
        return rows.select("*", F.row_number().over(near).alias("_rn"), F.first("_ident").over(run).alias("_id"), F.count("*").over(run).alias("_size"))

    salted = runs(keyed.filter(F.col("_salt") > 0).select("_ident", "_t", "_h", "_p", "_salt")).filter(F.col("_rn") == 1)
    merged = salted.groupBy("_t").agg(best("_id").alias("_all_id"), F.sum("_size").alias("_all"))
    merged = merged.select(F.sha2("_t", 256).alias("_sha"), "_all_id", "_all")
    rows = runs(keyed).withColumn("_sha", F.sha2("_t", 256))
    rows = rows.join(F.broadcast(merged), "_sha", "left")
    hot_row = F.col("_salt") > 0
    # where every identifier of a hot text is null they share one salt, so the run is the group
    lead = F.col("_id").eqNullSafe(F.col("_all_id"))
    whole = F.when(~F.col("_null"), F.col("_t"))
    return rows.select(
        *((whole if bare and c == text else F.col(f"c{i}")).alias(c) for i, c in enumerate(names)),
        F.when(hot_row, F.col("_all_id")).otherwise(F.col("_id")).alias("keep_id"),
        F.when(hot_row, F.col("_all")).otherwise(F.col("_size")).alias("group_size"),
        ((F.col("_rn") == 1) & (~hot_row | lead)).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Texts compared unchanged; of equal texts the row with the largest doc_id stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup(docs, keep="largest").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP6_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""

"""Mixing sources to target weights by systematic sampling.

Documents are put in order of source, size and identifier by a range partitioning whose splitters include the
identifier, so a source that holds most rows spreads over many partitions. The narrow ordered table (no texts) is
written to the shared folder with each row's partition and place in it. A row's prefix sum of expected copies in
its source is its rank there times the source's rate; the rank is its place plus the counts of the source in the
partitions before, a table of (partition, source) counts. A row is emitted once for each integer between its
prefix sum and the one before it, both moved by the source's random offset.

Ordered by size, each stretch of documents of like size is thinned or repeated evenly, so the words taken differ
from the target by about the size of the largest documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, apart, table, whole_text, with_row_numbers, written

#: Offsets are multiples of 2^-20, so that sums with whole copies are exact.
STEPS = 1 << 20


def mix(docs: DataFrame, size, ident: str = "doc_id", source: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: str = "mix", extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: ident, source, ``size``, ``source_size``, ``target`` (of its source) and ``copies``.

    ``size`` is a Column (null: 0). The sources in code-point order, null last, weigh ``weights``, repeated, and
    share ``share`` times all sizes; a target above ``cap`` times its source's size stops there and the rest is
    shared again by weight. ``extra`` columns are carried. A source of total size 0 has target 0 and no copies.
    Ties in size go by identifier (null first); rows that are equal in both are interchangeable. The result
    depends on the rows and the seed alone, not on their partitioning.
    """
    narrow = docs.select(F.col(ident).alias("_id"), F.col(source).alias("_src"), F.coalesce(size, F.lit(0)).cast("long").alias("size"), *extra)
    keys = ["_src", "size", "_id"]
    placed = narrow.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = placed.withColumn("_pid", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    placed = written(placed, "mix")

    parts = placed.groupBy("_src", "_pid").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"), F.sum("size").alias("_words"))
    earlier = Window.partitionBy("_src").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("_src", "_pid", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_shift"))

    # One row per source from here: the windows without a partition run over sources, not documents.
    by_name = Window.orderBy(F.col("_src").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    sources = parts.groupBy("_src").agg(F.sum("_words").alias("source_size")).withColumn("_w", weight)
    fill = Window.orderBy((F.col("source_size") / F.col("_w")).asc(), F.col("_src").asc_nulls_last())
    below, every = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sources = sources.withColumn("_left", F.lit(share) * F.sum("source_size").over(every) - F.lit(cap) * F.coalesce(F.sum("source_size").over(below), F.lit(0)))
    sources = sources.withColumn("_level", F.col("_left") / F.sum("_w").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    sources = sources.withColumn("_free", F.col("_w") * F.col("_level") <= F.lit(cap) * F.col("source_size"))
    sources = sources.withColumn("_at_level", F.first(F.when(F.col("_free"), F.col("_level")), True).over(every))
    sources = sources.withColumn("target", F.least(F.lit(cap) * F.col("source_size"), F.coalesce(F.col("_w") * F.col("_at_level"), F.lit(cap) * F.col("source_size"))))
    sources = sources.withColumn("_rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("_src"), F.lit("")))), 1, 5), 16, 10).cast("double") / STEPS
    sources = sources.select("_src", "source_size", "target", "_rate", offset.alias("_off"))

    starts = starts.join(sources, starts["_src"].eqNullSafe(sources["_src"])).select(starts["_src"], "_pid", "_shift", "source_size", "target", "_rate", "_off")
    rows = placed.join(starts, (placed["_pid"] == starts["_pid"]) & placed["_src"].eqNullSafe(starts["_src"])).drop(starts["_src"]).drop(starts["_pid"])
    rank = F.col("_at") + F.col("_shift")
    copies = F.floor(rank * F.col("_rate") + F.col("_off")) - F.floor((rank - 1) * F.col("_rate") + F.col("_off"))
    return rows.select(F.col("_id").alias(ident), F.col("_src").alias(source), *extra, "size", "source_size", "target", F.least(copies, F.ceil("_rate")).cast("long").alias("copies"))


def word_count(text: str = "text"):
    return F.regexp_count(whole_text(text), F.lit(WORD))


def emitted(docs: DataFrame, size, text: str = "text", **how) -> DataFrame:
    """The mix itself: rows of docs, each as many times as it is taken. size is a Column of ``text``, the identifier and
    the source (word_count, for one); any further columns pass, whatever their names."""
    docs, named = apart(docs, (text, how.get("ident", "doc_id"), how.get("source", "source")))
    docs = with_row_numbers(docs, "_row")
    plan = mix(docs, size, extra=("_row",), **how).filter(F.col("copies") > 0)
    rows = docs.join(plan.select("_row", "copies"), "_row")
    return named(rows.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))))


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    rows = mix(docs, word_count())
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM s),
f AS (SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
         - 2.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
       / (sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM w),
g AS (SELECT *, w::DOUBLE * level <= 2.0::DOUBLE * source_size::DOUBLE AS free FROM f),
l AS (SELECT arg_min(level, source_size / w) AS at_level FROM g WHERE free),
t AS (SELECT source, source_size,
        least(2.0::DOUBLE * source_size::DOUBLE, coalesce(w::DOUBLE * at_level, 2.0::DOUBLE * source_size::DOUBLE)) AS target,
        CAST(CAST('0x' || substr(md5('mix:' || coalesce(source, '')), 1, 5) AS BIGINT) AS DOUBLE) / 1048576 AS off
      FROM g LEFT JOIN l ON true),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.off,
        CASE WHEN t.source_size > 0 THEN t.target / t.source_size::DOUBLE ELSE 0.0::DOUBLE END AS rate,
        row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id NULLS FIRST) AS rank
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(least(floor(rank::DOUBLE * rate + off) - floor((rank - 1)::DOUBLE * rate + off), ceil(rate)) AS BIGINT) * size AS taken
FROM r
"""

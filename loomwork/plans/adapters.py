"""The benchmark's tables as the engine's inputs: alignments, sequences, layouts, features, reads. Integer
arithmetic only, so that SQL gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwork.operators.placement import LAYOUT, gap_part, laid_out, sequence_part
from loomwork.tables import spread

QUERY_LEN, REF_LEN = 12_000, 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items: parts are queries, groups of suppliers references. They are dealt out by query, as what follows is."""
    rows = spread(table(spark, sf_dir, "lineitem").withColumn("query", F.col("l_partkey").cast("string")), "query")
    order = Window.partitionBy("query").orderBy("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    size = F.lit(200) + 20 * F.col("l_quantity").cast("long")
    qs = (F.col("l_orderkey") * 97 + F.col("l_linenumber") * 389) % 10_800
    rs = (F.col("l_orderkey") * 131 + F.col("l_suppkey") * 17 + F.col("l_linenumber")) % 190_000
    return rows.select(
        "query", F.lit(QUERY_LEN).cast("long").alias("query_len"), qs.alias("query_start"), (qs + size).alias("query_end"),
        F.when(F.col("l_linestatus") == "O", "+").otherwise("-").alias("strand"),
        F.concat(F.lit("ref"), (F.col("l_suppkey") % 5).cast("string")).alias("ref"), F.lit(REF_LEN).cast("long").alias("ref_len"), rs.alias("ref_start"), (rs + size).alias("ref_end"),
        F.floor(size * (90 + F.col("l_linenumber")) / 100).alias("num_match"), size.alias("aln_len"), ((F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13) % 61).alias("mapq"),
        F.row_number().over(order).cast("long").alias("line_no"),
    )


ALN = """
raw AS (SELECT *, 200 + 20 * CAST(l_quantity AS BIGINT) AS size, (l_orderkey * 97 + l_linenumber * 389) % 10800 AS qs,
  (l_orderkey * 131 + l_suppkey * 17 + l_linenumber) % 190000 AS rs FROM lineitem),
aln AS (SELECT CAST(l_partkey AS VARCHAR) AS query, CAST(12000 AS BIGINT) AS query_len, qs AS query_start, qs + size AS query_end,
  CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS strand, 'ref' || CAST(l_suppkey % 5 AS VARCHAR) AS ref, CAST(200000 AS BIGINT) AS ref_len,
  rs AS ref_start, rs + size AS ref_end, size * (90 + l_linenumber) // 100 AS num_match, size AS aln_len, (l_orderkey * 7 + l_linenumber * 13) % 61 AS mapq,
  row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS line_no
  FROM raw)"""


def part_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as queries of one length: name, length."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("name"), F.lit(QUERY_LEN).cast("long").alias("length"))


def text_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with all but bases as N: name, seq, seq_ix."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("name"), F.regexp_replace("text", "[^ACGTacgt]", "N").alias("seq"), F.col("doc_id").alias("seq_ix"))


SEQ = "seqs AS (SELECT CAST(doc_id AS VARCHAR) AS name, regexp_replace(text, '[^ACGTacgt]', 'N', 'g') AS seq, doc_id AS seq_ix FROM documents)"


def component_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("name"), (1000 + 10 * F.col("p_size")).cast("long").alias("length"))


def component_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = component_lengths(spark, sf_dir)
    key = F.substr("name", F.lit(2)).cast("int")
    return own.select("name", F.substr(F.repeat(F.lit("ACGTTGCANCRY"), 150), 1 + key % 10, F.col("length").cast("int")).alias("seq"))


def _layout(spark: SparkSession, sf_dir: str, obj, order, turn) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size", obj.alias("obj"), order.alias("o"), turn.alias("turn"))
    w = Window.partitionBy("obj").orderBy("o", "p_partkey")
    rows = rows.withColumns({"n": F.row_number().over(w), "last": F.lead("o").over(w).isNull()})
    length = 1000 + 10 * F.col("p_size")
    seq = sequence_part(F.concat(F.lit("c"), F.col("p_partkey").cast("string")), length, F.col("turn"), 2 * F.col("n"))
    even = F.col("p_size") % 2 == 0
    gap = gap_part(F.when(even, "U").otherwise("N"), F.when(even, 100).otherwise(7 * F.col("p_size") + 1), 2 * F.col("n") + 1, F.lit("scaffold"), F.lit("yes"), F.when(even, "align_genus").otherwise("paired-ends;map"))
    both = F.explode(F.when(F.col("last") | (F.col("p_size") % 11 == 0), F.array(seq)).otherwise(F.array(seq, gap)))
    return laid_out(rows.select("obj", both.alias("p")).select("obj", "p.*")).select(*LAYOUT)


def layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return _layout(spark, sf_dir, F.concat(F.lit("obj"), (k % 20).cast("string")), k, F.when(k % 3 == 0, "+").when(k % 3 == 1, "-").otherwise("?"))


def other_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return _layout(spark, sf_dir, F.concat(F.lit("alt"), (F.floor(k / 7) % 30).cast("string")), (k * 37) % 1009, F.when(k % 5 < 3, "+").otherwise("-"))


def _layout_sql(name: str, obj: str, order: str, turn: str) -> str:
    return f"""
{name}_p AS (SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size, {obj} AS obj, {order} AS o, {turn} AS turn FROM part),
{name}_n AS (SELECT *, row_number() OVER (PARTITION BY obj ORDER BY o, p_partkey) AS n, lead(o) OVER (PARTITION BY obj ORDER BY o, p_partkey) IS NULL AS last FROM {name}_p),
{name}_u AS (SELECT obj, 2 * n AS ord, 1000 + 10 * p_size AS length, 'W' AS comp_type, 'c' || CAST(p_partkey AS VARCHAR) AS comp, CAST(1 AS BIGINT) AS comp_beg, 1000 + 10 * p_size AS comp_end, turn AS orientation,
    CAST(NULL AS BIGINT) AS gap_len, CAST(NULL AS VARCHAR) AS gap_type, CAST(NULL AS VARCHAR) AS linkage, CAST(NULL AS VARCHAR) AS linkage_evidence FROM {name}_n
  UNION ALL SELECT obj, 2 * n + 1, CASE WHEN p_size % 2 = 0 THEN 100 ELSE 7 * p_size + 1 END, CASE WHEN p_size % 2 = 0 THEN 'U' ELSE 'N' END, NULL, NULL, NULL, NULL,
    CASE WHEN p_size % 2 = 0 THEN 100 ELSE 7 * p_size + 1 END, 'scaffold', 'yes', CASE WHEN p_size % 2 = 0 THEN 'align_genus' ELSE 'paired-ends;map' END FROM {name}_n WHERE NOT last AND p_size % 11 <> 0),
{name} AS (SELECT obj, CAST(sum(length) OVER w - length + 1 AS BIGINT) AS obj_beg, CAST(sum(length) OVER w AS BIGINT) AS obj_end, row_number() OVER w AS pid, comp_type, comp, comp_beg, comp_end, orientation,
    gap_len, gap_type, linkage, linkage_evidence FROM {name}_u WINDOW w AS (PARTITION BY obj ORDER BY ord))"""


AGP = _layout_sql("agp", "'obj' || CAST(p_partkey % 20 AS VARCHAR)", "p_partkey", "CASE p_partkey % 3 WHEN 0 THEN '+' WHEN 1 THEN '-' ELSE '?' END")
ALT = _layout_sql("alt", "'alt' || CAST(p_partkey // 7 % 30 AS VARCHAR)", "(p_partkey * 37) % 1009", "CASE WHEN p_partkey % 5 < 3 THEN '+' ELSE '-' END")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as features of queries: seq, start, end (half-open), strand, event_id."""
    e = F.col("event_id")
    start = e * 37 % 10_000
    return table(spark, sf_dir, "events").select((F.col("user_id") % 200 + 1).cast("string").alias("seq"), start.alias("start"), (start + 50 + e % 300).alias("end"), F.when(e % 2 == 0, "+").otherwise("-").alias("strand"), "event_id")


FEAT = "feat AS (SELECT CAST(user_id % 200 + 1 AS VARCHAR) AS seq, event_id * 37 % 10000 AS start, event_id * 37 % 10000 + 50 + event_id % 300 AS \"end\", CASE WHEN event_id % 2 = 0 THEN '+' ELSE '-' END AS strand, event_id FROM events)"


def annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features as annotation rows (1-based closed)."""
    return features(spark, sf_dir).select(F.col("seq").alias("seqid"), F.lit("own").alias("source"), F.lit("gene").alias("feature"), (F.col("start") + 1).alias("start"), "end", F.lit(".").alias("score"), "strand", F.lit(".").alias("phase"), F.concat(F.lit("ID="), F.col("event_id").cast("string")).alias("attributes"), F.col("event_id").alias("line_no"))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as name-sorted reads."""
    e = F.col("event_id")
    start = e * 7919 % 9_000
    return table(spark, sf_dir, "events").select(e.alias("rec_no"), F.floor(e / 2).cast("string").alias("q_name"), (e % 2 == 0).alias("is_read1"), (e % 19 == 0).alias("is_unmapped"), (e % 23 == 0).alias("is_secondary"), F.concat(F.lit("r"), (F.col("user_id") % 50).cast("string")).alias("ref"), start.alias("ref_start"), (start + 100 + e % 7).alias("ref_end"))


READS = "reads AS (SELECT event_id AS rec_no, event_id // 2 AS q_name, event_id % 2 = 0 AS is_read1, 'r' || CAST(user_id % 50 AS VARCHAR) AS ref, event_id * 7919 % 9000 AS ref_start, event_id * 7919 % 9000 + 100 + event_id % 7 AS ref_end FROM events WHERE event_id % 19 <> 0 AND event_id % 23 <> 0)"


def read_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.concat(F.lit("r"), (F.col("user_id") % 50).cast("string")).alias("name")).distinct().withColumn("length", F.lit(9_101).cast("long"))

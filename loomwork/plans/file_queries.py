"""Queries that write the benchmark's tables in each file format and read them back, with the SQL of what they hold."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.operators import alignments, links, stats
from loomwork.operators.placement import LAYOUT
from loomwork.plans import adapters as ad
from loomwork.plans.catalog import query
from loomwork.sources import readers, writers
from loomwork.tables import shared_dir

_ROW = "query, query_len, query_start, query_end, strand, ref, ref_len, ref_start, ref_end, num_match, aln_len"


def _path(spark: SparkSession, suffix: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/file-{uuid.uuid4().hex}{suffix}"


def _text(lines: DataFrame, suffix: str, *order: str) -> str:
    """The path of a text file of ``value``, in the order of the columns."""
    path = _path(lines.sparkSession, suffix)
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("value").write.text(path)
    return path


@query(f"WITH {ad.ALN} SELECT {_ROW}, mapq, row_number() OVER (ORDER BY query, line_no) AS line_no FROM aln")
def file_paf(spark, d):
    path = _path(spark, ".paf")
    writers.write_paf(ad.alignments(spark, d), path)
    return readers.read_paf(spark, path).select(*_ROW.split(", "), "mapq", "line_no")


@query(f"WITH {ad.ALN} SELECT {_ROW}, 'tp' AS name, 'P' || CAST(mapq AS VARCHAR) AS tag, CAST(aln_len AS VARCHAR) || 'M' AS cigar FROM aln")
def file_paf_tags(spark, d):
    rows = ad.alignments(spark, d)
    value = F.concat_ws("\t", *(F.col(c).cast("string") for c in (*_ROW.split(", "), "mapq")), F.concat(F.lit("tp:A:P"), F.col("mapq").cast("string")), F.concat(F.lit("cg:Z:"), F.col("aln_len").cast("string"), F.lit("M")))
    path = _text(rows.withColumn("value", value), ".paf", "query", "line_no")
    return readers.read_paf(spark, path).select(*_ROW.split(", "), F.lit("tp").alias("name"), F.col("tags")["tp"].alias("tag"), F.col("tags")["cg"].alias("cigar"))


@query(f"""WITH {ad.ALN} SELECT query, query_len, query_start, query_end, strand, ref, ref_len, ref_start, ref_end, aln_len + 1 - 3 AS num_match, aln_len + 1 AS aln_len, '9M1D1I' || CAST(aln_len - 10 AS VARCHAR) || 'M' AS cigar FROM aln""")
def file_delta(spark, d):
    cigar = F.concat(F.lit("9M1D1I"), (F.col("aln_len") - 10).cast("string"), F.lit("M"))
    rows = ad.alignments(spark, d).withColumn("tags", F.create_map(F.lit("NM"), F.lit("3"), F.lit("cg"), cigar))
    path = _path(spark, ".delta")
    writers.write_delta(rows, path)
    return readers.delta_as_alignments(readers.read_delta(spark, path)).select(*_ROW.split(", "), F.col("tags")["cg"].alias("cigar"))


@query(f"WITH {ad.SEQ} SELECT row_number() OVER (ORDER BY seq_ix) - 1 AS seq_ix, name, length(seq) AS length, md5(seq) AS md5 FROM seqs")
def file_fasta(spark, d):
    path = _path(spark, ".fa")
    writers.write_fasta(ad.text_sequences(spark, d), path)
    return readers.read_fasta(spark, path).select("seq_ix", "name", "length", F.md5("seq").alias("md5"))


@query(f"WITH {ad.AGP} SELECT {', '.join(LAYOUT)}, row_number() OVER (ORDER BY obj, pid) + 2 AS line_no FROM agp")
def file_agp(spark, d):
    path = _path(spark, ".agp")
    writers.write_agp(ad.layout(spark, d), path, ("# own comment",))
    return readers.read_agp(spark, path).select(*LAYOUT, "line_no")


@query(f"WITH {ad.FEAT} SELECT seq AS seqid, 'own' AS source, 'gene' AS feature, start + 1 AS start, \"end\", '.' AS score, strand, '.' AS phase, 'ID=' || CAST(event_id AS VARCHAR) AS attributes FROM feat")
def file_gff(spark, d):
    path = _path(spark, ".gff")
    writers.write_gff(ad.annotation(spark, d), path)
    return readers.read_gff(spark, path).drop("line_no")


@query(f"""WITH {ad.SEQ}, {ad.AGP}, l AS (SELECT 'fa' AS kind, length(seq) AS length FROM seqs UNION ALL SELECT 'sizes', 12000 FROM part UNION ALL SELECT 'gfa', 1000 + 10 * p_size FROM part UNION ALL SELECT 'agp', max(obj_end) FROM agp GROUP BY obj)
SELECT kind, count(*) AS n_seqs, CAST(sum(length) AS BIGINT) AS total_bp, CAST(min(length) AS BIGINT) AS shortest, CAST(max(length) AS BIGINT) AS longest FROM l GROUP BY kind""")
def file_lengths_by_suffix(spark, d):
    paths = {k: _path(spark, f".{k}") for k in ("fa", "sizes", "agp")}
    writers.write_fasta(ad.text_sequences(spark, d), paths["fa"])
    writers.write_sizes(ad.part_sequences(spark, d), paths["sizes"])
    writers.write_agp(ad.layout(spark, d), paths["agp"])
    own = ad.component_lengths(spark, d)
    odd = F.col("length") % 20 == 0
    segment = F.concat_ws("\t", F.lit("S"), "name", F.when(odd, F.repeat(F.lit("A"), F.col("length").cast("int"))).otherwise("*"), F.when(~odd, F.concat(F.lit("LN:i:"), F.col("length").cast("string"))))
    paths["gfa"] = _text(own.withColumn("value", segment), ".gfa", "name")
    rows = None
    for kind, path in paths.items():
        some = readers.read_lengths(spark, path).select(F.lit(kind).alias("asm"), "length")
        rows = some if rows is None else rows.unionByName(some)
    return stats.assembly_stats(rows).select(F.col("asm").alias("kind"), "n_seqs", "total_bp", "shortest", "longest")


@query("SELECT 'c' || CAST(p_partkey AS VARCHAR) AS name, 'first word' AS kind FROM part UNION ALL SELECT 'c' || CAST(p_partkey AS VARCHAR) || ' ' || p_brand, 'line' FROM part")
def file_names(spark, d):
    value = F.concat(F.lit("c"), F.col("p_partkey").cast("string"), F.lit(" "), "p_brand", F.lit("  "))
    path = _text(ad.table(spark, d, "part").withColumn("value", value), ".txt", "p_partkey")
    return readers.read_names(spark, path).withColumn("kind", F.lit("first word")).unionByName(readers.read_names(spark, path, whole_line=True).withColumn("kind", F.lit("line")))


@query("SELECT 'l' || CAST(s_suppkey AS VARCHAR) || '.agp' AS agp_path, s_suppkey / 4 AS weight FROM supplier")
def file_weights(spark, d):
    value = F.concat_ws(",", F.concat(F.lit("l"), F.col("s_suppkey").cast("string"), F.lit(".agp")), (F.col("s_suppkey") / 4).cast("string"))
    return readers.read_weights(spark, _text(ad.table(spark, d, "supplier").withColumn("value", value), ".csv", "s_suppkey"))


@query(f"""WITH {ad.READS.replace('WHERE event_id % 19 <> 0 AND event_id % 23 <> 0', '')}
SELECT row_number() OVER (ORDER BY rec_no) + 1 AS rec_no, CAST(q_name AS VARCHAR) AS q_name, is_read1, rec_no % 19 = 0 AS is_unmapped, rec_no % 23 = 0 AS is_secondary, ref, ref_start, ref_end FROM reads""")
def file_sam(spark, d):
    rows = ad.reads(spark, d)
    flag = F.when(F.col("is_read1"), 64).otherwise(128) + F.when(F.col("is_unmapped"), 4).otherwise(0) + F.when(F.col("is_secondary"), 256).otherwise(0)
    cigar = F.concat(F.lit("7S90M5I"), (F.col("ref_end") - F.col("ref_start") - 90).cast("string"), F.lit("M"))
    value = F.concat_ws("\t", "q_name", flag.cast("string"), "ref", (F.col("ref_start") + 1).cast("string"), F.lit("60"), cigar, F.lit("*"), F.lit("0"), F.lit("0"), F.lit("*"), F.lit("*"))
    head = spark.createDataFrame([(-1, "@HD\tVN:1.6\tSO:queryname")], "rec_no long, value string")
    path = _text(head.unionByName(rows.select("rec_no", value.alias("value"))), ".sam", "rec_no")
    return readers.read_sam(spark, path)


@query("SELECT CAST(l_quantity AS BIGINT) AS cov, count(*) AS n_bp FROM lineitem GROUP BY l_quantity")
def file_coverage_histogram(spark, d):
    own = ad.table(spark, d, "lineitem").groupBy(F.col("l_quantity").cast("long").alias("cov")).agg(F.count("*").alias("n"))
    value = F.concat_ws("\t", F.lit("COV"), F.format_string("[%d-%d]", "cov", "cov"), F.col("cov").cast("string"), F.col("n").cast("string"))
    other = spark.createDataFrame([(0, "SN\traw total sequences:\t5")], "cov long, value string")
    return readers.read_coverage_histogram(spark, _text(other.unionByName(own.select("cov", value.alias("value"))), ".stats", "cov"))


@query("""SELECT 'c' || CAST(p_partkey AS VARCHAR) || '_b' AS u, 'c' || CAST(p_partkey + 1 AS VARCHAR) || '_e' AS v, p_size / 8 AS weight, false AS known, 100 AS gap_size, 'scaffold' AS gap_type, true AS linkage, 'proximity_ligation' AS linkage_evidence FROM part""")
def file_links(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    rows = ad.table(spark, d, "part").select(F.concat(F.lit("c"), k.cast("string"), F.lit("_b")).alias("u"), F.concat(F.lit("c"), (k + 1).cast("string"), F.lit("_e")).alias("v"), (size / 8).alias("weight"), size.cast("long").alias("raw"))
    path = _path(spark, ".tsv")
    writers.write_table(rows, path, header=False)
    return links.as_edges(readers.read_links(spark, path))


@query("SELECT CAST(p_partkey AS VARCHAR) AS query, p_size / 64 AS \"grouping\", 1.0::DOUBLE AS location, (p_size % 4) / 4 AS orientation FROM part")
def file_confidence(spark, d):
    rows = ad.table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("query"), (F.col("p_size") / 64).alias("grouping"), F.lit(1.0).alias("location"), (F.col("p_size") % 4 / 4).alias("orientation"))
    path = _path(spark, ".tsv")
    writers.write_table(rows, path)
    return readers.read_confidence(spark, path)


@query(f"""WITH {ad.ALN}, fl AS (SELECT *, query_start <= 1500 AS ql, query_len - query_end <= 1500 AS qr, ref_start <= 1500 AS rl, ref_len - ref_end <= 1500 AS rr FROM aln)
SELECT query, count(*) AS n_alns, count(DISTINCT ref) AS n_refs, bool_or(NOT (ql OR qr) AND NOT (rl AND rr)) AS internal FROM fl GROUP BY query""")
def file_query_info(spark, d):
    path = _path(spark, ".tsv")
    writers.write_table(alignments.query_summary(ad.alignments(spark, d), 1500), path)
    return spark.read.schema("query string, n_alns long, n_refs long, internal boolean").option("sep", "\t").option("header", True).csv(path)

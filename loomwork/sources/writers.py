"""Writers of the text formats. Rows keep their order over the part files: a range partitioning by the order
columns, then a sort in each part; names of part files go with the order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions.sequences import offsets_from_cigar
from loomwork.operators.alignments import COLUMNS


def _write(lines: DataFrame, order: list[str | Column], path: str, mode: str) -> None:
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("value").write.mode(mode).text(path)


def _tabbed(*columns: str) -> Column:
    return F.concat_ws("\t", *(F.col(c).cast("string") for c in columns))


def write_agp(layout: DataFrame, path: str, comments: tuple[str, ...] = (), mode: str = "error") -> None:
    """AGP text: the version line first, then comments (with #), then objects by name and part. mode ``ignore``
    leaves an existing result, ``overwrite`` replaces it."""
    if any(not c.startswith("#") for c in comments):
        raise ValueError("comments start with #")
    head = ["## agp-version 2.1", *(c for c in comments if not c.startswith("## agp-version"))]
    gap = F.col("comp").isNull()
    body = F.when(gap, _tabbed("obj", "obj_beg", "obj_end", "pid", "comp_type", "gap_len", "gap_type", "linkage", "linkage_evidence")).otherwise(_tabbed("obj", "obj_beg", "obj_end", "pid", "comp_type", "comp", "comp_beg", "comp_end", "orientation"))
    rows = layout.select(F.lit(1).alias("k"), "obj", F.col("pid").cast("long").alias("pid"), body.alias("value"))
    top = layout.sparkSession.createDataFrame([(0, "", i, c) for i, c in enumerate(head)], "k int, obj string, pid long, value string")
    _write(top.unionByName(rows), ["k", "obj", "pid"], path, mode)


def write_fasta(sequences: DataFrame, path: str, mode: str = "error") -> None:
    order = "seq_ix" if "seq_ix" in sequences.columns else "name"
    _write(sequences.withColumn("value", F.concat(F.lit(">"), "name", F.lit("\n"), "seq")), [order], path, mode)


def write_paf(alns: DataFrame, path: str, mode: str = "error") -> None:
    _write(alns.withColumn("value", _tabbed(*COLUMNS[:12])), ["query", "line_no"], path, mode)


def write_sizes(sequences: DataFrame, path: str, mode: str = "error") -> None:
    """Names and lengths, as index files have them."""
    _write(sequences.withColumn("value", _tabbed("name", "length")), ["name"], path, mode)


def write_gff(rows: DataFrame, path: str, mode: str = "error") -> None:
    """Annotation in the order of its lines."""
    _write(rows.withColumn("value", _tabbed("seqid", "source", "feature", "start", "end", "score", "strand", "phase", "attributes")), ["line_no"], path, mode)


def write_table(df: DataFrame, path: str, header: bool = True, mode: str = "error") -> None:
    """Confidences, query summaries and links as tab-separated text."""
    df.write.mode(mode).option("sep", "\t").option("header", header).csv(path)


def write_delta(alns: DataFrame, path: str, files: tuple[str, str] = ("file1", "file2"), mode: str = "error") -> None:
    """Delta text from alignments, by reference and query. One without a cg or NM tag is an error."""
    tagged = F.col("tags")["NM"].isNotNull() & F.col("tags")["cg"].isNotNull()
    alns = alns.withColumn("ref", F.when(tagged, F.col("ref")).otherwise(F.raise_error(F.concat(F.lit("no cg or NM tag in an alignment of "), "query"))))
    forward = F.col("strand") == "+"
    place = _spaced(F.col("ref_start") + 1, F.col("ref_end"), F.when(forward, F.col("query_start") + 1).otherwise(F.col("query_end")), F.when(forward, F.col("query_end")).otherwise(F.col("query_start") + 1), F.col("tags")["NM"], F.col("tags")["NM"], F.lit(0))
    offsets = F.concat(F.transform(offsets_from_cigar(F.col("tags")["cg"]), lambda d: d.cast("string")), F.array(F.lit("0")))
    rows = alns.select("ref", "query", "ref_len", "query_len", F.struct("line_no", F.concat_ws("\n", place, F.array_join(offsets, "\n")).alias("text")).alias("a"))
    body = rows.groupBy("ref", "query", "ref_len", "query_len").agg(F.array_join(F.transform(F.array_sort(F.collect_list("a")), lambda x: x["text"]), "\n").alias("text"))
    body = body.select(F.lit(1).alias("k"), "ref", "query", F.concat(F.lit(">"), _spaced(F.col("ref"), F.col("query"), F.col("ref_len"), F.col("query_len")), F.lit("\n"), "text").alias("value"))
    head = alns.sparkSession.createDataFrame([(0, "", "", f"{files[0]} {files[1]}\nNUCMER")], "k int, ref string, query string, value string")
    _write(head.unionByName(body), ["k", "ref", "query"], path, mode)


def _spaced(*columns: Column) -> Column:
    return F.concat_ws(" ", *(c.cast("string") for c in columns))

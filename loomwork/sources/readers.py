"""Readers of alignment, sequence, layout, annotation and link files as tables.

All but the delta reader are expressions over Spark's text and CSV scans (gzip included), so they run in the JVM
and split large plain files. Nothing here needs the files on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from loomwork.functions.sequences import cigar_from_offsets
from loomwork.tables import importable, with_line_numbers


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return with_line_numbers(spark.read.text(path).select(F.rtrim("value").alias("line")))


def read_paf(spark: SparkSession, path: str) -> DataFrame:
    """PAF: the alignment columns, line_no, and tags (map of name to value). A start after its end is an error."""
    f = F.split("line", "\t")
    at = lambda i: f[i].cast("long")
    tags = F.map_from_entries(F.transform(F.slice(f, F.lit(13), F.greatest(F.size(f) - 12, F.lit(0))), lambda x: F.struct(F.substr(x, F.lit(1), F.lit(2)), F.substr(x, F.lit(6)))))
    rows = _lines(spark, path).filter("line <> ''").select(
        f[0].alias("query"), at(1).alias("query_len"), at(2).alias("query_start"), at(3).alias("query_end"), f[4].alias("strand"),
        f[5].alias("ref"), at(6).alias("ref_len"), at(7).alias("ref_start"), at(8).alias("ref_end"),
        at(9).alias("num_match"), at(10).alias("aln_len"), at(11).alias("mapq"), "line_no", tags.alias("tags"),
    )
    bad = (F.col("query_start") > F.col("query_end")) | (F.col("ref_start") > F.col("ref_end"))
    return rows.withColumn("query", F.when(bad, F.raise_error(F.concat(F.lit("start after end in line "), F.col("line_no").cast("string")))).otherwise(F.col("query")))


def read_delta(spark: SparkSession, path: str) -> DataFrame:
    """Nucmer delta: ref, query, ref_len, query_len, rs, re, qs, qe (1-based, as in the file), nm, offsets. A
    record is what follows a header, so a file splits at headers."""
    importable(spark)
    schema = "ref string, query string, ref_len long, query_len long, rs long, re long, qs long, qe long, nm long, offsets array<long>, record long, n long"
    records = with_line_numbers(spark.read.option("lineSep", "\n>").text(path), "record")

    target = to_arrow_schema(StructType.fromDDL(schema))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value, record in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                head, *lines = value.split("\n")
                names = head.lstrip(">").split()
                if record == 1 and not value.startswith(">") or len(names) != 4:
                    continue  # the two lines before the first header
                now: dict | None = None
                for line in lines:
                    x = line.split()
                    if len(x) == 7:
                        rs, re_, qs, qe, nm, _, _ = map(int, x)
                        now = {"ref": names[0], "query": names[1], "ref_len": int(names[2]), "query_len": int(names[3]), "rs": rs, "re": re_, "qs": qs, "qe": qe, "nm": nm, "offsets": [], "record": record, "n": len(out)}
                    elif len(x) == 1 and now is not None:
                        if int(x[0]):
                            now["offsets"].append(int(x[0]))
                        else:
                            out.append(now)
                            now = None
            yield pa.RecordBatch.from_pylist(out, target)

    return records.select("value", "record").mapInArrow(parse, schema)


def delta_as_alignments(delta: DataFrame) -> DataFrame:
    """Delta rows as alignments, with the CIGAR and NM tags. Both sides must span the same after the indels."""
    forward = (F.col("rs") <= F.col("re")) == (F.col("qs") <= F.col("qe"))
    low, high = lambda a, b: F.least(a, b) - 1, lambda a, b: F.greatest(a, b)
    rows = delta.select(
        "query", "query_len", low("qs", "qe").alias("query_start"), high("qs", "qe").alias("query_end"), F.when(forward, "+").otherwise("-").alias("strand"),
        "ref", "ref_len", low("rs", "re").alias("ref_start"), high("rs", "re").alias("ref_end"), "nm", "offsets", "record", "n",
    )
    span, q_span = F.col("ref_end") - F.col("ref_start"), F.col("query_end") - F.col("query_start")
    deleted, inserted = F.size(F.filter("offsets", lambda d: d > 0)), F.size(F.filter("offsets", lambda d: d < 0))
    wrong = span - deleted != q_span - inserted
    cigar = F.when(wrong, F.raise_error(F.concat(F.lit("offsets do not fit the alignment of "), "query"))).otherwise(cigar_from_offsets(F.col("offsets"), span))
    return rows.select(
        "query", "query_len", "query_start", "query_end", "strand", "ref", "ref_len", "ref_start", "ref_end",
        (span + inserted - F.col("nm")).alias("num_match"), (span + inserted).alias("aln_len"), F.lit(0).cast("long").alias("mapq"),
        F.struct("record", "n").alias("line_no"), F.create_map(F.lit("NM"), F.col("nm").cast("string"), F.lit("cg"), cigar).alias("tags"),
    )


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """FASTA: seq_ix (from 0, file order), name (to the first space), seq, length."""
    records = with_line_numbers(spark.read.option("lineSep", "\n>").text(path).filter("value <> ''"), "n")
    head = F.regexp_replace(F.substring_index("value", "\n", 1), "^>", "")
    seq = F.when(F.instr("value", "\n") > 0, F.regexp_replace(F.substr("value", F.instr("value", "\n") + 1), r"\s", "")).otherwise("")
    return records.select((F.col("n") - 1).alias("seq_ix"), F.split(head, r"\s")[0].alias("name"), seq.alias("seq")).withColumn("length", F.length("seq").cast("long"))


def agp_lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw lines (file, line_no, line), for the checks on lines."""
    return _lines(spark, path).select(F.lit(path).alias("file"), "line_no", "line")


def parse_agp(lines: DataFrame) -> DataFrame:
    """Layout rows from raw lines (line_no, line)."""
    f = F.split("line", "\t")
    gap = f[4].isin("N", "U")
    get = lambda i, kind="string", when=None: (F.try_element_at(f, F.lit(i + 1)).try_cast(kind) if when is None else F.when(when, F.try_element_at(f, F.lit(i + 1)).try_cast(kind)))
    rows = lines.filter("line <> '' AND NOT startswith(line, '#')")
    return rows.select(
        "line_no", get(0).alias("obj"), get(1, "long").alias("obj_beg"), get(2, "long").alias("obj_end"), get(3, "long").alias("pid"), get(4).alias("comp_type"),
        get(5, when=~gap).alias("comp"), get(6, "long", ~gap).alias("comp_beg"), get(7, "long", ~gap).alias("comp_end"), get(8, when=~gap).alias("orientation"),
        get(5, "long", gap).alias("gap_len"), get(6, when=gap).alias("gap_type"), get(7, when=gap).alias("linkage"), get(8, when=gap).alias("linkage_evidence"),
    )


def read_agp(spark: SparkSession, path: str) -> DataFrame:
    return parse_agp(_lines(spark, path))


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    f = F.split("line", "\t")
    names = ("seqid", "source", "feature", "start", "end", "score", "strand", "phase", "attributes")
    rows = _lines(spark, path).filter("line <> '' AND NOT startswith(line, '#')")
    return rows.select(*((f[i].cast("long") if n in ("start", "end") else f[i]).alias(n) for i, n in enumerate(names)), "line_no")


def read_file_names(spark: SparkSession, path: str) -> list[str]:
    """The names of read files that a file lists, one a line; a short list for the driver."""
    return [r.value.rstrip() for r in spark.read.text(path).collect() if r.value.strip()]


def read_names(spark: SparkSession, path: str, whole_line: bool = False) -> DataFrame:
    """One name a line, to the first white space, or the whole line but for white space at its end."""
    if whole_line:
        return spark.read.text(path).select(F.rtrim("value").alias("name")).filter("name <> ''")
    return spark.read.text(path).select(F.split(F.trim("value"), r"\s+")[0].alias("name")).filter("name <> ''")


def read_sizes(spark: SparkSession, path: str) -> DataFrame:
    """Index files: name and length in the first two columns."""
    f = F.split("value", "\t")
    return spark.read.text(path).filter("value <> ''").select(f[0].alias("name"), f[1].cast("long").alias("length"))


def read_gfa(spark: SparkSession, path: str) -> DataFrame:
    """Segments of GFA: the LN tag, or the sequence's length; neither is an error."""
    f = F.split("value", "\t")
    tag = F.regexp_extract("value", r"\tLN:i:(\d+)", 1).try_cast("long")
    length = F.coalesce(tag, F.when(f[2] == "*", F.raise_error(F.concat(F.lit("no length of "), f[1])).cast("long")).otherwise(F.length(f[2]).cast("long")))
    return spark.read.text(path).filter("startswith(value, 'S\t')").select(f[1].alias("name"), length.alias("length"))


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("agp_path string, weight double").csv(path)


def read_links(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("u string, v string, weight double, raw long").option("sep", "\t").csv(path)


def read_confidence(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("query string, grouping double, location double, orientation double").option("sep", "\t").option("header", True).csv(path)


def read_coverage_histogram(spark: SparkSession, path: str) -> DataFrame:
    """COV lines of alignment statistics: cov, n_bp."""
    f = F.split("value", "\t")
    return spark.read.text(path).filter("startswith(value, 'COV')").select(f[2].cast("long").alias("cov"), f[3].cast("long").alias("n_bp"))


def read_sam(spark: SparkSession, path: str, any_order: bool = False) -> DataFrame:
    """Name-sorted SAM text: the read columns. The reference end is from the CIGAR. A file whose header doesn't say
    that it is sorted by name is an error, unless any_order."""
    lines = _lines(spark, path)
    f = F.split("line", "\t")
    flag = f[1].cast("int")
    ops = F.regexp_extract_all(f[5], F.lit(r"(\d+)[MDN=X]"), F.lit(1))
    span = F.aggregate(ops, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))
    if not any_order and not lines.filter(r"line RLIKE '^@HD\t(.*\t)?SO:queryname(\t|$)'").head(1):
        raise ValueError("the alignments must be sorted by read name")
    has = lambda bit: flag.bitwiseAND(F.lit(bit)) != 0
    return lines.filter("NOT startswith(line, '@')").select(
        F.col("line_no").alias("rec_no"), f[0].alias("q_name"), has(64).alias("is_read1"), has(4).alias("is_unmapped"), has(256).alias("is_secondary"),
        f[2].alias("ref"), (f[3].cast("long") - 1).alias("ref_start"), (f[3].cast("long") - 1 + span).alias("ref_end"),
    )


def read_lengths(spark: SparkSession, path: str) -> DataFrame:
    """asm (the path), length: of a file whose kind its suffix tells."""
    from loomwork.operators.agp import object_lengths

    bare = path[:-3] if path.endswith(".gz") else path
    kinds: list[tuple[tuple[str, ...], object]] = [
        ((".fasta", ".fa", ".fna"), read_fasta),
        ((".fai", ".sizes", ".lens"), read_sizes),
        ((".gfa",), read_gfa),
        ((".agp",), lambda s, p: object_lengths(read_agp(s, p))),
    ]
    for suffixes, read in kinds:
        if bare.endswith(suffixes):
            return read(spark, path).select(F.lit(path).alias("asm"), F.col("length").cast("long").alias("length"))
    raise ValueError(f"unknown kind of file: {path}")


def read_depth(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Depth of the mapped reads of SAM files as stretches, in positions that count from 1 as depth files do."""
    reads = read_sam(spark, paths[0], True)
    for path in paths[1:]:
        reads = reads.unionByName(read_sam(spark, path, True))
    return depth_of(reads.filter("NOT is_unmapped")).withColumns({"start": F.col("start") + 1, "end": F.col("end") + 1})


def depth_of(alns: DataFrame, name: str = "ref", start: str = "ref_start", end: str = "ref_end") -> DataFrame:
    """Read depth of a table of intervals as stretches: seq, start, end, depth. A sweep over interval ends."""
    from pyspark.sql.window import Window

    ends = F.array(F.struct(F.col(start).alias("pos"), F.lit(1).alias("d")), F.struct(F.col(end).alias("pos"), F.lit(-1).alias("d")))
    steps = alns.select(F.col(name).alias("seq"), F.explode(ends).alias("e")).groupBy("seq", F.col("e.pos").alias("start")).agg(F.sum("e.d").alias("d"))
    order = Window.partitionBy("seq").orderBy("start")
    rows = steps.select("seq", "start", F.lead("start").over(order).alias("end"), F.sum("d").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("depth"))
    return rows.filter("end IS NOT NULL AND depth > 0")

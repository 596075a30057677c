"""Tables in the shared folder, and row numbers."""

from __future__ import annotations

import atexit
import gc
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a session on one machine (master local) may name none: it gets a
    temporary one. On a cluster such a folder wouldn't be shared, so there it is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="loomwork-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(own)
        named = spark.sparkContext.getCheckpointDir()
    return named


def written(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, and every executor can read it. release: the
    shuffle files of the step may go, see released."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if release:
        released(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discarded(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more: all that came from them is written as well."""
    for table in tables:
        spark = table.sparkSession
        paths = table._jdf.queryExecution().analyzed().relation().location().rootPaths()
        for i in range(paths.size()):
            path = paths.apply(i)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def released(spark: SparkSession) -> None:
    """Let the executors drop the shuffle files of jobs that are done. Spark does so when the driver collects its
    garbage, which may be half an hour away."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _scanned(df: DataFrame) -> bool:
    """Whether df has the rows of files under one path, each once, and nothing in it changes between reads."""
    plan = df._jdf.queryExecution().analyzed()
    if not plan.deterministic():
        return False
    while plan.nodeName() in ("Project", "SubqueryAlias"):
        plan = plan.children().apply(0)
    if plan.nodeName() != "LogicalRelation" or plan.relation().getClass().getSimpleName() != "HadoopFsRelation":
        return False
    return plan.relation().location().rootPaths().size() == 1


def with_row_numbers(df: DataFrame, name: str) -> DataFrame:
    """df with a number of each row that stays the same however often it is read and however its rows are dealt out
    then. A row of a Parquet scan is numbered by file and stored place in the file; other rows are written to the
    shared folder with their numbers, and read from there."""
    if _scanned(df):
        try:
            rows = df.withColumns({"_file": F.col("_metadata.file_path"), name: F.col("_metadata.row_index")})
        except AnalysisException:  # not Parquet
            rows = None
        if rows is not None:
            files = sorted(r[0] for r in df.select("_metadata.file_path").distinct().collect())
            if len(files) < 2:
                return rows.drop("_file")
            places = df.sparkSession.createDataFrame(list(enumerate(files)), "_place long, _file string")
            rows = rows.join(F.broadcast(places), "_file").withColumn(name, F.shiftleft("_place", 40).bitwiseOR(F.col(name)))
            return rows.drop("_file", "_place")
    return written(df.withColumn(name, F.monotonically_increasing_id()), "numbered")


def dealt(side: DataFrame) -> DataFrame:
    """A side of a join that grows with the input, so it must be dealt out by the keys. Spark takes the size of its files
    for that of its rows, and would send a side of long made-up or well-packed strings to the driver as a small one."""
    return side.hint("merge")


#: Bytes of files whose rows one task of ``spread`` gets.
SHARE = 4 << 20


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt out by keys over a number of tasks that grows with its files, so that a task's memory doesn't. Spark
    alone takes a fixed number, or fewer."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(min(max(least, size // SHARE), 100_000), *keys)


def importable(spark: SparkSession) -> None:
    """Python workers find this package where the driver has it; ship it with --py-files where they can't."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    spark.sparkContext.environment.setdefault("PYTHONPATH", root)


def by_group(df: DataFrame, key: str, order: list[str], solve: Callable[[dict[str, list]], Iterator[tuple]], schema: str) -> DataFrame:
    """The rows that ``solve`` gives for the rows of each key, as lists by column, sorted by the order. Groups are a
    stream over Spark's sort: a task holds one of them at a time, and many small ones cost no more than one of all."""
    importable(df.sparkSession)
    target = to_arrow_schema(StructType.fromDDL(schema))
    names = df.columns

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict[str, list] = {}
        out: list[tuple] = []

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * len(target)
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target, strict=True)], schema=target)
            out.clear()
            return batch

        for batch in batches:
            keys = batch.column(names.index(key)).to_pylist()
            starts = [0] + [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]]
            columns = batch.to_pydict()
            for a, b in zip(starts, [*starts[1:], len(keys)], strict=True):
                if now and now[key][0] != keys[a]:
                    out.extend(solve(now))
                    now = {}
                for name in names:
                    now.setdefault(name, []).extend(columns[name][a:b])
                if len(out) >= 10_000:
                    yield flushed()
        if now:
            out.extend(solve(now))
        yield flushed()

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(solved, schema)


def running(df: DataFrame, order: list[str], name: str, value: str | None = None) -> DataFrame:
    """df with ``name``: the sum of ``value`` over the rows before in the order, or how many they are. The rows are
    dealt out by ranges of the order; a partition goes on from the sums of those before it, so no task has all rows."""
    rows = df.withColumn("_v", F.lit(1).cast("long") if value is None else F.col(value).cast("long"))
    rows = written(rows.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    starts = rows.groupBy("_pid").agg(F.sum("_v").alias("_s")).select("_pid", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(F.broadcast(starts), "_pid").withColumn(name, F.col("_start") + F.coalesce(F.sum("_v").over(inside), F.lit(0)))
    return rows.drop("_pid", "_start", "_v")


def with_line_numbers(lines: DataFrame, name: str = "line_no") -> DataFrame:
    """Rows of a file scan with their number from 1, by file name and place in the file. Spark deals stretches of files
    to partitions by size, so neither partitions nor the files in one go in that order. The rows of each stretch are
    counted, and its numbers go on from those before: no shuffle of the rows and no single task over them."""
    rows = lines.withColumns({"_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"), "_at": F.monotonically_increasing_id()})
    counts = rows.groupBy("_file", "_block").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    # Spark's part files have numbers of five digits, and of six from the 100,000th on
    place = F.regexp_replace("_file", r"/part-(\d{5})-", "/part-0$1-")
    before = Window.orderBy(place, "_block").rowsBetween(Window.unboundedPreceding, -1)  # one row for each stretch
    starts = counts.select("_file", "_block", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_start"))
    return rows.join(F.broadcast(starts), ["_file", "_block"]).withColumn(name, F.col("_start") + F.col("_at")).drop("_file", "_block", "_at", "_start")

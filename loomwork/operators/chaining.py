"""Chaining of neighbouring alignments.

The fold depends on order and history (a chain's end is a running maximum, its identity a running mean), so it is
no aggregate. Rows are dealt by query and reference, sorted by Spark, and folded as a stream: memory is one chain,
whatever the size of a group, and there is no quadratic step.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from loomwork.tables import importable

from .alignments import uncontained_in_query

SCHEMA = "query string, query_len long, query_start long, query_end long, strand string, ref string, ref_len long, ref_start long, ref_end long, num_match long, aln_len long, mapq long, line_no long"


def mean_mapq(a: int, b: int) -> int:
    """The quality of the mean error probability."""
    p = (10 ** (-a / 10) + 10 ** (-b / 10)) / 2
    return round(-10 * (math.log(p) / math.log(10)))


def chained(alns: DataFrame, distance: int, careful: bool = True) -> DataFrame:
    """Chains of alignments: in order of reference position, a row joins the chain before it if reference and
    strand agree, its reference start is within ``distance`` of the chain's reference end, and, if careful, the
    same holds on the query. Chains that others contain in the query go."""
    names = [f.strip().split()[0] for f in SCHEMA.split(",")]
    # the window deals rows out, unless they are by query already, and sorts them
    order = Window.partitionBy("query", "ref").orderBy("ref_start", "ref_end", "line_no")
    rows = alns.select(*names).withColumn("_at", F.row_number().over(order)).sortWithinPartitions("query", "ref", "ref_start", "ref_end", "line_no")

    target = to_arrow_schema(StructType.fromDDL(SCHEMA))
    importable(alns.sparkSession)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict | None = None
        for batch in batches:
            done = []
            for x in batch.to_pylist():
                if now and x["query"] == now["query"] and x["ref"] == now["ref"] and x["strand"] == now["strand"] and abs(x["ref_start"] - now["ref_end"]) <= distance and (not careful or abs(x["query_start"] - now["query_end"]) <= distance):
                    identity = (now["num_match"] / now["aln_len"] + x["num_match"] / x["aln_len"]) / 2
                    for side in ("query", "ref"):
                        now[f"{side}_start"] = min(now[f"{side}_start"], x[f"{side}_start"])
                        now[f"{side}_end"] = max(now[f"{side}_end"], x[f"{side}_end"])
                    now["aln_len"] = now["ref_end"] - now["ref_start"]
                    now["num_match"] = round(identity * now["aln_len"])
                    now["mapq"] = mean_mapq(now["mapq"], x["mapq"])
                else:
                    if now:
                        done.append(now)
                    now = x
                    del now["_at"]
            if done:
                yield pa.RecordBatch.from_pylist(done, target)
        if now:
            yield pa.RecordBatch.from_pylist([now], target)

    return uncontained_in_query(rows.mapInArrow(fold, SCHEMA))

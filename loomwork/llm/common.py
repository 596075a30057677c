"""What several operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.tables import discarded, importable, released, with_row_numbers, written

__all__ = ["WORD", "apart", "discarded", "free_name", "importable", "in_arrow", "released", "shipped", "table", "whole_text", "with_row_numbers", "written"]

#: A word, in all operators that count or compare words.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(col: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def free_name(taken: Iterable[str], name: str) -> str:
    """name, or name with more underscores if a column is called so (names differ in more than case)."""
    taken = {c.lower() for c in taken}
    while name.lower() in taken:
        name += "_"
    return name


def apart(docs: DataFrame, keep: Iterable[str]) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """docs with all columns but ``keep`` under inner names, so that none clashes with a column that an operator makes,
    and what selects the columns of docs, under their names, from a result (and further columns of it)."""
    names, keep = docs.columns, set(keep)
    inner = [c if c in keep else f"_c{i}" for i, c in enumerate(names)]
    return docs.toDF(*inner), lambda out, *more: out.select(*(F.col(f"`{x}`").alias(c) for x, c in zip(inner, names, strict=True)), *more)


def in_arrow(df: DataFrame, schema: str, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]]) -> DataFrame:
    """df through Python: make() is called once a task and gives what turns the columns of a batch (lists) into
    the columns of the output (lists or arrays). Nulls stay None and long values exact."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    struct = StructType.fromDDL(schema)
    importable(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, step = to_arrow_schema(struct), make()
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                out = step(dict(zip(part.schema.names, (c.to_pylist() for c in part.columns), strict=True)))
                if out is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in target], schema=target)

    return df.mapInArrow(run, struct)


def shipped(spark: SparkSession, value: object) -> object:
    """A value of bounded size for all tasks, sent once to each executor."""
    return spark.sparkContext.broadcast(value)

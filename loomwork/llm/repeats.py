"""What substring dedup by words and by bytes share: pieces that occur again, the spans that they make, the check of
the spans against their sources, and what is left of the texts.

The stages keep hot keys apart. Counts of anchors and of equal pieces are combined before the shuffle and written, so
that the joins back to the occurrences are between plain tables, whose large partitions Spark splits. What is collected
for a document is bounded by its own length, what is asked of a source by ASKED.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import Anchors
from .common import discarded, importable, in_arrow, whole_text, with_row_numbers, written

PIECE = "m long, s long, row long, id {id}, first int, n int, off int"
#: Spans that one row of a source answers about.
ASKED = 500
#: Longs that ``parted`` sends to the executors at most, each for 64 row numbers.
SENT = 1 << 21


def numbered(docs: DataFrame, text: str, ident: str, row: str | None = None) -> DataFrame:
    """row, id and text. The number is that of the stored column ``row``, or as with_row_numbers gives it, so it is the
    same each time the rows are read."""
    if row is None:
        docs, row = with_row_numbers(docs.select(F.col(f"`{ident}`").alias("id"), whole_text(f"`{text}`").alias("text")), "row"), "row"
        return docs.select("row", "id", "text")
    return docs.select(F.col(f"`{row}`").alias("row"), F.col(f"`{ident}`").alias("id"), whole_text(f"`{text}`").alias("text"))


def repeated(values: list, lens: np.ndarray):
    """Each value as often as lens says: an array if they are whole numbers, else a list."""
    if all(type(v) is int for v in values):
        return np.repeat(np.array(values, np.int64), lens)
    return [values[i] for i in np.repeat(np.arange(len(lens)), lens).tolist()]


def recurring(rows: DataFrame, anchors: Anchors, units: Callable[[], Callable[[str], np.ndarray]], name: str) -> DataFrame:
    """The pieces whose anchor occurs more than once, from a table in the shared folder."""
    kind = rows.schema["id"].dataType.simpleString()

    def make():
        split = units()

        def step(cols):
            found, lens = [], []
            for text in cols["text"]:
                found.append(anchors.pieces(split(text)))
                lens.append(found[-1][0].size)
            m, s, first, n, off = (np.concatenate(x) for x in zip(*found, strict=True))
            return {"m": m, "s": s, "row": repeated(cols["row"], lens), "id": repeated(cols["id"], lens), "first": first.astype(np.int32), "n": n.astype(np.int32), "off": off.astype(np.int32)}

        return step

    pieces = written(in_arrow(rows, PIECE.format(id=kind), make), f"{name}-pieces")
    again = written(pieces.groupBy("m").agg(F.count("*").alias("_n")).filter("_n > 1").select("m"), f"{name}-again", release=True)
    found = written(pieces.join(again, "m", "left_semi"), f"{name}-recurring", release=True)
    discarded(pieces, again)
    return found


def parted(rows: DataFrame, wanted: DataFrame, name: str) -> tuple[DataFrame, DataFrame | None]:
    """The rows whose number is in ``wanted`` (row), and the others, told apart where they are read, so that only texts
    that a join needs are shuffled. Executors get a bit for each number. Of more than SENT longs nothing is sent and rows
    are not told apart: then the first are all rows, and the others None."""
    bits = F.expr("bit_or(shiftleft(1L, CAST(row & 63 AS INT)))").alias("_bits")
    bits = written(wanted.groupBy(F.shiftright("row", 6).alias("_word")).agg(bits), f"{name}-bits", release=True)
    if bits.count() > SENT:
        return rows, None
    told = rows.withColumn("_word", F.shiftright("row", 6)).join(F.broadcast(bits), "_word", "left")
    told = told.withColumn("_in", F.expr("_bits IS NOT NULL AND getbit(_bits, CAST(row & 63 AS INT)) = 1"))
    return tuple(told.filter(x).select(*rows.columns) for x in ("_in", "NOT _in"))


def classes(pieces: DataFrame, name: str) -> DataFrame:
    """One row for each set of equal pieces: m, s, how many there are, and the earliest. A written table."""
    earliest = F.min(F.struct("id", "row", "first", "n", "off")).alias("lead")
    return written(pieces.groupBy("m", "s").agg(F.count("*").alias("many"), earliest), f"{name}-sets", release=True)


def branching(sets: DataFrame, name: str) -> DataFrame:
    """The anchors with unequal pieces, and how many. A written table."""
    return written(sets.groupBy("m").agg(F.count("*").alias("sets")).filter("sets > 1"), f"{name}-branching", release=True)


def _joined(row: int, first: np.ndarray, n: np.ndarray, src: np.ndarray, src_first: np.ndarray) -> tuple[np.ndarray, ...]:
    """first, n, src, at of the long spans of one row. src: -1 where there is none; in the result -2 is this row."""
    # of equal windows in a row each has the one before as its source, so that a periodic stretch is one long span
    order = np.lexsort((first, n, src_first, src))
    first, n, src, src_first = first[order], n[order], src[order], src_first[order]
    none = (src < 0) | ((src == row) & (src_first == first))
    same = np.append(False, (src[1:] == src[:-1]) & (src_first[1:] == src_first[:-1]) & (n[1:] == n[:-1])) & (src >= 0) & ~none
    at = np.where(same, np.append(0, first[:-1]), src_first)
    src = np.where(none, -1, np.where(same | (src == row), -2, src))
    shift = np.where(none, 0, at - first)
    # what goes on in the same source
    order = np.lexsort((first, shift, src))
    first, src, shift = first[order], src[order], shift[order]
    end = first + n[order]
    new = np.append(True, (src[1:] != src[:-1]) | (shift[1:] != shift[:-1]))
    far = np.cumsum(new) * (1 << 40) + end
    reach = np.maximum.accumulate(far)
    new |= np.append(True, np.cumsum(new)[1:] * (1 << 40) + first[1:] > reach[:-1])
    start = np.flatnonzero(new)
    ends = np.maximum.reduceat(end, start) if start.size else start
    return first[start], ends - first[start], src[start], first[start] + shift[start]


def long_spans(spans: DataFrame, name: str) -> DataFrame:
    """row, first, n, src, at: spans (row, first, n, src, src_first) with neighbours joined that go on in the same
    source. A source in the same row has a null src; spans that are their own source, or have none, have a null at as
    well. A written table. A row's spans are arrays here, in number bounded by the text's length."""
    importable(spans.sparkSession)
    each = spans.groupBy("row").agg(F.collect_list(F.struct("first", "n", "src", "src_first")).alias("spans"))
    schema = pa.schema([("row", pa.int64()), ("first", pa.int32()), ("n", pa.int32()), ("src", pa.int64()), ("at", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, lists = batch.column("row").to_numpy(), batch.column("spans")
            for i, row in enumerate(rows.tolist()):
                found = lists[i].values
                first, n, src, src_first = (found.field(k).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4))
                first, n, src, at = _joined(row, first, n, src, src_first)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(first.size, row)), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(src, mask=src < 0), pa.array(at.astype(np.int32), mask=src == -1)], schema=schema)

    return written(each.mapInArrow(run, "row long, first int, n int, src long, at int"), f"{name}-spans", release=True)


def sourced(rows: DataFrame, spans: DataFrame, cut: Callable[[], Callable[[str], Callable[[int, int], bytes]]], name: str) -> DataFrame:
    """spans (long_spans) with ``source``: what the source has at the span's coordinates; null where there is none or
    it is the same row. cut() gives what makes of a text a function of first window and number of windows.

    A source that many spans have is dealt out: each of its rows here answers about ASKED of them."""
    asked = spans.filter("src IS NOT NULL")
    many = written(asked.groupBy("src").agg(F.count("*").alias("_n")), f"{name}-asked")
    asked = asked.join(many, "src").withColumn("_k", F.pmod(F.xxhash64("row", "first"), F.ceil(F.col("_n") / ASKED)))
    asked = written(asked.groupBy("src", "_k").agg(F.collect_list(F.struct("row", "first", "n", "at")).alias("asked")), f"{name}-asks", release=True)

    def make():
        reader = cut()

        def step(cols):
            out = {"row": [], "first": [], "n": [], "at": [], "source": []}
            for text, found in zip(cols["text"], cols["asked"], strict=True):
                read = reader(text)
                for x in found:
                    for k in ("row", "first", "n", "at"):
                        out[k].append(x[k])
                    out["source"].append(read(x["at"], x["n"]))
            return out

        return step

    texts = asked.join(rows.select(F.col("row").alias("src"), "text"), "src").select("asked", "text")
    answers = in_arrow(texts, "row long, first int, n int, at int, source binary", make)
    return answers.unionByName(spans.filter("src IS NULL").select("row", "first", "n", "at", F.lit(None).cast("binary").alias("source")))


def with_spans(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """rows with ``spans``, an array of (first, n, at, source) runs of windows that go; null if there are none."""
    each = spans.groupBy("row").agg(F.collect_list(F.struct("first", "n", "at", "source")).alias("spans"))
    return rows.join(each, "row", "left")


def covered(size: int, window: int, spans: list[dict] | None, have: Callable[[int, int], bytes]) -> np.ndarray:
    """Which of ``size`` units are in the windows of the spans. ``have`` reads the text itself (first window, windows):
    a span that doesn't equal its source is an error, as then the hashes of unequal windows agree."""
    if not spans:
        return np.zeros(size, bool)
    for x in spans:
        source = x["source"] if x["source"] is not None or x["at"] is None else have(x["at"], x["n"])
        if source is not None and have(x["first"], x["n"]) != source:
            raise ValueError("a span differs from its source: two unequal windows have the same 128 bits of hash")
    first = np.array([x["first"] for x in spans])
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, first + np.array([x["n"] for x in spans]) + window - 1, -1)
    return np.cumsum(edge[:-1]) > 0

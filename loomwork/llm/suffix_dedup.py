"""Suffix-array dedup of bytes by column-wise construction.

Pieces (anchors.py) of texts whose anchors recur are laid out in aligned segments: the anchor of each begins at
the same column. The suffixes of all segments are sorted by going through the columns from right to left. Each round
inserts one symbol for every segment: a stable sort by the inserted symbol takes the order of the suffixes one
column further (the symbols that the order permutes are this column of the collection's Burrows-Wheeler
transform), and the common prefixes of neighbours grow by one where the symbols agree and restart where they
differ. Equal windows have their anchor at the same place, so a window recurs if and only if, in its own column,
its suffix shares the whole window's length with a neighbour.

Spark's sorted shuffle is the sequential external file: a task reads the segments of its anchors in order and
handles a bounded block at a time. Only one segment for each set of equal pieces is laid out. An anchor with more
segments than a block holds is made longer until they fit: its windows are cut in two halves by their place, the
windows of a half have more bytes than the anchor in common, and these are the new anchor. Segments that have become
equal are laid out once again. At the latest an anchor of a whole window's length leaves equal segments only.

Equal pieces are found by 128 bits of hash, and every copy is compared byte for byte with its source, the earliest,
before it goes (repeats.sourced).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import Anchors
from .common import discarded, in_arrow, table, written
from .repeats import branching, classes, covered, long_spans, numbered, parted, recurring, sourced, with_spans

#: Bytes in a window and in an anchor.
WINDOW, ANCHOR = 400, 128
#: Segments in a block about, and of one anchor in it at most.
BLOCK = 4096
SEGMENT = "m long, a int, single boolean, row long, first int, n int, off int, segment binary"


def byte_units():
    random = np.random.default_rng(12345).integers(1, 1 << 63, 256, dtype=np.uint64)
    return lambda text: random[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]


def bytes_at(window: int):
    """For repeats.sourced: the bytes of a run of windows."""

    def read(text: str):
        data = text.encode("utf-8", "surrogatepass")
        return lambda first, n: data[first : first + n + window - 1]

    return lambda: read


def common_windows(segments: list[bytes], group: np.ndarray, left: np.ndarray, window: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each column, from right to left, the segments whose window that starts there is another's as well.

    segments of one group are neighbours; left is the number of bytes before the anchor. Columns count from it.
    """
    size = np.array([len(x) for x in segments])
    if not size.size:
        return
    low, high = -int(left.max()), int((size - left).max())
    data = np.frombuffer(b"".join(segments) + b"\0", np.uint8)
    origin = np.append(0, np.cumsum(size))[:-1] + left
    order = np.arange(size.size)
    common = np.zeros(size.size, np.int64)  # prefix shared with the one before in order
    group = group.astype(np.int64)
    for column in range(high - 1, low - 1, -1):
        here = (column < size - left) & (column >= -left)
        # one symbol of each segment; 0: the segment has none in this column
        symbol = np.where(here, data[np.where(here, origin + column, 0)].astype(np.int64) + 1, 0)
        key = (group << 9 | symbol)[order]
        put = np.argsort(key, kind="stable")
        order, key = order[put], key[put]
        a, b = put[:-1] + 1, put[1:] + 1  # between neighbours that agree lie these places of the order before
        agree = np.flatnonzero((key[1:] == key[:-1]) & (key[1:] & 511 > 0))
        grown = np.zeros(size.size, np.int64)
        if agree.size:
            spans = np.empty(2 * agree.size, np.int64)
            spans[0::2], spans[1::2] = a[agree], b[agree]
            grown[agree + 1] = np.minimum.reduceat(np.append(common, 0), spans)[0::2] + 1
        common = grown
        if column <= high - window:
            twice = common >= window
            if twice.any():
                yield column, order[twice | np.append(twice[1:], False)]


def halves(segments: DataFrame, window: int) -> DataFrame:
    """Each segment as two, with anchors that are longer: m, s, a and the rest of SEGMENT.

    Windows begin at most ``window - a`` bytes before the anchor. Those that begin at least half of that before it
    all have the bytes from there to the anchor's end; the others all have the anchor and as many bytes behind it.
    """

    def make():
        def step(cols):
            out = {k: [] for k in ("m", "s", "a", "single", "row", "first", "n", "off", "segment")}
            for m, a, single, row, first, n, off, data in zip(*(cols[k] for k in ("m", "a", "single", "row", "first", "n", "off", "segment")), strict=True):
                middle = off - (window - a + 1) // 2  # windows that begin up to here are of the first half
                for side, lo, hi, start, stop in ((0, 0, min(n, middle + 1), middle, off + a), (1, max(0, middle + 1), n, off, middle + 1 + window)):
                    if lo < hi:
                        part = data[lo : hi + window - 1]
                        out["m"].append(xxhash.xxh3_64_intdigest(m.to_bytes(8, "little", signed=True) + data[start:stop], side) - (1 << 63))
                        out["s"].append(xxhash.xxh64_intdigest(part, hi - lo << 20 | start - lo) - (1 << 63))
                        out["a"].append(stop - start)
                        out["segment"].append(part)
                        out["first"].append(first + lo)
                        out["n"].append(hi - lo)
                        out["off"].append(start - lo)
                        out["single"].append(single)
                        out["row"].append(row)
            return out

        return step

    return in_arrow(segments, f"s long, {SEGMENT}", make)


def fitting(segments: DataFrame, most: int, window: int, name: str) -> tuple[DataFrame, DataFrame | None]:
    """Segments of which no anchor has more than ``most``, and the spans (row, first, n, src, src_first) that were
    found on the way as copies; None if there was nothing to do. segments is a written table."""
    cold, spans = [], None
    for _ in range(window.bit_length() + 2):  # the places of windows halve each time
        sizes = written(segments.groupBy("m").agg(F.count("*").alias("_n")), f"{name}-sizes", release=True)
        cold.append(segments.join(sizes.filter(f"_n BETWEEN 2 AND {most}").select("m"), "m", "left_semi"))
        if not sizes.filter(f"_n > {most}").head(1):
            break
        parts = written(halves(segments.join(sizes.filter(f"_n > {most}").select("m"), "m", "left_semi"), window), f"{name}-halves", release=True)
        lead = F.min(F.struct("row", "first")).alias("lead")
        sets = written(parts.groupBy("m", "s").agg(F.count("*").alias("many"), F.bool_and("single").alias("all_single"), lead), f"{name}-halfsets", release=True)
        # a row whose piece had copies anyway is known to go, and isn't told again
        copies = parts.filter("single").join(sets.filter("many > 1"), ["m", "s"]).select("row", "first", "n", F.col("lead.row").alias("src"), F.col("lead.first").alias("src_first"))
        spans = copies if spans is None else spans.unionByName(copies)
        leads = sets.select("m", "s", F.col("lead.row").alias("row"), F.col("lead.first").alias("first"), (F.col("all_single") & (F.col("many") == 1)).alias("_single"))
        segments = written(parts.join(leads, ["m", "s", "row", "first"]).withColumn("single", F.col("_single")).select("m", "a", "single", "row", "first", "n", "off", "segment"), f"{name}-longer", release=True)
    out = cold[0]
    for more in cold[1:]:
        out = out.unionByName(more)
    return out, spans


def repeated_spans(rows: DataFrame, anchors: Anchors, units, most: int = BLOCK, name: str = "bytes") -> DataFrame:
    """row, first, n: runs of windows that occur elsewhere as well; src and src_first where hashes told so."""
    window = anchors.window
    pieces = recurring(rows, anchors, units, name)
    sets = classes(pieces, name)
    forks = branching(sets, name)
    whole = pieces.join(sets.filter("many > 1").select("m", "s", "lead"), ["m", "s"]).select("row", "first", "n", F.col("lead.row").alias("src"), F.col("lead.first").alias("src_first"))
    opened = sets.join(forks, "m", "left_semi").select("m", (F.col("many") == 1).alias("single"), "lead.row", "lead.first", "lead.n", "lead.off")
    laid = opened.groupBy("row").agg(F.collect_list(F.struct("m", "single", "first", "n", "off")).alias("open"))

    def cut():
        def step(cols):
            out = {"m": [], "single": [], "row": [], "first": [], "n": [], "off": [], "segment": []}
            for row, text, found in zip(cols["row"], cols["text"], cols["open"], strict=True):
                data = text.encode("utf-8", "surrogatepass")
                for p in found:
                    for k in ("m", "single", "first", "n", "off"):
                        out[k].append(p[k])
                    out["row"].append(row)
                    out["segment"].append(data[p["first"] : p["first"] + p["n"] + window - 1])
            out["a"] = [anchors.k] * len(out["m"])
            return out

        return step

    texts, _ = parted(rows, opened.select("row"), f"{name}-open")
    segments = written(in_arrow(texts.join(laid, "row"), SEGMENT, cut), f"{name}-segments", release=True)
    fit, copies = fitting(segments, most, window, name)
    fit = fit.repartition("m").sortWithinPartitions("m")

    def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(block: list[dict]) -> pa.RecordBatch:
            left = np.array([x["off"] for x in block])
            ms = np.array([x["m"] for x in block])
            group = np.append(0, np.cumsum(ms[1:] != ms[:-1]))
            single = np.array([x["single"] for x in block])
            row, first, n = (np.array([x[k] for x in block]) for k in ("row", "first", "n"))
            out: list[tuple[np.ndarray, np.ndarray]] = []
            for column, which in common_windows([x["segment"] for x in block], group, left, window):
                at = column + left[which]
                which = which[single[which] & (at < n[which])]
                out.append((row[which], first[which] + column + left[which]))
            rows_, firsts = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            # runs of windows
            sort = np.lexsort((firsts, rows_))
            rows_, firsts = rows_[sort], firsts[sort]
            start = np.flatnonzero(np.append(True, (rows_[1:] != rows_[:-1]) | (firsts[1:] != firsts[:-1] + 1))) if rows_.size else np.zeros(0, np.int64)
            lens = np.diff(np.append(start, rows_.size))
            return pa.RecordBatch.from_arrays([pa.array(rows_[start], pa.int64()), pa.array(firsts[start], pa.int32()), pa.array(lens, pa.int32())], ["row", "first", "n"])

        block: list[dict] = []
        for batch in batches:
            for x in batch.to_pylist():
                if len(block) >= BLOCK and x["m"] != block[-1]["m"]:
                    yield done(block)
                    block = []
                block.append(x)
        if block:
            yield done(block)

    by_column = fit.mapInArrow(columns, "row long, first int, n int")
    by_column = by_column.select("*", F.lit(None).cast("long").alias("src"), F.lit(None).cast("int").alias("src_first"))
    found = whole.unionByName(by_column)
    spans = long_spans(found if copies is None else found.unionByName(copies), name)
    discarded(pieces, sets, forks, segments)
    return spans


def suffix_dedup(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, most: int = BLOCK, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """Per document: ident, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``, ``kept`` (the bytes left).

    A byte of the UTF-8 text goes if a string of ``window`` bytes that covers it also starts anywhere else, in
    this row or another. A null text is empty; texts shorter than a window lose nothing. Repeated rows are copies
    of each other, so they lose every byte if they have a window; identifiers, null or tied, play no part, nor do
    other columns of docs. ``most`` is the number of segments that are compared at a time; it doesn't change results.
    """
    rows, anchors = numbered(docs, text, ident), Anchors(anchor, window)
    spans = repeated_spans(rows, anchors, byte_units, most)
    sources, _ = parted(rows, spans.filter("src IS NOT NULL").select(F.col("src").alias("row")), "bytes-sources")
    some, others = parted(rows, spans, "bytes-some")
    found = with_spans(some, sourced(sources, spans, bytes_at(window), "bytes"))
    if others is not None:
        found = found.unionByName(others.withColumn("spans", F.lit(None).cast(found.schema["spans"].dataType)))
    kind = rows.schema["id"].dataType.simpleString()

    def make():
        def step(cols):
            size, removed, runs, digest, kept = [], [], [], [], []
            for t, spans in zip(cols["text"], cols["spans"], strict=True):
                data = t.encode("utf-8", "surrogatepass")
                gone = covered(len(data), window, spans, lambda first, n: data[first : first + n + window - 1])  # noqa: B023
                left = np.frombuffer(data, np.uint8)[~gone].tobytes() if spans else data
                size.append(len(data))
                removed.append(len(data) - len(left))
                runs.append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()) if spans else 0)
                digest.append(hashlib.sha256(left).hexdigest())
                kept.append(left)
            return {ident: cols["id"], "n_bytes": size, "n_removed": removed, "n_spans": runs, "kept_sha256": digest, "kept": kept}

        return step

    return in_arrow(found, f"`{ident}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary", make)


def op3_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup(docs).drop("kept")

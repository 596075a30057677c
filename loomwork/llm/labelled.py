"""Labelled training rows and held-out rows, for the classifiers of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import importable, whole_text

#: Rows whose identifier's checksum leaves the remainder 0 are held out.
FOLDS = 5


def held_out(ident: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(ident).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """(text, label) of at most ``most`` labelled rows that aren't held out: those of the smallest hashes of the
    identifier, an even choice that is the same in each run. Their identifiers are broadcast, ``most`` at most."""
    rows = labels.filter(F.col(label).isNotNull() & F.col(ident).isNotNull() & ~held_out(ident)).groupBy(ident).agg(F.max(label).cast("int").alias("_y"))
    rows = rows.orderBy(F.xxhash64(ident), ident).limit(most)
    return docs.select(ident, whole_text(text).alias("_text")).join(F.broadcast(rows), ident).select("_text", "_y")


def trained(rows: DataFrame, fit: Callable[[Iterator[tuple[list[str], list[int]]]], np.ndarray]) -> np.ndarray:
    """What fit makes of the training rows, in one task on an executor; only the model comes to the driver. The
    rows come to fit in an order that depends on their contents alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = fit((b.column(0).to_pylist(), b.column(1).to_pylist()) for b in batches)
        yield pa.RecordBatch.from_pydict({"model": pa.array([np.asarray(model, np.float32).tobytes()], pa.binary())})

    importable(rows.sparkSession)
    one = rows.repartition(1).sortWithinPartitions(F.xxhash64("_text"), "_text", "_y")
    found = one.mapInArrow(run, "model binary").collect()
    return np.frombuffer(found[0][0], np.float32) if found else np.asarray(fit(iter(())), np.float32)


def minimise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], w: np.ndarray, rounds: int, memory: int = 6) -> np.ndarray:
    """Limited-memory BFGS with backtracking. f gives value and gradient."""
    value, g = f(w)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        d, kept = -g.copy(), []
        for s, y, r in reversed(steps):
            kept.append(a := r * s.dot(d))
            d -= a * y
        if steps:
            s, y, r = steps[-1]
            d *= 1 / (r * y.dot(y))
        for (s, y, r), a in zip(steps, reversed(kept), strict=True):
            d += (a - r * y.dot(d)) * s
        slope, t = g.dot(d), 1.0 if steps else 1 / max(1.0, float(np.abs(g).sum()))
        if slope >= 0:
            break
        while True:
            nxt, g2 = f(w + t * d)
            if nxt <= value + 1e-4 * t * slope or t < 1e-10:
                break
            t *= 0.5
        s, y = t * d, g2 - g
        w, done, value, g = w + s, value - nxt < 1e-7 * max(1.0, abs(value)), nxt, g2
        if (sy := float(s.dot(y))) > 1e-12:
            steps = [*steps[-memory + 1 :], (s, y, 1 / sy)]
        if done:
            break
    return w


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))

"""Toxicity: a linear classifier on character n-grams whose features are scaled by naive Bayes log-count ratios.

Features say which n-grams of 3 to 5 characters, hashed, a lower-cased text has. Each is scaled by the log of the
ratio of its smoothed shares among toxic and other training texts; logistic regression on the scaled features
gives the weights. The product of ratio and weight is one number for each hash value, so a score is a sum over a
text's distinct n-grams. The model has a fixed size, is trained in one task on a bounded sample of labelled rows,
and is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, in_arrow, shipped, table, whole_text
from .labelled import held_out, minimise, sigmoid, trained, training_rows

BITS = 19
ORDERS = (3, 4, 5)
#: Training rows at most.
SAMPLE = 4000
#: Added to the counts; training texts that an n-gram needs; strength of the penalty on weights.
SMOOTH, LEAST, PENALTY = 1.0, 3, 1e-3
#: Features of training texts handled at a time, about.
BLOCK = 1 << 20


class Grams:
    """The distinct hashed n-grams of texts."""

    def __init__(self) -> None:
        self.seen = np.zeros(1 << BITS, bool)

    def __call__(self, text: str) -> np.ndarray:
        c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
        h, seen = c, self.seen
        for n in range(2, ORDERS[-1] + 1):
            h = h[:-1] * np.uint32(0x01000193) + c[n - 1 :]
            if n >= ORDERS[0]:
                if not h.size:
                    break
                seen[((h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1) + np.uint32(n)) >> np.uint32(32 - BITS)] = True
        found = np.flatnonzero(seen)
        seen[found] = False
        return found.astype(np.uint32)


def log_ratios(at: np.ndarray, toxic: np.ndarray, size: int = 1 << BITS) -> np.ndarray:
    """Of each hash value, the log of its smoothed share among the features of toxic texts over that among others'. at:
    the features of all texts; toxic: 1 or 0 for each. Values of fewer than LEAST texts get 0."""
    many, p = np.zeros(size, np.int64), np.zeros(size)
    for lo in range(0, at.size, BLOCK):
        many += np.bincount(at[lo : lo + BLOCK], minlength=size)
        p += np.bincount(at[lo : lo + BLOCK], toxic[lo : lo + BLOCK], size)
    q = SMOOTH + many - p
    p = SMOOTH + p
    out = np.log((p / p.sum()) / (q / q.sum()))
    out[many < LEAST] = 0
    return out


def fit(batches: Iterator[tuple[list[str], list[int]]]) -> np.ndarray:
    """The weight of each hash value, and the bias at the end."""
    grams, rows, ys = Grams(), [], []
    for texts, labels in batches:
        rows += [grams(t) for t in texts]
        ys += labels
    y = np.array(ys, float)
    size = 1 << BITS
    if not rows or y.min() == y.max():
        return np.append(np.zeros(size), -1.0 if not rows or y[0] == 0 else 1.0)
    at, lens = np.concatenate(rows), np.array([r.size for r in rows])
    del rows
    ratio = log_ratios(at, np.repeat(y > 0, lens), size)
    # only hash values that training texts have and whose ratio isn't 0 get a weight
    own = np.flatnonzero(ratio)
    back = np.zeros(size, np.int32)
    back[own] = np.arange(own.size)
    keep = (ratio != 0)[at]
    lens = np.add.reduceat(np.append(keep, False), np.append(0, np.cumsum(lens))[:-1], dtype=np.int64) * (lens > 0)
    at = back[at[keep]]
    starts, r, n = np.append(0, np.cumsum(lens)), ratio[own], len(y)
    cuts = np.unique(np.append(np.searchsorted(starts[:-1], np.arange(0, max(at.size, 1), BLOCK)), n))
    blocks = [(a, b, at[starts[a] : starts[b]]) for a, b in zip(np.append(0, cuts)[:-1].tolist(), cuts.tolist(), strict=True) if a < b]

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z, g, scaled = np.empty(n), np.zeros(own.size), w[:-1] * r
        for a, b, some in blocks:
            total = np.append(0, np.cumsum(scaled[some]))
            z[a:b] = total[starts[a + 1 : b + 1] - starts[a]] - total[starts[a:b] - starts[a]] + w[-1]
        e = sigmoid(z) - y
        for a, b, some in blocks:
            g += np.bincount(some, np.repeat(e[a:b], lens[a:b]), own.size)
        g = g * r / n + PENALTY * w[:-1]
        return float(np.logaddexp(0, z).mean() - (y * z).mean() + PENALTY / 2 * w[:-1].dot(w[:-1])), np.append(g, e.mean())

    w = minimise(loss, np.append(np.zeros(own.size), np.log(y.mean() / (1 - y.mean()))), 40)
    out = np.zeros(size + 1)
    out[own], out[-1] = w[:-1] * r, w[-1]
    return out


def model(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = SAMPLE, **names) -> np.ndarray:
    return trained(training_rows(docs, labels, label, most, **names), fit)


def scored(docs: DataFrame, weights: np.ndarray, text: str = "text", keep: tuple[str, ...] = ("doc_id",), out: str = "score") -> DataFrame:
    """The columns of ``keep`` and a score, from 0 to 1: how likely the whole text is toxic.

    The result is called ``out``, a kept column of that name is replaced; any other keeps its name and values. A null text counts as empty; empty texts get the score of the bias alone. Equal texts get equal scores. Texts
    without a known n-gram, and all texts if there were no labelled rows of both kinds, get the bias's as well.
    """
    sent = shipped(docs.sparkSession, weights)
    keep = tuple(c for c in keep if c != out)
    # a text that is kept goes through the workers once
    name = text if text in keep else free_name((*keep, out), "_text")
    rows = docs.select(*(F.col(f"`{c}`") for c in keep), *(() if name in keep else (whole_text(f"`{text}`").alias(name),)))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name in keep)

    def make():
        w, grams = sent.value, Grams()

        def step(cols):
            z = np.array([float(w[grams(t or "")].sum()) + float(w[-1]) for t in cols[name]])
            return cols | {out: sigmoid(z)}

        return step

    return in_arrow(rows, f"{schema}`{out}` double", make)


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = model(docs, table(spark, sf_dir, "labels"))
    rows = scored(docs, weights)
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

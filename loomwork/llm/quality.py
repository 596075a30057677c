"""Quality: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

The n-grams are single words and pairs of neighbouring words, once as they stand (lower case) and once by shape:
runs of small letters, capitals and digits each become one sign, other characters stay, and a word equal to the
one before it has a shape of its own. Shapes carry over to words that training never saw. A text's vector holds
each feature's share of all, times SCALE; the score is its dot product with the weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, in_arrow, shipped, table, whole_text
from .labelled import held_out, sigmoid, trained, training_rows

BITS = 18
#: Training rows at most, and how often each is used.
SAMPLE, PASSES = 6000, 4
SCALE = 12.0
#: Rate, its offset, and the L1 and L2 strengths of the updates.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.002, 0.01
#: Words that a task remembers at most.
REMEMBERED = 1_000_000

_RUNS = ((regex.compile(r"\p{Lu}+"), "A"), (regex.compile(r"[\p{Ll}\p{Lo}\p{Lm}\p{M}]+"), "a"), (regex.compile(r"\p{N}+"), "0"))


class Words(dict):
    """Of a word: the hash of its lower-case form, and above it that of its shape."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        text = word.decode("utf-8", "surrogatepass")
        if text.isalpha() and text.islower():
            shape = "a"
        else:
            shape = text
            for runs, sign in _RUNS:
                shape = runs.sub(sign, shape)
        found = xxhash.xxh32_intdigest(text.lower().encode("utf-8", "surrogatepass")) | xxhash.xxh32_intdigest(shape.encode("utf-8", "surrogatepass"), 7) << 32
        self[word] = found
        return found


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77)
    return (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE3D) >> np.uint32(32 - BITS)


def features(words: Words, text: str) -> np.ndarray:
    found = np.fromiter(map(words.__getitem__, text.encode("utf-8", "surrogatepass").split()), np.uint64)
    if not found.size:
        return np.zeros(0, np.uint32)
    s, h = found.astype(np.uint32), (found >> np.uint64(32)).astype(np.uint32)
    h[1:][s[1:] == s[:-1]] = 1
    pair = lambda a, k: (a[:-1] * np.uint32(0x9E3779B1)) ^ (a[1:] + np.uint32(k))
    return _mixed(np.concatenate([s, pair(s, 11), h, pair(h, 13)]))


def fit(batches: Iterator[tuple[list[str], list[int]]]) -> np.ndarray:
    """The weight of each hash value, and the bias at the end."""
    words, rows, ys = Words(), [], []
    for texts, labels in batches:
        for t in texts:
            at, n = np.unique(features(words, t), return_counts=True)
            rows.append((np.append(at, 1 << BITS).astype(np.int32), np.append(n * (SCALE / max(1, n.sum())), 1.0).astype(np.float32)))
        ys += labels
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(at: np.ndarray | slice) -> np.ndarray:
        a, b = z[at], n[at]
        return np.where(np.abs(a) <= L1, 0, -(a - np.sign(a) * L1) / ((BETA + np.sqrt(b)) / ALPHA + L2))

    for k in range(PASSES):
        for i in np.random.default_rng(k).permutation(len(rows)):
            at, x = rows[i]
            w = weights(at)
            g = (float(sigmoid(w.dot(x))) - ys[i]) * x
            g2 = g * g
            z[at] += g - (np.sqrt(n[at] + g2) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g2
    return weights(slice(None))


def model(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE, **names) -> np.ndarray:
    return trained(training_rows(docs, labels, label, most, **names), fit)


def scored(docs: DataFrame, weights: np.ndarray, text: str = "text", keep: tuple[str, ...] = ("doc_id",), out: str = "score") -> DataFrame:
    """The columns of ``keep`` and a score, from 0 to 1: how likely the whole text is of good quality.

    The result is called ``out``, a kept column of that name is replaced; any other keeps its name and values. A null text counts as empty; texts without words get the score of the bias alone, as all do if there were no
    labelled rows. Equal texts get equal scores.
    """
    sent = shipped(docs.sparkSession, weights)
    keep = tuple(c for c in keep if c != out)
    hidden = free_name((*keep, out), "_text")
    rows = docs.select(*(F.col(f"`{c}`") for c in keep), whole_text(f"`{text}`").alias(hidden))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name != hidden)

    def make():
        w, words = sent.value, Words()
        bias = float(w[-1])

        def step(cols):
            z = []
            for t in cols.pop(hidden):
                at = features(words, t)
                z.append(bias + (SCALE * float(w[at].mean()) if at.size else 0.0))
            return cols | {out: sigmoid(np.array(z))}

        return step

    return in_arrow(rows, f"{schema}`{out}` double", make)


def op5_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = model(docs, table(spark, sf_dir, "labels"))
    rows = scored(docs, weights)
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))

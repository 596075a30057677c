"""Substring dedup by a compacted De Bruijn graph of words.

Edges of the graph are the windows (k-mers) of ``window`` words, nodes the runs of one word less. Neighbouring
edges that share an anchor are kept as one path piece from the start (anchors.py). Joins on anchor and piece then
compact the graph: an anchor that has equal pieces only wherever it occurs lies on a nonbranching path, so each of
its pieces but the earliest is a repeated span as a whole. Where an anchor has unequal pieces the path branches
or ends; the earliest piece of each kind is opened into its edges, and a join on the edges finds those that an
earlier piece has as well.

Every repeated span carries the coordinates of its source, the earliest occurrence. Spans that go on in the same
source are joined to long ones, the words at the source's coordinates are fetched by a join, and each span is compared
with them word for word before it goes. Hashes of 128 bits only propose spans.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import CHUNK, Anchors
from .common import discarded, in_arrow, table, written
from .repeats import branching, classes, covered, long_spans, numbered, recurring, repeated, sourced, with_spans

#: Words in a window and in an anchor.
WINDOW, ANCHOR = 20, 5
#: Words that a task remembers at most.
REMEMBERED = 200_000


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def word_units():
    hashes = Hashes()
    return lambda text: np.fromiter(map(hashes.__getitem__, text.encode("utf-8", "surrogatepass").split()), np.uint64)


def words_at(window: int):
    """For repeats.sourced: the words of a run of windows, joined by a space."""

    def read(text: str):
        words = text.encode("utf-8", "surrogatepass").split()
        return lambda first, n: b" ".join(words[first : first + n + window - 1])

    return lambda: read


def edges_of(rows: DataFrame, opened: DataFrame, anchors: Anchors, units) -> DataFrame:
    """The windows of the opened pieces (m, row, id, first, n): m, hash, row, id, first."""
    kind = rows.schema["id"].dataType.simpleString()
    wanted = opened.groupBy("row").agg(F.collect_list(F.struct("m", "first", "n")).alias("open"))
    texts = rows.join(wanted, "row")

    def make():
        split = units()

        def step(cols):
            m, h, lens, first = [], [], [], []
            for text, pieces in zip(cols["text"], cols["open"], strict=True):
                u = split(text)
                pieces.sort(key=lambda p: p["first"])
                lo, of, edges = -CHUNK, None, 0
                for p in pieces:
                    a, b = p["first"], p["first"] + p["n"]
                    if b > lo + CHUNK:
                        lo = a
                        of = anchors.of_windows(u[lo : lo + CHUNK + anchors.window - 1])
                    h.append(of[a - lo : b - lo])
                    m.append(np.full(b - a, p["m"]))
                    first.append(np.arange(a, b, dtype=np.int32))
                    edges += b - a
                lens.append(edges)
            if not h:
                return None
            return {"m": np.concatenate(m), "h": np.concatenate(h).view(np.int64), "row": repeated(cols["row"], lens), "id": repeated(cols["id"], lens), "first": np.concatenate(first)}

        return step

    return in_arrow(texts, f"m long, h long, row long, id {kind}, first int", make)


def repeated_spans(rows: DataFrame, anchors: Anchors, units, name: str = "words") -> DataFrame:
    """row, first, n: runs of windows that also start earlier; src, src_first (row and window): where."""
    pieces = recurring(rows, anchors, units, name)
    sets = classes(pieces, name)
    later = pieces.join(sets.filter("many > 1").select("m", "s", "lead"), ["m", "s"])
    later = later.select("row", "first", "n", F.col("lead.row").alias("src"), F.col("lead.first").alias("src_first"))
    forks = branching(sets, name)
    opened = sets.join(forks, "m", "left_semi").select("m", "lead.row", "lead.first", "lead.n")
    edges = written(edges_of(rows, opened, anchors, units), f"{name}-edges", release=True)
    earliest = edges.groupBy("m", "h").agg(F.count("*").alias("many"), F.min(F.struct("id", "row", "first")).alias("source")).filter("many > 1")
    earliest = written(earliest.select("m", "h", F.col("source.row").alias("src"), F.col("source.first").alias("src_first")), f"{name}-earliest", release=True)
    more = edges.join(earliest, ["m", "h"]).select("row", "first", F.lit(1).alias("n"), "src", "src_first")
    found = later.unionByName(more).filter("row <> src OR first <> src_first")
    spans = long_spans(found, name)
    discarded(pieces, sets, forks, edges, earliest)
    return spans


def substring_dedup(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """Per document: ident, ``n_words``, ``n_removed``, ``kept_sha256``, ``kept_text`` (words joined by one space).

    A word goes if a window of ``window`` words that covers it also starts earlier: in a row with a smaller
    identifier, or earlier in the same row. Nulls are the smallest identifiers, and of rows that tie in it the one
    that comes first in the table is the earlier. A null text has no words; a text shorter than a window loses
    none. Of repeated rows all but one lose every word that a window covers. Other columns of docs, whatever their
    names, play no part.
    """
    rows, anchors = numbered(docs, text, ident), Anchors(anchor, window)
    found = with_spans(rows, sourced(rows, repeated_spans(rows, anchors, word_units), words_at(window), "words"))
    kind = rows.schema["id"].dataType.simpleString()

    def make():
        def step(cols):
            n, removed, digest, kept = [], [], [], []
            for t, spans in zip(cols["text"], cols["spans"], strict=True):
                left = words = t.encode("utf-8", "surrogatepass").split()
                if spans:
                    gone = covered(len(words), window, spans, lambda first, k: b" ".join(words[first : first + k + window - 1]))  # noqa: B023
                    left = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                joined = b" ".join(left)
                n.append(len(words))
                removed.append(len(words) - len(left))
                digest.append(hashlib.sha256(joined).hexdigest())
                kept.append(joined.decode("utf-8", "surrogatepass"))
            return {ident: cols["id"], "n_words": n, "n_removed": removed, "kept_sha256": digest, "kept_text": kept}

        return step

    return in_arrow(found, f"`{ident}` {kind}, n_words long, n_removed long, kept_sha256 string, kept_text string", make)


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup(docs).drop("kept_text")


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
t AS (SELECT doc_id, i, ws[i] AS word, CASE WHEN i + 19 <= len(ws) THEN array_to_string(ws[i : i + 19], ' ') END AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d)),
f AS (SELECT doc_id, i, word, win IS NOT NULL AND row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1 AS again FROM t),
c AS (SELECT doc_id, i, word, max(again::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) = 1 AS gone FROM f),
g AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id)
"""

"""Jaccard join on word n-grams with Bayesian candidate pruning.

1. Each text becomes the set of its shingles (five words each); texts with equal sets are one class, represented by
   its earliest row. Thousands of copies are one row from here on.
2. Representatives get MinHash values; bands of them are the keys of candidate buckets.
3. Pairs in buckets of up to ``SMALL`` rows are compared value by value: after each step of values a pair goes if
   the posterior probability that its similarity reaches the threshold is under TOLERANCE. The rest is verified on
   the shingle sets.
4. Larger buckets are not turned into pairs. Rows that share large buckets make a group, dealt into blocks by the
   least of their large buckets, so that candidates lie together. Two blocks that have rows in one large bucket are a
   cell; its rows are compared in the same way, all pairs in place, and give counts of links and edges that span what
   they connect. Blocks without a common bucket never meet, so work follows candidates; a cell has a bounded size,
   whatever the group's, and no link is left out. Pairs of small buckets that a cell has are left to it.
5. Components of the links are the classes of near duplicates.

Joins that carry texts, sets or signatures are sort-merge joins at every size, so that small inputs are planned as
large ones are.

At similarity 0.8 a pair shares no band with probability 6e-6 and is pruned with probability under 1e-6.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.operators.components import components

from .anchors import CHUNK, Anchors, mixed
from .common import importable, in_arrow, table, written
from .repeats import numbered
from .substring_dedup import word_units

SHINGLE, THRESHOLD = 5, 0.8
BANDS, IN_BAND = 40, 6
VALUES = BANDS * IN_BAND
#: MinHash values compared at a time, and the posterior under which a pair goes.
STEP, TOLERANCE = 24, 1e-7
#: Rows of a bucket that is turned into pairs, and rows of a block, at most about.
SMALL, BLOCK = 24, 256

_random = np.random.default_rng(20240229)
_A = _random.integers(1, 1 << 31, VALUES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _random.integers(0, 1 << 32, VALUES, dtype=np.uint32)


class Shingles:
    """The sorted distinct shingle hashes of a text. One of fewer words has one shingle, and none without words."""

    def __init__(self, size: int) -> None:
        self.units, self.anchors = word_units(), Anchors(1, size)

    def __call__(self, text: str) -> np.ndarray:
        u, size = self.units(text), self.anchors.window
        if u.size < size:
            return mixed(np.array([xxhash.xxh64_intdigest(u.tobytes(), 1)], np.uint64)) if u.size else u
        n = u.size - size + 1
        return np.unique(np.concatenate([self.anchors.of_windows(u[lo : lo + CHUNK + size - 1]) for lo in range(0, n, CHUNK)]))


def minhash(shingles: np.ndarray) -> bytes:
    """VALUES 16-bit values."""
    x = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    best = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    for lo in range(0, x.size, 2048):
        part = x[None, lo : lo + 2048] ^ _B[:, None]
        part *= _A[:, None]
        part ^= part >> np.uint32(15)
        part *= np.uint32(0x2C1B3C6D)
        np.minimum(best, part.min(axis=1), out=best)
    return ((best * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16).tobytes()


def least_agreements(threshold: float, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(values compared, fewest agreements that keep a pair). With a uniform prior the posterior after m of n
    agreements is Beta(m + 1, n - m + 1), whose upper tail is a sum of binomial terms."""
    out = []
    for n in range(STEP, VALUES + 1, STEP):
        tail, m = 0.0, -1
        while tail < tolerance:
            m += 1
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def survivors(a: np.ndarray, b: np.ndarray, table: list[tuple[int, int]]) -> np.ndarray:
    """Indices of the pairs (rows of a and b) that are never pruned."""
    at, seen, before = np.arange(len(a)), np.zeros(len(a), np.int32), 0
    for n, least in table:
        seen = seen + (a[at, before:n] == b[at, before:n]).sum(1, dtype=np.int32)
        keep = seen >= least
        at, seen, before = at[keep], seen[keep], n
    return at


def similar(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """Whether sorted sets reach the threshold, exactly."""
    if min(a.size, b.size) < threshold * max(a.size, b.size) - 1e-9:
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common >= threshold * (a.size + b.size - common) - 1e-9


def _block_links(rows: list[dict], table: list[tuple[int, int]], threshold: float) -> Iterator[tuple[int, int, int]]:
    """Of two blocks (sides 0 and 1) or one with itself: (row, documents that it links to, row it spans to)."""
    left = [x for x in rows if x["side"] == 0]
    right = [x for x in rows if x["side"] == 1]
    own = not right and rows[0]["same"]
    right = left if own else right
    if not left or not right:
        return
    sets_l, sets_r = ([np.frombuffer(x["shingles"], np.uint64) for x in side] for side in (left, right))
    sig_l, sig_r = (np.stack([np.frombuffer(x["sig"], np.uint16) for x in side]) for side in (left, right))
    words, at = np.unique(np.concatenate(sets_l + sets_r), return_inverse=True)
    n_l, n_r = np.array([s.size for s in sets_l]), np.array([s.size for s in sets_r])
    total = int(n_l.sum())
    common = np.zeros((len(left), len(right)), np.float32)
    which_l, which_r = np.repeat(np.arange(len(left)), n_l), np.repeat(np.arange(len(right)), n_r)
    for lo in range(0, words.size, 8192):  # shared shingles by columns of the incidence matrices
        m_l, m_r = np.zeros((len(left), 8192), np.float32), np.zeros((len(right), 8192), np.float32)
        k = (at[:total] >= lo) & (at[:total] < lo + 8192)
        m_l[which_l[k], at[:total][k] - lo] = 1
        k = (at[total:] >= lo) & (at[total:] < lo + 8192)
        m_r[which_r[k], at[total:][k] - lo] = 1
        common += m_l @ m_r.T
    alive = np.ones(common.shape, bool)
    if own:
        alive &= np.triu(alive, 1)
    i, j = np.nonzero(alive)
    ok = np.zeros(common.shape, bool)
    for lo in range(0, i.size, 65536):
        p, q = i[lo : lo + 65536], j[lo : lo + 65536]
        keep = survivors(sig_l[p], sig_r[q], table)
        p, q = p[keep], q[keep]
        c = common[p, q]
        good = c >= threshold * (n_l[p] + n_r[q] - c) - 1e-6
        ok[p[good], q[good]] = True
    if own:
        ok |= ok.T
    many_l, many_r = np.array([x["many"] for x in left]), np.array([x["many"] for x in right])
    for side, links, weights, others in ((left, ok, many_r, right),) if own else ((left, ok, many_r, right), (right, ok.T, many_l, left)):
        for x, linked in zip(side, links, strict=True):
            if linked.any():
                yield x["row"], int(weights[linked].sum()), others[int(linked.argmax())]["row"]
    if own and ok.any() or not own:
        # edges that connect what the links of this pair of blocks connect
        number = {x["row"]: k for k, x in enumerate(left + ([] if own else right))}
        root = list(range(len(number)))

        def find(k: int) -> int:
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        for p, q in zip(*(v.tolist() for v in np.nonzero(ok)), strict=True):
            a, b = find(number[left[p]["row"]]), find(number[right[q]["row"]])
            if a != b:
                root[max(a, b)] = min(a, b)
                yield left[p]["row"], 0, right[q]["row"]


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, text: str = "text", ident: str = "doc_id", small: int = SMALL, block: int = BLOCK, row: str | None = None) -> DataFrame:
    """Per row: ``row`` (its number, as repeats.numbered gives it; of column ``row`` if named), ident, ``class_id`` (smallest identifier of the
    texts that links connect with this one), ``n_links`` (other documents with similarity of at least
    ``threshold``), ``copies`` (documents with the same shingle set, itself included) and ``first`` (true for one
    row of each class, the one with the smallest identifier; ties go to the earlier row).

    Similarity is the Jaccard index of the sets of ``shingle``-word shingles; a shorter text is one shingle. Texts
    without words, null ones included, are classes of their own, one for each row, without links. Null identifiers
    count as smallest. Repeated rows are copies.
    """
    spark = docs.sparkSession
    importable(spark)
    rows = numbered(docs, text, ident, row)
    kind = rows.schema["id"].dataType.simpleString()

    def sign():
        shingles = Shingles(shingle)

        def step(cols):
            out = {"row": cols["row"], "id": cols["id"], "c1": [], "c2": [], "sig": []}
            for row, t in zip(cols["row"], cols["text"], strict=True):
                s = shingles(t)
                key = xxhash.xxh128_digest(s.tobytes() if s.size else b"row" + row.to_bytes(8, "little"))
                a, b = np.frombuffer(key, np.int64).tolist()
                out["c1"].append(a)
                out["c2"].append(b)
                out["sig"].append(minhash(s) if s.size else None)
            return out

        return step

    signed = written(in_arrow(rows, f"row long, id {kind}, c1 long, c2 long, sig binary", sign), "signed")
    classes = signed.groupBy("c1", "c2").agg(F.min(F.struct("id", "row")).alias("lead"), F.count("*").alias("many"))
    classes = written(classes.select("c1", "c2", F.col("lead.row").alias("row"), F.col("lead.id").alias("lead_id"), "many"), "classes")
    leads = signed.select("row", "sig").join(classes.select("row").hint("merge"), "row", "left_semi").filter("sig IS NOT NULL")

    size = IN_BAND * 2
    band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substr("sig", b * size + 1, F.lit(size)))))
    keys = leads.select("row", band.alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("row").alias("least")).filter("n > 1")
    shared = written(shared, "shared")
    buckets = written(keys.join(shared, "key"), "buckets", release=True)

    # large buckets: groups
    stars = buckets.filter(F.col("n") > small).filter("row <> least").select(F.col("row").alias("u"), F.col("least").alias("v"))
    groups = components(stars)
    sizes = groups.groupBy("root").agg(F.count("*").alias("size"))
    large = buckets.filter(F.col("n") > small).select("key", "row")
    home = large.groupBy("row").agg(F.min("key").alias("home"))
    groups = groups.join(sizes, "root").select(F.col("node").alias("row"), F.col("root").alias("grp"), F.ceil(F.col("size") / block).alias("blocks"))
    groups = written(groups.join(home, "row").select("row", F.xxhash64("grp", F.pmod(F.xxhash64("home"), "blocks")).alias("part")), "groups", release=True)
    # buckets that many rows have for their least make parts that are too large for a block
    parts = written(groups.groupBy("part").agg(F.ceil(F.count("*") / block).alias("slices")), "parts")
    placed = written(groups.join(parts, "part").select("row", F.xxhash64("part", F.pmod(F.xxhash64("row"), "slices")).alias("blk")), "placed")
    spread_over = written(large.join(placed, "row").select("key", "blk").distinct(), "spread", release=True)
    meets = spread_over.select("key", F.col("blk").alias("a")).join(spread_over.select("key", F.col("blk").alias("b")), "key").filter("a <= b")
    cells = written(meets.select("a", "b").distinct(), "cells", release=True)

    # small buckets: pairs
    lists = buckets.filter(F.col("n") <= small).groupBy("key").agg(F.sort_array(F.collect_list("row")).alias("rows")).select("rows").distinct()
    pairs = lists.select(F.explode(F.expr("flatten(transform(rows, (x, i) -> transform(slice(rows, i + 2, size(rows)), y -> struct(x as a, y as b))))")).alias("p")).select("p.*").distinct()
    for side in "ab":
        pairs = pairs.join(placed.select(F.col("row").alias(side), F.col("blk").alias(f"_{side}")), side, "left")
    known = cells.select(F.col("a").alias("_lo"), F.col("b").alias("_hi"))
    pairs = pairs.withColumns({"_lo": F.least("_a", "_b"), "_hi": F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), F.greatest("_a", "_b"))})
    pairs = pairs.join(known, ["_lo", "_hi"], "left_anti").select("a", "b")
    enough = least_agreements(threshold)
    sigs = leads.select("row", "sig")
    pairs = pairs.hint("merge").join(sigs.select(F.col("row").alias("a"), F.col("sig").alias("sa")), "a").hint("merge").join(sigs.select(F.col("row").alias("b"), F.col("sig").alias("sb")), "b")

    def prune():
        def step(cols):
            sa, sb = (np.frombuffer(b"".join(cols[k]), np.uint16).reshape(-1, VALUES) for k in ("sa", "sb"))
            keep = survivors(sa, sb, enough)
            return {k: np.array(cols[k], np.int64)[keep] for k in ("a", "b")}

        return step

    likely = written(in_arrow(pairs, "a long, b long", prune), "likely", release=True)
    needed = likely.select(F.col("a").alias("row")).unionByName(likely.select(F.col("b").alias("row"))).unionByName(placed.select("row")).distinct()

    def spread():
        shingles = Shingles(shingle)

        def step(cols):
            found = [shingles(t) for t in cols["text"]]
            return {"row": cols["row"], "shingles": [s.tobytes() for s in found], "sig": [minhash(s) for s in found]}

        return step

    sets = in_arrow(rows.select("row", "text").join(needed.hint("merge"), "row", "left_semi"), "row long, shingles binary, sig binary", spread)
    many = classes.select("row", "many")
    sets = written(sets.hint("merge").join(many, "row"), "sets", release=True)

    def verify():
        def step(cols):
            sets_of = lambda k: (np.frombuffer(x, np.uint64) for x in cols[k])
            keep = [i for i, (x, y) in enumerate(zip(sets_of("xa"), sets_of("xb"), strict=True)) if similar(x, y, threshold)]
            return {k: [cols[k][i] for i in keep] for k in ("a", "b", "ma", "mb")}

        return step

    left, right = (sets.select(F.col("row").alias(k), F.col("shingles").alias(f"x{k}"), F.col("many").alias(f"m{k}")) for k in "ab")
    links = written(in_arrow(likely.hint("merge").join(left, "a").hint("merge").join(right, "b"), "a long, b long, ma long, mb long", verify), "links", release=True)

    # blocks of groups, two at a time
    in_cell = lambda side, rest: cells.filter(rest).select(F.col(side).alias("blk"), F.xxhash64("a", "b").alias("cell"), F.lit(int(side == "b")).alias("side"), (F.col("a") == F.col("b")).alias("same"))
    members = placed.join(in_cell("a", "true").unionByName(in_cell("b", "a <> b")), "blk").select("row", "cell", "side", "same")
    dealt = members.hint("merge").join(sets, "row").repartition("cell").sortWithinPartitions("cell")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(cell: list[dict]) -> pa.RecordBatch:
            found = list(_block_links(cell, enough, threshold))
            cols = list(zip(*found, strict=True)) if found else [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["row", "n", "to"])

        cell: list[dict] = []
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                for x in batch.slice(lo, 500).to_pylist():
                    if cell and x["cell"] != cell[-1]["cell"]:
                        yield done(cell)
                        cell = []
                    cell.append(x)
        if cell:
            yield done(cell)

    dense = written(dealt.mapInArrow(blocks, "row long, n long, to long"), "dense", release=True)

    edges = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(dense.select(F.col("row").alias("u"), F.col("to").alias("v")))
    roots = components(edges)
    counts = links.select(F.col("a").alias("row"), F.col("mb").alias("n")).unionByName(links.select(F.col("b").alias("row"), F.col("ma").alias("n"))).unionByName(dense.select("row", "n"))
    counts = counts.groupBy("row").agg(F.sum("n").alias("n"))

    found = classes.join(counts, "row", "left").join(roots.select(F.col("node").alias("row"), "root"), "row", "left")
    found = found.select("c1", "c2", F.col("row").alias("lead_row"), "lead_id", "many", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("root", "row").alias("root"))
    firsts = found.groupBy("root").agg(F.min(F.struct("lead_id", "lead_row")).alias("least"))
    found = found.join(firsts, "root").select("c1", "c2", "many", "n", "least")
    out = signed.select("row", "id", "c1", "c2").join(found, ["c1", "c2"])
    return out.select(
        "row",
        F.col("id").alias(ident),
        F.col("least.lead_id").alias("class_id"),
        (F.col("n") + F.col("many") - 1).alias("n_links"),
        F.col("many").alias("copies"),
        (F.col("row") == F.col("least.lead_row")).alias("first"),
    )


def op8_jaccard_join(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_join(docs).drop("row")


OP8_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS shingle FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, least(len(ws), 1) + 1))) AS i FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT p.a, p.b, p.c = x.n AND p.c = y.n AS same FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE p.c >= 0.8 * (x.n + y.n - p.c) - 1e-9),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id),
k AS (SELECT doc_id, min(root) AS class_id FROM r GROUP BY doc_id),
m AS (SELECT a AS doc_id, count(*) AS n_links, count(*) FILTER (same) AS copies FROM l GROUP BY a)
SELECT k.doc_id, k.class_id, coalesce(m.n_links, 0) AS n_links, 1 + coalesce(m.copies, 0) AS copies, k.doc_id = k.class_id AS first FROM k LEFT JOIN m USING (doc_id)
"""

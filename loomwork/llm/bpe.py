"""Byte-level BPE: encoding with a hierarchical-bitmap rank queue, and decoding.

A pre-token's bytes are a doubly linked list of parts. For each neighbouring pair whose joined bytes are a token,
the left part's position goes to the bucket of that token's rank. A bitmap of three levels of 64-bit words says
which buckets hold something, so finding the lowest rank takes three find-first-set steps whatever the pre-token's
length. The bucket's positions are merged from the left; those whose pair has changed meanwhile are stale and
skipped. A pre-token of n bytes takes O(n) queue operations, so a single pre-token of megabytes is no problem.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, in_arrow, shipped, table, whole_text

#: Pre-tokens that a worker remembers at most, and the longest of them in characters.
REMEMBERED, LONGEST = 240_000, 64
#: Characters split at a time, and ids decoded at a time. What a block needs comes on top of what is remembered.
BLOCK = 250_000


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file with a token in base64 and its rank in each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class RankQueue:
    """Positions by rank. push() adds one; take() removes the bucket of the lowest rank there is."""

    def __init__(self, ranks: int) -> None:
        words = -(-ranks // 64)
        self.low, self.mid, self.top = [0] * words, [0] * -(-words // 64), 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, at: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(at)
            return
        self.buckets[rank] = [at]
        a, b = rank >> 6, rank >> 12
        self.low[a] |= 1 << (rank & 63)
        self.mid[b] |= 1 << (a & 63)
        self.top |= 1 << b

    def take(self) -> tuple[int, list[int]]:
        """The lowest rank, and its positions from left to right."""
        top, mid, low = self.top, self.mid, self.low
        b = (top & -top).bit_length() - 1
        m = mid[b]
        a = b << 6 | (m & -m).bit_length() - 1
        w = low[a]
        rank = a << 6 | (w & -w).bit_length() - 1
        low[a] = w = w & (w - 1)
        if not w:
            mid[b] = m = m & (m - 1)
            if not m:
                self.top = top & (top - 1)
        bucket = self.buckets.pop(rank)
        bucket.sort()
        return rank, bucket


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.queue = RankQueue(max(ranks.values()) + 1)
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        # the ids of pre-tokens met lately, and of those met before; what is met again moves to the first
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each pre-token. All share one list and one queue, so a bucket is found once for the many
        pre-tokens that have the pair; no pair spans two of them.

        No merge of a bucket adds to that bucket: the pairs it makes are longer than the bucket's token. It may
        add to a lower one, which then goes first; what is left of the bucket waits.
        """
        ranks, queue = self.ranks, self.queue
        push, take, rank_of, data = queue.push, queue.take, ranks.get, b"".join(pieces)
        n = len(data)
        ends = list(range(1, n + 1))  # of the part that begins at a position; it is the next part's position
        before = list(range(-1, n))
        limit: list[int] = []  # end of the pre-token
        pair = [rank_of(data[i : i + 2]) for i in range(n)]  # rank of the pair that begins at a position
        for piece in pieces:
            if piece:
                before[len(limit)] = -1
                limit += [len(limit) + len(piece)] * len(piece)
                pair[len(limit) - 1] = None  # no pair, or the part is gone
        for i, r in enumerate(pair):
            if r is not None:
                push(r, i)
        while queue.top:
            rank, bucket = take()
            for at, i in enumerate(bucket):
                if pair[i] != rank:
                    continue
                j = ends[i]
                end = ends[i] = ends[j]
                pair[j], lower = None, False
                if end < limit[i]:
                    before[end] = i
                    pair[i] = r = rank_of(data[i : ends[end]])
                    if r is not None:
                        push(r, i)
                        lower = r < rank
                else:
                    pair[i] = None
                k = before[i]
                if k >= 0:
                    pair[k] = r = rank_of(data[k:end])
                    if r is not None:
                        push(r, k)
                        lower = lower or r < rank
                if lower:
                    for k in bucket[at + 1 :]:
                        push(rank, k)
                    break
        out, i = [], 0
        for piece in pieces:
            whole, stop = rank_of(piece), i + len(piece)
            if whole is not None:
                out.append([whole])
                i = stop
                continue
            ids = []
            while i < stop:
                ids.append(ranks[data[i : ends[i]]])
                i = ends[i]
            out.append(ids)
        return out

    def _ids(self, texts: list[list[str]]) -> list[bytes]:
        """Of each list of pre-tokens, the ids."""
        if len(self.known) >= REMEMBERED // 2:
            self.known, self.older = {}, self.known
        known, older, fresh = self.known, self.older, []
        for p in {p for pieces in texts for p in pieces if p not in known}:
            if p in older:
                known[p] = older[p]
            else:
                fresh.append(p)
        packed = [np.array(ids, "<u4").tobytes() for ids in self.merge([p.encode("utf-8", "surrogatepass") for p in fresh])]
        known.update(zip(fresh, packed, strict=True))
        out = [b"".join(map(known.__getitem__, pieces)) for pieces in texts]
        for p in fresh:
            if len(p) > LONGEST:
                del known[p]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers. About BLOCK characters at a time are
        split; a text longer than that is split in parts, and a pre-token is always whole."""
        out, waiting, size = [], [], 0
        for text in texts:
            if len(text) > BLOCK:
                out += self._ids(waiting)
                found = (m.group() for m in self.pattern.finditer(text))
                parts = []
                while block := list(islice(found, BLOCK // 4)):
                    parts += self._ids([block])
                out.append(b"".join(parts))
                waiting, size = [], 0
                continue
            waiting.append(self.pattern.findall(text))
            size += len(text)
            if size > BLOCK:
                out += self._ids(waiting)
                waiting, size = [], 0
        return out + self._ids(waiting)

    def decode(self, ids: bytes) -> Iterator[bytes]:
        """The bytes that ids stand for, in parts."""
        at = np.frombuffer(ids, "<u4")
        for lo in range(0, at.size, BLOCK):
            yield b"".join(map(self.tokens.__getitem__, at[lo : lo + BLOCK].tolist()))


#: One encoder for the tasks that a worker runs one after the other, by the identifier of what the driver sent.
_ENCODERS: dict[str, Encoder] = {}


def _encoder(sent) -> Encoder:
    key, ranks, pattern = sent.value
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(ranks, pattern)
    return _ENCODERS[key]


def _sent(df: DataFrame, path: str, pattern: str):
    ranks = read_ranks(path)
    key = hashlib.sha256(repr((sorted(ranks.items()), pattern)).encode()).hexdigest()
    return shipped(df.sparkSession, (key, ranks, pattern))


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "tokens") -> DataFrame:
    """docs with ``out``, the ids of the whole text as an array of ints; a null or empty text has none. A column
    of that name is replaced. Any other column, null or not, passes as it is."""
    sent = _sent(docs, path, pattern)
    # the text goes through the workers once; apart from its column only if that one is replaced
    name = next(c for c in docs.columns if c.lower() == text.lower())
    if out.lower() == name.lower():
        name = free_name((*docs.columns, out), "_text")
        docs = docs.withColumn(name, F.col(f"`{text}`"))
    docs = docs.drop(out)

    def make():
        coder = _encoder(sent)

        def step(cols):
            return cols | {out: [np.frombuffer(ids, "<u4").astype(np.int32) for ids in coder.encode([t or "" for t in cols[name]])]}

        return step

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name != name or out.lower() != text.lower())
    return in_arrow(docs, f"{schema}`{out}` array<int>", make)


def digests(docs: DataFrame, path: str, pattern: str, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """Per document: ident, ``n_tokens``, ``ids_sha256`` and, of the decoded ids, ``decoded_sha256``. A null text
    counts as empty; repeated rows and null identifiers are rows like others."""
    sent = _sent(docs, path, pattern)
    rows = docs.select(F.col(f"`{ident}`"), whole_text(f"`{text}`").alias(hidden := free_name([ident], "_text")))

    def make():
        coder = _encoder(sent)

        def step(cols):
            n, of_ids, of_bytes = [], [], []
            for ids in coder.encode(cols[hidden]):
                back = hashlib.sha256()
                for part in coder.decode(ids):
                    back.update(part)
                n.append(len(ids) // 4)
                of_ids.append(hashlib.sha256(ids).hexdigest())
                of_bytes.append(back.hexdigest())
            return {ident: cols[ident], "n_tokens": n, "ids_sha256": of_ids, "decoded_sha256": of_bytes}

        return step

    kind = rows.schema[0].dataType.simpleString()
    return in_arrow(rows, f"`{ident}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", make)


def op7_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)

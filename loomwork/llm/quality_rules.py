"""Quality rules with line labels from a linear-chain conditional random field.

Counts over the whole text decide a base rule; a text that passes it is labelled line by line. Each line has a set
of yes-or-no features (length, ending, capitals, symbols, repetition, ...); the field scores the features of a line
and the step from one line's label to the next, and Viterbi decoding finds the best labelling. A text is kept if
enough of its words are in lines labelled as content.

Training has labels of documents only. All lines of a good document count as content. A first field without steps
is fitted as if all lines of a bad document were boilerplate; then each bad document's lines are labelled anew by
it, the most suspicious line always as boilerplate, and the field is fitted with steps. The sample of labelled
rows is bounded, and the model has about fifty numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, in_arrow, shipped, table, whole_text
from .labelled import minimise, trained, training_rows

#: Training rows at most.
SAMPLE = 3000
PENALTY = 1e-4
#: Share of the words that must be in content lines.
CONTENT = 0.5
#: Base rule: fewest words, and most words in repeated windows, in hundredths.
FEWEST, REPEATED = 50, 50

SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\x0c\r"
_SYMBOL = regex.compile(r"[#*$%&|<>]")
_UPPER = regex.compile(r"\p{Lu}")
_DIGIT = regex.compile(r"\p{Nd}")
_LINK = regex.compile(r"https?://|www\.|\S@\S")
#: Features of a line; each is a bit.
N_FEATURES = 19


def line_features(line: str, again: bool) -> int:
    """The features of a line, as bits. again: the text has had the line before."""
    words = line.encode("utf-8", "surrogatepass").split()
    n = len(words)
    if not n:
        return 3
    chars, marks, caps, digits = len(line), len(_SYMBOL.findall(line)), len(_UPPER.findall(line)), len(_DIGIT.findall(line))
    same, distinct = sum(map(bytes.__eq__, words, words[1:])), len(set(words))
    end = line.rstrip()[-1:]
    checks = (
        n < 4, n >= 12, end in ".!?:;\"'”»…" if end else False, line.lstrip()[:1].isupper(),
        2 * caps > chars, 5 * caps > chars, marks > 0, 10 * marks > n, 2 * marks > n,
        line.count("|") >= 2, line.count("!!") >= 2, again, 5 * same > n, 2 * distinct < n and n >= 6,
        5 * digits > chars, bool(_LINK.search(line)), chars > 14 * n,
    )
    bits = 1
    for k, yes in enumerate(checks):
        if yes:
            bits |= 4 << k
    return bits


def lines_of(text: str) -> tuple[list[int], list[int], int]:
    """Of each line the features and the number of words; and how many lines with a word equal an earlier one."""
    seen: set[str] = set()
    bits, sizes, again = [], [], 0
    for line in text.split("\n"):
        size = len(line.encode("utf-8", "surrogatepass").split())
        dup = size > 0 and line in seen
        again += dup
        seen.add(line)
        bits.append(line_features(line, dup))
        sizes.append(size)
    return bits, sizes, again


def repeat_words(text: str) -> tuple[int, int]:
    """The number of words, and how many are in windows of three words that the text has twice or more."""
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in text.encode("utf-8", "surrogatepass").split()], np.int64)
    n = ids.size
    if n < 4:
        return n, 0
    pairs = ids[:-1] * len(number) + ids[1:]
    if len(number) > 1 << 20:
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, at, counts = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    twice = counts[at] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : k + n - 2] |= twice
    return n, int(covered.sum())


def _dense(bits: np.ndarray) -> np.ndarray:
    return (bits[:, None] >> np.arange(N_FEATURES) & 1).astype(float)


class Chain:
    """Value and gradient of the field's log likelihood over documents of different lengths: at each line number,
    all documents that have it are handled at once."""

    def __init__(self, docs: list[np.ndarray], steps: bool) -> None:
        order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
        lens = np.array([len(docs[i]) for i in order])
        first = np.append(0, np.cumsum([len(d) for d in docs]))[order]
        self.x, self.steps, self.docs = _dense(np.concatenate(docs)), steps, len(docs)
        self.rows = [first[: int((lens > t).sum())] + t for t in range(int(lens[0]))]

    def __call__(self, w: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
        n = N_FEATURES
        e = np.zeros((len(self.x), 2))
        e[:, 1] = self.x @ w[:n]
        step = w[n:].reshape(2, 2) if self.steps else np.zeros((2, 2))
        forward, back = np.empty_like(e), np.zeros_like(e)
        for t, at in enumerate(self.rows):
            forward[at] = e[at] + (np.logaddexp.reduce(forward[at - 1][:, :, None] + step, axis=1) if t else 0)
        for t in range(len(self.rows) - 2, -1, -1):
            nxt = self.rows[t + 1]
            back[nxt - 1] = np.logaddexp.reduce(step + (e[nxt] + back[nxt])[:, None, :], axis=2)
        z = np.logaddexp.reduce(forward + back, axis=1)
        own = np.exp(forward[:, 1] + back[:, 1] - z)
        value = -z[self.rows[0]].sum() + e[np.arange(len(y)), y].sum()
        g = np.append(self.x.T @ (y - own), np.zeros(4))
        if self.steps:
            for nxt in self.rows[1:]:
                prev = nxt - 1
                both = np.exp(forward[prev][:, :, None] + step + (e[nxt] + back[nxt])[:, None, :] - z[nxt][:, None, None]).sum(0)
                seen = np.bincount(y[prev] * 2 + y[nxt], minlength=4).reshape(2, 2)
                g[n:] += (seen - both).ravel()
                value += (seen * step).sum()
        return -value / self.docs + PENALTY / 2 * w.dot(w), -g / self.docs + PENALTY * w


def fit(batches: Iterator[tuple[list[str], list[int]]]) -> np.ndarray:
    """Weights of the features for content, then of the steps from label to label (0: boilerplate, 1: content)."""
    docs, good = [], []
    for texts, labels in batches:
        for text, label in zip(texts, labels, strict=True):
            docs.append(np.array(lines_of(text)[0]))
            good.append(label)
    w = np.zeros(N_FEATURES + 4)
    if not docs or min(good) == max(good):
        w[0] = -1.0 if docs and not good[0] else 1.0
        return w
    lens = [len(d) for d in docs]
    y = np.repeat(np.array(good), lens)
    chain = Chain(docs, False)
    w = minimise(lambda v: chain(v, y), w, 40)
    scores, starts = chain.x @ w[:N_FEATURES], np.append(0, np.cumsum(lens))
    for i, ok in enumerate(good):
        if not ok:
            s = scores[starts[i] : starts[i + 1]]
            y[starts[i] : starts[i + 1]] = s > 0
            y[starts[i] + int(s.argmin())] = 0
    chain = Chain(docs, True)
    return minimise(lambda v: chain(v, y), np.append(w[:N_FEATURES], np.zeros(4)), 60)


class Labeller:
    """Viterbi decoding."""

    def __init__(self, w: np.ndarray) -> None:
        self.w = np.asarray(w, float)
        self.score: dict[int, float] = {}
        (self.bb, self.bc), (self.cb, self.cc) = self.w[N_FEATURES:].reshape(2, 2).tolist()

    def __call__(self, bits: list[int]) -> list[int]:
        """1 for each content line, 0 for each boilerplate line; ties go to content."""
        b = c = 0.0
        from_b, from_c = [], []  # whether the best way to a label comes from content
        for k, x in enumerate(bits):
            s = self.score.get(x)
            if s is None:
                s = self.score[x] = float(sum(self.w[i] for i in range(N_FEATURES) if x >> i & 1))
            if not k:
                b, c = 0.0, s
                continue
            bb, cb, bc, cc = b + self.bb, c + self.cb, b + self.bc, c + self.cc
            from_b.append(cb >= bb)
            from_c.append(cc >= bc)
            b, c = max(bb, cb), max(bc, cc) + s
        label = int(c >= b)
        out = [label]
        for to_b, to_c in zip(reversed(from_b), reversed(from_c), strict=True):
            label = int(to_c if label else to_b)
            out.append(label)
        return out[::-1][: len(bits)]


def judge(text: str, label: Labeller) -> tuple[int, int, int, int, int, bool, bool, float]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_share."""
    n, repeated = repeat_words(text)
    bits, sizes, again = lines_of(text)
    content = sum(s for s, is_content in zip(sizes, label(bits), strict=True) if is_content)
    failed = n < FEWEST or 100 * repeated > REPEATED * n
    share = content / n if n else 0.0
    chars = len(text) - sum(map(text.count, _SPACES))
    return n, chars, sum(map(text.count, SYMBOLS)), again, repeated, failed, not failed and share >= CONTENT, share


def model(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE, **names) -> np.ndarray:
    return trained(training_rows(docs, labels, label, most, **names), fit)


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share")


def judged(docs: DataFrame, weights: np.ndarray, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of ``keep`` and those of COLUMNS, for every row.

    Kept columns of those names are replaced. A null text has no words, so the base rule fails it, as it does an empty one. Without labelled rows of both
    kinds all lines count as content. Equal texts, repeated rows included, get the same verdict.
    """
    sent = shipped(docs.sparkSession, weights)
    keep = tuple(c for c in keep if c not in COLUMNS)
    hidden = free_name((*keep, *COLUMNS), "_text")
    rows = docs.select(*(F.col(f"`{c}`") for c in keep), whole_text(f"`{text}`").alias(hidden))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name != hidden)

    def make():
        label = Labeller(sent.value)

        def step(cols):
            found = [judge(t, label) for t in cols.pop(hidden)]
            return cols | dict(zip(COLUMNS, zip(*found, strict=True), strict=True)) if found else None

        return step

    return in_arrow(rows, f"{schema}n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double", make)


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judged(docs, model(docs, table(spark, sf_dir, "labels")))

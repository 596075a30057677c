"""Licence scan: sparse TF-IDF cosine to templates, then inheritance from the nearest directory.

Stretches of a text are vectors of their template terms, weighted by term frequency and by inverse document frequency,
and compared with each template by cosine; a stretch's other words count towards its length as one term each, at the
largest weight. Stretches are the lines, the sentences in them, the blocks between blank lines (a file's header is its
first), the whole text, and for each template every window of as many words, over line ends. A text's licence is that
of its best stretch. Document frequencies of the template terms come from all texts. Templates are the bodies of
licences (licence_texts), their titles, short statements and SPDX identifiers. A template of few terms needs all of
them, a body a stretch of at least half its words; wording that licences share decides only where nothing else does.

What cannot reach the cosine is not compared, and this loses nothing: the cosine is at most the square root of the
template's share, in squared weight, of the terms that a stretch has, and at most the cosine that it would have if all
its words were distinct.

Files without a statement inherit: a licence file speaks for its directory and all below it. Each file joins the
licence files on each of its ancestor directories, one equi-join on the path, and takes the deepest.
"""

from __future__ import annotations

import math
import pkgutil

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import apart, free_name, in_arrow, table, whole_text, written

#: Cosine that a line, sentence, block or text needs, and a window; a template of so few terms needs all of them.
LEAST, WITHIN, SHORT = 0.6, 0.8, 3

# Usual short statements of licences.
STATEMENTS = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved."),
)

# Titles, which count as lines, sentences or blocks but not inside a sentence if they are short.
TITLES = (
    ("MIT", "MIT License"),
    ("MIT", "The MIT License (MIT)"),
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU Lesser General Public License Version 2.1, February 1999"),
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("ISC", "ISC License"),
    ("CC0-1.0", "CC0 1.0 Universal"),
    ("Unlicense", "The Unlicense"),
)

_BODIES = ("Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense")
_GNU = ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0")
_PLAIN = ("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "ISC", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "Unlicense")
_IDENTIFIERS = tuple((x, x) for x in _PLAIN) + tuple((x, x + end) for x in _GNU for end in ("", "+", "-only", "-or-later"))
SPDX = tuple((x, f"SPDX-License-Identifier: {y}") for x, y in _IDENTIFIERS)
BODIES = tuple((x, pkgutil.get_data(__package__, f"licence_texts/{x}.txt").decode()) for x in _BODIES)
TEMPLATES = STATEMENTS + TITLES + SPDX + tuple((x, f"License: {y}") for x, y in _IDENTIFIERS) + BODIES
#: Wording of several licences.
SHARED = ("Redistribution and use", "Permission to use", "All rights reserved")

_EDGES = "\"'.,;:()[]{}!?*/#<>-"


def terms(line: str) -> list[str]:
    return [w for w in (x.strip(_EDGES) for x in line.lower().split()) if w]


VOCABULARY = sorted({t for _, text in TEMPLATES for t in terms(text)})


def document_counts(docs: DataFrame, text: str = "text") -> tuple[dict[str, int], int]:
    """In how many texts each template term is, and how many texts there are: sums of a fixed number of columns."""

    def make():
        known = set(VOCABULARY)

        def step(cols):
            found: dict[str, int] = dict.fromkeys(VOCABULARY, 0)
            for t in cols["_text"]:
                for w in known & {x.strip(_EDGES) for x in t.lower().split()}:
                    found[w] += 1
            return {"term": ["", *found], "n": [len(cols["_text"]), *found.values()]}

        return step

    counts = in_arrow(docs.select(whole_text(f"`{text}`").alias("_text")), "term string, n long", make).groupBy("term").agg(F.sum("n").alias("n")).collect()
    counts = {r["term"]: r["n"] for r in counts}
    return counts, counts.pop("", 0)


class Scanner:
    def __init__(self, counts: dict[str, int], total: int) -> None:
        self.number = {t: i for i, t in enumerate(VOCABULARY)}
        self.known = set(VOCABULARY)
        self.others = len(VOCABULARY)
        idf = np.array([math.log((1 + total) / (1 + counts.get(t, 0))) + 1 for t in VOCABULARY] + [math.log(1 + total) + 1])
        self.square = idf * idf
        vectors = np.zeros((len(TEMPLATES), idf.size))
        self.lengths, self.least_words, self.all_of, self.slides, self.own = [], [], [], [], []
        for k, (_, text) in enumerate(TEMPLATES):
            ids = [self.number[t] for t in terms(text)]
            np.add.at(vectors[k], ids, idf[ids])
            self.lengths.append(len(ids))
            self.all_of.append(np.unique(ids) if len(set(ids)) <= SHORT else None)
            self.slides.append(self.all_of[k] is None or text.startswith(("SPDX", *SHARED)))
            self.least_words.append(len(ids) // 2 if k >= len(TEMPLATES) - len(BODIES) else 1)
            self.own.append(not any(text.startswith(x) and (_, text) in STATEMENTS for x in SHARED))
        vectors /= np.sqrt((vectors * vectors).sum(1, keepdims=True))
        self.parts = vectors * idf  # what a word adds to the dot product
        self.shares = np.ascontiguousarray((vectors * vectors)[:, :-1].T)
        self.needed = np.array([LEAST * LEAST if x is None else 1.0 for x in self.all_of]) - 1e-9

    def _stretches(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Term numbers of the words, their lines, and where lines, sentences, blocks and the text begin and end."""
        ids, lines, cuts, block = [], [], set(), 0
        for number, line in enumerate(text.split("\n")):
            start = sentence = len(ids)
            for raw in line.split():
                if w := raw.strip(_EDGES):
                    ids.append(self.number.get(w, self.others))
                    lines.append(number)
                if raw[-1] in ".;!?":
                    cuts.add((sentence, len(ids)))
                    sentence = len(ids)
            cuts |= {(sentence, len(ids)), (start, len(ids))}
            if start == len(ids):
                cuts.add((block, start))
                block = start
        cuts |= {(block, len(ids)), (0, len(ids))}
        a, b = np.array(sorted(x for x in cuts if x[0] < x[1]), np.int64).reshape(-1, 2).T
        return np.array(ids, np.int64), np.array(lines, np.int64), a, b

    def _sizes(self, ids: np.ndarray, length: int) -> np.ndarray:
        """Squared length of the vector of each window."""
        square, others, words = self.square.tolist(), self.others, ids.tolist()
        seen: dict[int, int] = {}
        out, size = [], 0.0
        for i, w in enumerate(words):
            n = 0 if w == others else seen.get(w, 0)
            seen[w] = n + 1
            size += square[w] * (2 * n + 1)
            if i >= length - 1:
                out.append(size)
                w = words[i - length + 1]
                n = 1 if w == others else seen[w]
                seen[w] -= 1
                size -= square[w] * (2 * n - 1)
        return np.array(out)

    def best(self, text: str) -> tuple[str | None, float, int]:
        """Licence, cosine and line number of the best stretch; ties go to the first line and template."""
        text = text.lower()
        present = [self.number[t] for t in self.known & {x.strip(_EDGES) for x in text.split()}]
        likely = np.flatnonzero(self.shares[present].sum(0) >= self.needed) if present else present
        if not len(likely):
            return None, 0.0, -1
        ids, lines, a, b = self._stretches(text)
        bound = np.append(0.0, np.cumsum(self.square[ids]))
        top = None
        for k in likely.tolist():
            dots = np.append(0.0, np.cumsum(self.parts[k][ids]))
            found = []
            dot = dots[b] - dots[a]
            for i in np.flatnonzero((b - a >= self.least_words[k]) & (dot > 1e-9) & (dot >= (LEAST - 1e-6) * np.sqrt(bound[b] - bound[a]))).tolist():
                seen, n = np.unique(ids[a[i] : b[i]], return_counts=True)
                n = np.where(seen == self.others, n, n * n)
                found.append((dot[i] / math.sqrt(float((n * self.square[seen]).sum())), int(a[i]), int(b[i]), LEAST))
            length = self.lengths[k]
            if self.slides[k] and ids.size > length:
                dot = dots[length:] - dots[:-length]
                at = np.flatnonzero((dot > 1e-9) & (dot >= (WITHIN - 1e-6) * np.sqrt(bound[length:] - bound[:-length])))
                # windows that lie near each other together
                for run in np.split(at, np.flatnonzero(np.diff(at) > length) + 1) if at.size else ():
                    lo = int(run[0])
                    cosines = dot[run] / np.sqrt(self._sizes(ids[lo : run[-1] + length], length)[run - lo])
                    found += [(x, i, i + length, WITHIN) for x, i in zip(cosines.tolist(), run.tolist(), strict=True)]
            for cosine, lo, hi, least in found:
                if (cosine := round(float(cosine), 9)) < least or self.all_of[k] is not None and not np.isin(self.all_of[k], ids[lo:hi]).all():
                    continue
                order = (not self.own[k], -cosine, int(lines[lo]), k)
                top = order if top is None else min(top, order)
        return (TEMPLATES[top[3]][0], -top[1], top[2]) if top else (None, 0.0, -1)


def statements(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of ``keep``, ``licence`` (null: the text states none), ``cosine`` of its best stretch (0: none) and
    ``line`` (where that begins, -1: none). Null and empty texts state none. The whole text is looked at."""
    counts, total = document_counts(docs, text)
    keep = tuple(c for c in keep if c not in ("licence", "cosine", "line"))
    hidden = free_name((*keep, "licence", "cosine", "line"), "_text")
    rows = docs.select(*(F.col(f"`{c}`") for c in keep), whole_text(f"`{text}`").alias(hidden))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name != hidden)

    def make():
        scanner = Scanner(counts, total)

        def step(cols):
            found = [scanner.best(t) for t in cols.pop(hidden)]
            return cols | {"licence": [x[0] for x in found], "cosine": [x[1] for x in found], "line": [x[2] for x in found]}

        return step

    return in_arrow(rows, f"{schema}licence string, cosine double, line int", make)


def ancestors(path: Column) -> Column:
    """The directories above a path, "" for the top included: (depth, directory)."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("directory")))


def inherited(found: DataFrame, path: str, licence_file: str, ident: str = "doc_id") -> DataFrame:
    """``found`` with ``effective`` licence and ``basis`` (own, inherited, none) and ``from_directory``.

    Rows with ``licence_file`` true (a Boolean column) and a statement speak for the directory of their path; if a
    directory has several, that of the smallest identifier does. A row without a statement takes that of its
    deepest ancestor directory with a licence file. A null path has no ancestors. Columns of found that have a result
    column's name are replaced, all others pass whatever their names.
    """
    found, named = apart(found.drop("effective", "basis", "from_directory"), (path, licence_file, "licence", ident))
    speak = found.filter(F.col(licence_file) & F.col("licence").isNotNull() & F.col(path).isNotNull())
    speak = speak.withColumn("_dir", F.array_join(F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1), "/"))
    speak = speak.groupBy("_dir").agg(F.min(F.struct(ident, "licence")).alias("_said"))
    seek = found.filter(F.col("licence").isNull() & F.col(path).isNotNull())
    dirs = seek.select(path).distinct().select(F.col(path).alias("_path"), F.explode(ancestors(F.col(path))).alias("_a"))
    # one row for each directory, not for each file in it: files of a directory share the answer
    near = dirs.join(speak, F.col("_a.directory") == F.col("_dir")).groupBy("_path").agg(F.max_by(F.struct("_dir", F.col("_said.licence").alias("licence")), F.col("_a.depth")).alias("_near"))
    out = found.join(near, F.col(path) == F.col("_path"), "left")
    own = F.col("licence").isNotNull()
    out = out.select(
        *found.columns,
        F.when(own, F.col("licence")).otherwise(F.col("_near.licence")).alias("effective"),
        F.when(own, "own").when(F.col("_near").isNotNull(), "inherited").otherwise("none").alias("basis"),
        F.when(~own, F.col("_near._dir")).alias("from_directory"),
    )
    return named(out, "effective", "basis", "from_directory")


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    """Documents have no paths, so each gets one: source, then two levels of folders by doc_id. The first document
    of a folder is its licence file, so a statement there holds for the folder."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    found = statements(docs, keep=("doc_id", "source"))
    upper, lower = F.floor(F.col("doc_id") / 1024).cast("string"), F.floor(F.col("doc_id") / 32).cast("string")
    source = F.coalesce("source", F.lit("none"))
    path = F.when(F.col("doc_id") % 1024 == 0, F.concat_ws("/", source, upper, F.lit("LICENSE"))).otherwise(F.concat_ws("/", source, upper, lower, F.when(F.col("doc_id") % 32 < 2, F.lit("LICENSE")).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))))
    found = found.select("doc_id", path.alias("path"), "licence", "cosine", "line").withColumn("licence_file", F.col("path").endswith("/LICENSE"))
    return inherited(written(found, "statements"), "path", "licence_file")  # else read, and scanned, three times

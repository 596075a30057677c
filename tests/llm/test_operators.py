"""The operators on training text against brute force, on small tables with every awkward row."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.llm import bpe, exact_dedup, jaccard, licenses, mixing, quality, quality_rules, repeats, substring_dedup, suffix_dedup, toxicity
from loomwork.operators.components import components

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    """Near copies, copies, shared passages, nulls, empty and long texts, repeated rows and tied sizes."""
    rnd = random.Random(11)
    words = ["".join(rnd.choice("abcdeéß") for _ in range(rnd.randint(1, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rnd.choice(words) + rnd.choice(["", "", "", ".", "\n", "\t"]) for _ in range(n))
    passage, base = prose(90), prose(150).split(" ")
    out = [(i, prose(rnd.randint(1, 260))) for i in range(60)]
    out += [(100 + i, f"{prose(30)} {passage} {prose(rnd.randint(5, 60))}") for i in range(12)]
    for i in range(14):
        near = list(base)
        near[rnd.randrange(len(near))] = f"new{i}"
        out.append((200 + i, " ".join(near)))
    out += [(300 + i, out[5][1]) for i in range(9)] + [(320 + i, "a b") for i in range(3)]
    out += [(400, None), (401, ""), (402, " \n\t "), (403, None), (None, "lone text without an identifier"), (None, out[6][1])]
    out += [(500, out[7][1]), (500, out[7][1]), (501, "x" * 3000), (502, "ab " * 900), (503, prose(9000)), (504, "one"), (505, "two words")]
    return [(i, t, "en", None if i is None or i % 7 == 0 else f"s{'ab'[i % 3 == 0]}", 0) for i, t in out]


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    """As a table of several files, so that rows have the same numbers each time."""
    path = str(tmp_path_factory.mktemp("docs") / "t")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def key(x):
    return tuple("" if v is None else repr(v) for v in x)


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_dedup(docs, rows, keep):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    got = exact_dedup.exact_dedup(docs, keep=keep).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = groups[r.text or ""]
        known = [i for i in ids if i is not None]
        assert r.keep_id == ((max if keep == "largest" else min)(known) if known else None)
        assert (r.group_size, r.text_sha256) == (len(ids), sha(r.text or ""))
    kept = Counter(r.text or "" for r in got if r.kept)
    assert kept == Counter(dict.fromkeys(groups, 1))
    assert sorted((key((r.doc_id, r.text, r.source)) for r in got)) == sorted(key((a, b, d)) for a, b, _, d, _ in rows)


def test_exact_dedup_of_hot_texts(spark, tmp_path):
    """Texts with more copies than a partition should hold are dealt over several."""
    data = [(i, "same") for i in range(700)] + [(1000 + i, None) for i in range(300)] + [(5000 + i, f"t{i}") for i in range(50)] + [(699, "same"), (None, "same")]
    spark.createDataFrame(data, "doc_id long, text string").write.parquet(str(tmp_path / "t"))
    got = exact_dedup.exact_dedup(spark.read.parquet(str(tmp_path / "t")), keep="largest").collect()
    same = [r for r in got if r.text == "same"]
    assert {(r.keep_id, r.group_size) for r in same} == {(699, 702)} and sum(r.kept for r in same) == 1
    empty = [r for r in got if r.text is None]
    assert {(r.keep_id, r.group_size) for r in empty} == {(1299, 300)} and [r.doc_id for r in empty if r.kept] == [1299]


def test_exact_dedup_normalised_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "A ", 9, "x"), (2, "a", 8, "y")], "doc_id long, text string, kept long, _t string")
    got = exact_dedup.exact_dedup(df, normalise=lambda c: F.lower(F.trim(c))).collect()
    assert {(r.doc_id, r.text, r._t, r.keep_id, r.kept) for r in got} == {(1, "A ", "x", 1, True), (2, "a", "y", 1, False)}


def removed_by_words(rows, numbers):
    """What is left of each row, by the row numbers that the operator uses for ties."""
    seen, out = set(), {}
    for n, (i, t) in sorted(numbers.items(), key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0])):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = [False] * len(words)
        for k in range(len(words) - 19):
            w = tuple(words[k : k + 20])
            if w in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(w)
        left = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out[n] = (i, len(words), sum(gone), sha(left))
    return out


def numbered(docs):
    return {r.n: (r.doc_id, r.text) for r in docs.select(F.monotonically_increasing_id().alias("n"), "doc_id", "text").collect()}


def test_substring_dedup_by_words(docs, rows):
    want = removed_by_words(rows, numbered(docs))
    got = substring_dedup.substring_dedup(docs).collect()
    assert sorted(key((r.doc_id, r.n_words, r.n_removed, r.kept_sha256)) for r in got) == sorted(key(x) for x in want.values())
    assert sum(r.n_removed for r in got) > 1000
    assert all(sha(r.kept_text) == r.kept_sha256 for r in got)


@pytest.mark.parametrize("most", [4096, 2])
def test_substring_dedup_by_bytes(docs, rows, most):
    count = Counter()
    texts = [(i, (t or "").encode()) for i, t, *_ in rows]
    for _, b in texts:
        count.update(b[k : k + 400] for k in range(len(b) - 399))
    want = []
    for i, b in texts:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 399):
            if count[b[k : k + 400]] > 1:
                gone[k : k + 400] = True
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        want.append((i, len(b), int(gone.sum()), runs, sha(np.frombuffer(b, np.uint8)[~gone].tobytes())))
    got = suffix_dedup.suffix_dedup(docs, most=most).collect()
    assert sorted(key((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in got) == sorted(map(key, want))
    assert sum(w[2] for w in want) > 5000


def test_common_windows_match_brute_force():
    rnd = random.Random(3)
    for _ in range(60):
        group = np.sort(np.array([rnd.randrange(3) for _ in range(rnd.randint(1, 9))]))
        left = np.array([rnd.randrange(6) for _ in group])
        segments = [bytes(rnd.choice(b"ab") for _ in range(x + rnd.randrange(12))) for x in left]
        got = {(c, int(i)) for c, which in suffix_dedup.common_windows(segments, group, left, 4) for i in which}
        seen = defaultdict(set)
        for i, s in enumerate(segments):
            for k in range(len(s) - 3):
                seen[group[i], k - int(left[i]), s[k : k + 4]].add(i)
        assert got == {(k[1], i) for k, who in seen.items() if len(who) > 1 for i in who}


def test_jaccard_join(docs, rows):
    sets = []
    for _, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    n = len(rows)
    links, root = Counter(), list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and both and both / len(sets[a] | sets[b]) >= 0.8:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    ident = lambda i: -1 if rows[i][0] is None else rows[i][0]
    least = defaultdict(lambda: 10**9)
    for a in range(n):
        least[find(a)] = min(least[find(a)], ident(a))
    want = sorted((ident(a), links[a], least[find(a)]) for a in range(n))
    for small, block in ((24, 256), (2, 3)):
        got = jaccard.jaccard_join(docs, small=small, block=block).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_links, -1 if r.class_id is None else r.class_id) for r in got) == want
        assert sum(r["first"] for r in got) == len({find(a) for a in range(n)})


def test_pruning_keeps_what_reaches_the_threshold():
    rnd = np.random.default_rng(1)
    table, kept, near = jaccard.least_agreements(0.8), 0, []
    for _ in range(300):
        pool = rnd.integers(0, 1 << 63, 270, dtype=np.uint64)
        a, b = np.sort(pool[:240]), np.sort(np.concatenate([pool[30:240], pool[240:262]]))
        x, y = (np.frombuffer(jaccard.minhash(s), np.uint16)[None] for s in (a, b))
        near.append(float((x == y).mean()))
        kept += len(jaccard.survivors(x, y, table))
    assert kept == 300
    assert abs(np.mean(near) - 210 / 262) < 0.01
    far = [np.frombuffer(jaccard.minhash(rnd.integers(0, 1 << 63, 200, dtype=np.uint64)), np.uint16)[None] for _ in range(2)]
    assert not len(jaccard.survivors(*far, table))


def test_components_of_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 103), (103, 101)], "u long, v long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 103: 100}


def test_mixing(docs, rows):
    got = mixing.mix(docs, mixing.word_count()).collect()
    assert len(got) == len(rows)
    size = {s: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows if r[3] == s) for s in {r[3] for r in rows}}
    order = sorted((s for s in size if s is not None)) + [None]
    weight = dict(zip(order, [3, 1, 2], strict=True))
    target, open_, rest = {}, set(order), 1.5 * sum(size.values())
    while True:  # shares by weight; what is over twice the size is shared again
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * size[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2 * size[s]
            rest -= target[s]
        open_ -= over
    for r in got:
        assert (r.source_size, pytest.approx(r.target)) == (size[r.source], target[r.source])
        assert 0 <= r.copies <= 2
    for s in order:
        taken = sum(r.copies * r.size for r in got if r.source == s)
        assert abs(taken - target[s]) <= max(r.size for r in got if r.source == s)
    again = mixing.mix(docs.repartition(5), mixing.word_count()).collect()
    assert Counter((r.doc_id, r.copies) for r in again) == Counter((r.doc_id, r.copies) for r in got)
    mixed = mixing.emitted(docs, mixing.word_count())
    assert mixed.columns == docs.columns
    want = Counter({key((r.doc_id,)): 0 for r in got})
    for r in got:
        want[key((r.doc_id,))] += r.copies
    assert Counter(key((r.doc_id,)) for r in mixed.collect()) == +want


def test_bpe_round_trip_and_ids(docs, rows):
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    want = []
    for i, t, *_ in rows:
        ids = other.encode_ordinary(t or "")
        want.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t or "")))
    got = bpe.digests(docs, path, P.PATTERN).collect()
    assert sorted(key((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256)) for r in got) == sorted(map(key, want))
    rich = docs.withColumn("tokens", F.lit(1)).withColumn("__text_", F.lit(2))
    coded = bpe.encode(rich, path, P.PATTERN).collect()
    assert all(r.tokens == other.encode_ordinary(r.text or "") for r in coded)


def test_bpe_of_odd_texts():
    import public_tokenizers as P
    import tiktoken

    ranks = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    ours, other = bpe.Encoder(ranks, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(9)
    texts = ["".join(rnd.choice("abcé漢 \n\t'st1!😀‍") for _ in range(rnd.randint(0, 80))) for _ in range(400)]
    texts += ["a" * 4001, "".join(rnd.choice("abcdefgh") for _ in range(30_000)), "<|endoftext|>", " \n\n  x"]
    for t, ids in zip(texts, ours.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == other.encode_ordinary(t)
        assert b"".join(ours.decode(ids)) == t.encode()


def test_quality_rule_counts(docs, rows):
    got = quality_rules.judged(docs, np.array([1.0] + [0.0] * (quality_rules.N_FEATURES + 3), np.float32)).collect()
    want = []
    for i, t, *_ in rows:
        text = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
        hit = set()
        for k in range(len(words) - 2):
            if windows[tuple(words[k : k + 3])] > 1:
                hit |= {k, k + 1, k + 2}
        seen, dup = set(), 0
        for line in text.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
        want.append((i, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), failed, not failed))
    assert sorted(key((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept)) for r in got) == sorted(map(key, want))


def test_viterbi_and_gradient_match_brute_force():
    import itertools

    rnd = np.random.default_rng(4)
    w = rnd.normal(size=quality_rules.N_FEATURES + 4)
    docs = [rnd.integers(0, 1 << quality_rules.N_FEATURES, n) for n in (1, 3, 5, 4)]
    label = quality_rules.Labeller(w)
    step = w[quality_rules.N_FEATURES :].reshape(2, 2)

    def total(doc, ys):
        s = quality_rules._dense(doc) @ w[: quality_rules.N_FEATURES]
        return sum(s[k] for k, y in enumerate(ys) if y) + sum(step[a, b] for a, b in itertools.pairwise(ys))

    for doc in docs:
        best = max(itertools.product((0, 1), repeat=len(doc)), key=lambda ys: total(doc, ys))
        assert tuple(label(doc.tolist())) == best
    y = rnd.integers(0, 2, sum(map(len, docs)))
    chain = quality_rules.Chain(docs, True)
    value, g = chain(w, y)
    want, at = 0.0, 0
    for doc in docs:
        ys = y[at : at + len(doc)].tolist()
        at += len(doc)
        z = np.logaddexp.reduce([total(doc, t) for t in itertools.product((0, 1), repeat=len(doc))])
        want -= (total(doc, ys) - z) / len(docs)
    assert value == pytest.approx(want + quality_rules.PENALTY / 2 * w.dot(w))
    for k in (0, 3, quality_rules.N_FEATURES, quality_rules.N_FEATURES + 2):
        d = np.zeros_like(w)
        d[k] = 1e-5
        assert (chain(w + d, y)[0] - chain(w - d, y)[0]) / 2e-5 == pytest.approx(g[k], abs=1e-5)


def test_classifiers_learn_without_held_out_rows(spark, tmp_path):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("aeioulmnrst") for _ in range(5))
    data, labels = [], []
    for i in range(900):
        toxic, good = rnd.random() < 0.3, rnd.random() < 0.7
        words = [word() for _ in range(40)]
        if toxic:
            words[rnd.randrange(40)] = rnd.choice(["zonk", "quark"])
        words = words if good else [w.upper() + "!!" for w in words]
        data.append((i, " ".join(words)))
        labels.append((i, int(good), int(toxic)))
    spark.createDataFrame([*data, (5000, None), (5001, "")], "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    docs, marks = spark.read.parquet(str(tmp_path / "d")), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    held = {i for i in range(900) if zlib.crc32(str(i).encode()) % 5 == 0}
    # labels of held-out rows can't matter: wrong ones give the same model
    spoiled = marks.withColumns({c: F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col(c)).otherwise(F.col(c)) for c in ("quality", "toxic")})
    for module, column, limit in ((toxicity, "toxic", 0.5), (quality, "quality", 0.3)):
        weights = module.model(docs, marks)
        assert np.array_equal(weights, module.model(docs, spoiled))
        got = {r.doc_id: r.score for r in module.scored(docs, weights).collect()}
        assert len(got) == 902 and all(0 <= s <= 1 for s in got.values()) and got[5000] == got[5001]
        truth = {r[0]: r[1 if column == "quality" else 2] for r in labels}
        right = sum((got[i] >= limit) == bool(truth[i]) for i in held)
        assert right >= 0.93 * len(held)
    weights = quality_rules.model(docs, marks)
    assert quality_rules.judged(docs, weights).count() == 902


def test_licences(spark):
    text = "Some words first.\nReleased under the MIT License.\nmore"
    data = [
        (1, "a/LICENSE", "Licensed under the Apache License, Version 2.0."), (2, "a/b/x.txt", "nothing here"), (3, "a/b/c/LICENSE", text), (4, "a/b/c/d/y.txt", None),
        (5, "z/y.txt", ""), (6, None, "no path"), (7, "a/b/own.txt", "Licensed under CC BY-NC 4.0."), (8, "a/b/c/LICENSE", "Licensed under the Apache License, Version 2.0."), (8, "a/b/c/LICENSE", "Licensed under the Apache License, Version 2.0."),
    ]
    df = spark.createDataFrame(data, "doc_id long, path string, text string").withColumn("line", F.lit(7))
    found = licenses.statements(df, keep=("doc_id", "path", "line")).withColumn("file", F.col("path").endswith("LICENSE"))
    got = sorted((r.doc_id, r.licence, r.effective, r.basis, r.from_directory, r.line) for r in licenses.inherited(found, "path", "file").collect())
    assert [g[:5] for g in got] == [
        (1, "Apache-2.0", "Apache-2.0", "own", None), (2, None, "Apache-2.0", "inherited", "a"), (3, "MIT", "MIT", "own", None), (4, None, "MIT", "inherited", "a/b/c"),
        (5, None, None, "none", None), (6, None, None, "none", None), (7, "CC-BY-NC-4.0", "CC-BY-NC-4.0", "own", None), (8, "Apache-2.0", "Apache-2.0", "own", None), (8, "Apache-2.0", "Apache-2.0", "own", None),
    ]
    assert got[2][5] == 1


def test_empty_tables(spark, none):
    import public_tokenizers as P

    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    path = P.path("byte_bpe_50k.tiktoken")
    assert exact_dedup.exact_dedup(none).count() == 0
    assert substring_dedup.substring_dedup(none).count() == 0
    assert suffix_dedup.suffix_dedup(none).count() == 0
    assert jaccard.jaccard_join(none).count() == 0
    assert mixing.emitted(none, mixing.word_count()).count() == 0
    assert bpe.digests(none, path, P.PATTERN).count() == bpe.encode(none, path, P.PATTERN).count() == 0
    for module in (toxicity, quality):
        assert module.scored(none, module.model(none, labels)).count() == 0
    assert quality_rules.judged(none, quality_rules.model(none, labels)).count() == 0
    assert licenses.statements(none).count() == 0
    one = spark.createDataFrame([(1, "words")], "doc_id long, text string")
    assert toxicity.scored(one, toxicity.model(one, labels)).first().score < 0.5


@needs_data
def test_held_out_accuracy_on_the_tables(spark):
    from loomwork.llm.queries import QUERIES

    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    for name, column in (("op4_toxicity", "toxic"), ("op5_quality", "quality")):
        got = QUERIES[name](spark, "/root/testdata/sf0.01").filter("held_out").join(labels, "doc_id")
        assert got.filter(F.col("predicted") == F.col(column)).count() >= 0.9 * got.count()


@needs_data
@pytest.mark.parametrize("name", ["op1_substring_dedup", "op6_exact_dedup", "op8_jaccard_join", "op10_mixing"])
def test_queries_match_sql(spark, name):
    import duckdb

    from loomwork.llm.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{DATA}/documents.parquet')")
    found = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    want = sorted(found.fetchall())
    assert sorted(tuple(r[c] for c in names) for r in QUERIES[name](spark, DATA).collect()) == want


@needs_data
def test_pipeline(spark):
    import corpus_pipeline
    from loomwork.llm.common import table

    docs = table(spark, DATA, "documents")
    left = docs
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        left = spark.createDataFrame(stage(spark, left, DATA).toPandas(), docs.schema) if k < 2 else stage(spark, left, DATA)
        seen.append({r.doc_id for r in left.select("doc_id").collect()})
        assert left.columns == docs.columns
    toxic = {r.doc_id for r in toxicity.scored(docs, toxicity.model(docs, table(spark, DATA, "labels"))).filter("score >= 0.5").collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert seen[0] == set(texts) - toxic
    last = {}
    for i in sorted(seen[0]):
        last[texts[i]] = i
    assert seen[1] == set(last.values())
    out = corpus_pipeline.run(spark, DATA)
    assert out.columns == [*docs.columns, "tokens"]
    got = out.collect()
    assert {r.doc_id for r in got} <= seen[2] and all(r.tokens for r in got if r.text)


MIT_BODY = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""


@pytest.mark.parametrize("total", [1, 10_000])
def test_licence_files_headers_and_short_forms(total):
    scanner = licenses.Scanner({"the": total // 2, "of": total // 2, "license": total // 100}, total)
    padding = "invented words about " * 60
    bodies = dict(licenses.BODIES)
    for text, want in (
        (f"MIT License\n\nCopyright (c) 2020 Someone Else\n\n{MIT_BODY}", "MIT"),
        (f"Copyright (c) 2020 Someone Else\n\n{MIT_BODY}", "MIT"),
        (f"{padding}\n{MIT_BODY}\n{padding}", "MIT"),
        ("MIT License", "MIT"),
        ("License: MIT", "MIT"),
        ("// SPDX-License-Identifier: MIT\nint x;", "MIT"),
        ("# SPDX-License-Identifier: GPL-3.0-or-later", "GPL-3.0"),
        ("License: Apache-2.0", "Apache-2.0"),
        ("Apache License\nVersion 2.0, January 2004", "Apache-2.0"),
        (f"{padding} licensed under the Apache License, Version 2.0 {padding}", "Apache-2.0"),
        ("/*\n * Copyright 2020 Someone. All rights reserved.\n *\n * Licensed under the Apache License,\n * Version 2.0 (the \"License\"); you may not use this\n * file except in compliance with the License.\n */\nint x;", "Apache-2.0"),
        (f"Copyright 2020 Someone\n\n{bodies['BSD-2-Clause']}", "BSD-2-Clause"),
        (f"Copyright 2020 Someone\nAll rights reserved.\n\n{bodies['BSD-3-Clause']}", "BSD-3-Clause"),
        (bodies["GPL-3.0"], "GPL-3.0"),
        (bodies["LGPL-3.0"], "LGPL-3.0"),
        (bodies["MPL-2.0"], "MPL-2.0"),
        ("SPDX-License-Identifier: LicenseRef-Own", None),
        # one text alone has no document frequencies to tell common words by
        *([("the license of the software and all the terms of it", None)] if total > 1 else []),
        (padding, None),
        ("", None),
    ):
        assert scanner.best(text)[0] == want, text[:80]


@pytest.mark.parametrize("stored", [True, False])
def test_row_numbers_hold_under_other_splits(spark, docs, tmp_path, stored):
    """Files are split anew between two reads, as they are when executors come or go."""
    path = str(tmp_path / "t")
    size = {"spark.sql.files.maxPartitionBytes": "20k", "spark.sql.files.openCostInBytes": "1"}
    spark.range(20_000).repartition(3).selectExpr("id AS doc_id", "concat('text ', id) AS text").write.option("parquet.block.size", 20_000).parquet(path)
    table = spark.read.parquet(path) if stored else spark.read.parquet(path).filter("doc_id >= 0")
    rows = repeats.numbered(table, "text", "doc_id")
    before = {r.row: r.id for r in rows.collect()}
    assert len(before) == 20_000
    kept = {k: spark.conf.get(k) for k in size}
    try:
        for k, v in size.items():
            spark.conf.set(k, v)
        again = rows.select("*")
        assert again.rdd.getNumPartitions() > 3
        assert {r.row: r.id for r in again.collect()} == before
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)

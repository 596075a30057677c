"""Methods against brute force that the tables of test_operators are too large for, and columns with clashing names."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.llm import bpe, exact_dedup, jaccard, licenses, mixing, quality, quality_rules, substring_dedup, suffix_dedup, toxicity

WORD = r"[^\x20\x09-\x0D]+"
#: Names that operators give to results or use inside.
NAMES = [
    "row", "id", "_text", "_text_", "__text", "score", "kept", "keep_id", "group_size", "text_sha256", "spans", "first", "n", "m", "s", "_row", "__row", "_file", "_place",
    "copies", "size", "source_size", "target", "taken", "tokens_", "effective", "basis", "from_directory", "_path", "_near", "_dir", "_said", "_a", "_c0", "_c9", "_doc", "_copy",
    "_pid", "_at", "_src", "_id", "_rate", "_off", "n_words", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", "class_id", "n_links", "content_share", "base_failed", "_t", "_h", "_p", "_ident", "_null", "_salt", "_y",
]


@pytest.fixture(scope="module")
def rich(spark, tmp_path_factory):
    """Documents with a column of every such name; each holds its place times 1000 and the row's number."""
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) for _ in range(300)]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(5, 90))) for _ in range(24)]
    near = texts[3].split(" ") + ["tail"] * 2
    texts += [texts[0], texts[0], None, "", " ".join(near * 2), " ".join([*near * 2, "x"]), "Released under the MIT License."]
    extra = ", ".join(f"`{n}` long" for n in NAMES)
    rows = [(i, t, "ab"[i % 2], *(1000 * k + i for k in range(len(NAMES)))) for i, t in enumerate(texts)]
    path = str(tmp_path_factory.mktemp("rich") / "t")
    spark.createDataFrame(rows, f"doc_id long, text string, source string, {extra}").repartition(2).write.parquet(path)
    return spark.read.parquet(path)


def untouched(df, replaced=()):
    """Whether columns have the values that rich gave them."""
    names = [n for n in NAMES if n in df.columns and n not in replaced]
    assert len(df.columns) == len({c.lower() for c in df.columns})
    for r in df.collect():
        for n in names:
            assert r[n] == 1000 * NAMES.index(n) + r.doc_id, n
    return len(names) + len(replaced)


def test_clashing_names_in_stages(spark, rich, tmp_path):
    import corpus_pipeline

    labels = spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(20)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, rich, str(tmp_path))
        assert out.columns[: len(rich.columns)] == rich.columns, name
        assert untouched(out) == len(NAMES)
        assert stage(spark, rich.limit(0), str(tmp_path)).count() == 0


def test_clashing_names_in_operators(spark, rich):
    import public_tokenizers as P

    every = tuple(rich.columns)
    path = P.path("byte_bpe_50k.tiktoken")
    zero = np.zeros((1 << toxicity.BITS) + 1, np.float32), np.zeros((1 << quality.BITS) + 1, np.float32), np.zeros(quality_rules.N_FEATURES + 4, np.float32)
    assert untouched(toxicity.scored(rich, zero[0], keep=every), ("score",)) == len(NAMES)
    assert untouched(quality.scored(rich, zero[1], keep=every, out="own")) == len(NAMES)
    assert untouched(quality_rules.judged(rich, zero[2], keep=every), ("n_words", "base_failed", "kept", "content_share")) == len(NAMES)
    assert untouched(bpe.encode(rich, path, P.PATTERN)) == len(NAMES)
    assert untouched(exact_dedup.exact_dedup(rich), ("keep_id", "group_size", "kept", "text_sha256")) == len(NAMES)
    assert untouched(mixing.emitted(rich, mixing.word_count())) == len(NAMES)
    found = licenses.statements(rich, keep=every)
    found = found.withColumns({"path": F.concat(F.lit("a/"), "source", F.lit("/LICENSE")), "speaks": F.lit(True)})
    assert untouched(licenses.inherited(found, "path", "speaks"), ("effective", "basis", "from_directory")) == len(NAMES)
    # these return results alone; further columns must not change them
    bare = rich.select("doc_id", "text", "source")
    for run in (substring_dedup.substring_dedup, suffix_dedup.suffix_dedup, jaccard.jaccard_join, lambda d: mixing.mix(d, mixing.word_count()), lambda d: bpe.digests(d, path, P.PATTERN)):
        got, want = run(rich), run(bare)
        drop = [c for c in ("row", "kept") if c in got.columns]
        assert sorted(map(repr, got.drop(*drop).collect())) == sorted(map(repr, want.drop(*drop).collect()))


def test_identifiers_of_any_kind_and_long_texts(spark, tmp_path):
    """String identifiers, ties in them, and texts of a megabyte with a repeated half."""
    rnd = random.Random(8)
    long = " ".join(rnd.choice(["alpha", "beta", "gamma", "delta"]) + str(rnd.randrange(9999)) for _ in range(90_000))
    data = [("b", long), ("a", long[: len(long) // 2]), ("a", None), (None, "one two"), (None, "one two"), ("c", "x" * 2_000_000), ("d", "")]
    spark.createDataFrame(data, "doc_id string, text string").coalesce(1).write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    half = re.findall(WORD, long[: len(long) // 2])
    words = {(r.doc_id, r.n_words): r.n_removed for r in substring_dedup.substring_dedup(docs).collect()}
    assert words["b", 90_000] >= len(half) - 1 and words["a", len(half)] == 0 and words["c", 1] == 0
    spans = {(r.doc_id, r.n_bytes): (r.n_removed, r.n_spans) for r in suffix_dedup.suffix_dedup(docs).collect()}
    assert spans["a", len(long) // 2] == (len(long) // 2, 1) and spans["b", len(long)] == (len(long) // 2, 1) and spans["c", 2_000_000] == (2_000_000, 1)
    near = {r.doc_id: r.n_links for r in jaccard.jaccard_join(docs).collect() if r.doc_id}
    assert near == {"a": 0, "b": 0, "c": 0, "d": 0}


def test_hot_anchors_are_made_longer(spark, tmp_path):
    """Hundreds of unequal segments at one anchor, far more than a block holds."""
    rnd = random.Random(4)
    noise = lambda n: "".join(rnd.choice("abcdefghijklmnop") for _ in range(n))
    common = noise(460)
    texts = [noise(rnd.randrange(300)) + common[rnd.randrange(50) :] + noise(rnd.randrange(300)) for _ in range(300)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "t"))
    count = Counter(t[k : k + 400] for t in texts for k in range(len(t) - 399))
    want = {}
    for i, t in enumerate(texts):
        gone = [False] * len(t)
        for k in range(len(t) - 399):
            if count[t[k : k + 400]] > 1:
                gone[k : k + 400] = [True] * 400
        want[i] = sum(gone)
    docs = spark.read.parquet(str(tmp_path / "t"))
    assert {r.doc_id: r.n_removed for r in suffix_dedup.suffix_dedup(docs, most=8).collect()} == want
    assert len(set(want.values())) > 20


def test_a_span_that_differs_from_its_source_is_an_error():
    from loomwork.llm.repeats import covered

    text = b"abcdefghij"
    read = lambda first, n: text[first : first + n + 3]
    assert covered(10, 4, [{"first": 2, "n": 2, "at": 0, "source": b"cdefg"}], read).tolist() == [2 <= i < 7 for i in range(10)]
    with pytest.raises(ValueError, match="differs"):
        covered(10, 4, [{"first": 2, "n": 2, "at": 0, "source": b"cdefX"}], read)
    with pytest.raises(ValueError, match="differs"):
        covered(10, 4, [{"first": 2, "n": 2, "at": 1, "source": None}], read)
    assert not covered(10, 4, [{"first": 2, "n": 2, "at": None, "source": None}], read)[:2].any()


def test_spans_that_go_on_are_joined():
    from loomwork.llm.repeats import _joined

    array = lambda *x: np.array(x, np.int64)
    join = lambda *x: sorted(zip(*(y.tolist() for y in _joined(7, *x)), strict=True))
    # two pieces that go on in row 3, one elsewhere in it, one without a source
    assert join(array(10, 15, 30, 50), array(5, 4, 2, 3), array(3, 3, 3, -1), array(100, 105, 9, -1)) == [(10, 9, 3, 100), (30, 2, 3, 9), (50, 3, -1, 50)]
    # a period: every window equals one in row 3, so all but the first have their neighbour as source
    assert join(np.arange(20, 40), np.ones(20, np.int64), np.full(20, 3), np.full(20, 5)) == [(20, 1, 3, 5), (21, 19, -2, 20)]
    # the same in the row of the source itself
    assert join(np.arange(20, 40), np.ones(20, np.int64), np.full(20, 7), np.full(20, 20)) == [(20, 1, -1, 20), (21, 19, -2, 20)]


def test_licence_cosines_match_brute_force():
    """Every stretch of a text against every template, with vectors as plain dictionaries."""
    rnd = random.Random(21)
    counts = {t: rnd.randrange(1, 900) for t in licenses.VOCABULARY if rnd.random() < 0.5}
    total = 1000
    scanner = licenses.Scanner(counts, total)
    known = set(licenses.VOCABULARY)
    idf = {t: math.log((1 + total) / (1 + counts.get(t, 0))) + 1 for t in known}
    other = math.log(1 + total) + 1
    short = [k for k, (_, t) in enumerate(licenses.TEMPLATES) if len(licenses.terms(t)) <= 60]

    def cosine(words, template):
        a, b = Counter(w for w in words if w in known), Counter(template)
        rest = sum(w not in known for w in words)
        size = math.sqrt(sum((n * idf[w]) ** 2 for w, n in a.items()) + rest * other**2)
        own = math.sqrt(sum((n * idf[w]) ** 2 for w, n in b.items()))
        return sum(n * b[w] * idf[w] ** 2 for w, n in a.items()) / (size * own) if size else 0.0

    def best(text):
        lines, sentences, block, blocks, every = [], [], [], [], []
        for number, line in enumerate(text.lower().split("\n")):
            words, sentence = [], []
            for raw in line.split():
                if w := raw.strip(licenses._EDGES):
                    words.append((w, number))
                    sentence.append((w, number))
                if raw[-1] in ".;!?":
                    sentences.append(sentence)
                    sentence = []
            sentences.append(sentence)
            lines.append(words)
            every += words
            block = block + words if words else block
            if not words:
                blocks.append(block)
                block = []
        stretches = [x for x in (*lines, *sentences, *blocks, block, every) if x]
        top = None
        for k, (_, t) in enumerate(licenses.TEMPLATES):
            template = licenses.terms(t)
            tries = [(x, licenses.LEAST) for x in stretches if len(x) >= scanner.least_words[k]]
            if scanner.slides[k] and len(every) > len(template):
                tries += [(every[i : i + len(template)], licenses.WITHIN) for i in range(len(every) - len(template) + 1)]
            for x, least in tries:
                words = [w for w, _ in x]
                value = round(cosine(words, template), 9)
                if value < least or (len(set(template)) <= licenses.SHORT and not set(template) <= set(words)):
                    continue
                order = (not scanner.own[k], -value, x[0][1], k)
                top = order if top is None else min(top, order)
        return None if top is None else (licenses.TEMPLATES[top[3]][0], -top[1], top[2])

    found = 0
    noise = ["river", "stone", "the", "of", "license", "version", "software.", "under", "use;", "\n", "\n\n"]
    for _ in range(60):
        parts = []
        for _ in range(rnd.randint(0, 4)):
            parts += [rnd.choice(noise) for _ in range(rnd.randrange(12))]
            if rnd.random() < 0.6:
                words = licenses.TEMPLATES[rnd.choice(short)][1].split()
                parts += [w for w in words if rnd.random() < 0.95]
        text = " ".join(parts)
        got, want = scanner.best(text), best(text)
        if want is None:
            assert got[0] is None
        else:
            assert (got[0], got[2]) == (want[0], want[2]) and got[1] == pytest.approx(want[1], abs=2e-9)
            found += 1
    assert 20 < found < 60


def test_log_count_ratios_and_the_fit_match_brute_force():
    rnd = random.Random(6)
    texts = [" ".join(rnd.choice(["aba", "bcd", "cde", "dam", "eel"] + (["zap"] if i % 3 == 0 else ["sun"])) for _ in range(rnd.randint(3, 12))) for i in range(60)]
    y = [int(i % 3 == 0) for i in range(60)]
    grams = toxicity.Grams()
    rows = [grams(t) for t in texts]
    # a gram's hash value, counted in plain dictionaries
    toxic, clean = Counter(), Counter()
    for r, label in zip(rows, y, strict=True):
        assert len(set(r.tolist())) == len(r)
        (toxic if label else clean).update(r.tolist())
    size = 1 << toxicity.BITS
    p_sum, q_sum = sum(toxic.values()) + size, sum(clean.values()) + size
    want = {h: math.log((1 + toxic[h]) / p_sum / ((1 + clean[h]) / q_sum)) for h in toxic | clean if toxic[h] + clean[h] >= toxicity.LEAST}
    at, flags = np.concatenate(rows), np.repeat(np.array(y, float), [len(r) for r in rows])
    ratios = toxicity.log_ratios(at, flags)
    assert {int(h): pytest.approx(ratios[h]) for h in np.flatnonzero(ratios)} == {h: v for h, v in want.items() if v}
    # at the fitted weights the penalised likelihood has no slope, by a loop over texts
    weights = toxicity.fit(iter([(texts, y)]))
    slope, bias = defaultdict(float), 0.0
    for r, label in zip(rows, y, strict=True):
        e = 1 / (1 + math.exp(-(weights[r].sum() + weights[-1]))) - label
        bias += e / 60
        for h in r.tolist():
            slope[h] += e * want.get(h, 0.0) / 60
    assert abs(bias) < 0.01
    for h, ratio in want.items():
        if ratio:
            assert slope[h] + toxicity.PENALTY * weights[h] / ratio == pytest.approx(0, abs=0.02)


def test_follow_the_regularised_leader_matches_scalar_updates():
    rnd = random.Random(7)
    texts = [" ".join(rnd.choice("ab cd EF gh! 12 ij".split()) for _ in range(rnd.randint(0, 9))) for _ in range(25)]
    y = [rnd.randrange(2) for _ in texts]
    got = quality.fit(iter([(texts, y)]))
    words = quality.Words()
    rows = []
    for t in texts:
        found = Counter(quality.features(words, t).tolist())
        total = max(1, sum(found.values()))
        rows.append([*((h, n * quality.SCALE / total) for h, n in found.items()), (1 << quality.BITS, 1.0)])
    z, n = defaultdict(float), defaultdict(float)

    def weight(h):
        if abs(z[h]) <= quality.L1:
            return 0.0
        return -(z[h] - math.copysign(quality.L1, z[h])) / ((quality.BETA + math.sqrt(n[h])) / quality.ALPHA + quality.L2)

    for k in range(quality.PASSES):
        for i in np.random.default_rng(k).permutation(len(rows)):
            w = {h: weight(h) for h, _ in rows[i]}
            p = 1 / (1 + math.exp(-sum(w[h] * x for h, x in rows[i])))
            for h, x in rows[i]:
                g = (p - y[i]) * x
                z[h] += g - (math.sqrt(n[h] + g * g) - math.sqrt(n[h])) / quality.ALPHA * w[h]
                n[h] += g * g
    assert len(z) > 30
    for h in z:
        assert got[h] == pytest.approx(weight(h), abs=1e-5)
    assert np.count_nonzero(got) <= len(z)


def test_pipeline_stages_match_brute_force(spark, tmp_path):
    """Near copies, mix and ids of the last three stages, each from the rows that it gets."""
    import hashlib

    import corpus_pipeline
    import public_tokenizers as P
    import tiktoken

    rnd = random.Random(14)
    words = ["".join(rnd.choice("abcdef") for _ in range(5)) for _ in range(500)]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 120))) for _ in range(60)]
    for i in range(40):
        near = texts[rnd.randrange(20)].split(" ")
        near[rnd.randrange(len(near))] = f"w{i}"
        texts.append(" ".join(near))
    rows = [(i, t, "en", [None, "a", "b", "c"][i % 4], len(t or "")) for i, t in enumerate([*texts, None, ""])]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(2).write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    stage = dict(corpus_pipeline.STAGES)
    # near copies
    shingles = {}
    for i, t, *_ in rows:
        w = re.findall(WORD, t or "")
        shingles[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in shingles:
        for b in range(a):
            if shingles[a] and shingles[b] and len(shingles[a] & shingles[b]) / len(shingles[a] | shingles[b]) >= 0.8:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    left = stage["n-gram Jaccard join"](spark, docs, "")
    kept = {r.doc_id for r in left.collect()}
    assert kept == {i for i in root if find(i) == i} and len(kept) < len(rows)
    # the mix
    left = spark.createDataFrame([r for r in rows if r[0] in kept], schema)
    size = {r[0]: len(re.findall(WORD, r[1] or "")) for r in rows}
    of = {s: sorted((r for r in rows if r[3] == s and r[0] in kept), key=lambda r: (size[r[0]], r[0])) for s in ("a", "b", "c", None)}
    total = {s: sum(size[r[0]] for r in rs) for s, rs in of.items()}
    target, free, rest = {}, dict(zip(of, (3, 1, 2, 3), strict=True)), 1.5 * sum(total.values())
    while True:
        share = {s: rest * w / sum(free.values()) for s, w in free.items()}
        full = [s for s in free if share[s] > 2 * total[s]]
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 2.0 * total[s]
            rest -= target[s]
            del free[s]
    want = Counter()
    for s, rs in of.items():
        offset, rate, before = int(hashlib.md5(f"mix:{s or ''}".encode()).hexdigest()[:5], 16) / (1 << 20), target[s] / total[s], 0
        for k, r in enumerate(rs, 1):
            upto = math.floor(k * rate + offset) - math.floor(offset)
            want[r[0]] += upto - before
            before = upto
    mixed = stage["mixing sources to target weights"](spark, left, "")
    assert Counter(r.doc_id for r in mixed.collect()) == +want
    # the ids
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    for r in stage["byte-level BPE"](spark, docs, "").collect():
        assert r.tokens == other.encode_ordinary(r.text or "")


def test_what_an_encoder_remembers_is_bounded(monkeypatch):
    """The ids are those of a fresh encoder, however little is remembered and however small a block is."""
    import public_tokenizers

    from loomwork.llm import bpe

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    texts = [" ".join(f"word{i * j % 977}x the {'y' * (i % 90)}" for j in range(40)) for i in range(200)] + ["", "z" * 5000]
    want = [bpe.Encoder(ranks, public_tokenizers.PATTERN).encode([t])[0] for t in (texts[0], texts[150], texts[-2], texts[-1])]
    monkeypatch.setattr(bpe, "REMEMBERED", 400)
    monkeypatch.setattr(bpe, "BLOCK", 2000)
    coder, most = bpe.Encoder(ranks, public_tokenizers.PATTERN), 0
    for lo in range(0, len(texts), 10):
        got = coder.encode(texts[lo : lo + 10])
        most = max(most, len(coder.known) + len(coder.older))
        for t, ids in ((0, want[0]), (150, want[1]), (len(texts) - 2, want[2]), (len(texts) - 1, want[3])):
            if lo <= t < lo + 10:
                assert got[t - lo] == ids
    assert most < 2 * 400
    # what is met in every block is never encoded again
    assert " the" in coder.known or " the" in coder.older


def test_a_text_goes_through_the_workers_once(spark, tmp_path):
    """The pipeline's stages in Python get the text in one column, and null texts stay null in it."""
    import numpy as np
    import public_tokenizers

    from loomwork.llm import bpe, toxicity

    docs = spark.createDataFrame([(1, "a text", "b"), (2, None, "c")], "doc_id long, text string, lang string")
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    encoded, scored = bpe.encode(docs, path, pattern), toxicity.scored(docs, np.zeros((1 << toxicity.BITS) + 1), keep=("doc_id", "text", "lang"))
    for out in (encoded, scored):
        assert out._jdf.queryExecution().analyzed().children().apply(0).schema().fieldNames().__len__() == 3
        assert [r["text"] for r in out.orderBy("doc_id").collect()] == ["a text", None]
    replaced = bpe.encode(docs, path, pattern, out="text")
    assert replaced.columns == ["doc_id", "lang", "text"]
    tokens = {r["doc_id"]: r["tokens"] for r in encoded.collect()}
    assert {r["doc_id"]: r["text"] for r in replaced.collect()} == tokens and tokens[2] == [] and tokens[1]


def test_rows_are_told_apart_by_their_numbers(spark, tmp_path, monkeypatch):
    """Numbers of several files and beyond 64; the texts that the joins of op3 don't need are not shuffled for them."""
    from loomwork.llm import repeats

    numbers = [*range(130), 63 + (1 << 40), 64 + (1 << 40), (5 << 40) + 127]
    rows = spark.createDataFrame([(r, r, f"text {r}") for r in numbers], "row long, id long, text string")
    want = {0, 63, 64, 65, 129, 64 + (1 << 40), (5 << 40) + 127}
    wanted = spark.createDataFrame([(r,) for r in [*want, 63, 64, 63 + (2 << 40)]], "row long")
    some, others = repeats.parted(rows, wanted, "told")
    assert sorted(r.row for r in some.collect()) == sorted(want)
    assert sorted(r.row for r in others.collect()) == sorted(set(numbers) - want)
    assert some.columns == others.columns == rows.columns
    # copies among many texts that have none, with the numbers told apart and without
    rnd = random.Random(8)
    texts = ["".join(rnd.choice("abcdefgh") for _ in range(900)) for _ in range(300)]
    texts += [texts[7], "x" + texts[9][100:700] + "y", texts[11] + texts[7][:450]]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    found = {r.doc_id: r.n_removed for r in suffix_dedup.suffix_dedup(docs).collect()}
    assert {k: n for k, n in found.items() if n} == {7: 900, 9: 600, 11: 900, 300: 900, 301: 600, 302: 1350}
    monkeypatch.setattr(repeats, "SENT", 0)
    assert repeats.parted(rows, wanted, "told") == (rows, None)
    assert {r.doc_id: r.n_removed for r in suffix_dedup.suffix_dedup(docs).collect()} == found


def test_toxicity_is_trained_in_blocks(monkeypatch):
    """Counts need memory for a block of features, not for all; the size of a block doesn't change the weights."""
    import tracemalloc

    import numpy as np

    from loomwork.llm import toxicity

    at = np.tile(np.arange(1000, dtype=np.uint32), 4000)
    tracemalloc.start()
    toxicity.log_ratios(at, np.repeat(np.arange(4000) % 2 > 0, 1000), 1000)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40e6  # 4 million features of 16 bytes are 64 MB
    rnd = random.Random(3)
    texts = ["", *(" ".join(rnd.choice(("bad", "worse", "fine", "good", "tree", "stone", "river"))[: 2 + i % 4] for _ in range(rnd.randrange(60))) for i in range(120)), "", ""]
    labels = [int("bad" in t or "wor" in t and len(t) > 90) for t in texts]
    whole = toxicity.fit(iter([(texts, labels)]))
    monkeypatch.setattr(toxicity, "BLOCK", 50)
    assert np.abs(whole).max() > 0.1 and np.allclose(whole, toxicity.fit(iter([(texts, labels)])), atol=1e-6)

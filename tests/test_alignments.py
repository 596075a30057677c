import random

import pytest

from loomwork.operators import alignments, chaining, scoring

SCHEMA = chaining.SCHEMA


def table(spark, rows):
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], SCHEMA)


def random_rows(seed, n, queries=4, refs=2):
    rnd, count, out = random.Random(seed), {}, []
    for _ in range(n):
        q = f"q{rnd.randrange(queries)}"
        count[q] = count.get(q, 0) + 1
        qs, rs, size = rnd.randrange(900), rnd.randrange(5000), rnd.randrange(1, 120)
        out.append({"query": q, "query_len": 1200, "query_start": qs, "query_end": qs + size, "strand": rnd.choice("+-"), "ref": f"r{rnd.randrange(refs)}", "ref_len": 6000, "ref_start": rs, "ref_end": rs + size, "num_match": rnd.randrange(1, size + 1), "aln_len": size, "mapq": rnd.randrange(61), "line_no": count[q]})
    return out


@pytest.mark.parametrize("seed", range(3))
def test_unique_anchors_match_base_counts(spark, seed):
    rows = random_rows(seed, 60)
    depth = {}
    for r in rows:
        for x in range(r["query_start"], r["query_end"]):
            depth[r["query"], x] = depth.get((r["query"], x), 0) + 1
    for small in (False, True):
        want = set()
        for r in rows:
            alone = sum(depth[r["query"], x] == 1 for x in range(r["query_start"], r["query_end"]))
            if alone >= 50 or (small and alone == r["aln_len"]):
                want.add((r["query"], r["line_no"]))
        got = {(r.query, r.line_no) for r in alignments.unique_anchors(table(spark, rows), 50, small).collect()}
        assert got == want


@pytest.mark.parametrize("seed", range(3))
def test_chains_match_a_plain_fold(spark, seed):
    rows = random_rows(seed, 200)
    blocks = []
    for r in sorted(rows, key=lambda r: (r["query"], r["ref"], r["ref_start"], r["ref_end"], r["line_no"])):
        b = blocks[-1] if blocks else None
        if b and all(b[k] == r[k] for k in ("query", "ref", "strand")) and abs(r["ref_start"] - b["ref_end"]) <= 400 and abs(r["query_start"] - b["query_end"]) <= 400:
            identity = (b["num_match"] / b["aln_len"] + r["num_match"] / r["aln_len"]) / 2
            for k in ("query", "ref"):
                b[f"{k}_start"], b[f"{k}_end"] = min(b[f"{k}_start"], r[f"{k}_start"]), max(b[f"{k}_end"], r[f"{k}_end"])
            b["aln_len"] = b["ref_end"] - b["ref_start"]
            b["num_match"], b["mapq"] = round(identity * b["aln_len"]), chaining.mean_mapq(b["mapq"], r["mapq"])
        else:
            blocks.append(dict(r))
    kept = []
    for i, x in enumerate(blocks):
        inside = (y for j, y in enumerate(blocks) if j != i and y["query"] == x["query"] and y["query_start"] <= x["query_start"] and y["query_end"] >= x["query_end"])
        same = lambda y: (y["query_start"], y["query_end"]) == (x["query_start"], x["query_end"])  # noqa: B023, E731
        if not any(not same(y) or blocks.index(y) < i for y in inside):
            kept.append(tuple(sorted(x.items())))
    got = [tuple(sorted(r.asDict().items())) for r in chaining.chained(table(spark, rows), 400).collect()]
    assert sorted(got) == sorted(kept)


def test_scores_of_one_reference_are_whole(spark):
    rows = random_rows(1, 1)
    got = scoring.scores(table(spark, rows)).first()
    assert (got.grouping, got.location, got.orientation) == (1.0, 1.0, 1.0)


def test_no_rows(spark):
    none = table(spark, [])
    assert alignments.unique_anchors(none, 10, True).count() == 0
    assert chaining.chained(none, 10).count() == 0
    assert scoring.scores(none).count() == 0


def test_a_distance_must_be_positive(spark):
    with pytest.raises(ValueError):
        alignments.terminal_only(table(spark, []), 0)

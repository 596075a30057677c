"""Cases that larger tables bring."""

import random
import re

import pytest

from loomwork.operators import alignments, breaks, components, graph, placement, splitting, stats
from loomwork.operators.matching import max_weight_matching
from loomwork.plans import adapters as ad
from loomwork.sources import readers


@pytest.mark.parametrize("genome", [0, 40])
def test_assembly_stats_with_empty_sequences(spark, genome):
    rows = spark.createDataFrame([("a", x) for x in (10, 0, 30, 0)] + [("none", 0)], "asm string, length long")
    got = {r.asm: r for r in stats.assembly_stats(rows, genome).collect()}
    assert tuple(got["a"])[1:] == (4, 40, 0, 30, 25, 30, 10, 1, 2)
    assert tuple(got["none"])[1:] == (1, 0, 0, 0, 0 if genome else None, None, None, None, None)


def test_line_numbers_follow_files_not_their_sizes(spark, tmp_path):
    sizes = (3, 40, 1, 0, 25)
    lines = [[f"f{i}l{k}" for k in range(n)] for i, n in enumerate(sizes)]
    for i, some in enumerate(lines):
        (tmp_path / f"part-{i:05}-x.txt").write_text("".join(f"o\t1\t1\t1\tW\t{x}\t1\t1\t+\n" for x in some))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200b")
    try:
        rows = readers.read_agp(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r.line_no, r.comp) for r in rows) == list(enumerate([x for some in lines for x in some], 1))


def test_sequences_are_dealt_not_sent_to_the_driver(spark):
    layout = spark.createDataFrame([("o", 1, 4, 1, "W", "a", 1, 4, "+", None, None, None, None)], f"{', '.join(c + (' long' if c in ('obj_beg', 'obj_end', 'pid', 'comp_beg', 'comp_end', 'gap_len') else ' string') for c in placement.LAYOUT)}")
    for out, seqs in ((splitting.built(layout, named(spark, "a")), "o"), (splitting.cut_out(layout, named(spark, "o")), "a")):
        assert [(r.name, r.seq) for r in out.collect()] == [(seqs, "ACGT")]
        assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def named(spark, name):
    return spark.createDataFrame([(name, "ACGT")], "name string, seq string")


def test_large_graphs_are_contracted_and_settled_like_small_ones(spark, monkeypatch):
    rnd = random.Random(8)
    edges = {(f"n{min(a, b)}", f"n{max(a, b)}"): float(rnd.randint(1, 4)) for a, b in ((rnd.randrange(60), rnd.randrange(60)) for _ in range(50)) if a != b}
    edges |= {(f"p{i:03}", f"p{i + 1:03}"): 1.0 for i in range(30)} | {("s0", f"s{i}"): 2.0 for i in range(1, 6)}
    rows = spark.createDataFrame([(*sorted(k), w) for k, w in edges.items()], "u string, v string, weight double")
    monkeypatch.setattr(components, "SMALL", 0)
    monkeypatch.setattr(graph, "SMALL", 0)
    found = graph.matched(rows)
    assert sorted((r.u, r.v) for r in found.collect()) == max_weight_matching([(*k, w) for k, w in edges.items()])
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()  # nothing is done again by its readers
    root = {x: x for k in edges for x in k}
    for _ in root:
        for u, v in edges:
            root[u] = root[v] = min(root[u], root[v])
    assert {r.node: r.root for r in components.components(rows).collect()} == root


def test_alignments_are_dealt_out_once(spark):
    rows = ad.alignments(spark, "/root/testdata/sf0.001")
    plan = alignments.unique_anchors(rows, 200, True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cut_sequences_are_numbered_without_windows_over_stretches(spark):
    rows = spark.createDataFrame([("b", "NNNACNGNNNN"), ("a", "ACNNNNGT"), ("c", ""), ("d", "NN"), ("e", "NNN")], "name string, seq string")
    out = splitting.split_layout(rows, 2)
    want = [("a", 1, 2, 1, "seq00000000"), ("a", 3, 6, 2, None), ("a", 7, 8, 3, "seq00000001"), ("b", 1, 3, 1, None), ("b", 4, 7, 2, "seq00000002"), ("b", 8, 11, 3, None), ("d", 1, 2, 1, "seq00000003"), ("e", 1, 3, 1, None)]
    assert sorted((r.obj, r.obj_beg, r.obj_end, r.pid, r.comp) for r in out.collect()) == want
    # those of the running numbers only
    assert not re.findall(r"Window \[.*windowspecdefinition\((?:name|obj)#", plan_of(out))


def test_depth_is_filled_in_one_pass(spark):
    depth = spark.createDataFrame([("a", 2, 4, 3), ("a", 4, 6, 1), ("a", 8, 9, 2), ("x", 0, 3, 1)], "seq string, start long, end long, depth long")
    lengths = spark.createDataFrame([("a", 10), ("b", 5)], "seq string, query_len long")
    out = breaks.filled(depth, lengths)
    assert sorted(map(tuple, out.collect())) == [("a", 0, 2, 0), ("a", 2, 4, 3), ("a", 4, 6, 1), ("a", 6, 8, 0), ("a", 8, 9, 2), ("a", 9, 10, 0), ("b", 0, 5, 0)]
    assert "Union" not in plan_of(out)


def test_neighbours_keep_only_columns_that_are_read(spark):
    plan = plan_of(graph.adjacencies(ad.layout(spark, "/root/testdata/sf0.001")).select("comp_a", "comp_b"))
    assert set(re.findall(r"lead\((\w+)#", plan)) <= {"pid", "comp", "o"}

import itertools
import random

import pytest

from loomwork.operators import graph, placement
from loomwork.operators.components import components
from loomwork.operators.matching import max_weight_matching
from loomwork.plans import pipelines


def best_weight(nodes, w):
    if not nodes:
        return 0
    u, rest = nodes[0], nodes[1:]
    return max([best_weight(rest, w)] + [w[u, v] + best_weight(tuple(x for x in rest if x != v), w) for v in rest if (u, v) in w])


def test_matching_weighs_as_much_as_brute_force():
    rnd = random.Random(5)
    for _ in range(300):
        n = rnd.randint(2, 8)
        w = {(u, v): rnd.choice([1, 0.75]) * rnd.randint(1, 9) for u, v in itertools.combinations(range(n), 2) if rnd.random() < 0.6}
        got = max_weight_matching([(str(u), str(v), x) for (u, v), x in w.items()])
        assert len({x for p in got for x in p}) == 2 * len(got)
        assert sum(w[tuple(sorted(map(int, p)))] for p in got) == pytest.approx(best_weight(tuple(range(n)), w))


def test_components_match_union_find(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(120), rnd.randrange(120)) for _ in range(80)] + [(200 + i, 201 + i) for i in range(40)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root}


def layout(spark, objects):
    """objects: name to a list of (component, strand) or gap sizes."""
    parts = []
    for obj, items in objects.items():
        for k, x in enumerate(items):
            gap = isinstance(x, int)
            parts.append((obj, k, x if gap else 1000, "N" if gap else "W", None if gap else x[0], None if gap else 1, None if gap else 1000, None if gap else x[1], x if gap else None, "scaffold" if gap else None, "yes" if gap else None, "align_genus" if gap else None))
    schema = "obj string, ord long, length long, comp_type string, comp string, comp_beg long, comp_end long, orientation string, gap_len long, gap_type string, linkage string, linkage_evidence string"
    return placement.laid_out(spark.createDataFrame(parts, schema)).select(*placement.LAYOUT)


def shape(df):
    out = {}
    for r in df.orderBy("obj", "pid").collect():
        out.setdefault(r.obj, []).append((r.comp, r.orientation) if r.comp else r.gap_len)
    return out


def flipped(items):
    return [x if isinstance(x, int) else (x[0], "-" if x[1] == "+" else "+") for x in reversed(items)]


def test_merging_a_layout_with_itself_gives_its_objects(spark):
    objects = {"x": [("a", "+"), 50, ("b", "-"), 70, ("c", "+")], "y": [("d", "-"), ("e", "+")], "z": [("f", "+")]}
    own = layout(spark, objects)
    sequences = spark.createDataFrame([(n, 1000) for n in "abcdef"], "name string, length long")
    got = shape(pipelines.merge([(own, 1.0), (own, 1.0)], sequences, 0))
    want = [x if repr(x) < repr(flipped(x)) else flipped(x) for x in objects.values()]
    assert sorted((x if repr(x) < repr(flipped(x)) else flipped(x) for x in got.values()), key=repr) == sorted(want, key=repr)


def test_cycles_lose_their_lightest_edge(spark):
    edges = spark.createDataFrame([("a_e", "b_b", 3.0), ("b_e", "c_b", 2.0), ("a_b", "c_e", 1.0)], "u string, v string, weight double")
    names = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "name string")
    kept = graph.cover(edges, graph.matched(edges), names).filter("NOT inner").select("u", "v").collect()
    assert {tuple(r) for r in kept} == {("a_e", "b_b"), ("b_e", "c_b")}
    walked = graph.walked(graph.cover(edges, graph.matched(edges), names)).orderBy("root", "place").collect()
    assert [(r.comp, r.strand) for r in walked] == [("a", "+"), ("b", "+"), ("c", "+"), ("d", "+")]


def test_two_gaps_in_a_row_are_an_error(spark):
    with pytest.raises(Exception, match="two gaps"):
        graph.adjacencies(layout(spark, {"x": [("a", "+"), 5, 6, ("b", "+")]})).collect()


def test_graph_checks_nodes(spark):
    sequences = spark.createDataFrame([("a", 10), ("b", 10)], "name string, length long")
    own = graph.realized(graph.adjacencies(layout(spark, {"x": [("a", "+"), 9, ("b", "+")]})))
    g = graph.ScaffoldGraph(sequences, own).checked()
    assert g.has_edge("b_b", "a_e") and not g.has_edge("a_b", "b_b")
    bad = own.selectExpr("'q_e' AS u", "v", "weight", *graph.EVIDENCE)
    with pytest.raises(ValueError):
        g.with_edges(bad).checked()


def test_patch_fills_a_gap(spark):
    """A query spans two target pieces with 30 bases between them."""
    rows = [("q", 2030, 0, 1000, "+", "a", 1000, 0, 1000, 990, 1000, 60, 1), ("q", 2030, 1030, 2030, "+", "b", 1000, 0, 1000, 990, 1000, 60, 2)]
    from loomwork.operators.chaining import SCHEMA

    alns = spark.createDataFrame(rows, SCHEMA)
    target = layout(spark, {"t": [("a", "+"), 100, ("b", "+")], "u": [("c", "+")]})
    sequences = spark.createDataFrame([(n, 1000) for n in "abc"], "name string, length long")
    how = pipelines.Filters(anchor=100, keep_small=False, mapq=10, chain=100)
    got = shape(pipelines.patch(alns, target, sequences, how, length=500, distance=0.05))
    assert sorted(got.values(), key=repr) == [[("a", "+"), ("q", "+"), ("b", "+")], [("c", "+")]]


def test_graph_edges_can_be_read_and_removed(spark):
    rows = [("a_e", "b_b", 1.0, True, 50, "scaffold", True, "map"), ("a_e", "b_b", 2.0, None, 0, None, False, "bookend"), ("b_e", "c_b", 1.0, False, 100, "scaffold", True, "na")]
    edges = spark.createDataFrame(rows, "u string, v string, weight double, known boolean, gap_size long, gap_type string, linkage boolean, linkage_evidence string")
    g = graph.ScaffoldGraph(spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "name string, length long"), edges).checked()
    assert sorted((r.weight, r.gap_size) for r in g.edge("b_b", "a_e").collect()) == [(1.0, 50), (2.0, 0)]
    left = g.without_edges([("b_b", "a_e")])
    assert not left.has_edge("a_e", "b_b") and left.has_edge("c_b", "b_e") and g.without_edges([]).edges.count() == 3
    text = "".join(graph.gml_parts(edges.orderBy("u"), True, graph.EVIDENCE, True))
    assert text.count("edge [") == 2 * 3 + 1 and "directed 1" in text and 'linkageevidence "bookend"' in text and text.count('gapsize "50"') == 2


def test_patch_follows_the_strands_of_its_target(spark):
    targets = layout(spark, {"o": [("x", "+"), 70, ("y", "-"), 80, ("z", "-")]})
    none = spark.createDataFrame([], "query string, query_len long, query_start long, query_end long, strand string, ref string, ref_len long, ref_start long, ref_end long, num_match long, aln_len long, mapq long, line_no long")
    got = pipelines.patch_edges(none, targets)
    assert {(r.u, r.v, r.gap_len) for r in got.collect()} == {("x_e", "y_e", 70), ("y_b", "z_e", 80)}


def test_merge_skips_components(spark):
    one = layout(spark, {"o": [("x", "+"), 70, ("y", "+"), 80, ("z", "+")]})
    lengths = spark.createDataFrame([(n, 1000) for n in "xyz"], "name string, length long")
    skip = spark.createDataFrame([("z",)], "name string")
    got = shape(pipelines.merge([(one, 1.0), (one, 1.0)], lengths, 0, skip=skip))
    assert sorted(got.values(), key=len) == [[("z", "+")], [("x", "+"), 70, ("y", "+")]]


def test_matching_of_odd_rings_and_its_limit(monkeypatch):
    """Rings within rings, where blossoms are closed and opened again."""
    from loomwork.operators import matching

    rnd = random.Random(9)
    for _ in range(40):
        w = {}
        for k in range(3):
            ring = [5 * k + i for i in range(5)]
            for i in range(5):
                w[tuple(sorted((ring[i], ring[(i + 1) % 5])))] = rnd.randint(8, 11)
        for a, b in ((0, 5), (6, 10), (11, 1), (2, 7)):
            w[a, b] = rnd.randint(1, 12)
        w = {tuple(sorted(k)): x for k, x in w.items()}
        got = max_weight_matching([(f"{u:02}", f"{v:02}", x) for (u, v), x in w.items()])
        assert sum(w[tuple(sorted(map(int, p)))] for p in got) == best_weight(tuple(range(15)), w)
    monkeypatch.setattr(matching, "LARGEST", 4)
    with pytest.raises(ValueError, match="more than 4"):
        max_weight_matching([(str(i), str((i + 1) % 5), 1.0) for i in range(5)])

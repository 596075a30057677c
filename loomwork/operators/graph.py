"""Scaffold graphs as edge tables.

A node is an end of a component, ``<name>_b`` or ``<name>_e``. Edges have u < v, a weight and evidence columns.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwork.tables import by_group, dealt, discarded, running, written

from .components import SMALL, components
from .matching import SCALE, max_weight_matching
from .placement import LAYOUT, UNKNOWN_GAP, gap_part, laid_out, sequence_part

EVIDENCE = ("known", "gap_size", "gap_type", "linkage", "linkage_evidence")


def adjacencies(layout: DataFrame) -> DataFrame:
    """Neighbouring components of an object with at most one gap between them: comp_a, strand_a, comp_b, strand_b
    and the gap's data; without a gap the evidence is ``bookend`` and the size 0. Two gaps in a row are an error."""
    order = Window.partitionBy("obj").orderBy("pid")
    # column by column, so that those which nobody reads are not sorted and kept
    after = [F.lead(c, 1).over(order).alias(f"x_{c}") for c in ("pid", "comp", "orientation", "comp_type", "gap_len", "gap_type", "linkage", "linkage_evidence")]
    after += [F.lead(c, 2).over(order).alias(f"y_{c}") for c in ("pid", "comp", "orientation")]
    rows = layout.select("obj", "pid", "comp", "orientation", *after).filter("comp IS NOT NULL AND x_pid IS NOT NULL")
    gap = F.col("x_comp").isNull()
    rows = rows.withColumn("_two", F.when(gap & F.col("y_pid").isNotNull() & F.col("y_comp").isNull(), F.raise_error(F.concat(F.lit("two gaps in a row in "), "obj"))).otherwise(F.lit(False))).filter("NOT _two")
    rows = rows.filter(~gap | F.col("y_comp").isNotNull())
    return rows.select(
        F.col("comp").alias("comp_a"), F.col("orientation").alias("strand_a"),
        F.when(gap, F.col("y_comp")).otherwise(F.col("x_comp")).alias("comp_b"),
        F.when(gap, F.col("y_orientation")).otherwise(F.col("x_orientation")).alias("strand_b"),
        F.when(gap, F.col("x_comp_type") == "N").alias("known"),
        F.when(gap, F.col("x_gap_len")).otherwise(0).alias("gap_size"),
        F.when(gap, F.col("x_gap_type")).alias("gap_type"),
        F.when(gap, F.col("x_linkage") == "yes").otherwise(F.lit(False)).alias("linkage"),
        F.when(gap, F.col("x_linkage_evidence")).otherwise(F.lit("bookend")).alias("linkage_evidence"),
    )


def component_problems(layout: DataFrame, sequences: DataFrame) -> DataFrame:
    """(comp, problem): components that the sequences (name, length) lack, that end before their sequence does,
    and sequences that the layout lacks."""
    comps = layout.filter("comp IS NOT NULL").select("comp", "comp_end")
    both = comps.join(sequences.select(F.col("name"), F.col("length").alias("size")), F.col("comp") == F.col("name"), "full")
    problem = F.when(F.col("name").isNull(), "no such sequence").when(F.col("comp").isNull(), "not laid out").when(F.col("comp_end") != F.col("size"), "incomplete")
    return both.select(F.coalesce("comp", "name").alias("comp"), problem.alias("problem")).filter("problem IS NOT NULL")


def realized(points: DataFrame, weight: Column | float = 1.0) -> DataFrame:
    """Edges for adjacencies: an unknown strand stands for both, at three quarters of the weight."""
    both = lambda c: F.when(F.col(c).isin("+", "-"), F.array(F.col(c))).otherwise(F.array(F.lit("+"), F.lit("-")))
    sure = F.col("strand_a").isin("+", "-") & F.col("strand_b").isin("+", "-")
    w = weight if isinstance(weight, Column) else F.lit(float(weight))
    rows = points.withColumns({"_w": F.when(sure, w).otherwise(w * 0.75), "_a": F.explode(both("strand_a"))}).withColumn("_b", F.explode(both("strand_b")))
    a = F.concat("comp_a", F.when(F.col("_a") == "+", "_e").otherwise("_b"))
    b = F.concat("comp_b", F.when(F.col("_b") == "+", "_b").otherwise("_e"))
    return rows.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"), F.col("_w").alias("weight"), *EVIDENCE)


def merged(edges: DataFrame) -> DataFrame:
    """Parallel edges as one: the sum of the weights, and all evidence."""
    return edges.groupBy("u", "v").agg(F.sum("weight").alias("weight"), F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("weight", *EVIDENCE))).alias("evidence"))


def base(node: Column) -> Column:
    return F.substr(node, F.lit(1), F.length(node) - 2)


def incident(edges: DataFrame) -> DataFrame:
    """Each edge from both its nodes: node, other, weight."""
    return edges.select(F.col("u").alias("node"), F.col("v").alias("other"), "weight").unionByName(edges.select(F.col("v").alias("node"), F.col("u").alias("other"), "weight"))


def node_summary(edges: DataFrame) -> DataFrame:
    """Per node: degree and heaviest incident weight."""
    return incident(edges).groupBy("node").agg(F.count("*").alias("degree"), F.max("weight").alias("heaviest"))


def lightened(edges: DataFrame, least: float | None = None, most: float | None = None) -> DataFrame:
    """Edges with weights of at least ``least`` and at most ``most``."""
    if least is not None:
        edges = edges.filter(F.col("weight") >= least)
    return edges if most is None else edges.filter(F.col("weight") <= most)


def of_long_components(edges: DataFrame, sequences: DataFrame, length: int) -> DataFrame:
    """Edges between components of at least ``length``."""
    long = sequences.filter(F.col("length") >= length).select("name")
    for node in ("u", "v"):
        edges = edges.join(dealt(long), base(F.col(node)) == F.col("name"), "left_semi")
    return edges


def without_components(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Edges that touch none of the components (name)."""
    for node in ("u", "v"):
        edges = edges.join(dealt(names.select("name")), base(F.col(node)) == F.col("name"), "left_anti")
    return edges


def best_buddy(edges: DataFrame) -> DataFrame:
    """Edges with weights divided by that of the best alternative: the heaviest edge at either node, or, if that
    weighs the same as the edge, the heaviest other one at either node; 1 if there is none. Simple edges."""
    near = incident(edges)
    top = Window.partitionBy("node").orderBy(F.desc("weight"), "other")
    two = near.withColumn("_r", F.row_number().over(top)).filter("_r <= 2").groupBy("node").agg(F.max_by("other", -F.col("_r")).alias("first"), F.max("weight").alias("w1"), F.max(F.when(F.col("_r") == 2, F.col("weight"))).alias("w2"))
    rows = edges
    for node, other in (("u", "v"), ("v", "u")):
        side = two.select(F.col("node").alias(f"_{node}"), F.col("first").alias(f"_{node}f"), F.col("w1").alias(f"_{node}1"), F.col("w2").alias(f"_{node}2"))
        rows = rows.join(dealt(side), F.col(node) == F.col(f"_{node}")).withColumn(f"_{node}o", F.when(F.col(f"_{node}f") == F.col(other), F.coalesce(f"_{node}2", F.lit(0.0))).otherwise(F.col(f"_{node}1")))
    alternative = F.greatest("_u1", "_v1")
    alternative = F.when(alternative == F.col("weight"), F.greatest("_uo", "_vo")).otherwise(alternative)
    alternative = F.when(alternative == 0, 1.0).otherwise(alternative)
    return rows.select(*(F.col(c) if c != "weight" else (F.col("weight") / alternative).alias("weight") for c in edges.columns))


def reweighted(edges: DataFrame, by: DataFrame) -> DataFrame:
    """Edges that both tables have, with the weights of the second."""
    return edges.drop("weight").join(dealt(by.select("u", "v", "weight")), ["u", "v"]).select(*edges.columns)


def _settled(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round of what matching.max_weight_matching settles without a search, over all components: the pairs, and the
    edges that are left. An edge settles that weighs at least as much as the next heaviest at both its nodes together.
    Edges that settle at one node weigh the same and have no other edge at their far ends; the first by name counts."""
    near = edges.select(F.col("u").alias("node"), "w").unionByName(edges.select(F.col("v").alias("node"), "w"))
    top = Window.partitionBy("node").orderBy(F.desc("w"))
    two = near.withColumn("_r", F.row_number().over(top)).filter("_r <= 2").groupBy("node").agg(F.max("w").alias("w1"), F.coalesce(F.max(F.when(F.col("_r") == 2, F.col("w"))), F.lit(0)).alias("w2"))
    two, rows = written(two, "heaviest"), edges
    for node in ("u", "v"):
        side = two.select(F.col("node").alias(node), F.col("w1").alias("_w1"), F.col("w2").alias("_w2"))
        rows = rows.join(dealt(side), node).withColumn(f"_{node}", F.when(F.col("w") == F.col("_w1"), F.col("_w2")).otherwise(F.col("_w1"))).drop("_w1", "_w2")
    sure = rows.filter("w >= _u + _v").select("u", "v", F.explode(F.array("u", "v")).alias("node"))
    first = sure.withColumn("_r", F.row_number().over(Window.partitionBy("node").orderBy("u", "v"))).filter("_r = 1")
    pairs = written(first.groupBy("u", "v").count().filter("count = 2").select("u", "v"), "settled")
    gone = pairs.select(F.explode(F.array("u", "v")).alias("node"))
    left = edges
    for node in ("u", "v"):
        left = left.join(dealt(gone.withColumnRenamed("node", node)), node, "left_anti")
    left = written(left.select(*edges.columns), "unsettled")
    discarded(two)
    return pairs, left


def matched(edges: DataFrame) -> DataFrame:
    """Edges of a matching of greatest weight: u, v. Pairs that need no search are settled over the whole table, round
    by round while a round settles much; the rest is matched component by component, one component in one task."""
    weight = F.col("weight").cast("double")
    left = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), weight.alias("weight")).filter("u <> v AND weight > 0")
    left = written(left.groupBy("u", "v").agg(F.max("weight").alias("weight")).withColumn("w", F.rint(F.col("weight") * SCALE).cast("long")), "unsettled")
    found, n = None, left.count()
    while n > SMALL:
        pairs, rest = _settled(left)
        discarded(left)
        found, left = pairs if found is None else found.unionByName(pairs), rest
        before, n = n, left.count()
        if 50 * (before - n) < before:
            break
    parts = left.join(dealt(components(left)), F.col("u") == F.col("node")).select("root", "u", "v", "weight")

    def solve(part: dict[str, list]) -> list[tuple[str, str]]:
        return max_weight_matching(list(zip(part["u"], part["v"], part["weight"], strict=True)))

    searched = written(by_group(parts, "root", [], solve, "u string, v string"), "matched")
    return searched if found is None else found.unionByName(searched)


def cover(edges: DataFrame, matching: DataFrame, names: DataFrame) -> DataFrame:
    """The cover graph: components (name) joined end to end, and the matching without the lightest edge of each
    cycle. u, v, inner, root (its path)."""
    kept = edges.select("u", "v", F.col("weight").cast("double").alias("weight"), F.lit(False).alias("inner")).join(dealt(matching), ["u", "v"], "left_semi")
    inner = names.select(F.concat("name", F.lit("_b")).alias("u"), F.concat("name", F.lit("_e")).alias("v"), F.lit(None).cast("double").alias("weight"), F.lit(True).alias("inner"))
    both = written(kept.unionByName(inner), "cover")
    # every component has an inner edge; a cycle has as many edges as nodes
    placed = both.join(dealt(components(both)), F.col("u") == F.col("node")).drop("node")
    placed = written(placed, "placed")
    discarded(both)
    shape = placed.groupBy("root").agg(F.count("*").alias("n"), F.sum(F.when(F.col("inner"), 1).otherwise(0)).alias("inners"), F.min(F.when(~F.col("inner"), F.struct("weight", "u", "v"))).alias("light"))
    cut = shape.filter("n = 2 * inners").select("light.u", "light.v")
    return placed.join(dealt(cut.withColumn("_cut", F.lit(True))), ["u", "v"], "left").filter("inner OR _cut IS NULL").select("u", "v", "inner", "weight", "root")


def walked(cover_edges: DataFrame) -> DataFrame:
    """The paths of a cover graph: root, place, comp, strand, and the edge (u, v) to the next component. A path
    begins at its smallest free end."""

    def walk(part: dict[str, list]) -> list[tuple]:
        join: dict[str, str] = {}
        ends = set()
        for u, v, inner in zip(part["u"], part["v"], part["inner"], strict=True):
            if inner:
                ends |= {u, v}
            else:
                join[u], join[v] = v, u
        other = lambda x: x[:-2] + ("_e" if x.endswith("_b") else "_b")
        out, now, place = [], min(x for x in ends if x not in join), 1
        while True:
            far = other(now)
            nxt = join.get(far)
            out.append((part["root"][0], place, now[:-2], "+" if now.endswith("_b") else "-", min(far, nxt) if nxt else None, max(far, nxt) if nxt else None))
            if nxt is None:
                return out
            now, place = nxt, place + 1

    return written(by_group(cover_edges.select("root", "u", "v", "inner"), "root", [], walk, "root string, place long, comp string, strand string, u string, v string"), "paths")


def resolved_gap(evidence: Column, how: str = "min") -> Column:
    """What merged evidence says of a gap: known if any is; its size from the known ones (min, max or mean, cut to
    an integer), else unknown; its type if all agree, else scaffold; linkage if any; evidence without ``na``. A
    neighbourhood that is a bookend in all has no gap (null)."""
    if how not in ("min", "max", "mean"):
        raise ValueError("how is min, max or mean")
    sizes = F.transform(F.filter(evidence, lambda x: F.coalesce(x["known"], F.lit(False))), lambda x: x["gap_size"])
    size = {"min": F.array_min(sizes), "max": F.array_max(sizes), "mean": (F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x) / F.size(sizes)).cast("long")}[how]
    known = F.size(sizes) > 0
    types = F.array_distinct(F.transform(evidence, lambda x: x["gap_type"]))
    says = F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter(evidence, lambda x: x["linkage_evidence"] != "bookend"), lambda x: F.split(x["linkage_evidence"], ";")))))
    says = F.filter(says, lambda x: x != "na")
    link = F.exists(evidence, lambda x: x["linkage"])
    bookend = F.forall(evidence, lambda x: x["linkage_evidence"] == "bookend")
    gap = F.struct(
        F.when(known, "N").otherwise("U").alias("comp_type"),
        F.when(known, size).otherwise(UNKNOWN_GAP).cast("long").alias("gap_len"),
        F.when((F.size(types) == 1) & types[0].isNotNull(), types[0]).otherwise("scaffold").alias("gap_type"),
        F.when(link, "yes").otherwise("no").alias("linkage"),
        F.when(F.size(says) > 0, F.array_join(says, ";")).otherwise("na").alias("linkage_evidence"),
    )
    return F.when(~bookend, gap)


def path_layout(paths: DataFrame, merged_edges: DataFrame, sequences: DataFrame, how: str = "min", prefix: str = "scf", suffix: str = "_placed") -> DataFrame:
    """The layout of walked paths, numbered from 1 in order of their roots."""
    rows = paths.join(dealt(sequences.select(F.col("name").alias("comp"), F.col("length").cast("long").alias("length"))), "comp")
    rows = rows.join(dealt(merged_edges.select("u", "v", resolved_gap(F.col("evidence"), how).alias("gap"))), ["u", "v"], "left")
    number = running(paths.select("root").distinct(), ["root"], "_before").withColumn("_k", F.col("_before") + 1).drop("_before")
    rows = rows.join(dealt(number), "root")
    seq = sequence_part(F.col("comp"), F.col("length"), F.col("strand"), 2 * F.col("place"))
    gap = gap_part(F.col("gap.comp_type"), F.col("gap.gap_len"), 2 * F.col("place") + 1, F.col("gap.gap_type"), F.col("gap.linkage"), F.col("gap.linkage_evidence"))
    both = F.explode(F.when(F.col("gap").isNull(), F.array(seq)).otherwise(F.array(seq, gap)))
    obj = F.concat(F.lit(prefix), F.lpad(F.col("_k").cast("string"), 8, "0"), F.lit(suffix))
    return laid_out(rows.select(obj.alias("obj"), both.alias("p")).select("obj", "p.*")).select(*LAYOUT)


class ScaffoldGraph:
    """A graph over an edge table and the components it may use. Methods return new graphs."""

    REQUIRED = ("weight", *EVIDENCE)

    def __init__(self, sequences: DataFrame, edges: DataFrame) -> None:
        missing = {"u", "v", *self.REQUIRED} - set(edges.columns)
        if missing:
            raise ValueError(f"edges lack {sorted(missing)}")
        self.sequences, self.edges = sequences, edges

    def checked(self) -> ScaffoldGraph:
        """This graph, or an error if a node isn't an end of a known component."""
        nodes = self.nodes().select(base(F.col("node")).alias("name"), F.col("node").rlike("_[be]$").alias("ok"))
        bad = nodes.filter("NOT ok").limit(1).count() or nodes.join(self.sequences, "name", "left_anti").limit(1).count()
        if bad:
            raise ValueError("a node isn't an end of a component")
        return self

    def with_edges(self, edges: DataFrame) -> ScaffoldGraph:
        return ScaffoldGraph(self.sequences, self.edges.unionByName(edges.select("u", "v", *self.REQUIRED)))

    def without_nodes(self, names: Iterable[str]) -> ScaffoldGraph:
        names = list(names)
        return ScaffoldGraph(self.sequences, self.edges.filter(~F.col("u").isin(names) & ~F.col("v").isin(names)))

    def without_edges(self, pairs: Iterable[tuple[str, str]]) -> ScaffoldGraph:
        """Without all edges, parallel ones included, between the nodes of each pair. A short list."""
        gone = [F.struct(F.lit(min(p)).alias("u"), F.lit(max(p)).alias("v")) for p in pairs]
        return self if not gone else ScaffoldGraph(self.sequences, self.edges.filter(~F.struct("u", "v").isin(*gone)))

    def edge(self, u: str, v: str) -> DataFrame:
        """The attributes of the edges between two nodes: weight and evidence, one row for each."""
        return self.edges.filter((F.col("u") == min(u, v)) & (F.col("v") == max(u, v))).select(*self.REQUIRED)

    def has_edge(self, u: str, v: str) -> bool:
        return bool(self.edges.filter((F.col("u") == min(u, v)) & (F.col("v") == max(u, v))).head(1))

    def nodes(self) -> DataFrame:
        return self.edges.select(F.col("u").alias("node")).unionByName(self.edges.select(F.col("v").alias("node"))).distinct()

    def neighbours(self, node: str) -> DataFrame:
        return incident(self.edges).filter(F.col("node") == node).select("other").distinct()

    def degrees(self) -> DataFrame:
        return node_summary(self.edges)

    def merged(self) -> DataFrame:
        return merged(self.edges)


def gml(edges: list[tuple[str, str, float]], with_inner: bool = False) -> str:
    """A small graph as GML text."""
    nodes = sorted({x for u, v, _ in edges for x in (u, v)})
    number = {x: i for i, x in enumerate(nodes)}
    out = ["graph ["] + [f'  node [\n    id {i}\n    label "{x}"\n  ]' for x, i in number.items()]
    lines = [(number[u], number[v], str(w)) for u, v, w in sorted(edges)]
    if with_inner:
        lines += [(number[x], number[x[:-2] + "_e"], "inf") for x in nodes if x.endswith("_b") and x[:-2] + "_e" in number]
    out += [f'  edge [\n    source {a}\n    target {b}\n    weight "{w}"\n  ]' for a, b, w in lines]
    return "\n".join([*out, "]"]) + "\n"


def gml_parts(edges: DataFrame, with_inner: bool = False, attributes: tuple[str, ...] = (), both_ways: bool = False) -> Iterator[str]:
    """A graph of any size (u, v, weight) as GML text in parts; the driver holds a partition at a time. ``attributes``
    are further columns, written where they aren't null; both_ways writes a directed graph, each edge there and back."""
    nodes = edges.select(F.col("u").alias("node")).unionByName(edges.select(F.col("v").alias("node"))).distinct().orderBy("node")
    nodes = written(nodes.withColumns({"_pid": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "nodes")
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    starts = nodes.groupBy("_pid").agg(F.count("*").alias("_n")).select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    nodes = nodes.join(F.broadcast(starts), "_pid").select("node", (F.col("_start") + F.col("_at")).alias("id"))
    left, right = (nodes.select(F.col("node").alias(k), F.col("id").alias(f"{k}_id")) for k in "uv")
    lines = edges.select("u", "v", "weight", *attributes).join(left, "u").join(right, "v").orderBy("u", "v", "weight", *attributes)
    yield "graph [\n  directed 1\n" if both_ways else "graph [\n"
    for x in nodes.orderBy("id").toLocalIterator():
        yield f'  node [\n    id {x.id}\n    label "{x.node}"\n  ]\n'
    for x in lines.toLocalIterator():
        more = "".join(f'    {name.replace("_", "")} "{x[name]}"\n' for name in attributes if x[name] is not None)
        for a, b in ((x.u_id, x.v_id), (x.v_id, x.u_id))[: 2 if both_ways else 1]:
            yield f'  edge [\n    source {a}\n    target {b}\n    weight "{x.weight}"\n{more}  ]\n'
    if with_inner:
        begins = nodes.filter(F.col("node").endswith("_b")).select(F.expr("concat(left(node, length(node) - 2), '_e')").alias("node"), F.col("id").alias("begin"))
        for x in begins.join(nodes, "node").orderBy("begin").toLocalIterator():
            yield f'  edge [\n    source {x.begin}\n    target {x.id}\n    weight "inf"\n  ]\n'
    yield "]\n"

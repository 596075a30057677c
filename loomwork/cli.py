"""Commands over files: ``python -m loomwork COMMAND ...``."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions import sequences as fs
from loomwork.operators import agp, breaks, graph, links, liftover, splitting, stats
from loomwork.plans import pipelines
from loomwork.sources import readers as r
from loomwork.sources import writers as w
from loomwork.tables import written

log = logging.getLogger("loomwork")


def _names(spark: SparkSession, path: str | None) -> DataFrame | None:
    return r.read_names(spark, path, whole_line=True) if path else None


def _filters(a: argparse.Namespace) -> pipelines.Filters:
    return pipelines.Filters(a.anchor, a.keep_small, a.mapq, a.chain)


def scaffold(spark: SparkSession, a: argparse.Namespace) -> None:
    seqs = r.read_fasta(spark, a.query)
    out = pipelines.scaffold(r.read_paf(spark, a.paf), seqs, _filters(a), a.grouping, a.location, a.orientation, a.infer_gaps, a.smallest, a.largest, a.suffix, a.concatenate, _names(spark, a.skip_queries), _names(spark, a.skip_refs))
    if not out.confidence.head(1):
        raise SystemExit("no useful alignments")
    w.write_agp(out.layout, f"{a.out}/layout.agp", mode=a.mode)
    w.write_table(out.confidence, f"{a.out}/confidence.tsv", mode=a.mode)
    w.write_table(out.stats, f"{a.out}/stats.tsv", mode=a.mode)
    w.write_fasta(splitting.built(r.read_agp(spark, f"{a.out}/layout.agp"), seqs), f"{a.out}/scaffolds.fasta", mode=a.mode)


def correct(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.only and a.only not in ("intra", "inter"):
        raise SystemExit("only intra or inter")
    seqs = r.read_fasta(spark, a.query)
    depth = limits = features = None
    if a.reads or a.reads_list:
        depth = written(r.read_depth(spark, r.read_file_names(spark, a.reads_list) if a.reads_list else [a.reads]), "depth")
        limits = breaks.thresholds(breaks.median_coverage(breaks.histogram(depth)))
    if a.gff:
        features = r.read_gff(spark, a.gff).select(F.col("seqid").alias("seq"), (F.col("start") - 1).alias("start"), "end")
    layout = pipelines.correct(r.read_paf(spark, a.paf), seqs, _filters(a), a.from_end, (a.only,) if a.only else ("intra", "inter"), depth, limits, a.window, max(1, a.clamp), a.spacing, features)
    w.write_agp(layout, f"{a.out}/layout.agp", mode=a.mode)
    w.write_fasta(splitting.cut_out(r.read_agp(spark, f"{a.out}/layout.agp"), seqs), f"{a.out}/corrected.fasta", mode=a.mode)


def merge(spark: SparkSession, a: argparse.Namespace) -> None:
    seqs = r.read_fasta(spark, a.query)
    if a.weights:
        layouts = [(r.read_agp(spark, x.agp_path), x.weight) for x in r.read_weights(spark, a.weights).collect()]
    else:
        if len(set(a.agp)) < len(a.agp):
            raise SystemExit("a layout is given twice")
        layouts = [(r.read_agp(spark, p), 1.0) for p in a.agp]
    for layout, _ in layouts:
        agp.require_valid(layout)
    found = r.read_links(spark, a.links) if a.links else None
    w.write_agp(pipelines.merge(layouts, seqs, a.shortest, a.least, found, a.gap_size, a.suffix, r.read_names(spark, a.skip_components) if a.skip_components else None), f"{a.out}/layout.agp", mode=a.mode)


def patch(spark: SparkSession, a: argparse.Namespace) -> None:
    target = r.read_fasta(spark, a.target)
    pieces = splitting.split_layout(target)
    own = splitting.cut_out(pieces, target)
    both = own.unionByName(r.read_fasta(spark, a.query).select("name", "seq")).withColumn("length", F.length("seq").cast("long"))
    layout = pipelines.patch(r.read_paf(spark, a.paf), pieces, both, _filters(a), a.length, a.distance, a.fill_only, a.join_only)
    w.write_agp(layout, f"{a.out}/layout.agp", mode=a.mode)
    w.write_fasta(splitting.built(r.read_agp(spark, f"{a.out}/layout.agp"), both), f"{a.out}/patched.fasta", mode=a.mode)


def createlinks(spark: SparkSession, a: argparse.Namespace) -> None:
    seqs = r.read_fasta(spark, a.query)
    raw = links.link_counts(links.mate_pairs(r.read_sam(spark, a.reads)), seqs, a.share)
    norms = links.site_norms(seqs.withColumn("sites", fs.site_starts(F.col("seq"), fs.sites_pattern(a.enzymes.split(",")))), a.share) if a.enzymes else links.length_norms(seqs, a.share)
    w.write_table(links.normalised(raw, norms).select("u", "v", "weight", "raw"), a.out, header=False, mode=a.mode)


def agp2fa(spark: SparkSession, a: argparse.Namespace) -> None:
    w.write_fasta(splitting.built(r.read_agp(spark, a.agp), r.read_fasta(spark, a.query)), a.out, mode=a.mode)


def breakquery(spark: SparkSession, a: argparse.Namespace) -> None:
    w.write_fasta(splitting.cut_out(r.read_agp(spark, a.agp), r.read_fasta(spark, a.query)), a.out, mode=a.mode)


def agpcheck(spark: SparkSession, a: argparse.Namespace) -> None:
    for path in a.agp:
        bad = agp.line_violations(r.agp_lines(spark, path)).select("line_no", "rule").unionByName(agp.violations(r.read_agp(spark, path)).select("line_no", "rule")).orderBy("line_no", "rule").head(1)
        if bad:
            raise SystemExit(f"{path}, line {bad[0].line_no}: {bad[0].rule}")
        log.info("%s is valid", path)


def asmstats(spark: SparkSession, a: argparse.Namespace) -> None:
    for path in a.files:
        stats.assembly_stats(r.read_lengths(spark, path), a.genome_size).show(truncate=False)


def splitasm(spark: SparkSession, a: argparse.Namespace) -> None:
    seqs = r.read_fasta(spark, a.query)
    layout = splitting.split_layout(seqs, a.smallest)
    w.write_agp(layout, f"{a.out}/layout.agp", mode=a.mode)
    w.write_fasta(splitting.cut_out(layout, seqs), f"{a.out}/split.fasta", mode=a.mode)


def delta2paf(spark: SparkSession, a: argparse.Namespace) -> None:
    w.write_paf(r.delta_as_alignments(r.read_delta(spark, a.delta)), a.out, mode=a.mode)


def paf2delta(spark: SparkSession, a: argparse.Namespace) -> None:
    w.write_delta(r.read_paf(spark, a.paf), a.out, mode=a.mode)


def updategff(spark: SparkSession, a: argparse.Namespace) -> None:
    move = liftover.to_pieces if a.to_pieces else liftover.to_objects
    w.write_table(move(r.read_gff(spark, a.gff), r.read_agp(spark, a.agp)).drop("line_no", "problem"), a.out, header=False, mode=a.mode)


def rename(spark: SparkSession, a: argparse.Namespace) -> None:
    w.write_fasta(splitting.renamed(r.read_fasta(spark, a.query), a.prefix), a.out, mode=a.mode)


def scaffoldstats(spark: SparkSession, a: argparse.Namespace) -> None:
    agp.scaffolding_stats(r.read_agp(spark, a.agp), r.read_confidence(spark, a.confidence)).show(truncate=False)


def writegml(spark: SparkSession, a: argparse.Namespace) -> None:
    edges = graph.realized(graph.adjacencies(r.read_agp(spark, a.agp)))
    evidence = graph.EVIDENCE if a.evidence else ()
    edges = written(edges.select("u", "v", "weight", *evidence) if a.evidence else graph.merged(edges).select("u", "v", "weight"), "edges")
    if a.most and (n := edges.count()) > a.most:
        raise SystemExit(f"{n} edges, more than {a.most}")
    with open(a.out, "w") as f:
        f.writelines(graph.gml_parts(edges, True, evidence, a.both_ways))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="loomwork")
    subs = top.add_subparsers(dest="command", required=True)

    def add(f, *positional: str, out: bool = True, filters: bool = False, **options):
        p = subs.add_parser(f.__name__)
        p.set_defaults(run=f)
        for name in positional:
            p.add_argument(name.rstrip("+"), nargs="+" if name.endswith("+") else None)
        if out:
            p.add_argument("--out", required=True)
            p.add_argument("--mode", choices=("error", "ignore", "overwrite"), default="ignore")
        for name, value in options.items() | ({"anchor": 1000, "keep_small": True, "mapq": 10, "chain": 100_000}.items() if filters else set()):
            flag = f"--{name.replace('_', '-')}"
            if isinstance(value, bool):
                p.add_argument(flag, action=argparse.BooleanOptionalAction, default=value)
            else:
                p.add_argument(flag, default=value, type=str if value is None else type(value))

    add(scaffold, "paf", "query", filters=True, grouping=0.2, location=0.0, orientation=0.0, infer_gaps=False, smallest=100, largest=100_000, suffix="_placed", concatenate=None, skip_queries=None, skip_refs=None)
    add(correct, "paf", "query", filters=True, from_end=5000, only=None, reads=None, reads_list=None, gff=None, window=10_000, clamp=1000, spacing=1000)
    add(merge, "query", "agp+", weights=None, links=None, shortest=100_000, least=0.0, gap_size="min", suffix="_placed", skip_components=None)
    add(patch, "paf", "target", "query", filters=True, length=50_000, distance=0.05, fill_only=False, join_only=False)
    add(createlinks, "query", "reads", share=1.0, enzymes="GATC")
    add(agp2fa, "agp", "query")
    add(breakquery, "agp", "query")
    add(agpcheck, "agp+", out=False)
    add(asmstats, "files+", out=False, genome_size=0)
    add(splitasm, "query", smallest=0)
    add(delta2paf, "delta")
    add(paf2delta, "paf")
    add(updategff, "gff", "agp", to_pieces=False)
    add(rename, "query", prefix="seq")
    add(scaffoldstats, "agp", "confidence", out=False)
    add(writegml, "agp", most=0, evidence=False, both_ways=False)
    return top


def main(args: list[str] | None = None) -> None:
    logging.basicConfig(level=logging.INFO)
    found = parser().parse_args(args)
    found.run(SparkSession.builder.appName(f"loomwork {found.command}").getOrCreate(), found)

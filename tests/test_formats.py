import gzip
import random

import pytest

from loomwork.functions import sequences as fs
from loomwork.operators import agp, breaks, intervals, liftover, splitting
from loomwork.sources import readers, writers
from loomwork.tables import running
from pyspark.sql import functions as F


def test_paf_and_lists(spark, tmp_path):
    (tmp_path / "a.paf").write_text("q1\t100\t0\t50\t+\tr1\t500\t10\t60\t45\t50\t60\tNM:i:5\tcg:Z:50M\nq2\t80\t5\t20\t-\tr1\t500\t100\t115\t15\t15\t3\n")
    rows = readers.read_paf(spark, str(tmp_path / "a.paf")).orderBy("line_no").collect()
    assert (rows[0].query, rows[0].ref_end, rows[0].tags["cg"], rows[1].line_no) == ("q1", 60, "50M", 2)
    (tmp_path / "bad.paf").write_text("q1\t100\t60\t50\t+\tr1\t500\t10\t60\t45\t50\t60\n")
    with pytest.raises(Exception, match="start after end"):
        readers.read_paf(spark, str(tmp_path / "bad.paf")).collect()
    (tmp_path / "names").write_text("x one\n\ny\n")
    assert [r.name for r in readers.read_names(spark, str(tmp_path / "names")).collect()] == ["x", "y"]


def test_fasta_round_trip_and_lengths(spark, tmp_path):
    with gzip.open(tmp_path / "s.fa.gz", "wt") as f:
        f.write(">s1 text\nACGT\nAC\n>s2\nNNN\n")
    seqs = readers.read_fasta(spark, str(tmp_path / "s.fa.gz"))
    assert [(r.seq_ix, r.name, r.seq, r.length) for r in seqs.orderBy("seq_ix").collect()] == [(0, "s1", "ACGTAC", 6), (1, "s2", "NNN", 3)]
    writers.write_fasta(seqs, str(tmp_path / "out"))
    assert [(r.name, r.seq) for r in readers.read_fasta(spark, str(tmp_path / "out")).orderBy("seq_ix").collect()] == [("s1", "ACGTAC"), ("s2", "NNN")]
    (tmp_path / "g.gfa").write_text("H\tVN:Z:1\nS\ta\tACGT\nS\tb\t*\tLN:i:9\n")
    assert sorted(r.length for r in readers.read_lengths(spark, str(tmp_path / "g.gfa")).collect()) == [4, 9]
    with pytest.raises(ValueError):
        readers.read_lengths(spark, "x.txt")


def test_agp_round_trip_and_line_rules(spark, tmp_path):
    text = "## agp-version 2.1\n# own\no\t1\t10\t1\tW\tc\t1\t10\t+\no\t11\t20\t2\tN\t10\tscaffold\tyes\talign_genus\no\t21\t25\t3\tW\td\t1\t5\t-\n"
    (tmp_path / "a.agp").write_text(text)
    layout = readers.read_agp(spark, str(tmp_path / "a.agp"))
    assert agp.violations(layout).count() == 0
    agp.require_valid(layout)
    writers.write_agp(layout, str(tmp_path / "out"), ("# own",))
    assert "\n".join(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) + "\n" == text
    (tmp_path / "b.agp").write_text("o\t1\t10\t1\tW\tc\t1\t10\t+\n# late\no\t11\n\to\t1\t1\t1\tW\tc\t1\t1\n")
    rules = {(r.line_no, r.rule) for r in agp.line_violations(readers.agp_lines(spark, str(tmp_path / "b.agp"))).collect()}
    assert rules == {(2, "comment in the body"), (3, "not 9 fields"), (4, "empty field")}


def test_delta_round_trip(spark, tmp_path):
    text = "a.fa b.fa\nNUCMER\n>r1 q1 500 300\n1 30 1 30 2 2 0\n5\n-3\n0\n40 60 90 70 1 1 0\n0\n>r2 q1 80 300\n1 10 1 10 0 0 0\n0\n"
    (tmp_path / "x.delta").write_text(text)
    rows = readers.delta_as_alignments(readers.read_delta(spark, str(tmp_path / "x.delta")))
    got = {(r.ref, r.ref_start): r for r in rows.collect()}
    first = got["r1", 0]
    assert (first.tags["cg"], first.aln_len, first.num_match, first.strand) == ("4M1D2M1I23M", 31, 29, "+")
    assert got["r1", 39].strand == "-"
    writers.write_delta(rows, str(tmp_path / "out"), ("a.fa", "b.fa"))
    assert "\n".join(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) + "\n" == text


def test_cigar_offsets_are_inverse(spark):
    rnd = random.Random(1)
    rows = [([rnd.choice([-1, 1]) * rnd.randint(1, 9) for _ in range(rnd.randrange(8))],) for _ in range(60)]
    df = spark.createDataFrame(rows, "o array<bigint>").withColumn("c", fs.cigar_from_offsets(F.col("o"), F.lit(200).cast("long")))
    for r in df.withColumn("b", fs.offsets_from_cigar(F.col("c"))).collect():
        assert r.b == r.o, r
    with pytest.raises(Exception, match="unknown operation"):
        spark.range(1).select(fs.offsets_from_cigar(F.lit("5M3P"))).collect()


def test_split_then_build_gives_the_sequence(spark):
    rnd = random.Random(4)
    rows = [(f"s{i}", "".join(rnd.choice(["ACG", "N" * rnd.randint(1, 9), "t"]) for _ in range(rnd.randrange(1, 30)))) for i in range(20)]
    seqs = spark.createDataFrame(rows, "name string, seq string")
    layout = splitting.split_layout(seqs, 3)
    assert agp.violations(layout.withColumn("line_no", F.row_number().over(__import__("pyspark").sql.Window.orderBy("obj", "pid")))).filter("rule <> 'unknown gap not of 100'").count() == 0
    back = splitting.built(layout, splitting.cut_out(layout, seqs))
    assert {r.name: r.seq for r in back.collect()} == dict(rows)


def test_interval_joins_match_brute_force(spark):
    rnd = random.Random(6)
    boxes = [(rnd.choice("ab"), s := rnd.randrange(300), s + rnd.randrange(40), i) for i in range(80)]
    points = [(rnd.choice("abc"), rnd.randrange(340), i) for i in range(120)]
    b, p = spark.createDataFrame(boxes, "seq string, start long, end long, k long"), spark.createDataFrame(points, "seq string, pos long, n long")
    want = {(n, k) for s, x, n in points for t, lo, hi, k in boxes if s == t and lo <= x < hi}
    assert {(r.n, r.i_k) for r in intervals.stabbing(p, b, 16).collect()} == want
    assert {r.n for r in intervals.unstabbed(p, b, 16).collect()} == {n for _, _, n in points} - {n for n, _ in want}
    pairs = sorted((i, k) for s, lo, hi, i in boxes for t, a, z, k in boxes if s == t and lo < z and a < hi)
    assert sorted((r.k, r.r_k) for r in intervals.overlapping(b, b, 16).collect()) == pairs


def test_annotated_bases_survive_lifting(spark):
    """The bases under a feature are the same after its sequence is cut and the pieces are laid out reversed."""
    rnd = random.Random(8)
    seq = "".join(rnd.choice("ACGT") for _ in range(90))
    seqs = spark.createDataFrame([("q", seq, 90)], "name string, seq string, length long")
    cut = breaks.pieces_layout(seqs, spark.createDataFrame([("q", 40)], "query string, pos long"))
    schema = "seqid string, source string, feature string, start long, end long, score string, strand string, phase string, attributes string, line_no long"
    genes = spark.createDataFrame([("q", ".", "gene", 5, 20, ".", "+", ".", "ID=1", 1), ("q", ".", "gene", 50, 77, ".", "-", ".", "ID=2", 2)], schema)
    pieces = liftover.to_pieces(genes, cut).drop("problem")
    turned = cut.withColumns({"obj": F.concat(F.lit("o_"), "comp"), "obj_beg": F.lit(1).cast("long"), "obj_end": F.col("obj_end") - F.col("obj_beg") + 1, "pid": F.lit(1).cast("long"), "orientation": F.lit("-")})
    lifted = liftover.to_objects(pieces, turned).drop("problem").collect()
    built = {r.name: r.seq for r in splitting.built(turned, splitting.cut_out(cut, seqs)).collect()}
    other = str.maketrans("ACGT", "TGCA")
    read = lambda s, a, b, strand: s[a - 1 : b] if strand == "+" else s[a - 1 : b].translate(other)[::-1]
    got = {r.line_no: read(built[r.seqid], r.start, r.end, r.strand) for r in lifted}
    assert got == {1: read(seq, 5, 20, "+"), 2: read(seq, 50, 77, "-")}
    with pytest.raises(Exception, match="spans several"):
        liftover.to_pieces(genes.withColumn("end", F.lit(60)), cut).collect()


def test_depth_and_sites(spark):
    df = spark.createDataFrame([("a", 0, 10), ("a", 5, 8), ("b", 1, 2)], "ref string, ref_start long, ref_end long")
    assert sorted(tuple(r) for r in readers.depth_of(df).collect()) == [("a", 0, 5, 1), ("a", 5, 8, 2), ("a", 8, 10, 1), ("b", 1, 2, 1)]
    assert fs.sites_pattern(["HinfI", "gatc"]) == "GA[ACGT]TC|GATC"
    with pytest.raises(ValueError):
        fs.sites_pattern(["nothing!"])
    got = spark.createDataFrame([("GATCAAGATCGACTC",)], "s string").select(fs.site_starts(F.col("s"), fs.sites_pattern(["HinfI", "MboI"])).alias("x")).first().x
    assert got == [0, 6, 10]


def test_agp_numbers_must_be_integers(spark, tmp_path):
    (tmp_path / "a.agp").write_text("o\tX\t10\t1\tW\tc\t1\t10\t+\no\t11\tZ\t2\tW\td\t1\t5\t-\no\t16\t25\t3\tN\t1.5\tscaffold\tyes\tmap\no\t26\t30\t4\tW\te\t1\t5x\t+\n")
    rules = {(r.line_no, r.rule) for r in agp.violations(readers.read_agp(spark, str(tmp_path / "a.agp"))).collect()}
    assert {(n, "not an integer") for n in (1, 2, 3, 4)} <= rules


@pytest.mark.parametrize("head", ["", "@HD\tVN:1.6\n", "@HD\tVN:1.6\tSO:coordinate\n", "@SQ\tSN:r\tSO:queryname\n"])
def test_reads_must_be_sorted_by_name(spark, tmp_path, head):
    line = "a\t64\tr\t11\t60\t5M2D3M\t*\t0\t0\t*\t*\n"
    (tmp_path / "a.sam").write_text(head + line)
    with pytest.raises(ValueError, match="sorted by read name"):
        readers.read_sam(spark, str(tmp_path / "a.sam"))
    assert [(r.ref_start, r.ref_end) for r in readers.read_sam(spark, str(tmp_path / "a.sam"), any_order=True).collect()] == [(10, 20)]
    (tmp_path / "b.sam").write_text("@HD\tVN:1.6\tSO:queryname\n" + line)
    assert readers.read_sam(spark, str(tmp_path / "b.sam")).count() == 1
    (tmp_path / "list").write_text(f"{tmp_path}/a.sam\n{tmp_path}/b.sam\n")
    names = readers.read_file_names(spark, str(tmp_path / "list"))
    assert [tuple(r) for r in readers.read_depth(spark, names).collect()] == [("r", 11, 21, 2)]


@pytest.mark.parametrize("tags", ["NM:i:5", "cg:Z:50M"])
def test_delta_needs_both_tags(spark, tmp_path, tags):
    (tmp_path / "a.paf").write_text(f"q1\t100\t0\t50\t+\tr1\t500\t10\t60\t45\t50\t60\t{tags}\n")
    with pytest.raises(Exception, match="no cg or NM tag"):
        writers.write_delta(readers.read_paf(spark, str(tmp_path / "a.paf")), str(tmp_path / "out"))


def test_breaks_without_reads_are_low_coverage(spark):
    """A window that no read touches is dry from its first base on; one that reads leave is dry from there."""
    points = spark.createDataFrame([("q", 20_000, 5000, "intra"), ("q", 20_000, 10_000, "intra"), ("q", 20_000, 17_900, "intra"), ("none", 20_000, 9000, "inter"), ("tiny", 1500, 700, "inter")], "query string, query_len long, pos long, kind string")
    depth = spark.createDataFrame([("q", 0, 4000, 20), ("q", 16_000, 18_000, 20), ("q", 18_000, 18_050, 900), ("q", 18_050, 20_000, 20)], "seq string, start long, end long, depth long")
    limits = spark.createDataFrame([(20, 5, 240)], "median long, low long, high long")
    got = {(r.query, r.candidate): r.pos for r in breaks.validated(points, depth, limits, 4000, 1000).collect()}
    assert got == {("q", 5000): 4000, ("q", 10_000): 8000, ("q", 17_900): 15_900, ("none", 9000): 7000}
    assert {r.cov: r.n_bp for r in breaks.histogram(depth).collect()} == {20: 7950, 900: 50}


def test_depth_windows_match_brute_force(spark):
    rnd = random.Random(12)
    stretches, points = [], []
    for seq in "abc":
        at = rnd.randrange(30)
        while at < 380:
            end = min(400, at + rnd.randint(1, 60))
            stretches.append((seq, at, end, rnd.randint(0, 9)))
            at = end + rnd.choice([0, 0, rnd.randrange(20)])
    for seq in "abcd":
        points += [(seq, 400, rnd.randrange(400), "intra") for _ in range(25)]
    limits, window, clamp = (0, 9), 50, 20
    want = {}
    for seq, size, pos, _ in points:
        base = [0] * size
        for s, a, b, n in stretches:
            if s == seq:
                base[a:b] = [n] * (b - a)
        lo, hi = max(pos - window // 2, clamp), min(pos + window // 2, size - clamp)
        part = base[lo:hi]
        if part and min(part) <= limits[0]:
            want[seq, pos] = lo + part.index(min(part))
        elif part and max(part) >= limits[1]:
            want[seq, pos] = lo + part.index(max(part))
    got = breaks.validated(spark.createDataFrame(points, "query string, query_len long, pos long, kind string"), spark.createDataFrame(stretches, "seq string, start long, end long, depth long"), spark.createDataFrame([limits], "low long, high long"), window, clamp)
    assert {(r.query, r.candidate): r.pos for r in got.collect()} == want
    assert len(want) > 20


def test_running_sums_over_ranges(spark):
    rows = [(f"k{i % 40:02}", i, i % 5) for i in random.Random(5).sample(range(300), 300)]
    df = running(spark.createDataFrame(rows, "a string, b long, v long").repartition(7), ["a", "b"], "before", "v")
    total = 0
    for r in sorted(df.collect(), key=lambda r: (r.a, r.b)):
        assert r.before == total
        total += r.v

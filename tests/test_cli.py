import pytest

from loomwork import cli
from loomwork.operators.alignments import with_min_mapq
from loomwork.streaming.alignments import counts_by_query, stream_paf


def text(spark, path):
    return "\n".join(r.value for r in spark.read.text(str(path)).collect())


def test_scaffold_from_files(spark, tmp_path):
    """Two queries on one reference, the second reversed, and one that aligns nowhere."""
    (tmp_path / "q.fa").write_text(">a\n" + "ACGT" * 500 + "\n>b\n" + "GGCA" * 500 + "\n>c\nTTTT\n")
    (tmp_path / "x.paf").write_text("a\t2000\t0\t2000\t+\tr\t9000\t100\t2100\t1990\t2000\t60\nb\t2000\t0\t2000\t-\tr\t9000\t3000\t5000\t1990\t2000\t60\n")
    cli.main(["scaffold", str(tmp_path / "x.paf"), str(tmp_path / "q.fa"), "--out", str(tmp_path / "out"), "--infer-gaps"])
    rows = [x.split("\t") for x in text(spark, tmp_path / "out/layout.agp").split("\n") if not x.startswith("#")]
    assert rows == [
        ["c_placed", "1", "4", "1", "W", "c", "1", "4", "+"], ["r_placed", "1", "2000", "1", "W", "a", "1", "2000", "+"],
        ["r_placed", "2001", "2900", "2", "N", "900", "scaffold", "yes", "align_genus"], ["r_placed", "2901", "4900", "3", "W", "b", "1", "2000", "-"],
    ]
    assert ">r_placed\n" + "ACGT" * 500 + "N" * 900 + "TGCC" * 500 in text(spark, tmp_path / "out/scaffolds.fasta")
    cli.main(["agpcheck", str(tmp_path / "out/layout.agp")])


def test_every_command_has_its_options():
    for command in ("correct p q", "merge q a b", "patch p t q", "createlinks q s", "agp2fa a q", "breakquery a q", "splitasm q", "delta2paf d", "paf2delta p", "updategff g a", "rename q"):
        assert cli.parser().parse_args([*command.split(), "--out", "o"]).out == "o"
    assert cli.parser().parse_args(["asmstats", "x.fa", "--genome-size", "5"]).genome_size == 5


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / f"in/{i}.paf").write_text(f"q{i % 2}\t100\t0\t50\t+\tr\t500\t10\t60\t45\t50\t{20 * i}\nq9\t100\t60\t50\t+\tr\t500\t10\t60\t45\t50\t60\n")
    run = counts_by_query(with_min_mapq(stream_paf(spark, str(tmp_path / "in"), 1), 10)).writeStream.format("memory").queryName("seen").outputMode("complete").start()
    run.processAllAvailable()
    run.stop()
    assert sorted(tuple(r) for r in spark.table("seen").collect()) == [("q0", 1, 50, 40), ("q1", 1, 50, 20)]


def test_gml_has_every_edge(spark, tmp_path, monkeypatch):
    edges = [(f"s{i:04}_e", f"s{i + 1:04}_b", float(i)) for i in range(3000)]
    table = spark.createDataFrame(edges, "u string, v string, weight double").repartition(5)
    monkeypatch.setattr(cli.r, "read_agp", lambda *_: None)
    for name in ("adjacencies", "realized"):
        monkeypatch.setattr(cli.graph, name, lambda x: x)
    monkeypatch.setattr(cli.graph, "merged", lambda _: table)
    cli.main(["writegml", "x.agp", "--out", str(tmp_path / "g.gml")])
    assert (tmp_path / "g.gml").read_text() == cli.graph.gml(edges, True)
    with pytest.raises(SystemExit, match="3000 edges"):
        cli.main(["writegml", "x.agp", "--out", str(tmp_path / "few.gml"), "--most", "2999"])
    assert not (tmp_path / "few.gml").exists()

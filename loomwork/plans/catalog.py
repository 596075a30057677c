"""All queries of the engine, by name, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwork.functions import sequences as fs
from loomwork.operators import agp, alignments, breaks, chaining, components, graph, intervals, liftover, links, patching, placement, scoring, splitting, stats
from loomwork.plans import adapters as ad
from loomwork.plans import pipelines
from loomwork.sources import readers
from loomwork.tables import running

#: Parameters that keep each operator busy on these tables.
HOW = pipelines.Filters(anchor=200, keep_small=True, mapq=10, chain=20_000)
GROUPING = 0.3

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


ROW = "query, line_no, query_start, query_end, strand, ref, ref_start, ref_end, num_match, aln_len, mapq"
COLS = ROW.split(", ")


# Alignments: filters and flags


@query(f"""WITH {ad.ALN} SELECT query, line_no, ref_start <= 0.05 * ref_len AS ref_left, ref_len - ref_end <= 0.05 * ref_len AS ref_right,
  query_start <= 0.05 * ref_len AS query_left, query_len - query_end <= 0.05 * ref_len AS query_right FROM aln WHERE ref_end - ref_start >= 600 AND mapq >= 10""")
def aln_end_flags(spark, d):
    rows = alignments.with_min_mapq(alignments.with_min_length(ad.alignments(spark, d), 600), 10)
    return alignments.with_end_flags(rows, 0.05).select("query", "line_no", "ref_left", "ref_right", "query_left", "query_right")


@query(f"WITH {ad.ALN} SELECT {ROW} FROM aln WHERE ref_start <= 9000 OR ref_len - ref_end <= 9000")
def aln_terminal(spark, d):
    return alignments.terminal_only(ad.alignments(spark, d), 9000).select(*COLS)


@query(f"""WITH {ad.ALN} SELECT {ROW} FROM aln WHERE query NOT IN (SELECT CAST(p_partkey AS VARCHAR) FROM part WHERE p_size % 3 = 0) AND ref <> 'ref2'""")
def aln_exclude_names(spark, d):
    skip = ad.table(spark, d, "part").filter("p_size % 3 = 0").select(F.col("p_partkey").cast("string").alias("name"))
    refs = spark.createDataFrame([("ref2",)], "name string")
    return alignments.without_names(ad.alignments(spark, d), skip, refs).select(*COLS)


_FLAGS = "fl AS (SELECT *, query_start <= 1500 AS ql, query_len - query_end <= 1500 AS qr, ref_start <= 1500 AS rl, ref_len - ref_end <= 1500 AS rr FROM aln)"


@query(f"""WITH {ad.ALN}, {_FLAGS} SELECT query, count(*) AS n_alns, count(DISTINCT ref) AS n_refs, bool_or(NOT (ql OR qr) AND NOT (rl AND rr)) AS internal FROM fl GROUP BY query""")
def aln_query_summary(spark, d):
    return alignments.query_summary(ad.alignments(spark, d), 1500)


@query(f"""WITH {ad.ALN}, t AS (SELECT * FROM aln WHERE ref_end - ref_start >= 300 AND (ref_start <= 20000 OR ref_len - ref_end <= 20000)),
g AS (SELECT query FROM t GROUP BY query HAVING count(DISTINCT ref) > 1 AND NOT bool_or(NOT (query_start <= 20000 OR query_len - query_end <= 20000) AND NOT (ref_start <= 20000 AND ref_len - ref_end <= 20000)))
SELECT {ROW} FROM t WHERE query IN (SELECT query FROM g)""")
def aln_useful_for_patching(spark, d):
    return alignments.useful_for_patching(ad.alignments(spark, d), 300, 20_000).select(*COLS)


_UNIQUE = """pts AS (SELECT query, query_start AS a FROM aln UNION SELECT query, query_end FROM aln),
seg AS (SELECT query, a, lead(a) OVER (PARTITION BY query ORDER BY a) AS b FROM pts),
own AS (SELECT s.query, s.a, s.b, min(x.line_no) AS line_no FROM seg s JOIN aln x ON x.query = s.query AND x.query_start <= s.a AND x.query_end >= s.b GROUP BY s.query, s.a, s.b HAVING count(*) = 1),
alone AS (SELECT query, line_no, sum(b - a) AS bp FROM own GROUP BY query, line_no),
uniq AS (SELECT aln.* FROM aln LEFT JOIN alone USING (query, line_no) WHERE coalesce(bp, 0) >= 200 OR coalesce(bp, 0) = query_end - query_start)"""


@query(f"WITH {ad.ALN}, {_UNIQUE} SELECT {ROW} FROM uniq")
def aln_unique_anchors(spark, d):
    return alignments.unique_anchors(ad.alignments(spark, d), HOW.anchor, HOW.keep_small).select(*COLS)


@query(f"""WITH {ad.ALN}, o AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY ref, ref_start, ref_end, line_no) AS ix FROM aln)
SELECT {ROW} FROM o x WHERE NOT EXISTS (SELECT 1 FROM o y WHERE y.query = x.query AND y.ix <> x.ix AND y.query_start <= x.query_start AND y.query_end >= x.query_end
  AND (y.query_start < x.query_start OR y.query_end > x.query_end OR y.ix < x.ix))""")
def aln_uncontained(spark, d):
    return alignments.uncontained_in_query(ad.alignments(spark, d)).select(*COLS)


def _chain_sql(source: str) -> str:
    return f"""
num AS (SELECT *, row_number() OVER (PARTITION BY query, ref ORDER BY ref_start, ref_end, line_no) AS rn FROM {source}),
fold AS (
  SELECT query, ref, rn, CAST(1 AS BIGINT) AS block, query_len, query_start, query_end, strand, ref_len, ref_start, ref_end, num_match, aln_len, mapq, line_no FROM num WHERE rn = 1
  UNION ALL
  SELECT query, ref, rn, CASE WHEN j THEN block ELSE block + 1 END, query_len,
    CASE WHEN j THEN least(a_qs, query_start) ELSE query_start END, CASE WHEN j THEN greatest(a_qe, query_end) ELSE query_end END, strand, ref_len,
    CASE WHEN j THEN least(a_rs, ref_start) ELSE ref_start END, CASE WHEN j THEN greatest(a_re, ref_end) ELSE ref_end END,
    CASE WHEN j THEN CAST(round_even((a_nm / a_al + num_match / aln_len) / 2 * (greatest(a_re, ref_end) - least(a_rs, ref_start)), 0) AS BIGINT) ELSE num_match END,
    CASE WHEN j THEN greatest(a_re, ref_end) - least(a_rs, ref_start) ELSE aln_len END,
    CASE WHEN j THEN CAST(round_even(-10 * (ln((pow(10, -a_mq / 10) + pow(10, -mapq / 10)) / 2) / ln(10)), 0) AS BIGINT) ELSE mapq END,
    CASE WHEN j THEN a_line ELSE line_no END
  FROM (SELECT n.*, f.block, f.query_start AS a_qs, f.query_end AS a_qe, f.ref_start AS a_rs, f.ref_end AS a_re, f.num_match AS a_nm, f.aln_len AS a_al, f.mapq AS a_mq, f.line_no AS a_line,
      f.strand = n.strand AND abs(n.ref_start - f.ref_end) <= 20000 AND abs(n.query_start - f.query_end) <= 20000 AS j
    FROM fold f JOIN num n ON n.query = f.query AND n.ref = f.ref AND n.rn = f.rn + 1)),
blocks AS (SELECT * FROM fold QUALIFY row_number() OVER (PARTITION BY query, ref, block ORDER BY rn DESC) = 1),
bo AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY ref, ref_start, ref_end, line_no) AS ix FROM blocks),
chain AS (SELECT * FROM bo x WHERE NOT EXISTS (SELECT 1 FROM bo y WHERE y.query = x.query AND y.ix <> x.ix AND y.query_start <= x.query_start AND y.query_end >= x.query_end
  AND (y.query_start < x.query_start OR y.query_end > x.query_end OR y.ix < x.ix)))"""


_CHAINED = f"WITH RECURSIVE {ad.ALN}, {_UNIQUE}, good AS (SELECT * FROM uniq WHERE mapq >= 10), {_chain_sql('good')}"


@query(f"{_CHAINED} SELECT {ROW} FROM chain")
def aln_chains(spark, d):
    return pipelines.filtered(ad.alignments(spark, d), HOW).select(*COLS)


def _scores_sql(source: str) -> str:
    return f"""
cv AS (SELECT *, max(ref_end) OVER (PARTITION BY query, ref ORDER BY ref_start, ref_end, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {source}),
cov AS (SELECT query, ref, CAST(sum(greatest(0, ref_end - greatest(ref_start, coalesce(reach, ref_start)))) AS BIGINT) AS covered, min(ref_start) AS low, max(ref_end) AS high,
  sum(CASE WHEN strand = '+' THEN ref_end - ref_start ELSE 0 END) AS forward, sum(CASE WHEN strand <> '+' THEN ref_end - ref_start ELSE 0 END) AS reverse FROM cv GROUP BY query, ref),
best AS (SELECT *, sum(covered) OVER (PARTITION BY query) AS every, row_number() OVER (PARTITION BY query ORDER BY covered DESC, ref) AS k FROM cov),
prim AS (SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY query, ref ORDER BY ref_end - ref_start DESC, ref_start, ref_end, line_no) = 1),
score AS (SELECT b.query, b.ref, b.covered, b.covered::DOUBLE / nullif(b.every, 0)::DOUBLE AS "grouping", b.covered::DOUBLE / nullif(b.high - b.low, 0)::DOUBLE AS location,
  (CASE WHEN p.strand = '+' THEN b.forward ELSE b.reverse END)::DOUBLE / nullif(b.forward + b.reverse, 0)::DOUBLE AS orientation,
  p.query_len, p.query_start, p.query_end, p.strand, p.ref_len, p.ref_start, p.ref_end, p.line_no FROM best b JOIN prim p ON p.query = b.query AND p.ref = b.ref WHERE k = 1)"""


_SCORE_COLS = ["query", "ref", "covered", "grouping", "location", "orientation", "query_start", "query_end", "strand", "ref_start", "ref_end", "line_no"]
_SCORE_SQL = 'query, ref, covered, "grouping", location, orientation, query_start, query_end, strand, ref_start, ref_end, line_no'


@query(f"WITH {ad.ALN}, good AS (SELECT * FROM aln WHERE mapq >= 10), {_scores_sql('good')} SELECT {_SCORE_SQL} FROM score")
def confidence_raw(spark, d):
    return scoring.scores(alignments.with_min_mapq(ad.alignments(spark, d), 10)).select(*_SCORE_COLS)


_SCORED = f"{_CHAINED}, {_scores_sql('chain')}, sure AS (SELECT * FROM score WHERE \"grouping\" > 0.3 AND location > 0 AND orientation > 0)"


@query(f"{_SCORED} SELECT {_SCORE_SQL} FROM sure")
def confidence_chained(spark, d):
    return scoring.confident(scoring.scores(pipelines.filtered(ad.alignments(spark, d), HOW)), GROUPING).select(*_SCORE_COLS)


_PLACED = f"""{_SCORED},
pc AS (SELECT *, max(ref_end) OVER (PARTITION BY ref ORDER BY ref_start, ref_end DESC, query ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM sure),
pu AS (SELECT *, CASE WHEN strand = '+' THEN query_start ELSE query_len - query_end END AS lo, CASE WHEN strand = '+' THEN query_len - query_end ELSE query_start END AS hi FROM pc WHERE reach IS NULL OR ref_end > reach),
pg AS (SELECT *, row_number() OVER w AS place, lead(ref_start - lo) OVER w - (ref_end + hi) AS estimate FROM pu WINDOW w AS (PARTITION BY ref ORDER BY ref_start, ref_end, query)),
placed AS (SELECT *, CASE WHEN estimate IS NULL THEN NULL WHEN estimate > 100 AND estimate <= 100000 THEN estimate ELSE 100 END AS gap_size,
  CASE WHEN estimate IS NULL THEN NULL WHEN estimate > 100 AND estimate <= 100000 THEN 'N' ELSE 'U' END AS gap_type FROM pg)"""


def _placed(spark, d):
    scored = scoring.confident(scoring.scores(pipelines.filtered(ad.alignments(spark, d), HOW)), GROUPING)
    return placement.with_gaps(placement.uncontained_in_ref(scored))


@query(f"{_PLACED} SELECT query, ref, place, ref_start, ref_end, strand, estimate, gap_size, gap_type FROM placed")
def scaffold_placement(spark, d):
    return _placed(spark, d).select("query", "ref", "place", "ref_start", "ref_end", "strand", "estimate", "gap_size", "gap_type")


@query(f"""{_PLACED} SELECT count(*) FILTER (gap_type = 'N') AS inferred, count(*) FILTER (estimate <= 100) AS too_small, count(*) FILTER (estimate > 100000) AS too_large FROM placed""")
def scaffold_gap_counts(spark, d):
    return placement.gap_counts(_placed(spark, d))


_LAYOUT = ", ".join(placement.LAYOUT)
_SCAFFOLDED = f"""{_PLACED},
un AS (SELECT CAST(p_partkey AS VARCHAR) AS name FROM part WHERE CAST(p_partkey AS VARCHAR) NOT IN (SELECT query FROM placed)),
parts AS (SELECT ref || '_placed' AS obj, 2 * place AS ord, query_len AS length, 'W' AS comp_type, query AS comp, CAST(1 AS BIGINT) AS comp_beg, query_len AS comp_end, strand AS orientation,
    CAST(NULL AS BIGINT) AS gap_len, CAST(NULL AS VARCHAR) AS gap_type, CAST(NULL AS VARCHAR) AS linkage, CAST(NULL AS VARCHAR) AS linkage_evidence FROM placed
  UNION ALL SELECT ref || '_placed', 2 * place + 1, gap_size, gap_type, NULL, NULL, NULL, NULL, gap_size, 'scaffold', 'yes', 'align_genus' FROM placed WHERE gap_size IS NOT NULL
  UNION ALL SELECT name || '_placed', 0, 12000, 'W', name, 1, 12000, '+', NULL, NULL, NULL, NULL FROM un),
laid AS (SELECT obj, CAST(sum(length) OVER w - length + 1 AS BIGINT) AS obj_beg, CAST(sum(length) OVER w AS BIGINT) AS obj_end, row_number() OVER w AS pid, comp_type, comp, comp_beg, comp_end, orientation, gap_len, gap_type, linkage, linkage_evidence
  FROM parts WINDOW w AS (PARTITION BY obj ORDER BY ord))"""


def _scaffold(spark, d):
    return pipelines.scaffold(ad.alignments(spark, d), ad.part_sequences(spark, d), HOW, GROUPING, infer_gaps=True)


@query(f"{_SCAFFOLDED} SELECT {_LAYOUT} FROM laid")
def scaffold_layout(spark, d):
    return _scaffold(spark, d).layout


@query(f"""{_SCAFFOLDED} SELECT count(*) FILTER (comp IN (SELECT query FROM placed)) AS placed_sequences, coalesce(CAST(sum(obj_end - obj_beg + 1) FILTER (comp IN (SELECT query FROM placed)) AS BIGINT), 0) AS placed_bp,
  count(*) FILTER (comp IN (SELECT name FROM un)) AS unplaced_sequences, coalesce(CAST(sum(obj_end - obj_beg + 1) FILTER (comp IN (SELECT name FROM un)) AS BIGINT), 0) AS unplaced_bp,
  coalesce(CAST(sum(gap_len) AS BIGINT), 0) AS gap_bp, count(*) FILTER (comp IS NULL) AS gap_sequences FROM laid""")
def scaffold_stats(spark, d):
    return _scaffold(spark, d).stats


@query(f"""WITH {ad.ALN}, un AS (SELECT CAST(p_partkey AS VARCHAR) AS name FROM part WHERE CAST(p_partkey AS VARCHAR) NOT IN (SELECT query FROM aln WHERE mapq >= 55)),
o AS (SELECT name, row_number() OVER (ORDER BY name) AS n, lead(name) OVER (ORDER BY name) IS NULL AS last FROM un),
u AS (SELECT 2 * n AS ord, CAST(12000 AS BIGINT) AS length, 'W' AS comp_type, name AS comp FROM o UNION ALL SELECT 2 * n + 1, 100, 'U', NULL FROM o WHERE NOT last)
SELECT 'Chr0' AS obj, CAST(sum(length) OVER w - length + 1 AS BIGINT) AS obj_beg, CAST(sum(length) OVER w AS BIGINT) AS obj_end, row_number() OVER w AS pid, comp_type, comp FROM u WINDOW w AS (ORDER BY ord)""")
def unplaced_concatenated(spark, d):
    placed = ad.alignments(spark, d).filter("mapq >= 55").select("query").distinct()
    return placement.unplaced_layout(ad.part_sequences(spark, d), placed, concatenate="Chr0").select("obj", "obj_beg", "obj_end", "pid", "comp_type", "comp")


# Breaks

_BREAKS = """bk AS (SELECT query, query_len, query_start AS pos, ref, lag(ref) OVER (PARTITION BY query ORDER BY query_start, query_end, ref, ref_start, ref_end, line_no) AS prev FROM chain),
cand AS (SELECT query, query_len, pos, CASE WHEN ref = prev THEN 'intra' ELSE 'inter' END AS kind FROM bk WHERE prev IS NOT NULL AND pos > 500 AND pos < query_len - 500)"""


def _candidates(spark, d):
    return breaks.candidates(pipelines.filtered(ad.alignments(spark, d), HOW), 500)


@query(f"{_CHAINED}, {_BREAKS} SELECT query, pos, kind FROM cand")
def break_candidates(spark, d):
    return _candidates(spark, d).select("query", "pos", "kind")


_SPACED = """cs AS (SELECT query, query_len, pos, row_number() OVER (PARTITION BY query ORDER BY pos) AS rn FROM (SELECT DISTINCT query, query_len, pos FROM cand)),
sp AS (SELECT query, query_len, pos, rn, pos AS last, true AS keep FROM cs WHERE rn = 1
  UNION ALL SELECT c.query, c.query_len, c.pos, c.rn, CASE WHEN c.pos - s.last > 1000 THEN c.pos ELSE s.last END, c.pos - s.last > 1000 FROM sp s JOIN cs c ON c.query = s.query AND c.rn = s.rn + 1)"""


@query(f"{_CHAINED}, {_BREAKS}, {_SPACED} SELECT query, pos FROM sp WHERE keep")
def break_spacing(spark, d):
    return breaks.spaced(_candidates(spark, d), 1000).select("query", "pos")


@query(f"""{_CHAINED}, {_BREAKS}, {_SPACED}, {ad.FEAT},
cut AS (SELECT query, pos FROM sp k WHERE keep AND NOT EXISTS (SELECT 1 FROM feat f WHERE f.seq = k.query AND f.start <= k.pos AND k.pos < f."end")),
b AS (SELECT CAST(p_partkey AS VARCHAR) AS name, CAST(0 AS BIGINT) AS a FROM part UNION SELECT query, pos FROM cut),
e AS (SELECT name, a, coalesce(lead(a) OVER (PARTITION BY name ORDER BY a), 12000) AS z, count(*) OVER (PARTITION BY name) AS n, row_number() OVER (PARTITION BY name ORDER BY a) AS pid FROM b)
SELECT name AS obj, a + 1 AS obj_beg, z AS obj_end, pid, CASE WHEN n = 1 THEN name ELSE name || '_' || CAST(a + 1 AS VARCHAR) || '_' || CAST(z AS VARCHAR) || '_+' END AS comp, z - a AS comp_end FROM e""")
def correct_layout(spark, d):
    points = breaks.spaced(_candidates(spark, d), 1000)
    points = intervals.unstabbed(points.withColumn("seq", F.col("query")), ad.features(spark, d)).drop("seq")
    return breaks.pieces_layout(ad.part_sequences(spark, d), points).select("obj", "obj_beg", "obj_end", "pid", "comp", "comp_end")


def _depth(spark, d):
    li = ad.table(spark, d, "lineitem")
    pos = (F.col("l_orderkey") * 53 + F.col("l_linenumber") * 7) % 12_000
    spots = li.groupBy(F.col("l_partkey").cast("string").alias("seq"), pos.alias("start")).agg(F.max(F.col("l_quantity").cast("long")).alias("depth"))
    ends = F.coalesce(F.lead("start").over(Window.partitionBy("seq").orderBy("start")), F.lit(12_000))
    # some stretches and some sequences have no reads
    return spots.select("seq", "start", ends.alias("end"), "depth").filter("depth >= 3 AND seq % 7 <> 0")


_DEPTH = """spot AS (SELECT CAST(l_partkey AS VARCHAR) AS seq, (l_orderkey * 53 + l_linenumber * 7) % 12000 AS start, max(CAST(l_quantity AS BIGINT)) AS depth FROM lineitem GROUP BY ALL),
tile AS (SELECT seq, start, lead(start, 1, 12000) OVER (PARTITION BY seq ORDER BY start) AS "end", CASE WHEN depth >= 3 AND CAST(seq AS BIGINT) % 7 <> 0 THEN depth ELSE 0 END AS depth FROM spot
  UNION ALL SELECT seq, 0, min(start), 0 FROM spot GROUP BY seq HAVING min(start) > 0)"""
_MEDIAN = f"""{_DEPTH}, h AS (SELECT depth AS cov, sum("end" - start) AS n_bp FROM tile WHERE depth > 0 GROUP BY depth),
hh AS (SELECT row_number() OVER (ORDER BY cov) - 1 AS place, n_bp FROM h WHERE cov < (SELECT max(cov) FROM h)),
med AS (SELECT min(place) AS median FROM (SELECT place, sum(n_bp) OVER (ORDER BY place) AS upto, sum(n_bp) OVER () AS total FROM hh) WHERE 2 * upto >= total),
lim AS (SELECT median, greatest(5, median - 5 * CAST(round_even(sqrt(median), 0) AS BIGINT)) AS low, 12 * median AS high FROM med)"""


def _limits(spark, d):
    return breaks.thresholds(breaks.median_coverage(breaks.histogram(_depth(spark, d))))


@query(f"WITH {_MEDIAN} SELECT median, low, high FROM lim")
def coverage_thresholds(spark, d):
    return _limits(spark, d)


@query(f"""{_CHAINED}, {_BREAKS}, {_MEDIAN},
w AS (SELECT DISTINCT query, query_len, pos, greatest(pos - 1000, 300) AS lo, least(pos + 1000, query_len - 300) AS hi FROM cand),
n AS (SELECT w.*, d.depth, greatest(d.start, w.lo) AS place FROM w JOIN tile d ON d.seq = w.query AND d."end" > w.lo AND d.start < w.hi),
j AS (SELECT query, pos AS candidate, min(depth) AS least, arg_min(place, depth * 100000 + place) AS at_least, max(depth) AS most, arg_min(place, -depth * 100000 + place) AS at_most FROM n GROUP BY ALL)
SELECT query, candidate, CASE WHEN least <= low THEN at_least ELSE at_most END AS pos FROM j, lim WHERE least <= low OR most >= high""")
def break_validation(spark, d):
    return breaks.validated(_candidates(spark, d), _depth(spark, d), _limits(spark, d), 2000, 300).select("query", "candidate", "pos")


@query(f"""WITH {ad.FEAT}, e AS (SELECT seq, start AS pos, 1 AS x FROM feat UNION ALL SELECT seq, "end", -1 FROM feat), s AS (SELECT seq, pos, sum(x) AS x FROM e GROUP BY seq, pos),
r AS (SELECT seq, pos AS start, lead(pos) OVER w AS "end", CAST(sum(x) OVER w AS BIGINT) AS depth FROM s WINDOW w AS (PARTITION BY seq ORDER BY pos))
SELECT seq, start, "end", depth FROM r WHERE "end" IS NOT NULL AND depth > 0""")
def interval_depth(spark, d):
    return readers.depth_of(ad.features(spark, d), "seq", "start", "end")


# Intervals and annotation

_PIECES = "SELECT CAST(p_partkey AS VARCHAR) AS obj, p_partkey FROM part"


@query(f"""WITH {ad.ALN}, {ad.FEAT} SELECT a.query, a.line_no, f.event_id FROM aln a JOIN feat f ON f.seq = a.query AND f.start <= a.query_start AND a.query_start < f."end" """)
def interval_stab_join(spark, d):
    points = ad.alignments(spark, d).select(F.col("query").alias("seq"), F.col("query_start").alias("pos"), "line_no")
    return intervals.stabbing(points, ad.features(spark, d), 512).select(F.col("seq").alias("query"), "line_no", F.col("i_event_id").alias("event_id"))


@query(f"""WITH {ad.ALN}, {ad.FEAT} SELECT a.query, a.line_no FROM aln a WHERE NOT EXISTS (SELECT 1 FROM feat f WHERE f.seq = a.query AND f.start <= a.query_start AND a.query_start < f."end")""")
def interval_stab_antijoin(spark, d):
    points = ad.alignments(spark, d).select(F.col("query").alias("seq"), F.col("query_start").alias("pos"), "line_no")
    return intervals.unstabbed(points, ad.features(spark, d), 512).select(F.col("seq").alias("query"), "line_no")


@query(f"""WITH {ad.ALN}, {ad.FEAT} SELECT a.query, a.line_no, f.event_id FROM aln a JOIN feat f ON f.seq = a.query AND f.start < a.query_end AND a.query_start < f."end" """)
def interval_overlap_join(spark, d):
    rows = ad.alignments(spark, d).select(F.col("query").alias("seq"), F.col("query_start").alias("start"), F.col("query_end").alias("end"), "line_no")
    return intervals.overlapping(rows, ad.features(spark, d), 512).select(F.col("seq").alias("query"), "line_no", F.col("r_event_id").alias("event_id"))


def _thirds(spark, d):
    cuts = ad.part_sequences(spark, d).select(F.col("name").alias("query"), F.explode(F.array(F.lit(4000).cast("long"), F.lit(8000).cast("long"))).alias("pos"))
    return breaks.pieces_layout(ad.part_sequences(spark, d), cuts)


@query(f"""WITH {ad.FEAT}, f AS (SELECT *, start + 1 AS b, start // 4000 AS x, ("end" - 1) // 4000 AS y, seq IN (SELECT CAST(p_partkey AS VARCHAR) FROM part) AS known FROM feat),
g AS (SELECT *, CASE WHEN NOT known THEN 'on no piece' WHEN x <> y THEN 'spans several pieces' END AS problem FROM f)
SELECT CASE WHEN problem IS NULL THEN seq || '_' || CAST(x * 4000 + 1 AS VARCHAR) || '_' || CAST((x + 1) * 4000 AS VARCHAR) || '_+' ELSE seq END AS seqid,
  CASE WHEN problem IS NULL THEN b - x * 4000 ELSE b END AS start, CASE WHEN problem IS NULL THEN "end" - x * 4000 ELSE "end" END AS "end", strand, event_id AS line_no, problem FROM g""")
def annotation_to_pieces(spark, d):
    return liftover.to_pieces(ad.annotation(spark, d), _thirds(spark, d), strict=False).select("seqid", "start", "end", "strand", "line_no", "problem")


@query(f"""WITH {ad.AGP}, {ad.FEAT}, f AS (SELECT 'c' || seq AS seqid, start % 900 + 1 AS b, start % 900 + 50 AS e, strand, event_id FROM feat),
j AS (SELECT f.*, obj, obj_beg, obj_end, orientation FROM f LEFT JOIN agp ON comp = seqid)
SELECT coalesce(obj, seqid) AS seqid, CASE WHEN obj IS NULL THEN b WHEN orientation = '-' THEN obj_end - e + 1 ELSE obj_beg + b - 1 END AS start,
  CASE WHEN obj IS NULL THEN e WHEN orientation = '-' THEN obj_end - b + 1 ELSE obj_beg + e - 1 END AS "end",
  CASE WHEN orientation = '-' THEN CASE strand WHEN '+' THEN '-' ELSE '+' END ELSE strand END AS strand, event_id AS line_no, CASE WHEN obj IS NULL THEN 'on no component' END AS problem FROM j""")
def annotation_to_objects(spark, d):
    rows = ad.annotation(spark, d).withColumns({"seqid": F.concat(F.lit("c"), "seqid"), "start": (F.col("start") - 1) % 900 + 1})
    rows = rows.withColumn("end", F.col("start") + 49)
    return liftover.to_objects(rows, ad.layout(spark, d), strict=False).select("seqid", "start", "end", "strand", "line_no", "problem")


# Layouts


@query(f"WITH {ad.AGP} SELECT obj, max(obj_end) AS length FROM agp GROUP BY obj")
def layout_object_lengths(spark, d):
    return agp.object_lengths(ad.layout(spark, d))


@query(f"WITH {ad.AGP} SELECT count(*) AS n_lines, count(DISTINCT obj) AS n_objects FROM agp")
def layout_counts(spark, d):
    return agp.counts(ad.layout(spark, d))


def _spoiled(spark, d):
    rows = running(ad.layout(spark, d), ["obj", "pid"], "line_no").withColumn("line_no", F.col("line_no") + 1)
    at = lambda n: F.col("line_no") % n == 0
    return rows.withColumns({
        "obj_beg": F.when(~at(41), F.col("obj_beg")),
        "comp_end": F.when(~at(43), F.col("comp_end")),
        "obj_end": F.when(at(17), F.col("obj_end") + 1).otherwise(F.col("obj_end")),
        "pid": F.when(at(19), F.col("pid") + 1).otherwise(F.col("pid")),
        "orientation": F.when(at(23), "x").otherwise(F.col("orientation")),
        "gap_type": F.when(at(3), "hole").otherwise(F.col("gap_type")),
        "linkage": F.when(at(5), "no").otherwise(F.col("linkage")),
        "linkage_evidence": F.when(at(7), "na;guess").otherwise(F.col("linkage_evidence")),
        "comp_type": F.when(at(29), "Q").otherwise(F.col("comp_type")),
        "comp_beg": F.when(at(31), 0).otherwise(F.col("comp_beg")),
        "gap_len": F.when(at(37), 0).when(~at(39), F.col("gap_len")),
    })


_SPOILED = f"""{ad.AGP}, n AS (SELECT *, row_number() OVER (ORDER BY obj, pid) AS line_no FROM agp),
sp AS (SELECT obj, line_no, CASE WHEN line_no % 41 <> 0 THEN obj_beg END AS obj_beg, CASE WHEN line_no % 17 = 0 THEN obj_end + 1 ELSE obj_end END AS obj_end, CASE WHEN line_no % 19 = 0 THEN pid + 1 ELSE pid END AS pid, CASE WHEN line_no % 29 = 0 THEN 'Q' ELSE comp_type END AS comp_type,
  CASE WHEN line_no % 31 = 0 THEN 0 ELSE comp_beg END AS comp_beg, CASE WHEN line_no % 43 <> 0 THEN comp_end END AS comp_end, CASE WHEN line_no % 23 = 0 THEN 'x' ELSE orientation END AS orientation, CASE WHEN line_no % 37 = 0 THEN 0 WHEN line_no % 39 <> 0 THEN gap_len END AS gap_len,
  CASE WHEN line_no % 3 = 0 THEN 'hole' ELSE gap_type END AS gap_type, CASE WHEN line_no % 5 = 0 THEN 'no' ELSE linkage END AS linkage, CASE WHEN line_no % 7 = 0 THEN 'na;guess' ELSE linkage_evidence END AS linkage_evidence FROM n),
r AS (SELECT *, lag(line_no) OVER w AS pl, lag(pid) OVER w AS pp, lag(obj_end) OVER w AS pe, comp_type IN ('N', 'U') AS gap, comp_type IN ('A', 'D', 'F', 'G', 'O', 'P', 'W') AS seq, string_split(linkage_evidence, ';') AS ev, obj_end - obj_beg + 1 AS span FROM sp WINDOW w AS (PARTITION BY obj ORDER BY line_no))"""


@query(f"""WITH {_SPOILED}
SELECT obj, line_no, 'not an integer' AS rule FROM r WHERE obj_beg IS NULL OR obj_end IS NULL OR pid IS NULL OR seq AND (comp_beg IS NULL OR comp_end IS NULL) OR gap AND gap_len IS NULL
UNION ALL SELECT obj, line_no, 'object not contiguous' FROM r WHERE pl IS NOT NULL AND line_no <> pl + 1
UNION ALL SELECT obj, line_no, 'object does not start at 1' FROM r WHERE pl IS NULL AND (obj_beg <> 1 OR pid <> 1)
UNION ALL SELECT obj, line_no, 'part numbers not sequential' FROM r WHERE pl IS NOT NULL AND pid <> pp + 1
UNION ALL SELECT obj, line_no, 'object intervals not contiguous' FROM r WHERE pl IS NOT NULL AND obj_beg <> pe + 1
UNION ALL SELECT obj, line_no, 'bad object interval' FROM r WHERE obj_beg <= 0 OR obj_end <= 0 OR pid <= 0 OR obj_beg > obj_end
UNION ALL SELECT obj, line_no, 'unknown component type' FROM r WHERE NOT gap AND NOT seq
UNION ALL SELECT obj, line_no, 'bad component interval' FROM r WHERE seq AND (comp_beg <= 0 OR comp_beg > comp_end)
UNION ALL SELECT obj, line_no, 'spans differ' FROM r WHERE seq AND comp_end - comp_beg + 1 <> span
UNION ALL SELECT obj, line_no, 'unknown orientation' FROM r WHERE seq AND orientation NOT IN ('+', '-', '?', '0', 'na')
UNION ALL SELECT obj, line_no, 'bad gap length' FROM r WHERE gap AND (gap_len <= 0 OR gap_len <> span)
UNION ALL SELECT obj, line_no, 'unknown gap not of 100' FROM r WHERE comp_type = 'U' AND gap_len <> 100
UNION ALL SELECT obj, line_no, 'unknown gap type' FROM r WHERE gap AND gap_type NOT IN ('scaffold', 'contig', 'centromere', 'short_arm', 'heterochromatin', 'telomere', 'repeat', 'contamination')
UNION ALL SELECT obj, line_no, 'unknown linkage' FROM r WHERE gap AND linkage NOT IN ('yes', 'no')
UNION ALL SELECT obj, line_no, 'unknown evidence' FROM r WHERE gap AND list_contains(ev, 'guess')
UNION ALL SELECT obj, line_no, 'evidence without linkage' FROM r WHERE gap AND linkage = 'no' AND (gap_type = 'scaffold' OR linkage_evidence <> 'na')
UNION ALL SELECT obj, line_no, 'linkage without evidence' FROM r WHERE gap AND linkage = 'yes' AND list_contains(ev, 'na')""")
def layout_violations(spark, d):
    return agp.violations(_spoiled(spark, d))


# Statistics


def _lengths(spark, d):
    docs = ad.table(spark, d, "documents").select(F.concat(F.lit("texts_"), "lang").alias("asm"), F.col("n_chars").cast("long").alias("length"))
    orders = ad.table(spark, d, "orders").select(F.lit("orders").alias("asm"), F.floor("o_totalprice").alias("length"))
    return docs.unionByName(orders)


def _stats_sql(whole: str) -> str:
    return f"""WITH l AS (SELECT 'texts_' || lang AS asm, n_chars AS length FROM documents UNION ALL SELECT 'orders', CAST(floor(o_totalprice) AS BIGINT) FROM orders),
c AS (SELECT asm, length, sum(length) OVER w AS bp, row_number() OVER w AS k, ({whole})::DOUBLE AS whole FROM l WINDOW w AS (PARTITION BY asm ORDER BY length DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT asm, count(*) AS n_seqs, CAST(sum(length) AS BIGINT) AS total_bp, min(length) AS shortest, max(length) AS longest, CAST(round_even(sum(length::DOUBLE * (length / whole)), 0) AS BIGINT) AS au_n,
  max(length) FILTER (bp > 0.5 * whole) AS n50, max(length) FILTER (bp > 0.9 * whole) AS n90, min(k) FILTER (bp > 0.5 * whole) AS l50, min(k) FILTER (bp > 0.9 * whole) AS l90 FROM c GROUP BY asm"""


@query(_stats_sql("sum(length) OVER (PARTITION BY asm)"))
def assembly_stats(spark, d):
    return stats.assembly_stats(_lengths(spark, d))


@query(_stats_sql("900000"))
def assembly_stats_for_genome_size(spark, d):
    return stats.assembly_stats(_lengths(spark, d), 900_000)


# Sequences


@query(f"""WITH {ad.SEQ}, p AS (SELECT name, unnest(regexp_extract_all(seq, '[Nn]+|[^Nn]+')) AS part, generate_subscripts(regexp_extract_all(seq, '[Nn]+|[^Nn]+'), 1) AS i FROM seqs),
g AS (SELECT name, i, length(part) AS n, upper(part[1]) = 'N' AND length(part) > 6 AS gap FROM p),
e AS (SELECT *, sum(n) OVER (PARTITION BY name ORDER BY i) AS e, CASE WHEN gap OR coalesce(lag(gap) OVER (PARTITION BY name ORDER BY i), true) THEN 1 ELSE 0 END AS f FROM g),
r AS (SELECT *, sum(f) OVER (PARTITION BY name ORDER BY i) AS run FROM e),
q AS (SELECT name, run, min(e - n) AS a, max(e) AS z, bool_or(gap) AS gap FROM r GROUP BY name, run),
k AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY run) AS pid, CASE WHEN NOT gap THEN row_number() OVER (PARTITION BY gap ORDER BY name, run) - 1 END AS num FROM q)
SELECT name AS obj, CAST(a + 1 AS BIGINT) AS obj_beg, CAST(z AS BIGINT) AS obj_end, pid, CASE WHEN gap THEN 'N' ELSE 'W' END AS comp_type, 'seq' || lpad(CAST(num AS VARCHAR), 8, '0') AS comp FROM k""")
def split_at_gaps(spark, d):
    return splitting.split_layout(ad.text_sequences(spark, d), 6).select("obj", "obj_beg", "obj_end", "pid", "comp_type", "comp")


@query(f"WITH {ad.SEQ} SELECT name AS old_name, 'seq' || lpad(CAST(seq_ix AS VARCHAR), 8, '0') AS name, length(seq) AS length FROM seqs")
def rename_sequences(spark, d):
    return splitting.renamed(ad.text_sequences(spark, d)).select("old_name", "name", F.length("seq").cast("long").alias("length"))


@query(f"WITH {ad.SEQ} SELECT name, md5(reverse(translate(seq, 'ACGTURYSWKMBDHVNacgturyswkmbdhvn', 'TGCAAYRSWMKVHDBNtgcaayrswmkvhdbn'))) AS rc_md5 FROM seqs")
def reverse_complements(spark, d):
    return ad.text_sequences(spark, d).select("name", F.md5(fs.reverse_complement(F.col("seq"))).alias("rc_md5"))


@query(f"WITH {ad.SEQ}, p AS (SELECT name, seq, list_filter(range(length(seq)), lambda i: substr(seq, i + 1, 2) = 'NA' OR substr(seq, i + 1, 2) = 'TT' AND substr(seq, i, 2) <> 'TT') AS sites FROM seqs) SELECT name, len(sites) AS n_sites, CAST(coalesce(list_sum(sites), 0) AS BIGINT) AS sum_starts, CAST(len(list_filter(sites, lambda i: i <= 500)) AS BIGINT) AS upto_500 FROM p")
def restriction_digest(spark, d):
    sites = fs.site_starts(F.col("seq"), "NA|TT")
    rows = ad.text_sequences(spark, d).select("name", sites.alias("s"))
    return rows.select("name", F.size("s").cast("long").alias("n_sites"), F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x).alias("sum_starts"), fs.sites_upto(F.col("s"), F.lit(500)).cast("long").alias("upto_500"))


@query(f"WITH {ad.ALN} SELECT query, line_no, CAST(round_even(-10 * (ln(pow(10, -mapq / 10)) / ln(10)), 0) AS BIGINT) AS back, CAST(round_even((num_match / aln_len + 0.5) / 2 * 1000, 0) AS BIGINT) AS matches FROM aln")
def quality_functions(spark, d):
    p = fs.quality_to_error(F.col("mapq"))
    return ad.alignments(spark, d).select("query", "line_no", fs.error_to_quality(p).alias("back"), fs.chain_matches(F.col("num_match"), F.col("aln_len"), F.lit(1), F.lit(2), F.lit(1000)).alias("matches"))


@query(f"""WITH {ad.AGP}, s AS (SELECT 'c' || CAST(p_partkey AS VARCHAR) AS name, substr(repeat('ACGTTGCANCRY', 150), CAST(1 + p_partkey % 10 AS BIGINT), CAST(1000 + 10 * p_size AS BIGINT)) AS seq FROM part)
SELECT obj AS name, CAST(sum(obj_end - obj_beg + 1) AS BIGINT) AS length, md5(string_agg(CASE WHEN comp IS NULL THEN repeat('N', gap_len) WHEN orientation = '-' THEN reverse(translate(seq, 'ACGTURYSWKMBDHVN', 'TGCAAYRSWMKVHDBN')) ELSE seq END, '' ORDER BY pid)) AS md5 FROM agp LEFT JOIN s ON comp = s.name GROUP BY obj""")
def layout_to_sequences(spark, d):
    rows = splitting.built(ad.layout(spark, d), ad.component_sequences(spark, d))
    return rows.select("name", F.length("seq").cast("long").alias("length"), F.md5("seq").alias("md5"))


@query("""WITH s AS (SELECT CAST(p_partkey AS VARCHAR) AS name, substr(repeat('ACGTTGCANCRY', 1001), CAST(1 + p_partkey % 10 AS BIGINT), 12000) AS seq FROM part)
SELECT name || '_' || CAST(4000 * i + 1 AS VARCHAR) || '_' || CAST(4000 * (i + 1) AS VARCHAR) || '_+' AS name, md5(substr(seq, 4000 * i + 1, 4000)) AS md5 FROM s, range(3) t(i)""")
def break_sequences(spark, d):
    seqs = ad.part_sequences(spark, d).select("name", F.substr(F.repeat(F.lit("ACGTTGCANCRY"), 1001), 1 + F.col("name").cast("int") % 10, F.lit(12_000)).alias("seq"))
    return splitting.cut_out(_thirds(spark, d), seqs).select("name", F.md5("seq").alias("md5"))


@query(f"""WITH {ad.ALN} SELECT query, query_start, query_end, strand, ref, ref_start, ref_end, aln_len + 1 - 5 AS num_match, aln_len + 1 AS aln_len, '4M1D2M1I' || CAST(aln_len - 7 AS VARCHAR) || 'M' AS cigar FROM aln""")
def delta_to_alignments(spark, d):
    a = ad.alignments(spark, d)
    forward = F.col("strand") == "+"
    delta = a.select("ref", "query", "ref_len", "query_len", (F.col("ref_start") + 1).alias("rs"), F.col("ref_end").alias("re"), F.when(forward, F.col("query_start") + 1).otherwise(F.col("query_end")).alias("qs"), F.when(forward, F.col("query_end")).otherwise(F.col("query_start") + 1).alias("qe"), F.lit(5).cast("long").alias("nm"), F.array(F.lit(5), F.lit(-3)).cast("array<bigint>").alias("offsets"), F.lit(1).cast("long").alias("record"), F.col("line_no").alias("n"))
    return readers.delta_as_alignments(delta).select("query", "query_start", "query_end", "strand", "ref", "ref_start", "ref_end", "num_match", "aln_len", F.col("tags")["cg"].alias("cigar"))


@query(f"""WITH {ad.ALN} SELECT query, line_no, '11,' || CASE WHEN mapq % 2 = 0 THEN '1,' ELSE '' END || '-' || CAST(aln_len + 1 AS VARCHAR) || ',-1,-1' AS offsets FROM aln""")
def cigar_to_offsets(spark, d):
    cigar = F.concat(F.lit("5S10M"), F.when(F.col("mapq") % 2 == 0, "2D").otherwise("1D"), F.col("aln_len").cast("string"), F.lit("M3I7M"))
    return ad.alignments(spark, d).select("query", "line_no", F.array_join(F.transform(fs.offsets_from_cigar(cigar), lambda x: x.cast("string")), ",").alias("offsets"))


# Graphs

_ADJ = """nx AS (SELECT obj, pid, comp, orientation, lead(comp) OVER w AS c1, lead(orientation) OVER w AS o1, lead(comp_type) OVER w AS t1, lead(gap_len) OVER w AS g1, lead(gap_type) OVER w AS k1, lead(linkage) OVER w AS l1, lead(linkage_evidence) OVER w AS e1,
    lead(comp, 2) OVER w AS c2, lead(orientation, 2) OVER w AS o2, lead(pid) OVER w AS p1 FROM {0} WINDOW w AS (PARTITION BY obj ORDER BY pid)),
{1} AS (SELECT comp AS comp_a, orientation AS strand_a, coalesce(c1, c2) AS comp_b, CASE WHEN c1 IS NULL THEN o2 ELSE o1 END AS strand_b, CASE WHEN c1 IS NULL THEN t1 = 'N' END AS known, CASE WHEN c1 IS NULL THEN g1 ELSE 0 END AS gap_size,
    CASE WHEN c1 IS NULL THEN k1 END AS gap_type, coalesce(l1 = 'yes', false) AS linkage, CASE WHEN c1 IS NULL THEN e1 ELSE 'bookend' END AS linkage_evidence FROM nx WHERE comp IS NOT NULL AND p1 IS NOT NULL AND coalesce(c1, c2) IS NOT NULL)"""


@query(f"WITH {ad.AGP}, {_ADJ.format('agp', 'adj')} SELECT * FROM adj")
def graph_adjacencies(spark, d):
    return graph.adjacencies(ad.layout(spark, d))


def _real(adj: str, name: str, weight: str) -> str:
    return f"""{name} AS (SELECT least(a, b) AS u, greatest(a, b) AS v, weight FROM (SELECT comp_a || CASE WHEN x = '+' THEN '_e' ELSE '_b' END AS a, comp_b || CASE WHEN y = '+' THEN '_b' ELSE '_e' END AS b,
  CASE WHEN strand_a IN ('+', '-') AND strand_b IN ('+', '-') THEN {weight} ELSE 0.75 * {weight} END::DOUBLE AS weight
  FROM {adj}, (VALUES ('+'), ('-')) p(x), (VALUES ('+'), ('-')) q(y) WHERE (strand_a = x OR strand_a NOT IN ('+', '-')) AND (strand_b = y OR strand_b NOT IN ('+', '-'))))"""


_MERGED = f"""{ad.AGP}, {ad.ALT}, {_ADJ.format('agp', 'adj')}, {_ADJ.format('alt', 'adj2').replace('nx AS', 'nx2 AS').replace('FROM nx ', 'FROM nx2 ')}, {_real('adj', 'e1', '1')}, {_real('adj2', 'e2', '2')},
mg AS (SELECT u, v, sum(weight) AS weight, count(*) AS n FROM (SELECT * FROM e1 UNION ALL SELECT * FROM e2) GROUP BY u, v)"""


def _merged(spark, d):
    one = graph.realized(graph.adjacencies(ad.layout(spark, d)), 1.0)
    return graph.merged(one.unionByName(graph.realized(graph.adjacencies(ad.other_layout(spark, d)), 2.0)))


@query(f"WITH {_MERGED} SELECT u, v, weight, n FROM mg")
def graph_merged_edges(spark, d):
    return _merged(spark, d).select("u", "v", "weight", "n")


@query(f"WITH {_MERGED}, i AS (SELECT u AS node, weight FROM mg UNION ALL SELECT v, weight FROM mg) SELECT node, count(*) AS degree, max(weight) AS heaviest FROM i GROUP BY node")
def graph_node_summary(spark, d):
    return graph.node_summary(_merged(spark, d))


@query(f"WITH {_MERGED}, s AS (SELECT 'c' || CAST(p_partkey AS VARCHAR) AS name FROM part WHERE 1000 + 10 * p_size >= 1200) SELECT u, v, weight FROM mg WHERE weight >= 1 AND weight <= 2.5 AND left(u, length(u) - 2) IN (SELECT name FROM s) AND left(v, length(v) - 2) IN (SELECT name FROM s)")
def graph_filtered_edges(spark, d):
    return graph.of_long_components(graph.lightened(_merged(spark, d), 1, 2.5), ad.component_lengths(spark, d), 1200).select("u", "v", "weight")


_BUDDY = """i AS (SELECT u AS node, v AS other, weight FROM mg UNION ALL SELECT v, u, weight FROM mg),
mx AS (SELECT node, max(weight) AS m FROM i GROUP BY node),
bb AS (SELECT g.u, g.v, g.weight, greatest(a.m, b.m) AS alt, (SELECT max(i.weight) FROM i WHERE (i.node = g.u AND i.other <> g.v) OR (i.node = g.v AND i.other <> g.u)) AS other FROM mg g JOIN mx a ON a.node = g.u JOIN mx b ON b.node = g.v),
buddy AS (SELECT u, v, weight / CASE WHEN CASE WHEN alt = weight THEN coalesce(other, 0) ELSE alt END = 0 THEN 1 ELSE CASE WHEN alt = weight THEN other ELSE alt END END AS weight FROM bb)"""


@query(f"WITH {_MERGED}, {_BUDDY} SELECT u, v, weight FROM buddy")
def graph_best_buddy(spark, d):
    return graph.best_buddy(_merged(spark, d).select("u", "v", "weight"))


@query(f"WITH {_MERGED} SELECT g.u, g.v, e.weight FROM mg g JOIN (SELECT DISTINCT u, v, weight FROM e1) e ON e.u = g.u AND e.v = g.v WHERE g.weight < 1")
def graph_reweighted(spark, d):
    one = graph.realized(graph.adjacencies(ad.layout(spark, d)), 1.0).select("u", "v", "weight").distinct()
    return graph.reweighted(_merged(spark, d).filter("weight < 1").select("u", "v", "weight"), one)


@query(f"""WITH RECURSIVE {_MERGED}, i AS (SELECT u AS a, v AS b FROM mg UNION SELECT v, u FROM mg),
cc(node, root) USING KEY (node) AS (SELECT a AS node, min(least(a, b)) AS root FROM i GROUP BY a
  UNION SELECT i.b, min(cc.root) FROM cc JOIN i ON i.a = cc.node JOIN recurring.cc AS k ON k.node = i.b WHERE cc.root < k.root GROUP BY i.b)
SELECT node, root FROM cc""")
def graph_components(spark, d):
    return components.components(_merged(spark, d).select("u", "v"))


@query()
def graph_matching(spark, d):
    return graph.matched(_merged(spark, d))


@query()
def merge_layouts(spark, d):
    return pipelines.merge([(ad.layout(spark, d), 1.0), (ad.other_layout(spark, d), 2.0)], ad.component_lengths(spark, d), 0)


def _small_graphs(spark, d):
    """Six ends a group of parts, eight edges: a ring with two chords."""
    k, size = F.col("p_partkey"), F.col("p_size")
    rows = ad.table(spark, d, "part").select(F.floor(k / 8).alias("g"), (k % 8).alias("i"), ((size * 7 + k) % 23 + 1).cast("double").alias("weight"))
    end = lambda x: F.concat(F.lit("g"), F.col("g").cast("string"), F.lit("n"), x.cast("string"), F.lit("_b"))
    a = F.when(F.col("i") < 6, F.col("i")).otherwise(F.col("i") - 6)
    b = F.when(F.col("i") < 6, (F.col("i") + 1) % 6).otherwise(F.col("i") - 3)
    return rows.select("g", F.least(end(a), end(b)).alias("u"), F.greatest(end(a), end(b)).alias("v"), "weight")


@query("""WITH RECURSIVE e AS (SELECT p_partkey // 8 AS g, p_partkey % 8 AS i, ((p_size * 7 + p_partkey) % 23 + 1)::DOUBLE AS w, CASE WHEN p_partkey % 8 < 6 THEN p_partkey % 8 ELSE p_partkey % 8 - 6 END AS a, CASE WHEN p_partkey % 8 < 6 THEN (p_partkey % 8 + 1) % 6 ELSE p_partkey % 8 - 3 END AS b FROM part),
m AS (SELECT DISTINCT g, -1 AS last, 0 AS used, 0::DOUBLE AS total FROM e
  UNION ALL SELECT m.g, e.i, m.used + (1 << e.a) + (1 << e.b), m.total + e.w FROM m JOIN e ON e.g = m.g AND e.i > m.last AND (m.used >> e.a) % 2 = 0 AND (m.used >> e.b) % 2 = 0)
SELECT g, max(total) AS weight FROM m GROUP BY g""")
def graph_matching_weight(spark, d):
    edges = _small_graphs(spark, d)
    return edges.join(graph.matched(edges.select("u", "v", "weight")), ["u", "v"]).groupBy("g").agg(F.sum("weight").alias("weight"))


@query(f"""WITH {ad.ALT},
c AS (SELECT obj, comp, orientation, comp_end AS length, row_number() OVER w AS k, count(*) OVER (PARTITION BY obj) AS n FROM alt WHERE comp IS NOT NULL WINDOW w AS (PARTITION BY obj ORDER BY pid)),
h AS (SELECT obj, pid, gap_len, comp_type, linkage_evidence, (SELECT count(*) FROM alt x WHERE x.obj = a.obj AND x.pid < a.pid AND x.comp IS NOT NULL) AS k FROM alt a WHERE comp IS NULL),
o AS (SELECT obj, any_value(n) AS n, min(comp || '_b') AS root, max(comp || CASE WHEN orientation = '+' THEN '_b' ELSE '_e' END) FILTER (k = 1) > max(comp || CASE WHEN orientation = '+' THEN '_e' ELSE '_b' END) FILTER (k = n) AS rev FROM c GROUP BY obj),
p AS (SELECT *, 'scf' || lpad(CAST(row_number() OVER (ORDER BY root) AS VARCHAR), 8, '0') || '_placed' AS name FROM o),
parts AS (SELECT p.name, 2 * CASE WHEN rev THEN p.n + 1 - k ELSE k END AS ord, length, 'W' AS comp_type, comp, CASE WHEN rev = (orientation = '+') THEN '-' ELSE '+' END AS orientation, NULL AS evidence FROM c JOIN p USING (obj)
  UNION ALL SELECT p.name, 2 * CASE WHEN rev THEN p.n - k ELSE k END + 1, gap_len, comp_type, NULL, NULL, array_to_string(list_sort(string_split(linkage_evidence, ';')), ';') FROM h JOIN p USING (obj))
SELECT name AS obj, CAST(sum(length) OVER w AS BIGINT) AS obj_end, row_number() OVER w AS pid, comp_type, comp, orientation, evidence AS linkage_evidence FROM parts WINDOW w AS (PARTITION BY name ORDER BY ord)""")
def merge_same_layout(spark, d):
    """A layout merged with itself is that layout, objects numbered and turned by their names."""
    one = ad.other_layout(spark, d)
    return pipelines.merge([(one, 1.0), (one, 2.0)], ad.component_lengths(spark, d), 0).select("obj", "obj_end", "pid", "comp_type", "comp", "orientation", "linkage_evidence")


# Links

_PAIRS = """rp AS (SELECT q_name, is_read1, ref, ref_start + (ref_end - ref_start) // 2 AS pos, lag(is_read1) OVER w AS m, lag(ref) OVER w AS pref, lag(ref_start + (ref_end - ref_start) // 2) OVER w AS ppos FROM reads WINDOW w AS (PARTITION BY q_name ORDER BY rec_no)),
pr AS (SELECT pref AS ref_a, ppos AS pos_a, ref AS ref_b, pos AS pos_b FROM rp WHERE m <> is_read1 AND pref <> ref),
nd AS (SELECT CASE WHEN pos_a > 9101 - round_even(4551 * 0.8, 0) THEN ref_a || '_e' WHEN pos_a <= round_even(4550 * 0.8, 0) THEN ref_a || '_b' END AS a, CASE WHEN pos_b > 9101 - round_even(4551 * 0.8, 0) THEN ref_b || '_e' WHEN pos_b <= round_even(4550 * 0.8, 0) THEN ref_b || '_b' END AS b FROM pr),
lk AS (SELECT least(a, b) AS u, greatest(a, b) AS v, count(*) AS raw FROM nd WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL)"""


def _links(spark, d):
    return links.link_counts(links.mate_pairs(ad.reads(spark, d)), ad.read_refs(spark, d), 0.8)


@query(f"WITH {ad.READS}, {_PAIRS} SELECT u, v, raw FROM lk")
def link_counts(spark, d):
    return _links(spark, d)


@query(f"""WITH {ad.READS}, {_PAIRS} SELECT u, v, raw, raw::DOUBLE / (CASE WHEN u LIKE '%_b' THEN 3640 ELSE 5460 END + CASE WHEN v LIKE '%_b' THEN 3640 ELSE 5460 END)::DOUBLE AS weight FROM lk""")
def link_weights(spark, d):
    return links.normalised(_links(spark, d), links.length_norms(ad.read_refs(spark, d), 0.8))


_SITES = "list_filter(range(9101), lambda i: substr(seq, i + 1, 4) = 'GATC' OR substr(seq, i + 1, 6) = 'AAGCTT')"


@query(f"""WITH {ad.READS}, {_PAIRS}, rs AS (SELECT DISTINCT user_id % 50 AS i FROM events),
sq AS (SELECT 'r' || CAST(i AS VARCHAR) AS name, substr(repeat('GATCAAGTACTTAAGCTTCCGGA', 400), CAST(1 + i % 20 AS BIGINT), 9101) AS seq FROM rs), st AS (SELECT name, {_SITES} AS sites FROM sq),
nm AS (SELECT name || '_b' AS node, len(list_filter(sites, lambda i: i <= 3640)) AS norm FROM st UNION ALL SELECT name || '_e', len(sites) - len(list_filter(sites, lambda i: i <= 5460)) FROM st)
SELECT u, v, raw, raw::DOUBLE / (a.norm + b.norm)::DOUBLE AS weight FROM lk JOIN nm a ON a.node = u JOIN nm b ON b.node = v""")
def site_link_weights(spark, d):
    refs = ad.read_refs(spark, d)
    seq = F.substr(F.repeat(F.lit("GATCAAGTACTTAAGCTTCCGGA"), 400), 1 + F.substr("name", F.lit(2)).cast("int") % 20, F.lit(9101))
    sites = refs.withColumn("sites", fs.site_starts(seq, fs.sites_pattern(["HindIII", "gatc"])))
    return links.normalised(_links(spark, d), links.site_norms(sites, 0.8))


# Patching

#: The targets of a few queries each, so that some pairs of ends are bridged once and others more often.
_TARGETS = ad.ALN.replace("aln AS (", "every AS (") + """,
aln AS (SELECT * REPLACE (ref || 't' || CAST(CAST(query AS BIGINT) // 4 AS VARCHAR) AS ref) FROM every)"""


def _targets(spark, d):
    return ad.alignments(spark, d).withColumn("ref", F.concat("ref", F.lit("t"), F.floor(F.col("query").cast("long") / 4).cast("string")))


_BRIDGES = f"""{_TARGETS}, fl AS (SELECT *, query_start <= 3000 AS ql, query_len - query_end <= 3000 AS qr, ref_start <= 60000 AS rl, ref_len - ref_end <= 60000 AS rr FROM aln),
tu AS (SELECT *, CASE WHEN rl AND rr THEN strand = '-' WHEN ql2 AND qr2 THEN strand = '-' WHEN rl THEN ql2 ELSE qr2 END AS turned FROM (SELECT *, query_start <= 60000 AS ql2, query_len - query_end <= 60000 AS qr2 FROM fl)),
oi AS (SELECT *, query_end + CASE WHEN turned THEN ref_start ELSE ref_len - ref_end END AS out_at, query_start - CASE WHEN turned THEN ref_len - ref_end ELSE ref_start END AS in_at FROM tu),
lg AS (SELECT *, lag(ref) OVER w AS pref, lag(ref_len) OVER w AS plen, lag(turned) OVER w AS pturned, lag(out_at) OVER w AS pout FROM oi WINDOW w AS (PARTITION BY query ORDER BY query_start, query_end, ref, ref_start, ref_end, line_no)),
br AS (SELECT pref || CASE WHEN pturned THEN '_b' ELSE '_e' END AS u, ref || CASE WHEN turned THEN '_e' ELSE '_b' END AS v, query, query_len, pout AS my_end, in_at AS their_start FROM lg WHERE pref <> ref AND pout - in_at <= ref_len AND pout - in_at <= plen)"""


def _bridges(spark, d):
    return patching.bridges(_targets(spark, d), 60_000)


@query(f"WITH {_BRIDGES} SELECT * FROM br")
def patch_bridges(spark, d):
    return _bridges(spark, d)


@query(f"""WITH {_BRIDGES} SELECT u, v, query, query_len, my_end, their_start, '+' AS strand FROM br UNION ALL SELECT v, u, query, query_len, query_len - their_start, query_len - my_end, '-' FROM br""")
def patch_mirrored(spark, d):
    return patching.mirrored(_bridges(spark, d))


_ONCE = "once AS (SELECT * FROM br QUALIFY count(*) OVER (PARTITION BY least(u, v), greatest(u, v)) = 1)"


@query(f"WITH {_BRIDGES}, {_ONCE} SELECT u, v, query, my_end, their_start FROM once")
def patch_single_bridges(spark, d):
    return patching.single_bridges(_bridges(spark, d)).select("u", "v", "query", "my_end", "their_start")


def _own_gaps(spark, d):
    """The first two targets of a group are neighbours, and the next two."""
    group = F.floor(F.col("p_partkey") / 4).cast("string")
    rows = ad.table(spark, d, "part").select(group.alias("g")).distinct()
    pair = lambda a, b, gap: F.struct(F.concat(F.lit(f"ref{a}t"), "g", F.lit("_e")).alias("u"), F.concat(F.lit(f"ref{b}t"), "g", F.lit("_b")).alias("v"), F.lit(gap).cast("long").alias("gap_len"))
    return rows.select(F.explode(F.array(pair(0, 1, 50), pair(2, 3, 70))).alias("x")).select("x.*")


_OWN_GAPS = """g AS (SELECT DISTINCT CAST(p_partkey // 4 AS VARCHAR) AS g FROM part),
known AS (SELECT 'ref0t' || g || '_e' AS u, 'ref1t' || g || '_b' AS v, 50 AS gap_len FROM g UNION ALL SELECT 'ref2t' || g || '_e', 'ref3t' || g || '_b', 70 FROM g),
ends AS (SELECT u AS node FROM known UNION SELECT v FROM known)"""


@query(f"""WITH {_BRIDGES}, {_ONCE}, {_OWN_GAPS},
pairs AS (SELECT *, least(u, v) AS a, greatest(u, v) AS b FROM once)
SELECT k.u, k.v, p.u AS from_end, query, my_end, their_start, gap_len FROM known k LEFT JOIN pairs p ON p.a = k.u AND p.b = k.v
UNION ALL SELECT a, b, u, query, my_end, their_start, NULL FROM pairs WHERE u NOT IN (SELECT node FROM ends) AND v NOT IN (SELECT node FROM ends)""")
def patch_known_edges(spark, d):
    rows = patching.with_known(patching.single_bridges(_bridges(spark, d)), _own_gaps(spark, d))
    return rows.select("u", "v", F.col("bridge.u").alias("from_end"), "bridge.query", "bridge.my_end", "bridge.their_start", "gap_len")


_PATCHED = f"""WITH RECURSIVE {_TARGETS}, {_UNIQUE}, good AS (SELECT * FROM uniq WHERE mapq >= 10), {_chain_sql('good')},
long AS (SELECT * FROM chain WHERE ref_end - ref_start >= 300 AND (ref_start <= 60000 OR ref_len - ref_end <= 60000)),
fit AS (SELECT * FROM long WHERE query IN (SELECT query FROM long GROUP BY query HAVING count(DISTINCT ref) > 1)),
{_BRIDGES[_BRIDGES.index('fl AS'):].replace('FROM aln', 'FROM fit')}, {_ONCE}, {_OWN_GAPS},
names AS (SELECT 'ref' || CAST(i AS VARCHAR) || 't' || g AS comp, g, i FROM g, range(5) r(i)),
roots AS (SELECT g, i, row_number() OVER (ORDER BY root) - 1 AS k FROM (SELECT g, i, min(comp || '_b') OVER (PARTITION BY g, i // 2) AS root FROM names) WHERE i % 2 = 0),
ed AS (SELECT k.u, k.v, k.gap_len, o.u = k.u AS along, o.query, o.my_end, o.their_start - o.my_end AS span FROM known k LEFT JOIN once o ON least(o.u, o.v) = k.u AND greatest(o.u, o.v) = k.v),
parts AS (
  SELECT 'scf' || lpad(CAST(r.k AS VARCHAR), 8, '0') AS obj, 2 * (n.i % 2) AS ord, n.comp, 1 + CASE WHEN n.i % 2 = 1 THEN coalesce(greatest(-e.span, 0), 0) ELSE 0 END AS comp_beg, 200000 AS comp_end, '+' AS orientation, CAST(NULL AS INT) AS gap_len
  FROM names n JOIN roots r ON r.g = n.g AND r.i = n.i // 2 * 2 LEFT JOIN ed e ON e.v = n.comp || '_b'
  UNION ALL SELECT 'scf' || lpad(CAST(r.k AS VARCHAR), 8, '0'), 1, CASE WHEN span > 0 THEN query END, CASE WHEN span > 0 THEN my_end + 1 END, CASE WHEN span > 0 THEN my_end + span END, CASE WHEN span > 0 THEN CASE WHEN along THEN '+' ELSE '-' END END, CASE WHEN span IS NULL THEN e.gap_len END
  FROM names n JOIN roots r ON r.g = n.g AND r.i = n.i JOIN ed e ON e.u = n.comp || '_e' WHERE span > 0 OR span IS NULL)"""


@query(f"""{_PATCHED} SELECT obj, CAST(sum(coalesce(gap_len, comp_end - comp_beg + 1)) OVER w AS BIGINT) AS obj_end, row_number() OVER w AS pid, comp, CAST(comp_beg AS BIGINT) AS comp_beg, CAST(comp_end AS BIGINT) AS comp_end, orientation, CAST(gap_len AS BIGINT) AS gap_len
FROM parts WINDOW w AS (PARTITION BY obj ORDER BY ord)""")
def patch_layout(spark, d):
    """Own gaps are filled only, so each end has one neighbour at most and the best matching is all edges."""
    group = F.floor(F.col("p_partkey") / 4).cast("string")
    names = ad.table(spark, d, "part").select(group.alias("g")).distinct().withColumn("i", F.explode(F.array(*map(F.lit, range(5)))))
    names = names.withColumn("name", F.concat(F.lit("ref"), F.col("i").cast("string"), F.lit("t"), "g"))
    part = placement.sequence_part(F.col("name"), F.lit(200_000), F.lit("+"), 2 * F.col("i"))
    gap = placement.gap_part(F.lit("N"), F.when(F.col("i") == 0, 50).otherwise(70), 2 * F.col("i") + 1, F.lit("scaffold"), F.lit("yes"), F.lit("align_genus"))
    obj = F.concat("g", F.lit("."), F.floor(F.col("i") / 2).cast("string"))
    laid = placement.laid_out(names.select(obj.alias("obj"), F.explode(F.when((F.col("i") % 2 == 0) & (F.col("i") < 4), F.array(part, gap)).otherwise(F.array(part))).alias("p")).select("obj", "p.*"))
    lengths = names.select("name", F.lit(200_000).cast("long").alias("length")).unionByName(ad.part_sequences(spark, d))
    out = pipelines.patch(_targets(spark, d), laid, lengths, HOW, 300, 60_000, fill_only=True)
    return out.select("obj", "obj_end", "pid", "comp", "comp_beg", "comp_end", "orientation", "gap_len")

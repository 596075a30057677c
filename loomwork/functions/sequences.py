"""Column functions on sequences, qualities and alignments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Complements of the IUPAC codes.
_CODES = "ACGTURYSWKMBDHVNacgturyswkmbdhvn"
_COMPLEMENTS = "TGCAAYRSWMKVHDBNtgcaayrswmkvhdbn"

# Restriction enzymes and their sites; N stands for any base.
ENZYMES = {"HINDIII": "AAGCTT", "SAU3AI": "GATC", "MBOI": "GATC", "DPNII": "GATC", "HINFI": "GANTC", "DDEI": "CTNAG", "MSEI": "TTAA"}


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, _CODES, _COMPLEMENTS))


def error_to_quality(p: Column) -> Column:
    """Phred quality; rounds half to even."""
    return F.rint(-10 * F.log(10.0, p)).cast("long")


def quality_to_error(q: Column) -> Column:
    return F.pow(F.lit(10.0), q / -10)


def chain_matches(matches_a: Column, length_a: Column, matches_b: Column, length_b: Column, length: Column) -> Column:
    """Matches of a chain of ``length`` with the mean identity of two alignments."""
    return F.rint((matches_a / length_a + matches_b / length_b) / 2 * length).cast("long")


def gap_string(length: Column) -> Column:
    return F.repeat(F.lit("N"), length.cast("int"))


def sites_pattern(names: list[str]) -> str:
    """The pattern of all sites of enzymes (any case) or of sites given as bases."""
    sites = []
    for name in names:
        site = ENZYMES.get(name.upper(), name.upper())
        if not site or set(site) - set("ACGTN"):
            raise ValueError(f"unknown enzyme: {name}")
        sites.append(site.replace("N", "[ACGT]"))
    return "|".join(sites)


def site_starts(seq: Column, pattern: str) -> Column:
    """Starts (from 0) of non-overlapping matches, in order. Case matters."""
    between = F.split(seq, pattern, -1)
    hits = F.regexp_extract_all(seq, F.lit(f"({pattern})"), F.lit(1))
    sizes = F.zip_with(F.slice(between, F.lit(1), F.size(between) - 1), hits, lambda a, b: F.struct(F.length(a).alias("a"), F.length(b).alias("b")))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("all"))
    return F.aggregate(sizes, start, lambda acc, x: F.struct((acc["at"] + x["a"] + x["b"]).alias("at"), F.concat(acc["all"], F.array(acc["at"] + x["a"])).alias("all")), lambda acc: acc["all"])


def sites_upto(sites: Column, pos: Column) -> Column:
    return F.size(F.filter(sites, lambda x: x <= pos))


def half_cutoffs(length: Column, share: float = 1.0) -> tuple[Column, Column]:
    """Where the left part ends and the right part begins: ``share`` of each half, counted from the ends."""
    if not 0 < share <= 1:
        raise ValueError("the share must be over 0 and at most 1")
    left = F.floor(length / 2)
    right = length - left
    return F.rint(left * share).cast("long"), length - F.rint(right * share).cast("long")


def node_end(seq: Column, pos: Column, left: Column, right: Column) -> Column:
    """The end of a sequence that a position belongs to; null between the parts."""
    return F.when(pos > right, F.concat(seq, F.lit("_e"))).when(pos <= left, F.concat(seq, F.lit("_b")))


def cigar_from_offsets(offsets: Column, ref_span: Column) -> Column:
    """The CIGAR of a delta alignment from its signed indel offsets: d > 0 is d - 1 matches and a deletion, d < 0
    as many matches and an insertion; neighbouring equal operations are one. The reference span gives the tail."""
    step = lambda acc, d: F.struct(
        F.concat(acc["ops"], F.array(F.struct((F.abs(d) - 1).alias("n"), F.lit("M").alias("op")), F.struct(F.lit(1).cast("long").alias("n"), F.when(d > 0, "D").otherwise("I").alias("op")))).alias("ops"),
        (acc["used"] + F.abs(d) - 1 + F.when(d > 0, 1).otherwise(0)).alias("used"),
    )
    start = F.struct(F.expr("cast(array() as array<struct<n:bigint,op:string>>)").alias("ops"), F.lit(0).cast("long").alias("used"))
    ops = F.aggregate(F.transform(offsets, lambda d: d.cast("long")), start, step, lambda acc: F.concat(acc["ops"], F.array(F.struct((ref_span - acc["used"]).alias("n"), F.lit("M").alias("op")))))
    ops = F.filter(ops, lambda x: x["n"] > 0)
    fused = F.aggregate(ops, F.expr("cast(array() as array<struct<n:bigint,op:string>>)"), lambda acc, x: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["op"] == x["op"]), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct((F.try_element_at(acc, F.lit(-1))["n"] + x["n"]).alias("n"), x["op"].alias("op"))))).otherwise(F.concat(acc, F.array(x))))
    return F.array_join(F.transform(fused, lambda x: F.concat(x["n"].cast("string"), x["op"])), "")


def offsets_from_cigar(cigar: Column) -> Column:
    """The signed indel offsets of a CIGAR: the inverse of cigar_from_offsets. Clips are skipped; operations other
    than M, I, D, S, H, = and X are an error."""
    bad = F.regexp_replace(cigar, r"\d+[MIDSH=X]", "") != ""
    ops = F.regexp_extract_all(cigar, F.lit(r"(\d+[MID=X])"), F.lit(1))
    ops = F.transform(ops, lambda x: F.struct(F.regexp_extract(x, r"\d+", 0).cast("long").alias("n"), F.substr(x, F.length(x)).alias("op")))
    # (matches since the last indel, offsets)
    start = F.struct(F.lit(0).cast("long").alias("run"), F.expr("cast(array() as array<bigint>)").alias("all"))

    def step(acc, x):
        sign = F.when(x["op"] == "D", 1).otherwise(-1).cast("long")
        more = F.concat(F.array((acc["run"] + 1) * sign), F.array_repeat(sign, (x["n"] - 1).cast("int")))
        match = x["op"].isin("M", "=", "X")
        return F.struct(F.when(match, acc["run"] + x["n"]).otherwise(0).alias("run"), F.when(match, acc["all"]).otherwise(F.concat(acc["all"], more)).alias("all"))

    found = F.aggregate(ops, start, step, lambda acc: acc["all"])
    return F.when(bad, F.raise_error(F.concat(F.lit("unknown operation in "), cigar)).cast("array<bigint>")).otherwise(found)

"""The queries of this package, by name, and their SQL."""

from __future__ import annotations

from .bpe import op7_bpe
from .exact_dedup import OP6_SQL, op6_exact_dedup
from .jaccard import OP8_SQL, op8_jaccard_join
from .licenses import op2_license_scan
from .mixing import OP10_SQL, op10_mixing
from .quality import op5_quality
from .quality_rules import op9_quality_rules
from .substring_dedup import OP1_SQL, op1_substring_dedup
from .suffix_dedup import op3_suffix_array_dedup
from .toxicity import op4_toxicity

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_license_scan": op2_license_scan,
    "op3_suffix_array_dedup": op3_suffix_array_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_quality": op5_quality,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_bpe": op7_bpe,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_quality_rules": op9_quality_rules,
    "op10_mixing": op10_mixing,
}

ORACLE_SQL = {
    "op1_substring_dedup": OP1_SQL,
    "op6_exact_dedup": OP6_SQL,
    "op8_jaccard_join": OP8_SQL,
    "op10_mixing": OP10_SQL,
}

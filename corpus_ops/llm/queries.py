"""Queries of these operators, with SQL where it can say the same."""

from __future__ import annotations

from .p1_pack import P1_CUT_SQL, p1_cut, p1_pack, p1_unused
from .p2_quality import P2_WORDS_SQL, p2_found, p2_reasons, p2_statistics, p2_words
from .p3_copies import p3_copies, p3_found
from .p4_pages import p4_bodies, p4_found
from .p5_splits import p5_counts, p5_found
from .p6_answers import p6_defects, p6_found
from .p7_code import p7_found, p7_kinds
from .p8_leaks import P8_FOUND_SQL, p8_found, p8_leaks
from .p9_mix import p9_mix, p9_shares
from .p10_residue import p10_found, p10_residue

_ALL = (
    p1_pack, p1_unused, p1_cut, p2_statistics, p2_reasons, p2_words, p2_found, p3_copies, p3_found, p4_bodies, p4_found, p5_counts, p5_found, p6_defects, p6_found,
    p7_kinds, p7_found, p8_leaks, p8_found, p9_mix, p9_shares, p10_residue, p10_found,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {"p1_cut": P1_CUT_SQL, "p2_words": P2_WORDS_SQL, "p8_found": P8_FOUND_SQL}

"""The sequence functions under names that SQL text can use."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .chars import MASKS

_SITES = "size(filter(zip_with(split(a, ''), split(b, ''), (x, y) -> {test}), z -> z))"
_VALID = "instr('NXO-?.', x) = 0 AND instr('NXO-?.', y) = 0"
_ACGT = "instr('ACGT', x) > 0 AND instr('ACGT', y) > 0"
_MASK = "coalesce(get(array(" + ", ".join(map(str, MASKS)) + "), ascii({c})), 0)"

#: Name, arguments and body; all give a number of sites.
FUNCTIONS = {
    "seq_count_valid": ("s STRING", r"length(regexp_replace(s, '[NXO?.\\-]', ''))"),
    "seq_count_acgt": ("s STRING", "length(regexp_replace(s, '[^ACGT]', ''))"),
    "seq_valid_pairs": ("a STRING, b STRING", _SITES.format(test=_VALID)),
    "seq_acgt_pairs": ("a STRING, b STRING", _SITES.format(test=_ACGT)),
    "seq_acgt_matches": ("a STRING, b STRING", _SITES.format(test=f"{_ACGT} AND x = y")),
    "seq_acgt_mismatches": ("a STRING, b STRING", _SITES.format(test=f"{_ACGT} AND x <> y")),
    "seq_text_matches": ("a STRING, b STRING", _SITES.format(test=f"{_VALID} AND x = y")),
    "seq_text_mismatches": ("a STRING, b STRING", _SITES.format(test=f"{_VALID} AND x <> y")),
    "seq_partial_matches": ("a STRING, b STRING", _SITES.format(test=f"{_VALID} AND (x = y OR ({_MASK.format(c='x')} & {_MASK.format(c='y')}) <> 0)")),
    "seq_left_only": ("a STRING, b STRING", _SITES.format(test="instr('NXO-?.', x) = 0 AND instr('NXO-?.', y) > 0")),
    "seq_left_acgt_only": ("a STRING, b STRING", _SITES.format(test="instr('ACGT', x) > 0 AND instr('ACGT', y) = 0")),
    "seq_differences": ("a STRING, b STRING", _SITES.format(test="x <> y")),
}


_BITS = "bit_count({m})"
_M1, _M2 = _MASK.format(c="x"), _MASK.format(c="y")
_SNPS = f"filter(transform(zip_with(split(a, ''), split(b, ''), (x, y) -> {_VALID} AND x <> y), (z, i) -> if(z, CAST(i AS BIGINT), NULL)), z -> z IS NOT NULL)"
_RUNS = r"zip_with(regexp_extract_all(c, '(\\d+)([MXID])', 1), regexp_extract_all(c, '(\\d+)([MXID])', 2), (n, op) -> named_struct('n', CAST(n AS BIGINT), 'op', op))"
_OVER_RUNS = f"aggregate({_RUNS}, 0L, (s, r) -> s + {{weight}})"
_COUNT = lambda ops: _OVER_RUNS.format(weight=f"if(instr('{ops}', r.op) > 0, r.n, 0L)")
_PROJECTED = f"""array_join(aggregate({_RUNS}, named_struct('at', 1L, 'parts', CAST(array() AS ARRAY<STRING>)), (s, r) -> named_struct('at', s.at + if(r.op = 'D', 0L, r.n), 'parts',
 concat(s.parts, array(CASE r.op WHEN 'D' THEN repeat('-', CAST(r.n AS INT)) WHEN 'I' THEN '' ELSE substring(a, CAST(s.at AS INT), CAST(r.n AS INT)) END)))).parts, '')"""
#: Functions with other results: name, arguments, type and body.
OTHERS = {
    # -1: the left one knows more sites, 1: the right one, 0: the same sites, 255: each knows sites of its own.
    "seq_resolution": ("a STRING, b STRING", "BIGINT", "CASE WHEN seq_left_only(a, b) > 0 AND seq_left_only(b, a) > 0 THEN 255 WHEN seq_left_only(a, b) > 0 THEN -1 WHEN seq_left_only(b, a) > 0 THEN 1 ELSE 0 END"),
    "seq_resolution_acgt": ("a STRING, b STRING", "BIGINT", "CASE WHEN seq_left_acgt_only(a, b) > 0 AND seq_left_acgt_only(b, a) > 0 THEN 255 WHEN seq_left_acgt_only(a, b) > 0 THEN -1 WHEN seq_left_acgt_only(b, a) > 0 THEN 1 ELSE 0 END"),
    # What follows from an alignment's operations.
    "seq_cigar_cost": ("c STRING", "BIGINT", _OVER_RUNS.format(weight="CASE r.op WHEN 'X' THEN 4 * r.n WHEN 'M' THEN 0L ELSE 6 + 2 * r.n END")),
    "seq_cigar_ref_sites": ("c STRING", "BIGINT", _COUNT("MXD")),
    "seq_cigar_letters": ("c STRING", "BIGINT", _COUNT("MXI")),
    "seq_cigar_identity": ("c STRING", "DOUBLE", f"round({_COUNT('M')} / greatest(1L, {_COUNT('MXID')}), 8)"),
    "seq_cigar_projected": ("a STRING, c STRING", "STRING", _PROJECTED),
    # Sites that differ from a reference.
    "seq_snp_sites": ("a STRING, b STRING", "ARRAY<BIGINT>", _SNPS),
    # Partial matches by the share of equal base pairs among those that both letters stand for.
    "seq_weighted_matches": ("a STRING, b STRING", "DOUBLE", f"aggregate(zip_with(split(a, ''), split(b, ''), (x, y) -> CASE WHEN {_M1} > 0 AND {_M2} > 0 THEN {_BITS.format(m=f'({_M1} & {_M2})')} / CAST({_BITS.format(m=_M1)} * {_BITS.format(m=_M2)} AS DOUBLE) ELSE 0D END), 0D, (s, z) -> s + z)"),
}


def register(spark: SparkSession) -> None:
    """Makes ``FUNCTIONS`` and ``OTHERS`` temporary functions of the session; Catalyst sees their bodies."""
    for name, (arguments, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS BIGINT RETURN CAST({body} AS BIGINT)")
    for name, (arguments, kind, body) in OTHERS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")

"""Character classes of aligned sequences, and functions of one or two of them, as Spark columns.

Sequences are upper case.  ``N X O - ? .`` tell nothing about a site; every other character is valid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACGT = "ACGT"
INVALID = "NXO-?."
#: Bases that a letter stands for, as bits A 1, C 2, G 4, T 8 (fixed values of the IUPAC code).
MASK = {"A": 1, "C": 2, "G": 4, "T": 8, "U": 8, "R": 5, "Y": 10, "S": 6, "W": 9, "K": 12, "M": 3, "B": 14, "D": 13, "H": 11, "V": 7}
MASKS = [MASK.get(chr(i), 0) for i in range(128)]


def normalise(seq: Column) -> Column:
    """Without blanks, ASCII letters in upper case."""
    return F.translate(F.regexp_replace(seq, r"\s", ""), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def trimmed(seq: Column, trim: int) -> Column:
    return F.substring(seq, F.lit(trim + 1), F.length(seq) - 2 * trim)


def count_valid(seq: Column) -> Column:
    return F.length(F.regexp_replace(seq, r"[NXO?.\-]", "")).cast("long")


def count_acgt(seq: Column) -> Column:
    return F.length(F.regexp_replace(seq, "[^ACGT]", "")).cast("long")


def compress_acgt(seq: Column) -> Column:
    return F.regexp_replace(seq, "[^ACGT]", "")


def proportions(seq: Column) -> tuple[Column, Column]:
    """Shares of ACGT and of invalid characters."""
    n = F.length(seq)
    return F.round(count_acgt(seq) / n, 8), F.round((n - count_valid(seq)) / n, 8)


def is_acgt(c: Column) -> Column:
    return c.isin(*ACGT)


def is_valid(c: Column) -> Column:
    return ~c.isin(*INVALID)


def mask(c: Column) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, MASKS)), F.ascii(c)), F.lit(0))


def sites(df: DataFrame, seq: str = "seq", *keep: str) -> DataFrame:
    """A row ``site, c`` (from 0) for each character, with the columns ``keep``."""
    return df.select(*keep, F.posexplode(F.split(F.col(seq), "")).alias("site", "c"))


PAIR_COLUMNS = ("acgt", "text", "partial", "valid", "acgt_valid", "hamming", "left_only", "right_only", "left_acgt_only", "right_acgt_only")


def with_pair_counts(df: DataFrame, a: str, b: str, trim: int = 0) -> DataFrame:
    """Adds the counts of ``PAIR_COLUMNS`` over the sites of two aligned sequences:

    ACGT matches, text matches, matches of partial letters, valid pairs, ACGT pairs, raw
    differences, and sites that are known (or ACGT) on one side only."""

    def site(q: Column, r: Column) -> Column:
        vq, vr, aq, ar = is_valid(q), is_valid(r), is_acgt(q), is_acgt(r)
        tests = (
            aq & (q == r), vq & (q == r), vq & vr & ((q == r) | (mask(q).bitwiseAND(mask(r)) != 0)), vq & vr, aq & ar, q != r,
            vq & ~vr, vr & ~vq, aq & ~ar, ar & ~aq,
        )
        return F.struct(*[t.cast("int").alias(n) for n, t in zip(PAIR_COLUMNS, tests, strict=True)])

    letters = lambda c: F.split(trimmed(F.col(c), trim), "")
    df = df.withColumn("_pair", F.zip_with(letters(a), letters(b), site))
    zero = F.struct(*[F.lit(0).alias(n) for n in PAIR_COLUMNS])
    df = df.withColumn("_pair", F.aggregate("_pair", zero, lambda s, x: F.struct(*[(s[n] + x[n]).alias(n) for n in PAIR_COLUMNS])))
    return df.withColumns({n: F.col(f"_pair.{n}").cast("long") for n in PAIR_COLUMNS}).drop("_pair")


def resolution(left_only: Column, right_only: Column) -> Column:
    """-1: the left one knows more sites, 1: the right one, 0: the same sites, 255: each knows sites of its own."""
    return F.when((left_only > 0) & (right_only > 0), 255).when(left_only > 0, -1).when(right_only > 0, 1).otherwise(0).cast("long")

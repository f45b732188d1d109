"""Alignments as run-length strings (``53M1X2D64M``), and what follows from them, as Spark columns.

``M`` pairs equal letters, ``X`` different ones, ``D`` leaves out a letter of the sequence's place on the reference, ``I`` is a letter that the
reference lacks.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Costs of a mismatch, of a gap and of each letter in it (fixed values of the aligner).
MISMATCH, OPEN, EXTEND = 4, 6, 2
RUN = r"(\d+)([MXID])"


def is_cigar(cigar: Column) -> Column:
    return cigar.rlike(r"^(\d+[MXID])*$")


def runs(cigar: Column) -> Column:
    """The runs as ``array<struct<n bigint, op string>>``."""
    n, op = (F.regexp_extract_all(cigar, F.lit(RUN), F.lit(k)) for k in (1, 2))
    return F.zip_with(n, op, lambda n, op: F.struct(n.cast("long").alias("n"), op.alias("op")))


def total(cigar: Column, weight) -> Column:
    """Sum over the runs of ``weight(op, n)``."""
    return F.aggregate(runs(cigar), F.lit(0).cast("long"), lambda s, r: s + weight(r["op"], r["n"]))


def cost(cigar: Column) -> Column:
    return total(cigar, lambda op, n: F.when(op == "X", MISMATCH * n).when(op.isin("I", "D"), OPEN + EXTEND * n).otherwise(0))


def count(cigar: Column, ops: str) -> Column:
    """How many letters the runs of these operations have."""
    return total(cigar, lambda op, n: F.when(op.isin(*ops), n).otherwise(0))


def ref_sites(cigar: Column) -> Column:
    return count(cigar, "MXD")


def seq_letters(cigar: Column) -> Column:
    return count(cigar, "MXI")


def identity(cigar: Column) -> Column:
    """Matches per operation, to eight digits; 0 without any."""
    return F.round(count(cigar, "M") / F.greatest(F.lit(1), count(cigar, "MXID")), 8)


def projected(seq: Column, cigar: Column) -> Column:
    """The sequence in the reference's coordinates: insertions left out, deletions as ``-``."""
    start = F.struct(F.lit(1).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(s: Column, r: Column) -> Column:
        letters = F.substring(seq, s["at"].cast("int"), r["n"].cast("int"))
        part = F.when(r["op"] == "D", F.repeat(F.lit("-"), r["n"].cast("int"))).when(r["op"] == "I", "").otherwise(letters)
        return F.struct((s["at"] + F.when(r["op"] == "D", 0).otherwise(r["n"])).alias("at"), F.concat(s["parts"], F.array(part)).alias("parts"))

    return F.array_join(F.aggregate(runs(cigar), start, step)["parts"], "")

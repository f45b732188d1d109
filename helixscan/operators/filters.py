"""Filters of records (``ordinal, name, seq``) and checks of parameters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from helixscan.functions import chars


@dataclass(frozen=True)
class Parameters:
    """Options of the searches, clamped to what makes sense."""

    n: int = 100
    ref_ambiguity: float = 0.5
    query_ambiguity: float = 0.5
    trim: int = 0
    distance: int = 5
    acgt: bool = False
    keep_resolved: bool = False
    exclude_self: bool = False

    def clamped(self, length: int) -> Parameters:
        trim = max(0, min(self.trim, int(length / 2.1)))
        unit = lambda x: min(1.0, max(0.001, x))
        return Parameters(
            max(1, self.n), unit(self.ref_ambiguity), unit(self.query_ambiguity), trim,
            max(0, min(self.distance, (length - 2 * trim) // 10)), self.acgt, self.keep_resolved, self.exclude_self,
        )


def query_is_clear(seq: Column, ambiguity: float = 0.5) -> Column:
    """At least five characters, not too many that tell nothing and enough ACGT."""
    n = F.length(seq)
    return (n >= 5) & ((n - chars.count_valid(seq)) / n <= ambiguity) & (chars.count_acgt(seq) / n >= 1 - 1.1 * ambiguity)


def reference_is_clear(seq: Column, ambiguity: float = 0.5, length: int | None = None) -> Column:
    least = F.floor(F.length(seq) * (1 - ambiguity)) if length is None else F.lit(int(length * (1 - ambiguity)))
    return chars.count_valid(seq) >= least


def ball_reference_is_clear_as_written(seq: Column, ambiguity: float = 0.5) -> Column:
    """The ball search's own threshold, which differs from the nearest search's except at one half."""
    return chars.count_valid(seq) >= F.floor(F.length(seq) * ambiguity)


def unaligned_is_clear(seq: Column, length: Column | int, ambiguity: float = 0.5) -> Column:
    """Between two thirds and three halves of the reference's length, and clear enough."""
    n = F.length(seq)
    length = F.lit(length) if isinstance(length, int) else length
    fits = (3 * n >= 2 * length) & (2 * n <= 3 * length)
    return fits & ((n - chars.count_valid(seq)) / n <= ambiguity) & (chars.count_acgt(seq) / n >= 1 - 1.1 * ambiguity)


def aligned_length(df: DataFrame) -> int:
    """The common length of all records; raises if they differ.  0 for an empty table."""
    lo, hi = df.agg(F.min(F.length("seq")), F.max(F.length("seq"))).first()
    if lo != hi:
        raise ValueError(f"sequences have {lo} to {hi} sites; they must be aligned")
    return lo or 0


def of_length(df: DataFrame, length: int, what: str = "reference") -> DataFrame:
    """The same records; one with another length stops the search, by its name, whatever its quality.  A ``length`` of 0 asks nothing."""
    if not length:
        return df
    told = F.concat(F.lit(f"{what} "), F.coalesce("name", F.lit("without a name")), F.lit(" has "), F.length("seq").cast("string"), F.lit(f" sites instead of {length}"))
    return df.withColumn("seq", F.when(F.length("seq") == length, F.col("seq")).otherwise(F.raise_error(told)))


def without_names(refs: DataFrame, queries: DataFrame) -> DataFrame:
    """References whose name is no query's."""
    return refs.join(queries.select("name").distinct(), "name", "left_anti").select(*refs.columns)


def marked(refs: DataFrame, queries: DataFrame | None) -> DataFrame:
    """References with ``_same``: whether a query has the name; ``None``: names don't matter."""
    if queries is None:
        return refs.withColumn("_same", F.lit(False))
    names = queries.select("name").distinct().withColumn("_same", F.lit(True))
    return refs.join(names, "name", "left").select(*refs.columns, F.coalesce("_same", F.lit(False)).alias("_same"))


def counts(ambiguity: float) -> list[Column]:
    """References read, of a query's name, too ambiguous, and left, of ``marked`` ones."""
    same, clear = F.col("_same"), reference_is_clear(F.col("seq"), ambiguity)
    return [F.count(F.lit(1)).alias("n_read"), F.count_if(same).alias("n_same_name"), F.count_if(~same & ~clear).alias("n_ambiguous"), F.count_if(~same & clear).alias("n_kept")]


def kept_references(refs: DataFrame, queries: DataFrame | None, ambiguity: float = 0.5, counters: Observation | None = None) -> DataFrame:
    """Clear references of which no query (if given) has the name.  ``counters`` gets ``counts`` when they have been read for the first time."""
    clear = reference_is_clear(F.col("seq"), ambiguity)
    if counters is None:
        return (refs if queries is None else without_names(refs, queries)).where(clear)
    return marked(refs, queries).observe(counters, *counts(ambiguity)).where(~F.col("_same") & clear).drop("_same")


def run_counters(refs: DataFrame, queries: DataFrame, ambiguity: float = 0.5) -> DataFrame:
    """One row: references read, of a query's name, too ambiguous, and left."""
    return marked(refs, queries).agg(*counts(ambiguity))

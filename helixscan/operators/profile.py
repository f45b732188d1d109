"""The site profile of a set of aligned queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixscan.functions import chars
from helixscan.sources.storage import numbered

UNUSED, CONSTANT, MISSING, SEGREGATING = "u", "c", "m", "p"


def counts(c: Column, acgt: bool) -> Column:
    return chars.is_acgt(c) if acgt else chars.is_valid(c)


def site_profile(queries: DataFrame, acgt: bool = False, trim: int = 0) -> DataFrame:
    """``site, n_distinct, n_missing, class, consensus`` for every site of the alignment.

    Counted first by site and character, so that the shuffle holds a few rows for each site and task."""
    length = F.length("seq")
    by_char = queries.select(length.alias("length"), F.posexplode(F.split("seq", "")).alias("site", "c")).groupBy("site", "c").agg(F.count("*").alias("n"), F.max("length").alias("length"))
    used = (F.col("site") >= trim) & (F.col("site") < F.col("length") - trim)
    known = counts(F.col("c"), acgt)
    out = by_char.groupBy("site").agg(
        F.count_if(known).alias("n_distinct"), F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("n_missing"),
        F.max(F.when(known, F.col("c"))).alias("c"), F.max(used).alias("used"),
    )
    kind = F.when(~F.col("used") | (F.col("n_distinct") == 0), UNUSED).when(F.col("n_distinct") > 1, SEGREGATING).when(F.col("n_missing") > 0, MISSING).otherwise(CONSTANT)
    consensus = F.when(kind == UNUSED, "N").when(kind == SEGREGATING, "#").otherwise(F.col("c"))
    return out.select(F.col("site").cast("long").alias("site"), "n_distinct", F.col("n_missing").cast("long").alias("n_missing"), kind.alias("class"), consensus.alias("consensus"))


def consensus(profile: DataFrame) -> DataFrame:
    """One row: the consensus string, ``#`` where sites segregate, ``N`` where nothing is known.  As long as the alignment."""
    letters = F.array_sort(F.collect_list(F.struct("site", "consensus")))
    return profile.agg(F.array_join(F.transform(letters, lambda x: x["consensus"]), "").alias("consensus"))


def class_counts(profile: DataFrame) -> DataFrame:
    return profile.groupBy("class").agg(F.count("*").alias("n_sites"))


def query_order(queries: DataFrame, acgt: bool = False, trim: int = 0) -> DataFrame:
    """``resolution_order`` from 1: least resolved queries first, then by ordinal.

    Ranks are counted in the ranges of a distributed sort, so that many queries with the same number of sites don't meet in a task."""
    seq = chars.trimmed(F.col("seq"), trim)
    known = queries.select("ordinal", "name", (chars.count_acgt(seq) if acgt else chars.count_valid(seq)).alias("n_known"))
    return numbered(known, "resolution_order", "n_known", "ordinal").withColumn("resolution_order", F.col("resolution_order") + 1)

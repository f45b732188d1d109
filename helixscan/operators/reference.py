"""The reference genome of a set of records, and records against it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixscan.functions import chars

from . import filters, kernels

#: Ordinals from the least one on that are looked at first, and bytes of sequence at once.
FIRST, BYTES = 1024, 2 << 20


def first_known(records: DataFrame, sites: np.ndarray) -> dict[int, str]:
    """The first ACGT at each of the sites (by ordinal), where a record has one.  A task hands on a row for each site at most."""
    step = max(1, BYTES // max(1, len(sites)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, base = np.full(len(sites), np.iinfo(np.int64).max), np.zeros(len(sites), np.uint8)
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                seq = kernels.matrix(batch.column("seq").cast(pa.binary()).to_pylist())[:, sites]
                ordinal = np.where(kernels.IS_ACGT[seq], batch.column("ordinal").to_numpy()[:, None], np.iinfo(np.int64).max)
                row = ordinal.argmin(0)
                least = ordinal[row, np.arange(len(sites))]
                base = np.where(least < first, seq[row, np.arange(len(sites))], base)
                first = np.minimum(first, least)
        some = np.flatnonzero(base)
        yield pa.RecordBatch.from_arrays([pa.array(sites[some], pa.int64()), pa.array(first[some], pa.int64()), pa.array([chr(c) for c in base[some]], pa.string())], names=["site", "ordinal", "base"])

    found = records.select("ordinal", "seq").mapInArrow(run, "site long, ordinal long, base string")
    return {r["site"]: r["base"] for r in found.groupBy("site").agg(F.min_by("base", "ordinal").alias("base")).collect()}


def backbone(records: DataFrame) -> str:
    """The first ACGT that any record has at a site, by ordinal; ``A`` where none has one.  One character for each site is on the driver.

    Records up to ``FIRST`` after the least ordinal are looked at first; of all others only the sites that none of those knew."""
    first = records.agg(F.min("ordinal"), F.min(F.struct("ordinal", F.length("seq").alias("n")))).first()
    if first[0] is None:
        return ""
    records = filters.of_length(records, first[1]["n"], "record")
    base = np.full(first[1]["n"], "?")
    for part in (records.where(F.col("ordinal") < first[0] + FIRST), records.where(F.col("ordinal") >= first[0] + FIRST)):
        missing = np.flatnonzero(base == "?")
        if len(missing):
            for site, letter in first_known(part, missing).items():
                base[site] = letter
    return "".join(np.where(base == "?", "A", base))


def synthesised(records: DataFrame) -> DataFrame:
    """``site, base``: the letters of ``backbone``."""
    one = records.sparkSession.range(1).select(F.posexplode(F.split(F.lit(backbone(records)), "")).alias("site", "base"))
    return one.select(F.col("site").cast("long").alias("site"), "base").where("base != ''")


def snps(records: DataFrame, reference: str, trim: int = 0) -> DataFrame:
    """``ordinal, name, seq, snp_sites``: sites (from the trim on) that differ from the reference where both are valid."""
    letters = F.split(chars.trimmed(F.col("seq"), trim), "")
    base = F.split(chars.trimmed(F.lit(reference), trim), "")
    differs = F.zip_with(letters, base, lambda a, b: chars.is_valid(a) & chars.is_valid(b) & (a != b))
    placed = F.filter(F.transform(differs, lambda d, i: F.when(d, i.cast("long"))), lambda i: i.isNotNull())
    return records.withColumn("snp_sites", placed)


def snp_vs_reference(records: DataFrame, reference: str, n: int = 1, trim: int = 0) -> DataFrame:
    """``ordinal, name, distance``, and the first ``n`` SNP sites as ``snp_1``...; -1 where there are fewer."""
    found = snps(records, reference, trim)
    return found.select("ordinal", "name", F.size("snp_sites").cast("long").alias("distance"), *[F.coalesce(F.get("snp_sites", F.lit(k)), F.lit(-1)).cast("long").alias(f"snp_{k + 1}") for k in range(n)])


def snp_counter(records: DataFrame, reference: str, trim: int = 0) -> DataFrame:
    """``site, n_snps`` over all records, for sites that have any."""
    return snps(records, reference, trim).select(F.explode("snp_sites").alias("site")).groupBy("site").agg(F.count("*").alias("n_snps"))


def snp_sites(counter: DataFrame, more_than: int = 0) -> DataFrame:
    return counter.where(F.col("n_snps") > more_than).select("site")

"""Records as what sets them apart from a reference: SNP columns and runs of unknown sites.

A record of 30,000 sites is a few dozen sites with their letters and a few runs; that is what shuffles and groups of the clustering and
redundancy operators hold.  Sites that are in neither equal the reference.  Two records can differ only at a site where one of them
has a SNP, so that ``columns`` of some records, the union of their SNP sites, gives all distances between them.

``units`` brings together all pairs of records within a distance, by a pigeonhole index.  The sites are cut into ``distance + 1 + 2 * WILD`` blocks with equal
numbers of SNPs.  A record with unknown sites among a block's SNP sites is wild there.  Of two records with ``WILD`` wild blocks at
most, one block is wild in neither and without a difference, since each difference spoils one block: they have the same key there.
Records with more wild blocks meet all others instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixscan.sources.storage import written

from . import filters, kernels

#: Columns of a sparse record: sites (from the trim on), their letters, and runs of unknown sites as begin, end, begin, end...
COLUMNS = ("sites", "letters", "unknown")
#: Wild blocks that a record of the index may have; rows of one side in a unit, about.
WILD, SIDE = 2, 512
#: Bytes of sequence that are compared with the reference at once.
BYTES = 32 << 20


def lists(counts: np.ndarray, values: np.ndarray) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)))


def described(seqs: list[bytes], reference: bytes, trim: int, raw: bool) -> list[pa.Array]:
    """``d_ref, snp, known, sites, letters, unknown`` of each sequence."""
    whole = kernels.matrix(seqs)
    seq = whole[:, trim : whole.shape[1] - trim]
    base = np.frombuffer(reference, np.uint8)[trim : len(reference) - trim]
    missing = ~kernels.IS_VALID[seq]
    differs = seq != base
    snps = differs & ~missing & kernels.IS_VALID[base]
    kept = differs if raw else differs & ~missing
    row, site = np.nonzero(kept)
    counts = kept.sum(1)
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    letters = pa.Array.from_buffers(pa.binary(), len(seqs), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(seq[row, site]))])
    if raw:
        missing = np.zeros_like(missing)
    edges = np.zeros((len(seqs), seq.shape[1] + 1), bool)
    edges[:, 0], edges[:, -1] = (missing[:, 0], missing[:, -1]) if seq.shape[1] else (False, False)
    edges[:, 1:-1] = missing[:, 1:] != missing[:, :-1]
    first = np.where(snps.any(1), snps.argmax(1), -1) if seq.shape[1] else np.full(len(seqs), -1)
    numbers = (snps.sum(1), first, kernels.IS_VALID[whole].sum(1))
    return [*(pa.array(x.astype(np.int64)) for x in numbers), lists(counts, site), letters, lists(edges.sum(1), np.nonzero(edges)[1])]


def records(df: DataFrame, reference: str, trim: int = 0, raw: bool = False, what: str = "record") -> DataFrame:
    """``ordinal, name, d_ref, snp, known`` (distance to the reference, place of the first SNP or -1, valid sites) and ``COLUMNS``.

    ``raw``: letters that tell nothing are letters like others."""
    base = reference.encode()
    step = max(1, BYTES // max(1, len(base)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                found = described(batch.column("seq").cast(pa.binary()).to_pylist(), base, trim, raw)
                yield pa.RecordBatch.from_arrays([batch.column("ordinal"), batch.column("name"), *found], names=["ordinal", "name", "d_ref", "snp", "known", *COLUMNS])

    sized = filters.of_length(df, len(reference), what).select("ordinal", "name", "seq")
    return sized.mapInArrow(run, "ordinal long, name string, d_ref long, snp long, known long, sites array<int>, letters binary, unknown array<int>")


def flat(values: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and values of a column of lists."""
    counts = values.map(len).to_numpy()
    joined = np.concatenate([np.asarray(v, np.int64) for v in values]) if len(values) else np.zeros(0, np.int64)
    return np.repeat(np.arange(len(values)), counts), joined.astype(np.int64)


def columns(rows: pd.DataFrame, reference: bytes) -> np.ndarray:
    """Letters of the records (``COLUMNS``) at the sites where one of them has a SNP; 0 where a record tells nothing.  ``reference``: without the trim."""
    row, site = flat(rows["sites"])
    at = np.unique(site)
    out = np.repeat(np.frombuffer(reference, np.uint8)[at][None], len(rows), 0)
    out[row, np.searchsorted(at, site)] = np.frombuffer(b"".join(bytes(x) for x in rows["letters"]), np.uint8)
    row, edge = flat(rows["unknown"])
    change = np.zeros((len(rows), len(at) + 1), np.int16)
    np.add.at(change, (row, np.searchsorted(at, edge)), np.where(np.arange(len(edge)) % 2, -1, 1))  # runs come in pairs
    out[np.cumsum(change, 1)[:, :-1] > 0] = 0
    return out


def unknown_cells(unknown: pd.Series) -> np.ndarray:
    """Whether each record knows nothing of each cell; cells reach from one begin or end of a run, in any record, to the next."""
    row, edge = flat(unknown)
    at = np.unique(edge)
    change = np.zeros((len(unknown), len(at) + 1), np.int16)
    np.add.at(change, (row, np.searchsorted(at, edge)), np.where(np.arange(len(edge)) % 2, -1, 1))
    return np.cumsum(change, 1)[:, :-1] > 0


#: Rows up to which pairs are compared directly, without matrix products.
FEW = 4


def differences(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sites that differ, for all pairs of rows of two matrices of ``columns``."""
    if min(len(a), len(b)) <= FEW:
        if len(a) > len(b):
            return differences(b, a).T
        known = b != 0
        return np.array([((b != x) & known & (x != 0)).sum(1) for x in a], np.int64).reshape(len(a), len(b))
    letters = [c for c in np.unique(a) if c]
    same = sum((a == c).astype(np.float32) @ (b == c).astype(np.float32).T for c in letters)
    return np.rint((a != 0).astype(np.float32) @ (b != 0).astype(np.float32).T - same).astype(np.int64)


# The index


def mixed(x: np.ndarray) -> np.ndarray:
    """64 well mixed bits of each number."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def block_keys(rows: pd.DataFrame, sites: np.ndarray, block: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each record in each block, and where it is wild.  ``sites``: all SNP sites in order; ``block``: their blocks."""
    n = len(rows)
    row, site = flat(rows["sites"])
    letter = np.frombuffer(b"".join(bytes(x) for x in rows["letters"]), np.uint8)
    keys = np.repeat(mixed(np.arange(blocks, dtype=np.uint64))[None], n, 0)
    np.add.at(keys, (row, block[np.searchsorted(sites, site)]), mixed(site.astype(np.uint64) << np.uint64(8) | letter.astype(np.uint64)))
    row, edge = flat(rows["unknown"])
    at = np.searchsorted(sites, edge)
    begin, end, row = at[::2], at[1::2], row[::2]
    some = begin < end
    change = np.zeros((n, blocks + 1), np.int32)
    np.add.at(change, (row[some], block[begin[some]]), 1)
    np.add.at(change, (row[some], block[end[some] - 1] + 1), -1)
    return keys.astype(np.int64), np.cumsum(change, 1)[:, :-1] > 0


def snp_blocks(counts: DataFrame, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """SNP sites (``site, n``; no more than the alignment has) in order, and the block of each: runs with about equal numbers of SNPs."""
    rows = counts.orderBy("site").collect()
    n = np.array([r["n"] for r in rows], np.int64)
    before = np.cumsum(n) - n
    return np.array([r["site"] for r in rows], np.int64), np.minimum(blocks - 1, blocks * before // max(1, int(n.sum())))


def indexed(df: DataFrame, sites: np.ndarray, block: np.ndarray, blocks: int, wild: int) -> DataFrame:
    """Adds ``keys`` (one for each block, null where the record is wild) and ``vague`` (too many wild blocks for the index)."""
    fields = df.schema.fields

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            keys, none = block_keys(rows, sites, block, blocks)
            yield rows.assign(keys=[[None if w else int(k) for k, w in zip(*x, strict=True)] for x in zip(keys, none, strict=True)], vague=none.sum(1) > wild)

    return df.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", keys array<long>, vague boolean")


def meeting(left: DataFrame, right: DataFrame, keys: list[str], side: int, label: str, once: bool = False) -> DataFrame:
    """Rows of both sides (``is_left``) by ``unit``: each left and right row with equal ``keys`` meet in a unit with about ``side`` rows of either.

    Keys of one side only go.  ``once``: both sides are the same rows, and a key of one row goes, too."""
    counted = [df.groupBy(*keys).agg(F.count("*").alias(c)) for df, c in ((left, "_l"), (right, "_r"))]
    both = counted[0].join(counted[1], keys)
    if once:
        both = both.where("_l > 1")
    both = both.select(*keys, F.ceil(F.col("_l") / side).alias("_l"), F.ceil(F.col("_r") / side).alias("_r"))
    parts = []
    for df, own, other, is_left in ((left, "_l", "_r", True), (right, "_r", "_l", False)):
        dealt = df.join(both, keys).withColumns({"_own": F.pmod(F.xxhash64("id"), own), "_other": F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))})
        place = ("_own", "_other") if is_left else ("_other", "_own")
        parts.append(dealt.withColumns({"unit": F.concat_ws("/", F.lit(label), *keys, *place), "is_left": F.lit(is_left)}).drop("_l", "_r", "_own", "_other", *keys))
    return parts[0].unionByName(parts[1])


def units(left: DataFrame, right: DataFrame, distance: int, by: list[str] | None = None, near: list[str] | None = None, wild: int = WILD, side: int = SIDE) -> DataFrame:
    """Rows of both sides (``is_left``) by ``unit``: each left and right row with equal ``by`` and at most ``distance`` differences meet in a unit.

    Both: ``id``, ``COLUMNS``, ``by`` and further columns.  ``near``: further columns that both sides have, for pairs that also
    have ``d_ref`` within ``distance``: records that the index can't take meet only those on the same or a neighbouring ring.  A pair may meet several times."""
    by, once = by or [], left is right
    plain = lambda df: df.drop("keys", "vague")
    sizes = [df.agg(F.count("*")).first()[0] for df in ((left,) if once else (left, right))]
    if sum(sizes) <= 2 * side:  # no more than the index would bring together in a unit
        return meeting(*(df.withColumn("_all", F.lit(0)) for df in (left, right)), ["_all", *by], side, "all")
    blocks = distance + 1 + 2 * wild
    found = left if once else left.select("sites").unionByName(right.select("sites"))
    sites, block = snp_blocks(found.select(F.explode("sites").alias("site")).groupBy("site").agg(F.count("*").alias("n")), blocks)
    if not len(sites):  # all records equal the reference, or tell nothing where they don't
        sites, block = np.zeros(1, np.int64), np.zeros(1, np.int64)
    own = written(indexed(left, sites, block, blocks, wild), "indexed")
    other = own if once else written(indexed(right, sites, block, blocks, wild), "indexed")

    def keyed(df: DataFrame) -> DataFrame:
        return df.where("NOT vague").select("*", F.posexplode("keys").alias("block", "key")).where("key IS NOT NULL").drop("keys", "vague")

    a, b = keyed(own), keyed(other)
    # Keys of few rows share a unit.
    counts = [df.groupBy(*by, "block", "key").agg(F.count("*").alias(c)) for df, c in ((a, "_a"), (b, "_b"))]
    both = counts[0].join(counts[1], [*by, "block", "key"])
    both = written(both.where("_a > 1") if once else both, "keys")
    rows = F.col("_a") if once else F.col("_a") + F.col("_b")
    small = rows <= side // 4
    bins = both.where(small).groupBy(*by, "block").agg(F.ceil(F.sum(rows) / (2 * side)).alias("_bins"))
    named = both.withColumn("_small", small).join(bins, [*by, "block"], "left").select(*by, "block", "key", F.when(F.col("_small"), F.pmod("key", "_bins")).otherwise(F.col("key")).alias("group"))
    a, b = (df.join(named, [*by, "block", "key"]).drop("key") for df in (a, b))
    out = meeting(a, b, [*by, "block", "group"], side, "clear", once)
    for label, x, y in (("vague", own.where("vague"), other), ("other", own.where("NOT vague"), other.where("vague"))):
        x, y = plain(x), plain(y)
        if near is not None:
            ring = F.floor(F.col("d_ref") / (distance + 1))
            x, y = x.withColumn("ring", ring), y.withColumn("ring", F.explode(F.array(ring - 1, ring, ring + 1)))
        else:
            x, y = x.withColumn("ring", F.lit(0).cast("long")), y.withColumn("ring", F.lit(0).cast("long"))
        out = out.unionByName(meeting(x, y, [*by, "ring"], side, label))
    return out

"""All references within a SNP distance of any query.

Mismatches with the consensus on sites that all queries share are counted first: most references are too far away by these alone.  Queries
that fit one block are sent to all tasks, where the other sites are compared run by run of sites, as long as some query is near enough.  More
queries than that meet the references on the pigeonhole index of sparse records, in one join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixscan.sources.storage import written

from . import filters, kernels, nearest, sparse
from .filters import Parameters
from .nearest import clear_queries, over_blocks, profile_arrays, spread
from .profile import site_profile
from .redundancy import keep_less_resolved

PAIR, CONSENSUS, AS_WRITTEN = "pair", "consensus", "as_written"
#: Runs of sites that are compared one after the other.
RUNS = 8


class Queries:
    """Queries at a run of sites, as the (site, letter) columns that some query has; bits until they are needed."""

    def __init__(self, q: np.ndarray, sites: np.ndarray, acgt: bool):
        self.known = kernels.IS_ACGT if acgt else kernels.IS_VALID
        own = q[:, sites]
        letters = np.array([c for c in np.flatnonzero(np.bincount(own.ravel(), minlength=256)) if self.known[c]], np.uint8)
        held = np.array([(own == c).any(0) for c in letters]).reshape(len(letters), len(sites))
        site, which = np.nonzero(held.T)
        self.site, self.letter = sites[site], letters[which]
        self.one_hot = own[:, site] == self.letter

    def other(self, r: np.ndarray) -> np.ndarray:
        """Where each reference has a letter that differs from a column's."""
        at = r[:, self.site]
        return (self.known[at] & (at != self.letter)).astype(np.float32)

    def mismatches(self, lo: int, hi: int, other: np.ndarray) -> np.ndarray:
        """Queries from ``lo`` to ``hi`` x references: pairs of letters that differ."""
        return self.one_hot[lo:hi].astype(np.float32) @ other.T


class Sites:
    """Which sites are compared with the consensus (``fixed``) and which with the queries (``own``)."""

    def __init__(self, queries: DataFrame, p: Parameters, mode: str):
        classes, self.consensus = profile_arrays(site_profile(queries, p.acgt, p.trim))
        self.fixed = np.flatnonzero(classes == ord("c") if mode == PAIR else np.isin(classes, [ord("c"), ord("m")]))
        self.own = np.flatnonzero(np.isin(classes, [ord("m"), ord("p")]) if mode == PAIR else classes == ord("p"))

    def outer(self, r: np.ndarray, acgt: bool) -> np.ndarray:
        """Mismatches of each reference with the consensus."""
        r, c = r[:, self.fixed], self.consensus[self.fixed]
        known = kernels.IS_ACGT if acgt else kernels.IS_VALID
        return ((r != c) & known[r] & known[c]).sum(1)


def within(runs: list[Queries], r: np.ndarray, outer: np.ndarray, p: Parameters, mode: str) -> tuple[np.ndarray, np.ndarray]:
    """References that may be within the distance, and the least mismatches of each with a query.

    Pairs are counted in tiles of bounded size, whatever the number of queries; a reference that some query equals needs no further one."""
    free = 2 * outer <= p.distance if mode == AS_WRITTEN else np.zeros(len(r), bool)  # accepted whatever the other sites are
    may = outer <= p.distance
    if not runs:
        return np.flatnonzero(may), np.zeros(int(may.sum()), np.int64)
    queries, none = len(runs[0].one_hot), np.iinfo(np.int64).max
    inner = np.full(len(r), none)
    step = min(max(16, kernels.PAIRS // max(1, min(queries, kernels.QUERIES))), max(16, 4 * kernels.PAIRS // max(1, max(len(q.site) for q in runs))))
    may = np.flatnonzero(may)
    for at in range(0, len(may), step):
        part = may[at : at + step]
        others = [q.other(r[part]) for q in runs]
        for lo in range(0, queries, kernels.QUERIES):
            hi = min(lo + kernels.QUERIES, queries)
            left, total = np.flatnonzero(inner[part] > 0), None
            for q, other in zip(runs, others, strict=True):
                new = q.mismatches(lo, hi, other if len(left) == len(part) else other[left])
                total = new if total is None else total + new
                near = (total.min(0) + outer[part[left]] <= p.distance) | free[part[left]]
                if not near.all():
                    left, total = left[near], total[:, near]
            inner[part[left]] = np.minimum(inner[part[left]], total.min(0).astype(np.int64))
    left = np.flatnonzero(inner < none)
    return left, inner[left]


def distances(refs: DataFrame, queries: DataFrame, p: Parameters, mode: str) -> DataFrame:
    """``ordinal, name, seq, outer, inner`` of references that may be within the distance: mismatches with the consensus on constant
    sites (and, but for ``pair``, on sites where some query misses it), and the least over the queries of the others."""
    sites = Sites(queries, p, mode)
    refs = spread(refs)
    if mode != AS_WRITTEN and nearest.total_sites(queries) > nearest.RESIDENT:
        return refs.join(joined(refs, queries, sites, p), "ordinal").select("ordinal", "name", "seq", "outer", "inner")

    def scored(block: list) -> tuple[DataFrame, Broadcast]:
        own = kernels.matrix([r["seq"].encode() for r in block])[:, sites.own]
        shared = refs.sparkSession.sparkContext.broadcast(kernels.matrix(list(dict.fromkeys(bytes(x) for x in own))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q = shared.value
            runs = [Queries(q, run, p.acgt) for run in np.array_split(np.arange(q.shape[1]), RUNS) if len(run)]
            for r, group, ordinal, name in kernels.chunks(batches, nearest.CHUNK):  # equal sequences are compared once
                outer = sites.outer(r, p.acgt)
                left, inner = within(runs, r[:, sites.own], outer, p, mode)
                place = np.full(len(r), -1)
                place[left] = np.arange(len(left))
                record = np.flatnonzero(place[group] >= 0)
                found, seqs = place[group[record]], kernels.texts(r[left])
                for at in range(0, len(record), 10_000):
                    i, k = record[at : at + 10_000], found[at : at + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array(ordinal[i]), name.take(pa.array(i)).combine_chunks(), seqs.take(pa.array(k)), pa.array(outer[left][k].astype(np.int64)), pa.array(inner[k])], names=["ordinal", "name", "seq", "outer", "inner"])

        return refs.select("ordinal", "name", "seq").mapInArrow(run, "ordinal long, name string, seq string, outer long, inner long"), shared

    out, several = over_blocks(queries, scored, "distances", "ordinal", "outer", "inner")
    if out is None:
        return refs.select("ordinal", "name", "seq", F.lit(0).cast("long").alias("outer"), F.lit(0).cast("long").alias("inner")).limit(0)
    if several:  # the nearest query of all blocks; sequences are looked up afterwards
        out = refs.join(out.groupBy("ordinal").agg(F.max("outer").alias("outer"), F.min("inner").alias("inner")), "ordinal")
    return out.select("ordinal", "name", "seq", "outer", "inner")


def sparse_sites(df: DataFrame, sites: Sites, p: Parameters, base: bytes, most: int | None) -> DataFrame:
    """``id, outer, d_ref`` and sparse records of the sites that are compared with queries; ``most``: without records of more mismatches with the consensus."""
    known = kernels.IS_ACGT if p.acgt else kernels.IS_VALID

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(16, sparse.BYTES // max(1, len(sites.consensus)))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                r = kernels.matrix(batch.column("seq").cast(pa.binary()).to_pylist())
                outer = sites.outer(r, p.acgt)
                left = np.flatnonzero(outer <= most) if most is not None else np.arange(len(r))
                own = r[np.ix_(left, sites.own)]
                own = np.where(known[own], own, ord("N")).astype(np.uint8)
                d_ref, _, _, *found = sparse.described([bytes(x) for x in own], base, 0, False)
                yield pa.RecordBatch.from_arrays([batch.column("ordinal").take(pa.array(left)), pa.array(outer[left].astype(np.int64)), d_ref, *found], names=["id", "outer", "d_ref", *sparse.COLUMNS])

    return df.select("ordinal", "seq").mapInArrow(run, "id long, outer long, d_ref long, sites array<int>, letters binary, unknown array<int>")


def joined(refs: DataFrame, queries: DataFrame, sites: Sites, p: Parameters) -> DataFrame:
    """``ordinal, outer, inner`` of the references within the distance of a query, by the index."""
    first = queries.orderBy("ordinal").select("seq").first()["seq"]
    base = bytes(np.frombuffer(first.encode(), np.uint8)[sites.own])
    q = sparse_sites(queries, sites, p, base, None)
    r = sparse_sites(refs, sites, p, base, p.distance)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        side = rows["is_left"].to_numpy()
        if side.all() or not side.any():
            return pd.DataFrame({"ordinal": [], "outer": [], "inner": []})
        letters, outer = sparse.columns(rows, base), rows["outer"].to_numpy()[~side]
        inner = sparse.differences(letters[side], letters[~side]).min(0)
        near = inner + outer <= p.distance
        return pd.DataFrame({"ordinal": rows["id"].to_numpy()[~side][near], "outer": outer[near], "inner": inner[near]})

    found = sparse.units(written(q, "sparse"), written(r, "sparse"), p.distance).groupBy("unit").applyInPandas(run, "ordinal long, outer long, inner long")
    return found.groupBy("ordinal").agg(F.max("outer").alias("outer"), F.min("inner").alias("inner"))


def ball(refs: DataFrame, queries: DataFrame, mode: str = PAIR, redundant: bool = True, **options) -> DataFrame:
    """References (``ordinal, name, seq, distance``) at most ``distance`` away from some query.

    ``mode``: ``pair`` compares with the query itself; ``consensus`` compares sites that all queries share, or
    miss, with the consensus; ``as_written`` also takes a reference that has twice its consensus distance within the radius.
    ``redundant``: first drop queries that a less resolved one stands for."""
    options.setdefault("distance", 5)
    asked = Parameters(**options)
    length = filters.aligned_length(clear_queries(queries, asked))
    p = asked.clamped(length)
    queries = clear_queries(queries, p)
    if redundant:
        queries = keep_less_resolved(queries, p.acgt, p.trim)
    refs = filters.of_length(refs, length)
    d = distances(refs.where(filters.reference_is_clear(F.col("seq"), p.ref_ambiguity)), queries, p, mode)
    keep = F.col("distance") <= p.distance
    if mode == AS_WRITTEN:
        keep = (F.col("_outer") <= p.distance) & ((2 * F.col("_outer") <= p.distance) | keep)
    found = d.withColumns({"distance": F.col("outer") + F.col("inner"), "_outer": F.col("outer")}).where(keep)
    return found.select("ordinal", "name", "seq", "distance")

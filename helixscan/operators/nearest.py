"""Nearest references of every query, by six keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from helixscan.sources.storage import shared_path

from . import filters, kernels
from .filters import Parameters
from .profile import site_profile
from .redundancy import keep_resolved

FULL = ("ACGT_matches", "text_matches", "partial_matches", "valid_pair_comparisons", "ACGT_matches_unique", "valid_ref_sites")
ONLY_ACGT = ("ACGT_matches", "valid_ACGT_comparisons", "ACGT_matches_unique", "valid_ref_sites", "dist_consensus", "dist_unique")
#: Bytes of query sequences that are sent to all tasks at once; more queries go in blocks.  A task's matrices take about
#: ten times as much: a byte for each base that a site has, and planes of bits.
RESIDENT = 16 << 20
#: Rows of all lists of a block of queries; bytes of references whose equal sequences a task looks for; pairs that wait for the lists, and rows that lists take in at once.
HELD, CHUNK, WAITING = 1 << 20, 16 << 20, 1 << 19


def score_columns(acgt: bool) -> tuple[str, ...]:
    return ONLY_ACGT if acgt else FULL


def total_sites(queries: DataFrame) -> int:
    return queries.agg(F.coalesce(F.sum(F.length("seq")), F.lit(0))).first()[0]


def query_blocks(queries: DataFrame, resident: int | None = None, *, n: int = 0) -> tuple[int, Callable[[int], list]]:
    """How many blocks of about ``resident`` bytes, and ``HELD`` rows of lists of ``n``, the queries make, and what reads one.

    They are dealt by a hash of the ordinal into a table with a folder for each block, so that each is read once."""
    queries = queries.select("ordinal", "name", "seq")
    rows, sites = queries.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("seq")), F.lit(0))).first()
    blocks = max(1, -(-sites // (resident or RESIDENT)), -(-rows * n // HELD))
    if blocks == 1:
        return 1, lambda k: queries.orderBy("ordinal").collect()
    path = shared_path(queries.sparkSession, "queries")
    queries.withColumn("block", F.pmod(F.xxhash64("ordinal"), F.lit(blocks)).cast("int")).write.partitionBy("block").parquet(path)
    table = queries.sparkSession.read.schema("ordinal long, name string, seq string, block int").parquet(path)
    return blocks, lambda k: table.where(F.col("block") == k).drop("block").orderBy("ordinal").collect()


def over_blocks(queries: DataFrame, scored: Callable[[list], tuple[DataFrame, Broadcast]], label: str, *kept: str, n: int = 0) -> tuple[DataFrame | None, bool]:
    """What ``scored`` gives for all blocks of queries, and whether there are several.

    The result of one block is left to be worked out; those of several are written (their columns ``kept``, all by default) into one folder, each
    before the next block is read, so that the driver and the tasks hold one block at a time."""
    blocks, rows_of = query_blocks(queries, n=n)
    if blocks == 1:
        rows = rows_of(0)
        return (scored(rows)[0] if rows else None), False
    path, schema = shared_path(queries.sparkSession, label), None
    for k in range(blocks):
        if rows := rows_of(k):
            df, shared = scored(rows)
            df = df.select(*kept) if kept else df
            df.write.option("compression", "zstd").parquet(f"{path}/block={k}")
            schema = df.schema
            shared.unpersist()
    return queries.sparkSession.read.schema(schema).parquet(f"{path}/block=*"), True


def profile_arrays(profile: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Classes and consensus as byte arrays: one row for each site of the alignment."""
    rows = profile.select("site", "class", "consensus").orderBy("site").collect()
    return np.array([ord(r["class"]) for r in rows], np.uint8), np.array([ord(r["consensus"]) for r in rows], np.uint8)


def spread(refs: DataFrame) -> DataFrame:
    """Small files give few partitions; the kernel wants at least one for each core."""
    least = refs.sparkSession.sparkContext.defaultParallelism
    return refs.repartition(least) if refs.rdd.getNumPartitions() < least else refs


def worst(held: list[np.ndarray], queries: int, n: int) -> np.ndarray:
    """The first key of each query's last one of ``n`` best; below any key while there are fewer."""
    count, least = np.bincount(held[0], minlength=queries), np.full(queries, np.iinfo(np.int32).max)
    np.minimum.at(least, held[0], held[1].astype(np.int32))
    return np.where(count < n, -1, least)


class Lists:
    """The ``n`` best references of each query, by keys and ordinal, of the records that were added.

    Equal sequences have equal keys: they are scored once, and the ``n`` first of them count."""

    def __init__(self, scorer: kernels.Scorer, sites: int, n: int):
        self.scorer, self.n, self.packed = scorer, n, kernels.Packed(sites)
        queries, words = scorer.queries, len(self.packed.words([np.zeros(0)] * 6))
        self.rows = [np.zeros(0, np.int64) for _ in range(words + 2)] + [np.zeros(0, object)]  # query, keys, ordinal, name: in order
        self.least = np.full(queries, -1)  # the first key of each list's last row
        self.last = np.full((words, queries), -1, np.int64)
        self.last_ordinal = np.zeros(queries, np.int64)

    def add(self, letters: np.ndarray, group: np.ndarray, ordinal: np.ndarray, name: pa.ChunkedArray) -> None:
        order = np.lexsort((ordinal, group))
        begin = np.searchsorted(group[order], np.arange(len(letters) + 1))
        first = ordinal[order[begin[:-1]]]
        s, waiting, size = self.scorer, [], 0
        # As many references as make PAIRS pairs with QUERIES queries, or as have letters for as many numbers.
        step = max(16, kernels.PAIRS // max(1, min(s.queries, kernels.QUERIES)))
        step = min(step, max(16, 4 * kernels.PAIRS // max(1, len(s.site))))
        for at in range(0, len(letters), step):
            block = kernels.References(letters[at : at + step], s)
            for lo in range(0, s.queries, kernels.QUERIES):
                i, j = self.candidates(lo, min(lo + kernels.QUERIES, s.queries), block)
                words = self.packed.words(s.of_pairs(i, block, j))
                on = self.better(i, words, first[at + j])
                waiting.append([x[on] for x in (i, at + j, *words)])
                size += len(waiting[-1][0])
                if size > WAITING:
                    self.take(waiting, first, order, begin, ordinal, name)
                    waiting, size = [], 0
        self.take(waiting, first, order, begin, ordinal, name)

    def candidates(self, lo: int, hi: int, block: kernels.References) -> tuple[np.ndarray, np.ndarray]:
        """Pairs whose first key is not below that of the query's last row."""
        total, rows = self.scorer.counted(lo, hi, block, self.least if self.least[lo:hi].max(initial=-1) >= 0 else None)
        least = self.least[lo:hi].astype(np.float32)
        short = np.flatnonzero(least < 0)
        if len(short) and len(rows) > self.n:  # there are ``n`` better ones here already
            least[short] = np.partition(total[short], len(rows) - self.n, axis=1)[:, len(rows) - self.n]
        i, j = np.nonzero(total >= least[:, None])
        return i + lo, rows[j]

    def better(self, i: np.ndarray, words: list[np.ndarray], ordinal: np.ndarray) -> np.ndarray:
        """Pairs that come before the query's last row."""
        on = ordinal < self.last_ordinal[i]
        for word, last in zip(reversed(words), reversed(self.last), strict=True):
            on = (word > last[i]) | (word == last[i]) & on
        return on

    def take(self, waiting: list[list[np.ndarray]], first, order, begin, ordinal, name) -> None:
        """Takes pairs of queries and different sequences into the lists."""
        if not sum(len(x[0]) for x in waiting):
            return
        i, j, *words = (np.concatenate(x) for x in zip(*waiting, strict=True))
        at = np.lexsort((first[j], *[-w for w in reversed(words)], i))
        at = at[np.arange(len(at)) - np.searchsorted(i[at], i[at]) < self.n]
        i, j, words = i[at], j[at], [w[at] for w in words]
        count = np.minimum(begin[j + 1] - begin[j], self.n)
        # Queries whose new records are about WAITING, one part after the other.
        part = np.cumsum(count)[np.searchsorted(i, i)] // WAITING
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1), len(i)]
        done = []
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            n = count[lo:hi]
            rep = np.repeat(np.arange(lo, hi), n)
            record = order[begin[j[rep]] + np.arange(len(rep)) - np.repeat(np.cumsum(n) - n, n)]
            held = slice(*np.searchsorted(self.rows[0], [i[lo] if lo else 0, i[hi] if hi < len(i) else self.scorer.queries]))
            old = [x[held] for x in self.rows]
            new = [np.concatenate([x, y]) for x, y in zip(old[:-1], (i[rep], *(w[rep] for w in words), ordinal[record]), strict=True)]
            row = np.lexsort((new[-1], *[-w for w in new[-2:0:-1]], new[0]))
            row = row[np.arange(len(row)) - np.searchsorted(new[0][row], new[0][row]) < self.n]
            entered = row >= len(old[0])
            names = np.empty(len(row), object)
            names[~entered] = old[-1][row[~entered]]
            names[entered] = name.take(pa.array(record[row[entered] - len(old[0])])).to_pylist()
            done.append([*(x[row] for x in new), names])
        self.rows = [np.concatenate(x) for x in zip(*done, strict=True)]
        count = np.bincount(self.rows[0], minlength=self.scorer.queries)
        full = np.flatnonzero(count == self.n)
        row = np.cumsum(count)[full] - 1
        for last, word in zip(self.last, self.rows[1:-2], strict=True):
            last[full] = word[row]
        self.last_ordinal[full] = self.rows[-2][row]
        self.least[full] = self.packed.unpacked([w[row] for w in self.rows[1:-2]])[0]


def scored_block(refs: DataFrame, block: list, arrays: tuple[np.ndarray, np.ndarray], n: int, acgt: bool) -> tuple[DataFrame, Broadcast]:
    """The ``n`` best references of each query of a block within each partition, and what the tasks were sent."""
    names = score_columns(acgt)
    number: dict[str, int] = {}
    of = np.array([number.setdefault(r["seq"], len(number)) for r in block])  # equal queries have equal lists
    shared = refs.sparkSession.sparkContext.broadcast((kernels.matrix([x.encode() for x in number]), of, np.array([r["ordinal"] for r in block]), pa.array([r["name"] for r in block], pa.string()), *arrays))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, of, ordinals, labels, classes, consensus = shared.value
        lists = Lists(kernels.Scorer(q, classes, consensus, acgt), q.shape[1], n)
        for chunk in kernels.chunks(batches, CHUNK):
            lists.add(*chunk)
        i, *words, ordinal, name = lists.rows
        begin = np.searchsorted(i, np.arange(len(q) + 1))
        step = max(1, (1 << 16) // n)
        for at in range(0, len(of), step):
            own = of[at : at + step]
            count = begin[own + 1] - begin[own]
            query = np.repeat(np.arange(at, at + len(own)), count)
            row = np.arange(len(query)) + np.repeat(begin[own] - (np.cumsum(count) - count), count)
            if len(row):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ordinals[query]), labels.take(pa.array(query)), pa.array(ordinal[row]), pa.array(name[row], pa.string()), *(pa.array(k) for k in lists.packed.unpacked([w[row] for w in words]))],
                    names=["query_ordinal", "query", "ref_ordinal", "reference", *names],
                )

    return refs.select("ordinal", "name", "seq").mapInArrow(run, "query_ordinal long, query string, ref_ordinal long, reference string, " + ", ".join(f"{c} long" for c in names)), shared


def ranked(scored: DataFrame, n: int, acgt: bool) -> DataFrame:
    order = Window.partitionBy("query_ordinal").orderBy(*[F.desc(c) for c in score_columns(acgt)], "ref_ordinal")
    best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    more = [c for c in scored.columns if c not in ("query_ordinal", "query", "ref_ordinal", "reference", *score_columns(acgt))]
    return best.select("query_ordinal", "query", "ref_ordinal", "reference", F.col("rank").cast("long").alias("rank"), *score_columns(acgt), *more)


def clear_queries(queries: DataFrame, p: Parameters) -> DataFrame:
    return queries.where(filters.query_is_clear(F.col("seq"), p.query_ambiguity))


def prepared(refs: DataFrame, queries: DataFrame, options: Parameters, counters: Observation | None = None) -> tuple[DataFrame, DataFrame, Parameters]:
    """Filtered references and queries, and the clamped options.  References must be as long as the queries, also those that a filter drops."""
    length = filters.aligned_length(clear_queries(queries, options))
    p = options.clamped(length)
    queries = clear_queries(queries, p)
    if p.keep_resolved:
        queries = keep_resolved(queries, p.acgt, p.trim)
    refs = filters.kept_references(filters.of_length(refs, length), queries if p.exclude_self else None, p.ref_ambiguity, counters)
    return refs, queries, p


def nearest(refs: DataFrame, queries: DataFrame, counters: Observation | None = None, **options) -> DataFrame:
    """The ``n`` best references of every query (both ``ordinal, name, seq``).

    Output: ``query_ordinal, query, ref_ordinal, reference, rank`` and six scores.  Queries are sent to
    the tasks in blocks of bounded size; references stay where they are, and a task hands on at most
    ``n`` rows for each query.  ``counters`` gets, from the same pass, how many references were read, left out and kept."""
    refs, queries, p = prepared(refs, queries, Parameters(**options), counters)
    arrays = profile_arrays(site_profile(queries, p.acgt, p.trim))
    refs = spread(refs)
    out, _ = over_blocks(queries, lambda block: scored_block(refs, block, arrays, p.n, p.acgt), "scored", n=p.n)
    if out is None:
        names = ", ".join(f"{c} long" for c in score_columns(p.acgt))
        out = refs.sparkSession.createDataFrame([], f"query_ordinal long, query string, ref_ordinal long, reference string, {names}")
    return ranked(out, p.n, p.acgt)


def snp_distance(table: DataFrame, acgt: bool = False) -> DataFrame:
    distance = F.col("dist_consensus") + F.col("dist_unique") if acgt else F.col("valid_pair_comparisons") - F.col("partial_matches")
    return table.withColumn("snp_distance", distance)


def worst_of(table: DataFrame) -> DataFrame:
    """The last row of each query's list: what a reference has to be better than."""
    last = table.groupBy("query_ordinal").agg(F.max("rank").alias("rank"))
    return table.join(last, ["query_ordinal", "rank"], "left_semi")


def closest_names(table: DataFrame, most: int = 1) -> DataFrame:
    """Distinct references of rank ``most`` or better."""
    return table.where(F.col("rank") <= most).select(F.col("reference").alias("name")).distinct()


def closest_alignment(table: DataFrame, refs: DataFrame, most: int = 1) -> DataFrame:
    return refs.join(closest_names(table, most), "name", "left_semi").select("ordinal", "name", "seq")

"""The older search: three top lists of each query, united."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixscan.functions.chars import MASK
from helixscan.sources.storage import written

from . import filters, kernels
from .filters import Parameters
from .nearest import clear_queries, over_blocks, spread

#: Counts that a task holds before it adds them up; ordinals of a block of references that tie.
FEW, TIED = 100_000, 1024

_share = np.zeros((256, 256), np.float32)
for _a, _x in MASK.items():
    for _b, _y in MASK.items():
        _share[ord(_a), ord(_b)] = (_x & _y).bit_count() / (_x.bit_count() * _y.bit_count())


def weighted(q: kernels.QueryMatrix, r: np.ndarray) -> np.ndarray:
    """Queries x references: sum over sites of the share of base pairs, of those both letters stand for, that are equal."""
    return q.one_hot @ _share[r[:, q.site], q.letter[None]].T


def legacy_scores(refs: DataFrame, queries: DataFrame, **options) -> DataFrame:
    """A row for each pair: ``query_ordinal, query, ref_ordinal, reference, valid_sites, ACGT_matches,
    prop_char_matches, partial_matches``.  The table is as large as queries times references by its nature."""
    asked = Parameters(**options)
    length = filters.aligned_length(clear_queries(queries, asked))
    p = asked.clamped(length)
    refs = spread(filters.of_length(refs, length).where(filters.query_is_clear(F.col("seq"), p.ref_ambiguity)))
    schema = "query_ordinal long, query string, ref_ordinal long, reference string, valid_sites long, ACGT_matches long, prop_char_matches double, partial_matches double"

    def scored(block: list) -> tuple[DataFrame, Broadcast]:
        shared = refs.sparkSession.sparkContext.broadcast((kernels.matrix([r["seq"].encode() for r in block]), [r["ordinal"] for r in block], [r["name"] for r in block]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q, ordinal, names = shared.value
            matrix = kernels.QueryMatrix(q[:, p.trim : q.shape[1] - p.trim])
            step = max(1, (1 << 20) // max(1, len(q)))
            for whole in batches:
                for at in range(0, whole.num_rows, step):
                    batch = whole.slice(at, step)
                    r = kernels.matrix(batch.column("seq").cast(pa.binary()).to_pylist())
                    r = r[:, p.trim : r.shape[1] - p.trim]
                    s, w = matrix.scores(r), weighted(matrix, r)
                    i, j = (x.ravel() for x in np.indices(w.shape))
                    valid, take = s["valid"].ravel(), pa.array(j)
                    share = np.round(s["text"].ravel() / np.maximum(valid, 1), 8)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.array(ordinal)[i], pa.int64()), pa.array(np.array(names, object)[i], pa.string()), batch.column("ordinal").take(take), batch.column("name").take(take),
                            pa.array(valid.astype(np.int64)), pa.array(s["acgt"].ravel().astype(np.int64)), pa.array(share), pa.array(np.round(w.ravel().astype(np.float64), 3)),
                        ],
                        names=[x.split()[0] for x in schema.split(", ")],
                    )

        return refs.select("ordinal", "name", "seq").mapInArrow(run, schema), shared

    out, _ = over_blocks(clear_queries(queries, p), scored, "scores")
    return out if out is not None else refs.sparkSession.createDataFrame([], schema)


#: Columns of a list's candidates, and their types.
CANDIDATE = "query_ordinal long, query string, ref_ordinal long, reference string, valid_sites long, ACGT_matches long, prop_char_matches double, partial_matches double"
KEYS = ("ACGT_matches", "prop_char_matches", "partial_matches")


class Pairs:
    """Scores of blocks of references with blocks of queries, made anew in each pass: what a pass hands on is bounded, and no pair is stored."""

    def __init__(self, refs: DataFrame, queries: DataFrame, **options):
        asked = Parameters(**options)
        length = filters.aligned_length(clear_queries(queries, asked))
        self.p = asked.clamped(length)
        self.queries = clear_queries(queries, self.p)
        self.refs = spread(filters.of_length(refs, length).where(filters.query_is_clear(F.col("seq"), self.p.ref_ambiguity)))

    def total(self) -> int:
        return self.refs.count()

    def over(self, work, schema: str, label: str, per_query: dict[int, tuple] | None = None) -> DataFrame:
        """``work(query ordinals and names, limits, an iterator of scored batches)`` gives columns of ``schema``, in every task and for every block of queries.

        ``per_query``: a few numbers for each query, which ``work`` gets for those of its block."""
        refs, trim = self.refs, self.p.trim

        def scored(block: list) -> tuple[DataFrame, Broadcast]:
            ordinals = [r["ordinal"] for r in block]
            limits = None if per_query is None else [per_query.get(o) for o in ordinals]
            shared = refs.sparkSession.sparkContext.broadcast((kernels.matrix([r["seq"].encode() for r in block]), ordinals, [r["name"] for r in block], limits))

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                q, ordinals, names, limits = shared.value
                matrix = kernels.QueryMatrix(q[:, trim : q.shape[1] - trim])
                names_of = [c.split()[0] for c in schema.split(", ")]

                def parts() -> Iterator[tuple]:
                    step = max(1, (1 << 20) // max(1, len(q)))
                    for whole in batches:
                        for at in range(0, whole.num_rows, step):
                            batch = whole.slice(at, step)
                            r = kernels.matrix(batch.column("seq").cast(pa.binary()).to_pylist())
                            yield batch, r[:, trim : r.shape[1] - trim]

                for columns in work(ordinals, names, limits, matrix, parts()):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names_of)

            return refs.select("ordinal", "name", "seq").mapInArrow(run, schema), shared

        out, _ = over_blocks(self.queries, scored, label)
        return out if out is not None else refs.sparkSession.createDataFrame([], schema)


def acgt_matches(matrix: kernels.QueryMatrix, r: np.ndarray) -> np.ndarray:
    return matrix.scores(r, acgt_only=True)["acgt"]


def match_counts(pairs: Pairs) -> DataFrame:
    """``query_ordinal, matches, rows``: how many references have so many ACGT matches with each query."""

    def work(ordinals, names, limits, matrix, parts):
        sites = matrix.q.shape[1] + 1
        counts = np.zeros((len(ordinals), sites), np.int64)
        for _, r in parts:
            found = acgt_matches(matrix, r)
            for k, row in enumerate(found):
                counts[k] += np.bincount(row, minlength=sites)
        q, m = np.nonzero(counts)
        yield np.array(ordinals, np.int64)[q], m.astype(np.int64), counts[q, m]

    found = pairs.over(work, "query_ordinal long, matches long, rows long", "counts")
    return found.groupBy("query_ordinal", "matches").agg(F.sum("rows").alias("rows"))


def cuts(counts: DataFrame, size: int) -> dict[int, tuple[int, int]]:
    """For each query the number of matches at which its ``size`` best end, and how many with just so many are among them."""
    before = F.sum("rows").over(Window.partitionBy("query_ordinal").orderBy(F.desc("matches"))) - F.col("rows")
    found = counts.withColumn("left", size - before).where("left > 0 and left <= rows").select("query_ordinal", "matches", "left")
    return {r["query_ordinal"]: (r["matches"], r["left"]) for r in found.collect()}  # a row for each query


def last_ordinals(pairs: Pairs, cut: dict[int, tuple[int, int]]) -> dict[int, tuple[int, int]]:
    """``cut`` as the number of matches and the last ordinal that is among the best with just so many.

    References at the cut are counted by blocks of ordinals; the block in which the last one stands is then looked at by itself."""

    def at_cut(keep):
        def work(ordinals, names, limits, matrix, parts):
            held: list[tuple[np.ndarray, np.ndarray]] = []
            limit = np.array([-1 if x is None else x[0] for x in limits])
            block = np.array([-1 if x is None or len(x) < 3 else x[2] for x in limits])
            for batch, r in parts:
                ordinal = batch.column("ordinal").to_numpy()
                q, j = np.nonzero(acgt_matches(matrix, r) == limit[:, None])
                held.append(keep(q, ordinal[j], block))
                if sum(len(x) for x, _, _ in held) > FEW:
                    held = [summed(held)]
            q, place, n = summed(held)
            yield np.array(ordinals, np.int64)[q], place, n

        return work

    def summed(held):
        q, place, n = (np.concatenate([h[k] for h in held]) if held else np.zeros(0, np.int64) for k in range(3))
        both, where = np.unique(np.stack([q, place], 1), axis=0, return_inverse=True)
        return both[:, 0], both[:, 1], np.bincount(where.ravel(), weights=n, minlength=len(both)).astype(np.int64)

    def by_block(q, ordinal, block):
        return q, ordinal // TIED, np.ones(len(q), np.int64)

    def inside(q, ordinal, block):
        on = ordinal // TIED == block[q]
        return q[on], ordinal[on], np.ones(int(on.sum()), np.int64)

    def ends(df: DataFrame, left: dict[int, int]) -> dict[int, tuple[int, int]]:
        """Where the ``left`` first of each query end: the place and how many of it are among them."""
        df = df.groupBy("query_ordinal", "place").agg(F.sum("n").alias("n"))
        wanted = df.sparkSession.createDataFrame(list(left.items()), "query_ordinal long, wanted long")
        before = F.sum("n").over(Window.partitionBy("query_ordinal").orderBy("place")) - F.col("n")
        found = df.withColumn("before", before).join(wanted, "query_ordinal").where("before < wanted and wanted <= before + n")
        return {r["query_ordinal"]: (r["place"], r["wanted"] - r["before"]) for r in found.collect()}

    if not cut:
        return {}
    schema = "query_ordinal long, place long, n long"
    block = ends(pairs.over(at_cut(by_block), schema, "blocks", cut), {q: left for q, (_, left) in cut.items()})
    with_block = {q: (cut[q][0], cut[q][1], place) for q, (place, _) in block.items()}
    last = ends(pairs.over(at_cut(inside), schema, "last", with_block), {q: left for q, (_, left) in block.items()})
    return {q: (cut[q][0], place) for q, (place, _) in last.items()}


def candidates(pairs: Pairs, keys: tuple[str, ...], limits: dict[int, tuple], most: list[int]) -> DataFrame:
    """``CANDIDATE`` and ``list``: the ``most`` best pairs of each query by each of ``keys``, within each task; ``limits``: for each query and list
    after the first, the number of matches and the ordinal up to which a pair may be in it (``None``: all)."""

    def work(ordinals, names, per_query, matrix, parts):
        held: list[list[np.ndarray] | None] = [None] * len(keys)
        limit = np.array([[(-1, np.iinfo(np.int64).max) if x is None or x[k] is None else x[k] for k in range(len(keys))] for x in per_query], np.int64).reshape(len(ordinals), len(keys), 2)
        for batch, r in parts:
            s, w = matrix.scores(r), weighted(matrix, r)
            ordinal, name = batch.column("ordinal").to_numpy(), np.array(batch.column("name").to_pylist(), object)
            share = np.round(s["text"] / np.maximum(s["valid"], 1), 8)
            values = (s["acgt"], share, np.round(w.astype(np.float64), 3))
            for k, value in enumerate(values[: len(keys)]):
                among = (s["acgt"] > limit[:, k, :1]) | (s["acgt"] == limit[:, k, :1]) & (ordinal[None] <= limit[:, k, 1:])
                q, j = np.nonzero(among)
                new = [q, value[q, j], s["acgt"][q, j], ordinal[j], name[j], s["valid"][q, j], share[q, j], values[2][q, j]]
                if held[k] is not None:
                    new = [np.concatenate(x) for x in zip(held[k], new, strict=True)]
                order = np.lexsort((new[3], -new[2], -new[1], new[0]))
                order = order[np.arange(len(order)) - np.searchsorted(new[0][order], new[0][order]) < most[k]]
                held[k] = [x[order] for x in new]
        for k, new in enumerate(held):
            if new is not None and len(new[0]):
                yield np.array(ordinals, np.int64)[new[0]], np.array(names, object)[new[0]], new[3], new[4], new[5].astype(np.int64), new[2].astype(np.int64), new[6], new[7], np.full(len(new[0]), k, np.int32)

    return pairs.over(work, f"{CANDIDATE}, list int", "candidates", limits)


def legacy_search(refs: DataFrame, queries: DataFrame, n: int = 8, most: int | None = None, **options) -> DataFrame:
    """The references that are in a top list of a query: by ACGT matches; by the share of equal characters among the
    best eighth of all references; by weighted partial matches among the best sixteenth.  A list has ``n`` references, up
    to ``most`` while they equal the best one.  Ties go by the reference's ordinal.  The columns are those of ``legacy_scores``.

    Pairs are scored in a pass that counts them by matches, in two that look for the ordinals at which the eighths and sixteenths end, and in one that
    keeps the ``most`` best of each list in each task: the table of all pairs is never made."""
    pairs = Pairs(refs, queries, **options)
    total, most = pairs.total(), max(n, most or 2 * n)
    sizes = [total, *([total // 8] if total > 16 else []), *([total // 16] if total > 32 else [])]
    counts = written(match_counts(pairs), "counts") if len(sizes) > 1 else None
    ends = [{}, *(last_ordinals(pairs, cuts(counts, size)) for size in sizes[1:])]
    limits = {q: tuple(end.get(q) for end in ends) for q in set().union(*ends)}
    lengths = []
    for size in sizes:
        n, most = min(n, size), min(most, size)
        lengths.append((n, most))
    none = (None,) * len(sizes)
    found = candidates(pairs, KEYS[: len(sizes)], AllQueries(limits, none), [m for _, m in lengths])
    out = None
    for k, (key, (n, most)) in enumerate(zip(KEYS, lengths, strict=False)):
        order = Window.partitionBy("query_ordinal").orderBy(F.desc(key), F.desc("ACGT_matches"), "ref_ordinal")
        best = found.where(F.col("list") == k).drop("list").withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= most)
        first = F.max(key).over(Window.partitionBy("query_ordinal"))  # of at most `most` rows
        part = best.withColumn("_first", first).where((F.col("_rank") <= n) | (F.col("_first") - F.col(key) < 1e-15)).drop("_rank", "_first")
        out = part if out is None else out.union(part)
    return out.distinct()


class AllQueries(dict):
    """Limits of some queries, and those of all others."""

    def __init__(self, some: dict, others: tuple):
        super().__init__(some)
        self.others = others

    def get(self, key, default=None):
        return super().get(key, self.others)


def legacy_chosen(found: DataFrame, refs: DataFrame) -> DataFrame:
    """The references that some query chose."""
    return refs.join(found.select(F.col("ref_ordinal").alias("ordinal")).distinct(), "ordinal", "left_semi").select("ordinal", "name", "seq")

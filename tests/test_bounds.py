"""Memory of the searches' tasks: bounded, whatever the number of queries."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from helixscan.operators import ball, kernels, nearest, profile

SITES = 24


class Task:
    """References that keep what a task does, so that it can be done here."""

    rdd = sparkSession = sparkContext = defaultParallelism = property(lambda self: self)

    def getNumPartitions(self):  # noqa: N802
        return 1

    def __lt__(self, other):
        return False

    __gt__ = __lt__

    def broadcast(self, value):
        self.value = value
        return self

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):  # noqa: N802
        self.run = run
        return self

    def rows(self, batches):
        return [tuple(r.values()) for b in self.run(iter(batches)) for r in b.to_pylist()]


def letters(g, base, n, share, among=b"ACGTNRY-"):
    x = np.repeat(base[None], n, 0)
    on = g.random(x.shape) < share
    x[on] = g.choice(np.frombuffer(among, np.uint8), int(on.sum()))
    return x


def records(spark, q):
    return spark.createDataFrame([(i, f"q{i}", bytes(x).decode()) for i, x in enumerate(q)], "ordinal long, name string, seq string")


def batch(ordinal, r):
    return pa.RecordBatch.from_arrays([pa.array(ordinal), pa.array([f"r{o}" for o in ordinal]), pa.array([bytes(x).decode() for x in r])], names=["ordinal", "name", "seq"])


def peak(work):
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("acgt", [False, True])
def test_nearest_holds_no_matrix_of_all_pairs(acgt):
    """2000 queries and a batch of 10,000 references: a matrix of their pairs is 80 MB, and there were a dozen."""
    g = np.random.default_rng(1)
    base = g.choice(np.frombuffer(b"ACGT", np.uint8), SITES)
    q, r = letters(g, base, 2000, 0.3), letters(g, base, 10_000, 0.3)
    block = [{"ordinal": i, "name": f"q{i}", "seq": bytes(x).decode()} for i, x in enumerate(q)]
    task, own = Task(), batch(np.arange(10_000), r)
    nearest.scored_block(task, block, (np.full(SITES, ord("p"), np.uint8), np.full(SITES, ord("#"), np.uint8)), 3, acgt)
    assert peak(lambda: [b.num_rows for b in task.run(iter([own]))]) < 250e6


@pytest.mark.parametrize("mode", [ball.PAIR, ball.CONSENSUS, ball.AS_WRITTEN])
def test_ball_holds_no_matrix_of_all_pairs(spark, monkeypatch, mode):
    g = np.random.default_rng(2)
    base = g.choice(np.frombuffer(b"ACGT", np.uint8), SITES)
    q, r = letters(g, base, 2000, 0.3), letters(g, base, 10_000, 0.3)
    task, own = Task(), batch(np.arange(10_000), r)
    monkeypatch.setattr(ball, "spread", lambda refs: refs)
    ball.distances(task, records(spark, q), nearest.Parameters(distance=2), mode)
    assert peak(lambda: [b.num_rows for b in task.run(iter([own]))]) < 150e6


@pytest.mark.parametrize("acgt", [False, True])
@pytest.mark.parametrize(("pairs", "queries", "waiting", "n"), [(1 << 21, 2048, 1 << 19, 4), (64, 3, 7, 1), (1 << 10, 5, 100, 10)])
def test_lists_of_tiles_are_the_best_of_all_pairs(spark, monkeypatch, acgt, pairs, queries, waiting, n):
    """Copies among queries and references, in several chunks; ties go by the ordinal."""
    g = np.random.default_rng(3)
    base = g.choice(np.frombuffer(b"ACGT", np.uint8), 60)
    q, r = letters(g, base, 9, 0.1)[[0, 1, 2, 3, 4, 5, 6, 7, 8, 3, 0]], letters(g, base, 150, 0.03)[g.integers(0, 150, 400)]
    ordinal = g.permutation(1000)[:400]
    arrays = nearest.profile_arrays(profile.site_profile(records(spark, q), acgt))
    keys, _ = kernels.Scorer(q, *arrays, acgt).keys(r)
    want = []
    for i in range(len(q)):
        best = np.lexsort((ordinal, *[-k[i] for k in reversed(keys)]))[:n]
        want += [(i, f"q{i}", int(ordinal[j]), f"r{ordinal[j]}", *(int(k[i, j]) for k in keys)) for j in best]
    monkeypatch.setattr(kernels, "PAIRS", pairs)
    monkeypatch.setattr(kernels, "QUERIES", queries)
    monkeypatch.setattr(nearest, "WAITING", waiting)
    monkeypatch.setattr(nearest, "CHUNK", 5000)
    task, block = Task(), [{"ordinal": i, "name": f"q{i}", "seq": bytes(x).decode()} for i, x in enumerate(q)]
    nearest.scored_block(task, block, arrays, n, acgt)
    assert task.rows([batch(ordinal[at : at + 50], r[at : at + 50]) for at in range(0, 400, 50)]) == want


@pytest.mark.parametrize("acgt", [False, True])
@pytest.mark.parametrize(("pairs", "queries"), [(1 << 21, 2048), (64, 3), (1 << 10, 5)])
def test_ball_of_tiles_is_the_least_of_all_pairs(monkeypatch, acgt, pairs, queries):
    monkeypatch.setattr(kernels, "PAIRS", pairs)
    monkeypatch.setattr(kernels, "QUERIES", queries)
    g = np.random.default_rng(4)
    base = g.choice(np.frombuffer(b"ACGT", np.uint8), 40)
    q, r, outer = letters(g, base, 13, 0.15), letters(g, base, 300, 0.1), g.integers(0, 4, 300)
    known = kernels.IS_ACGT if acgt else kernels.IS_VALID
    least = np.array([((q != x) & known[q] & known[x]).sum(1).min() for x in r])
    runs = [ball.Queries(q, x, acgt) for x in np.array_split(np.arange(40), 8)]
    for mode in (ball.PAIR, ball.AS_WRITTEN):
        left, inner = ball.within(runs, r, outer, nearest.Parameters(distance=3, acgt=acgt), mode)
        want = (outer <= 3) & ((least + outer <= 3) | ((2 * outer <= 3) & (mode == ball.AS_WRITTEN)))
        assert left.tolist() == np.flatnonzero(want).tolist() and (inner == least[left]).all() and 0 < len(left) < 300

"""Kernels against a loop over sites and against column expressions; examples worked out by hand."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helixscan.functions import chars
from helixscan.operators import ball, cluster, filters, kernels, legacy, nearest, profile, redundancy
from helixscan.plans import fixtures

LETTERS = "ACGTACGTACGTNXO-?.MRWSYKBDHVUZ*a"


def by_site(q, r):
    out = dict.fromkeys(("acgt", "text", "partial", "valid", "acgt_valid"), 0)
    for a, b in zip(q, r, strict=True):
        valid = a not in chars.INVALID and b not in chars.INVALID
        out["valid"] += valid
        out["text"] += valid and a == b
        out["partial"] += valid and (a == b or bool(chars.MASK.get(a, 0) & chars.MASK.get(b, 0)))
        out["acgt_valid"] += a in "ACGT" and b in "ACGT"
        out["acgt"] += a in "ACGT" and a == b
    return out


def bytes_of(*seqs):
    return kernels.matrix([s.encode() for s in seqs])


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40).flatmap(lambda n: st.tuples(*[st.lists(st.text(LETTERS, min_size=n, max_size=n), min_size=1, max_size=4)] * 2)))
def test_kernel_is_the_loop_over_sites(case):
    q, r = case
    full, acgt = kernels.QueryMatrix(bytes_of(*q)).scores(bytes_of(*r)), kernels.QueryMatrix(bytes_of(*q)).scores(bytes_of(*r), True)
    for i, a in enumerate(q):
        for j, b in enumerate(r):
            want = by_site(a, b)
            assert [full[k][i, j] for k in ("acgt", "text", "partial", "valid")] == [want[k] for k in ("acgt", "text", "partial", "valid")]
            assert acgt["acgt_valid"][i, j] == want["acgt_valid"]
            assert want["acgt"] <= want["text"] <= want["partial"] <= want["valid"]


def test_columns_are_the_loop_over_sites(spark):
    g = np.random.default_rng(5)
    pairs = [tuple("".join(g.choice(list(LETTERS), 30)) for _ in range(2)) for _ in range(200)]
    df = chars.with_pair_counts(spark.createDataFrame(pairs, "q string, r string"), "q", "r")
    for row in df.collect():
        want = by_site(row["q"], row["r"])
        assert {k: row[k] for k in want} == want
        assert row["hamming"] == sum(a != b for a, b in zip(row["q"], row["r"], strict=True))


@pytest.mark.parametrize(
    "a, b, acgt, partial, valid",
    [("AACGTTA--", "AACG-TAM-", 6, 6, 6), ("AACGTTA--", "MNCGTTMC-", 4, 6, 6), ("AACG-TAM-", "MNCGTTMC-", 3, 6, 6), ("AACGTTA--", "KNCGTTKC-", 4, 4, 6), ("------AAA", "CCC------", 0, 0, 0)],
)
def test_worked_examples(a, b, acgt, partial, valid):
    s = kernels.QueryMatrix(bytes_of(a)).scores(bytes_of(b))
    assert (s["acgt"][0, 0], s["partial"][0, 0], s["valid"][0, 0]) == (acgt, partial, valid)


def records(spark, seqs):
    return spark.createDataFrame([(i, f"s{i}", s) for i, s in enumerate(seqs)], "ordinal long, name string, seq string")


def test_redundancy_example(spark):
    df = records(spark, ["AAAGCG-C", "AA--CG-C", "AAA-CGAC", "AAA-CGTC", "AAAGCG-C"])
    assert [r["ordinal"] for r in redundancy.keep_resolved(df).orderBy("ordinal").collect()] == [0, 2, 3]
    assert [r["ordinal"] for r in redundancy.keep_less_resolved(df).orderBy("ordinal").collect()] == [1]


SF = "/root/testdata/sf0.001"


def test_nearest_is_the_same_for_any_partitions(spark):
    q, r = fixtures.queries(spark, SF), fixtures.references(spark, SF)
    tables = [sorted(map(tuple, nearest.nearest(x, q, n=7).collect())) for x in (r.repartition(1), r.repartition(9), r.orderBy(F.desc("ordinal")))]
    assert tables[0] == tables[1] == tables[2] and len(tables[0]) == 70


def test_queries_in_blocks_give_the_same(spark, monkeypatch):
    q, r = fixtures.queries(spark, SF), fixtures.references(spark, SF)
    want = sorted(map(tuple, nearest.nearest(r, q, n=5).collect()))
    in_ball = sorted(map(tuple, ball.ball(r, q, distance=3).collect()))
    kept = sorted(map(tuple, redundancy.keep_resolved(q).collect()))
    monkeypatch.setattr(nearest.query_blocks, "__defaults__", (300,))
    assert sorted(map(tuple, nearest.nearest(r, q, n=5).collect())) == want
    assert sorted(map(tuple, ball.ball(r, q, distance=3).collect())) == in_ball
    assert sorted(map(tuple, redundancy.keep_resolved(q).collect())) == kept


def test_fewer_references_than_asked(spark):
    q, r = fixtures.queries(spark, SF), fixtures.references(spark, SF).where("ordinal < 3")
    assert nearest.nearest(r, q, n=100).groupBy("query").count().where("count != 3").count() == 0
    assert nearest.nearest(r.limit(0), q).count() == 0 and nearest.nearest(r, q.limit(0)).count() == 0


def test_ball_grows_with_the_radius(spark):
    q, r = fixtures.queries(spark, SF).where("ordinal < 3"), fixtures.references(spark, SF)
    for mode in (ball.PAIR, ball.CONSENSUS, ball.AS_WRITTEN):
        found = [{x["ordinal"] for x in ball.ball(r, q, mode, distance=d).collect()} for d in (0, 2, 5)]
        assert found[0] <= found[1] <= found[2] and found[2]


def test_unequal_lengths_are_an_error(spark):
    with pytest.raises(ValueError, match="aligned"):
        filters.aligned_length(records(spark, ["ACGTA", "ACGT"]))


@pytest.mark.parametrize("seq", ["ACGTACGTAC", "ACGTACG", "NNNNNNNNNNN"])
def test_references_of_another_length_stop_the_search_by_name(spark, seq):
    """Also those that would be dropped as ambiguous."""
    q = records(spark, ["ACGTACGTA", "ACGTACGTT"])
    r = spark.createDataFrame([(0, "fine", "ACGTACGTA"), (1, "odd one", seq)], "ordinal long, name string, seq string")
    for search in (nearest.nearest, ball.ball, legacy.legacy_scores):
        with pytest.raises(Exception, match=f"odd one has {len(seq)} sites instead of 9"):
            search(r, q).collect()
    with pytest.raises(Exception, match="odd one has"):
        redundancy.keep_resolved(r).collect()
    with pytest.raises(Exception, match="odd one has"):
        cluster.cluster(r, "ACGTACGTA").collect()


def test_order_of_many_equal_queries(spark):
    """All know the same number of sites; no window holds them together."""
    n = 3000
    df = spark.range(n).select(F.col("id").alias("ordinal"), F.concat(F.lit("q"), F.col("id").cast("string")).alias("name"), F.lit("ACGTAC").alias("seq")).repartition(7)
    found = profile.query_order(df)
    assert sorted((r["ordinal"], r["resolution_order"]) for r in found.collect()) == [(i, i + 1) for i in range(n)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(n_known" not in plan


def test_one_block_shuffles_no_sequences(spark):
    q, r = fixtures.queries(spark, SF), fixtures.references(spark, SF)
    plan = ball.ball(r, q)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan


def test_parameters_are_clamped():
    p = filters.Parameters(n=0, trim=999, distance=99, ref_ambiguity=7.0, query_ambiguity=0.0).clamped(100)
    assert (p.n, p.trim, p.distance, p.ref_ambiguity, p.query_ambiguity) == (1, 47, 0, 1.0, 0.001)


def test_profile_of_classes(spark):
    found = {r["site"]: (r["class"], r["consensus"]) for r in profile.site_profile(records(spark, ["AC-M-", "ACGA-", "AT-AN"])).collect()}
    assert found == {0: ("c", "A"), 1: ("p", "#"), 2: ("m", "G"), 3: ("p", "#"), 4: ("u", "N")}


def test_weights_of_partial_letters():
    w = legacy.weighted(kernels.QueryMatrix(bytes_of("TWA")), bytes_of("WWA"))
    assert w.tolist() == [[2.0]]


def plain_lists(rows, n, total):
    """Pairs of query and reference that are in a top list, from all scores of each query."""
    found = set()
    for query in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == query), key=lambda r: (-r[5], r[2]))
        few, most = n, 2 * n
        for column, size, least in ((5, total, 0), (6, total // 8, 17), (7, total // 16, 33)):
            if total < least:
                continue
            few, most = min(few, size), min(most, size)
            best = sorted(own[:size], key=lambda r: (-r[column], -r[5], r[2]))
            found |= {(query, r[2]) for i, r in enumerate(best[:most]) if i < few or best[0][column] - r[column] < 1e-15}
    return found


@pytest.mark.parametrize(("total", "sites", "few", "resident"), [(300, 12, 100_000, 1 << 20), (300, 3, 0, 30), (40, 12, 0, 1 << 20), (20, 12, 100_000, 1 << 20), (5, 6, 0, 12)])
def test_older_search_makes_no_table_of_pairs(spark, monkeypatch, total, sites, few, resident):
    """Few sites make many ties, also at the ends of the eighths and sixteenths."""
    monkeypatch.setattr(legacy, "TIED", 8)
    monkeypatch.setattr(legacy, "FEW", few)
    monkeypatch.setattr(nearest, "RESIDENT", resident)
    g = random.Random(total)
    seq = lambda: "".join(g.choice("AAACGTMW") for _ in range(sites))
    refs = spark.createDataFrame([(i, f"r{i}", seq()) for i in g.sample(range(3000), total)], "ordinal long, name string, seq string").repartition(3)
    queries = spark.createDataFrame([(i, f"q{i}", seq()) for i in range(4)], "ordinal long, name string, seq string")
    options = {"ref_ambiguity": 1.0, "query_ambiguity": 1.0}
    rows = [tuple(r) for r in legacy.legacy_scores(refs, queries, **options).collect()]
    found = legacy.legacy_search(refs, queries, n=3, **options).collect()
    pairs = [(r["query_ordinal"], r["ref_ordinal"]) for r in found]
    assert len(set(pairs)) == len(pairs) and set(pairs) == plain_lists(rows, 3, total)
    assert {tuple(r) for r in found} <= set(rows)


def test_pruned_references_change_nothing(spark):
    """References that can't reach a query's worst best one are left out; the ones that are left have all their keys."""
    g = np.random.default_rng(4)
    base = g.choice(np.frombuffer(b"ACGT", np.uint8), 400)
    q = np.repeat(base[None], 6, 0)
    q[:, ::9] = g.choice(np.frombuffer(b"ACGTRN", np.uint8), q[:, ::9].shape)
    r = np.repeat(base[None], 300, 0)
    for k in range(300):  # from near to far
        at = g.integers(0, 400, k // 2)
        r[k, at] = g.choice(np.frombuffer(b"ACGTN", np.uint8), len(at))
    rows = spark.createDataFrame([(i, f"q{i}", bytes(x).decode()) for i, x in enumerate(q)], "ordinal long, name string, seq string")
    for acgt in (False, True):
        arrays = nearest.profile_arrays(profile.site_profile(rows, acgt))
        whole, _ = kernels.Scorer(q, *arrays, acgt).keys(r)
        scorer = kernels.Scorer(q, *arrays, acgt)
        least = np.sort(whole[0], axis=1)[:, -10]  # of the ten best of each query
        keys, left = scorer.keys(r, least)
        assert all((a == b[:, left]).all() for a, b in zip(keys, whole, strict=True))
        assert (whole[0] >= least[:, None]).any(0)[left].sum() == (whole[0] >= least[:, None]).any(0).sum()
        assert scorer.seen == 300 and scorer.scored < 150
        nothing, none = kernels.Scorer(q, *arrays, acgt).keys(r, np.full(6, 401))
        assert not len(none) and nothing[0].shape == (6, 0)
    one = nearest.worst([np.array([0, 0, 2]), np.array([7, 5, 3])], 3, 2)
    assert one.tolist() == [5, -1, -1]


KERNEL = """
import time
import numpy as np
from helixscan.operators import kernels
g = np.random.default_rng(8)
base = g.choice(np.frombuffer(b"ACGT", np.uint8), 20_000)
q, r = np.repeat(base[None], 64, 0), np.repeat(base[None], 64, 0)
for x in (*q, *r):
    x[g.integers(0, 20_000, 30)] = ord("T")
classes = np.where((q == q[:1]).all(0), ord("c"), ord("p")).astype(np.uint8)
scorer = kernels.Scorer(q, classes, np.where(classes == ord("c"), base, ord("#")).astype(np.uint8), False)
seconds = []
for _ in range(5):
    began = time.process_time()
    scorer.keys(r)
    seconds.append(time.process_time() - began)
print(64 * 64 * 20_000 / min(seconds))
"""


def test_kernel_compares_many_sites_a_second():
    """On one core, as in a task of Spark, which gives the matrix products one thread."""
    import os
    import subprocess
    import sys

    run = subprocess.run([sys.executable, "-c", KERNEL], env=os.environ | {"OMP_NUM_THREADS": "1", "OPENBLAS_NUM_THREADS": "1"}, capture_output=True, text=True, check=True)
    assert float(run.stdout) > 100e6  # site comparisons; about 4.7e9 on an idle core


def test_consensus_scores_are_those_of_a_query():
    g = np.random.default_rng(2)
    c = g.choice(np.frombuffer(b"ACGTRYK", np.uint8), 80)
    r = np.where(g.random((30, 80)) < 0.7, c, g.choice(np.frombuffer(b"ACGTRN-KZ", np.uint8), (30, 80))).astype(np.uint8)
    for acgt in (False, True):
        a, b = kernels.Consensus(c).scores(r, acgt), kernels.QueryMatrix(c[None]).scores(r, acgt)
        assert a.keys() == b.keys() and all((a[k] == b[k]).all() for k in a)


def test_counters_come_from_the_search_itself(spark):
    from pyspark.sql import Observation

    q, r = fixtures.queries(spark, SF), fixtures.references(spark, SF)
    r = r.withColumn("name", F.when(F.col("ordinal") < 3, "query5").otherwise(F.col("name")))
    counters = Observation()
    nearest.nearest(r, q, counters, n=3, exclude_self=True).collect()
    assert counters.get == filters.run_counters(r, q.where(filters.query_is_clear(F.col("seq")))).first().asDict() and counters.get["n_same_name"] == 3

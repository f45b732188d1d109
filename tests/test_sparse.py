"""Sparse records, their index and what is built on them, against plain comparisons of whole sequences."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helixscan.functions.chars import INVALID
from helixscan.operators import ball, cluster, kernels, nearest, redundancy, reference, sparse

SITES = 29_903


def plain_distance(a, b):
    return sum(x != y and x not in INVALID and y not in INVALID for x, y in zip(a, b, strict=True))


def made(g, n, length, snps, letters="ACGTACGTACGTRN-", runs=2):
    base = g.choice(list("ACGT"), length)
    out = []
    for i in range(n):
        s = (base if i < 3 or g.random() < 0.6 else np.array(list(out[int(g.integers(0, i))]))).copy()
        for _ in range(int(g.integers(0, snps + 1))):
            s[int(g.integers(0, length))] = g.choice(list(letters))
        for _ in range(int(g.integers(0, runs + 1))):
            at = int(g.integers(0, length))
            s[at : at + int(g.integers(1, max(2, length // 8)))] = g.choice(list("N-"))
        out.append("".join(s))
    return "".join(base), out


def frame(seqs, base, trim=0, raw=False):
    found = sparse.described([s.encode() for s in seqs], base.encode(), trim, raw)
    return pd.DataFrame({c: x.to_pylist() for c, x in zip(("d_ref", "snp", "known", *sparse.COLUMNS), found, strict=True)})


@pytest.mark.parametrize("base_letters", [None, "N?"])
def test_sparse_distances_are_those_of_whole_sequences(base_letters):
    g = np.random.default_rng(2)
    base, seqs = made(g, 40, 90, 9)
    if base_letters:  # a reference that knows nothing of some sites
        base = "".join(c if i % 7 else base_letters[i % 2] for i, c in enumerate(base))
    for trim in (0, 6):
        rows = frame(seqs, base, trim)
        inner = [s[trim : len(s) - trim] for s in seqs]
        letters = sparse.columns(rows, base.encode()[trim : len(base) - trim])
        want = np.array([[plain_distance(a, b) for b in inner] for a in inner])
        assert (sparse.differences(letters, letters) == want).all()
        assert (sparse.differences(letters[:2], letters) == want[:2]).all() and (sparse.differences(letters, letters[:3]) == want[:, :3]).all()
        assert rows["d_ref"].tolist() == [plain_distance(s, base[trim : len(base) - trim]) for s in inner]
        assert rows["known"].tolist() == [sum(c not in INVALID for c in s) for s in seqs]
        first = [next((i for i, (x, y) in enumerate(zip(s, base[trim:])) if plain_distance(x, y)), -1) for s in inner]  # noqa: B905
        assert rows["snp"].tolist() == first
    rows = frame(seqs, base, raw=True)
    letters = sparse.columns(rows, base.encode())
    assert (sparse.differences(letters, letters) == [[sum(x != y for x, y in zip(a, b, strict=True)) for b in seqs] for a in seqs]).all()


def test_size_of_a_record_follows_its_snps_not_its_length():
    g = np.random.default_rng(4)
    for length in (3_000, 30_000):
        base, seqs = made(g, 200, length, 20, "ACGT", 3)
        rows = frame(seqs, base)
        held = sum(4 * len(a) + len(b) + 4 * len(c) for a, b, c in zip(*(rows[x] for x in sparse.COLUMNS), strict=True)) / len(seqs)
        assert held < 600


def test_query_columns_are_those_of_a_plain_loop():
    g = np.random.default_rng(1)
    q = g.choice(np.frombuffer(b"ACGTRN-", np.uint8), (9, 50))
    m = kernels.QueryMatrix(q)
    want = [(i, c) for i in range(50) for c in np.unique(q[:, i]) if kernels.IS_VALID[c]]
    assert list(zip(m.site.tolist(), m.letter.tolist(), strict=True)) == [(i, int(c)) for i, c in want]
    assert kernels.QueryMatrix(q[:, :0]).scores(q[:, :0])["text"].shape == (9, 9)


@pytest.mark.parametrize(("distance", "wild"), [(0, 2), (1, 0), (1, 2), (3, 1)])
def test_all_near_pairs_meet(spark, distance, wild):
    g = np.random.default_rng(distance + 10 * wild)
    base, seqs = made(g, 120, 80, 6)
    rows = [(i, f"s{i}", s) for i, s in enumerate(seqs)]
    df = spark.createDataFrame(rows, "ordinal long, name string, seq string").repartition(3)
    own = sparse.records(df, base).withColumnRenamed("ordinal", "id")
    left, right = own.where("id % 2 = 0"), own.where("id % 2 = 1")
    want = {(i, j) for i in range(0, 120, 2) for j in range(1, 120, 2) if plain_distance(seqs[i], seqs[j]) <= distance}
    for a, b in ((left, right), (own, own)):
        met, units = set(), {}
        for r in sparse.units(a, b, distance, wild=wild, side=10).collect():
            units.setdefault(r["unit"], ([], []))[not r["is_left"]].append(r["id"])
        for x, y in units.values():
            met |= {(i, j) for i in x for j in y}
        assert want <= met
    assert max(len(x) + len(y) for x, y in units.values()) < 80


def test_candidates_of_a_hot_lineage_are_few(spark):
    """Two thirds of the records are one lineage; each has private SNPs, and none is within the distance of another."""
    g = np.random.default_rng(7)
    length, n = 6000, 600
    base = g.choice(list("ACGT"), length)
    hot = base.copy()
    hot[::97] = [("ACGT" * 2)["ACGT".index(c) + 1] for c in hot[::97]]
    seqs = []
    for i in range(n):
        s = (hot if i % 3 else base).copy()
        for at in g.integers(0, length, 12):
            s[at] = ("ACGT" * 2)["ACGT".index(s[at]) + 1 + int(g.integers(0, 2))]
        seqs.append("".join(s))
    df = spark.createDataFrame([(i, f"s{i}", s) for i, s in enumerate(seqs)], "ordinal long, name string, seq string")
    own = sparse.records(df, "".join(base)).withColumnRenamed("ordinal", "id")
    sizes = sparse.units(own.where("id < 300"), own.where("id >= 300"), 1, side=64).groupBy("unit").agg(F.count_if("is_left"), F.count_if(~F.col("is_left"))).collect()
    assert sum(r[1] + r[2] for r in sizes) < n  # rows that are compared at all: with six keys each there could be 3600
    assert sum(r[1] * r[2] for r in sizes) < 20 * n  # of 90,000 pairs


def plain_leader(rows, base, distance, queue):
    """Record by record, over whole sequences."""
    out = {}
    for q in sorted({i // queue for i, _ in rows}):
        medoids, of = [], {}
        for i, s in [r for r in rows if r[0] // queue == q]:
            key = (sum(c not in INVALID for c in s), plain_distance(s, base))
            for k, (_, m, other) in enumerate(medoids):
                d = plain_distance(s, m)
                if abs(key[1] - other[1]) <= distance and d <= distance:
                    of[i] = k
                    if not d and key > other:
                        medoids[k] = (i, s, key)
                    break
            else:
                of[i] = len(medoids)
                medoids.append((i, s, key))
        out |= {i: (q, medoids[k][0]) for i, k in of.items()}
    return out


def test_leader_is_the_plain_one(spark, monkeypatch):
    monkeypatch.setattr(cluster, "QUEUE", 70)
    g = np.random.default_rng(6)
    base, seqs = made(g, 200, 150, 3)
    df = spark.createDataFrame([(i, f"s{i}", s) for i, s in enumerate(seqs)], "ordinal long, name string, seq string").repartition(3)
    for distance in (1, 3):
        found = {r["member"]: (r["queue"], r["medoid"]) for r in cluster.leader(df, base, distance).collect()}
        assert found == plain_leader(list(enumerate(seqs)), base, distance, 70)


def test_whole_genomes_take_little_time():
    import time

    g = np.random.default_rng(3)
    base, seqs = made(g, 400, SITES, 30, "ACGT", 3)
    rows = frame(seqs, base)
    began = time.process_time()
    own = cluster.Queue(sparse.columns(rows, base.encode()), rows["d_ref"].to_numpy(), rows["known"].to_numpy(), 1, False)
    for i in range(len(rows)):
        own.add(i)
    assert len(own.medoid) > 100
    assert (time.process_time() - began) / len(rows) < 0.005


def test_far_queries_give_what_near_ones_give(spark, monkeypatch):
    g = np.random.default_rng(9)
    base, seqs = made(g, 160, 200, 6)
    df = spark.createDataFrame([(i, f"s{i}", s) for i, s in enumerate(seqs)], "ordinal long, name string, seq string")
    q, r = df.where("ordinal < 40"), df.where("ordinal >= 40").repartition(3)
    for mode, acgt in ((ball.PAIR, False), (ball.CONSENSUS, True), (ball.AS_WRITTEN, False)):
        near = sorted(tuple(x) for x in ball.ball(r, q, mode, distance=3, acgt=acgt, query_ambiguity=0.9).collect())
        if mode == ball.PAIR and not acgt:
            queries = [s for s in seqs[:40] if sum(c in INVALID for c in s) / 200 <= 0.9]
            want = {i: min(plain_distance(s, x) for x in queries) for i, s in enumerate(seqs) if i >= 40 and sum(c not in INVALID for c in s) >= 100}
            assert {x[0]: x[3] for x in near} == {i: d for i, d in want.items() if d <= 3}
        monkeypatch.setattr(nearest, "RESIDENT", 2000)
        assert sorted(tuple(x) for x in ball.ball(r, q, mode, distance=3, acgt=acgt, query_ambiguity=0.9).collect()) == near
        monkeypatch.undo()
        assert near


def test_redundant_records_are_the_plain_ones(spark):
    g = np.random.default_rng(12)
    base = "".join(g.choice(list("ACGT"), 60))
    kinds, seqs = ["".join(g.choice(list("ACGTR")) if i % 9 == k else c for i, c in enumerate(base)) for k in range(4)], []
    for _ in range(90):
        s = list(kinds[int(g.integers(0, 4))])
        for at in g.integers(0, 60, int(g.integers(0, 4))):
            for k in range(at, min(60, at + int(g.integers(1, 9)))):
                s[k] = "N"
        seqs.append("".join(s))
    known = [{i for i, c in enumerate(s) if c not in INVALID} for s in seqs]
    sign = ["".join(c if c not in INVALID else "N" for c in s) for s in seqs]
    firsts = [i for i in range(90) if sign[i] not in sign[:i]]
    agree = lambda i, j: all(seqs[i][k] == seqs[j][k] for k in known[i] & known[j])
    df = spark.createDataFrame([(i, f"s{i}", s) for i, s in enumerate(seqs)], "ordinal long, name string, seq string")
    more = {i for i in firsts if not any(known[j] > known[i] and agree(i, j) for j in firsts)}
    less = {i for i in firsts if not any(known[j] < known[i] and agree(i, j) for j in firsts)}
    assert {r["ordinal"] for r in redundancy.keep_resolved(df).collect()} == more
    assert {r["ordinal"] for r in redundancy.keep_less_resolved(df).collect()} == less
    assert len(more) < len(firsts) > len(less)


def test_backbone_takes_later_records_for_sites_that_the_first_ones_miss(spark, monkeypatch):
    monkeypatch.setattr(reference, "FIRST", 2)
    df = spark.createDataFrame([(5, "a", "NNA-"), (6, "b", "NCG-"), (9, "c", "TGC-"), (8, "d", "GTT-")], "ordinal long, name string, seq string")
    assert reference.backbone(df) == "GCAA"
    assert reference.backbone(df.limit(0)) == ""
    assert [tuple(r) for r in reference.synthesised(df).orderBy("site").collect()] == [(0, "G"), (1, "C"), (2, "A"), (3, "A")]

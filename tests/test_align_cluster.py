"""Alignment by cost and length, clusters by what must hold."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixscan.functions import cigar, sql
from helixscan.operators import align, cluster, reference, sparse
from helixscan.plans import fixtures, queries

SF = "/root/testdata/sf0.001"
FAR = 10**9


def plain_cost(ref, seq):
    n, m = len(ref), len(seq)
    best, down, side = (np.full((n + 1, m + 1), FAR) for _ in range(3))
    best[0, 0] = 0
    for i in range(n + 1):
        for j in range(m + 1):
            if i:
                down[i, j] = min(best[i - 1, j] + 8, down[i - 1, j] + 2)
            if j:
                side[i, j] = min(best[i, j - 1] + 8, side[i, j - 1] + 2)
            pair = best[i - 1, j - 1] + 4 * (ref[i - 1] != seq[j - 1]) if i and j else best[i, j]
            best[i, j] = min(pair, down[i, j], side[i, j])
    return best[n, m]


def checked(ref, seq, cigar):
    """The cost of an alignment whose letters are what its operations say."""
    i = j = cost = 0
    for n, op in re.findall(r"(\d+)([MXID])", cigar):
        n = int(n)
        assert op in "ID" or all((x == y) == (op == "M") for x, y in zip(ref[i : i + n], seq[j : j + n], strict=True))
        cost += {"M": 0, "X": 4 * n, "I": 6 + 2 * n, "D": 6 + 2 * n}[op]
        i, j = i + n * (op in "MXD"), j + n * (op in "MXI")
    assert (i, j) == (len(ref), len(seq))
    return cost


def edited(g, ref, edits):
    seq = list(ref)
    for _ in range(edits):
        at = int(g.integers(0, len(seq) + 1))
        seq[at : at + int(g.integers(0, 4))] = list(g.choice(list("ACGTN"), int(g.integers(0, 4))))
    return "".join(seq)


@pytest.mark.parametrize("kept", [align.KEPT, 0])  # side by side; each on its own, from kept wavefronts
def test_alignments_have_the_least_cost(monkeypatch, kept):
    monkeypatch.setattr(align, "STRIDE", 5)
    g = np.random.default_rng(3)
    for _ in range(40):
        ref = "".join(g.choice(list("ACGT"), int(g.integers(1, 40))))
        seqs = [edited(g, ref, int(g.integers(0, 8))) for _ in range(3)] + ["".join(g.choice(list("ACGT"), int(g.integers(0, 30)))), ref]
        found = align.cigars(ref, seqs, kept=kept)
        assert [checked(ref, s, c) for s, c in zip(seqs, found, strict=True)] == [plain_cost(ref, s) for s in seqs]
        assert found[-1] == f"{len(ref)}M"
    assert align.cigars("ACGT", []) == [] and align.cigars("ACGT", [""]) == ["4D"]


def test_whole_genomes_align_in_little_time_and_memory():
    import time
    import tracemalloc

    g = np.random.default_rng(5)
    ref = "".join(g.choice(list("ACGT"), 29_903))
    near = ref
    for at in g.integers(0, 29_000, 30):
        near = near[:at] + g.choice([c for c in "ACGT" if c != near[at]]) + near[at + 1 :]
    align.cigars(ref, [near])
    began = time.process_time()
    cost = checked(ref, near, align.cigars(ref, [near])[0])
    assert cost == 120 and time.process_time() - began < 0.15  # about 0.03 s on an idle core
    ref = ref[:10_000]
    far = list(ref)
    for at in g.choice(10_000, 1000, replace=False):  # a tenth of all letters
        far[at] = g.choice([c for c in "ACGT" if c != far[at]])
    far = "".join(far)
    tracemalloc.start()
    found = align.cigars(ref, [far])[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert checked(ref, far, found) <= 4 * 1000 and peak < 60 << 20
    assert checked(ref, far, align.cigars(ref, [far], adaptive=512)[0]) >= checked(ref, far, found)


def test_cigar_columns(spark):
    rows = [("ACGT", "ACGT", "4M"), ("ACT", "ACGT", "2M1D1M"), ("AACGTT", "ACGT", "1I4M1I"), ("", "AC", "2D"), ("TG", "CG", "1X1M"), ("", "", "")]
    df = spark.createDataFrame(rows, "seq string, ref string, c string")
    c = F.col("c")
    found = df.select(cigar.cost(c), cigar.ref_sites(c), cigar.seq_letters(c), cigar.identity(c), cigar.projected(F.col("seq"), c), cigar.is_cigar(c), F.size(cigar.runs(c))).collect()
    assert [tuple(r) for r in found] == [(0, 4, 4, 1.0, "ACGT", True, 1), (8, 4, 3, 0.75, "AC-T", True, 3), (16, 4, 6, 0.66666667, "ACGT", True, 3), (10, 2, 0, 0.0, "--", True, 1), (4, 2, 2, 0.5, "TG", True, 2), (0, 0, 0, 0.0, "", True, 0)]
    sql.register(spark)
    again = df.selectExpr("seq_cigar_cost(c)", "seq_cigar_ref_sites(c)", "seq_cigar_letters(c)", "seq_cigar_identity(c)", "seq_cigar_projected(seq, c)").collect()
    assert [tuple(r) for r in again] == [tuple(r)[:5] for r in found]
    assert not spark.range(1).select(cigar.is_cigar(F.lit("4M3"))).first()[0]


def test_equal_sequence_is_unchanged(spark):
    df = spark.createDataFrame([(0, "a", "ACGTACGT"), (1, "short", "AC"), (2, "gap", "ACGACGT")], "ordinal long, name string, seq string")
    found = {r["name"]: (r["seq"], r["cost"]) for r in align.align(df, "ACGTACGT").collect()}
    assert found["a"] == ("ACGTACGT", 0) and found["gap"] == ("ACG-ACGT", 8) and "short" not in found


def test_all_alignments_have_the_length_of_the_reference(spark):
    rows = queries.align(spark, SF).collect()
    assert rows and all(len(r["seq"]) == fixtures.SITES for r in rows)


def test_clusters_divide_the_records(spark):
    records = fixtures.references(spark, SF)
    base = reference.backbone(records)
    seqs = {r["ordinal"]: r["seq"] for r in records.collect()}
    alone = cluster.leader(records, base, distance=1, queues=1).collect()
    for found in (alone, cluster.cluster(records, base, distance=1, queues=1).collect(), cluster.cluster(records, base, distance=1, queues=5).collect()):
        assert sorted(r["member"] for r in found) == sorted(seqs)
        medoids = {r["medoid"] for r in found}
        assert all(r["medoid"] == r["member"] for r in found if r["member"] in medoids)
        assert len(medoids) < len(seqs)
    # One queue needs no merge: it is the leader's own result.
    merged = cluster.cluster(records, base, distance=1, queues=1).collect()
    assert sorted((r["medoid"], r["member"]) for r in merged) == sorted((r["medoid"], r["member"]) for r in alone)


def test_equal_records_are_one_cluster(spark):
    rows = [(i, f"s{i}", "ACGTACGTAC" if i % 2 else "TTTTTTTTTT") for i in range(40)]
    df = spark.createDataFrame(rows, "ordinal long, name string, seq string")
    found = cluster.cluster(df, "ACGTACGTAC", distance=1, queues=7).collect()
    assert len({r["medoid"] for r in found}) == 2 and len(found) == 40


def test_merge_in_small_units_is_the_same(spark, monkeypatch):
    records = fixtures.references(spark, SF)
    base = reference.backbone(records)
    want = sorted(map(tuple, cluster.cluster(records, base, queues=4).collect()))
    monkeypatch.setattr(sparse.units, "__defaults__", (None, None, 0, 5))  # fewer records for the index, small units
    assert sorted(map(tuple, cluster.cluster(records, base, queues=4).collect())) == want


def test_rounds_in_tasks_are_those_of_joins(spark, monkeypatch):
    """All rounds in one task, some of them, and none."""
    records = fixtures.references(spark, SF)
    base = reference.backbone(records)
    jobs, found = [], []
    for most in (1 << 15, 60, 0):
        monkeypatch.setattr(cluster, "TOGETHER", most)
        spark.sparkContext.setJobGroup(f"together {most}", "")
        found.append(sorted(map(tuple, cluster.cluster(records, base, queues=7).collect())))
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"together {most}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert found[0] == found[1] == found[2] and len({r[0] for r in found[0]}) > 1
    assert jobs[0] < jobs[1] < jobs[2] and jobs[0] < 25


def test_lines_of_the_table_hold_all_members(spark):
    rows = [(i, f"s{i}", "ACGTACGTAC" if i % 3 else "TTTTTTTTTT") for i in range(40)]
    found = cluster.cluster(spark.createDataFrame(rows, "ordinal long, name string, seq string"), "ACGTACGTAC", distance=1, queues=3)
    lines = [r["line"].split(",") for r in cluster.table(found, per_line=4).collect()]
    assert len(lines) > 2 and {x[0] for x in lines} == {r["medoid_name"] for r in found.collect()}
    assert sorted({x for line in lines for x in line}) == sorted(r[1] for r in rows)


def test_sql_functions_are_the_columns(spark):
    from helixscan.functions import chars

    sql.register(spark)
    g = np.random.default_rng(5)
    pairs = [tuple("".join(g.choice(list("ACGTN-?.MRWKBZ"), 30)) for _ in range(2)) for _ in range(50)]
    df = chars.with_pair_counts(spark.createDataFrame(pairs, "q string, r string"), "q", "r")
    names = {"acgt_matches": "acgt", "text_matches": "text", "partial_matches": "partial", "valid_pairs": "valid", "acgt_pairs": "acgt_valid", "differences": "hamming"}
    for row in df.selectExpr("*", *[f"seq_{k}(q, r) AS f_{k}" for k in names], "seq_acgt_mismatches(q, r) AS m", "seq_text_mismatches(q, r) AS t", "seq_count_valid(q) AS v").collect():
        assert [row[f"f_{k}"] for k in names] == [row[v] for v in names.values()]
        assert (row["m"], row["t"], row["v"]) == (row["acgt_valid"] - row["acgt"], row["valid"] - row["text"], sum(c not in chars.INVALID for c in row["q"]))

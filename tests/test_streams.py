"""Streams of records: clusters with state, FASTA files as they arrive."""

import gzip

import numpy as np
import pytest
from test_sparse import made

from helixscan.operators import cluster
from helixscan.streaming import cluster as streaming


@pytest.fixture(scope="module")
def seqs():
    return made(np.random.default_rng(21), 150, 120, 2)


def batches(spark, rows, folder, sizes):
    """Files that are read one by one, in the order of their times."""
    import os

    at = 0
    for k, n in enumerate(sizes):
        path = f"{folder}/{k}"
        spark.createDataFrame(rows[at : at + n], "ordinal long, name string, seq string").coalesce(1).write.parquet(path)
        for name in os.listdir(path):
            if name.endswith(".parquet"):
                os.makedirs(f"{folder}/all", exist_ok=True)
                os.rename(f"{path}/{name}", f"{folder}/all/{k}.parquet")
                os.utime(f"{folder}/all/{k}.parquet", (1e9 + k, 1e9 + k))
        at += n
    return spark.readStream.schema("ordinal long, name string, seq string").option("maxFilesPerTrigger", 1).parquet(f"{folder}/all")


def test_stream_of_any_batches_gives_the_clusters_of_one_run(spark, seqs, tmp_path, monkeypatch):
    monkeypatch.setattr(cluster, "QUEUE", 64)
    base, found = seqs
    rows = [(i, f"s{i}", s) for i, s in enumerate(found)]
    df = spark.createDataFrame(rows, "ordinal long, name string, seq string")
    columns = ["queue", "medoid", "member", "medoid_name", "member_name", "letters", *cluster.SCORES]
    want = sorted(map(repr, cluster.leader(df, base, 2).select(*columns).collect()))
    for k, sizes in enumerate(([150], [40, 1, 60, 49])):
        stream = batches(spark, rows, tmp_path / str(k), sizes)
        got = streaming.stream_cluster(stream, base, 2, partial=str(tmp_path / f"partial{k}"), every=2, checkpoint=str(tmp_path / f"state{k}"))
        assert sorted(map(repr, got.select(*columns).collect())) == want
        assert [p.rsplit("=")[1] for p in streaming.partial_tables(spark, str(tmp_path / f"partial{k}"))] == [f"{n:012}" for n in range(1, len(sizes), 2)]
    # The partial table after two batches is that of the records up to there.
    first = streaming.partial_tables(spark, str(tmp_path / "partial1"))[0]
    lines = sorted(r[0] for r in spark.read.text(first).collect())
    assert lines == sorted(r["line"] for r in cluster.table(cluster.leader(df.where("ordinal < 41"), base, 2)).collect())


def test_stream_goes_on_from_its_checkpoint(spark, seqs, tmp_path):
    base, found = seqs
    rows = [(i, f"s{i}", s) for i, s in enumerate(found[:60])]
    folder = tmp_path / "files"
    stream = batches(spark, rows[:30], folder / "a", [30])
    state = str(tmp_path / "state")
    assert streaming.stream_cluster(stream, base, 2, queues=1, checkpoint=state).count() == 30
    import os
    import shutil

    batches(spark, rows[30:], folder / "b", [30])
    shutil.copy(folder / "b/all/0.parquet", folder / "a/all/9.parquet")
    os.utime(folder / "a/all/9.parquet", (2e9, 2e9))
    got = streaming.stream_cluster(spark.readStream.schema("ordinal long, name string, seq string").parquet(str(folder / "a/all")), base, 2, queues=1, checkpoint=state)
    df = spark.createDataFrame(rows, "ordinal long, name string, seq string")
    assert sorted((r["medoid"], r["member"]) for r in got.collect()) == sorted((r["medoid"], r["member"]) for r in cluster.leader(df, base, 2, queues=1).collect())


def xz_files(tmp_path, text):
    """The same text as xz of one block, of several streams, and of several blocks of one stream if the program is there."""
    import lzma
    import shutil
    import subprocess

    (tmp_path / "one.xz").write_bytes(lzma.compress(text))
    cuts = [0, 1, 700, 701, 1500, len(text)]
    (tmp_path / "streams.xz").write_bytes(b"".join(lzma.compress(text[a:b]) + b"\0" * 8 for a, b in zip(cuts, cuts[1:])))  # noqa: B905
    if shutil.which("xz"):
        for size in (100, 333):
            (tmp_path / f"b{size}.xz").write_bytes(subprocess.run(["xz", "-c", f"--block-size={size}"], input=text, capture_output=True, check=True).stdout)
    return sorted(map(str, tmp_path.glob("*.xz")))


def test_xz_blocks_give_the_records_of_the_whole_file(spark, tmp_path):
    from helixscan.sources import fasta, files

    g = np.random.default_rng(5)
    text = "junk\n" + "".join(f"x>r{i} >q\n" + "".join("".join(g.choice(list("acgtN"), int(g.integers(0, 90)))) + g.choice(["\n", "\r\n", "\n\n"]) for _ in range(int(g.integers(0, 4)))) for i in range(80))
    want = list(fasta.records(files.lines(iter([text.encode()]))))
    assert len(want) > 50
    for path in xz_files(tmp_path, text.encode()):
        for size in (1, 250, 10**6):
            parts = fasta.parts_of_file(0, path, size)
            assert [(r[4], r[5]) for p in parts for r in p.records()] == want
        with files.opened(path) as f:
            many = files.blocks(f, files.located(path)[0].get_file_info(path).size)
            assert b"".join(x for b in many for x in files.block_text(f, b)) == text.encode()
    path = xz_files(tmp_path, text.encode())[-1]
    found = fasta.read_fasta(spark, [path, f"file://{path}"], part_size=300)
    assert [tuple(r) for r in found.orderBy("ordinal").collect()] == [(i, *r) for i, r in enumerate(want * 2)]


def test_xz_lines_are_replaced(spark, tmp_path):
    import lzma

    from helixscan.sources import files, sinks

    path = str(tmp_path / "lines")
    for n in (900, 5):
        sinks.write_lines(spark.range(n).selectExpr("id", "concat('l', id) AS line"), path, "id", compression="xz")
        found = [line for p, _ in files.listed(path) for line in lzma.open(p, "rt").read().split()]
        assert found == [f"l{i}" for i in range(n)]


def test_fasta_stream_repeats_and_loses_nothing(spark, tmp_path):
    from helixscan.sources import fasta, files

    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()
    records = [(f"s{i}", "ACGT" * (i + 1)) for i in range(12)]

    def put(k, opener=open):
        with opener(folder / f"f{9 - k}.fa", "wt") as f:
            f.write("".join(f">{n}\n{s}\n" for n, s in records[3 * k : 3 * k + 3]))

    def run(**trigger):
        query = fasta.write_fasta_stream(fasta.stream_fasta(spark, str(folder), files_per_batch=len(trigger)), out, state, "gzip", **trigger)
        if trigger:
            query.processAllAvailable()
            query.stop()
        query.awaitTermination()
        return sorted((r["name"], r["seq"]) for r in fasta.read_fasta(spark, [p for p, _ in files.listed(out)]).collect())

    put(0)
    put(1, gzip.open)
    assert run() == sorted(records[:6])
    assert run() == sorted(records[:6])
    put(2)
    put(3)  # sorts before the files that have been read
    assert run(processingTime="0 seconds") == sorted(records)
    assert len({p.name.split("-part")[0] for p in (tmp_path / "out").glob("batch*")}) == 3  # two files, then one by one


def test_batch_that_is_committed_again_replaces_its_files(tmp_path):
    from types import SimpleNamespace

    from helixscan.sources import fasta, files

    w = fasta.FastaStreamWriter({"path": str(tmp_path / "x"), "compression": "none"})
    for rows in (["a", "b"], ["c"]):
        w.commit([SimpleNamespace(part=i, file=fasta.TaskFile(w.path, "none").written(iter([f">{r}\nA\n"]))) for i, r in enumerate(rows)], 4)
    w.abort([SimpleNamespace(part=0, file=fasta.TaskFile(w.path, "none").written(iter(["x"]))), None], 5)
    assert [p.rsplit("/", 1)[1] for p, _ in files.listed(w.path)] == ["batch-00000004-part-00000.aln"]
    assert len(list((tmp_path / "x").iterdir())) == 1

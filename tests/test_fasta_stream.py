"""FASTA files of all kinds, and searches over streams."""

import bz2
import gzip
import io
import lzma

import pytest

from helixscan.operators import nearest, profile
from helixscan.plans import fixtures
from helixscan.sources import fasta, sinks
from helixscan.streaming import search

SF = "/root/testdata/sf0.001"
TEXT = ">one  with words\r\nacg tac\r\n\r\nGT\r\n>empty\n>two\nNN--\nx>three\nAC"
WANT = [("one  with words", "ACGTACGT"), ("two", "NN--"), ("three", "AC")]


def test_files_of_all_codecs(spark, tmp_path):
    paths = []
    for i, opener in enumerate((open, gzip.open, bz2.open, lzma.open)):
        paths.append(str(tmp_path / f"{i}.aln"))
        with opener(paths[-1], "wt") as f:
            f.write(TEXT)
    (tmp_path / "none.aln").write_text("")
    found = fasta.read_fasta(spark, [*paths, str(tmp_path / "none.aln")]).orderBy("ordinal").collect()
    assert [(r["name"], r["seq"]) for r in found] == WANT * 4
    assert [r["ordinal"] for r in found] == list(range(12))


def test_sink_and_source(spark, tmp_path):
    df = fixtures.queries(spark, SF)
    for codec in ("xz", "gzip", "bzip2", "none"):
        fasta.write_fasta(df.repartition(3), str(tmp_path / codec), codec)
        back = fasta.read_fasta(spark, sorted(map(str, (tmp_path / codec).glob("part*"))))
        assert sorted(map(tuple, back.select("name", "seq").collect())) == sorted(map(tuple, df.select("name", "seq").collect()))


def test_text_reader_takes_what_the_source_takes(spark, tmp_path):
    (tmp_path / "a.txt").write_text(">one\nacg\nTT\n>two\nNN-\n")
    assert [tuple(r) for r in fasta.read_fasta_text(spark, str(tmp_path)).orderBy("ordinal").collect()] == [(0, "one", "ACGTT"), (1, "two", "NN-")]


def test_text_reader_keeps_the_rules_and_the_order(spark, tmp_path):
    (tmp_path / "b.txt").write_text(TEXT.replace("\r", "") + "\n>last\nA")
    (tmp_path / "a.txt").write_text("".join(f">s{i:04}\nac\n gt\n" for i in range(2000)))
    with gzip.open(tmp_path / "c.txt.gz", "wt") as f:
        f.write(">z>y\nTT")
    paths = [str(tmp_path / x) for x in ("b.txt", "a.txt", "c.txt.gz")]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        found = [tuple(r) for r in fasta.read_fasta_text(spark, paths).orderBy("ordinal").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = [*WANT, ("last", "A"), *((f"s{i:04}", "ACGT") for i in range(2000)), ("z>y", "TT")]
    assert found == [(i, *x) for i, x in enumerate(want)]


def test_first_record(spark):
    df = spark.createDataFrame([(4, "b", "TT"), (2, "a", "ACGT")], "ordinal long, name string, seq string")
    assert fasta.first_record(df) == ("a", "ACGT")
    with pytest.raises(ValueError, match="no sequence"):
        fasta.first_record(df.limit(0))


def test_table_and_alignment_sinks(spark, tmp_path):
    q, r = fixtures.queries(spark, SF), fixtures.references(spark, SF)
    names = sinks.output_names("nearest", str(tmp_path / "run"))
    table, order = nearest.nearest(r, q, n=4), profile.query_order(q)
    sinks.write_table(table, order, names["table"], "none")
    lines = [line for p in sorted((tmp_path / "run.csv").glob("part*")) for i, line in enumerate(p.read_text().splitlines()) if i]
    at = {x["name"]: x["resolution_order"] for x in order.collect()}
    places = [(at[line.split(",")[0]], int(line.split(",")[2])) for line in lines]
    assert places == sorted(places) and len(places) == table.count()
    assert sinks.read_table(spark, names["table"]).columns == ["query", "reference", "rank", *nearest.FULL]
    out = io.StringIO()
    assert sinks.print_alignment(q, out) == q.count()
    assert out.getvalue() == "".join(f">{x['name']}\n{x['seq']}\n" for x in q.orderBy("ordinal").collect())
    sinks.write_alignment(q, names["alignment"])
    assert [x["name"] for x in fasta.read_fasta_text(spark, names["alignment"]).orderBy("ordinal").collect()] == [x["name"] for x in q.orderBy("ordinal").collect()]
    assert sinks.output_names("ball") == {"alignment": "ball.aln", "table": "ball.csv"}


def test_partial_lines_are_replaced(spark, tmp_path):
    for n in (3, 5):
        sinks.write_lines(spark.range(n).selectExpr("id", "concat('l', id) AS line"), str(tmp_path / "lines"), "id", compression="none")
    assert "".join(p.read_text() for p in sorted((tmp_path / "lines").glob("part*"))).split() == ["l0", "l1", "l2", "l3", "l4"]


def test_stream_of_several_files_is_the_batch(spark, tmp_path):
    q, r = fixtures.queries(spark, SF), fixtures.references(spark, SF)
    want = sorted(map(tuple, nearest.nearest(r, q, n=5).collect()))
    r.repartition(4).write.parquet(str(tmp_path / "refs"))
    stream = spark.readStream.schema(r.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "refs"))
    progress: list[dict] = []
    found = search.stream_nearest(stream, q, progress, str(tmp_path / "entrants"), n=5)
    assert [p["batch"] for p in progress] == list(range(len(progress))) and sum(p["n_read"] for p in progress) == r.count() and len(progress) > 1
    entered = spark.read.parquet(str(tmp_path / "entrants"))
    assert found.join(entered, ["query_ordinal", "ref_ordinal", "entered_at_batch"], "left_anti").count() == 0 and entered.count() > found.count()
    assert found.agg({"entered_at_batch": "max"}).first()[0] > 0
    assert sorted(map(tuple, found.drop("entered_at_batch").collect())) == want

"""Clustering of records that arrive as a stream.

The state of a queue is its medoids, as sparse records; a queue has ``cluster.QUEUE`` records, unless a number of queues is given.  Records of a
micro-batch are taken in the order of their ordinals after those of earlier batches, as from files that are read one after the other; so
the clusters are those of one run over all records, whatever the batches.

A batch adds its members and the medoids that it made or replaced to a folder.  Every few batches the clusters so far are written as a partial
table, each in a folder of its own, so that a reader never meets one that is half written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixscan.operators import cluster, sparse
from helixscan.sources.storage import shared_path

from .search import drained

SPARSE = "sites array<int>, letters binary, unknown array<int>, d_ref long, snp long, known long"
OUT = f"queue int, cluster long, member long, member_name string, medoid long, medoid_name string, {SPARSE}"
HELD = ["ordinal", "name", *sparse.COLUMNS, *cluster.SCORES]
HELD_TYPES = pa.schema([("ordinal", pa.int64()), ("name", pa.string()), ("sites", pa.list_(pa.int32())), ("letters", pa.binary()), ("unknown", pa.list_(pa.int32())), *((c, pa.int64()) for c in cluster.SCORES)])


def packed(rows: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, HELD_TYPES) as out:
        out.write_table(pa.Table.from_pandas(rows[HELD], HELD_TYPES, preserve_index=False))
    return sink.getvalue().to_pybytes()


def unpacked(held: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(held).read_pandas()


def stepped(stream: DataFrame, reference: str, distance: int, trim: int, queues: int | None, ring: bool, raw: bool) -> DataFrame:
    """A row for each member (its cluster's number in the queue) and one for each medoid that is new or replaced."""
    base = reference.encode()[trim : len(reference) - trim]
    df = sparse.records(stream, reference, trim, raw).withColumn("queue", cluster.queue_of(F.col("ordinal"), queues))

    def run(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = unpacked(state.get[0]) if state.exists else pd.DataFrame({c: [] for c in HELD})
        new = pd.concat(list(parts), ignore_index=True).sort_values("ordinal", ignore_index=True)
        n = len(held)
        rows = pd.concat([held[HELD], new[HELD]], ignore_index=True) if n else new[HELD]
        own = cluster.Queue(sparse.columns(rows, base), rows["d_ref"].to_numpy(np.int64), rows["known"].to_numpy(np.int64), distance, ring).begin(n)
        of = [own.add(i) for i in range(n, len(rows))]
        medoids = rows.iloc[own.medoid].reset_index(drop=True)
        state.update((packed(medoids),))
        changed = [k for k, i in enumerate(own.medoid) if i >= n]
        members = pd.DataFrame({"queue": key[0], "cluster": of, "member": new["ordinal"], "member_name": new["name"]})
        there = medoids.iloc[changed].rename(columns={"ordinal": "medoid", "name": "medoid_name"}).assign(queue=key[0], cluster=changed)
        both = pd.concat([members, there], ignore_index=True)
        for c in ("member", "medoid", *cluster.SCORES):
            both[c] = both[c].astype("Int64")
        for c in ("member_name", "medoid_name", *sparse.COLUMNS):
            both[c] = both[c].astype(object).where(both[c].notna(), None)
        yield both[[c.split()[0] for c in OUT.split(", ")]]

    return df.groupBy("queue").applyInPandasWithState(run, OUT, "held binary", "append", "NoTimeout")


def clusters(spark: SparkSession, folder: str) -> DataFrame:
    """The clusters of all batches so far, with the columns of ``cluster.leader``."""
    rows = spark.read.schema(f"{OUT}, batch long").parquet(folder)
    of_medoid = [c for c in rows.columns if c not in ("queue", "cluster", "member", "member_name", "batch")]
    medoids = rows.where("medoid IS NOT NULL").groupBy("queue", "cluster").agg(F.max_by(F.struct(*of_medoid), "batch").alias("m")).select("queue", "cluster", "m.*")
    joined = rows.where("member IS NOT NULL").select("queue", "cluster", "member", "member_name").join(medoids, ["queue", "cluster"])
    own = F.col("medoid") == F.col("member")
    return joined.select("queue", "medoid", "member", "medoid_name", "member_name", *[F.when(own, F.col(c)).alias(c) for c in sparse.COLUMNS], *cluster.SCORES)


def partial_tables(spark: SparkSession, folder: str) -> list[str]:
    """Folders of the partial tables that are complete, the oldest first."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/after=*/_SUCCESS")) or []
    return sorted(x.getPath().getParent().toString() for x in found)


def stream_cluster(
    stream: DataFrame, reference: str, distance: int = 1, trim: int = 0, queues: int | None = None, ring: bool = True, raw: bool = False, partial: str | None = None, every: int = 10, checkpoint: str | None = None
) -> DataFrame:
    """``cluster.leader`` over a stream of records (``ordinal, name, seq``): works off what is there and returns the clusters so far.

    ``partial``: a folder for partial tables (lines of names, as ``cluster.table`` has them before queues are merged), one after ``every`` batches.
    ``checkpoint``: a folder for the stream's state and the results of its batches; a run with the same one goes on where the last one ended."""
    spark = stream.sparkSession
    root = checkpoint or shared_path(spark, "clusters")
    folder = f"{root}/batches"

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")  # a batch that is run again replaces its own rows
        if partial and number % every == every - 1:
            lines = cluster.table(clusters(spark, folder))
            lines.orderBy("place", "part").select("line").write.mode("overwrite").option("compression", "gzip").text(f"{partial}/after={number:012}")

    drained(stepped(stream, reference, distance, trim, queues, ring, raw), step, f"{root}/stream")
    return clusters(spark, folder)

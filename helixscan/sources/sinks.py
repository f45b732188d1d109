"""Where results go: tables and alignments under a prefix, standard output, partial results.

A run's files are named by a prefix, which is the program's name unless one is given.
"""

from __future__ import annotations

import sys
import uuid
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files
from .fasta import Lines, fasta_text


def output_names(program: str, prefix: str | None = None) -> dict[str, str]:
    """Folders of the alignment and the table of a run."""
    stem = prefix or program
    return {"alignment": f"{stem}.aln", "table": f"{stem}.csv"}


def write_table(table: DataFrame, order: DataFrame, path: str, compression: str = "gzip") -> None:
    """The table of a search as CSV with a header: least resolved queries first, then by rank.

    ``order``: ``ordinal, resolution_order`` of the queries.  Files follow each other by name; the rows are sorted over all of them."""
    columns = [c for c in table.columns if c not in ("query_ordinal", "ref_ordinal")]
    ordered = table.join(order.select(F.col("ordinal").alias("query_ordinal"), "resolution_order"), "query_ordinal").orderBy("resolution_order", "rank")
    ordered.select(*columns).write.option("header", True).option("compression", compression).csv(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    names = spark.read.option("header", True).csv(path).columns
    kinds = {"query": "string", "reference": "string"}
    return spark.read.option("header", True).schema(", ".join(f"`{c}` {kinds.get(c, 'long')}" for c in names)).csv(path)


def write_alignment(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Records (``ordinal, name, seq``) as FASTA in the order of their ordinals, on any file system that Spark writes."""
    fasta_text(records.orderBy("ordinal")).write.option("compression", compression).text(path)


def print_alignment(records: DataFrame, out: TextIO | None = None) -> int:
    """Records as FASTA on standard output, a partition at a time; returns how many."""
    n = 0
    for row in fasta_text(records.orderBy("ordinal")).toLocalIterator(prefetchPartitions=False):
        print(row["value"], file=out or sys.stdout)
        n += 1
    return n


def write_lines(lines: DataFrame, path: str, *order, compression: str = "gzip") -> None:
    """A column ``line`` as text in ``order``; what is there already is replaced, as for partial results of a run.  ``compression``: Spark's, or xz."""
    ordered = lines.orderBy(*order)
    if compression != "xz":
        ordered.select("line").write.mode("overwrite").option("compression", compression).text(path)
        return
    lines.sparkSession.dataSource.register(Lines)
    old = files.listed(path)
    ordered.select(F.col("line").alias("value")).write.format("lines").option("compression", "xz").option("prefix", uuid.uuid4().hex).mode("append").save(path)
    for name, _ in old:
        system, at = files.located(name)
        system.delete_file(at)

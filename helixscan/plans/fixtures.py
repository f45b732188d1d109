"""Aligned sequences made from the numbers of a table's rows, in Spark and in SQL.

The tables hold no sequences, so that both sides of a test work these out: records of lineages with
private SNPs, ragged ends, runs that drop out, partial letters, records of low quality, and copies
that are equal or know less.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixscan.operators.nearest import spread
from helixscan.sources.storage import written

SITES = 120
QUERY_OFFSET = 100_000

_SITE = """CASE
 WHEN e % 50 = 49 AND i % 3 <> 0 THEN 'N'
 WHEN e % 8 = 3 AND i {div} 10 = e % 7 THEN 'N'
 WHEN i < k % 3 OR i >= 120 - (k % 4) THEN '-'
 WHEN i < 80 AND (k * 17 + (i {div} 10) * 29) % 37 = 0 THEN 'N'
 WHEN i < 90 AND (k * 31 + i * 271) % 211 = 0 THEN substr('MRWSYK', {int}1 + (k + i) % 6 {end}), 1)
 ELSE substr('ACGT', {int}1 + ((i * i * 31 + i * 17 + 7) % 101
   + CASE WHEN i % 3 <> 0 AND ((k % 12) * 37 + i * 13) % 41 = 0 THEN 1 ELSE 0 END
   + CASE WHEN i % 3 <> 0 AND (k * 7919 + i * 104729) % 9973 % 131 = 0 THEN 2 ELSE 0 END) % 4 {end}), 1)
END"""
SPARK_SITE = _SITE.format(div="div", int="cast(", end="as int")
DUCK_SITE = _SITE.format(div="//", int="(", end="")


def sequences(df: DataFrame, key: str, offset: int, prefix: str) -> DataFrame:
    """``ordinal, name, seq`` for every row of ``df``."""
    e = df.select(F.col(key).cast("long").alias("ordinal"), (F.col(key).cast("long") + offset).alias("e"))
    e = e.withColumn("k", F.expr("e - if(e % 4 = 3, 1, 0)"))
    seq = F.expr(f"array_join(transform(sequence(0L, {SITES - 1}L), i -> {SPARK_SITE}), '')")
    return e.select("ordinal", F.concat(F.lit(prefix), F.col("ordinal").cast("string")).alias("name"), seq.alias("seq"))


def records(keys: DataFrame, key: str, offset: int, prefix: str) -> DataFrame:
    """The sequences as a table, so that a search that reads its records several times does not make them again."""
    return written(sequences(spread(keys.select(key)), key, offset, prefix), "records")


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark.read.parquet(f"{sf_dir}/customer.parquet"), "c_custkey", 0, "ref")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark.read.parquet(f"{sf_dir}/supplier.parquet"), "s_suppkey", QUERY_OFFSET, "query")


GENOME = 29_903


def genomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record of the length of a viral genome for every customer: one of twelve lineages with 20 SNPs each, three private SNPs and an end that is unknown."""
    keys = spread(spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("long").alias("ordinal")))
    base = "".join("ACGT"[(i * i * 31 + i * 17 + i // 97) % 101 % 4] for i in range(GENOME))
    places = "concat(transform(sequence(1, 20), j -> 1 + ((ordinal % 12) * 7919 + j * 1409) % 29903), transform(sequence(1, 3), j -> 1 + (ordinal * 104729 + j * 7877) % 29903))"
    seq = F.expr(f"aggregate({places}, '{base}', (s, p) -> overlay(s PLACING translate(substring(s, CAST(p AS INT), 1), 'ACGT', 'CGTA') FROM CAST(p AS INT)))")
    made = keys.select("ordinal", F.concat(F.lit("genome"), F.col("ordinal").cast("string")).alias("name"), seq.alias("seq"))
    unknown = (F.col("ordinal") % 200).cast("int")
    return written(made.withColumn("seq", F.concat(F.repeat(F.lit("N"), unknown), F.substring(F.col("seq"), unknown + 1, F.lit(GENOME)))), "genomes")


def duck_sites(table: str, key: str, offset: int) -> str:
    """SELECT of ``id, site, c`` for every site of every row."""
    return (
        f"SELECT id, i AS site, {DUCK_SITE} AS c FROM (SELECT id, e, CASE WHEN e % 4 = 3 THEN e - 1 ELSE e END AS k, i FROM "
        f"(SELECT CAST({key} AS BIGINT) AS id, CAST({key} AS BIGINT) + {offset} AS e FROM {table}) a, (SELECT CAST(range AS BIGINT) AS i FROM range({SITES})) b) c"
    )

"""Small helpers that several operators share."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixscan.sources.storage import shared_path, written  # noqa: F401


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def named(column: str) -> Column:
    """The column of just this name, whatever characters the name has."""
    return F.col("`" + column.replace("`", "``") + "`")


def unlike(columns: list[str], new: tuple[str, ...]) -> list[str]:
    """Those of ``columns`` that are not named like a new one, in whatever case."""
    taken = {c.lower() for c in new}
    return [c for c in columns if c.lower() not in taken]


def set_aside(docs: DataFrame, *needed: str, **computed: Column) -> DataFrame:
    """The columns ``needed``, the ``computed`` ones and, as the struct ``_others``, all others, whose names can then clash with none."""
    others = [named(c) for c in docs.columns if c not in needed]
    return docs.select(*map(named, needed), *[c.alias(name) for name, c in computed.items()], *([F.struct(*others).alias("_others")] if others else []))


def restored(df: DataFrame, columns: list[str], *new: str) -> DataFrame:
    """``columns`` as they were before ``set_aside``, but for those named like a new one, then the new ones."""
    aside = df.schema["_others"].dataType.names if "_others" in df.columns else []
    kept = [F.col("_others").getField(c).alias(c) if c in aside else named(c) for c in unlike(columns, new)]
    return df.select(*kept, *new)


#: A key that has more than one in so many of all rows is joined by broadcast; there are at most so many.
HOT = 1000


def joined_by_key(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join with ``right``, which has one row for each key and, as ``rows``, how many rows of ``left`` may have it.

    The rows of a hot key stay where they are: at most ``HOT`` rows of ``right`` go to all tasks.  All others are
    joined by shuffle, where no key has more than one in ``HOT`` of the rows."""
    right = written(right, "keys")
    total = right.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    hot, others = right.where(F.col("rows") * HOT > total), right.where(F.col("rows") * HOT <= total)
    columns = [c for c in right.columns if c not in (*keys, "rows")]
    near = left.join(F.broadcast(hot.drop("rows")), keys)
    far = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(others.drop("rows"), keys)
    out = [*keys, *(c for c in left.columns if c not in keys), *columns]
    return near.select(*out).union(far.select(*out))


def as_bytes(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as UTF-8; null counts as the empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def as_texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def slices(batch: pa.RecordBatch, column: str, limit: int = 8 << 20):
    """Parts of a batch that hold about ``limit`` bytes of ``column`` each, so that memory is bounded."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)

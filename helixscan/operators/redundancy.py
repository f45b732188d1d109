"""Queries that another query makes redundant.

Two records agree if no valid pair of their sites differs.  One dominates the other if they agree and
it knows all sites that the other knows.  Keeping the resolved ones drops every record that is strictly
dominated; keeping the less resolved ones drops every record that strictly dominates another.  Of records with the
same known sites and letters, the one with the least ordinal stays.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixscan.functions import chars
from helixscan.sources.storage import written

from . import filters, sparse
from .reference import backbone


def signature(seq: Column, acgt: bool, trim: int) -> Column:
    """The sequence with everything that tells nothing as ``N``."""
    return F.regexp_replace(chars.trimmed(seq, trim), "[^ACGT]" if acgt else r"[NXO?.\-]", "N")


def _kept(records: DataFrame, acgt: bool, trim: int, more: bool) -> DataFrame:
    records = filters.of_length(records, (records.select(F.length("seq")).first() or [0])[0], "query")
    # The first of each signature, found before the shuffle: copies of one record don't meet in a task.
    first = records.withColumn("_sign", signature(F.col("seq"), acgt, trim)).groupBy("_sign").agg(F.min(F.struct("ordinal", *[c for c in records.columns if c != "ordinal"])).alias("_r"))
    own = written(first.select("_sign", *[F.col(f"_r.{c}") for c in records.columns]), "signatures")
    signs = own.select("ordinal", "name", F.col("_sign").alias("seq"))
    base = backbone(signs)
    rows = written(sparse.records(signs, base, what="query").select(F.col("ordinal").alias("id"), "known", *sparse.COLUMNS), "sparse")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        side = rows["is_left"].to_numpy()
        if side.all() or not side.any():
            return pd.DataFrame({"ordinal": []})
        letters, known, name = sparse.columns(rows, base.encode()), rows["known"].to_numpy(), rows["id"].to_numpy()
        a, b = np.flatnonzero(side), np.flatnonzero(~side)
        covers = sparse.differences(letters[a], letters[b]) == 0
        # The left one knows more, and all that the right one knows.
        missing = sparse.unknown_cells(rows["unknown"]).astype(np.float32)
        covers &= (known[a][:, None] > known[b][None]) & (missing[a] @ (1 - missing[b]).T == 0)
        return pd.DataFrame({"ordinal": name[b][covers.any(0)] if more else name[a][covers.any(1)]})

    dropped = sparse.units(rows, rows, 0).groupBy("unit").applyInPandas(run, "ordinal long")
    return own.join(dropped.distinct(), "ordinal", "left_anti").select(*records.columns)


def keep_resolved(records: DataFrame, acgt: bool = False, trim: int = 0) -> DataFrame:
    """Without the records that a better resolved one covers."""
    return _kept(records, acgt, trim, True)


def keep_less_resolved(records: DataFrame, acgt: bool = False, trim: int = 0) -> DataFrame:
    """Without the records that cover a less resolved one."""
    return _kept(records, acgt, trim, False)

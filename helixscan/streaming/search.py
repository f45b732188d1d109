"""Searches over references that arrive as a stream of files.

Each micro-batch gives its best references of every query; they are united with the best so far and
ranked again.  Under a total order this gives what one search over all references gives, whatever the batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from helixscan.operators import align as aligner
from helixscan.operators import ball as ball_search
from helixscan.operators import filters, nearest
from helixscan.operators.filters import Parameters
from helixscan.operators.profile import site_profile
from helixscan.sources.storage import shared_path, written


def drained(refs: DataFrame, step, checkpoint: str | None = None) -> None:
    """Runs ``step(batch, number)`` on all micro-batches that are there."""
    query = refs.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint or shared_path(refs.sparkSession, "stream")).trigger(availableNow=True).start()
    query.awaitTermination()


def stream_nearest(refs: DataFrame, queries: DataFrame, progress: list[dict] | None = None, entrants: str | None = None, **options) -> DataFrame:
    """``nearest`` over a stream of references (``ordinal, name, seq``), with ``entered_at_batch``: the batch in which a
    reference came among the best and stayed.  ``progress`` gets a row of counts for each batch, from the pass that scores it.
    ``entrants``: a folder for all that ever came among the best, batch by batch, whether they stayed or not."""
    _, queries, p = nearest.prepared(queries, queries, Parameters(**options))
    profile = written(site_profile(queries, p.acgt, p.trim), "profile")
    queries = written(queries, "queries")
    arrays = nearest.profile_arrays(profile)
    length = len(arrays[0])
    best: list[DataFrame] = []

    def step(batch: DataFrame, number: int) -> None:
        counters = Observation() if progress is not None else None
        own = nearest.spread(filters.kept_references(filters.of_length(batch, length), queries if p.exclude_self else None, p.ref_ambiguity, counters))
        new, _ = nearest.over_blocks(queries, lambda block: nearest.scored_block(own, block, arrays, p.n, p.acgt), "scored", n=p.n)
        if new is None:
            return
        new = new.withColumn("entered_at_batch", F.lit(number).cast("long"))
        # The table of a batch that is run again is written anew, from the same table before it.
        both = new if not best else best[-1].drop("rank").unionByName(new)
        best.append(written(nearest.ranked(both, p.n, p.acgt), "best"))
        if entrants:  # a batch that is run again replaces its own
            best[-1].where(F.col("entered_at_batch") == number).drop("entered_at_batch").write.mode("overwrite").parquet(f"{entrants}/entered_at_batch={number}")
        if counters is not None:
            progress.append({"batch": number, **counters.get})

    drained(refs, step)
    if not best:
        return nearest.nearest(queries.limit(0), queries, **options).withColumn("entered_at_batch", F.lit(None).cast("long"))
    return best[-1]


def stream_ball(refs: DataFrame, queries: DataFrame, **options) -> DataFrame:
    """``ball`` over a stream of references: each micro-batch is filtered on its own and appended."""
    queries = written(queries, "queries")
    folder = shared_path(refs.sparkSession, "ball")

    def step(batch: DataFrame, number: int) -> None:
        ball_search.ball(batch, queries, **options).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    drained(refs, step)
    return refs.sparkSession.read.schema("ordinal long, name string, seq string, distance long").parquet(f"{folder}/batch=*")


def stream_align(unaligned: DataFrame, reference: str, **options) -> DataFrame:
    """``align.align`` over a stream of records: each is aligned on its own, and a batch that is run again replaces its rows."""
    folder = shared_path(unaligned.sparkSession, "aligned")
    aligned = aligner.align(unaligned, reference, **options)
    drained(aligned, lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/batch={number}"))
    return unaligned.sparkSession.read.schema(aligned.schema).parquet(f"{folder}/batch=*")

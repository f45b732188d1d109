"""Clustering of near-identical records around medoids.

Records are dealt to queues of bounded size, by their numbers.  In a queue, each record in turn joins the first medoid
within the distance, or becomes one.  Then half of the queues take in the other half, round by round: each medoid joins
the first medoid of the other queue within the distance, or moves over.  As many rounds as lead to queues whose medoids fit a task are done
there at once.  Beyond that a round is a join of sparse records
on the pigeonhole index of their SNP sites, so that no queue has to fit a task and no sequence is shuffled.  Only pairs whose distances to the
reference differ by ``d`` at most are within reach of each other (the ring).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixscan.sources.storage import numbered, written

from . import sparse

#: Records of a queue, unless a number of queues is given.
QUEUE = 1000
#: Medoids, and their letters, whose rounds are done in one task; medoids that are compared with others at once.
TOGETHER, LETTERS, STEP = 1 << 15, 32 << 20, 1024
#: What orders medoids, all descending: distance to the reference, place of the first SNP, known sites.
SCORES = ("d_ref", "snp", "known")
MEDOID = ("medoid", "medoid_name", *sparse.COLUMNS, *SCORES)


class Queue:
    """Medoids of one queue, by the rows of its records' letters."""

    def __init__(self, letters: np.ndarray, d_ref: np.ndarray, known: np.ndarray, distance: int, ring: bool):
        self.letters, self.d_ref, self.known, self.distance, self.ring = letters, d_ref, known, distance, ring
        self.held = np.empty_like(letters)  # the medoids' letters and distances, side by side
        self.held_ref = np.empty(len(letters), np.int64)
        self.medoid: list[int] = []

    def begin(self, n: int) -> Queue:
        """The first ``n`` rows are medoids from before."""
        for i in range(n):
            self.medoid.append(i)
            self.put(i, i)
        return self

    def add(self, i: int) -> int:
        """The cluster that row ``i`` joins or begins."""
        n = len(self.medoid)
        near = np.flatnonzero(np.abs(self.held_ref[:n] - self.d_ref[i]) <= self.distance) if self.ring else np.arange(n)
        if len(near):
            d = sparse.differences(self.letters[i : i + 1], self.held[near] if len(near) < n else self.held[:n])[0]
            hit = np.flatnonzero(d <= self.distance)
            if len(hit):
                found, apart = int(near[hit[0]]), int(d[hit[0]])
                m = self.medoid[found]
                if not apart and (self.known[i], self.d_ref[i]) > (self.known[m], self.d_ref[m]):
                    self.put(found, i)
                return found
        self.medoid.append(i)
        self.put(n, i)
        return n

    def put(self, place: int, i: int) -> None:
        self.medoid[place], self.held[place], self.held_ref[place] = i, self.letters[i], self.d_ref[i]


def queue_of(ordinal: Column, queues: int | None) -> Column:
    """``queues``: how many, dealt in turn; without it, ``QUEUE`` records in a row are a queue, so that later records don't move earlier ones."""
    return (F.pmod(ordinal, F.lit(queues)) if queues else F.floor(ordinal / QUEUE)).cast("int")


def leader(records: DataFrame, reference: str, distance: int = 1, trim: int = 0, queues: int | None = None, ring: bool = True, raw: bool = False) -> DataFrame:
    """``queue, medoid, member, medoid_name, member_name, d_ref, snp, known``: each record with its medoid (ordinals), and
    the medoid as a sparse record in its own row (null in those of the others).

    ``queues``: see ``queue_of``.  A record that equals its medoid and knows more sites (then: is further from the reference) takes its place."""
    df = sparse.records(records, reference, trim, raw).withColumn("queue", queue_of(F.col("ordinal"), queues))
    base = reference.encode()[trim : len(reference) - trim]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ordinal", ignore_index=True)
        own = Queue(sparse.columns(rows, base), rows["d_ref"].to_numpy(), rows["known"].to_numpy(), distance, ring)
        of = np.array([own.add(i) for i in range(len(rows))])
        medoid = np.array(own.medoid)[of]
        chosen, alone = rows.iloc[medoid].reset_index(drop=True), medoid == np.arange(len(rows))
        return pd.DataFrame({
            "queue": key[0], "medoid": chosen["ordinal"], "member": rows["ordinal"], "medoid_name": chosen["name"], "member_name": rows["name"],
            **{c: rows[c].where(alone, None) for c in sparse.COLUMNS}, **{c: chosen[c] for c in SCORES},
        })

    return df.groupBy("queue").applyInPandas(run, "queue int, medoid long, member long, medoid_name string, member_name string, sites array<int>, letters binary, unknown array<int>, d_ref long, snp long, known long")


def first_matches(left: DataFrame, right: DataFrame, base: bytes, distance: int, ring: bool) -> DataFrame:
    """``medoid, into``: for medoids of ``right`` the first of ``left`` (by ``place``) in the same ``pair`` within the distance.

    Both: ``pair, medoid, place, d_ref`` and a sparse record."""
    sides = [df.select("pair", F.col("medoid").alias("id"), "place", "d_ref", *sparse.COLUMNS) for df in (left, right)]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        side = rows["is_left"].to_numpy()
        if side.all() or not side.any():
            return pd.DataFrame({"medoid": [], "into": [], "place": []})
        rows = rows.sort_values(["is_left", "place"], ignore_index=True)
        side = rows["is_left"].to_numpy()
        letters, d_ref = sparse.columns(rows, base), rows["d_ref"].to_numpy()
        close = sparse.differences(letters[~side], letters[side]) <= distance
        if ring:
            close &= np.abs(d_ref[~side][:, None] - d_ref[side][None]) <= distance
        some = close.any(1)
        at = close.argmax(1)[some]
        return pd.DataFrame({"medoid": rows["id"].to_numpy()[~side][some], "into": rows["id"].to_numpy()[side][at], "place": rows["place"].to_numpy()[side][at]})

    near = ["d_ref"] if ring else None
    found = sparse.units(sides[0], sides[1], distance, ["pair"], near).groupBy("unit").applyInPandas(run, "medoid long, into long, place long")
    return found.groupBy("medoid").agg(F.min_by("into", "place").alias("into"))


def folded(queue: Column, count: int, rounds: int) -> tuple[Column, int]:
    """The queue that a queue's medoids are in after so many rounds, and how many queues there are then."""
    for _ in range(rounds):
        count = -(-count // 2)
        queue = F.pmod(queue, F.lit(count))
    return queue, count


def rounds_together(medoids: DataFrame, count: int, most: int) -> int:
    """How many rounds lead to queues that come from ``most`` medoids or fewer."""
    queues = medoids.groupBy("queue").agg(F.count("*").alias("n"))
    ends = [folded(F.col("queue"), count, k)[0] for k in range(1, (count - 1).bit_length() + 1)]
    at = queues.select("n", F.posexplode(F.array(*ends)).alias("k", "end")).groupBy("k", "end").agg(F.sum("n").alias("n"))
    sizes = {r["k"]: r["n"] for r in at.groupBy("k").agg(F.max("n").alias("n")).collect()}
    return sum(sizes[k] <= most for k in range(len(ends)))  # sizes never fall


def in_tasks(medoids: DataFrame, base: bytes, distance: int, ring: bool, count: int, rounds: int) -> DataFrame:
    """``queue, was`` and ``MEDOID``: where each medoid is after the rounds; the sparse record only in the medoid's own row."""

    def first_of(a: np.ndarray, b: np.ndarray, letters: np.ndarray, d_ref: np.ndarray) -> np.ndarray:
        """For each of ``b`` the first of ``a`` within the distance, as a place in ``a``, or -1."""
        found = np.full(len(b), -1)
        for at in range(0, len(b), STEP):
            some = b[at : at + STEP]
            for begin in range(0, len(a), STEP):
                open_ = np.flatnonzero(found[at : at + STEP] < 0)
                if not len(open_):
                    break
                left = a[begin : begin + STEP]
                close = sparse.differences(letters[some[open_]], letters[left]) <= distance
                if ring:
                    close &= np.abs(d_ref[some[open_]][:, None] - d_ref[left][None]) <= distance
                hit = close.any(1)
                found[at + open_[hit]] = begin + close.argmax(1)[hit]
        return found

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        letters = sparse.columns(rows, base)
        d_ref, snp, known, name = (rows[c].to_numpy() for c in (*SCORES, "medoid"))
        queue, into, now, left = rows["queue"].to_numpy().copy(), np.arange(len(rows)), np.arange(len(rows)), count  # of clusters: queue, what each went into, and its medoid
        for _ in range(rounds):
            left = -(-left // 2)
            heads = np.flatnonzero(into == np.arange(len(rows)))
            m = now[heads]
            heads = heads[np.lexsort((name[m], -known[m], -snp[m], -d_ref[m], queue[heads]))]
            for q in np.unique(queue[heads][queue[heads] >= left]):
                a, b = heads[queue[heads] == q - left], heads[queue[heads] == q]
                at = first_of(now[a], now[b], letters, d_ref) if len(a) else np.full(len(b), -1)
                queue[b[at < 0]] = q - left
                b, at = b[at >= 0], at[at >= 0]
                into[b] = a[at]
                # Of the medoids that came in, the one that knows most sites; it takes the place of a medoid that knows fewer.
                m = now[b]
                order = np.lexsort((name[m], -d_ref[m], -known[m], at))
                best = order[np.unique(at[order], return_index=True)[1]]
                wins = known[m[best]] > known[now[a[at[best]]]]
                now[a[at[best[wins]]]] = m[best[wins]]
            head = into
            while (head != into[head]).any():
                head = into[head]
            into = head
        chosen = rows.iloc[now[into]].reset_index(drop=True)
        alone = now[into] == np.arange(len(rows))
        return pd.DataFrame({"queue": queue[into], "was": name, **{c: chosen[c] for c in ("medoid", "medoid_name", *SCORES)}, **{c: rows[c].where(alone, None).to_numpy() for c in sparse.COLUMNS}})

    kinds = {f.name: f.dataType.simpleString() for f in medoids.schema.fields}
    schema = ", ".join(["queue int", "was long", *(f"{c} {kinds[c]}" for c in ("medoid", "medoid_name", *SCORES, *sparse.COLUMNS))])
    return medoids.select("queue", *MEDOID).groupBy(folded(F.col("queue"), count, rounds)[0]).applyInPandas(run, schema)


def merged(clusters: DataFrame, reference: str, distance: int = 1, trim: int = 0, ring: bool = True) -> DataFrame:
    """One set of clusters from those of all queues: ``medoid, member, medoid_name, member_name`` and the medoid's ``SCORES``."""
    base = reference.encode()[trim : len(reference) - trim]
    members = written(clusters.select("queue", *MEDOID, "member", "member_name"), "clusters")
    medoids = members.where("medoid = member").select("queue", *MEDOID)
    joined = members.select("medoid", "member", "member_name")
    count = (medoids.agg(F.max("queue")).first()[0] or 0) + 1
    while count > 1:
        rounds = rounds_together(medoids, count, min(TOGETHER, max(1, LETTERS // max(1, len(base)))))
        if rounds:
            placed = written(in_tasks(medoids, base, distance, ring, count, rounds), "medoids")
            medoids, count = placed.where("was = medoid").select("queue", *MEDOID), folded(F.lit(0), count, rounds)[1]
            names = placed.select("was", F.col("medoid").alias("now"))
            joined = written(joined.join(names, joined["medoid"] == names["was"]).select(F.col("now").alias("medoid"), "member", "member_name"), "members")
            continue
        half = -(-count // 2)
        # Order within a queue: by the scores, then by ordinal.
        placed = numbered(medoids, "place", "queue", *map(F.desc, SCORES), "medoid")
        left = placed.where(F.col("queue") < half).withColumn("pair", F.col("queue"))
        right = placed.where(F.col("queue") >= half).withColumn("pair", F.col("queue") - half)
        into = written(first_matches(left, right, base, distance, ring), "into")
        better = right.join(into, "medoid").select("into", "medoid", *[F.col(c).alias(f"r_{c}") for c in MEDOID[1:]])
        # A medoid that came in and knows more sites takes the place of the one it joined.
        order = F.struct("r_known", "r_d_ref", -F.col("medoid"))
        best = better.groupBy("into").agg(F.max_by(F.struct("medoid", *[f"r_{c}" for c in MEDOID[1:]]), order).alias("b"))
        kept = left.join(best, left["medoid"] == best["into"], "left")
        wins = F.coalesce(F.col("b.r_known") > F.col("known"), F.lit(False))
        old = kept.select("queue", F.col("medoid").alias("was"), F.when(wins, F.col("b.medoid")).otherwise(F.col("medoid")).alias("medoid"), *[F.when(wins, F.col(f"b.r_{c}")).otherwise(F.col(c)).alias(c) for c in MEDOID[1:]])
        moved = right.join(into, "medoid", "left_anti").select(F.col("pair").alias("queue"), F.col("medoid").alias("was"), *MEDOID)
        gone = into.join(old.select(F.col("was").alias("into"), F.col("medoid").alias("now")), "into").select(F.col("medoid").alias("was"), "now")
        names = written(old.select("was", F.col("medoid").alias("now")).union(moved.select("was", F.col("medoid").alias("now"))).union(gone), "names")
        medoids = written(old.drop("was").unionByName(moved.drop("was")), "medoids")
        joined = written(joined.join(names, joined["medoid"] == names["was"]).select(F.col("now").alias("medoid"), "member", "member_name"), "members")
        count = half
    return joined.join(medoids.select("medoid", "medoid_name", *SCORES), "medoid").select("medoid", "member", "medoid_name", "member_name", *SCORES)


def cluster(records: DataFrame, reference: str, distance: int = 1, trim: int = 0, queues: int | None = None, ring: bool = True, raw: bool = False) -> DataFrame:
    return merged(leader(records, reference, distance, trim, queues, ring, raw), reference, distance, trim, ring)


def sizes(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("medoid", "medoid_name").agg(F.count("*").alias("n_members"))


def final_order(clusters: DataFrame) -> DataFrame:
    """``place`` (from 0), ``medoid``, ``medoid_name``, ``n_members``: the largest clusters first, then by the medoid's scores and ordinal."""
    medoids = clusters.groupBy("medoid", "medoid_name", *SCORES).agg(F.count("*").alias("n_members"))
    return numbered(medoids, "place", F.desc("n_members"), *map(F.desc, SCORES), "medoid").drop(*SCORES)


def medoid_alignment(clusters: DataFrame, records: DataFrame) -> DataFrame:
    """The medoids' sequences as ``ordinal, name, seq``, numbered in the final order."""
    order = final_order(clusters)
    return records.select(F.col("ordinal").alias("medoid"), "name", "seq").join(order, "medoid").select(F.col("place").alias("ordinal"), "name", "seq")


def table(clusters: DataFrame, per_line: int = 1000) -> DataFrame:
    """``place, n_members, medoid, part, line``: text lines of a medoid's name and members' names.

    A line holds about ``per_line`` names; a large cluster has several lines, so that none has to hold it whole.
    Sorted by ``place`` and ``part`` they are the cluster table."""
    n = final_order(clusters).select("medoid", "n_members", "place")
    parts = F.pmod(F.xxhash64("member"), F.ceil(F.col("n_members") / per_line)).alias("part")
    rows = clusters.join(n, "medoid").select("place", "medoid", "n_members", "medoid_name", "member", "member_name", parts)
    names = F.transform(F.array_sort(F.collect_list(F.when(F.col("member") != F.col("medoid"), F.struct("member", "member_name")))), lambda x: x["member_name"])
    lines = rows.groupBy("place", "medoid", "n_members", "medoid_name", "part").agg(names.alias("names"))
    return lines.select("place", "n_members", "medoid", F.col("part").cast("long").alias("part"), F.concat_ws(",", "medoid_name", "names").alias("line"))

"""N-gram Jaccard join by MinHash banding.

Documents are sets of hashed word 5-grams.  Rows and bands are chosen for a target recall; documents
meet on equal band hashes, and pairs that meet are verified on their full sets.

* Documents with the same words are one class; only one of each class is compared.
* Buckets with the same members, in whatever band, are one group, so that its pairs are verified once.
  A pair that shares several groups belongs to the one with the smallest id.
* A group of more than ``BLOCK`` members or ``BLOCK_BYTES`` of text is cut into blocks; pairs of blocks are the units of
  work, which hold at most about two blocks.  The larger a group, the larger its blocks, up to ``LARGEST`` members.
* A unit gives a row for each linked member: its links, and one link to a representative.  The
  representatives make a forest, from which rounds of joins find the clusters.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from .common import as_bytes, documents, joined_by_key, restored, set_aside, slices, written

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.9999
BLOCK, LARGEST, BLOCK_BYTES = 512, 2048, 8 << 20
BLANK = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_g = np.random.default_rng(20250101)
BYTE = _g.integers(1, 2**63, 256, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
PLACE = _g.integers(1, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def banding(threshold: float = THRESHOLD, recall: float = RECALL, most: int = 96) -> tuple[int, int]:
    """(bands, rows): the most rows a band for which at most ``most`` hashes reach the recall at the threshold;
    ``ValueError`` if so many cannot."""
    if not (0 < threshold < 1 and 0 < recall < 1):
        raise ValueError(f"threshold {threshold} and recall {recall} must lie between 0 and 1")
    best = None
    for rows in range(1, most + 1):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows))))
        if bands * rows <= most:
            best = (bands, rows)
    if best is None:
        raise ValueError(f"{most} hashes do not reach a recall of {recall} at {threshold}")
    return best


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[bytes], n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of words, and the text that each is from.  A text of fewer words is one n-gram."""
    data = np.frombuffer(b" ".join([b"", *texts, b""]).lower(), np.uint8)
    blank = BLANK[data]
    starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    if not len(starts):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    # Sum of byte values by powers of BASE that begin anew at each word.
    lengths = ends - starts
    inside = np.flatnonzero(~blank)
    offset = np.arange(len(inside)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    power = np.cumprod(np.full(int(lengths.max()), BASE, np.uint64))
    word = mixed(np.add.reduceat(BYTE[data[inside]] * power[offset], np.cumsum(lengths) - lengths))
    edges = np.cumsum([0, *(len(t) + 1 for t in texts)])
    owner = np.searchsorted(edges, starts - 1, "right") - 1
    grams, owners = [], []
    if len(word) >= n:
        whole = owner[: len(word) - n + 1] == owner[n - 1 :]
        h = sum((word[k : len(word) - n + 1 + k] * PLACE[k] for k in range(1, n)), word[: len(word) - n + 1] * PLACE[0])
        grams.append(h[whole])
        owners.append(owner[: len(whole)][whole])
    count = np.bincount(owner, minlength=len(texts))
    few = (count > 0) & (count < n)
    if few.any():
        first = np.searchsorted(owner, np.flatnonzero(few))
        for i, a in zip(np.flatnonzero(few), first, strict=True):
            grams.append((word[a : a + count[i]] * PLACE[: count[i]]).sum(dtype=np.uint64, keepdims=True) + np.uint64(count[i]))
            owners.append(np.array([i]))
    h, o = np.concatenate(grams), np.concatenate(owners)
    order = np.argsort(o, kind="stable")
    return mixed(h[order]), o[order]


def band_hashes(h: np.ndarray, owner: np.ndarray, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts that have n-grams, and the band hashes of each (texts x bands)."""
    starts = np.flatnonzero(np.diff(owner, prepend=-1))
    g = np.random.default_rng(41)
    factor = g.integers(1, 2**63, (bands, rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shift = g.integers(0, 2**63, (bands, rows), dtype=np.uint64)
    out = np.empty((len(starts), bands), np.uint64)
    for b in range(bands):
        total = np.full(len(starts), b, np.uint64)
        for r in range(rows):
            least = np.minimum.reduceat((h * factor[b, r] + shift[b, r]) >> np.uint64(20), starts)
            total = mixed(total * BASE + least)
        out[:, b] = total
    return owner[starts], out


def signatures(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """Adds ``_key`` (equal for the same words; null without words) and ``_bands`` to the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                texts = as_bytes(batch.column("text"))
                keys = [hashlib.blake2b(b" ".join(w), digest_size=16).digest() if (w := t.lower().split()) else None for t in texts]
                found: list = [None] * len(texts)
                h, owner = shingles(texts)
                if len(h):
                    for i, row in zip(*band_hashes(h, owner, bands, rows), strict=True):
                        found[i] = row.view(np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary()), pa.array(found, pa.list_(pa.int64()))], names=[*batch.schema.names, "_key", "_bands"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("_key", BinaryType()), StructField("_bands", ArrayType(LongType()))]))


def linked(texts: list[bytes], allowed: np.ndarray, threshold: float) -> np.ndarray:
    """Which allowed pairs of texts reach the threshold, on their full n-gram sets (symmetric)."""
    h, owner = shingles(texts)
    m = len(texts)
    values, column = np.unique(h, return_inverse=True)
    pairs = np.unique(owner * len(values) + column)
    owner, column = pairs // len(values), pairs % len(values)
    size = np.bincount(owner, minlength=m)
    shared = np.flatnonzero(np.bincount(column, minlength=len(values)) > 1)
    place = np.full(len(values), -1)
    place[shared] = np.arange(len(shared))
    owner, column = owner[place[column] >= 0], place[column[place[column] >= 0]]
    both = np.zeros((m, m), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for at in range(0, len(shared), 4096):
        a, b = np.searchsorted(column, [at, at + 4096])
        dense = np.zeros((m, min(4096, len(shared) - at)), np.float32)
        dense[owner[a:b], column[a:b] - at] = 1
        both += dense @ dense.T
    union = size[:, None] + size[None] - both
    out = allowed & (both >= threshold * union - 1e-6) & (both > 0)
    np.fill_diagonal(out, False)
    return out


def units(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of one unit at a time from batches sorted by unit."""
    held: list[dict] = []
    key = None
    for batch in batches:
        for row in batch.to_pylist():
            if (now := (row["gid"], row["lo"], row["hi"])) != key:
                if held:
                    yield held
                held, key = [], now
            held.append(row)
    if held:
        yield held


def verified(members: DataFrame, threshold: float) -> DataFrame:
    """``members``: ``gid, lo, hi, block, node, n, gids, text``.  Gives ``node, texts, rows, root`` for
    linked members of a unit: linked texts, their documents, and the least node linked in the unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in units(batches):
            m, gid, lo, hi = len(rows), rows[0]["gid"], rows[0]["lo"], rows[0]["hi"]
            block = np.array([r["block"] for r in rows])
            allowed = np.ones((m, m), bool) if lo == hi else block[:, None] != block[None]
            elsewhere: dict[int, list[int]] = {}
            for i, r in enumerate(rows):
                for g in r["gids"]:
                    if g < gid:
                        elsewhere.setdefault(g, []).append(i)
            for own in elsewhere.values():  # pairs that belong to another group
                if len(own) > 1:
                    allowed[np.ix_(own, own)] = False
            np.fill_diagonal(allowed, False)
            if not allowed.any():
                continue
            links = linked([r["text"] for r in rows], allowed, threshold)
            node, n = np.array([r["node"] for r in rows]), np.array([r["n"] for r in rows])
            root = node.copy()
            while True:
                least = np.minimum(root, np.where(links, root[None], np.iinfo(np.int64).max).min(1))
                if (least == root).all():
                    break
                root = least
            some = links.any(1)
            if some.any():
                yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(links.sum(1)[some].astype(np.int64)), pa.array((links @ n)[some].astype(np.int64)), pa.array(root[some])], names=["node", "texts", "rows", "root"])

    # Whole units meet in a partition by the hash of their key, in order.
    dealt = members.repartition("gid", "lo", "hi").sortWithinPartitions("gid", "lo", "hi")
    return dealt.mapInArrow(run, "node long, texts long, rows long, root long")


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` (the least node of its component) for undirected edges ``u, v``.

    Rounds of large-star and small-star, each written, until the edges stay as they are."""
    now = written(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    while True:
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v").cast("decimal(38,0)"))).first()
        if state == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label"))
        mark = state
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("rows"))
        large = joined_by_key(both, least, ["u"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        now = written(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u != v").distinct(), "edges")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Joins documents (``doc_id, text`` and any other columns) whose sets of word 5-grams have a
    Jaccard similarity of ``threshold`` or more.  One row per row of ``docs``, with its columns and

    * ``class_id``: the least ``doc_id`` with the same words (ASCII case and white space aside),
    * ``cluster_id``: the least ``doc_id`` that links lead to,
    * ``n_links``: linked documents, those of the own class included; ``n_text_links``: linked classes,
    * ``stays``: true for one row of each cluster.

    Texts that are null or have no word link to nothing and stay.  Repeated rows are copies of each
    other; of rows with the least ``doc_id`` of a cluster, or without any id, one stays.  Columns named like the new ones are replaced; an empty table gives an empty table."""
    bands, rows = banding(threshold, recall)
    new = ("class_id", "cluster_id", "n_links", "n_text_links", "stays")
    table = written(signatures(set_aside(docs, "doc_id", "text"), bands, rows).withColumn("_row", F.monotonically_increasing_id()), "signatures")
    worded = table.where("_key is not null")
    lead = F.min(F.struct("doc_id", "_row"))
    classes = worded.groupBy("_key").agg(lead.alias("lead"), F.count("*").alias("n"), F.min("_row").alias("node"), F.any_value("_bands").alias("bands"), F.max(F.octet_length("text")).cast("long").alias("size"))
    classes = written(classes, "classes")

    banded = classes.select("node", "size", F.posexplode("bands").alias("band", "h"))
    buckets = banded.groupBy("band", "h").agg(F.count("*").alias("m"), F.sum("size").alias("bytes"), F.min("node").alias("a"), F.max("node").alias("z"), F.bit_xor(F.xxhash64("node")).alias("x")).where("m > 1")
    buckets = buckets.select("band", "h", F.col("m").alias("rows"), "m", "bytes", F.xxhash64("m", "a", "z", "x").alias("gid"))
    groups = written(joined_by_key(banded.select("node", "band", "h"), buckets, ["band", "h"]).select("node", "gid", "m", "bytes").distinct(), "groups")
    own = groups.groupBy("node").agg(F.collect_set("gid").alias("gids"))  # at most one for each band
    compared = own.join(classes.select("node", "n"), "node").join(table.select(F.col("_row").alias("node"), F.col("text").cast("binary").alias("text")), "node")
    members = F.least(F.lit(LARGEST), F.greatest(F.lit(BLOCK), F.ceil(F.col("m") / 64)))
    blocks = F.greatest(F.ceil(F.col("m") / members), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    placed = groups.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node", "gid"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("gid", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "node")
    found = written(verified(placed.join(compared, "node"), threshold), "links")

    links = found.groupBy("node").agg(F.sum("rows").alias("rows"), F.sum("texts").alias("texts"))
    label = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    named = classes.select("_key", "node", "n", "lead").join(links, "node", "left").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = written(named, "labels")
    first = named.groupBy("label").agg(F.min("lead").alias("first"), F.count("*").alias("rows"))
    named = joined_by_key(named, first, ["label"]).select(
        "_key", F.col("n").alias("rows"),
        F.col("lead.doc_id").alias("class_id"), F.col("first.doc_id").alias("cluster_id"), F.col("first._row").alias("_first"),
        (F.coalesce("rows", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"), F.coalesce("texts", F.lit(0)).cast("long").alias("n_text_links"),
    )
    kept = [c for c in table.columns if c not in ("_key", "_bands", "_row")]
    out = joined_by_key(worded, named, ["_key"]).select(*kept, "class_id", "cluster_id", "n_links", "n_text_links", (F.col("_row") == F.col("_first")).alias("stays"))
    alone = table.where("_key is null").select(*kept, F.col("doc_id").alias("class_id"), F.col("doc_id").alias("cluster_id"), F.lit(0).cast("long").alias("n_links"), F.lit(0).cast("long").alias("n_text_links"), F.lit(True).alias("stays"))
    return restored(out.union(alone), docs.columns, *new)


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir).select("doc_id", "text")).drop("text", "stays")


def oracle() -> str:
    """The same in SQL, from all common n-grams."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""WITH RECURSIVE split AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{lower}'), '[ \\t-\\r]+'), lambda w: w <> '') AS w FROM documents),
classes AS (SELECT array_to_string(w, ' ') AS k, min(doc_id) AS c, count(*) AS n, any_value(w) AS w FROM split WHERE len(w) > 0 GROUP BY array_to_string(w, ' ')),
grams AS (SELECT c, unnest(list_distinct(CASE WHEN len(w) < {WORDS} THEN [k] ELSE list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(list_slice(w, i, i + {WORDS - 1}), ' ')) END)) AS g FROM classes),
sizes AS (SELECT c, count(*) AS s FROM grams GROUP BY c),
both_have AS (SELECT x.c AS a, y.c AS b, count(*) AS i FROM grams x JOIN grams y ON x.g = y.g WHERE x.c <> y.c GROUP BY x.c, y.c),
links AS (SELECT a, b, n FROM both_have JOIN sizes p ON p.c = a JOIN sizes q ON q.c = b JOIN classes ON classes.c = b WHERE i >= {THRESHOLD} * (p.s + q.s - i) - 1e-6),
reach AS (SELECT c AS a, c AS b FROM classes UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
clusters AS (SELECT a, min(b) AS cluster_id FROM reach GROUP BY a),
counts AS (SELECT a, CAST(sum(n) AS BIGINT) AS docs, count(*) AS texts FROM links GROUP BY a)
SELECT doc_id, coalesce(classes.c, doc_id) AS class_id, coalesce(cluster_id, doc_id) AS cluster_id, CAST(coalesce(docs, 0) + coalesce(n, 1) - 1 AS BIGINT) AS n_links, CAST(coalesce(texts, 0) AS BIGINT) AS n_text_links
FROM split LEFT JOIN classes ON len(split.w) > 0 AND classes.k = array_to_string(split.w, ' ') LEFT JOIN clusters ON clusters.a = classes.c LEFT JOIN counts ON counts.a = classes.c"""

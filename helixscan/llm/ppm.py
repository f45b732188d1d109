"""Language-model scoring by prediction by partial matching.

The model is a trie of byte contexts of up to ``ORDER`` bytes.  A context predicts a byte by its
counts; with the escape probability t / (n + t) (t different bytes in n) it hands over to the context
one byte shorter, where the bytes that it knows itself are excluded; below the empty context all
bytes left are alike.  Counts are taken over the whole training part and all contexts are kept.

All contexts of up to two bytes and the ``HOT_CONTEXTS`` most frequent of each longer length are in the
tasks' trie.  For these the probabilities of all 256 bytes are worked out once, so that scoring a text is
walking the trie for every byte, which numpy does for all bytes of a batch at once.  The others stay in tables;
bytes whose longest context the trie can't tell are counted for each text and joined with them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, documents, joined_by_key, slices, written

ORDER = 4
#: Contexts of 3 and of 4 bytes that all tasks get: so many of the most frequent of each.
HOT_CONTEXTS = 16_384
#: Stands before a text and at its end; it does not occur in UTF-8.
EDGE = 255
#: Words whose counts all tasks get: so many of the most frequent, of at most so many bytes.
HOT_WORDS, HOT_BYTES = 60_000, 64
#: Byte strings counted in a task before they are handed on.
HELD = 1 << 21


def edged(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts between edges, the places of the bytes to code (an edge after each text), and where each text's begin."""
    edge = bytes([EDGE])
    data = np.frombuffer(b"".join(edge * ORDER + t + edge for t in texts), np.uint8)
    lengths = np.array([len(t) + 1 for t in texts])
    first = np.cumsum(lengths) - lengths
    places = np.arange(int(lengths.sum())) + np.repeat(ORDER * np.arange(1, len(texts) + 1), lengths)
    return data, places, first


def context_counts(docs: DataFrame) -> DataFrame:
    """``gram, n``: every byte with the ``ORDER`` bytes before it (as one number), counted over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, counts, held = [], [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            g, inverse = np.unique(np.concatenate(grams), return_inverse=True)
            return g, np.bincount(inverse, weights=np.concatenate(counts)).astype(np.int64)

        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                data, places, _ = edged(as_bytes(batch.column("text")))
                code = np.zeros(len(places), np.int64)
                for k in range(ORDER, -1, -1):
                    code = code << 8 | data[places - k]
                g, n = np.unique(code, return_counts=True)
                grams.append(g)
                counts.append(n)
                held += len(g)
                if held > HELD:
                    g, n = merged()
                    grams, counts, held = [g], [n], len(g)
                    if held > HELD // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(n)], names=["gram", "n"])
                        grams, counts, held = [], [], 0
        if grams:
            g, n = merged()
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(n)], names=["gram", "n"])

    return docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


@dataclass
class Trie:
    """Nodes by length of context, shortest first: log10 of all bytes' probabilities for each node, the node of
    each two bytes, the children of nodes (by the byte further back; -1: none), and the nodes that have
    more children than those in the trie."""

    logs: np.ndarray
    pair: np.ndarray
    child: np.ndarray
    partial: np.ndarray

    def score(self, texts: list[bytes], chunk: int = 1 << 19) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """log10 probability of each text and its end, without the bytes whose longest context may be
        outside the trie; those as text, gram and how often, by text."""
        data, places, first = edged(texts)
        out, outside = np.empty(len(places)), [np.zeros((2, 0), np.int64)]
        for at in range(0, len(places), chunk):
            p = places[at : at + chunk]
            node = self.pair[data[p - 2].astype(np.int64) << 8 | data[p - 1]]
            for back in range(3, ORDER + 1):
                further = self.child[node, data[p - back]]
                node = np.where(further >= 0, further, node) if back == 3 else np.where((further >= 0) & deeper, further, node)
                deeper = further >= 0 if back == 3 else deeper & (further >= 0)
            partial = self.partial[node]
            out[at : at + chunk] = np.where(partial, 0, self.logs[node, data[p]])
            if partial.any():
                p = p[partial]
                code = np.searchsorted(first, at + np.flatnonzero(partial), "right") - 1
                for back in range(ORDER, -1, -1):
                    code = code << 8 | data[p - back]
                outside.append(np.stack(np.unique(code, return_counts=True)))
        code, times = np.concatenate(outside, 1)
        bits = 8 * (ORDER + 1)
        return np.add.reduceat(out, first) if len(first) else np.empty(0), code >> bits, code & ((1 << bits) - 1), times


def level(grams: DataFrame, k: int) -> DataFrame:
    """``c, s, n``: context, byte and count for the contexts of length ``k``."""
    mask = (1 << 8 * k) - 1
    return grams.select(F.shiftright("gram", 8).bitwiseAND(F.lit(mask)).alias("c"), F.col("gram").bitwiseAND(F.lit(255)).cast("short").alias("s"), "n").groupBy("c", "s").agg(F.sum("n").alias("n"))


def most_frequent(rows: DataFrame, most: int) -> DataFrame:
    return F.broadcast(rows.groupBy("c").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "c").limit(most).select("c"))


def fetched(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    table = rows.select("c", "s", "n").toArrow()
    c, s, n = (table.column(x).to_numpy() for x in ("c", "s", "n"))
    return c.astype(np.int64), s.astype(np.int64), n.astype(np.float64)


def suffix_of(k: int) -> Column:
    """The context one byte shorter than ``c`` of ``k`` bytes."""
    return F.col("c").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1))


def blended(counts: list[np.ndarray]) -> np.ndarray:
    """Probabilities of all bytes for rows of counts in the longest context, the next shorter one and so on."""
    known = np.zeros(counts[0].shape, bool)
    left, p = np.ones(len(known)), np.zeros(known.shape)
    for held in counts:
        c = np.where(known, 0, held).astype(np.float64)
        seen = c > 0
        known |= seen
        n, t = c.sum(1), seen.sum(1).astype(np.float64)
        t[known.all(1)] = 0  # nothing to escape to
        total = np.where(n + t > 0, n + t, 1)
        p += c * (left / total)[:, None]
        left = np.where(n > 0, left * t / total, left)
    rest = (~known).sum(1)
    return p + np.where(known, 0, (left / np.maximum(rest, 1))[:, None])


def distributions(counts: list[np.ndarray], suffix: list[np.ndarray], k: int, chunk: int = 2048) -> np.ndarray:
    """log10 probabilities of all bytes for the contexts of length ``k``; ``suffix[j]``: places at length j - 1."""
    out = np.empty(counts[k].shape, np.float32)
    for at in range(0, len(out), chunk):
        place, held = np.arange(at, min(len(out), at + chunk)), []
        for j in range(k, -1, -1):
            held.append(counts[j][place])
            if j:
                place = suffix[j][place]
        out[at : at + chunk] = np.log10(np.maximum(blended(held), 1e-300))
    return out


def build(levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]], partial: list[np.ndarray]) -> Trie:
    """``partial``: the contexts of each length that have longer ones outside ``levels``."""
    names, counts, suffix = [], [], [np.zeros(0, np.int64)]
    for k, (c, s, n) in enumerate(levels):
        own = np.unique(c) if k else np.zeros(1, np.int64)
        if k:  # a context is reached through the shorter one
            shorter = own & ((1 << 8 * (k - 1)) - 1)
            place = np.searchsorted(names[k - 1], shorter)
            kept = (place < len(names[k - 1])) & (names[k - 1][np.minimum(place, len(names[k - 1]) - 1)] == shorter)
            own, place = own[kept], place[kept]
            suffix.append(place)
        table = np.zeros((len(own), 256), np.float32)
        at = np.searchsorted(own, c)
        inside = (at < len(own)) & (own[np.minimum(at, max(len(own) - 1, 0))] == c) if len(own) else np.zeros(len(c), bool)
        np.add.at(table, (at[inside], s[inside]), n[inside])
        names.append(own)
        counts.append(table)
    base = np.cumsum([0, *map(len, names)])
    logs = np.concatenate([distributions(counts, suffix, k) for k in range(len(levels))])
    child = np.full((int(base[ORDER]), 256), -1, np.int32)
    for k in range(1, len(levels)):
        child[base[k - 1] + suffix[k], names[k] >> 8 * (k - 1)] = base[k] + np.arange(len(names[k]))
    one = np.where(child[0] >= 0, child[0], 0)
    two = child[one][:, :]  # last byte x the byte before it
    two = np.where((two >= 0) & (child[0] >= 0)[:, None], two, one[:, None])
    # Scoring goes on from contexts of two bytes only.
    child[: base[2]] = -1
    more = np.concatenate([np.isin(own, c) for own, c in zip(names, partial, strict=True)])
    return Trie(logs, np.ascontiguousarray(two.T.reshape(-1)).astype(np.int32), child, more)


@dataclass
class Model:
    """The tasks' trie, its counts, and the tables ``c, s, n`` of the contexts of 3 and of 4 bytes outside it."""

    trie: Trie
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    rest: dict[int, DataFrame]


def train(docs: DataFrame) -> Model:
    """At most 256**k contexts for k up to 2 and ``HOT_CONTEXTS`` for a longer k come to the driver."""
    spark = docs.sparkSession
    grams = written(context_counts(docs), "grams")
    levels, rest, hot = [fetched(level(grams, k)) for k in range(3)], {}, None
    partial = [np.zeros(0, np.int64) for _ in range(ORDER + 1)]
    for k in range(3, ORDER + 1):
        rows = written(level(grams, k), f"contexts{k}")
        # A context is reached through the shorter one.
        inside = rows if hot is None else rows.join(hot, suffix_of(k) == hot["shorter"], "left_semi")
        levels.append(fetched(inside.join(most_frequent(inside, HOT_CONTEXTS), "c")))
        names = pa.table({"shorter": np.unique(levels[k][0])})
        within, hot = hot, F.broadcast(spark.createDataFrame(names))
        rest[k] = rows.join(hot, rows["c"] == hot["shorter"], "left_anti")
        cut = rest[k].select(suffix_of(k).alias("c")).distinct()
        cut = cut if within is None else cut.join(within, cut["c"] == within["shorter"], "left_semi")
        partial[k - 1] = cut.toArrow().column("c").to_numpy().astype(np.int64)
    return Model(build(levels, partial), levels, rest)


def gram_logs(grams: DataFrame, model: Model) -> DataFrame:
    """``gram, log``: log10 of the probability of each different ``gram``'s byte after its context, by all contexts."""
    asked = grams.select("gram").distinct().groupBy(F.shiftright("gram", 8).alias("c")).agg(F.collect_list(F.col("gram").bitwiseAND(F.lit(255)).cast("short")).alias("asked"))
    for k in (4, 3):
        counts = model.rest[k].groupBy(F.col("c").alias(f"c{k}")).agg(F.collect_list(F.struct("s", "n")).alias(f"d{k}"))
        asked = asked.join(counts, F.col("c").bitwiseAND(F.lit((1 << 8 * k) - 1)) == F.col(f"c{k}"), "left").drop(f"c{k}")
    shared = grams.sparkSession.sparkContext.broadcast(model.levels[:ORDER])

    def spread(lists: pa.Array) -> np.ndarray:
        """A row of 256 counts for each list."""
        out = np.zeros((len(lists), 256))
        owner = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        s, n = lists.flatten().flatten()
        out[owner, s.to_numpy()] = n.to_numpy()
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for whole in batches:
            if not held:
                for c, s, n in shared.value:
                    own, place = np.unique(c, return_inverse=True)
                    table = np.zeros((len(own) + 1, 256), np.float32)  # the last row is for all other contexts
                    table[place, s] = n
                    held.append((np.append(own, -1), table))
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                c = batch.column("c").to_numpy()
                counts = [spread(batch.column("d4"))]
                for k in range(ORDER - 1, -1, -1):
                    own, table = held[k]
                    suffix = c & ((1 << 8 * k) - 1)
                    place = np.searchsorted(own[:-1], suffix)
                    counts.append(table[np.where(own[place] == suffix, place, len(own) - 1)])
                    if k == 3:
                        counts[-1] = counts[-1] + spread(batch.column("d3"))
                logs = np.log10(np.maximum(blended(counts), 1e-300))
                row = np.repeat(np.arange(len(c)), pc.list_value_length(batch.column("asked")).to_numpy(zero_copy_only=False))
                s = batch.column("asked").flatten().to_numpy().astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(c[row] << 8 | s), pa.array(logs[row, s])], names=["gram", "log"])

    return asked.mapInArrow(run, "gram long, log double")


def word_counts(docs: DataFrame, most: int = 300_000) -> DataFrame:
    """``word, c`` over all texts; the empty word counts the ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], names=["word", "c"])

        for whole in batches:
            for batch in slices(whole, "text"):
                for t in as_bytes(batch.column("text")):
                    held.update(t.lower().split())
                    held[b""] += 1
                if len(held) > most:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return docs.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def scored(docs: DataFrame, trie: Trie, hot: dict[bytes, int]) -> DataFrame:
    """Per document what a task can tell: ``score``, ``n_tokens``, and over its words in ``hot`` the known
    ones and the sum of log10(c + 1); the others as ``rare``.  ``outside``: the grams that ``score`` lacks."""
    context = docs.sparkSession.sparkContext
    shared, frequent = context.broadcast(trie), context.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        logs = {w: (np.log10(c + 1), c > 0) for w, c in frequent.value.items()}
        item = pa.struct([("word", pa.binary()), ("k", pa.int32())])
        pair = pa.struct([("gram", pa.int64()), ("k", pa.int32())])
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                texts = as_bytes(batch.column("text"))
                tokens, known, total, word, times, ends = [], [], [], [], [], [0]
                for t in texts:
                    words = t.lower().split()
                    count = Counter(words)
                    count[b""] = 1
                    s, k = 0.0, 0
                    for w, n in count.items():
                        if (found := logs.get(w)) is None:
                            word.append(w)
                            times.append(n)
                        else:
                            s += n * found[0]
                            k += n * found[1]
                    tokens.append(len(words) + 1)
                    known.append(k)
                    total.append(s)
                    ends.append(len(word))
                rare = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(word, pa.binary()), pa.array(times, pa.int32())], fields=list(item)))
                score, owner, gram, often = model.score(texts)
                place = np.searchsorted(owner, np.arange(len(texts) + 1))
                outside = pa.ListArray.from_arrays(pa.array(place, pa.int32()), pa.StructArray.from_arrays([pa.array(gram, pa.int64()), pa.array(often, pa.int32())], fields=list(pair)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(total, pa.float64()), rare, outside],
                    names=["doc_id", "held_out", "score", "n_tokens", "known", "total", "rare", "outside"],
                )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "held_out", "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, n_tokens long, known long, total double, rare array<struct<word:binary,k:int>>, outside array<struct<gram:long,k:int>>")


def language_model_scores(docs: DataFrame, held_out: Column) -> DataFrame:
    """Scores every whole text of ``docs`` (``doc_id, text``) with a model of the rows where not ``held_out``.

    Output per row: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.
    ``score`` is the log10 probability of the bytes of the text and its end; ``base_score`` that of
    its lower-cased words and its end, counted one by one.  A null text counts as empty (its end
    alone is scored); repeated rows repeat; other columns are ignored; an empty table gives an empty
    table, and without training rows every byte has the same probability.  Of words that are equally frequent the first by their bytes are resolved in the tasks.  A task holds
    about 40 bytes for each byte of the text that it is at."""
    docs = docs.select("doc_id", "text", held_out.alias("held_out"))
    training = docs.where("not held_out")
    words = written(word_counts(training), "words")
    total = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    top = words.where(F.octet_length("word") <= HOT_BYTES).orderBy(F.desc("c"), "word").limit(HOT_WORDS).collect()
    hot = {bytes(r["word"]): r["c"] for r in top}
    least = top[-1]["c"] if len(top) == HOT_WORDS else 0
    model = train(training)
    table = written(scored(docs, model.trie, hot).withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = table.select("row", F.explode("rare").alias("x")).select("row", "x.word", "x.k")
    # A word outside the frequent ones counts at most as often as the last of them, unless it is long; a long one may be in any number of texts.
    long = F.octet_length("word") > HOT_BYTES
    known = joined_by_key(rare.where(long), words.where(long).withColumn("rows", F.col("c")), ["word"]).select("row", "k", "c")
    if least:
        known = known.union(rare.where(~long).join(words.where(~long & (F.col("c") <= least)), "word").select("row", "k", "c"))
    found = known.select("row", "k", (F.col("k") * F.log10(F.col("c") + 1)).alias("t"), F.lit(0.0).alias("l"))
    outside = table.select("row", F.explode("outside").alias("x")).select("row", "x.gram", "x.k")
    resolved = outside.join(gram_logs(outside, model), "gram").select("row", F.lit(0).alias("k"), F.lit(0.0).alias("t"), (F.col("k") * F.col("log")).alias("l"))
    found = found.union(resolved).groupBy("row").agg(F.sum("k").alias("rare_known"), F.sum("t").alias("rare_total"), F.sum("l").alias("rest"))
    base = F.col("total") + F.coalesce("rare_total", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(total["n"] + total["v"] + 1).cast("double"))
    return table.drop("rare", "outside").join(found, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(total["n"]).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("score") + F.coalesce("rest", F.lit(0.0))).alias("score")
    )


def op1_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(True))
    return language_model_scores(documents(spark, sf_dir), held_out)

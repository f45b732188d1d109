"""Language identification by a byte convolutional network in numpy.

Bytes are embedded, filters of several widths slide over windows of fixed length, each filter keeps
its maximum, and a softmax layer names the language.  The network is trained on a bounded sample of
labelled rows.  To apply it, the products of embedding and filter are tabulated for pairs of bytes,
so that a filter's value at a position is one or two look-ups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import as_texts, documents, restored, set_aside, slices

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS, EMBED = 16, 12
#: Bounds of the training sample of each label: rows, and pieces of a row, of so many characters each.
ROWS_EACH, PARTS, CHARS = 1200, 3, 512
#: Steps of a hash as a number between 0 and 1.
FINE = 1 << 53
#: Steps of training, enough for so many languages; with more languages they grow in proportion.
STEPS, STEPS_FOR = 900, 64


class ByteConvNet:
    def __init__(self, labels: list[str], seed: int = 7):
        g = np.random.default_rng(seed)
        self.labels = labels
        self.embed = g.normal(0, 0.3, (256, EMBED)).astype(np.float32)
        self.filters = {w: g.normal(0, 0.3, (w, EMBED, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.dense = g.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(labels))).astype(np.float32)
        self.offset = np.zeros(len(labels), np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, *self.filters.values(), self.bias, self.dense, self.offset]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross entropy over windows ``x`` (n x WINDOW bytes) with labels ``y``."""
        n, peaks, where = len(x), [], []
        for w, f in self.filters.items():
            tables = self.embed @ f  # w x 256 x FILTERS
            m = x.shape[1] - w + 1
            value = sum(tables[k][x[:, k : k + m]] for k in range(w))
            where.append(value.argmax(1))
            peaks.append(value.max(1))
        pooled = np.concatenate(peaks, 1) + self.bias
        hidden = np.maximum(pooled, 0)
        d = softmax(hidden @ self.dense + self.offset)
        d[np.arange(n), y] -= 1
        d /= n
        back = (d @ self.dense.T) * (pooled > 0)
        d_embed, d_filters = np.zeros_like(self.embed), []
        number = np.broadcast_to(np.arange(FILTERS), (n, FILTERS))
        for i, (w, f) in enumerate(self.filters.items()):
            own, d_filter = back[:, i * FILTERS : (i + 1) * FILTERS], np.zeros_like(f)
            for k in range(w):
                table = np.zeros((256, FILTERS), np.float32)
                np.add.at(table, (np.take_along_axis(x, where[i] + k, 1), number), own)
                d_filter[k] = self.embed.T @ table
                d_embed += table @ f[k].T
            d_filters.append(d_filter)
        return [d_embed, *d_filters, back.sum(0), hidden.T @ d, d.sum(0)]

    def train(self, texts: list[bytes], y: np.ndarray, steps: int = STEPS, batch: int = 64, rate: float = 0.01, seed: int = 11) -> ByteConvNet:
        """Adam over windows cut from ``texts`` at random, a third of them shorter than a window."""
        g = np.random.default_rng(seed)
        by_label = [np.flatnonzero(y == k) for k in range(len(self.labels))]
        state = [(np.zeros_like(p), np.zeros_like(p)) for p in self.parameters()]
        for step in range(1, steps + 1):
            pick = np.array([g.choice(by_label[k]) for k in g.integers(len(self.labels), size=batch)])
            x = np.zeros((batch, WINDOW), np.uint8)
            for row, i in enumerate(pick):
                length = int(g.integers(12, WINDOW)) if row % 3 == 0 else WINDOW
                start = int(g.integers(0, max(1, len(texts[i]) - length)))
                part = texts[i][start : start + length]
                x[row, : len(part)] = np.frombuffer(part, np.uint8)
            lr = rate * min(1, 2 * (1 - step / (steps + 1)))
            for p, (m, v), d in zip(self.parameters(), state, self.gradients(x, y[pick]), strict=True):
                m += 0.1 * (d - m)
                v += 0.01 * (d * d - v)
                p -= lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        return self

    def tables(self) -> Tables:
        return Tables(self)


class Tables:
    """The trained network as look-up tables."""

    def __init__(self, net: ByteConvNet):
        self.labels, self.bias, self.dense, self.offset = net.labels, net.bias, net.dense, net.offset
        self.looks = []
        for w, f in net.filters.items():
            single = net.embed @ f
            looks = [(k, True, (single[k][:, None] + single[k + 1][None]).reshape(1 << 16, FILTERS)) for k in range(0, w - 1, 2)]
            if w % 2:
                looks.append((w - 1, False, single[w - 1]))
            self.looks.append((w, looks))

    def probabilities(self, windows: np.ndarray, block: int = 64) -> np.ndarray:
        """Of each label for each window (n x WINDOW bytes)."""
        out = np.empty((len(windows), len(self.labels)), np.float32)
        for at in range(0, len(windows), block):
            x = np.ascontiguousarray(windows[at : at + block].T).astype(np.int32)
            two = (x[:-1] << 8) | x[1:]
            pooled = []
            for w, looks in self.looks:
                m = len(x) - w + 1
                value = None
                for k, double, table in looks:
                    found = table.take((two if double else x)[k : k + m], 0)
                    value = found if value is None else np.add(value, found, out=value)
                pooled.append(value.max(0))
            hidden = np.maximum(np.concatenate(pooled, 1) + self.bias, 0)
            out[at : at + block] = softmax(hidden @ self.dense + self.offset)
        return out


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all texts, the text of each, and how many of its bytes are text."""
    count = np.array([-(-len(t) // WINDOW) for t in texts])
    joined = b"".join(t.ljust(int(n) * WINDOW, b"\0") for t, n in zip(texts, count, strict=True))
    owner = np.repeat(np.arange(len(texts)), count)
    held = np.full(len(owner), WINDOW)
    last = np.cumsum(count) - 1
    for i, t in enumerate(texts):
        if t:
            held[last[i]] = len(t) - (count[i] - 1) * WINDOW
    return np.frombuffer(joined, np.uint8).reshape(-1, WINDOW), owner, held


def training_rows(docs: DataFrame) -> list[tuple[str, str]]:
    """A sample: of every label ``ROWS_EACH`` rows (all if there are no more), those with the least hashes of id and text,
    and of each row ``PARTS`` pieces of ``CHARS`` characters that begin at hashed places of the whole text."""
    labelled = docs.where("text is not null and lang is not null and text rlike '\\\\p{L}'")
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(FINE)) / FINE
    # First what is likely among the least: twice as many as asked for and some more, of any number of rows.
    likely = labelled.join(F.broadcast(labelled.groupBy("lang").count()), "lang").withColumn("_place", place).where(F.col("_place") * F.col("count") < 2 * ROWS_EACH + 50)
    chosen = likely.withColumn("_rank", F.row_number().over(Window.partitionBy("lang").orderBy("_place", "doc_id"))).where(F.col("_rank") <= ROWS_EACH)
    begin = lambda k: 1 + F.pmod(F.xxhash64("doc_id", F.lit(k)), F.greatest(F.lit(1), F.length("text") - CHARS + 1))
    parts = F.array(*[F.substring("text", begin(k).cast("int"), F.lit(CHARS)) for k in range(PARTS)])
    rows = chosen.select("lang", F.explode(F.array_distinct(parts)).alias("text")).collect()
    return sorted((r["lang"], r["text"]) for r in rows)


def train(rows: list[tuple[str, str]]) -> Tables | None:
    """None if there is nothing to learn from."""
    if not rows:
        return None
    labels = sorted({lang for lang, _ in rows})
    number = {lang: i for i, lang in enumerate(labels)}
    steps = STEPS * max(1, -(-len(labels) // STEPS_FOR))
    return ByteConvNet(labels).train([t.encode().lower() for _, t in rows], np.array([number[lang] for lang, _ in rows]), steps=steps).tables()


def predicted(docs: DataFrame, model: Tables | None, text: str = "text") -> DataFrame:
    """Adds ``lang_pred`` and ``score`` (the mean probability over all windows of the whole text,
    by length) to the rows.  A text that is null or has no letter, and every text where no labelled
    row was given, is ``und`` with score 0; of labels equally likely the first by name counts.  Repeated rows repeat; an empty table gives an empty table;
    columns named like the new ones are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    df = set_aside(docs, text)
    df = df.withColumnRenamed(text, "_text")
    schema = StructType([*df.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for batch in slices(whole, "_text"):
                texts = as_texts(batch.column("_text"))
                known = [i for i, t in enumerate(texts) if m is not None and any(map(str.isalpha, t))]
                pred, score = ["und"] * len(texts), [0.0] * len(texts)
                if known:
                    windows, owner, held = windows_of([texts[i].encode().lower() for i in known])
                    p = m.probabilities(windows) * held[:, None]
                    first = np.flatnonzero(np.diff(owner, prepend=-1))
                    mean = np.add.reduceat(p, first, 0) / np.add.reduceat(held, first)[:, None]
                    for i, k, v in zip(known, mean.argmax(1), mean.max(1), strict=True):
                        pred[i], score[i] = m.labels[k], min(1.0, float(v))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return restored(df.mapInArrow(run, schema).withColumnRenamed("_text", text), docs.columns, "lang_pred", "score")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))
    docs = documents(spark, sf_dir).select("doc_id", held_out.alias("held_out"), "text", "lang")
    model = train(training_rows(docs.where(~F.col("held_out"))))
    return predicted(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")

"""What a chain of filters removes in every order, from potentials over its coalitions.

Each document gets a bit for each filter that it fails.  For a coalition S of filters, v(S) is the number of documents that fail one of
them.  The potential of the removal game is P(empty) = 0, P(S) = (v(S) + sum of P(S without i)) / |S|, and the Shapley value of filter i is P(all)
minus P(all without i).  A step of an order removes v(first k) - v(first k-1).  So a part of the corpus needs no more than its counts by
failed filters, 32 rows, and the corpus is read once.

Potentials are kept 120 times as large: in this scale all of them are integers, and the Shapley value is the sum over the 120 orders.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, documents, slices, written

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: Parameters of the filters: words; percent of distinct words; percent of capital letters; symbols.
WORDS, DISTINCT, CAPITALS, SYMBOLS = 100, 80, 10, b"#$%&*|"
UPPER, CONTINUING = bytes(range(65, 91)), bytes(range(128, 192))
#: Bytes of a text that are cut into words at once.
PART = 4 << 20
_SYMBOL = re.compile(b"[" + re.escape(SYMBOLS) + b"]")


def word_counts(text: bytes) -> tuple[int, int]:
    """Words and distinct words; a long text is cut in parts that end at white space, so that the words themselves are held once."""
    if len(text) <= PART:
        words = text.split()
        return len(words), len(set(words))
    seen: set[bytes] = set()
    n = start = 0
    while start < len(text):
        end = min(len(text), start + PART)
        while end < len(text) and text[end] not in b" \t\n\v\f\r":
            end += 1
        words = text[start:end].split()
        n += len(words)
        seen.update(words)
        start = end
    return n, len(seen)


def failed(text: bytes) -> int:
    """Filters A to D that the text fails, as bits 1, 2, 4, 8."""
    n, distinct = word_counts(text)
    capitals, points = len(text) - len(text.translate(None, UPPER)), len(text) - (len(text) - len(text.translate(None, CONTINUING)))
    return (n < WORDS) | (100 * distinct < DISTINCT * n) << 1 | (100 * capitals > CAPITALS * points) << 2 | (_SYMBOL.search(text) is not None) << 3


def judged(docs: DataFrame) -> DataFrame:
    """``doc_id, part, digest, fails, n``: how many rows have the same of all these; ``digest`` is the text's SHA-256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                bits = pa.array([failed(t) for t in as_bytes(batch.column("text"))], pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), batch.column("digest"), bits], names=["doc_id", "part", "digest", "fails"])

    text = F.coalesce("text", F.lit(""))
    own = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))
    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(run, f"doc_id {kind}, part string, digest binary, fails int").groupBy("doc_id", "part", "digest", "fails").agg(F.count("*").alias("n"))


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds ``good`` and ``toxic`` (0 or 1): whether some label of the document says so."""
    said = labels.where("quality = 1 OR toxic = 1").groupBy("doc_id").agg(*[F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias(k) for c, k in (("quality", "good"), ("toxic", "toxic"))])
    return rows.join(said, "doc_id", "left").withColumns({k: F.coalesce(k, F.lit(0)) for k in ("good", "toxic")})


def coalition_counts(rows: DataFrame) -> DataFrame:
    """``part, fails`` (five bits), and how many rows, good ones and toxic ones have them.

    The first row of a text is found by a minimum for each digest, worked out in the tasks before the shuffle, and looked up
    by digest and ``doc_id`` together: a text that a third of all rows share makes no hot key."""
    first = rows.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    marked = rows.join(first, ["digest", "doc_id"], "left").withColumn("fails", F.col("fails") + F.when(copy, 16).otherwise(0))
    return marked.groupBy("part", "fails").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def removed(counts: np.ndarray) -> np.ndarray:
    """v(S) for all coalitions from the counts by failed filters: all rows but those that fail filters outside S only."""
    inside = np.array([[m & s == 0 for m in range(32)] for s in range(32)])
    return counts.sum(0) - inside.astype(np.int64) @ counts


def potentials(v: np.ndarray) -> list[int]:
    """120 times the potential of each coalition."""
    out = [0] * 32
    for s in range(1, 32):  # parts of a coalition have smaller numbers
        inside = [i for i in range(5) if s >> i & 1]
        out[s] = (120 * int(v[s]) + sum(out[s ^ 1 << i] for i in inside)) // len(inside)
    return out


def steps(part: str, counts: np.ndarray) -> pd.DataFrame:
    """The 600 rows of a part; ``counts``: rows, good and toxic ones by failed filters (32 x 3)."""
    v = removed(counts)
    potential = potentials(v[:, 0])
    shapley = [potential[31] - potential[31 ^ 1 << i] for i in range(5)]
    total, out = int(counts[:, 0].sum()), []
    for order in ORDERS:
        before = 0
        for k, letter in enumerate(order):
            i = FILTERS.index(letter)
            after = before | 1 << i
            gone, good, toxic = (int(x) for x in v[after] - v[before])
            out.append((part, order, k + 1, total - int(v[after, 0]), gone, int(v[1 << i, 0]) - gone, int(v[31, 0] - v[31 ^ 1 << i, 0]), good, toxic, shapley[i]))
            before = after
    return pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])


SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Kept, removed and lost documents of every part, order of the five filters and step.

    ``docs``: ``doc_id, text, lang``; ``labels``: ``doc_id, quality, toxic``; other columns are ignored, whatever their names.  A null text is empty, a null
    ``lang`` the part of the empty string.  Whole texts count, however long.  Rows repeat: all of equal ``doc_id`` and text are alike, and
    none of them is a copy of the others; a row without ``doc_id`` is neither a copy nor an original, and has no label.  A document with
    several labels is good (toxic) if one says so.  An empty table gives an empty table."""
    docs = docs.select("doc_id", "text", "lang")
    rows = written(judged(docs), "judged")
    counts = coalition_counts(with_labels(rows, labels.select("doc_id", "quality", "toxic")))

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:  # 32 rows at most
        table = np.zeros((32, 3), np.int64)
        table[group["fails"].to_numpy()] = group[["n", "good", "toxic"]].to_numpy()
        return steps(key[0], table)

    return counts.groupBy("part").applyInPandas(run, SCHEMA)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def oracle() -> str:
    """The same by orders: every document goes through the filters one by one."""
    orders = ", ".join(f"('{o}')" for o in ORDERS)
    words = "list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t-\\r]+'), lambda w: w <> '')"
    hit = lambda letter: f"CASE {letter} " + " ".join(f"WHEN '{x}' THEN {x.lower()}" for x in FILTERS) + " END"
    return f"""WITH texts AS (SELECT doc_id, coalesce(text, '') AS x, coalesce(lang, '') AS part, {words} AS w FROM documents),
firsts AS (SELECT x, min(doc_id) AS least FROM texts GROUP BY x),
said AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
docs AS (SELECT part, len(w) < {WORDS} AS a, 100 * len(list_distinct(w)) < {DISTINCT} * len(w) AS b, 100 * length(regexp_replace(t.x, '[^A-Z]', '', 'g')) > {CAPITALS} * length(t.x) AS c,
 regexp_matches(t.x, '[#$%&*|]') AS d, coalesce(t.doc_id > f.least, false) AS e, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM texts t JOIN firsts f ON f.x = t.x LEFT JOIN said s ON s.doc_id = t.doc_id),
alike AS (SELECT part, a, b, c, d, e, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM docs GROUP BY ALL),
steps AS (SELECT filter_order, step, substr(filter_order, 1, step - 1) AS before, substr(filter_order, step, 1) AS own FROM (VALUES {orders}) o(filter_order), (SELECT CAST(range AS INTEGER) AS step FROM range(1, 6)) k),
went AS (SELECT part, filter_order, step, own, n, good, toxic, {hit("own")} AS fails, {" OR ".join(f"({x.lower()} AND contains(before, '{x}'))" for x in FILTERS)} AS gone, CAST(a AS INT) + CAST(b AS INT) + CAST(c AS INT) + CAST(d AS INT) + CAST(e AS INT) AS failed FROM alike, steps),
counted AS (SELECT part, filter_order, step, own, sum(CASE WHEN NOT gone AND NOT fails THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND fails THEN n ELSE 0 END) AS removed, sum(CASE WHEN gone AND fails THEN n ELSE 0 END) AS redundant,
 sum(CASE WHEN fails AND failed = 1 THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN NOT gone AND fails THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND fails THEN toxic ELSE 0 END) AS toxic_lost FROM went GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, {", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))}, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM counted"""

"""Best-fit packing of token pieces into sequences by exact complements.

Lengths are at most ``capacity``, so the counts of all lengths are a table of at most ``capacity``
rows whatever the size of the corpus.  ``plan`` packs that table: for the gap of a batch of open
sequences it looks up one length, a pair or a triple that fills the gap exactly and consumes it as
often as the counts allow; where there is none, it places the largest piece that fits.  A plan row
says which pieces of a length (by rank) go to which sequences, so the plan is bounded too: every
pattern uses up some length, and a sequence holds at most 63 different lengths out of 2048.  The
pieces themselves stay distributed: their rank within a length is counted in salted groups.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_texts, documents, slices, written
from .tokens import PartTable, load_tokenizer

CAPACITY = 2048
#: Pieces of one length in one salted group, about.
GROUP = 20_000

_open: dict[str, PartTable] = {}


def word_table(path: str) -> PartTable:
    """The tokenizer at ``path`` drops white space, so that the parts between spaces encode alone."""
    if path not in _open:
        _open[path] = PartTable(load_tokenizer(path, special_as_text=False), lower=True)
    return _open[path]


def words(text: str) -> list[str]:
    return text.replace("\n", " ").split(" ")


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Pieces of every document: ``doc_id, piece, start, length, ids_crc32``."""
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_table(tokenizer_path)
        for whole in batches:
            for batch in slices(whole, "text"):
                rows, piece, start, length, crc = [], [], [], [], []
                for i, ids in enumerate(table.ids([table.parts(t, words) for t in as_texts(batch.column("text"))])):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        rows.append(i)
                        piece.append(k)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class Stock:
    """How many pieces of each length are left, with the lengths in stock as a bit mask."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = [0] * (capacity + 1)
        self.mask = self.mirror = 0  # bit x; bit capacity - x
        for length, n in counts.items():
            self.add(length, n)

    def add(self, length: int, n: int) -> None:
        self.left[length] += n
        here, there = 1 << length, 1 << (self.capacity - length)
        if self.left[length]:
            self.mask |= here
            self.mirror |= there
        else:
            self.mask &= ~here
            self.mirror &= ~there

    def largest(self, most: int) -> int:
        """The largest length in stock of at most ``most``; 0 if there is none."""
        return (self.mask & ((1 << (most + 1)) - 1)).bit_length() - 1 if most > 0 and self.mask & ((1 << (most + 1)) - 1) else 0

    def pair(self, total: int, most: int) -> tuple[int, int] | None:
        """Two lengths in stock that add up to ``total``, the larger one first and at most ``most``."""
        if total < 2:
            return None
        both = self.mask & (self.mirror >> (self.capacity - total)) & ((1 << (min(total, most) + 1)) - 1)
        while both:
            x = both.bit_length() - 1
            if 2 * x < total:
                return None
            if 2 * x > total or self.left[x] >= 2:
                return x, total - x
            both ^= 1 << x
        return None

    def exact(self, gap: int) -> tuple[int, ...] | None:
        if self.left[gap]:
            return (gap,)
        if found := self.pair(gap, gap):
            return found
        x = self.largest(gap - 2)
        while 3 * x >= gap:
            if (found := self.pair(gap - x, x)) and all(self.left[y] >= n for y, n in Counter((x, *found)).items()):
                return (x, *found)
            x = self.largest(x - 1)
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Counter, int]]:
    """Patterns (lengths in a sequence) and how many sequences have each."""
    stock, out = Stock(counts, capacity), []
    while first := stock.largest(capacity):
        n = max(1, stock.left[first] // (capacity // first))
        stock.add(first, -n)
        batches = [(capacity - first, Counter([first]), n)]
        while batches:
            gap, held, n = batches.pop()
            if gap and (found := stock.exact(gap)):
                need = Counter(found)
                k = min(n, *(stock.left[x] // m for x, m in need.items()))
                for x, m in need.items():
                    stock.add(x, -k * m)
                out.append((held + need, k))
                if k < n:
                    batches.append((gap, held, n - k))
            elif gap and (x := stock.largest(gap)):
                k = min(n, stock.left[x])
                stock.add(x, -k)
                if k < n:
                    batches.append((gap, held, n - k))
                batches.append((gap - x, held + Counter([x]), k))
            else:
                out.append((held, n))
    return out


def placements(patterns: list[tuple[Counter, int]]) -> dict[str, np.ndarray]:
    """Plan rows by length and first rank: pieces from ``rank`` on, ``per`` in each sequence from
    ``sequence`` on, the first of them at ``offset``."""
    used: Counter = Counter()
    rows, sequence = [], 0
    for held, n in patterns:
        at = 0
        for length in sorted(held, reverse=True):
            rows.append((length, used[length], sequence, held[length], at))
            used[length] += n * held[length]
            at += length * held[length]
        sequence += n
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "sequence", "per", "offset"), table.T, strict=True))


def packed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces (``doc_id, piece, start, length, ids_crc32``)."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    rows = placements(plan(counts, capacity))
    salts = 1 + max(counts.values(), default=0) // GROUP
    keyed = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    # Ranks before a group: at most `capacity` lengths by `salts` groups.
    before = keyed.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = before.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = keyed.withColumn("own", F.row_number().over(own) - 1).join(before, ["length", "salt"]).withColumn("rank", F.col("own") + F.col("before"))
    shared = pieces.sparkSession.sparkContext.broadcast(rows)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        keys = p["length"] * (1 << 50) + p["rank"]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            i = np.searchsorted(keys, length * (1 << 50) + rank, "right") - 1
            k = rank - p["rank"][i]
            sequence, offset = p["sequence"][i] + k // p["per"][i], p["offset"][i] + k % p["per"][i] * length
            kept = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    types = dict(pieces.dtypes)
    return ranked.select(*columns, "rank").mapInArrow(place, ", ".join(f"{c} {types[c]}" for c in columns) + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    Output per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.  A null or
    empty text is one piece with the end token alone; repeated rows are packed as often as they
    occur; other columns are ignored; an empty table gives an empty table.
    """
    return packed(written(token_pieces(docs, tokenizer_path, capacity), "pieces"), capacity)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))

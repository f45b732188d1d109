"""Packing by Karmarkar-Karp multiway differencing.

A document's ids are cut at every full sequence; what is left of it, its tail, is packed with the tails of a block of documents.
A partial partition is a list of windows in descending order of their sums; at first each tail is one of its own, with one window
that holds it and others that are empty.  The two partial partitions with the largest imbalance (largest sum less smallest) are merged
so that opposing imbalances meet: the largest window of one with the smallest of the other.  The one that is left has
near-equal windows.  If one of them exceeds the capacity, the number of windows rises, and the block is differenced again.

Cuts are free, so nothing need be padded: as many of the emptiest windows as the block can do without are cut into the gaps of the others,
and the tokens that are left over make sequences whose lengths are powers of two.

A block is a run of rows of one partition, of bounded tokens.  Packing needs no shuffle, and a lost task's blocks are the same again.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import insort
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import documents, slices
from .packing import CAPACITY
from .tokens import ColumnTable, load_tokenizer

#: Tails of a block; parts of texts whose ids a worker remembers (about 200 bytes each).
BLOCK, PARTS = 1024, 1_400_000
#: A window: its sum and the numbers of its items.
Window = tuple[int, tuple]


def merged(a: list[Window], b: list[Window], k: int) -> list[Window]:
    """Windows of both partial partitions (in descending order, empty ones left out), the largest of one with the smallest of the other."""
    if len(b) > len(a):
        a, b = b, a
    if len(b) == 1 and len(a) < k:
        out = list(a)
        insort(out, b[0], key=lambda w: -w[0])
        return out
    over = len(a) + len(b) - k  # windows that get something of both
    if over <= 0:
        out = a + b
    else:
        both = [(x[0] + y[0], (x[1], y[1])) for x, y in zip(a[len(a) - over :], reversed(b[len(b) - over :]), strict=True)]
        out = a[: len(a) - over] + both + b[: len(b) - over]
    return sorted(out, key=itemgetter(0), reverse=True)


def differenced(sizes: list[int], k: int) -> list[Window]:
    """``sizes`` in ``k`` windows with near-equal sums."""
    heap = [(-n if k > 1 else 0, i, [(n, (i,))]) for i, n in enumerate(sizes)]
    heapq.heapify(heap)
    count = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        both = merged(a, b, k)
        count += 1
        heapq.heappush(heap, (both[-1][0] * (len(both) == k) - both[0][0], count, both))
    return heap[0][2] if heap else []


def items_of(held: tuple) -> list[int]:
    """The numbers in nested pairs, without recursion."""
    out, stack = [], [held]
    while stack:
        x = stack.pop()
        if isinstance(x, tuple):
            stack.extend(reversed(x))
        else:
            out.append(x)
    return out


def windows(sizes: list[int], capacity: int) -> list[tuple[int, list[int]]]:
    """Near-equal windows of at most ``capacity``.  Their number rises by a hundredth, one at least, until none exceeds it."""
    total = sum(sizes)
    k = -(-total // capacity)
    while True:
        found = differenced(sizes, k)
        excess = sum(max(0, n - capacity) for n, _ in found)
        if not excess:
            return [(n, items_of(held)) for n, held in found]
        k += max(1, k // 100, excess // capacity)


def filled(sizes: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (item, start in it, length): those of ``windows``, the emptiest cut into the gaps of the others."""
    found = windows(sizes, capacity)
    full = sum(sizes) // capacity
    out = [[(i, 0, sizes[i]) for i in items] for _, items in found[:full]]
    spare = [(i, 0, sizes[i]) for _, items in found[full:] for i in items]
    spare.reverse()
    for sequence, (n, _) in zip(out, found[:full], strict=True):
        move(spare, sequence, capacity - n)
    left = sum(n for _, _, n in spare)
    for bit in reversed(range(left.bit_length())):
        if left >> bit & 1:
            out.append([])
            move(spare, out[-1], 1 << bit)
    return out


def move(spare: list[tuple[int, int, int]], into: list[tuple[int, int, int]], n: int) -> None:
    """The last ``n`` tokens' worth of ``spare``, cut where need be."""
    while n:
        item, start, length = spare.pop()
        take = min(n, length)
        into.append((item, start, take))
        if take < length:
            spare.append((item, start + take, length - take))
        n -= take


_open: dict[str, ColumnTable] = {}


def byte_table_of(path: str) -> ColumnTable:
    """One per Python worker."""
    if path not in _open:
        _open[path] = ColumnTable(load_tokenizer(path, special_as_text=False), keep=PARTS)
    return _open[path]


class Packer:
    """Rows of pieces, and the tails of the block that is open."""

    def __init__(self, capacity: int, first: int):
        self.capacity, self.next = capacity, first
        self.tails: list[tuple] = []  # document, its tokens, where the tail begins, its ids
        self.rows: list[tuple] = []

    def add(self, doc, ids: bytes) -> None:
        n = len(ids) // 4
        for start in range(0, n - self.capacity + 1, self.capacity):
            self.rows.append((doc, start, self.capacity, zlib.crc32(ids[4 * start : 4 * (start + self.capacity)]), n, self.next, 0))
            self.next += 1
        if n % self.capacity:
            start = n - n % self.capacity
            self.tails.append((doc, n, start, ids[4 * start :]))
            if len(self.tails) == BLOCK:
                self.close()

    def close(self) -> None:
        for sequence in filled([len(t[3]) // 4 for t in self.tails], self.capacity):
            at = 0
            for i, start, length in sequence:
                doc, n, before, ids = self.tails[i]
                self.rows.append((doc, before + start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n, self.next, at))
                at += length
            self.next += 1
        self.tails = []


COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
#: Sequences of a partition have numbers of their own.
NUMBERS = 1 << 40


def pack_by_differencing(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """Packs all documents (``doc_id, text``) into sequences of at most ``capacity`` tokens; none of them needs padding.

    Output per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.  Every sequence has ``capacity`` tokens but for those that end a
    block, whose lengths are powers of two.  A null or empty text is its end token alone.  A very long text is encoded piece by piece; its ids, 4
    bytes each, are held once.  Repeated rows are packed as often as they occur; of equal tails the earlier row's is placed first.  Other columns are
    ignored; an empty table gives an empty table."""
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, packer = byte_table_of(tokenizer_path), Packer(capacity, TaskContext.get().partitionId() * NUMBERS)
        kind = None

        def given(least: int) -> Iterator[pa.RecordBatch]:
            if len(packer.rows) >= least:
                first, *others = zip(*packer.rows, strict=True)
                packer.rows = []
                yield pa.RecordBatch.from_arrays([pa.array(first, kind), *(pa.array(x, pa.int64()) for x in others)], names=list(COLUMNS))

        for whole in batches:
            kind = whole.schema.field("doc_id").type
            for batch in slices(whole, "text", 16 << 20):
                for doc, ids in zip(batch.column("doc_id").to_pylist(), table.column(batch.column("text")), strict=True):
                    packer.add(doc, ids + end)
                    yield from given(10_000)
        packer.close()
        yield from given(1)

    doc = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {doc}, " + ", ".join(f"{c} long" for c in COLUMNS[1:]))


def op13_differencing_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_by_differencing(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))

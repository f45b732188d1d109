"""Projection of unaligned sequences onto a reference by global gap-affine alignment.

A mismatch costs 4, a gap of k letters 6 + 2 k.  A wavefront holds, for one cost and each diagonal (place in the sequence less place in the
reference), the furthest place that paths of this cost reach; matches are free and are taken as far as they go.  So a
record costs time by its length and by the square of its least cost, not by a band over all rows.  Wavefronts of many records are vectors
side by side.  What is kept of a wavefront is a byte for each diagonal: where its best path came from.  The path is read from
them backwards, and its matches are found again going forwards.

Records that would keep too many bytes are aligned alone: every ``STRIDE`` costs the wavefronts themselves are kept, and the bytes in between are worked out again
from there on the way back, so that memory grows with the root of the work.

Where paths of a diagonal reach as far, a pair is preferred to a deletion, and that to an insertion.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixscan.functions import cigar
from helixscan.functions.cigar import EXTEND, MISMATCH, OPEN

from . import filters

#: All costs are even: steps of two.  How many steps back the wavefronts are that a new one is made of.
UNIT = 2
BACK_X, BACK_OPEN, BACK_GAP = MISMATCH // UNIT, (OPEN + EXTEND) // UNIT, EXTEND // UNIT
NONE = -(1 << 29)
#: Records side by side; bytes of moves that they may keep; costs between wavefronts that are kept for a record on its own.
SIDE_BY_SIDE, KEPT, STRIDE = 64, 32 << 20, 256
#: Letters that are compared at once, at first and at most.
WINDOW, WIDEST = 16, 1024
#: Bits of a move: where the best path came from; that a deletion, or an insertion, goes on.
PAIR, DELETION, INSERTION, LONGER_D, LONGER_I = 0, 1, 2, 4, 8


class Wavefronts:
    """The last few wavefronts of some records, by diagonal from ``-reach`` to ``reach``; places are those in the sequence."""

    def __init__(self, ref: np.ndarray, seqs: list[np.ndarray], adaptive: int | None = None):
        self.n, self.sizes, self.adaptive = len(ref), np.array([len(s) for s in seqs], np.int32), adaptive
        self.ref = np.concatenate([ref, np.full(WIDEST, 254, np.uint8)])
        self.letters = np.full((len(seqs), int(self.sizes.max(initial=0)) + WIDEST), 255, np.uint8)
        for k, s in enumerate(seqs):
            self.letters[k, : len(s)] = s
        self.rows = np.arange(len(seqs))
        self.step, self.reach = 0, 0
        first = np.zeros((len(seqs), 1), np.int32)
        self.extend(first)
        self.m, self.i, self.d = [first], [np.full_like(first, NONE)], [np.full_like(first, NONE)]  # the newest last

    def state(self) -> tuple:
        return self.step, self.reach, list(self.m), list(self.i), list(self.d)

    def back_to(self, state: tuple) -> None:
        self.step, self.reach, self.m, self.i, self.d = state[0], state[1], list(state[2]), list(state[3]), list(state[4])

    def extend(self, m: np.ndarray) -> None:
        """Matches from all places of ``m`` on, in place."""
        b, k = np.nonzero(m >= 0)
        j = m[b, k].astype(np.int64)
        i = j - (k - self.reach)
        own, window = self.rows[b], 1
        while len(b):
            at = np.arange(window)
            same = self.letters[own[:, None], j[:, None] + at] == self.ref[i[:, None] + at]
            ran = np.where(same.all(1), window, same.argmin(1))
            m[b, k] += ran.astype(np.int32)
            on = ran == window
            b, k, own, j, i = b[on], k[on], own[on], j[on] + window, i[on] + window
            window = WINDOW if window == 1 else min(WIDEST, 4 * window)

    def older(self, kept: list[np.ndarray], back: int, reach: int) -> np.ndarray:
        """The wavefront ``back`` steps ago over diagonals from ``-reach`` to ``reach``."""
        out = np.full((len(self.rows), 2 * reach + 1), NONE, np.int32)
        if back <= len(kept):
            x = kept[-back]
            side = reach - x.shape[1] // 2
            if side >= 0:
                out[:, side : side + x.shape[1]] = x
        return out

    def advance(self) -> np.ndarray:
        """The next wavefront; returns its moves, a byte for each diagonal."""
        self.step += 1
        reach = self.reach = max(0, min(self.step - BACK_OPEN + 1, max(self.n, int(self.sizes.max(initial=0)))))
        diagonal = np.arange(-reach, reach + 1, dtype=np.int32)
        opened, i, d = self.older(self.m, BACK_OPEN, reach), self.older(self.i, BACK_GAP, reach), self.older(self.d, BACK_GAP, reach)
        pair = self.older(self.m, BACK_X, reach) + 1
        longer_i, longer_d = i > opened, d > opened
        gap_i, gap_d = np.maximum(i, opened) + 1, np.maximum(d, opened)
        none = np.full((len(self.rows), 1), NONE, np.int32)
        gap_i, longer_i = np.hstack([none, gap_i[:, :-1]]), np.hstack([none > 0, longer_i[:, :-1]])
        gap_d, longer_d = np.hstack([gap_d[:, 1:], none]), np.hstack([longer_d[:, 1:], none > 0])
        size = self.sizes[self.rows][:, None]
        for x in (pair, gap_i, gap_d):
            x[(x > size) | (x - diagonal > self.n) | (x < 0)] = NONE
        best = np.maximum(np.maximum(pair, gap_d), gap_i)
        moves = np.where(best == pair, PAIR, np.where(best == gap_d, DELETION, INSERTION)).astype(np.uint8)
        moves |= longer_d.astype(np.uint8) * LONGER_D | longer_i.astype(np.uint8) * LONGER_I
        self.extend(best)
        if self.adaptive is not None:
            left = np.where(best < 0, 1 << 29, np.maximum(self.n - (best - diagonal), size - best))
            for x in (best, gap_i, gap_d):
                x[left > left.min(1, keepdims=True) + self.adaptive] = NONE
        for kept, new in ((self.m, best), (self.i, gap_i), (self.d, gap_d)):
            kept.append(new)
            del kept[:-BACK_OPEN]
        return moves

    def done(self) -> np.ndarray:
        """Which records have been aligned whole."""
        size = self.sizes[self.rows]
        at = size - self.n + self.reach
        inside = (at >= 0) & (at <= 2 * self.reach)
        return inside & (self.m[-1][np.arange(len(self.rows)), np.clip(at, 0, 2 * self.reach)] == size)

    def keep(self, which: np.ndarray) -> None:
        self.rows = self.rows[which]
        for kept in (self.m, self.i, self.d):
            kept[:] = [x[which] for x in kept]


def walked(step: int, diagonal: int, kind: int, moves_of) -> Iterator[tuple[int, int, int, str]]:
    """The path backwards from a step's diagonal: ``step, diagonal, kind`` after each operation, and the operation.

    ``kind``: whether a pair, a deletion or an insertion is looked for; ``moves_of(step)``: moves and their reach.  Lower-case operations begin a gap."""
    while step > 0:
        moves, reach = moves_of(step)
        if moves is None:
            return
        move = int(moves[diagonal + reach])
        if kind == PAIR:
            kind = move & 3
            if kind == PAIR:
                step -= BACK_X
                yield step, diagonal, kind, "X"
                continue
        longer, letter = (LONGER_D, "D") if kind == DELETION else (LONGER_I, "I")
        diagonal += 1 if kind == DELETION else -1
        step, kind, letter = (step - BACK_GAP, kind, letter) if move & longer else (step - BACK_OPEN, PAIR, letter.lower())
        yield step, diagonal, kind, letter


def matches(ref: np.ndarray, seq: np.ndarray, i: int, j: int) -> int:
    """How many letters from places i and j on are equal."""
    at, most, window = 0, min(len(ref) - i, len(seq) - j), 64
    while at < most:
        end = min(most, at + window)
        differ = ref[i + at : i + end] != seq[j + at : j + end]
        if differ.any():
            return at + int(differ.argmax())
        at, window = end, 4 * window
    return at


def run_lengths(ref: np.ndarray, seq: np.ndarray, operations: str) -> str:
    """The CIGAR of operations in order, which leave out matches."""
    runs: list[list] = []

    def add(n: int, op: str) -> None:
        if n and runs and runs[-1][1] == op:
            runs[-1][0] += n
        elif n:
            runs.append([n, op])

    i = j = 0
    for k, op in enumerate(["M", *operations]):
        if op != "M":
            add(1, op.upper())
            i, j = i + (op in "XDd"), j + (op in "XIi")
        if op in "MX" or k == len(operations) or operations[k] not in "DI":  # in a gap that goes on nothing matches
            n = matches(ref, seq, i, j)
            add(n, "M")
            i, j = i + n, j + n
    return "".join(f"{n}{op}" for n, op in runs)


def side_by_side(ref: np.ndarray, seqs: list[np.ndarray], kept: int, adaptive: int | None) -> list[str | None]:
    """CIGARs of records whose moves fit into ``kept`` bytes together."""
    waves = Wavefronts(ref, seqs, adaptive)
    out: list[str | None] = [None] * len(seqs)
    moves: list[tuple[np.ndarray, np.ndarray, int]] = []  # of each step: rows, moves, reach
    held = 0
    while True:
        done = waves.done()
        for row in waves.rows[done]:

            def moves_of(step: int, row=row) -> tuple[np.ndarray, int]:
                rows, table, reach = moves[step - 1]
                return table[np.searchsorted(rows, row)], reach

            path = [op for *_, op in walked(waves.step, len(seqs[row]) - len(ref), PAIR, moves_of)]
            out[row] = run_lengths(ref, seqs[row], "".join(reversed(path)))
        if done.any():
            waves.keep(~done)
        if not len(waves.rows) or held > kept:
            return out
        new = waves.advance()
        moves.append((waves.rows, new, waves.reach))
        held += new.size


def alone(ref: np.ndarray, seq: np.ndarray, adaptive: int | None) -> str:
    """The CIGAR of one record, from wavefronts that are kept every ``STRIDE`` steps."""
    waves = Wavefronts(ref, [seq], adaptive)
    states, moves = [waves.state()], {}
    while not waves.done()[0]:
        if waves.step and waves.step % STRIDE == 0:
            states.append(waves.state())
            moves = {}
        new = waves.advance()
        moves[waves.step] = new[0], waves.reach
    step, diagonal, kind, path = waves.step, len(seq) - len(ref), PAIR, []
    while step > 0:
        state = states.pop() if states else None
        if not moves:
            waves.back_to(state)
            while waves.step < state[0] + STRIDE and waves.step < step:
                new = waves.advance()
                moves[waves.step] = new[0], waves.reach
        for step, diagonal, kind, op in walked(step, diagonal, kind, lambda s: moves.get(s, (None, 0))):  # noqa: B023, B020
            path.append(op)
        moves = {}
    return run_lengths(ref, seq, "".join(reversed(path)))


def cigars(ref: str, seqs: list[str], adaptive: int | None = None, kept: int = KEPT) -> list[str]:
    """The CIGAR of a least-cost alignment of each sequence.  ``adaptive``: leave out diagonals that lie so many letters behind the best one; the
    cost may then be above the least."""
    r = np.frombuffer(ref.encode(), np.uint8)
    codes = [np.frombuffer(s.encode(), np.uint8) for s in seqs]
    order = sorted(range(len(codes)), key=lambda k: abs(len(codes[k]) - len(r)))
    out: list = [None] * len(seqs)
    for at in range(0, len(order), SIDE_BY_SIDE):
        part = order[at : at + SIDE_BY_SIDE]
        for k, found in zip(part, side_by_side(r, [codes[k] for k in part], kept, adaptive), strict=True):
            out[k] = alone(r, codes[k], adaptive) if found is None else found
    return out


def align(unaligned: DataFrame, reference: str | Column, ambiguity: float = 0.5, adaptive: int | None = None) -> DataFrame:
    """``ordinal, name, seq`` (as long as the reference) with ``cost``, ``identity`` (matches per operation) and ``cigar`` for every
    record that fits.  ``reference``: one sequence, or a column with each record's."""
    if isinstance(reference, str):  # sent to the tasks once, not with every record
        df = unaligned.where(filters.unaligned_is_clear(F.col("seq"), len(reference), ambiguity))

        @F.pandas_udf("string")
        def run_one(seqs: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in seqs:
                yield pd.Series(cigars(reference, list(s), adaptive), dtype=object)

        df = df.withColumn("cigar", run_one("seq"))
    else:
        df = unaligned.withColumn("_ref", reference)
        df = df.where(filters.unaligned_is_clear(F.col("seq"), F.length("_ref"), ambiguity))

        @F.pandas_udf("string")
        def run(seqs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for s, r in seqs:
                rows: list = [None] * len(s)
                for ref, group in s.groupby(r):  # all records of one reference together
                    for k, found in zip(group.index, cigars(ref, list(group), adaptive), strict=True):
                        rows[k] = found
                yield pd.Series(rows, dtype=object)

        df = df.withColumn("cigar", run("seq", "_ref"))
    c = F.col("cigar")
    return df.select("ordinal", "name", cigar.projected(F.col("seq"), c).alias("seq"), cigar.cost(c).alias("cost"), cigar.identity(c).alias("identity"), "cigar")

"""Scores of all pairs of queries and references of a batch, as matrix products over numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from helixscan.functions.chars import ACGT, INVALID, MASK

_code = np.zeros(256, np.uint8)
for _letter, _bits in MASK.items():
    _code[ord(_letter)] = _bits
IS_ACGT = np.isin(np.arange(256), list(ACGT.encode()))
IS_VALID = ~np.isin(np.arange(256), list(INVALID.encode()))


def matrix(seqs: list[bytes]) -> np.ndarray:
    """One row of byte values for each sequence; all must have the same length."""
    length = len(seqs[0]) if seqs else 0
    if any(len(s) != length for s in seqs):
        raise ValueError("sequences of different lengths")
    return np.frombuffer(b"".join(seqs), np.uint8).reshape(len(seqs), length)


def texts(rows: np.ndarray) -> pa.Array:
    """The sequences of the rows of a matrix."""
    offsets = np.arange(len(rows) + 1, dtype=np.int64) * rows.shape[1]
    return pa.Array.from_buffers(pa.large_string(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.string())


class QueryMatrix:
    """Queries as columns (site, letter) that some query has; letters of other queries need no product."""

    def __init__(self, q: np.ndarray):
        self.q = q
        letters = np.array([c for c in np.flatnonzero(np.bincount(q.ravel(), minlength=256)) if IS_VALID[c]], np.uint8)
        held = np.array([(q == c).any(0) for c in letters]).reshape(len(letters), q.shape[1])
        self.site, which = np.nonzero(held.T)
        self.letter = letters[which]
        self.one_hot = (q[:, self.site] == self.letter).astype(np.float32)
        self.acgt_column = IS_ACGT[self.letter]
        self.valid = IS_VALID[q].astype(np.float32)
        self.acgt = IS_ACGT[q].astype(np.float32)

    def scores(self, r: np.ndarray, acgt_only: bool = False) -> dict[str, np.ndarray]:
        """Counts as integer matrices, queries x references."""
        at = r[:, self.site]
        same = (at == self.letter).astype(np.float32)
        a = self.acgt_column
        acgt = self.one_hot[:, a] @ same[:, a].T
        out = {"acgt": acgt}
        if acgt_only:
            out["acgt_valid"] = self.acgt @ IS_ACGT[r].astype(np.float32).T
        else:
            overlap = ((at == self.letter) | ((_code[at] & _code[self.letter]) != 0) & IS_VALID[at]).astype(np.float32)
            out["text"] = acgt + self.one_hot[:, ~a] @ same[:, ~a].T
            out["partial"] = self.one_hot @ overlap.T
            out["valid"] = self.valid @ IS_VALID[r].astype(np.float32).T
        return {k: v.astype(np.int32) for k, v in out.items()}


class Consensus:
    """One query, of letters that tell something, against references that mostly have the same letters."""

    def __init__(self, letters: np.ndarray):
        self.letters, self.acgt = letters, IS_ACGT[letters]
        self.only_acgt = bool(self.acgt.all())

    def scores(self, r: np.ndarray, acgt_only: bool = False) -> dict[str, np.ndarray]:
        """Counts as ``QueryMatrix`` gives them, in one row."""
        same = r == self.letters
        text = same.sum(1)
        acgt = text if self.only_acgt else same[:, self.acgt].sum(1)
        row, site = np.nonzero(~same)  # few
        other, own, acgt_there = r[row, site], self.letters[site], self.acgt[site]
        count = lambda on: np.bincount(row[on], minlength=len(r))
        if acgt_only:
            out = {"acgt": acgt, "acgt_valid": acgt + count(acgt_there & IS_ACGT[other])}
        else:
            known = IS_VALID[other]
            out = {"acgt": acgt, "text": text, "partial": text + count(known & ((_code[other] & _code[own]) != 0)), "valid": text + count(known)}
        return {k: v.astype(np.int32)[None] for k, v in out.items()}


#: Runs of segregating sites that are scored one after the other.
RUNS = 4
#: Pairs, and queries, whose matches are counted at once; words of a plane whose pairs are scored at once.
PAIRS, QUERIES, WORDS = 1 << 21, 2048, 1 << 18


def planes(letters: np.ndarray, number: np.ndarray, bits: int) -> list[np.ndarray]:
    """Rows of letters as rows of 64 bit words: known ones, ACGT, the four bases that a letter stands for, and the ``bits`` of its ``number``."""
    bases, numbers = _code[letters], number[letters]
    found = []
    for on in (IS_VALID[letters], IS_ACGT[letters], *((bases >> k) & 1 for k in range(4)), *((numbers >> k) & 1 for k in range(bits))):
        packed = np.packbits(on, axis=1)
        words = np.zeros((len(letters), max(1, -(-packed.shape[1] // 8)) * 8), np.uint8)
        words[:, : packed.shape[1]] = packed
        found.append(words.view(np.uint64))
    return found


class References:
    """What all queries need of a block of references."""

    def __init__(self, r: np.ndarray, scorer: Scorer):
        s = scorer
        self.n = len(r)
        self.known = IS_VALID[r].sum(1).astype(np.int32)
        self.constant = {k: x[0] for k, x in s.constant.scores(r[:, s.constant_sites], s.acgt_only).items()}
        own = r[:, s.sites]
        self.same = (own[:, s.site] == s.letter).astype(np.float32)
        letters = np.add.reduceat(np.pad(IS_ACGT[own], ((0, 0), (0, 1))).astype(np.int32), s.begins, 1) if len(r) else np.zeros((0, len(s.begins)), np.int32)
        letters[:, s.empty] = 0
        self.ahead = np.cumsum(letters[:, ::-1], 1)[:, ::-1]  # ACGT letters from a run on
        self.planes = planes(own, s.number, s.bits)


class Scorer:
    """Six sort keys of pairs of queries and references.  Constant sites are scored once for each reference, against the consensus.

    The first key, ACGT matches, is counted for all pairs as a matrix product; the others only for pairs that are asked for, from letters as bits.
    Given the least first key that still counts for each query, references are left out as soon as they can't reach it for any
    query: by the matches so far and the letters that both have on the other sites.  ``seen`` and ``scored`` count references, before and after."""

    def __init__(self, q: np.ndarray, classes: np.ndarray, consensus: np.ndarray, acgt_only: bool):
        self.acgt_only, self.queries = acgt_only, len(q)
        parts = {k: np.flatnonzero(classes == ord(k)) for k in "cmp"}
        self.constant_sites, self.constant = parts["c"], Consensus(consensus[parts["c"]])
        # The sites where some query misses the others' letter, then the segregating ones in runs.
        runs = [parts["m"], *np.array_split(parts["p"], RUNS)]
        self.sites = np.concatenate(runs)
        own = q[:, self.sites]
        self.begins = np.cumsum([0, *(len(x) for x in runs[:-1])])
        self.empty = np.array([not len(x) for x in runs])
        held = np.array([(own == c).any(0) for c in ACGT.encode()]).reshape(len(ACGT), len(self.sites))
        self.site, which = np.nonzero(held.T)
        self.letter = np.frombuffer(ACGT.encode(), np.uint8)[which]
        self.one_hot = own[:, self.site] == self.letter
        self.columns = np.searchsorted(self.site, self.begins)  # the first column of each run
        letters = np.stack([IS_ACGT[own[:, b : b + len(x)]].sum(1) for b, x in zip(self.begins, runs, strict=True)], 1).astype(np.int32)
        self.ahead = np.cumsum(letters[:, ::-1], 1)[:, ::-1]
        present = [c for c in np.flatnonzero(np.bincount(own.ravel(), minlength=256)) if IS_VALID[c]]
        self.number = np.zeros(256, np.uint8)  # 0: a letter that no query has
        self.number[present] = np.arange(1, len(present) + 1)
        self.bits = len(present).bit_length()
        self.planes = planes(own, self.number, self.bits)
        on_p = np.zeros((1, len(self.sites)), np.uint8)
        on_p[:, len(parts["m"]) :] = ord("A")
        self.segregating = planes(on_p, self.number, 0)[1]
        self.seen = self.scored = 0

    def counted(self, lo: int, hi: int, r: References, least: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """ACGT matches of the queries from ``lo`` to ``hi`` with the references, by number, that may reach ``least`` for one of them."""
        rows, total = np.arange(r.n), np.repeat(r.constant["acgt"][None].astype(np.float32), hi - lo, 0)
        ends, trying = [*self.columns[1:], len(self.site)], least is not None
        for at, (begin, end) in enumerate(zip(self.columns, ends, strict=True)):
            if trying and len(rows):
                on = (total + np.minimum(self.ahead[lo:hi, at, None], r.ahead[rows, at][None]) >= least[lo:hi, None]).any(0)
                trying = np.count_nonzero(on) < 0.9 * len(on)
                if not on.all():
                    rows, total = rows[on], total[:, on]
            end = end if trying else len(self.site)
            if begin < end:
                same = r.same[:, begin:end] if len(rows) == r.n else r.same[rows, begin:end]
                total += self.one_hot[lo:hi, begin:end].astype(np.float32) @ same.T
            if not trying:
                break
        return total, rows

    def of_pairs(self, i: np.ndarray, r: References, j: np.ndarray) -> list[np.ndarray]:
        """The six keys of query ``i[k]`` and reference ``j[k]``, for each ``k``."""
        step = max(1, WORDS // self.planes[0].shape[1])
        parts = [self._of_pairs(i[at : at + step], r, j[at : at + step]) for at in range(0, max(1, len(i)), step)]
        return [np.concatenate(x) for x in zip(*parts, strict=True)]

    def _of_pairs(self, i: np.ndarray, r: References, j: np.ndarray) -> list[np.ndarray]:
        count = lambda words: np.bitwise_count(words).sum(1, dtype=np.int32)
        own, other = ((lambda k: self.planes[k][i]), (lambda k: r.planes[k][j]))
        apart = np.zeros((len(i), self.planes[0].shape[1]), np.uint64)
        for k in range(6, 6 + self.bits):
            apart |= own(k) ^ other(k)
        known, acgt = own(0), own(1)
        equal = ~apart & known
        match, fixed = equal & acgt, {k: x[j] for k, x in r.constant.items()}
        matches = count(match)
        if self.acgt_only:
            both = acgt & other(1)
            valid, p = count(both), count((both ^ match) & self.segregating)
            m = valid - matches - p
            return [fixed["acgt"] + matches, fixed["acgt_valid"] + valid, matches, r.known[j], fixed["acgt_valid"] - fixed["acgt"] + m, p]
        shared = equal.copy()
        for k in range(2, 6):
            shared |= own(k) & other(k)
        return [fixed["acgt"] + matches, fixed["text"] + count(equal), fixed["partial"] + count(shared), fixed["valid"] + count(known & other(0)), matches, r.known[j]]

    def keys(self, r: np.ndarray, least: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
        """The keys (queries x references) and the references, by number, that were scored to the end."""
        block = References(r, self)
        _, rows = self.counted(0, self.queries, block, least)
        self.seen += len(r)
        self.scored += len(rows)
        i, j = (x.ravel() for x in np.indices((self.queries, len(rows))))
        return [x.reshape(self.queries, len(rows)) for x in self.of_pairs(i, block, rows[j])], rows


class Packed:
    """Keys of a pair as one or more numbers of 63 bits that sort like the keys; ``sites``: the greatest key."""

    def __init__(self, sites: int, keys: int = 6):
        self.bits = max(1, int(sites).bit_length())
        self.each, self.keys = 63 // self.bits, keys

    def words(self, keys: list[np.ndarray]) -> list[np.ndarray]:
        out = []
        for at in range(0, self.keys, self.each):
            word = np.zeros(len(keys[0]), np.int64)
            for key in keys[at : at + self.each]:
                word = word << self.bits | key.astype(np.int64)
            out.append(word)
        return out

    def unpacked(self, words: list[np.ndarray]) -> list[np.ndarray]:
        out = []
        for at, word in zip(range(0, self.keys, self.each), words, strict=True):
            few = min(self.each, self.keys - at)
            out += [word >> self.bits * (few - 1 - k) & (1 << self.bits) - 1 for k in range(few)]
        return out


def chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.ChunkedArray]]:
    """Records of about ``size`` bytes of sequence at once: their different sequences as a matrix, which of them each record has, ordinals and names."""

    def together(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.ChunkedArray]:
        table = pa.Table.from_batches(parts)
        seq = table.column("seq").cast(pa.binary()).combine_chunks().dictionary_encode()
        return matrix(seq.dictionary.to_pylist()), seq.indices.to_numpy(), table.column("ordinal").to_numpy(), table.column("name")

    held, used = [], 0
    for whole in batches:
        if not whole.num_rows:
            continue
        step = max(16, size // max(1, len(whole.column("seq")[0].as_py() or "")))
        for at in range(0, whole.num_rows, step):
            part = whole.slice(at, step)
            held.append(part)
            used += part.column("seq").nbytes
            if used >= size:
                yield together(held)
                held, used = [], 0
    if held:
        yield together(held)


def best(keys: list[np.ndarray], ordinal: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Query and reference numbers of the ``n`` best references of each query: keys descending, then ordinal."""
    nq, nr = keys[0].shape
    if nr > n:
        least = np.partition(keys[0], nr - n, axis=1)[:, nr - n]
        q, r = np.nonzero(keys[0] >= least[:, None])
    else:
        q, r = (x.ravel() for x in np.indices((nq, nr)))
    order = np.lexsort((ordinal[r], *[-k[q, r] for k in reversed(keys)], q))
    q, r = q[order], r[order]
    first = np.searchsorted(q, q)
    keep = np.arange(len(q)) - first < n
    return q[keep], r[keep]

"""Byte-level BPE with the tokenizers library: encoding, offsets, decoding and split characters.

``byte_table`` is the reversible map between the 256 bytes and the printable characters that the
vocabulary file is written in.  ``ByteBPE`` encodes texts with the library and decodes ids by
reversing that table; ids that end inside a character give its first bytes, which ``decode_stream``
holds back until the rest arrives.

Texts are cut at single spaces and around single line ends between two characters that are not white
space.  The pre-tokenizer always cuts there too (a space joins the word that follows it), so a part encodes
alone as it does in its text, and parts that occur again come from a bounded table.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import os
import re
from array import array
from collections.abc import Iterable, Iterator
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import as_texts, documents, slices

#: A space that is not between two characters other than white space.
LOOSE_SPACE = re.compile(r"\s\s| \Z|\A ")
#: Before a space that is.
SAFE = re.compile(r"(?<=\S)(?= \S)")
KEEP = 600_000
#: Different runs of marks after words whose ids are remembered.
MARKS = 1000
#: A word of Latin letters, perhaps after a space, and the marks after it.  The pre-tokenizers cut
#: such a part between letters and marks only, and no normaliser changes it but for its case.
SIMPLE = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:%&$#*]*)\Z")


def byte_table() -> dict[int, str]:
    """Byte to character: printable Latin-1 stays, the others follow from code point 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: Latin-1 characters as the vocabulary files spell their bytes.
SPELLED = {c: "".join(byte_table()[b] for b in chr(c).encode()) for c in range(256)}


def load_tokenizer(path: str, special_as_text: bool = True):
    """``special_as_text``: the strings of special tokens are ordinary text (the library by itself makes their ids of them)."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = special_as_text
    return tokenizer


class PartTable:
    """Ids of text parts as little-endian bytes.

    Parts are remembered in two generations: a full newer one becomes the older one, which is
    dropped then, so that at most ``keep`` parts are held and frequent ones stay.  A part that the
    pre-tokenizer is sure to leave as one word, or as a word and the marks after it, goes straight
    to the library's merges; the library takes every other part as a text.
    """

    def __init__(self, tokenizer, lower: bool = False, keep: int = KEEP):
        self.tokenizer, self.lower, self.keep = tokenizer, lower, keep
        self.newer: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.ends: dict[str, bytes] = {}
        self.merge = tokenizer.model.tokenize
        own = [] if tokenizer.encode_special_tokens else [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.special, self.mark = re.compile(f"({'|'.join(map(re.escape, own))})") if own else None, os.path.commonprefix(own)

    def parts(self, text: str, cut) -> list[str]:
        """``cut(text)``, where the strings of special tokens, which the library takes out first, are parts of their own."""
        if self.special is None or self.mark not in text or not self.special.search(text):
            return cut(text)
        return [p for i, x in enumerate(self.special.split(text)) for p in ([x] if i % 2 else cut(x))]

    def encode(self, parts: list[str], known: dict[str, bytes]) -> None:
        """Adds the ids of new parts to ``known``."""
        match, merge, lower, hard, ends = SIMPLE.match, self.merge, self.lower, [], self.ends
        for p in parts:
            m = match(p)
            if m is None:
                hard.append(p)
                continue
            word, marks = m.groups()
            own = array("I", [t.id for t in merge((word.lower() if lower else word).translate(SPELLED))]).tobytes()
            if marks:
                if marks not in ends:
                    if len(ends) >= MARKS:
                        ends.clear()
                    ends[marks] = array("I", [t.id for t in merge(marks)]).tobytes()
                own += ends[marks]
            known[p] = own
        for i in range(0, len(hard), 4096):
            part = hard[i : i + 4096]
            for p, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                known[p] = array("I", e.ids).tobytes()

    def ids(self, texts: list[list[str]]) -> list[bytes]:
        """For each text, given as its parts, the ids of all its parts."""
        wanted = set().union(*texts)
        new = [p for p in wanted if p not in self.newer]
        if len(self.newer) + len(new) > self.keep // 2:
            self.older, self.newer, new = self.newer, {}, list(wanted)
        newer, older = self.newer, self.older
        again = [p for p in new if p in older]
        newer.update(zip(again, map(older.__getitem__, again), strict=True))
        self.encode([p for p in new if p not in older] if again else new, newer)
        return [b"".join(map(newer.__getitem__, parts)) for parts in texts]


def parts_of(text: str) -> list[str]:
    if not text:
        return []
    if LOOSE_SPACE.search(text):
        # Cut only where a space stands between two characters that are not white space.
        return re.split(r"(?<=\S)(?= \S)", text)
    parts: list[str] = []
    for line in text.split("\n"):
        if parts:
            parts.append("\n")
        first, *rest = line.split(" ")
        parts.append(first)
        parts += [" " + x for x in rest]
    return parts


#: Characters of a text that are cut into parts at once.
LONG = 1 << 20


def segments(text: str, size: int = LONG) -> Iterator[str]:
    """A long text in pieces of about ``size`` characters that encode alone: they end between a character and a space before another one."""
    start = 0
    while len(text) - start > size:
        found = SAFE.search(text, start + size)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:] if start else text


#: White space as Python sees it, and what ``LOOSE_SPACE`` finds, in Arrow's syntax.
BLANK = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
LOOSE = rf"[{BLANK}][{BLANK}]| \z|\A "
ID = attrgetter("id")


class ColumnTable(PartTable):
    """Ids of whole columns of texts: Arrow cuts them at spaces and numbers the different parts, each of which is
    looked up once for a column.  A word is merged once, whatever marks follow it.  Texts that are long, have loose
    spaces or may hold special tokens are cut one by one."""

    def encode(self, parts: list[str], known: dict[str, bytes]) -> None:
        match, merge, older, hard = SIMPLE.match, self.merge, self.older, []

        def merged(word: str) -> bytes:
            return array("I", map(ID, merge(word))).tobytes()

        for p in parts:
            m = match(p)
            if m is None:
                hard.append(p)
                continue
            word, marks = m.groups()
            own = known.get(word) or older.get(word)
            if own is None:
                own = known[word] = merged((word.lower() if self.lower else word).translate(SPELLED))
            if marks:
                end = self.ends.get(marks)
                if end is None:
                    if len(self.ends) >= MARKS:
                        self.ends.clear()
                    end = self.ends[marks] = merged(marks)
                known[p] = own + end
            else:
                known[p] = own
        super().encode(hard, known)

    def each(self, parts: list[str]) -> list[bytes]:
        """The ids of every part."""
        found = list(map(self.newer.get, parts))
        new = {p for p, x in zip(parts, found, strict=True) if x is None}
        if not new:
            return found
        if len(self.newer) + len(new) > self.keep // 2:
            self.older, self.newer, new = self.newer, {}, set(parts)
        newer, older = self.newer, self.older
        newer.update((p, older[p]) for p in new if p in older)
        self.encode([p for p in new if p not in newer], newer)
        return [newer[p] if x is None else x for p, x in zip(parts, found, strict=True)]

    def lined(self, parts: list[str]) -> list[bytes]:
        """The ids of parts that may hold single line ends."""
        at = [i for i, p in enumerate(parts) if "\n" in p]
        cut = [parts[i].split("\n") for i in at]
        pieces = list({x for xs in cut for x in xs})
        for i in at:
            parts[i] = "\n"
        found = self.each([*parts, "\n", *pieces])
        end, of = found[len(parts)], dict(zip(pieces, found[len(parts) + 1 :], strict=True))
        del found[len(parts) :]
        for i, xs in zip(at, cut, strict=True):
            found[i] = end.join([of[x] for x in xs])
        return found

    def column(self, texts: pa.Array) -> list[bytes]:
        """The ids of every text; null counts as empty."""
        if not len(texts):
            return []
        odd = pc.or_(pc.match_substring_regex(texts, LOOSE), pc.greater(pc.binary_length(texts), LONG))
        if self.special is not None:
            odd = pc.or_(odd, pc.match_substring(texts, self.mark))
        odd = pc.fill_null(odd, True)
        words = pc.split_pattern(pc.if_else(odd, "", texts).cast(pa.string()), " ")
        bounds = words.offsets.to_numpy()
        flat = words.values.dictionary_encode()
        begins = flat.take(pa.array(bounds[:-1]))
        which = flat.indices.to_numpy().copy()
        # The first word of a text has no space before it.
        firsts = begins.dictionary_decode().to_pylist()
        own = {x: len(flat.dictionary) + i for i, x in enumerate(dict.fromkeys(firsts))}
        which[bounds[:-1]] = [own[x] for x in firsts]
        spaced = pc.binary_join_element_wise(" ", flat.dictionary, "").to_numpy(zero_copy_only=False).tolist()
        ids = self.lined([*spaced, *own])
        held = np.frombuffer(b"".join(ids), "<u4")
        sizes = np.fromiter(map(len, ids), np.int32, len(ids)) // 4
        starts, lengths = (np.cumsum(sizes, dtype=np.int32) - sizes)[which], sizes[which]
        ends = np.concatenate([np.zeros(1, np.int32), np.cumsum(lengths, dtype=np.int32)])
        place = np.repeat(starts - ends[:-1], lengths)
        place += np.arange(len(place), dtype=np.int32)
        out = held[place].tobytes()
        at = (4 * ends[bounds].astype(np.int64)).tolist()
        found = [out[a:b] for a, b in zip(at, at[1:], strict=False)]
        left = np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist()
        for k in range(0, len(left), 256):
            some = [list(segments(texts[i].as_py() or "")) for i in left[k : k + 256]]
            short = iter(self.ids([self.parts(x[0], parts_of) for x in some if len(x) == 1]))
            for i, xs in zip(left[k : k + 256], some, strict=True):
                found[i] = next(short) if len(xs) == 1 else b"".join(self.ids([self.parts(x, parts_of)])[0] for x in xs)
        return found


class ByteBPE:
    """The vocabulary at ``json_path`` with the ids of the rank file at ``ranks_path``."""

    def __init__(self, json_path: str, ranks_path: str):
        self.tokenizer = load_tokenizer(json_path)
        with open(ranks_path, "rb") as f:
            ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, f)}
        to_char = byte_table()
        from_char = {c: b for b, c in to_char.items()}
        self.bytes_of = [b""] * (max(ranks) + 1)
        for token, i in self.tokenizer.get_vocab().items():
            if i in ranks:
                self.bytes_of[i] = bytes(from_char[c] for c in token)
        if any(self.bytes_of[i] != b for i, b in ranks.items()):
            raise ValueError("the vocabulary and the rank file differ")
        self.table = PartTable(self.tokenizer)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        return self.table.ids([parts_of(t) for t in texts])

    def encode_with_offsets(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        """Ids and, for each, the characters (start, end) that its bytes belong to."""
        e = self.tokenizer.encode(text, add_special_tokens=False)
        width = np.array([len(c.encode()) for c in text], dtype=np.int64)
        char_at = np.repeat(np.arange(len(text)), width)
        ends = np.cumsum([len(self.bytes_of[i]) for i in e.ids]) if e.ids else []
        starts = [0, *ends[:-1]] if len(ends) else []
        return e.ids, [(int(char_at[a]), int(char_at[b - 1]) + 1) for a, b in zip(starts, ends, strict=True)]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text as ids arrive; bytes of a character that is split between ids wait for its end."""
        held = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            if out := held.decode(self.bytes_of[i]):
                yield out
        if out := held.decode(b"", True):
            yield out


_open: dict[tuple, ByteBPE] = {}


def byte_bpe(json_path: str, ranks_path: str) -> ByteBPE:
    """One per Python worker."""
    key = (json_path, ranks_path)
    if key not in _open:
        _open[key] = ByteBPE(*key)
    return _open[key]


def bpe_round_trip(docs: DataFrame, json_path: str, ranks_path: str, text: str = "text", ids: bool = False) -> DataFrame:
    """Encode every whole text, decode the ids again.  Adds nothing to and drops nothing from the rows.

    Input: ``doc_id`` and a text column; other columns are ignored.  Output per row: ``doc_id,
    n_tokens, ids_sha256, decoded_sha256`` and, on request, ``ids`` (array of long) and ``decoded``.
    A null or empty text has no tokens and the hashes of the empty string; repeated rows repeat;
    an empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(json_path, ranks_path)
        for whole in batches:
            for batch in slices(whole, "text"):
                n, a, b, all_ids, all_bytes = [], [], [], [], []
                for packed in bpe.encode_batch(as_texts(batch.column("text"))):
                    found = np.frombuffer(packed, "<u4").tolist()
                    back = bpe.decode(found)
                    n.append(len(found))
                    a.append(hashlib.sha256(packed).hexdigest())
                    b.append(hashlib.sha256(back).hexdigest())
                    if ids:
                        all_ids.append(found)
                        all_bytes.append(back.decode("utf-8", "replace"))
                columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if ids:
                    columns += [pa.array(all_ids, pa.list_(pa.int64())), pa.array(all_bytes, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<long>, decoded string" if ids else ""
    return docs.select("doc_id", docs[text].alias("text")).mapInArrow(run, schema)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))

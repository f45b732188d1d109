"""Files by path or URI, on any file system that Arrow opens (local, S3, GCS, HDFS), and xz block by block."""

from __future__ import annotations

import bz2
import gzip
import lzma
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

from pyarrow import fs

#: First bytes of compressed files.
GZIP, BZIP2, XZ = b"\x1f\x8b", b"BZh", b"\xfd7zXZ\x00"
#: Fixed values of the xz format: bytes of a stream's header and of its footer, magic bytes of the footer, the filter LZMA2.
HEADER, FOOTER, FOOTER_MAGIC, LZMA2 = 12, 12, b"YZ", 0x21
#: Compressed bytes that are read at once.
CHUNK = 1 << 20


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path on it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def opened(path: str) -> BinaryIO:
    system, at = located(path)
    return system.open_input_file(at)


def listed(folder: str) -> list[tuple[str, int]]:
    """Paths and sizes of the visible files in a folder, by name; none if there is no such folder."""
    system, at = located(folder)
    found = system.get_file_info(fs.FileSelector(at, allow_not_found=True))
    start = folder.rstrip("/")
    return sorted((f"{start}/{x.base_name}", x.size) for x in found if x.is_file and x.base_name[:1] not in "._")


def text_lines(path: str) -> Iterator[bytes]:
    """Lines of a plain or compressed file; by the first bytes, whatever the file is called."""
    with opened(path) as f:
        start = f.read(6)
        f.seek(0)
        kinds = ((GZIP, gzip.open), (BZIP2, bz2.open), (XZ, lzma.open))
        opener = next((o for magic, o in kinds if start.startswith(magic)), None)
        yield from lines(chunks(f if opener is None else opener(f, "rb")))


def chunks(f: BinaryIO) -> Iterator[bytes]:
    while part := f.read(CHUNK):
        yield bytes(part)


def lines(parts: Iterator[bytes]) -> Iterator[bytes]:
    """Lines with their ends (``\\n``, ``\\r\\n`` or ``\\r``) left on."""
    held = b""
    for part in parts:
        held += part
        found = held.split(b"\n")
        held = found.pop()
        for line in found:
            yield line + b"\n"
    if held:
        yield held


# xz


@dataclass(frozen=True)
class Block:
    """Place of a block, its bytes without padding, its bytes of text, and bytes of its check."""

    offset: int
    unpadded: int
    text: int
    check: int


def number(data: bytes, at: int) -> tuple[int, int]:
    """A number of variable length, and where it ends."""
    out = shift = 0
    while True:
        byte = data[at]
        out |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return out, at


def padded(n: int) -> int:
    return -(-n // 4) * 4


def blocks(f: BinaryIO, size: int) -> list[Block]:
    """All blocks of a file of one or more xz streams, from the indexes at their ends."""
    out: list[Block] = []
    end = size
    while end > 0:
        f.seek(end - 4)
        if f.read(4) == b"\0\0\0\0":  # padding between streams
            end -= 4
            continue
        f.seek(end - FOOTER)
        footer = f.read(FOOTER)
        if footer[-2:] != FOOTER_MAGIC:
            raise ValueError("not an xz file")
        length = (struct.unpack("<I", footer[4:8])[0] + 1) * 4
        check = (0, 4, 4, 4, 8, 8, 8, 16, 16, 16, 32, 32, 32, 64, 64, 64)[footer[9] & 15]
        f.seek(end - FOOTER - length)
        index = f.read(length)
        n, at = number(index, 1)
        sizes = []
        for _ in range(n):
            unpadded, at = number(index, at)
            text, at = number(index, at)
            sizes.append((unpadded, text))
        begin = end - FOOTER - length - sum(padded(u) for u, _ in sizes)
        own, place = [], begin
        for unpadded, text in sizes:
            own.append(Block(place, unpadded, text, check))
            place += padded(unpadded)
        out = own + out
        end = begin - HEADER
    return out


def block_text(f: BinaryIO, block: Block) -> Iterator[bytes]:
    """A block's text, piece by piece."""
    f.seek(block.offset)
    size = (f.read(1)[0] + 1) * 4
    f.seek(block.offset)
    head = f.read(size)
    at = 2
    for bit in (64, 128):  # sizes that the header may repeat
        if head[1] & bit:
            _, at = number(head, at)
    filters = []
    for _ in range((head[1] & 3) + 1):
        kind, at = number(head, at)
        n, at = number(head, at)
        filters.append((kind, head[at : at + n]))
        at += n
    if [k for k, _ in filters] != [LZMA2]:
        raise ValueError("an xz filter other than LZMA2")
    bits = filters[0][1][0]
    dictionary = 0xFFFFFFFF if bits == 40 else (2 | bits & 1) << (bits // 2 + 11)
    decoder = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA2, "dict_size": dictionary}])
    left = block.unpadded - size - block.check
    while not decoder.eof:
        if decoder.needs_input:
            part = f.read(min(CHUNK, left))
            left -= len(part)
            if not part:
                break
        else:
            part = b""
        if text := decoder.decompress(part, 4 * CHUNK):
            yield text

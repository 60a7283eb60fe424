"""Files of token ids: independent zstandard frames, a trailing seek table, a checksum per frame.

A file is a run of frames, one per group of consecutive documents, each
decompressible alone, then one skippable frame with the seek table:

    uint32 magic 0x184D2A5E, uint32 size of what follows
    per frame: uint32 compressed size, uint32 decompressed size, uint32 checksum
    uint32 number of frames, uint8 descriptor 0x80 (checksums present), uint32 0x8F92EAB1

The checksum of a frame is the low 32 bits of the XXH64 of its content.  These
are the fixed values of the public seekable zstandard format.  A frame's content
is a header (n, n lengths, n document ids, n bytes that tell a null id) and the
token ids, little-endian uint32.
"""

from __future__ import annotations

import struct

import numpy as np
import xxhash
import zstandard

MAGIC, SEEKABLE, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
LEVEL = 1


def checksum(content: bytes) -> int:
    return xxhash.xxh64_intdigest(content) & 0xFFFFFFFF


def pack(doc_ids: list[int | None], documents: list[np.ndarray]) -> bytes:
    """Content of one frame."""
    known = np.array([d is not None for d in doc_ids], "u1")
    numbers = np.array([d or 0 for d in doc_ids], "<i8")
    lengths = np.array([len(documents), *map(len, documents)], "<u4")
    return b"".join([x.tobytes() for x in (lengths, numbers, known)] + [d.astype("<u4", copy=False).tobytes() for d in documents])


def unpack(content: bytes) -> list[tuple[int | None, np.ndarray]]:
    n = int(np.frombuffer(content, "<u4", 1)[0])
    ends = np.cumsum(np.frombuffer(content, "<u4", n, 4).astype(np.int64))
    numbers = np.frombuffer(content, "<i8", n, 4 + 4 * n).tolist()
    known = np.frombuffer(content, "u1", n, 4 + 12 * n)
    ids = np.frombuffer(content, "<u4", offset=4 + 13 * n)
    return [(d if k else None, ids[i:j]) for d, k, i, j in zip(numbers, known, np.r_[0, ends[:-1]], ends)]


class Writer:
    """Writes frames to ``sink`` as they come; memory follows one frame."""

    def __init__(self, sink):
        self.sink = sink
        self.table: list[tuple[int, int, int]] = []
        self.compress = zstandard.ZstdCompressor(level=LEVEL).compress

    def add(self, doc_ids: list[int | None], documents: list[np.ndarray]) -> int:
        """Append a frame; returns its number."""
        content = pack(doc_ids, documents)
        frame = self.compress(content)
        self.sink.write(frame)
        self.table.append((len(frame), len(content), checksum(content)))
        return len(self.table) - 1

    def finish(self) -> None:
        table = b"".join(struct.pack("<3I", *row) for row in self.table)
        foot = struct.pack("<IBI", len(self.table), CHECKSUMS, SEEKABLE)
        self.sink.write(struct.pack("<2I", MAGIC, len(table) + len(foot)) + table + foot)


class Reader:
    """Random access: ``read(size, offset)`` is called for the seek table and for requested frames only."""

    def __init__(self, read, size: int):
        n, descriptor, magic = struct.unpack("<IBI", read(9, size - 9))
        if magic != SEEKABLE or descriptor != CHECKSUMS:
            raise ValueError("no seek table with checksums")
        tail = read(12 * n + 8, size - 9 - 12 * n - 8)
        if struct.unpack_from("<2I", tail) != (MAGIC, 12 * n + 9):
            raise ValueError("the seek table is damaged")
        self.read, self.table = read, np.frombuffer(tail, "<u4", 3 * n, 8).reshape(-1, 3)
        self.starts = np.r_[0, np.cumsum(self.table[:, 0].astype(np.int64))]

    def __len__(self) -> int:
        return len(self.table)

    def frame(self, k: int) -> list[tuple[int | None, np.ndarray]]:
        """``(doc_id, ids)`` of the documents of frame ``k``."""
        size, full, check = map(int, self.table[k])
        content = zstandard.ZstdDecompressor().decompress(self.read(size, int(self.starts[k])), max_output_size=full)
        if len(content) != full or checksum(content) != check:
            raise ValueError(f"frame {k}: the checksum does not match")
        return unpack(content)

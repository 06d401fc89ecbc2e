"""Token files: independent zstandard frames, a trailing seek table, checksums.

A file is: a skippable frame with the documents it holds (ids and numbers of
tokens), data frames of little-endian 32-bit ids, and a skippable frame with the
seek table, in the layout of the public seekable format: for each data frame its
compressed size, its size and the low 32 bits of a 64-bit xxhash of its content,
then the number of frames, a descriptor byte and a magic number. A reader takes
the last bytes, then only the frames that hold the documents it wants.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs as pafs

# Fixed values of the seekable format.
SKIPPABLE_INDEX = 0x184D2A50
SKIPPABLE_SEEK = 0x184D2A5E
SEEK_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

#: Tokens after which a frame is closed at the next document's end.
FRAME_TOKENS = 32_768
_NULL_ID = -(1 << 63)


def encode_file(docs: Iterable[tuple[int | None, bytes]], frame_tokens: int = FRAME_TOKENS, level: int = 1) -> tuple[bytes, int, int]:
    """(file, documents, tokens) of (doc_id, little-endian 32-bit ids) in the order given."""
    packer = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
    ids: list[int] = []
    counts: list[int] = []
    frames: list[bytes] = []
    table: list[bytes] = []
    held: list[bytes] = []
    size = 0

    def close() -> None:
        nonlocal size
        raw = b"".join(held)
        frame = packer.compress(raw)
        frames.append(frame)
        table.append(struct.pack("<III", len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        held.clear()
        size = 0

    for doc, raw in docs:
        ids.append(_NULL_ID if doc is None else doc)
        counts.append(len(raw) // 4)
        held.append(raw)
        size += len(raw) // 4
        if size >= frame_tokens:
            close()
    if held:
        close()
    index = packer.compress(np.array([ids, counts], "<i8").tobytes())
    head = struct.pack("<III", SKIPPABLE_INDEX, len(index) + 4, len(ids)) + index
    seek = b"".join(table) + struct.pack("<IBI", len(table), CHECKSUM_FLAG, SEEK_MAGIC)
    return b"".join((head, *frames, struct.pack("<II", SKIPPABLE_SEEK, len(seek)), seek)), len(ids), sum(counts)


class Reader:
    """Reads documents of a token file; ``source`` is a seekable binary file."""

    def __init__(self, source):
        self._f = source
        source.seek(0, 2)
        end = source.tell()
        source.seek(end - 9)
        n, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEK_MAGIC or not flags & CHECKSUM_FLAG:
            raise ValueError("no seek table")
        source.seek(end - 9 - 12 * n - 8)
        kind, size = struct.unpack("<II", source.read(8))
        if kind != SKIPPABLE_SEEK or size != 12 * n + 9:
            raise ValueError("the seek table is damaged")
        rows = np.frombuffer(source.read(12 * n), "<u4").reshape(n, 3).astype(np.int64)
        source.seek(0)
        kind, size, docs = struct.unpack("<III", source.read(12))
        if kind != SKIPPABLE_INDEX:
            raise ValueError("no document index")
        index = zstandard.ZstdDecompressor().decompress(source.read(size - 4)) if docs else b""
        self.doc_ids, self.counts = np.frombuffer(index, "<i8").reshape(2, docs) if docs else np.zeros((2, 0), np.int64)
        self.starts = np.cumsum(self.counts) - self.counts
        self._at = 8 + size + np.cumsum(rows[:, 0]) - rows[:, 0]
        self._sizes, self._raw, self._sums = rows.T if n else np.zeros((3, 0), np.int64)
        self._first = (np.cumsum(self._raw) - self._raw) // 4
        self._have: tuple[int, bytes] = (-1, b"")

    def frame(self, k: int) -> bytes:
        if self._have[0] != k:
            self._f.seek(int(self._at[k]))
            raw = zstandard.ZstdDecompressor().decompress(self._f.read(int(self._sizes[k])), max_output_size=int(self._raw[k]))
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self._sums[k]:
                raise ValueError(f"frame {k} fails its checksum")
            self._have = (k, raw)
        return self._have[1]

    def tokens(self, i: int) -> bytes:
        """The ids of the i-th document; only its frame is decompressed."""
        if not self.counts[i]:
            return b""
        k = int(np.searchsorted(self._first, self.starts[i], "right")) - 1
        at = 4 * int(self.starts[i] - self._first[k])
        return self.frame(k)[at : at + 4 * int(self.counts[i])]

    def __iter__(self) -> Iterator[tuple[int | None, bytes]]:
        for i, d in enumerate(self.doc_ids.tolist()):
            yield None if d == _NULL_ID else d, self.tokens(i)


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI or plain path, on any store that Arrow can reach."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1))


def write_whole(folder: str, name: str, content: bytes) -> str:
    """Put a file under its final name in one step, so a repeated or speculative task leaves one whole file."""
    store, path = open_store(folder)
    store.create_dir(path, recursive=True)
    tmp = f"{path}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(tmp) as out:
        out.write(content)
    try:
        store.move(tmp, f"{path}/{name}")
    except OSError:  # a store that doesn't replace files, and another attempt came first
        if store.get_file_info(f"{path}/{name}").type != pafs.FileType.File:
            raise
        store.delete_file(tmp)
    return f"{folder}/{name}"


def open_reader(uri: str) -> Reader:
    store, path = open_store(uri)
    return Reader(pa.PythonFile(store.open_input_file(path), mode="r"))

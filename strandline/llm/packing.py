"""Harmonic packing of tokenised documents into sequences of fixed capacity.

A piece longer than capacity/(k+1) and at most capacity/k is of class k, and a
bin of class k takes exactly k pieces. Bins of different classes never mix while
they fill, so a worker packs its own rows in one pass with no word from the
others. Documents may be cut, so a text first gives full sequences, then pieces
that fill their class exactly, and only its short tail is of uneven length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import kernels, tokens

CAPACITY = 1024
#: A tail of at most this many tokens is not cut further.
SHORT_TAIL = 48
#: Sequences that one partition can number.
_IDS_PER_PARTITION = 1 << 36


def cuts(length: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of a document's pieces: full ones, then the largest capacity/k that fits, again and again, then a tail."""
    out = [capacity] * (length // capacity)
    rest = length % capacity
    while rest > SHORT_TAIL:
        k = -(-capacity // rest)
        piece = capacity // k
        out.append(piece)
        rest -= piece
    if rest:
        out.append(rest)
    return out


def reciprocal_class(length: int, capacity: int = CAPACITY) -> int:
    return capacity // length


class Bins:
    """The open bin of each class, and the sequences that are full."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity = capacity
        self._open: dict[int, list[tuple]] = {}

    def add(self, length: int, piece: tuple) -> list[tuple] | None:
        """The pieces of a bin that is now full, if one is."""
        k = reciprocal_class(length, self.capacity)
        bin_ = self._open.setdefault(k, [])
        bin_.append((length, piece))
        return self._open.pop(k) if len(bin_) == k else None

    def rest(self) -> Iterator[list[tuple]]:
        """What is left in open bins, first-fit by decreasing length; at most one bin's worth per class."""
        left = sorted((x for b in self._open.values() for x in b), key=lambda x: -x[0])
        self._open = {}
        bins: list[tuple[int, list[tuple]]] = []
        for x in left:
            for i, (used, members) in enumerate(bins):
                if used + x[0] <= self.capacity:
                    members.append(x)
                    bins[i] = (used + x[0], members)
                    break
            else:
                bins.append((x[0], [x]))
        yield from (members for _, members in bins)


_FIELDS = (("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()))
_SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"


def pack(df: DataFrame, vocabulary: str, end_id: int = 0, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Pack each row's ids and ``end_id`` into sequences of at most ``capacity`` tokens.

    Returns one row per piece: doc_id, start (ids of its document before it),
    length, ids_crc32, doc_tokens, sequence_id, offset (in the sequence), and
    with ``with_ids`` the ids themselves as little-endian 32-bit integers. A
    null or empty text is the end id alone; each repeated row is packed for
    itself; a null id is kept; an empty table gives an empty result; extra
    columns are not read. A partition packs alone: there is no shuffle, and a
    lost task gives the same sequences when it runs again on rows in the same
    order, as files give them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(vocabulary)
        bins = Bins(capacity)
        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        number = part * _IDS_PER_PARTITION
        rows: list[tuple] = []

        def close(members: list[tuple]) -> None:
            nonlocal number
            at = 0
            for length, piece in members:
                rows.append((*piece[:2], length, *piece[2:4], number, at, piece[4]))
                at += length
            number += 1

        def batch() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [[] for _ in _FIELDS]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, _FIELDS, strict=True)], names=[n for n, _ in _FIELDS])
            rows.clear()
            return out

        for b in batches:
            for s in kernels.slices(b, "text"):
                ids, offs = enc.encode(s.column("text"))
                for i, doc in enumerate(s.column("doc_id").to_pylist()):
                    own = np.append(ids[offs[i] : offs[i + 1]], np.uint32(end_id)).astype("<u4").tobytes()
                    total, start = len(own) // 4, 0
                    for n in cuts(total, capacity):
                        raw = own[start * 4 : (start + n) * 4]
                        full = bins.add(n, (doc, start, zlib.crc32(raw), total, raw if with_ids else None))
                        if full:
                            close(full)
                        start += n
                if len(rows) > 1_000:
                    yield batch()
        for members in bins.rest():
            close(members)
        yield batch()
        kernels.give_back()

    out = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _SCHEMA)
    return out if with_ids else out.drop("ids")


def sequences(pieces: DataFrame) -> DataFrame:
    """One row per sequence: sequence_id, pieces, used, and padded (the length it is stored with).

    A sequence whose length is a power of two is stored as it is; any other is
    padded to the capacity.
    """
    used = pieces.groupBy("sequence_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("length").alias("used"))
    power = F.col("used").bitwiseAND(F.col("used") - 1) == 0
    return used.withColumn("padded", F.when(power, F.col("used")).otherwise(F.lit(CAPACITY).cast("bigint")))

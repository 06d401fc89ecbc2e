"""Writing a table's token ids to token files in id order, and reading them back."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm import kernels, shared, tokenfile, tokens

#: Text bytes that one file should hold; files grow in number with the input.
FILE_TEXT_BYTES = 16_000_000

#: Partitions in which files are read back at most; a partition reads its files one after the other.
MOST_READERS = 100_000

_MANIFEST = "part int, file int, path string, docs bigint, tokens bigint"


def write_tokens(df: DataFrame, vocabulary: str, folder: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", files: int | None = None) -> DataFrame:
    """Write each row's ids and ``end_id`` to token files, in ascending id order across files.

    Returns the manifest: part, file, path, docs, tokens, in file order by
    (part, file). Rows are dealt to parts by ranges of id and a hash of the
    text, so file after file gives the whole table in order, rows of one id in
    the hash's order, whichever attempt of a task writes them; a null id comes
    first. A part is written in files of bounded size as its rows come.
    """
    src = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    if files is None:
        size = src.agg(F.sum(F.octet_length("text")).alias("b")).first().b or 0
        files = max(1, -(-int(size) // FILE_TEXT_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(vocabulary)
        part = TaskContext.get().partitionId()
        made: list[tuple] = []
        held: list[tuple[int | None, bytes]] = []
        size = 0

        def close() -> None:
            nonlocal size
            content, docs, count = tokenfile.encode_file(held)
            path = tokenfile.write_whole(folder, f"part-{part:06d}-{len(made):06d}.tok", content)
            made.append((part, len(made), path, docs, count))
            held.clear()
            size = 0

        for b in batches:
            for s in kernels.slices(b, "text"):
                ids, offs = enc.encode(s.column("text"))
                for i, doc in enumerate(s.column("doc_id").to_pylist()):
                    raw = np.append(ids[offs[i] : offs[i + 1]], np.uint32(end_id)).astype("<u4").tobytes()
                    held.append((doc, raw))
                    size += len(raw)
                if size >= 2 * FILE_TEXT_BYTES:
                    close()
        if held:
            close()
        cols = list(zip(*made, strict=True)) or [[]] * 5
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["part", "file", "path", "docs", "tokens"])

    # many rows may share an id, or have none: what else is in them spreads them and fixes their order
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc(), F.col("text").asc_nulls_first()]
    dealt = src.repartitionByRange(files, *order[:2]).sortWithinPartitions(*order)
    return dealt.mapInArrow(run, _MANIFEST)


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of each document, from the files alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, before in zip(b.column("path").to_pylist(), b.column("before").to_pylist(), strict=True):
                r = tokenfile.open_reader(path)
                docs, sums = [], []
                for doc, raw in r:
                    docs.append(doc)
                    sums.append(zlib.crc32(raw))
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(before + r.starts, pa.int64()), pa.array(r.counts, pa.int64()), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # a row per file: two sums, one over each part's files and one over parts
    within = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    parts = manifest.groupBy("part").agg(F.sum("tokens").alias("t"))
    over = parts.select("part", F.coalesce(F.sum("t").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("p"))
    files = manifest.withColumn("w", F.coalesce(F.sum("tokens").over(within), F.lit(0))).join(over, "part")
    # a number that is given stays: a manifest's rows are few bytes, which would otherwise be read as one partition
    n = max(1, min(manifest.count(), MOST_READERS))
    files = files.select("path", (F.col("p") + F.col("w")).cast("bigint").alias("before")).repartition(n, "path")
    return files.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def tokens_round_trip(df: DataFrame, vocabulary: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write a table's token files to the shared folder and describe each document as read back from them.

    A null or empty text is the end id alone; each repeated row is a document
    of its own; an empty table writes nothing; extra columns are not read.
    """
    folder = shared.new_path(df.sparkSession, "tokens")
    manifest = shared.materialise(write_tokens(df, vocabulary, folder, end_id, id_col, text_col), "manifest")
    shared.drop_at_end(df.sparkSession, folder)
    return read_tokens(manifest)

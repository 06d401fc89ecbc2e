"""Point reads of JSON-lines files by an index of byte ranges, as a Spark data source.

The index has the file, offset and length of each record's line by its id. A
query for some ids reads their lines and nothing else of the files:

    pointread.build_index(spark, folder, "doc_id", index)
    pointread.register(spark)
    df = spark.read.format("indexed_jsonl").schema(...).option("path", folder).option("index", index).option("key", "doc_id").load()
    df.filter("doc_id IN (7, 9)")

Without such a filter the files are read whole, in byte ranges of a bounded
size. Many ids are read by :func:`read_ids`, a join with the index. Folders are
paths that pyarrow can open.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from strandline import checks

#: Bytes of a file that one task reads from its start on; a line belongs to the range that it begins in.
RANGE_BYTES = 32_000_000
#: Requested lines of one file that are so near each other are read at once.
GAP_BYTES = 4_096
#: Lines that one task of a point read gets.
LINES = 2_000
_READ = 1_000_000


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


def data_files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of a folder's files without those whose names begin with a dot or an underscore; none is an error."""
    store, place = store_of(path)
    root = store.get_file_info(place)
    if root.type == fs.FileType.File:
        return [(place, root.size)]
    if root.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = sorted((f.path, f.size) for f in store.get_file_info(fs.FileSelector(place, recursive=True)) if f.type == fs.FileType.File and f.base_name[0] not in "._")
    if not found:
        raise FileNotFoundError(f"{path} has no files")
    return found


def lines_of(store: fs.FileSystem, file: str, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line without its end) of the lines that begin in [start, end), blank ones left out."""
    with store.open_input_file(file) as f:
        at = start
        if start:  # the line that holds the byte before belongs to the range before
            at = start - 1
        f.seek(at)
        rest, skip = b"", start > 0
        while True:
            data = f.read(_READ)
            *whole, rest = (rest + data).split(b"\n")
            if not data and rest:
                whole, rest = [*whole, rest], b""
            for line in whole:
                here, at = at, at + len(line) + 1
                if skip:
                    skip = False
                elif here >= end:
                    return
                elif line.strip():
                    yield here, line
            if not data or (at >= end and not skip):
                return


def ranges(path: str, size: int | None = None) -> list[tuple[str, int, int]]:
    """(file, start, end) of the byte ranges of all files."""
    step = size or RANGE_BYTES
    return [(f, at, min(at + step, n)) for f, n in data_files(path) for at in range(0, n, step)]


def build_index(spark: SparkSession, path: str, key: str, index: str) -> DataFrame:
    """Write (key, file, offset, length) of each line, in ranges of the key, and return it. A line without the key and a repeated key are errors."""
    plan = ranges(path)
    parts = spark.createDataFrame(plan, "file string, start bigint, stop bigint").repartition(len(plan), "file", "start")
    local = path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = store_of(local)
        for b in batches:
            for file, start, stop in zip(*(b.column(c).to_pylist() for c in ("file", "start", "stop")), strict=True):
                rows = [(json.loads(line)[key], file, at, len(line)) for at, line in lines_of(store, file, start, stop)]
                cols = list(zip(*rows, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array([str(x) for x in cols[0]], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], names=["key", "file", "offset", "length"])

    found = parts.mapInArrow(run, "key string, file string, offset bigint, length bigint")
    found.repartitionByRange("key").sortWithinPartitions("key").write.parquet(index)
    made = spark.read.parquet(index)
    checks.require_unique(made, f"index of {path}", "key")
    return made


@dataclass
class Lines(InputPartition):
    """Byte ranges of one file: of whole lines asked for, each with its key, or from ``start`` to ``stop``."""

    file: str
    spans: tuple[tuple[int, int, str], ...] = ()
    start: int = 0
    stop: int = 0


def read_spans(store: fs.FileSystem, file: str, spans: Iterable[tuple[int, int, str]], key: str) -> Iterator[dict]:
    """Records of (offset, length, key), in order; near ones by one read. A record of another key is an error."""
    near: list[tuple[int, int, str]] = []

    def records() -> Iterator[dict]:
        f.seek(near[0][0])
        data = f.read(near[-1][0] + near[-1][1] - near[0][0])
        for at, n, k in near:
            got = json.loads(data[at - near[0][0] : at - near[0][0] + n])
            if str(got.get(key)) != k:
                raise ValueError(f"the index of {file} is not of this file: {k} is not at {at}")
            yield got

    with store.open_input_file(file) as f:
        for span in sorted(spans):
            if near and (span[0] - (near[-1][0] + near[-1][1]) > GAP_BYTES or span[0] - near[0][0] > RANGE_BYTES):
                yield from records()
                near.clear()
            near.append(span)
        if near:
            yield from records()


class Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.path, self.index, self.key = options["path"], options["index"], options["key"]
        self.names = schema.fieldNames()
        self.schema = to_arrow_schema(schema)
        self.wanted: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes equality with, and membership of, the key; Spark applies all other filters to what is read."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and tuple(f.attribute) == (self.key,):
                mine = {str(x) for x in ((f.value,) if isinstance(f, EqualTo) else f.value) if x is not None}
                self.wanted = mine if self.wanted is None else self.wanted & mine
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        if self.wanted is None:
            return [Lines(f, start=a, stop=b) for f, a, b in ranges(self.path)]
        if not self.wanted:
            return [Lines("")]
        store, place = store_of(self.index)
        table = ds.dataset(place, filesystem=store, format="parquet").to_table(filter=ds.field("key").isin(pa.array(sorted(self.wanted), pa.string())))
        by: dict[str, list[tuple[int, int, str]]] = {}
        for r in table.to_pylist():
            by.setdefault(r["file"], []).append((r["offset"], r["length"], r["key"]))
        return [Lines(f, tuple(sorted(x)[i : i + LINES])) for f, x in sorted(by.items()) for i in range(0, len(x), LINES)] or [Lines("")]

    def read(self, partition: Lines) -> Iterator[pa.RecordBatch]:
        store, _ = store_of(self.path)
        if partition.spans:
            rows = read_spans(store, partition.file, partition.spans, self.key)
        else:
            rows = (json.loads(x) for _, x in lines_of(store, partition.file, partition.start, partition.stop)) if partition.file else iter(())
        held: list[dict] = []
        for r in rows:
            held.append({k: r.get(k) for k in self.names})
            if len(held) == 1_000:
                yield pa.RecordBatch.from_pylist(held, schema=self.schema)
                held = []
        if held or not partition.file:
            yield pa.RecordBatch.from_pylist(held, schema=self.schema)


class IndexedJsonl(DataSource):
    """Options: path, index (of :func:`build_index`), key (the id's field). The schema has to be given."""

    @classmethod
    def name(cls) -> str:
        return "indexed_jsonl"

    def reader(self, schema: StructType) -> Reader:
        return Reader(schema, self.options)


def register(spark: SparkSession) -> None:
    """Make ``indexed_jsonl`` known to the session, and let filters reach it."""
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # it is planned in a worker that may not have this package
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(IndexedJsonl)


def read_ids(spark: SparkSession, ids: DataFrame, path: str, index: str, key: str, schema: str) -> DataFrame:
    """The records of many ids, a column named as the key, each once; an id that the index lacks is an error.

    Ids meet the index in a shuffle join. Each task gets lines of few files and
    reads them in order. Repeated and null ids ask for nothing more.
    """
    asked = ids.select(F.col(key).cast("string").alias("key")).filter("key is not null").distinct()
    found = asked.join(spark.read.parquet(index), "key", "left")
    checks.require(found, f"ids of {path}", missing=F.col("file").isNull())
    made = StructType([f for f in StructType.fromDDL(schema)])
    arrow = to_arrow_schema(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = store_of(path)
        for b in batches:
            by: dict[str, list[tuple[int, int, str]]] = {}
            for r in b.to_pylist():
                by.setdefault(r["file"], []).append((r["offset"], r["length"], r["key"]))
            for file, spans in by.items():
                held = [{k: x.get(k) for k in arrow.names} for x in read_spans(store, file, spans, key)]
                yield pa.RecordBatch.from_pylist(held, schema=arrow)

    near = found.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    return near.mapInArrow(run, made)

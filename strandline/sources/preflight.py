"""Digests of input files that are made once: a file of the size and time of an earlier manifest is not read again."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline import runtime
from strandline.sources import pointread

#: Files whose content one job reads.
FILES = 5_000
#: Bytes of a file up to which a task holds it whole; a longer one is read in pieces.
WHOLE = 32_000_000
PIECE = 4_000_000
MANIFEST = "path string, size bigint, modified timestamp, settings string, sha256 string"


def listing(spark: SparkSession, path: str) -> DataFrame:
    """path, size, modified of all files of a path, by the hidden columns of the scan: no content is read. A path without files is an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("modified"))


def digests(files: DataFrame) -> DataFrame:
    """path, length, sha256 of each file of a ``binaryFile`` scan.

    Files of up to ``WHOLE`` bytes are digested by the scan. Of longer ones the
    scan reads no content; a task reads them in pieces, by paths that pyarrow
    can open.
    """
    piece = PIECE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for path in b.column("path").to_pylist():
                store, place = pointread.store_of(path)
                sha = hashlib.sha256()
                with store.open_input_file(place) as f:
                    while data := f.read(piece):
                        sha.update(data)
                found.append(sha.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("path"), b.column("length"), pa.array(found, pa.string())], names=["path", "length", "sha256"])

    path = F.col("_metadata.file_path").alias("path")
    whole = files.filter(F.col("length") <= WHOLE).select(path, "length", F.sha2("content", 256).alias("sha256"))
    return whole.unionByName(files.filter(F.col("length") > WHOLE).select(path, "length").mapInArrow(run, "path string, length bigint, sha256 string"))


def _latest(spark: SparkSession, manifests: str) -> int:
    if not runtime.exists(spark, manifests):
        return -1
    store, place = runtime.hadoop(spark, manifests)
    done = [f.getPath() for f in store.listStatus(place) if store.exists(runtime.hadoop(spark, f"{f.getPath()}/_SUCCESS")[1])]
    return max((int(p.getName().split("-")[1]) for p in done), default=-1)


def preflight(spark: SparkSession, path: str, manifests: str, settings: str = "") -> DataFrame:
    """path, size, modified, settings, sha256, reused of each file; only files that are new, changed, or digested under other settings are read.

    The manifest of each run is a folder of its own, which counts once it is
    whole; the newest is the one that the next run starts from. No task holds
    more than ``WHOLE`` bytes of a file. Files that are gone leave the manifest.
    """
    before = _latest(spark, manifests)
    known = spark.read.schema(MANIFEST).parquet(f"{manifests}/run-{before}") if before >= 0 else spark.createDataFrame([], MANIFEST)
    here = runtime.materialise(listing(spark, path).withColumn("settings", F.lit(settings)), "listing")
    key = ["path", "size", "modified", "settings"]
    kept = here.join(known, key).withColumn("reused", F.lit(True))
    # names of files, which the driver has listed to plan the scan
    changed = [r.path for r in here.join(known, key, "left_anti").select("path").collect()]
    out = kept
    for at in range(0, len(changed), FILES):
        content = digests(spark.read.format("binaryFile").load(changed[at : at + FILES])).select("path", "sha256")
        out = out.unionByName(here.join(content, "path").select(*key, "sha256", F.lit(False).alias("reused")))
    made = f"{manifests}/run-{before + 1}"
    out.write.mode("overwrite").parquet(made)
    return spark.read.schema(f"{MANIFEST}, reused boolean").parquet(made)

"""Incremental output that can be resumed: each record is written once, however often it arrives."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandline import checks, runtime


#: Record indices of one bucket of the key index; an index is there once, so a bucket has no more entries.
BUCKET = 4_096
#: Beyond so many buckets a batch reads the whole key index rather than their folders one by one.
MOST_BUCKETS = 5_000


class RecordSink:
    """A folder of records keyed by (sample_index, sample_key).

    A record that is there already is passed over; an index with another key is
    an error. An existing folder is refused unless ``resume`` is set.

    Records lie in a folder a batch. Beside them is an index of their keys, in
    buckets of neighbouring indices: a batch reads the buckets that it touches
    and never the records. A batch counts once its mark is written, which is
    last; what a failed batch left behind is overwritten when it runs again, and
    passed over until then.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, resume: bool = False, index: str = "sample_index", key: str = "sample_key"):
        if runtime.exists(spark, path) and not resume:
            raise FileExistsError(f"{path} holds records; say resume to add to it")
        self._spark, self.path, self._schema, self._index, self._key = spark, path, schema, index, key

    def _batches(self, what: str) -> set[str]:
        """Names of the batches that have a folder of records, or a mark."""
        store, place = runtime.hadoop(self._spark, f"{self.path}/{what}")
        return {f.getPath().getName() for f in store.listStatus(place)} if store.exists(place) else set()

    def _read(self, folder: str, paths: list[str], schema: str) -> DataFrame:
        rows = self._spark.read.schema(schema).option("basePath", folder).parquet(*paths)
        unfinished = [b.split("=")[1] for b in self._batches("records") - self._batches("done")]
        return rows.filter(~F.col("batch").isin(unfinished)) if unfinished else rows

    def records(self) -> DataFrame:
        """The records of all finished batches."""
        if not self._batches("done"):
            return self._spark.createDataFrame([], self._schema)
        folder = f"{self.path}/records"
        return self._read(folder, [folder], f"{self._schema}, batch string").drop("batch")

    def _keys(self, buckets: list[int]) -> DataFrame:
        """(__i, __k) of the finished batches in some buckets; bounds of a folder's listing are those of the batch."""
        folder = f"{self.path}/keys"
        paths = [folder] if len(buckets) > MOST_BUCKETS else [f"{folder}/bucket={b}" for b in buckets]
        paths = [p for p in paths if runtime.exists(self._spark, p)]
        if not paths:
            return self._spark.createDataFrame([], "__i bigint, __k string")
        return self._read(folder, paths, "__i bigint, __k string, bucket bigint, batch string").select("__i", "__k")

    def append(self, batch: DataFrame, batch_id: int | str | None = None) -> int:
        """Add the batch's new records; returns how many there were.

        A batch whose id is finished adds nothing. Without an id a batch takes
        the next number. Records without an index are an error.
        """
        done = self._batches("done")
        if batch_id is None:
            batch_id = f"n{len(done)}"
        name = f"batch={batch_id}"
        if name in done:
            return 0
        once = batch.groupBy(self._index).agg(F.min(F.struct(*batch.columns)).alias("r"), F.min(self._key).alias("__k0"), F.max(self._key).alias("__k1"))
        once = runtime.materialise(once.select("r.*", "__k0", "__k1"), "batch")
        at = F.col(self._index)
        bucket = F.floor(at / BUCKET).cast("bigint")
        checks.require(once, "records", no_index=at.isNull(), index_has_two_keys=~F.col("__k0").eqNullSafe(F.col("__k1")))
        once = once.drop("__k0", "__k1")
        touched = [r[0] for r in once.select(bucket.alias("b")).distinct().limit(MOST_BUCKETS + 1).collect()]
        joined = once.join(self._keys(touched), at == F.col("__i"), "left")
        checks.require(joined, "records", index_has_another_key=F.col("__i").isNotNull() & ~F.col("__k").eqNullSafe(F.col(self._key)))
        new = joined.filter("__i is null").select(batch.columns)
        place = f"{self.path}/records/{name}"
        # keys go first: whatever has records has its keys
        keys = new.select(at.cast("bigint").alias("__i"), F.col(self._key).alias("__k"), bucket.alias("bucket"), F.lit(str(batch_id)).alias("batch"))
        self._mark("records", name)
        keys.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(f"{self.path}/keys")
        new.write.mode("overwrite").parquet(place)
        added = self._spark.read.schema(self._schema).parquet(place).count()
        self._mark("done", name)
        runtime.drop(self._spark, once)
        return added

    def _mark(self, what: str, name: str) -> None:
        store, place = runtime.hadoop(self._spark, f"{self.path}/{what}/{name}")
        store.mkdirs(place)

    def contiguous(self) -> int:
        """The number of records, if their indices run from 0 without a gap."""
        return checks.require_contiguous(self.records(), "records", self._index)

    def resume_point(self, rollouts: int, batch_size: int) -> int:
        """Samples that are done: a whole number of prompts' rollouts and of batches, or an error."""
        n = self.contiguous()
        if n % rollouts or n // rollouts % batch_size:
            raise checks.CheckFailed(f"{n} records are no whole number of batches")
        return n


def stream_records(spark: SparkSession, source: str, schema: str, sink: RecordSink, checkpoint: str) -> StreamingQuery:
    """Read JSON files as they appear and add their records, until all that is there is read.

    The checkpoint remembers which files were read; a micro-batch that runs
    again after a failure adds nothing twice, as the sink knows its keys.
    """
    rows = spark.readStream.schema(schema).option("mode", "FAILFAST").json(source)
    name = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]  # batches are numbered by checkpoint
    return rows.writeStream.foreachBatch(lambda batch, number: sink.append(batch, f"{name}-{number}") and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def finished(sink: RecordSink, expected: int) -> DataFrame:
    """The records, if there are as many as expected."""
    n = sink.contiguous()
    if n != expected:
        raise checks.CheckFailed(f"{n} of {expected} records")
    return sink.records()


def result_cache(requests: DataFrame, cache: DataFrame, key: str = "request_key") -> tuple[DataFrame, DataFrame]:
    """(answered requests, distinct requests still to run): equal requests run once, and failures are never cached."""
    good = cache.filter("not failed")
    hit = requests.join(good, key)
    return hit, requests.join(good.select(key), key, "left_anti").dropDuplicates([key])

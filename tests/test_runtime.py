"""Tables that cut lineage."""

from pyspark.sql import functions as F

from strandline import runtime


def test_shuffles_of_a_table_are_gone_when_it_is_there(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    had = spark.conf.get(name, None)
    disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    files = lambda: {x for x in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in x}
    before = files()
    df = spark.range(10_000).withColumn("k", F.col("id") % 7)
    joined = df.groupBy("k").agg(F.sum("id").alias("s")).join(df.repartition(3, "k"), "k")
    made = runtime.materialise(joined, "sums")
    assert made.count() == 10_000 and joined.count() == 10_000
    kept = runtime.materialise(joined, "sums")
    assert kept.agg(F.sum("s")).first() == made.agg(F.sum("s")).first()
    runtime.drop(spark, made, kept)
    assert spark.conf.get(name, None) == had
    before |= files()
    again = runtime.materialise(joined.groupBy("s").count(), "sums")
    assert not files() - before
    runtime.drop(spark, again)

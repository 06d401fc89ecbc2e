"""Images as pixels, decoded by Spark's own image source in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# the source gives rows of blue, green and red samples, one grey sample, or four with alpha
_TO_RGB = {1: (r"(..)", "$1$1$1"), 3: (r"(..)(..)(..)", "$3$2$1"), 4: (r"(..)(..)(..)..", "$3$2$1")}


def rgb(image: Column) -> Column:
    """The red, green and blue samples of an image of the source, row by row; alpha is left out."""
    out = F.lit(None).cast("binary")
    for channels, (samples, order) in _TO_RGB.items():
        out = F.when(image["nChannels"] == channels, F.unhex(F.regexp_replace(F.hex(image["data"]), samples, order))).otherwise(out)
    return out


def pixel_sha256(width: Column, height: Column, pixels: Column) -> Column:
    """sha256 of RGB samples after a header with the dimensions: equal pixels have one digest, whatever file they come from."""
    nul = F.lit("\0")
    header = F.concat(F.lit("RGB"), nul, width.cast("string"), nul, height.cast("string"), nul)
    return F.sha2(F.concat(F.encode(header, "UTF-8"), pixels), 256)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """path, width, height, pixels (RGB), sha256 of each file of a folder; of a damaged file, or one that is no image, all but the path are null."""
    files = spark.read.format("image").option("dropInvalid", False).load(path)
    good = F.col("image.nChannels").isin(*_TO_RGB) & (F.col("image.height") > 0)
    of = lambda c: F.when(good, c)
    made = files.select(F.col("image.origin").alias("path"), of(F.col("image.width")).alias("width"), of(F.col("image.height")).alias("height"), of(rgb(F.col("image"))).alias("pixels"))
    return made.withColumn("sha256", pixel_sha256(F.col("width"), F.col("height"), F.col("pixels")))

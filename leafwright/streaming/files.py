"""Uploads as a stream: files that arrive in a folder, with the gate of sources.pages.files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwright.sources.pages import MAX_BYTES

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, folder: str, glob: str = "*.{pdf,png,jpg,jpeg,webp}") -> DataFrame:
    found = spark.readStream.format("binaryFile").schema(SCHEMA).option("pathGlobFilter", glob).load(folder)
    return found.select("path", "length", F.when(F.col("length") > MAX_BYTES, "FILE_TOO_LARGE").alias("error_code"))

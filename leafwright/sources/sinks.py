"""The run envelope as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def envelopes(pages: DataFrame, phase: str = "1.0.0") -> DataFrame:
    """doc_id and a JSON text with the pages in order and their sizes."""
    page = F.struct(F.col("page_index").alias("index"), "text", F.length("text").alias("chars"))
    by = pages.groupBy("doc_id").agg(F.sort_array(F.collect_list(page)).alias("pages"))
    body = F.struct(F.lit(phase).alias("phase"), F.struct("pages").alias("results"), F.struct(F.size("pages").alias("pages")).alias("metrics"), F.array().cast("array<string>").alias("errors"))
    return by.select("doc_id", F.to_json(body).alias("envelope"))


def write(pages: DataFrame, path: str, phase: str = "1.0.0") -> None:
    envelopes(pages, phase).select("envelope").write.text(path)

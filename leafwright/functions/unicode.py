"""Unicode normal form C of a column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwright.dialect import SPARK


def normalized(df: DataFrame, column: str = "text") -> DataFrame:
    """df with a column in normal form C; null stays null."""
    return df.withColumn(column, F.expr(SPARK.nfc(f"`{column}`")))

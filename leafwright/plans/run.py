"""Runs an operator, an SQL text with @names for its inputs, on DataFrames."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame


#: Long chains of rules with nested lambdas take more rounds to resolve than the default allows.
ROUNDS, ENOUGH = "spark.sql.analyzer.maxIterations", "2000"


def apply(sql: str, **inputs: DataFrame) -> DataFrame:
    names = {k: f"leafwright_{uuid.uuid4().hex}" for k in inputs}
    spark = next(iter(inputs.values())).sparkSession
    for k, df in inputs.items():
        df.createOrReplaceTempView(names[k])
    before = spark.conf.get(ROUNDS)
    spark.conf.set(ROUNDS, ENOUGH)
    try:
        return spark.sql(re.sub(r"@(\w+)", lambda m: names.get(m[1], m[0]), sql))
    finally:
        spark.conf.set(ROUNDS, before)
        for name in names.values():
            spark.catalog.dropTempView(name)


def inlined(sql: str, **inputs: str) -> str:
    """The same as one text, with SQL for the inputs."""
    return re.sub(r"@(\w+)", lambda m: f"({inputs[m[1]]})" if m[1] in inputs else m[0], sql)

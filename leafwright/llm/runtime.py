"""Tables in the shared folder, partition counts and other things that depend on the session."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of input that one group of a wide step should hold.
TARGET_BYTES = 6 << 20
#: Partitions beyond which a sort or join gains nothing; its partitions spill, groups are never capped.
MOST_PARTITIONS = 100_000
#: A key with more than this share of all rows is hot: there are fewer than 1 / HOT_SHARE of them, whatever the input.
HOT_SHARE = 1 / 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares. Where it is unset, a session of one machine takes a local folder; a cluster
    must name one."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    master = spark.sparkContext.master or ""
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    made = getattr(shared_dir, "made", None)
    if made is None:
        made = shared_dir.made = "file://" + tempfile.mkdtemp(prefix="leafwright-")
    return made


#: With this on, Spark removes the shuffle files of a query when it ends. Written tables need them no more.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """Writes a table into the shared folder and rereads it: later steps survive lost executors without recomputing
    what came before, and the shuffle files behind it go at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/leafwright-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Removes tables made by stored() that no later step reads."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def input_bytes(df: DataFrame) -> int:
    """The size of the files that a plan reads; where Spark does not know it, the bytes of its texts are summed."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size < 1 << 60:
        return size
    texts = [F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)).cast("long") for c, t in df.dtypes if t in ("string", "binary")]
    return int(df.agg(F.sum(sum(texts, F.lit(8 * len(df.columns)).cast("long"))).alias("n")).first().n or 0)


def groups_for(df: DataFrame, target: int = TARGET_BYTES) -> int:
    """A number of groups that follows the input and never falls below the session's own partitions."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(input_bytes(df) / target))


def partitions_for(df: DataFrame, target: int = TARGET_BYTES) -> int:
    """Partitions for a step that spills: as groups_for, up to a count that a driver can plan."""
    return min(groups_for(df, target), MOST_PARTITIONS)


def looked_up(rows: DataFrame, keys: list[str], table: DataFrame, of: list[str], weight: str, total: int, spread: list[str]) -> DataFrame:
    """rows joined with the one row that `table` has for its key, left out where there is none.

    table: `of` name its key columns, `weight` how many rows of `rows` have that key; total: all rows. The keys with
    more than HOT_SHARE of all rows, fewer than 1 / HOT_SHARE, are broadcast; no other key is large enough to make a
    task of its own. spread: columns by which rows of hot keys are dealt in the shuffle that they need no more."""
    values = [c for c in table.columns if c not in of and c != weight]
    hot = table.where(F.col(weight) > F.lit(max(1.0, total * HOT_SHARE)))
    hot = hot.select(*(F.col(c).alias(f"_h{i}") for i, c in enumerate(of)), F.struct(*values).alias("_hot"))
    cold = table.select(*(F.col(c).alias(f"_c{i}") for i, c in enumerate(of)), F.struct(*values).alias("_cold"), F.lit(0).cast("long").alias("_cs"))

    def same(prefix: str) -> Column:
        out = F.lit(True)
        for i, c in enumerate(keys):
            out = out & (F.col(c) == F.col(f"{prefix}{i}"))
        return out

    first = rows.join(F.broadcast(hot), same("_h"), "left").withColumn("_s", F.when(F.col("_hot").isNotNull(), F.xxhash64(*spread)).otherwise(F.lit(0)).cast("long"))
    out = first.join(cold, same("_c") & (F.col("_s") == F.col("_cs")), "left").withColumn("_value", F.coalesce("_hot", "_cold")).where("_value is not null")
    return out.select(*(c for c in rows.columns if c not in values), *(F.col(f"_value.{c}").alias(c) for c in values))



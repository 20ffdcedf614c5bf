"""What the operators share: reading tables, tables in the shared folder, partition sizes, columns of any name."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _file_system(spark: SparkSession, path: str):
    """(file system, path) on the JVM's side."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.  Where the session names none, a local session gets a temporary one that goes when it ends; on a cluster that's an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not where:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="folioscore-")
        spark.sparkContext.setCheckpointDir(where)
        fs, p = _file_system(spark, where)
        fs.deleteOnExit(p)
    return where


def materialise(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, survives lost executors and keeps column pruning.  The folder goes with `release`, or when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/folioscore-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, p = _file_system(spark, path)
    fs.deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def release(df: DataFrame) -> None:
    """Deletes what `materialise` wrote, once nothing reads it any more."""
    fs, p = _file_system(df.sparkSession, df._written)
    fs.delete(p, True)


def plan_bytes(df: DataFrame, column: str = "text") -> int:
    """About how many bytes a plan gives; it sizes partitions only, never results.

    The optimizer knows the bytes of one table that it scans.  Anything else is
    measured by the bytes of a column, since estimates for joins and local rows
    are far off.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    if leaves.size() == 1 and leaves.head().getClass().getSimpleName() == "LogicalRelation":
        return int(str(plan.stats().sizeInBytes()))
    return int(df.agg(F.sum(F.octet_length(column))).first()[0] or 0)


def buckets(df: DataFrame, bytes_each: int, column: str = "text") -> int:
    """A number of hash buckets that grows with the input."""
    return max(8, -(-plan_bytes(df, column) // bytes_each))


def columns(df: DataFrame) -> list[Column]:
    """All columns by their names, dots and backticks in them included."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever the case of its letters."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text and the named columns, without rows that lack an id or a text."""
    return docs.select("doc_id", "text", *more).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())


def keyed_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, text): text_key is a hash that tells the texts of one doc_id apart."""
    return texts(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of docs whose (doc_id, text_key) isn't in gone, all columns kept; rows without an id or a text stay."""
    key = fresh(docs, "text_key")
    keyed = docs.withColumn(key, F.xxhash64("text"))
    left = gone.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct().hint("shuffle_hash")
    on = (keyed["doc_id"].cast("bigint") == left["__id"]) & (keyed[key] == left["__key"]) & keyed["text"].isNotNull()
    return keyed.join(left, on, "left_anti").select(*columns(docs))

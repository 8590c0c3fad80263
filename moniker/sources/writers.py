"""Sinks (K1 to K6): facts, clusters, indexes, patterns and mentions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_facts(facts: DataFrame, path: str) -> None:
    """Adds facts (K1); loads accumulate, and the same fact of two loads counts once where facts are read."""
    facts.write.mode("append").parquet(path)


def scratch(spark: SparkSession) -> str:
    """A new path in the folder of spark.checkpoint.dir, deleted when the driver's JVM ends; where that is unset, in a temporary folder, if all runs on this machine."""
    there, master = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir(), spark.sparkContext.master
    if not there:
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        there = f"file://{tempfile.mkdtemp(prefix='moniker-')}"
    path = f"{there}/scratch-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def entities_json(entities: DataFrame, path: str) -> None:
    """Entities, a JSON object a line."""
    entities.write.mode("overwrite").json(path)


def clusters_json(clusters: DataFrame, path: str) -> None:
    """A dump of clusters, a JSON object a line (K2)."""
    clusters.write.mode("overwrite").json(path)


def mentions_json(mentions: DataFrame, path: str) -> None:
    """Mentions as {"text", "start", "end", "schema"} (K3), besides the document's id."""
    mentions.write.mode("overwrite").json(path)


def _files(spark: SparkSession, path: str):  # noqa: ANN202
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    files, at = _files(spark, path)
    return files.exists(at)


def table(df: DataFrame, path: str, *sort: str) -> None:
    """An index table (K4, K5), sorted by ranges of `sort` so that point lookups skip most row groups. It is written beside and then takes the old one's place, so a job that
    fails leaves the old one."""
    if sort:
        df = df.repartitionByRange(*sort).sortWithinPartitions(*sort)
    beside = f"{path}.{uuid.uuid4().hex}"
    df.write.parquet(beside)
    files, new = _files(df.sparkSession, beside)
    _, old = _files(df.sparkSession, path)
    files.delete(old, True)
    if not files.rename(new, old):
        raise OSError(f"{beside} can't be renamed to {path}")


def patterns_tsv(patterns: DataFrame, path: str) -> None:
    """Lines pattern TAB schema, sorted (K6)."""
    patterns.orderBy("pattern").select(F.concat_ws("\t", "pattern", "schema").alias("value")).write.mode("overwrite").text(path)

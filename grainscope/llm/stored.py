"""Intermediate tables of operators with several rounds: written once, deleted when the next round has read them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from grainscope.session import save_and_reload

#: At the end of a query its exchanges are deleted, not only when the driver's memory is cleaned up.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, path: str) -> DataFrame:
    """``save_and_reload``; what the query shuffled is deleted once the table stands."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        return save_and_reload(df, path)
    finally:
        conf.set(CLEANUP, before)


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete stored tables that no later plan reads."""
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(hadoop).delete(p, True)

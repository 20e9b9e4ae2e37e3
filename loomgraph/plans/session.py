"""Session helpers."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

_INITIAL, _ADVISORY = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
_TABLE_BYTES, _SHUFFLE_BYTES = 4 << 20, 8 << 20


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder that the cluster names, a temporary one only where none is named."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="loomgraph-"))
    return df.checkpoint(eager=True)


def spread(spark: SparkSession, *paths: str) -> None:
    """Let shuffles of these files begin with a partition for every 4 MB of them, and adaptive execution join partitions up to 8 MB only.

    Graph rows unpack to some twenty times their size in a shuffle: with fewer or larger partitions a task's sorts grow with the tables until
    they spill.  What the session has is kept where it is finer.
    """
    hadoop, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm
    size = 0
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        size += path.getFileSystem(hadoop).getContentSummary(path).getLength()
    conf = spark._jsparkSession.sessionState().conf()
    now = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(spark.conf.get(_INITIAL, None) or 0))
    spark.conf.set(_INITIAL, str(max(now, -(-size // _TABLE_BYTES))))
    if jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(conf.getConfString(_ADVISORY)) > _SHUFFLE_BYTES:
        spark.conf.set(_ADVISORY, f"{_SHUFFLE_BYTES}b")

"""Session settings the operators rely on at scale."""

from __future__ import annotations

from pyspark.sql import SparkSession

PARTITION_BYTES = 256 << 20

SETTINGS = {
    # Re-plan at run time: merge small partitions, split skewed ones, and broadcast what
    # turned out small. Splitting is wanted even where it costs one more shuffle, since
    # a single key may hold a large share of a table.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Fail on overflow and on casts that lose information.
    "spark.sql.ansi.enabled": "true",
    # What a task reads of files, and so what it sorts or groups, is bounded well below what its
    # memory holds; Spark's 128 MB of compressed columns may be gigabytes of rows.
    "spark.sql.files.maxPartitionBytes": str(32 << 20),
    # Rows for the few folders of a partitioned write are not sorted first, which spills.
    "spark.sql.maxConcurrentOutputFileWriters": "8",
    # Tables are written several times and read by column: smaller files for a little work.
    "spark.sql.parquet.compression.codec": "zstd",
}


def tune(spark: SparkSession, shuffled_bytes: int | None = None) -> SparkSession:
    """Apply the settings; with ``shuffled_bytes`` also size the shuffles.

    Adaptive execution merges partitions that are too small but does not cut ordinary
    ones, so a large job has to start with enough of them. Small ones are then merged up to
    the size that also suits output files, rather than kept for the sake of parallelism.
    """
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    if shuffled_bytes is not None:
        wanted = -(-shuffled_bytes // PARTITION_BYTES)
        if wanted > int(spark.conf.get("spark.sql.shuffle.partitions")):
            spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", wanted)
            spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", PARTITION_BYTES)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
    return spark

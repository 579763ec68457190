from __future__ import annotations

from terrace.session import SETTINGS, tune

INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"


def test_settings_are_applied(spark):
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "false")
    tune(spark)
    assert {k: spark.conf.get(k) for k in SETTINGS} == SETTINGS


def test_shuffles_grow_with_the_data(spark):
    other = spark.newSession()
    tune(other, shuffled_bytes=1 << 20)
    assert other.conf.get(INITIAL, None) is None
    tune(other, shuffled_bytes=1 << 40)
    assert other.conf.get(INITIAL) == "4096"
    assert other.conf.get(ADVISORY) == str(256 << 20)
    tune(other, shuffled_bytes=1 << 50)
    assert other.conf.get(INITIAL) == str(1 << 22)

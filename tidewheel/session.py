"""The session that the operators expect: UTC, adaptive execution, RocksDB state for streams."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings that hold for every session. Partition counts are left to the cluster's configuration.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def session(master: str | None = None, **more: str) -> SparkSession:
    builder = SparkSession.builder.config(map=SETTINGS | more)
    return (builder.master(master) if master else builder).getOrCreate()


def configure(spark: SparkSession) -> SparkSession:
    """Put the settings into a session that exists already."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark

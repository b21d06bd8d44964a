"""Session settings the engine relies on; all can be set on a running session."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # the corpus queries take smaller batches
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
    # reports want inferred filters, also after a query of the session that did without
    "spark.sql.constraintPropagation.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark

"""Session settings the jobs profit from."""

from __future__ import annotations

from pyspark.sql import SparkSession

RUNTIME_CONF = {
    # The JVM does not compile methods over 8000 bytes. Stages with longer generated methods (wide cleaning
    # projections) run several times faster as separately generated, smaller functions.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def tune(spark: SparkSession) -> SparkSession:
    """Set the settings the session's owner has left at their defaults."""
    given = dict(spark.sparkContext.getConf().getAll())
    for key, value in RUNTIME_CONF.items():
        if key not in given:
            spark.conf.set(key, value)
    return spark

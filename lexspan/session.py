"""Session for tests and the local benchmark; on a cluster the session is given."""

import os

from pyspark.sql import SparkSession


def local_session(cores: str = "8", app: str = "lexspan") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", os.environ.get("LEXSPAN_SHUFFLE", cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark

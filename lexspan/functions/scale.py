"""Helpers that keep joins and lineages safe at scale."""

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def keyed_join(facts: DataFrame, dim: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Equi-join whose `facts` side may hold a third of its rows under one key.

    Both sides reach the join from shuffles that the planner adds itself, because only those can be split:
    adaptive execution measures every partition at run time, reads a hot one in several tasks, and repeats
    only that partition's rows of `dim`. A `dim` under the broadcast threshold is broadcast as usual.
    """
    return facts.join(dim, on, how)


def top_rows(df: DataFrame, by: list[str], order: list[Column], k) -> DataFrame:
    """The first `k` rows per group with their `rank`; each task prunes before the shuffle."""
    from pyspark.sql import Window

    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col("rank") <= k)


def factorised(params: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """params(request_id, keys...) -> (relation(request_id, answer_id), asked(answer_id, keys...)).

    Requests for the same thing share one answer, so that answers grow with what is asked for and the relation with
    the requests, and not with their product.
    """
    marked = params.withColumn("answer_id", F.md5(F.to_json(F.struct(*keys))))
    return marked.select("request_id", "answer_id"), marked.select("answer_id", *keys).distinct()


def each(df: DataFrame, keep: list, array: Column, name: str, pos: str | None = None) -> DataFrame:
    """One row per element of a costly array expression, which is evaluated once.

    A plain explode makes the optimiser add a filter on the array's size that evaluates the
    expression a second time. Elements must not be null.
    """
    if pos is None:
        rows = df.select(*keep, F.explode_outer(array).alias(name))
    else:
        rows = df.select(*keep, F.posexplode_outer(array).alias(pos, name))
    return rows.where(F.col(name).isNotNull())


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: the one the cluster names."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    own = tempfile.mkdtemp(prefix="lexspan-")
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext.getCheckpointDir()


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once as a Parquet table in the shared folder and read it back.

    For results used several times in one job: the lineage is cut, losing an executor costs
    nothing but a re-read, and later readers fetch only the columns they need.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)

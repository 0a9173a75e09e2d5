from pyspark.sql import functions as F

from lexspan.functions import scale


def test_top_rows_prunes_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("g"), "id")
    best = scale.top_rows(df, ["g"], [F.col("id").desc()], 2)
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert sorted((r.g, r.id) for r in best.collect()) == [(0, 96), (0, 99), (1, 94), (1, 97), (2, 95), (2, 98)]


def test_each_keeps_every_element_once(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, None)], "id int, xs array<string>")
    rows = scale.each(df, ["id"], F.col("xs"), "x", pos="pos").collect()
    assert [tuple(r) for r in rows] == [(1, 0, "a"), (1, 1, "b")]


def test_written_table_reads_back(spark):
    df = spark.range(10).withColumn("s", F.lit("x"))
    back = scale.written(df, "t")
    assert back.count() == 10 and "FileScan parquet" in back._jdf.queryExecution().executedPlan().toString()


def test_a_hot_key_is_split_at_run_time(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.shuffle.partitions": "12",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        facts = spark.range(0, 200_000, 1, 8).select("id", F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).alias("k"))
        dim = spark.range(50_000).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
        for how in ("left", "inner", "left_semi", "left_anti"):
            joined = scale.keyed_join(facts, dim, ["k"], how)
            count = len(joined.select("id").collect())
            rows = joined.select("id")
            rows.write.format("noop").mode("overwrite").save()
            assert count == {"left": 200_000, "inner": 125_000, "left_semi": 125_000, "left_anti": 75_000}[how]
        plan_of = scale.keyed_join(facts, dim, ["k"])
        plan_of.collect()
        assert "skew=true" in plan_of._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)

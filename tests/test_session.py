from doclake.session import scratch_dir, spread, stage


def test_staged_tables_go_to_the_scratch_folder(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    assert scratch_dir(spark) == (configured.rstrip("/") if configured else scratch_dir(spark))
    staged = stage(spark.range(10).selectExpr("id", "id % 2 AS k"), "numbers", ["k"])
    assert sorted(tuple(r) for r in staged.collect()) == [(i, i % 2) for i in range(10)]
    assert f"{scratch_dir(spark)}/numbers-" in staged.inputFiles()[0]


def test_only_small_inputs_are_spread(spark):
    small = spark.range(10).coalesce(1)
    assert spread(small).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    # 10**10 rows by estimate: far beyond what fills four cores.
    assert "Repartition" not in spread(spark.range(10**10))._jdf.queryExecution().optimizedPlan().toString()

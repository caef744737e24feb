from chatloom.llm import url_filter


def test_a_levels_plan_is_small(spark):
    """The driver's memory went to plans: a level is one tree of joins, worked through once."""
    rows = [("h", ["a", "x"], 3, 1, 0), ("h", ["b", "x"], 4, 0, 1)]
    tree = spark.createDataFrame(rows, "host string, shape array<string>, pages long, n_block long, n_allow long").withColumn("template", url_filter.F.col("shape"))
    plan = url_filter._changed(tree, 1, url_filter.Settings())._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Join") <= 3 and plan.count("FileScan") <= 4

"""Sizes of tables are counted together: what the driver plans doesn't grow by a product for each table."""

from triplewright.operators import minimize


def test_sizes_are_counted_in_one_grouping(spark):
    before = {"a": spark.range(7), "b": spark.range(0), "c": spark.range(3)}
    after = {"a": spark.range(2), "b": spark.range(0), "c": spark.range(3)}
    report = minimize.size_report(before, after)
    assert sorted(map(tuple, report.collect())) == [("a", 7, 2, 28.5714), ("b", 0, 0, 0.0), ("c", 3, 3, 100.0)]
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "SinglePartition" not in plan

"""CLV reports on values that the fixture does not have."""

from retention.operators import clv as CLV
from retention.plans import registry as R
from conftest import SF_SMALL


def test_customers_without_a_value_have_no_segment(spark):
    rows = [(float(v) if v is not None else None, i % 2) for i, v in enumerate([1, 2, 3, 4, 5, 6, 7, 8, None, None])]
    seg = CLV.assign_quartiles(spark.createDataFrame(rows, "clv double, label int"))
    assert seg.where("clv is null").count() == 2 and seg.count() == 10
    for report in (CLV.churn_by_clv(seg), CLV.segment_clv_share(seg), CLV.quartile_bounds(seg)):
        assert {r.clv_quartile for r in report.collect()} == {"Low", "Medium", "High", "Premium"}
    assert sum(r.share_pct for r in CLV.segment_clv_share(seg).collect()) == 100


def test_no_values_and_equal_values(spark):
    empty = CLV.assign_quartiles(spark.createDataFrame([(None, 1)], "clv double, label int"))
    assert empty.first().clv_quartile is None and CLV.churn_by_clv(empty).count() == 0
    assert CLV.clv_histogram(empty).count() == 0
    same = CLV.assign_quartiles(spark.createDataFrame([(5.0, 1)] * 4, "clv double, label int"))
    assert [r.clv_quartile for r in same.collect()] == ["Low"] * 4


def test_histogram_has_all_bins(spark):
    rows = spark.createDataFrame([(0.0,), (0.1,), (100.0,), (None,)], "clv double")
    got = sorted((r.bin, r.bin_start, r.customers) for r in CLV.clv_histogram(rows).collect())
    assert [g[0] for g in got] == list(range(50)) and got[0][2] == 2 and got[49] == (49, 98.0, 1)
    assert sum(g[2] for g in got) == 3
    flat = CLV.clv_histogram(spark.createDataFrame([(7.0,)] * 3, "clv double")).collect()
    assert len(flat) == 50 and sum(r.customers for r in flat) == 3


def test_edges_are_not_planned_again(spark):
    plan = R.QUERIES["segment_clv_share"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and plan.count("ExistingRDD") <= 1

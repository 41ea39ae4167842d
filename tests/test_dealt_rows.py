"""Costly rows are dealt over all cores, looked up once and counted before they meet other tables."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from folioflow.operators import contracts as C


def test_paths_into_a_result_are_bound_once(spark):
    plan = spark.range(1).select(C.result_errors(F.try_parse_json(F.lit('{"result":{}}'))))._jdf.queryExecution().analyzed().toString()
    assert plan.count("$.result,") == 1 and plan.count("$.extraction,") == 1


@pytest.mark.parametrize("name", ["pipeline_result_errors", "extraction_payload", "validation_payload"])
def test_results_are_dealt_over_all_cores(spark, sf_dir, name):
    assert entry.queries()[name](spark, sf_dir).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_configurations_are_dealt_over_all_cores(spark, sf_dir):
    assert entry.queries()["preflight_failures"](spark, sf_dir).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_drill_rows_are_counted_before_they_meet_the_steps(spark, sf_dir):
    plan = entry.queries()["drill_mismatches"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.index("BroadcastHashJoin") < plan.index("HashAggregate")


@pytest.mark.parametrize("name", ["evaluation_run_metrics", "sample_metrics"])
def test_samples_and_runs_are_dealt_over_all_cores(spark, sf_dir, name):
    assert entry.queries()[name](spark, sf_dir).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism

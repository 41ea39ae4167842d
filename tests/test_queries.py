"""A few queries through the registry and plan shapes."""

import __spark_entry__ as entry


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_filter_and_columns_reach_the_scan(spark, sf_dir):
    from folioflow.sources.tables import table

    plan = table(spark, sf_dir, "orders").filter("o_orderkey > 10").select("o_custkey")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderkey), GreaterThan(o_orderkey,10)]" in plan and "o_totalprice" not in plan


def flow(spark):
    from folioflow.operators.classify import classify
    from folioflow.operators.extract import extract
    from folioflow.operators.validate import validate

    docs = spark.range(10).selectExpr("id AS job_id", "concat('Invoice Number INV-', id) AS text", "0.9D AS ocr_confidence", "false AS fallback_used", "id AS unused")
    return validate(extract(classify(docs)))


def test_document_flow_needs_no_shuffle_and_no_python(spark):
    plan = flow(spark)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_document_flow_makes_only_what_is_asked_for(spark):
    few = flow(spark).select("job_id", "verdict")._jdf.queryExecution().optimizedPlan().toString()
    assert "rule_results" not in few and "missing_recommended_fields" not in few and "strategy_profile" not in few and "unused" not in few
    kept = flow(spark).filter("job_id < 3").select("job_id", "verdict")._jdf.queryExecution().optimizedPlan().toString()
    assert kept.rindex("Filter") > kept.index("Project")  # the filter lies below the stages


def test_small_files_are_dealt_over_all_cores(spark, sf_dir, tmp_path):
    from folioflow.sources.tables import spread, table

    assert "Exchange" in spread(table(spark, sf_dir, "orders"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in spread(table(spark, sf_dir, "orders"), least_bytes=1)._jdf.queryExecution().executedPlan().toString()

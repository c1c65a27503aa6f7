"""Plan checks: filters reach the Parquet scan, stateless plans have no Python
UDF, each message is parsed once, small dimensions are broadcast."""

from pyspark.sql import functions as F

from eddyline.operators.filters import keep_types
from eddyline.plans import catalog, inputs


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_filter_pushed_to_parquet_scan(spark, sf_small):
    ev = inputs.load_table(spark, sf_small, "events")
    plan = _plan(keep_types(ev).select("event_id"))
    assert "PushedFilters: [In(event_type" in plan or "PushedFilters: [IsNotNull(event_type)" in plan
    assert "ReadSchema: struct<event_id:bigint,event_type:string>" in plan


def test_stateless_plan_has_no_python(spark, sf_small):
    plan = _plan(catalog.passthrough_filter(spark, sf_small))
    for op in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas"):
        assert op not in plan


def test_messages_parsed_once(spark, sf_small):
    plan = _plan(catalog.tumbling_count(spark, sf_small))
    assert plan.count("from_json(") == 1


def test_small_dimension_is_broadcast_before_any_fact_shuffle(spark, sf_small):
    df = catalog.enrich_customer(spark, sf_small)
    plan = _plan(df)
    assert "SortMergeJoin" not in plan
    assert plan.count("BroadcastHashJoin") == 2  # nation into customer, dim into events
    assert "Exchange hashpartitioning" not in plan  # the event side is never shuffled


def test_interval_join_keys_on_time_bucket(spark, sf_small):
    plan = _plan(catalog.interval_join(spark, sf_small))
    assert "_b" in plan and ("SortMergeJoin" in plan or "BroadcastHashJoin" in plan)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_typed_inputs_push_type_filters_to_scan(spark, sf_small):
    plan = _plan(catalog.interval_join(spark, sf_small))
    assert "EqualTo(event_type,view)" in plan and "EqualTo(event_type,click)" in plan
    pruned = _plan(catalog.running_count(spark, sf_small))
    assert "from_json" in pruned  # pattern 04 keeps the message decode
    latest = _plan(catalog.latest_per_key(spark, sf_small))
    assert "from_json" not in latest and "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz," \
        "user_id:bigint,event_type:string>" in latest


def test_winner_rows_need_no_sort_aggregate(spark, sf_small):
    for query in (catalog.latest_per_key, catalog.running_last_type, catalog.dedup):
        plan = _plan(query(spark, sf_small))
        assert "SortAggregate" not in plan and "WindowGroupLimit" in plan, query.__name__


def test_session_and_funnel_plans_collect_nothing_by_key(spark, sf_small):
    for query in (catalog.funnel_states, catalog.sessions, catalog.running_count_per_record, catalog.inactivity_alerts):
        plan = _plan(query(spark, sf_small))
        assert "collect_list" not in plan and "Window" not in plan, query.__name__

"""Physical plans: no nested loops or cross products, filters at the scan, pruned top-k."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from weftgraph.catalog import search
from weftgraph.operators import limits as L
from weftgraph.operators import search as S
from weftgraph.plans.views import star_graph

SF = "/root/testdata/sf0.001"
LAZY = ["callers", "api_contracts", "api_map", "load_links", "enclosing_entity", "wildcard_resolve", "impact_counts", "knn_filtered", "ann", "text_search",
        "secret_scan", "scan_summary", "chunk_pieces", "ts_entities", "count_limits", "similar_files", "name_collisions", "line_changes", "context_window",
        "intent_rules", "embed_cache_split", "upsert_nodes", "link_endpoints", "neighbors_d1", "usage_summary"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_nested_loops(spark, name):
    text = plan(entry_point.queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


@pytest.mark.parametrize("name", ["secret_scan", "scan_summary", "redact"])
def test_text_scans_do_not_group(spark, name):
    text = plan(entry_point.queries()[name](spark, SF))
    assert "hashpartitioning" not in text and "Python" not in text


def test_top_k_is_cut_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(entry_point.queries()["last_turns"](spark, SF))
    assert "WindowGroupLimit" in plan(L.limit_counts(entry_point.queries()["session_tail"](spark, SF).select(
        "session_id", "event_id", F.lit("click").alias("resource"), F.current_timestamp().alias("ts")), {"click": 3}))


def test_filters_and_columns_reach_the_scan(spark):
    pool = S.payload_filter(S.choose_repos(search.points(spark, SF), ["front"]), {"node_type": ["kind1"]}).select("vec_id")
    text = pool._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<vec_id:bigint,label:int>" in text
    calls = plan(star_graph(spark, SF).edges.filter("rel_type = 'CALLS'").select("src"))
    assert "PartitionFilters: [isnotnull(rel_type" in calls and "ReadSchema: struct<src:string>" in calls

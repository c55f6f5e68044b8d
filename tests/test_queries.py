"""Every registered query: equal to its SQL, and a plan that holds at scale."""

import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

from __spark_entry__ import entry
from padron.plans import catalogue

SF_DIR = "/root/testdata/sf0.001"
QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()
ROWS_ONLY = {"toxic_classifier", "toxic_model_select"}


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_only_trained_scores_lack_sql():
    assert set(QUERIES) - set(SQL) == ROWS_ONLY and set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    assert compare(spark, con, QUERIES[name], SQL[name], SF_DIR) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - ROWS_ONLY))
def test_plan_has_no_cross_join(spark, name):
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in plan


@pytest.mark.parametrize("name", ["contains_filter", "home_filters", "qa_pairs_eu", "capped_sample", "project_drop"])
def test_scan_reads_needed_columns_only(spark, name):
    unread = {
        "contains_filter": "n_chars", "home_filters": "o_totalprice", "qa_pairs_eu": "l_tax",
        "capped_sample": "text", "project_drop": "p_retailprice",
    }
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    reads = [line for line in plan.splitlines() if "ReadSchema" in line]
    assert reads and not any(unread[name] + ":" in line for line in reads)


def test_rows_only_queries(spark):
    assert QUERIES["toxic_classifier"](spark, SF_DIR).count() > 0
    report = QUERIES["toxic_model_select"](spark, SF_DIR).collect()
    assert len(report) == 5 and sum(r.best for r in report) == 1


HOME = (
    "home_filters home_indicators territory_filter kpi_summary argmax_spend argmin_spend argmax_licences"
    " ranked_regions indicator_table localised_table fallback_fact region_alias_join chat_answer guarded_answer"
).split()


@pytest.mark.parametrize("name", HOME)
def test_year_reaches_the_scan(spark, name):
    spark.conf.set("spark.sql.maxMetadataStringLength", "20000")
    try:
        plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    scans = [line for line in plan.splitlines() if "FileScan" in line and ("o_orderdate" in line or "l_shipdate" in line)]
    assert scans
    for line in scans:
        column = "o_orderdate" if "o_orderdate" in line else "l_shipdate"
        assert f"GreaterThanOrEqual({column},1998-01-01" in line and f"LessThan({column},1999-01-01" in line


@pytest.mark.parametrize("name", ["confusion_matrix", "binary_metrics", "class_report"])
def test_texts_do_not_meet_labels(spark, name):
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.splitlines():
        if "Join Inner" in line:
            assert "text" not in line


def test_trained_score_is_no_worse_than_the_blocklist(spark):
    """Held-out rows of the driver's tables."""
    sf = "/root/testdata/sf0.01"
    report = {r.passes: r for r in QUERIES["toxic_model_select"](spark, sf).collect()}
    best = next(r for r in report.values() if r.best)
    from padron.operators import metrics, moderation, sampling
    from padron.plans.moderation_queries import TERMS, labelled
    from padron.functions.text import fold_long

    rows = sampling.with_split(labelled(spark, sf), ["doc_id"], test_share=0.2).filter("split = 'test'")
    rows = rows.withColumn("folded", fold_long(F.col("text")))
    flag = moderation.lexical_flag(F.col("folded"), TERMS, "word").cast("int")
    rule = metrics.binary_metrics(metrics.confusion_matrix(rows.select("label", flag.alias("pred")))).first()
    assert best.f1 > 0 and best.f1 >= rule.f1


def test_entry(spark):
    assert entry(spark).count() > 0

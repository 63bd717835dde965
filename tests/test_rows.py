"""Long runs, long chains and contexts: nothing grows faster than the document."""

import time

import pytest
from pyspark.sql import functions as F

from anchorite.functions.text import LONG_ENTITY
from anchorite.operators.relations import choose
from anchorite.plans import registry

SF = "/root/testdata/sf0.001"


def test_a_long_run_takes_no_stack(spark):
    run = " ".join(["Ab"] * 4_000)
    text = spark.createDataFrame([(f"- {run} end",)], "t string")
    got = text.select(F.length(F.get(F.regexp_extract_all("t", F.lit(LONG_ENTITY), F.lit(1)), F.lit(0))).alias("n")).first().n
    assert got == len(run)


def test_a_long_chain_is_chosen_step_by_step():
    n, began = 5_000, time.time()
    got = choose({m: [0.9, 0.1] for m in range(n)}, [(m, c, m + 1, c, 0.2) for m in range(n - 1) for c in (0, 1)])
    assert set(got.values()) == {0} and time.time() - began < 15


@pytest.mark.parametrize("name", ["R10_overlap_resolution", "N14_joint_linking"])
def test_python_gets_no_group_a_document(spark, name):
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "InPandas" not in plan and "MapInArrow" in plan


@pytest.mark.parametrize("name", ["M11_local_contexts", "C5_coherence"])
def test_contexts_are_not_shuffled(spark, name):
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan


@pytest.mark.parametrize("name", ["K11_pairwise_similarity", "F16_link_relatedness", "L19_similarity_lookup"])
def test_links_of_a_hub_are_not_joined_with_one_another(spark, name, tmp_path):
    # A hub with n links each way has n * n paths of two links through it; no join may make them.
    n = 1_500
    rows = [(2 * k + s, page, s + 1, number) for k in range(n) for s, pages in enumerate(((k + 1, 0), (0, k + 1))) for number, page in enumerate(pages)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").write.parquet(str(tmp_path / "lineitem.parquet"))
    frame = registry.queries()[name](spark, str(tmp_path))
    assert frame.count() >= n
    plan = frame._jdf.queryExecution()
    frame.collect()
    made, todo = [], [plan.executedPlan()]
    while todo:
        x = todo.pop()
        if "AdaptiveSparkPlan" in x.nodeName():
            x = x.executedPlan()
        if x.nodeName().endswith("QueryStage"):
            x = x.plan()
        if "Join" in x.nodeName() and x.metrics().contains("numOutputRows"):
            made.append(x.metrics().apply("numOutputRows").value())
        todo += [x.children().apply(i) for i in range(x.children().size())]
    assert made and max(made) < 20 * n


@pytest.mark.parametrize(("name", "scans"), [("F12_cosine", 2), ("L11_bm25", 4)])
def test_documents_are_read_a_few_times(spark, name, scans):
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [doc_id") <= scans


@pytest.mark.parametrize("name", ["X1_lexical", "X2_reweighted"])
def test_cosines_join_no_places(spark, name):
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and not [x for x in plan.splitlines() if "Join" in x and "pos#" in x]

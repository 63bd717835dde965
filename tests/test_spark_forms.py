"""Queries over the tokens of documents: nothing is joined or sorted by the place of a token."""

import pytest

from anchorite.plans import registry

SF = "/root/testdata/sf0.001"
#: Queries that read each document once or twice and join it only with tables of surfaces.
BY_ROW = ["E1_outcomes_at_k", "E2_scores_at_k", "E3_bag_of_concepts", "O10_error_report", "O9_training_lines", "M8_long_names", "O10_mistake_counts", "Q6_election", "Q8_exceptions", "Q7_heads", "M10_eligible", "A6_service_labels", "W1_ranker_samples", "M6_merged_spans", "V1_vectors"]


@pytest.mark.parametrize("name", BY_ROW)
def test_tokens_are_not_joined_by_place(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frame = registry.queries()[name](spark, SF)._jdf.queryExecution()
        optimised, plan = frame.optimizedPlan().toString(), frame.executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not [x for x in plan.splitlines() if "Join" in x and "doc_id" in x]
    assert not [x for x in plan.splitlines() if "Window" in x and "doc_id" in x and "pos" in x]
    # No array of words is computed anew in a filter, for each word.
    assert not [x for x in optimised.splitlines() if "Filter" in x and "split(" in x]

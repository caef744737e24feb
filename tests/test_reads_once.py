import pytest

from chatloom.plans.catalogue import QUERIES


@pytest.mark.parametrize("query", ["model_templates", "chat_templates"])
def test_conversations_are_read_once_for_all_templates(spark, query):
    """A union would put all its parts' shares of the shuffle into one task."""
    plan = QUERIES[query](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan") == 1 and "Union" not in plan

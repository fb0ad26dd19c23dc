"""Plan invariants of the library's own queries (checked on the executed plan):
no nested-loop or Cartesian joins, and no Python stage evaluated more often
than intended (a filter on a UDF result pushed below an exchange would
double it)."""
import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL

# Python stages (ArrowEvalPython + MapInPandas) each plan is allowed.
MAX_PYTHON = {"page_text": 1, "first_store": 1, "second_store": 1, "index_stats": 2, "pages_first_store": 1,
              "summaries": 1, "fewshot_predictions": 1, "fewshot_accuracy": 1, "fewshot_best": 1,
              "fewshot_preview": 1, "answers": 1, "search_hits": 2, "search_l2": 2, "vector_search": 1,
              "vector_search_label": 1, "qa_context": 1, "hash_embedding": 1, "lsh_hits": 2, "ivf_hits": 2,
              "pathless_store": 1, "same_model_hits": 4, "single_question": 1, "retriever_hits": 1, "upload_answers": 1}


@pytest.mark.parametrize("name", sorted(E._reference_queries()))
def test_plan_invariants(spark, name):
    p = E._reference_queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in p and "CartesianProduct" not in p
    assert p.count("ArrowEvalPython") + p.count("MapInPandas") <= MAX_PYTHON.get(name, 0), p

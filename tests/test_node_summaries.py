"""What a node says without a model, where its 200 characters end near a line break."""

import pytest

from parlance.operators import tree


@pytest.mark.parametrize("length", [1, 197, 198, 199, 200, 201])
def test_summaries_end_at_any_character(spark, length):
    said = ["x" * (length - len("A: ")), "y", "", "é€"]
    rows = spark.createDataFrame([(1, i, "A", t) for i, t in enumerate(said)], "job_id long, idx long, speaker string, text string")
    (got,) = tree.node_summaries(tree.build(rows, 4), rows).where("node_id = 'T0'").collect()
    assert got.summary == "\n".join("A: " + t for t in said)[:200] + "..."

"""Guards of entity resolution: what stays apart although it looks alike."""

import pytest
from pyspark.sql import functions as F

from corvidex.operators import dedup, linking

APART = [
    ("ADR 0011 record of decisions", "ADR 0013 record of decisions"), ("3.1 Product Goals", "1.1 Product Goals"), ("block3", "block13"),
    ("cranel", "cranelr"), ("ASR1603", "ASR1605"), ("M1", "M1 Pro"), ("client", "client old"), ("extractor", "extractar"), ("pane", "plane"),
    ("Asset Contribution Flow", "Asset Consumption Flow"), ("payment gateway north", "payment gateway south"), ("colour palette table", "color palette table"),
    ("graph builder", "graph builder service"), ("2 before 10 items", "10 items before 2"), ("step 09 of the plan", "step 9 of the plan"),
]
TOGETHER = [
    ("export a read-only snapshot", "export the read-only snapshot"), ("payment gateway", "payment gatewey"), ("payment manager", "payment managr"), ("account manager", "account nanager"),
    ("step 09 of plan", "step 9 of the plan"), ("Payment_Gateway", "payment gateway"), ("extractor", "extarctor"), ("", ""),
]


@pytest.mark.parametrize("a, b", APART)
def test_apart(a, b):
    assert dedup.guarded(a, b) and dedup.guarded(b, a)


@pytest.mark.parametrize("a, b", TOGETHER)
def test_not_kept_apart(a, b):
    assert dedup.guarded(a, b) == dedup.guarded(b, a) is False


def test_buckets_agree_with_the_guards(spark):
    """No pair that the guards let pass lies in buckets of its own for its numbers."""
    labels = sorted({x for pair in APART + TOGETHER for x in pair})
    own = {r["l"]: r["o"] for r in spark.createDataFrame([(x,) for x in labels], "l string").select("l", dedup._must_agree(F.col("l")).alias("o")).collect()}
    assert all(own[a] == own[b] for a in labels for b in labels if not dedup.guarded(a, b))
    assert own["block3"] != own["block13"]


def test_general_labels_link_nothing(spark):
    labels = spark.createDataFrame([(w, i) for i, w in enumerate(("handlers", "Response", "ledger", "abc"))], "label string, id int")
    assert [r["label"] for r in linking.dictionary(labels).collect()] == ["ledger"]

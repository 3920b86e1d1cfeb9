"""Notes on what sessions lack."""

from lawloom.operators.quality import era_notes
from lawloom.plans.quality_queries import ERA_RULES, ERAS, session_rows


def test_eras(spark):
    bills = spark.createDataFrame([("19971998",), ("20012002",), ("20032004",), (None,)], "session_year string")
    history = spark.createDataFrame([("199719980AB1",), ("200120020AB1",)], "bill_id string")
    got = era_notes(session_rows({"bill": bills, "bill_history": history}), ERA_RULES, ERAS).collect()
    assert sorted(map(tuple, got)) == [("19971998", "chiefly chaptered bills"), ("20032004", "no history")]
    analyses = spark.createDataFrame([("200120020AB1",)], "bill_id string")
    got = era_notes(session_rows({"bill": bills, "bill_analysis": analyses}), ERA_RULES).collect()
    assert sorted(map(tuple, got)) == [("19971998", "no analyses"), ("20032004", "no analyses")]

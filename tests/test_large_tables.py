"""What must not grow with the tables in one place: the driver, a task, a folder of shuffles."""

from tallyspark.plans import intake


def test_parties_and_pieces_are_not_broadcast(spark):
    plan = intake.party_match(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan

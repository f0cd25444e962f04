import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from dueward.config import Scope
from dueward.operators import eligibility, readiness
from dueward.operators.roles import FeaturePolicyError, check_features, leakage_audit, select_features
from dueward.operators.silver import typed_requests
from tests.conftest import rows_of

SCOPE = Scope.of("DSNY", "Graffiti", "2024-01-01", "2024-12-31", "2024-06-01T00:00:00Z")


def governed(requests, changes, **kw):
    return eligibility.evaluate_eligibility(typed_requests(requests(changes)), SCOPE, **kw)


@pytest.mark.parametrize("change, reason, flag", [
    ({}, "eligible", None),
    ({"agency": "DOT"}, "outside_selected_scope", "within_selected_scope"),
    ({"agency": None}, "outside_selected_scope", "within_selected_scope"),
    ({"complaint_type": "Noise"}, "outside_selected_scope", "within_selected_scope"),
    ({"created_date": "2023-12-31T23:59:59"}, "outside_selected_scope", "within_selected_scope"),
    ({"created_date": None}, "missing_created_date", "has_created_date"),
    ({"created_date": "junk"}, "missing_created_date", "has_created_date"),
    ({"due_date": None}, "missing_due_date", "has_due_date"),
    ({"closed_date": None}, "missing_closed_date", "has_closed_date"),
    ({"due_date": "2023-12-01"}, "due_before_created", "valid_due_chronology"),
    ({"closed_date": "2023-12-01"}, "closed_before_created", "valid_closed_chronology"),
    ({"status": "Open"}, "excluded_status", "status_allowed"),
    ({"status": None}, "excluded_status", "status_allowed"),
    ({"due_date": "2024-06-02"}, "outcome_not_mature", "outcome_mature"),
])
def test_reason_and_flag(requests, change, reason, flag):
    row = governed(requests, [change]).first()
    assert row["primary_exclusion_reason"] == reason
    assert row["target_eligible"] == (reason == "eligible")
    if flag:
        assert row[flag] is False


def test_boundaries(requests):
    rows = governed(requests, [
        {"due_date": "2024-06-01T00:00:00", "closed_date": "2024-06-01T00:00:00"},
        {"created_date": "2024-12-31T23:59:59", "due_date": "2024-12-31T23:59:59", "closed_date": "2025-01-01"},
    ]).orderBy("unique_key").collect()
    assert rows[0]["target_eligible"] and rows[0]["missed_resolution_target"] == 0
    assert rows[1]["within_selected_scope"]


DUPLICATES = [
    {"unique_key": "a", "source_row_index": "20"}, {"unique_key": "a", "source_row_index": "10"},
    {"unique_key": "b"}, {"unique_key": "b", "closed_date": "2024-01-20"},
    {"unique_key": None}, {"unique_key": None}, {"unique_key": "c", "closed_date": "2024-02-01"},
]


def test_duplicates_and_conflicts(requests):
    df = governed(requests, DUPLICATES)
    found = {r["source_row_index"]: r for r in df.collect()}
    assert found["20"]["is_exact_duplicate"] and not found["10"]["is_exact_duplicate"]
    assert found["0002"]["is_conflicting_duplicate"] and found["0003"]["is_conflicting_duplicate"]
    assert not found["0004"]["is_conflicting_duplicate"] and not found["0005"]["is_exact_duplicate"]
    assert found["0006"]["missed_resolution_target"] == 1


def test_a_hot_key_goes_through_the_one_plan(requests):
    changes = [{"unique_key": "hot", "status": "Closed" if i % 2 else "Open"} for i in range(300)] + [{"unique_key": None}] * 40 + DUPLICATES
    df = governed(requests, changes)
    assert df.where("unique_key = 'hot' AND is_conflicting_duplicate").count() == 300
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "GlobalLimit" not in plan


def test_cube_agrees_with_rows(requests):
    changes = DUPLICATES + [{"status": "Open"}, {"due_date": None}, {"agency": None}, {"created_date": "bad"}]
    typed = typed_requests(requests(changes))
    rows = governed(requests, changes).repartition(5).groupBy("primary_exclusion_reason").count()
    cube = eligibility.exclusion_reasons(eligibility.eligibility_cube(typed, SCOPE))
    assert rows_of(rows) == rows_of(cube, "primary_exclusion_reason", "row_count")
    assert sum(r["row_share"] for r in cube.collect()) == pytest.approx(1.0)


def test_input_is_not_changed(requests):
    raw = requests(DUPLICATES)
    out = eligibility.evaluate_eligibility(typed_requests(raw), SCOPE)
    assert rows_of(raw) == rows_of(out, *raw.columns)


def test_unknown_status_is_an_error_unless_excluded(requests):
    with pytest.raises(PySparkException):
        governed(requests, [{"status": "In Progress"}]).collect()
    assert governed(requests, [{"status": "In Progress"}], on_unknown="exclude").first()["status_allowed"] is False
    assert [r["status"] for r in eligibility.unrecognized_statuses(
        typed_requests(requests([{"status": " In Progress"}, {}]))).collect()] == ["in progress"]
    with pytest.raises(ValueError):
        eligibility.status_policy({"closed"}, {"Closed "})


def test_invariants(requests):
    found = eligibility.invariant_violations(governed(requests, DUPLICATES)).first()
    # Two rows without a key are eligible here; the counter reports them.
    assert found["flag_reason_mismatch"] == 0 and found["eligible_repeated_keys"] == 0
    assert found["eligible_null_keys"] == 2


def test_label_on_flagged_rows(spark):
    df = spark.createDataFrame(
        [("2024-01-10", "2024-01-09", True), ("2024-01-10", "2024-01-10", True), ("2024-01-10", "2024-01-11", True),
         ("2024-01-10", None, False)], "d string, c string, target_eligible boolean"
    ).select(F.col("d").cast("timestamp").alias("due_ts"), F.col("c").cast("timestamp").alias("closed_ts"), "target_eligible")
    assert [r[0] for r in eligibility.build_target(df).select("missed_resolution_target").collect()] == [0, 0, 1, None]
    with pytest.raises(PySparkException):
        eligibility.build_target(df.withColumn("target_eligible", F.lit(True))).collect()


def test_wider_conflict_only_overrides_eligible_rows(requests):
    typed = typed_requests(requests([
        {"unique_key": "a"}, {"unique_key": "a", "descriptor": "Other"}, {"unique_key": "b", "status": "weird"}]))
    cube = readiness.readiness_cube(typed, SCOPE)
    assert rows_of(readiness.candidate_exclusions(cube), "candidate_exclusion_reason", "row_count") == [
        ("conflicting_duplicate_unique_key", 1), ("exact_duplicate_unique_key", 1), ("excluded_status", 1)]
    rules = {r["readiness_rule"]: r for r in readiness.target_readiness(cube).collect()}
    assert rules["is_conflicting_duplicate"]["true_count"] == 2
    assert rules["candidate_target_eligible"]["pass_count"] == 0


def test_feature_gate(spark, requests):
    check_features(["created_date", "agency"])
    check_features(["borough"], approved={"borough"})
    with pytest.raises(FeaturePolicyError) as error:
        check_features(["borough", "closed_date", "mystery"])
    assert all(word in str(error.value) for word in ("borough", "closed_date", "mystery"))
    assert select_features(requests([{}]), ["agency"]).columns == ["agency"]
    audit = {r["column_name"]: r["leakage_status"] for r in leakage_audit(spark, ["agency", "borough", "status", "x"]).collect()}
    assert audit == {"agency": "SAFE", "borough": "CONDITIONAL", "status": "BLOCKED", "x": "BLOCKED"}

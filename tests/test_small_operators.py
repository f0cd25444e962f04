"""Small operators that no registered query exercises."""

from datetime import datetime, timezone

import pytest

from dueward.operators import landing_checks, overview, scope
from dueward.operators.silver import typed_requests, with_row_id
from dueward.schemas import RAW_COLUMNS, ROW_ID, project


def test_projection_keeps_to_the_allow_list(requests):
    raw = requests([{}])
    assert project(raw, ["status", "agency"]).columns == ["status", "agency"]
    for columns in (["status", "status"], ["nothing"]):
        with pytest.raises(ValueError):
            project(raw, columns)
    with pytest.raises(ValueError):
        project(raw.drop("status"), ["status"])


def test_pages_of_a_preview(requests):
    raw = requests([{"unique_key": str(i), "created_date": f"2024-01-0{1 + i % 3}"} for i in range(6)])
    seen = [r["unique_key"] for r in overview.in_source_order(raw).collect()]
    assert seen == ["0", "3", "1", "4", "2", "5"]
    assert [r["unique_key"] for r in overview.page_slice(raw, 2, 3).collect()] == seen[3:5]
    for limit, offset in ((0, 0), (50_001, 0), (1, -1)):
        with pytest.raises(ValueError):
            overview.page_slice(raw, limit, offset)


def test_rows_up_to_the_newest(requests):
    typed = typed_requests(requests([{}, {"created_date": "bad"}, {"created_date": "2024-05-01"}]))
    assert scope.up_to_latest(typed).count() == 2
    assert scope.up_to_latest(typed_requests(requests([{"created_date": "bad"}]))).count() == 0


@pytest.mark.parametrize(("moment", "expected"), [
    ("2024-03-31T23:59:59+00:00", "2024-02-29"), ("2024-04-01T00:00:00+00:00", "2024-03-31"), ("2024-01-15T00:00:00+00:00", "2023-12-31")])
def test_latest_complete_month(moment, expected):
    found = scope.latest_complete_month_end(datetime.fromisoformat(moment).astimezone(timezone.utc))
    assert found.isoformat() == expected


def test_declared_types_must_match(requests):
    scope.check_selected_scope(2, 10, ["a", "b"])
    scope.check_selected_scope(0, 0, [])
    for declared, total, listed in ((1, 10, ["a", "b"]), (0, 3, [])):
        with pytest.raises(ValueError):
            scope.check_selected_scope(declared, total, listed)


def test_strict_loading(requests):
    good = requests([{}, {}])
    assert landing_checks.load_strict(good).count() == 2
    for changes in ([{"unique_key": None}], [{"unique_key": "a"}, {"unique_key": "a"}]):
        with pytest.raises(landing_checks.ExtractionRejected):
            landing_checks.load_strict(requests(changes))


def test_columns_are_listed_in_order(requests):
    found = overview.column_inventory(requests([{}])).collect()
    assert [(r["column_position"], r["column_name"], r["storage_type"]) for r in found][:2] == [
        (1, RAW_COLUMNS[0], "string"), (2, RAW_COLUMNS[1], "string")]


def test_rows_without_identity_get_one(spark, requests, tmp_path):
    requests([{}, {}, {}]).drop(ROW_ID).write.parquet(f"{tmp_path}/plain")
    named = with_row_id(spark.read.parquet(f"{tmp_path}/plain"))
    assert named.select(ROW_ID).distinct().count() == 3
    again = with_row_id(spark.read.parquet(f"{tmp_path}/plain"))
    assert sorted(map(str, named.collect())) == sorted(map(str, again.collect()))

"""Landing to run to validation, on files."""

import json
import os
import tempfile
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from dueward.config import Scope
from dueward.functions.text import nested_text
from dueward.operators import checks, evidence, landing_checks
from dueward.operators.silver import stored_names, typed_requests, with_placeholders
from dueward.plans.ingest import ingest
from dueward.plans.validate import validate
from dueward.schemas import RAW_COLUMNS, ROW_ID, ROW_PLACE
from dueward.sources import runs
from dueward.sources.landing import LandingRejected, read_landed
from dueward.sources.report_tables import VALIDATION_TABLES, run_audited, write_tables
from dueward.sources.scope_files import ScopeRejected, approved, read_scope
from tests.conftest import BASE

SCOPE = Scope.of("DSNY", "Graffiti", "2024-01-01", "2024-12-31", "2025-06-01T00:00:00Z")
STARTED = datetime(2025, 6, 1, 12, tzinfo=timezone.utc)


def land(folder, pages, limit):
    for i, page in enumerate(pages):
        path = f"{folder}/page_number={i + 1}/offset={i * limit}/requested_limit={limit}"
        os.makedirs(path)
        with open(f"{path}/page.json", "w") as f:
            json.dump(page, f)


def sparse(**change):
    return {k: v for k, v in {**BASE, **change}.items() if v is not None}


def test_ingest_once_and_only_once(spark):
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    land(f"{root}/pages", [
        [sparse(unique_key="1", status=" Closed "), sparse(unique_key="2")],
        [sparse(unique_key="2", created_date="2024-01-02T00:00:00.000")]], 2)
    landed = read_landed(spark, f"{root}/pages")
    assert [r["column_name"] for r in landing_checks.never_present_columns(landed).collect()] == ["descriptor_2"]
    kw = dict(preflight=3, postflight=3, source="test", authority_path="authority.csv", started_at=STARTED)
    paths = ingest(spark, f"{root}/pages", f"{root}/runs", SCOPE, report_root=f"{root}/reports", **kw)
    raw, manifest = runs.read_run(spark, f"{root}/runs", paths.extraction_date, paths.run_id)
    assert manifest["page_row_counts"] == [2, 1] and manifest["page_count"] == 2
    assert manifest["duplicate_unique_key_count"] == 1 and manifest["unique_key_count"] == 2
    assert raw.columns == [*RAW_COLUMNS, ROW_ID, ROW_PLACE]
    assert raw.where("unique_key = '1'").first()["status"] == " Closed "
    with pytest.raises(runs.RunExists):
        ingest(spark, f"{root}/pages", f"{root}/runs", SCOPE, overwrite=True, **kw)
    newest = runs.latest_run(runs.read_manifests(spark, f"{root}/runs")).first()
    assert newest["folder_run_id"] == paths.run_id
    assert all(r["passed"] for r in runs.manifest_check(runs.read_manifests(spark, f"{root}/runs")).collect())
    assert runs.file_fingerprint(spark, paths.data).first()["files"] >= 1


def test_failed_gate_and_broken_pages_store_nothing(spark):
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    land(f"{root}/pages", [[sparse(unique_key="1"), sparse(unique_key="2", agency="DOT")]], 5)
    kw = dict(source="test", authority_path="a", started_at=STARTED)
    with pytest.raises(landing_checks.ExtractionRejected, match="agency_scope"):
        ingest(spark, f"{root}/pages", f"{root}/runs", SCOPE, preflight=2, postflight=2, **kw)
    assert not [d for d in (os.listdir(f"{root}/runs") if os.path.isdir(f"{root}/runs") else []) if d != "_staging"]
    land(f"{root}/bad", [[sparse(unique_key="2"), sparse(unique_key="1")], [sparse(unique_key="2"), sparse(unique_key="1")]], 2)
    with pytest.raises(landing_checks.ExtractionRejected, match="repeated pages, unstable page order"):
        ingest(spark, f"{root}/bad", f"{root}/runs", SCOPE, preflight=4, postflight=4, **kw)
    assert not [d for d in (os.listdir(f"{root}/runs") if os.path.isdir(f"{root}/runs") else []) if d != "_staging"]


def land_lines(folder, number, records, limit=1_000):
    path = f"{folder}/page_number={number}/offset={(number - 1) * limit}/requested_limit={limit}"
    os.makedirs(path)
    with open(f"{path}/page.jsonl", "w") as f:
        f.writelines(json.dumps(r) + "\n" for r in records)


def test_large_pages_are_split_or_rejected(spark, tmp_path):
    """A gigabyte of an array is turned away by the listing; lines are read in blocks and keep their positions."""
    land_lines(tmp_path / "lines", 1, [{"unique_key": str(k)} for k in range(4_000)], 5_000)
    land_lines(tmp_path / "lines", 2, [], 5_000)
    land(tmp_path / "lines/array", [[{"unique_key": "9"}]], 5_000)
    os.rename(tmp_path / "lines/array/page_number=1", tmp_path / "lines/page_number=3")
    os.rename(tmp_path / "lines/page_number=3/offset=0", tmp_path / "lines/page_number=3/offset=10000")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        rows = read_landed(spark, str(tmp_path / "lines"))
        assert rows.where("page_number = 1").select("record").rdd.getNumPartitions() > 1
        found = {(r.page_number, r.pos): r.unique_key for r in rows.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert found == {**{(1, k): str(k) for k in range(4_000)}, (3, 0): "9"}
    path = tmp_path / "big/page_number=1/offset=0/requested_limit=10"
    os.makedirs(path)
    with open(path / "page.json", "w") as f:
        f.truncate(1 << 30)
    with pytest.raises(LandingRejected, match="1073741824 bytes"):
        read_landed(spark, str(tmp_path / "big"))


def test_absent_keys_nulls_and_values_are_told_apart(spark, tmp_path):
    records = [{"unique_key": "1", "status": None}, {"unique_key": "2", "borough": {"b": 1, "a": [2]}}, {"status": "Open"}]
    land_lines(tmp_path, 1, records)
    found = {r.column_name: (r.objects_without_key, r.explicit_nulls, r.objects_with_key)
             for r in landing_checks.column_presence(read_landed(spark, str(tmp_path))).collect()}
    assert (found["unique_key"], found["status"], found["borough"], found["agency"]) == ((1, 0, 2), (1, 1, 2), (2, 0, 1), (3, 0, 0))
    landed = read_landed(spark, str(tmp_path))
    assert [r.t for r in landed.orderBy("pos").select(nested_text(F.col("borough")).alias("t")).collect()] == [None, '{"a":[2],"b":1}', None]


def test_a_changed_run_is_noticed(spark, requests, tmp_path):
    """Validation reads the raw rows once; rows that differ from those written fail the boundary check."""
    raw = requests([{}, {}])
    paths = runs.run_paths(spark, str(tmp_path / "runs"), SCOPE, STARTED)
    pages = raw.selectExpr("1L AS page_number", "2L AS returned_rows").distinct()
    runs.write_run(raw, lambda stored: runs.build_manifest(
        stored, pages, SCOPE, paths, expected=2, started_at=STARTED, completed_at=STARTED, query_hash="h", source="t",
        authority_path="a", counted_before=STARTED, counted_after=STARTED), "plan", paths)
    seen = runs.stored_fingerprint(spark, paths)
    stored = spark.read.parquet(paths.data)
    assert {k: v for k, v in seen.items() if k != "columns"} == runs.content_fingerprint(stored).first().asDict()
    changed = stored.withColumn("status", F.lit("Changed"))
    changed.write.parquet(str(tmp_path / "other"))
    for name in os.listdir(paths.data):
        os.unlink(f"{paths.data}/{name}")
    for name in os.listdir(tmp_path / "other"):
        os.rename(tmp_path / "other" / name, f"{paths.data}/{name}")
    result = validate(spark, str(tmp_path / "runs"), SCOPE, str(tmp_path / "reports"))
    checks = {r["check_id"]: r["status"] for r in result.tables["validation_checks"].collect()}
    assert checks["boundary.raw_immutable"] == "FAIL" and checks["schema.metadata_row_count"] == "PASS"


def test_order_is_checked_across_chunks_and_pages(spark):
    rows = [(p, i, f"2024-01-{d:02d}", str(i)) for p, days in ((1, [1, 2, 4, 3, 5]), (2, [4, 6, 7, 8, 9])) for i, d in enumerate(days)]
    landed = spark.createDataFrame(rows, "page_number long, pos long, created_date string, unique_key string")
    for chunk in (1, 2, 100):
        found = sorted((r["page_number"], r["pos"]) for r in landing_checks.unstable_order(landed, chunk).collect())
        assert found == [(1, 3), (2, 0)]


def _one_run(spark, raw, root, rows, status="success", writer_paths=None):
    paths = writer_paths or runs.run_paths(spark, root, SCOPE, STARTED)
    pages = raw.selectExpr("1L AS page_number", "unique_key").groupBy("page_number").count().withColumnRenamed("count", "returned_rows")
    runs.write_run(raw, lambda stored: runs.build_manifest(
        stored, pages, SCOPE, paths, expected=rows, started_at=STARTED, completed_at=STARTED, query_hash="h", source="test",
        authority_path="a", page_size=5, counted_before=STARTED, counted_after=STARTED, status=status), "plan", paths)
    return paths


def test_a_second_writer_leaves_the_first_run_alone(spark, requests, tmp_path, monkeypatch):
    root = str(tmp_path)
    raw = requests([{}, {}, {}])
    paths = _one_run(spark, raw, root, 3)
    with pytest.raises(runs.RunExists):
        _one_run(spark, raw, root, 3, writer_paths=paths)
    seen = runs.exists
    monkeypatch.setattr(runs, "exists", lambda s, p: p != paths.folder and seen(s, p))  # both looked before either wrote
    with pytest.raises(runs.RunExists):
        _one_run(spark, raw.limit(2), root, 2, writer_paths=paths)
    monkeypatch.undo()
    stored, manifest = runs.read_run(spark, root, paths.extraction_date, paths.run_id)
    assert stored.count() == 3 and manifest["page_size"] == 5 and manifest["raw_file_size"] > 0
    assert os.listdir(f"{root}/_staging") == []


def test_a_lost_row_or_page_stops_the_commit(spark, requests, tmp_path):
    raw = requests([{}, {}, {}])
    with pytest.raises(runs.RunUnreadable, match="source's count"):
        _one_run(spark, raw, str(tmp_path), 4)
    paths = runs.run_paths(spark, str(tmp_path), SCOPE, STARTED)
    assert not os.path.exists(paths.folder) and os.listdir(f"{tmp_path}/_staging") == []


def test_ten_thousand_and_two_pages_are_continuous(spark):
    pages = spark.range(1, 10_003).selectExpr("id AS page_number", "(id - 1) * 1 AS offset", "1L AS requested_limit", "0L AS pos")
    assert landing_checks.page_continuity(pages).where("is_continuous").count() == 10_002


SCHEMA_CASES = [
    ([], [], None, {}), (["descriptor_2"], [], None, {"required_columns": "FAIL", "metadata_columns": "FAIL", "column_order": "FAIL"}),
    ([], ["extra"], None, {"unexpected_columns": "WARN", "metadata_columns": "FAIL", "column_order": "FAIL"}),
    ([], [], ["unique_key"], {"metadata_columns": "FAIL", "column_order": "FAIL"}),
    (["unique_key"], [], None, {"required_columns": "FAIL", "metadata_columns": "FAIL", "column_order": "FAIL", "identifier_representation": "FAIL"}),
]


@pytest.mark.parametrize(("absent", "extra", "selected", "failed"), SCHEMA_CASES)
def test_schema_checks_see_the_stored_columns(requests, absent, extra, selected, failed):
    raw = requests([{}, {}]).drop(*absent).selectExpr("*", *[f"'x' AS {c}" for c in extra])
    found = {r["check_id"].removeprefix("schema."): r["status"] for r in checks.schema_check_table(raw, 2, selected=selected).collect()}
    assert {k: v for k, v in found.items() if v != "PASS"} == failed


def test_a_missing_column_is_a_finding_and_no_crash(requests):
    raw = requests([{}, {}]).drop("due_date", "latitude", "status")
    manifest = {"retrieved_row_count": 2, "selected_source_columns": list(RAW_COLUMNS)}
    found = {r["check_id"]: r for r in checks.validation_checks(
        evidence.planned(with_placeholders(typed_requests(raw)), SCOPE, SCOPE.extracted_at), SCOPE, manifest, stored=stored_names(raw)).collect()}
    assert found["schema.required_columns"]["status"] == "FAIL" and found["schema.required_columns"]["affected_rows"] == 3
    assert found["missingness.due_date"]["affected_rows"] == 2


DIRTY = [
    {}, {"due_date": None}, {"closed_date": None}, {"created_date": "bad"}, {"due_date": "2023-12-01"},
    {"closed_date": "2023-12-01"}, {"unique_key": "x"}, {"unique_key": "x"}, {"unique_key": "y"},
    {"unique_key": "y", "descriptor": "Other"}, {"status": " closed "}, {"status": "Mystery"},
    {"latitude": None, "longitude": None}, {"latitude": "bad", "incident_zip": "12345.0"},
    {"latitude": "10.0", "longitude": "10.0"},
]


def test_validation_of_a_dirty_run(spark, requests):
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    raw = requests(DIRTY)
    paths = runs.run_paths(spark, f"{root}/runs", SCOPE, STARTED)
    pages = raw.selectExpr("1L AS page_number", "unique_key").groupBy("page_number").count().withColumnRenamed("count", "returned_rows")
    runs.write_run(raw, lambda stored: runs.build_manifest(
        stored, pages, SCOPE, paths, expected=15, started_at=STARTED, completed_at=STARTED, query_hash="h",
        source="test", authority_path="authority.csv", counted_before=STARTED, counted_after=STARTED), "plan", paths)
    result = validate(spark, f"{root}/runs", SCOPE, f"{root}/reports", authority_path="authority.csv")
    assert set(result.tables) == set(VALIDATION_TABLES)
    verdict = result.verdict.first()
    assert verdict["overall_status"] == "CRITICAL" and verdict["gate_code"] == 2
    duplicates = {r["metric"]: r["row_count"] for r in result.tables["duplicate_summary"].collect()}
    assert duplicates["redundant_exact_duplicate_rows"] == 1 and duplicates["conflicting_duplicate_keys"] == 1
    assert sum(r["row_count"] for r in result.tables["candidate_exclusion_reason_summary"].collect()) == 15
    checks = {r["check_id"]: r for r in result.tables["validation_checks"].collect()}
    assert checks["boundary.raw_immutable"]["status"] == "PASS"
    assert checks["schema.metadata_row_count"]["status"] == "PASS"
    assert checks["timestamp.created_date"]["status"] == "FAIL"
    assert checks["status.unexpected"]["affected_rows"] == 1
    assert checks["geography.coordinate_pair.outside_nyc_bounding_box"]["affected_rows"] == 1
    assert checks["geography.incident_zip.decimal_like"]["affected_rows"] == 1
    variants = result.tables["category_variants"].collect()
    assert [(r["column_name"], r["variant_type"]) for r in variants] == [("status", "case")] * 2
    assert os.path.isdir(f"{root}/reports/csv/validation_checks")


def test_scope_authority(spark):
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    with open(f"{root}/authority.csv", "w") as f:
        f.write("decision_status,selected_agency,selected_complaint_type,selected_start_date,selected_end_date,extraction_timestamp\n"
                "APPROVED,DSNY,Graffiti,2024-01-01,2024-12-31,2025-06-01T00:00:00+00:00\n")
    for name, agency in (("good", "DSNY"), ("bad", "DOT")):
        with open(f"{root}/{name}.csv", "w") as f:
            f.write(f"source,dataset_identifier,extraction_timestamp,agency\nx,y,2025-06-01,{agency}\n")
    assert approved(read_scope(spark, f"{root}/authority.csv", f"{root}/good.csv")) == SCOPE
    with pytest.raises(ScopeRejected):
        read_scope(spark, f"{root}/authority.csv", f"{root}/bad.csv")
    with pytest.raises(ScopeRejected):
        approved(Scope.of("a", "b", "2024-01-01", "2024-01-02", "2024-01-01", "REJECTED"))


def test_failed_checks_are_logged_as_unknown(spark, requests, tmp_path):
    def broken():
        raise RuntimeError("no result")
    root = str(tmp_path)
    results, audit = run_audited(
        spark, {"fine": ("x", lambda: requests([{}, {}])), "broken": ("x", broken)}, root, orders={"fine": ("unique_key",)})
    log = {r["query_name"]: (r["status"], r["row_count"]) for r in audit.collect()}
    assert log == {"fine": ("computed", 2), "broken": ("not_computable", None)} and list(results) == ["fine"]
    with pytest.raises(ValueError, match="missing"):
        write_tables({}, ("a",), "/tmp/never-written")

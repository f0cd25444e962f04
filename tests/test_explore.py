"""Overview, audit and feasibility tables on files, and tables stored in order."""

import os
import re
from datetime import datetime, timezone

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from dueward.config import Scope
from dueward.operators import evidence, overview, quality
from dueward.operators.silver import typed_requests
from dueward.plans import explore
from dueward.schemas import RAW_COLUMNS
from dueward.sources.report_tables import AUDIT_TABLES, FEASIBILITY_TABLES, OVERVIEW_TABLES, write_ordered

SCOPE = Scope.of("DSNY", "Graffiti", "2024-01-01", "2024-12-31", "2025-06-01T00:00:00Z")
NOW = datetime(2025, 6, 1, tzinfo=timezone.utc)
ROWS = [
    {}, {"agency": "DOT", "agency_name": "Roads"}, {"agency": "DOT", "agency_name": "Old Roads"}, {"unique_key": "x"}, {"unique_key": "x"},
    {"status": "open", "closed_date": None}, {"status": "Open"}, {"due_date": None}, {"created_date": "bad"}, {"unique_key": None},
    {"borough": None, "incident_zip": "1"}, {"created_date": "2023-12-31T23:00:00.000"},
]


@pytest.fixture(scope="module")
def gathered(spark, requests_module, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("evidence"))
    return evidence.gather(typed_requests(requests_module(ROWS)), root, SCOPE, NOW)


@pytest.fixture(scope="module")
def requests_module(request):
    return request.getfixturevalue("requests")


def in_file_order(path):
    """Rows as a plain reader meets them: files by name, then positions."""
    rows = []
    for name in sorted(n for n in os.listdir(path) if n.endswith(".parquet")):
        rows += pq.read_table(f"{path}/{name}").to_pylist()
    return rows


def test_gathered_evidence_equals_the_planned(gathered, requests_module):
    planned = evidence.planned(typed_requests(requests_module(ROWS)), SCOPE, NOW)
    for name in ("counters", "cells", "keys"):
        a, b = getattr(gathered, name), getattr(planned, name)
        assert sorted(map(str, a.select(*b.columns).collect())) == sorted(map(str, b.collect())), name


def test_stored_rows_are_not_stored_again(spark, gathered, requests_module, tmp_path):
    root, at = str(tmp_path / "evidence"), str(tmp_path / "rows")
    typed_requests(requests_module(ROWS)).write.parquet(at)
    again = evidence.gather(spark.read.parquet(at), root, SCOPE, NOW, rows_stored=True)
    assert not os.path.exists(f"{root}/typed")
    for name in ("counters", "cells", "keys"):
        a, b = getattr(gathered, name), getattr(again, name)
        assert sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect())), name


def test_what_is_missing_is_asked_where_values_are_grouped(spark, requests_module, tmp_path):
    root, at = str(tmp_path / "evidence"), str(tmp_path / "rows")
    odd = [None, "", " ", "\u3000", "null", " N/A ", "Unknown", "nonesuch", "-", "91", "nan", "9e1", "unknown\u00a0"]
    rows = [{c: odd[(i + k) % len(odd)] for k, c in enumerate(RAW_COLUMNS)} for i in range(2 * len(odd))]
    typed_requests(requests_module([*ROWS, *rows, rows[0]])).write.parquet(at)
    rows = spark.read.parquet(at)
    again = evidence.gather(rows, root, SCOPE, NOW, rows_stored=True)
    every = rows.agg(*evidence.counters(SCOPE, NOW))
    assert again.counters.columns == every.columns and again.counters.collect() == every.collect()
    assert again.counters.first()["latitude__null_like"] > 0 and again.counters.first()["unique_key__blank"] > 0
    # one expression for all columns beside the key, and one reading of each coordinate
    cells = evidence.cells(rows, words=("none", "nan"))._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < cells.count("lower(") <= 2
    values = spark.read.schema("kind int, n long, column_name string").parquet(f"{root}/cells")
    plan = evidence.counted(rows, values, SCOPE, NOW)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("as double") == 4  # a reading tells NaN from a number, so it names its cast twice


def test_scans_of_rows_are_small_enough_to_be_compiled(spark, gathered, capsys):
    values = spark.createDataFrame([], "kind int, n long, column_name string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for scan in (evidence.counted(gathered.rows, values, SCOPE, NOW), evidence.cells(gathered.rows, words=("none", "nan")),
                     evidence.key_groups(gathered.rows)):
            scan.explain("codegen")
            sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
            assert sizes and max(sizes) < 8_000, sizes  # larger methods are interpreted
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_keys_shuffle_one_material_hash(gathered):
    keys = evidence.key_groups(gathered.rows)._jdf.queryExecution().executedPlan().toString()
    partial = next(line for line in keys.splitlines() if "partial_min" in line)
    assert partial.count("partial_min") == 9  # the place, seven audited columns, and one hash of all material columns


def test_rows_whose_key_is_their_own_form_one_group(spark, gathered, requests_module, tmp_path):
    root, at = str(tmp_path / "evidence"), str(tmp_path / "rows")
    typed_requests(requests_module([*ROWS, {"unique_key": None}, {"unique_key": "x", "status": "Open"}])).write.parquet(at)
    rows = spark.read.parquet(at)
    # A hash more than needed changes nothing.
    several = rows.where("unique_key = 'x' OR status = 'open'").select(evidence.key_hash().alias("k1")).distinct()
    again = evidence.gather(rows, root, SCOPE, NOW, rows_stored=True, several=several)
    groups = spark.read.parquet(f"{root}/key_groups")
    assert sorted((r.alone, r.n) for r in groups.collect()) == [(False, 1), (False, 2), (False, 3), (True, rows.count() - 6)]
    every = evidence.key_groups(rows)
    assert again.keys.collect() == evidence.key_totals(every).collect()
    plain = evidence.cells(rows, RAW_COLUMNS)
    assert sorted(map(str, again.cells.select("column_name", "n").collect())) == sorted(map(str, plain.select("column_name", "n").collect()))
    key = "column_name = 'unique_key'"
    assert sorted(map(str, again.cells.where(key).select(*plain.columns).collect())) == sorted(map(str, plain.where(key).select(
        "column_name", "h1", "value", "n", "readable", "first_place").collect()))
    with_hashes = evidence.key_groups(rows, evidence.filter_of(evidence.repeated_hashes(rows)))
    assert with_hashes.count() == 3 and every.count() == rows.count() - 3


def test_whole_rows_are_compared_under_keys_that_may_have_equal_ones(spark, requests_module, tmp_path):
    at = str(tmp_path / "rows")
    rows = [*ROWS, {"unique_key": "copy"}, {"unique_key": "copy"}, {"unique_key": "far"}, {"unique_key": "far", "status": "Open"}]
    typed_requests(requests_module(rows)).write.parquet(at)
    rows = spark.read.parquet(at)
    alike = rows.where("unique_key IN ('x', 'copy')").select(evidence.key_hash().alias("k1")).distinct()
    every = evidence.gather(rows, str(tmp_path / "every"), SCOPE, NOW, rows_stored=True)
    held = spark.read.parquet(str(tmp_path / "every" / "several"))
    fewer = evidence.gather(rows, str(tmp_path / "fewer"), SCOPE, NOW, rows_stored=True, held=held, alike=alike)
    for name in ("counters", "cells", "keys"):
        a, b = getattr(every, name), getattr(fewer, name)
        assert sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect())), name


def test_no_raw_text_of_a_profile_is_shuffled(gathered):
    plan = evidence.cells(gathered.rows, texts=())._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan or "first_place" in plan
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert exchanges and all("resolution_description" not in line for line in exchanges)


def test_tables_of_the_three_stages(spark, gathered, tmp_path):
    root = str(tmp_path)
    first = explore.write_overview(gathered, root, source="test", extracted_at="2025-06-01", page_size=10)
    second = explore.write_audit(gathered, root)
    third = explore.write_feasibility(gathered, root, "DSNY")
    assert set(first) == set(OVERVIEW_TABLES) and set(second) == set(AUDIT_TABLES) and set(FEASIBILITY_TABLES) <= set(third)
    for name in (*first, *second, *third):
        assert os.path.isdir(f"{root}/parquet/{name}") and os.path.isdir(f"{root}/csv/{name}")
    log = {r.query_name: (r.status, r.row_count) for r in second["query_audit"].collect()}
    assert log["duplicate_keys"] == ("computed", 1) and all(status == "computed" for status, _ in log.values())
    counts = [r["record_count"] for r in in_file_order(f"{root}/parquet/distribution_agency_summary")]
    assert counts == sorted(counts, reverse=True) and sum(counts) == len(ROWS)
    assert [r["issue_id"] for r in in_file_order(f"{root}/parquet/issue_register")] == [
        f"DQ-{k + 1:04}" for k in range(second["issue_register"].count())]
    inventory = {r.column_name: (r.column_position, r.non_null_count) for r in first["column_inventory"].collect()}
    assert inventory["unique_key"] == (1, len(ROWS) - 1) and inventory["descriptor_2"][1] == 0
    headline = third["target_coverage_headline_status"].first()
    assert (headline.group_count, headline.groups_with_due_dates) == (3, 3)


def test_a_check_that_fails_is_a_finding(spark, gathered, tmp_path, monkeypatch):
    monkeypatch.setattr(quality, "geo_quality", lambda counters: 1 / 0)
    tables = explore.write_audit(gathered, str(tmp_path))
    assert "geographic_quality" not in tables
    found = tables["issue_register"].where("severity = 'not_computable'").collect()
    assert [(r.check_name, r.affected_count) for r in found] == [("geographic_quality", None)]


def test_ordered_tables_read_back_in_order(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(5_000).select((F.col("id") * 7919 % 5000).alias("k"), F.when(F.col("id") % 9 > 0, F.col("id") % 5).alias("g"))
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")  # else so few rows make one file
    try:
        write_ordered(rows.repartition(7), path, (F.asc_nulls_last("g"), F.desc("k")))
    finally:
        spark.conf.unset(coalesce)
    found = in_file_order(path)
    assert [r["place"] for r in found] == list(range(1, 5_001)) and not os.path.exists(f"{path}__sorted")
    assert [(r["g"], r["k"]) for r in found] == sorted(((r.g, r.k) for r in rows.collect()), key=lambda x: (x[0] is None, x[0] or 0, -x[1]))
    assert len([n for n in os.listdir(path) if n.endswith(".parquet")]) > 1


def test_nested_values_are_one_text_whatever_their_key_order(spark):
    df = spark.sql("""SELECT map('b', 1, 'a', 2) AS m, named_struct('z', 1, 'y', array(named_struct('q', 2, 'p', 3))) AS s,
        parse_json('{"b": [1, {"d": 0, "c": null}], "a": 5}') AS v, '{"b": 1, "a": {"d": 2, "c": 3}}' AS t, 'plain' AS u, '{broken' AS x""")
    row = df.select(*[overview.canonical_text(df, c).alias(c) for c in df.columns]).first()
    assert tuple(row) == ('{"a":2,"b":1}', '{"y":[{"p":3,"q":2}],"z":1}', '{"a":5,"b":[1,{"c":null,"d":0}]}',
                          '{"a":{"c":3,"d":2},"b":1}', "plain", "{broken")

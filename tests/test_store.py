"""The request store: layout, month-by-month upkeep, and tables from its states."""

import os
from datetime import date, datetime, timezone

import pytest
from pyspark.sql import functions as F

from dueward.config import Period, ScopeLimits
from dueward.operators import keyed, scope
from dueward.operators.silver import by_creation_month, in_months, read_silver, typed_requests, write_silver
from dueward.plans.select import SELECTION_TABLES, complete_months, select_scope
from dueward.schemas import ROW_ID
from dueward.sources import store
from oracle.sample_tables import service_requests
from tests.conftest import rows_of

AT = datetime(2024, 6, 1, tzinfo=timezone.utc)


def month_of_year(m, n, **change):
    """``n`` rows of a month, the same on every call."""
    return [{"unique_key": f"{m}-{k}", "created_date": f"2024-{m:02}-{1 + k % 27:02}T10:00:00.000", **change} for k in range(n)]


SNAPSHOT = [
    *month_of_year(1, 12), *month_of_year(2, 9), *month_of_year(3, 5, agency="DOT", agency_name="Roads"),
    {"unique_key": "1-3", "created_date": "2024-02-11"}, {"unique_key": "1-3", "created_date": "2024-02-12", "agency": "DOT"},
    {"unique_key": "2-1", "created_date": "2024-02-02T10:00:00.000"}, {"unique_key": None}, {"unique_key": None, "agency": "DOT"},
    {"unique_key": "bad", "created_date": "?"}, {"unique_key": "bad", "created_date": " ", "due_date": "??"},
]


def files(root):
    """Data files by path, with what tells a rewritten file from an old one."""
    found = {}
    for folder, _, names in os.walk(root):
        for n in names:
            if n.endswith(".parquet"):
                path = os.path.join(folder, n)
                found[path.removeprefix(f"{root}/")] = os.stat(path).st_mtime_ns
    return found


def compare(spark, root, raw):
    """Every stored table against the same table made from the snapshot itself."""
    typed = typed_requests(raw)
    silver = by_creation_month(raw)
    columns = [c for c in silver.columns if c != ROW_ID]  # unchanged months keep the row ids of the run that wrote them
    assert rows_of(store.read(spark, root, "silver"), *columns) == rows_of(silver, *columns)
    gold = scope.scope_monthly(typed)
    assert rows_of(store.read(spark, root, "gold"), *gold.columns) == rows_of(gold)
    agencies = scope.agency_summary(typed)
    assert rows_of(store.agency_summary(spark, root), *agencies.columns) == rows_of(agencies)
    diagnostics = scope.scope_diagnostics(typed)
    assert rows_of(store.scope_diagnostics(spark, root), *diagnostics.columns) == rows_of(diagnostics)
    keys = store.key_states(silver)
    several = keys.groupBy("key_hash").agg(F.sum("n").alias("n")).where("n > 1").select("key_hash").collect()
    want = [r for r in rows_of(keys, *store.STATE) if r[3] in {k.key_hash for k in several}]
    assert rows_of(store.read_repeated(spark, root), *store.STATE) == want


def test_a_second_run_rewrites_the_months_that_changed(spark, requests, tmp_path):
    root = str(tmp_path)
    assert store.refresh(requests(SNAPSHOT), root) == [None, date(2024, 1, 1), date(2024, 2, 1), date(2024, 3, 1)]
    compare(spark, root, requests(SNAPSHOT))
    before = files(root)
    assert store.refresh(requests(SNAPSHOT[::-1]), root) == []
    assert files(root) == before
    changed = [{**r, "status": "Open"} if r.get("unique_key") == "2-4" else r for r in SNAPSHOT] + [
        {"unique_key": "3-1", "created_date": "2024-02-20"}, {"unique_key": "1-5", "created_date": "2024-02-21", "agency": "DOT"}]
    assert store.refresh(requests(changed), root) == [date(2024, 2, 1)]
    compare(spark, root, requests(changed))
    monthly = {f: t for f, t in files(root).items() if f.split("/")[0] in ("silver", *store.MONTHLY)}
    for f, t in before.items():
        if f in monthly or f.split("/")[0] in ("silver", *store.MONTHLY):
            assert ("created_month=2024-02-01" in f) == (monthly.get(f) != t), f


def test_months_come_and_go(spark, requests, tmp_path):
    root = str(tmp_path)
    store.refresh(requests(SNAPSHOT), root)
    less = [r for r in SNAPSHOT if "2024-01" not in r.get("created_date", "2024-01")] + month_of_year(5, 3)
    less = [r for r in less if r.get("unique_key") != "bad"]
    assert store.refresh(requests(less), root) == [None, date(2024, 1, 1), date(2024, 5, 1)]
    compare(spark, root, requests(less))
    assert store.refresh(requests(SNAPSHOT), root) == [None, date(2024, 1, 1), date(2024, 5, 1)]
    compare(spark, root, requests(SNAPSHOT))


def test_a_failed_refresh_is_made_up_for(spark, requests, tmp_path, monkeypatch):
    root = str(tmp_path)
    store.refresh(requests(SNAPSHOT), root)
    changed = SNAPSHOT + [{"unique_key": "2-2", "created_date": "2024-03-09"}]
    with monkeypatch.context() as m:
        m.setattr(store, "_repeated", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            store.refresh(requests(changed), root)
    assert store.refresh(requests(changed), root) == [date(2024, 3, 1)]
    compare(spark, root, requests(changed))


def test_files_are_bounded_and_months_pruned(spark, requests, tmp_path):
    raw = requests(month_of_year(1, 400) + month_of_year(2, 40) + month_of_year(3, 3) + [{"created_date": "bad"}] * 5).repartition(16)
    silver = by_creation_month(raw)
    write_silver(silver, str(tmp_path / "s"), rows_per_file=100)
    for m in (1, 2, 3):
        found = [f for f in files(str(tmp_path / "s")) if f"2024-{m:02}" in f]
        n = {1: 400, 2: 40, 3: 3}[m]
        assert len(found) <= -(-n // 100) + 2
    assert max(r["count"] for r in read_silver(spark, str(tmp_path / "s")).groupBy(F.input_file_name()).count().collect()) <= 100
    pruned = in_months(read_silver(spark, str(tmp_path / "s")), date(2024, 2, 1), date(2024, 2, 29))
    assert "PartitionFilters: [isnotnull(created_month" in pruned._jdf.queryExecution().executedPlan().toString()
    assert pruned.count() == 40


def test_a_refresh_shuffles_neither_whole_rows_nor_key_rows(spark, requests, tmp_path, monkeypatch):
    root, written = str(tmp_path), []
    monkeypatch.setattr(store, "by_creation_month", lambda raw: written.append(by_creation_month(raw)) or written[-1])
    store.refresh(requests(SNAPSHOT), root, rows_per_file=4)
    assert "Exchange" not in written[0]._jdf.queryExecution().executedPlan().toString()
    silver = store.read(spark, root, "silver")
    assert max(r["count"] for r in silver.groupBy(F.input_file_name()).count().collect()) <= 4
    assert "Exchange" not in store.MAKE["keys"](silver)._jdf.queryExecution().executedPlan().toString()
    assert store.read(spark, root, "keys").count() == len(SNAPSHOT)
    assert not [f for f in files(f"{root}/_staging")]
    compare(spark, root, requests(SNAPSHOT))


def test_rows_of_repeated_keys_are_picked_where_they_are(spark, requests, tmp_path, monkeypatch):
    root, threshold = str(tmp_path / "store"), "spark.sql.autoBroadcastJoinThreshold"
    store.refresh(requests(SNAPSHOT), root)
    spark.conf.set(threshold, "-1")  # as if the optimizer knew no size
    try:
        found = store._repeated(store.read(spark, root, "keys"), None, [])
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and rows_of(found, *store.STATE) == rows_of(store.read_repeated(spark, root), *store.STATE)
    finally:
        spark.conf.unset(threshold)
    monkeypatch.setattr(keyed, "FILTER_BITS", 1)  # a filter that holds every hash
    full = store._repeated(store.read(spark, root, "keys"), None, [])
    assert full.agg(F.sum("n")).first()[0] == len(SNAPSHOT) and "Window" not in full._jdf.queryExecution().executedPlan().toString()
    counted = [rows_of(store.repeated_rows(f).where("duplicate_unique_key_count > 0")) for f in (full, store.read_repeated(spark, root))]
    assert counted[0] == counted[1] != []
    hashes = [r.k1 for r in store.repeated_hashes(spark, root).collect()]
    assert len(hashes) == 3 and None not in hashes  # '1-3', '2-1' and 'bad'


def test_a_first_run_keeps_its_filter(spark, requests, tmp_path):
    root = str(tmp_path)

    def held():
        hashes = store.repeated_hashes(spark, root)
        return {r.k1 for r in keyed.with_held(hashes, F.col("k1"), store.repeated_filter(spark, root), "held").where("held").collect()}

    store.refresh(requests(SNAPSHOT), root)
    assert "Exchange" not in store.repeated_filter(spark, root)._jdf.queryExecution().executedPlan().toString()
    assert held() == {r.k1 for r in store.repeated_hashes(spark, root).collect()} and len(held()) == 3
    store.refresh(requests(SNAPSHOT + [{"unique_key": "1-7", "created_date": "2024-02-20"}]), root)
    assert held() == {r.k1 for r in store.repeated_hashes(spark, root).collect()} and len(held()) == 4


def test_rows_are_alike_only_within_a_state(spark, requests, tmp_path):
    root, copy = str(tmp_path), {"unique_key": "copy", "created_date": "2024-02-05T10:00:00.000"}
    three = [{"unique_key": "three", "created_date": "2024-02-05T10:00:00.000", "status": s} for s in ("Open", "Closed", "Open")]
    two = [{**three[0], "unique_key": "two"}, {**three[1], "unique_key": "two"}]
    store.refresh(requests([*SNAPSHOT, copy, copy, *three, *two]), root)
    found = {r.k1 for r in store.alike_hashes(spark, root).collect()}
    # two rows that differ are no copies, of three some may be
    assert found == {r.h for r in spark.createDataFrame([("2-1",), ("copy",), ("three",)], "k string").select(F.xxhash64("k").alias("h")).collect()}


def test_many_small_files_make_few_tasks(spark, requests, tmp_path):
    root, conf = str(tmp_path), "spark.sql.files.openCostInBytes"
    store.refresh(requests(month_of_year(1, 300) + month_of_year(2, 300)), root, rows_per_file=5)
    spark.conf.set(conf, str(128 << 20))  # a task per file
    try:
        rows = store.read_rows(spark, root)
        assert store.read(spark, root, "silver").rdd.getNumPartitions() >= 120
        assert rows.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and rows.count() == 600
        plan = in_months(rows, date(2024, 2, 1), date(2024, 2, 29)).select("status")._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(created_month" in plan and "ReadSchema: struct<status:string>" in plan
    finally:
        spark.conf.unset(conf)


def test_a_filter_holds_every_hash_and_few_others(spark):
    hashed = spark.range(40_000).select((F.col("id") % 2 == 0).alias("inside"), F.xxhash64("id").alias("h"))
    found = keyed.hash_filter(hashed.where("inside"), "h")
    looked = keyed.with_held(hashed.unionByName(spark.createDataFrame([(False, None)], "inside boolean, h long")), F.col("h"), found, "held")
    assert looked.columns == ["inside", "h", "held"] and looked.count() == 40_001
    counts = looked.groupBy("inside").agg(F.count_if("held").alias("n"), F.count_if(F.col("h").isNull() & F.col("held")).alias("nulls"))
    by = {r.inside: (r.n, r.nulls) for r in counts.collect()}
    assert by[True] == (20_000, 0) and by[False][0] < 20 and by[False][1] == 0


def test_the_sample_lines_do_not_move_for_customers(spark):
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(threshold, "-1")
    try:
        plan = service_requests(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset(threshold)
    depth = {k: next(line.index("Join") for line in plan.splitlines() if "Join" in line and k in line) for k in ("l_orderkey", "o_custkey")}
    assert depth["o_custkey"] > depth["l_orderkey"]


def test_the_sample_lines_carry_one_text_of_their_part(spark):
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(threshold, "-1")
    try:
        raw = service_requests(spark, "/root/testdata/sf0.001")
        plan = raw._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset(threshold)
    lines = plan[plan.index("Join"):].splitlines()  # below the last join
    assert [line for line in lines if "l_orderkey" in line and "p_texts" in line]
    assert not [line for line in lines if "l_orderkey" in line and "p_name" in line]
    parts = spark.read.parquet("/root/testdata/sf0.001/part.parquet").select("p_type", "p_brand", "p_name").distinct()
    assert raw.select("complaint_type", "descriptor", "location_type").exceptAll(raw.select(
        "complaint_type", "descriptor", "location_type").join(parts, (F.col("complaint_type") == F.col("p_type")) & (
            F.col("descriptor") == F.col("p_brand")) & (F.col("location_type") == F.col("p_name")), "left_semi")).count() == 0


def test_sketches_merge_over_months(spark, requests, tmp_path):
    root = str(tmp_path)
    store.refresh(requests(SNAPSHOT + [{"agency": "NONE", "unique_key": None}]), root)
    counters = store.read(spark, root, "counters")
    found = {r.agency: r.approximate_distinct_keys for r in store.distinct_keys(counters).collect()}
    assert found == {"DSNY": 12 + 9 + 1, "DOT": 6, "NONE": 0}


def test_the_store_needs_no_source_rows(spark, requests, tmp_path):
    root = str(tmp_path)
    store.refresh(requests(SNAPSHOT), root)
    span = Period.of("2024-01-01", "2024-02-29")
    tables = select_scope(spark, root, "DSNY", [span], span, AT, ScopeLimits())
    assert set(tables) == set(SELECTION_TABLES)
    assert sorted((r.agency, r.total_records) for r in tables["agency_summary"].collect()) == [("DOT", 2), ("DOT", 5), ("DSNY", 26)]
    for df in (*tables.values(), store.agency_summary(spark, root), store.scope_diagnostics(spark, root)):
        plan = df._jdf.queryExecution().toString()
        assert "/silver" not in plan and "/keys" not in plan


def test_ranges_end_with_the_latest_complete_month(spark, requests, tmp_path):
    root = str(tmp_path)
    store.refresh(requests(SNAPSHOT), root)
    gold = complete_months(spark, root, datetime(2024, 3, 15, tzinfo=timezone.utc))
    plan = gold._jdf.queryExecution().executedPlan().toString()
    assert "subquery" in plan.lower() and "PartitionFilters: [isnotnull(created_month" in plan
    assert {r.created_month for r in gold.collect()} == {date(2024, 1, 1), date(2024, 2, 1)}
    assert {r.created_month for r in complete_months(spark, root, AT).collect()} == {date(2024, m, 1) for m in (1, 2, 3)}
    empty = scope.up_to_complete_month(store.read(spark, root, "gold"), AT, spark.range(0).selectExpr("max(timestamp_millis(id))"))
    assert empty.collect() == []

"""Registered queries against their SQL twins, and the plans they produce."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registered
from oracle import queries as built
from oracle import settings, sql
from dueward.operators import eligibility, scope
from tests.conftest import SAMPLE

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
COMPARED = (
    "monthly_metrics", "exclusion_reasons", "eligibility_flags", "target_readiness", "duplicate_summary",
    "conflicting_duplicates", "validation_checks", "issue_register", "category_profile", "column_profile",
    "agency_summary", "sensitivity", "candidate_comparison", "unstable_order", "manifest_check",
)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SAMPLE}/{t}.parquet'")
    return connection


def test_every_query_has_a_twin():
    assert set(built.build()) == set(sql.build())


@pytest.mark.parametrize("name", COMPARED)
def test_query_equals_its_twin(spark, duck, name):
    df = registered.queries()[name](spark, SAMPLE)
    names = sorted(df.columns)
    result = duck.execute(registered.oracle_sql()[name])
    found = [d[0] for d in result.description]
    assert sorted(found) == names
    theirs = sorted(([row[found.index(c)] for c in names] for row in result.fetchall()), key=str)
    ours = sorted(([row[c] for c in names] for row in df.collect()), key=str)
    assert ours == theirs


@pytest.mark.parametrize("name", ["validation_checks", "eligibility_flags", "issue_register", "sensitivity"])
def test_no_python_in_the_plan(spark, name):
    plan = registered.queries()[name](spark, SAMPLE)._jdf.queryExecution().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan


def test_rows_are_windowed_only_by_page_or_key(spark):
    """No window over source rows may lack a partition."""
    for df in (eligibility.evaluate_eligibility(built.typed(spark, SAMPLE), settings.SCOPE), built.landed(spark, SAMPLE)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan.replace("TakeOrderedAndProject", "")


def test_sums_reconcile(spark):
    typed = built.typed(spark, SAMPLE)
    total = typed.count()
    cube = eligibility.eligibility_cube(typed, settings.SCOPE)
    assert cube.agg(F.sum("rows")).first()[0] == total
    gold = scope.scope_monthly(typed)
    assert gold.agg(F.sum("total_records")).first()[0] == total
    shuffled = eligibility.eligibility_cube(typed.repartition(7, "agency"), settings.SCOPE)
    assert sorted(map(tuple, eligibility.exclusion_reasons(shuffled).collect())) == sorted(
        map(tuple, eligibility.exclusion_reasons(cube).collect()))

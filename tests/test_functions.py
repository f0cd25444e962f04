from datetime import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from dueward.config import Period
from dueward.functions import numbers, text, time
from dueward.operators import categories, eligibility, reconcile, scope
from oracle import sample_tables


def one(spark, column, **values):
    fields = ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], fields).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("value, expected", [
    ("2024-01-05T12:00:00.000", datetime(2024, 1, 5, 12)), ("2024-01-05T12:00:00Z", datetime(2024, 1, 5, 12)),
    ("2024-01-05T12:00:00+01:00", datetime(2024, 1, 5, 11)), ("01/05/2024", datetime(2024, 1, 5)),
    ("Jan 5 2024", datetime(2024, 1, 5)), ("January 5, 2024", datetime(2024, 1, 5)), ("01-05-2024", datetime(2024, 1, 5)),
    ("01/05/2024 01:02:03 PM", datetime(2024, 1, 5, 13, 2, 3)), ("2024", datetime(2024, 1, 1)),
    ("20240105", datetime(2024, 1, 5)), ("not-a-date", None), ("13/45/2024", None), ("", None), (None, None),
])
def test_mixed_timestamps(spark, value, expected):
    epoch = one(spark, F.unix_seconds(time.parse_timestamp(F.col("v"))), v=value)
    assert epoch == (None if expected is None else int((expected - datetime(1970, 1, 1)).total_seconds()))


def test_offset_and_iso_text(spark):
    assert one(spark, time.is_zoned(F.col("v")), v="2024-01-01T00:00:00+01:00")
    assert not one(spark, time.is_zoned(F.col("v")), v="01-15-2024")
    fraction = time.iso_text(time.parse_timestamp(F.col("v")))
    assert one(spark, fraction, v="2024-01-01T00:00:00.500") == "2024-01-01T00:00:00.500000+00:00"
    assert one(spark, fraction, v="2024-01-01") == "2024-01-01T00:00:00+00:00"


def test_text_forms(spark):
    assert one(spark, text.comparison_form(F.col("v")), v="\t In   Progress\n") == "in progress"
    assert one(spark, text.fold(F.col("v")), v=" A  B ") == "a  b"
    assert one(spark, text.is_blank(F.col("v")), v="  \t")
    assert not one(spark, text.is_blank(F.col("v")), v="")
    assert one(spark, text.truth(F.col("v")), v=" TRUE ") is True
    assert one(spark, text.truth(F.col("v")), v=None) is False
    with pytest.raises(PySparkException):
        one(spark, text.truth(F.col("v")), v="yes")


def test_numbers(spark):
    assert one(spark, numbers.ratio(F.col("a"), F.col("b")), a=1.0, b=0.0) == 0.0
    assert one(spark, numbers.percentage(F.col("a"), F.col("b")), a=1.0, b=0.0) is None
    assert one(spark, numbers.percentage(F.col("a"), F.col("b")), a=1.0, b=3.0) == 33.333333
    assert one(spark, numbers.balance_score(F.col("a")), a=0.25) == 0.5
    assert one(spark, numbers.to_double(F.col("v")), v="NaN") is None


def test_complete_years():
    assert Period.of("2024-01-01", "2025-12-31").complete_years == 2
    assert Period.of("2024-01-02", "2025-12-30").complete_years == 0
    assert Period.of("2024-01-15", "2024-03-01").months == 3


def test_two_summaries_need_one_row_each(spark):
    columns = reconcile.IDENTIFIERS + reconcile.COUNTS + reconcile.RATES
    one = spark.range(1).select(*[F.lit("2024-01-01" if c in ("selected_start_date", "selected_end_date") else "1").alias(c) for c in columns])
    found = reconcile.scope_outputs_check(one, one).collect()
    assert len(found) == len(columns) and all(r["agrees"] for r in found)
    with pytest.raises(reconcile.ScopeMismatch):
        reconcile.scope_outputs_check(one, one.unionByName(one))
    with pytest.raises(reconcile.ScopeMismatch):
        reconcile.scope_outputs_check(one.limit(0), one)


def test_an_empty_status_set_is_not_the_default():
    assert eligibility.status_policy(set(), {"open"}) == ([], ["open"])


def test_an_odd_lot_of_spellings_is_listed_row_by_row(spark):
    counts = spark.createDataFrame([("s", "Open", 3), ("s", "OPEN", 1), ("s", " Open", 2), ("s", "Shut", 9), ("s", None, 4)],
                                   "column_name string, value string, row_count long")
    found = sorted((r["raw_variant"], r["variant_rows"], r["row_count"], r["raw_variant_count"]) for r in categories.category_variants(counts).collect())
    assert found == [(" Open", 2, 6, 3), ("OPEN", 1, 6, 3), ("Open", 3, 6, 3)]
    assert tuple(categories.variant_totals(counts).first()) == (1, 6)


def test_blank_and_null_like_texts_equal_the_plain_rules(spark):
    words = ("null", "N/A", " none ", "-", "?")
    texts = [None, "", " ", "\t\u3000", "\x1c", "\x7f", "null", " NULL ", "\u00a0n/a", "n/a\u2003", "N/A", "none", "nonesuch", "-", "?", "-?",
             "\u00e9", "\u212a", "a long text", " a long text", "\x00", "\u0130"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    plain = text.fold(t).isin([w.strip().lower() for w in words])
    for r in df.select(t, text.is_blank(t).alias("b"), ((t != "") & (text.strip(t) == "")).alias("b2"),
                       text.is_null_like(t, words).alias("n"), plain.alias("n2")).collect():
        assert (bool(r.b), bool(r.n), r.t is None) == (bool(r.b2), bool(r.n2), r.b is None), r
    assert "CASE WHEN" in df.select(text.is_null_like(t, words))._jdf.queryExecution().optimizedPlan().toString()


def test_packed_texts_come_back(spark):
    rows = [("a", "b", "c"), (None, "b", "c,\u00e9"), ("a,1", None, ""), ("", "", None), ("\U0001f600\u00e9", "x" * 200, "7,8,"), (None, None, None)]
    df = spark.createDataFrame(rows, "p string, q string, r string").select(sample_tables._packed("p", "q", "r").alias("t"))
    assert [tuple(r) for r in df.select(*sample_tables._unpacked("t", "p", "q", "r")).collect()] == rows


def test_only_unreadable_times_are_stripped(spark):
    df = spark.createDataFrame([], ", ".join(f"{c} string" for c in ("unique_key", "created_date", "closed_date", "due_date")) + ", "
                               + ", ".join(f"{c} timestamp" for c in ("created_ts", "closed_ts", "due_ts")))
    plan = df.agg(*scope.diagnostic_counters())._jdf.queryExecution().analyzed().toString()
    for c in ("created", "closed", "due"):
        assert 0 <= plan.find(f"isnull({c}_ts") < plan.find(f"trim({c}_date"), plan

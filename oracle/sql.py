"""SQL twins of the registered queries, on the same sample tables.

Shared steps are common table expressions; :func:`_with` puts in front of a
query the ones it names, in dependency order.
"""

from __future__ import annotations

import re

from oracle.fixed import (
    CHRONOLOGY_SEVERITY, COLUMN_GROUPS, DAY_COUNTS, DEFAULT_SEMANTIC_TYPE, DIAGNOSTIC_CONFLICT_COLUMNS, EXCLUSION_ORDER, GEO_METRICS,
    GEO_SEVERITY, MATERIAL_COLUMNS, NULL_LIKE, OVERVIEW_CONFLICT_COLUMNS, PATTERN_SEVERITY, PLACEHOLDERS, PROFILE_CATEGORY_COLUMNS,
    QUALITY_CATEGORY_COLUMNS, RAW_COLUMNS, READINESS_RULES, ROLES, RULES, SEMANTIC_TYPES, STATUS_SEVERITY, SUMS, TIMESTAMP_COLUMNS,
    VIOLATIONS,
)
from oracle import settings as S

TS = {"created_date": "created_ts", "closed_date": "closed_ts", "due_date": "due_ts",
      "resolution_action_updated_date": "updated_ts"}
AT = "TIMESTAMP '2001-07-20 00:00:00'"
RECENT = "DATE '2000-07-01'"


# ---- small writers ----------------------------------------------------------

def text(value: str) -> str:
    return "'" + str(value).replace("'", "''") + "'"


def words(values) -> str:
    return "(" + ", ".join(text(v) for v in values) + ")"


def r(x: str) -> str:
    return f"round(({x})::DOUBLE, 6)"


def raw_ratio(a: str, b: str) -> str:
    return f"coalesce(({a})::DOUBLE / nullif(({b})::DOUBLE, 0), 0)"


def ratio(a: str, b: str) -> str:
    return r(raw_ratio(a, b))


def ratio_null(a: str, b: str) -> str:
    return r(f"({a})::DOUBLE / nullif(({b})::DOUBLE, 0)")


def pct(a: str, b: str) -> str:
    return r(f"100.0 * coalesce(({a})::DOUBLE / nullif(({b})::DOUBLE, 0), 0)")


def pct_null(a: str, b: str) -> str:
    return r(f"100.0 * ({a})::DOUBLE / nullif(({b})::DOUBLE, 0)")


def n(x: str) -> str:
    return f"coalesce({x}, 0)::BIGINT"


def count_if(cond: str) -> str:
    return f"(count(*) FILTER (WHERE {cond}))::BIGINT"


def iso(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%dT%H:%M:%S+00:00')"


def day(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d')"


def stamp(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


def union(parts) -> str:
    return "\nUNION ALL\n".join(parts)


def reasons(pairs) -> str:
    """Labels of the conditions that hold, joined in order."""
    listed = ", ".join(f"CASE WHEN {cond} THEN {text(label)} END" for cond, label in pairs)
    return f"array_to_string(list_filter([{listed}], lambda x: x IS NOT NULL), ' | ')"


def clip(x: str) -> str:
    return f"greatest(0.0, least(1.0, ({x})::DOUBLE))"


# ---- shared steps -----------------------------------------------------------

_STATUS = """CASE WHEN l_linestatus = 'F' AND l_partkey % 50 = 0 THEN ' CLOSED '
      WHEN l_linestatus = 'F' THEN 'Closed' WHEN l_returnflag = 'N' THEN 'Open'
      WHEN l_returnflag = 'A' THEN 'Cancelled' WHEN l_partkey % 7 = 0 THEN 'Pending' ELSE 'Started' END"""

CTES: dict[str, str] = {}
CTES["requests"] = f"""
  SELECT l_orderkey || '-' || l_linenumber AS unique_key,
    CASE WHEN l_partkey % 211 = 0 THEN 'not-a-date' WHEN l_partkey % 199 = 0 THEN NULL
      ELSE strftime(o_orderdate, '%Y-%m-%d') || 'T00:00:00.000' END AS created_date,
    CASE WHEN ({_STATUS}) = 'Open' OR l_partkey % 61 = 0 THEN NULL
      ELSE strftime(o_orderdate::DATE + l_quantity::INT - CASE WHEN l_partkey % 149 = 0 THEN 60 ELSE 0 END, '%Y-%m-%d')
        || 'T00:00:00.000' END AS closed_date,
    CASE WHEN l_suppkey % 10 = 0 THEN NULL
      ELSE strftime(o_orderdate::DATE + (10 + l_suppkey % 15)::INT - CASE WHEN l_partkey % 157 = 0 THEN 60 ELSE 0 END, '%Y-%m-%d')
        || 'T00:00:00.000' END AS due_date,
    r_name AS agency, 'Department of ' || r_name || CASE WHEN r_name = 'MIDDLE EAST' AND l_partkey % 173 = 0 THEN ' (former)' ELSE '' END AS agency_name, p_type AS complaint_type, p_brand AS descriptor,
    NULL::VARCHAR AS descriptor_2, {_STATUS} AS status,
    CASE WHEN c_custkey % 37 = 0 THEN 'Unspecified' WHEN c_custkey % 41 = 0 THEN NULL WHEN c_custkey % 43 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS borough,
    CASE WHEN c_custkey % 53 = 0 THEN '12345.0' WHEN c_custkey % 59 = 0 THEN '123' WHEN c_custkey % 67 = 0 THEN NULL
      ELSE lpad(c_custkey::VARCHAR, 5, '0') END AS incident_zip,
    CASE WHEN c_custkey % 83 = 0 THEN 'bad' WHEN c_custkey % 89 = 0 THEN '95.0' WHEN c_custkey % 71 = 0 THEN NULL
      WHEN c_custkey % 73 = 0 THEN '35.0' ELSE '40.75' END AS latitude,
    CASE WHEN c_custkey % 71 = 0 THEN NULL WHEN c_custkey % 79 = 0 THEN '-200.0' ELSE '-73.9' END AS longitude,
    p_name AS location_type, o_orderpriority AS open_data_channel_type, o_orderstatus AS resolution_description,
    NULL::VARCHAR AS resolution_action_updated_date,
    l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || copy AS source_row_index,
    (l_orderkey * 16 + l_linenumber) * 2 + copy AS row_place, l_orderkey AS order_key
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    CROSS JOIN (SELECT 0 AS copy UNION ALL SELECT 1) copies
  WHERE copy = 0 OR l_orderkey % 97 = 0"""
CTES["typed"] = """
  SELECT *, TRY_CAST(created_date AS TIMESTAMP) AS created_ts, TRY_CAST(closed_date AS TIMESTAMP) AS closed_ts,
    TRY_CAST(due_date AS TIMESTAMP) AS due_ts, TRY_CAST(resolution_action_updated_date AS TIMESTAMP) AS updated_ts
  FROM requests"""
CTES["mine"] = f"SELECT * FROM typed WHERE agency = {text(S.AGENCY)}"

# governed label
CTES["flags"] = f"""
  SELECT *, lower(trim(status)) AS status_normalized,
    coalesce(agency = {text(S.SCOPE.agency)} AND complaint_type = {text(S.SCOPE.complaint_type)}
      AND created_ts >= DATE '{S.SCOPE.start}' AND created_ts < DATE '{S.SCOPE.end_exclusive}', FALSE) AS within_selected_scope,
    created_ts IS NOT NULL AS has_created_date, due_ts IS NOT NULL AS has_due_date, closed_ts IS NOT NULL AS has_closed_date,
    NOT coalesce(due_ts < created_ts, FALSE) AS valid_due_chronology,
    NOT coalesce(closed_ts < created_ts, FALSE) AS valid_closed_chronology,
    lower(trim(status)) = 'closed' AS status_allowed, lower(trim(status)) = 'cancelled' AS is_cancelled,
    closed_ts IS NULL OR lower(trim(status)) <> 'closed' AS is_open,
    (lower(trim(status)) = 'closed') <> (closed_ts IS NOT NULL) AS status_closed_date_inconsistent,
    coalesce(due_ts <= TIMESTAMP '{S.SCOPE.extracted_at:%Y-%m-%d %H:%M:%S}', FALSE) AS outcome_mature
  FROM typed"""
CTES["target_keys"] = """
  SELECT unique_key, count(*) AS group_rows,
    count(DISTINCT row(created_ts, due_ts, closed_ts, agency, complaint_type, status)) > 1 AS conflicting,
    min(source_row_index) AS canonical_id
  FROM typed WHERE unique_key IS NOT NULL GROUP BY 1 HAVING count(*) > 1"""
CTES["keyed"] = """
  SELECT f.*, coalesce(k.conflicting, FALSE) AS is_conflicting_duplicate,
    coalesce(NOT k.conflicting AND f.source_row_index <> k.canonical_id, FALSE) AS is_exact_duplicate
  FROM flags f LEFT JOIN target_keys k USING (unique_key)"""
_APPLIES = {
    "outside_selected_scope": f"NOT within_selected_scope AND (agency <> {text(S.SCOPE.agency)} "
                              f"OR complaint_type <> {text(S.SCOPE.complaint_type)} OR has_created_date)",
    "missing_created_date": "NOT has_created_date", "missing_due_date": "NOT has_due_date",
    "missing_closed_date": "NOT has_closed_date", "due_before_created": "NOT valid_due_chronology",
    "closed_before_created": "NOT valid_closed_chronology", "excluded_status": "NOT status_allowed",
    "conflicting_duplicate_unique_key": "is_conflicting_duplicate",
    "exact_duplicate_unique_key": "is_exact_duplicate", "outcome_not_mature": "NOT outcome_mature",
}
_CASE = "CASE " + " ".join(f"WHEN {_APPLIES[x]} THEN '{x}'" for x in EXCLUSION_ORDER) + " ELSE 'eligible' END"
CTES["governed"] = f"""
  SELECT *, {_CASE} AS primary_exclusion_reason, ({_CASE}) = 'eligible' AS target_eligible,
    CASE WHEN ({_CASE}) = 'eligible' THEN (closed_ts > due_ts)::BIGINT END AS missed_resolution_target
  FROM keyed"""
_MATERIAL_ROW = "row(" + ", ".join(MATERIAL_COLUMNS) + ")"
CTES["material_keys"] = f"""
  SELECT unique_key, count(*) AS group_rows, count(DISTINCT {_MATERIAL_ROW}) > 1 AS conflicting,
    min(source_row_index) AS canonical_id,
    array_to_string(list_filter([{", ".join(
        f"CASE WHEN count(DISTINCT coalesce({c}, '<NA>')) > 1 THEN '{c}' END" for c in MATERIAL_COLUMNS)}],
      lambda x: x IS NOT NULL), '|') AS conflicting_fields
  FROM requests WHERE unique_key IS NOT NULL GROUP BY 1 HAVING count(*) > 1"""
CTES["ready"] = """
  SELECT g.* EXCLUDE (is_conflicting_duplicate), g.is_conflicting_duplicate OR coalesce(m.conflicting, FALSE) AS is_conflicting_duplicate,
    target_eligible AND NOT coalesce(m.conflicting, FALSE) AS candidate_target_eligible,
    CASE WHEN target_eligible AND coalesce(m.conflicting, FALSE) THEN 'conflicting_duplicate_unique_key'
      ELSE primary_exclusion_reason END AS candidate_exclusion_reason
  FROM governed g LEFT JOIN material_keys m USING (unique_key)"""

# categories
CTES["profile_counts"] = union(
    f"SELECT '{c}' AS column_name, {c} AS value, count(*) AS row_count FROM requests GROUP BY {c}"
    for c in PROFILE_CATEGORY_COLUMNS)
CTES["audit_counts"] = union(
    f"SELECT '{c}' AS column_name, {c} AS value, count(*) AS row_count FROM requests GROUP BY {c}"
    for c in QUALITY_CATEGORY_COLUMNS)
CTES["variants"] = """
  SELECT column_name, lower(regexp_replace(trim(value), '\\s+', ' ', 'g')) AS normalised_comparison_value,
    count(*) AS raw_variant_count, sum(row_count)::BIGINT AS row_count,
    CASE WHEN count(DISTINCT trim(value)) = 1 THEN 'whitespace'
      WHEN count(DISTINCT regexp_replace(trim(value), '\\s+', ' ', 'g')) = 1 THEN 'repeated_whitespace' ELSE 'case' END AS variant_type
  FROM profile_counts WHERE value IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1"""
_AUDIT_CHECKS = {
    "null_values": "value IS NULL", "empty_strings": "value = ''",
    "leading_or_trailing_whitespace": "value <> trim(value)",
    "placeholder_values": f"lower(trim(value)) IN {words(PLACEHOLDERS)}",
}
CTES["audit_checks"] = union(
    [f"SELECT column_name, '{c}' AS check_name, {n(f'sum(row_count) FILTER (WHERE {cond})')} AS affected_count "
     "FROM audit_counts GROUP BY 1" for c, cond in _AUDIT_CHECKS.items()]
    + ["SELECT column_name, 'case_insensitive_collisions', "
       "coalesce(sum(group_rows) FILTER (WHERE spellings > 1), 0)::BIGINT FROM (SELECT column_name, lower(value) AS form, "
       "count(value) AS spellings, sum(row_count) AS group_rows FROM audit_counts GROUP BY 1, 2) GROUP BY 1"])

# source audit
_LAT, _LON = "TRY_CAST(latitude AS DOUBLE)", "TRY_CAST(longitude AS DOUBLE)"
AUDIT = {
    "pattern": {
        "closed_and_due_both_missing": "closed_date IS NULL AND due_date IS NULL",
        "closed_present_due_missing": "closed_date IS NOT NULL AND due_date IS NULL",
        "due_present_closed_missing": "due_date IS NOT NULL AND closed_date IS NULL",
        "closed_status_missing_closed_date": "status = 'Closed' AND closed_date IS NULL",
        "non_closed_status_with_closed_date": "status <> 'Closed' AND closed_date IS NOT NULL",
        "latitude_without_longitude": "latitude IS NOT NULL AND longitude IS NULL",
        "longitude_without_latitude": "longitude IS NOT NULL AND latitude IS NULL",
        "borough_and_zip_both_missing": "borough IS NULL AND incident_zip IS NULL",
        "borough_missing_coordinates_present": "borough IS NULL AND latitude IS NOT NULL AND longitude IS NOT NULL",
    },
    "chronology": {
        "closed_before_created": "closed_ts < created_ts", "due_before_created": "due_ts < created_ts",
        "resolution_update_before_created": "updated_ts < created_ts",
        "created_after_analysis_time": f"created_ts > {AT}", "closed_after_analysis_time": f"closed_ts > {AT}",
        "resolution_update_after_analysis_time": f"updated_ts > {AT}", "due_after_analysis_time": f"due_ts > {AT}",
    },
    "status": {
        "closed_status_missing_closed_date": "status = 'Closed' AND closed_date IS NULL",
        "active_status_with_closed_date":
            "status IN ('Assigned', 'In Progress', 'Open', 'Pending', 'Started') AND closed_date IS NOT NULL",
        "closed_status_closed_before_created": "status = 'Closed' AND closed_ts < created_ts",
        "special_status_with_closed_date": "status IN ('Cancel', 'Cancelled', 'Unspecified') AND closed_date IS NOT NULL",
    },
    "geo": {
        "latitude_outside_global_range": f"{_LAT} < -90 OR {_LAT} > 90",
        "longitude_outside_global_range": f"{_LON} < -180 OR {_LON} > 180",
        "latitude_without_longitude": "latitude IS NOT NULL AND longitude IS NULL",
        "longitude_without_latitude": "longitude IS NOT NULL AND latitude IS NULL",
        "both_coordinates_missing": "latitude IS NULL AND longitude IS NULL",
        "borough_missing_coordinates_present": "borough IS NULL AND latitude IS NOT NULL AND longitude IS NOT NULL",
        "coordinates_outside_approximate_nyc_box":
            f"{_LAT} < 40.45 OR {_LAT} > 40.95 OR {_LON} < -74.30 OR {_LON} > -73.65",
        "incident_zip_malformed": "NOT regexp_full_match(incident_zip, '[0-9]{5}')",
    },
}
# Unreadable coordinates have no position, so the box test needs both numbers.
AUDIT["geo"]["coordinates_outside_approximate_nyc_box"] = (
    f"{_LAT} IS NOT NULL AND {_LON} IS NOT NULL AND ({AUDIT['geo']['coordinates_outside_approximate_nyc_box']})")
SEVERITIES = {"pattern": PATTERN_SEVERITY, "chronology": CHRONOLOGY_SEVERITY, "status": STATUS_SEVERITY, "geo": GEO_SEVERITY}
CTES["audit_totals"] = "SELECT count(*) AS all_rows, " + ", ".join(
    [f"count(*) FILTER (WHERE {c} IS NULL) AS missing__{c}" for c in RAW_COLUMNS]
    + [f"count(*) FILTER (WHERE {cond}) AS {g}__{name}" for g, conds in AUDIT.items() for name, cond in conds.items()]
) + " FROM typed"
_OVERVIEW_CONFLICT = [f"count(DISTINCT {c}) > 1" for c in OVERVIEW_CONFLICT_COLUMNS]
CTES["audit_keys"] = f"""
  SELECT unique_key, count(*) AS n, ({" OR ".join(_OVERVIEW_CONFLICT)}) AS conflict FROM requests GROUP BY 1"""
CTES["whole_rows"] = "SELECT count(*) AS n FROM requests GROUP BY " + ", ".join(RAW_COLUMNS)
_REPEATED = "unique_key IS NOT NULL AND n > 1"
CTES["audit_duplicates"] = union([
    f"SELECT 'null_unique_key' AS check_name, {n('sum(n) FILTER (WHERE unique_key IS NULL)')} AS affected_count, TRUE AS has_share FROM audit_keys",
    f"SELECT 'duplicated_unique_key_groups', {count_if(_REPEATED)}, FALSE FROM audit_keys",
    f"SELECT 'rows_in_duplicate_id_groups', {n(f'sum(n) FILTER (WHERE {_REPEATED})')}, TRUE FROM audit_keys",
    f"SELECT 'excess_duplicate_id_rows', {n(f'sum(n - 1) FILTER (WHERE {_REPEATED})')}, TRUE FROM audit_keys",
    f"SELECT 'maximum_records_for_one_unique_key', coalesce(max(n) FILTER (WHERE {_REPEATED}), 1)::BIGINT, FALSE FROM audit_keys",
    f"SELECT 'conflicting_duplicate_ids', {count_if(_REPEATED + ' AND conflict')}, FALSE FROM audit_keys",
    f"SELECT 'exact_duplicate_rows', {n('sum(n) FILTER (WHERE n > 1)')}, TRUE FROM whole_rows",
    f"SELECT 'excess_exact_duplicate_rows', {n('sum(n - 1) FILTER (WHERE n > 1)')}, TRUE FROM whole_rows",
])

# scope selection
_COMPLETE = "created_ts IS NOT NULL AND due_ts IS NOT NULL AND closed_ts IS NOT NULL"
_PARTIALS = f"""count(*)::BIGINT AS total_records, count(created_ts)::BIGINT AS created_date_present_count,
    count(due_ts)::BIGINT AS due_date_present_count, count(closed_ts)::BIGINT AS closed_date_present_count,
    {count_if(_COMPLETE)} AS eligible_target_count, {count_if(_COMPLETE + ' AND closed_ts > due_ts')} AS missed_target_count,
    {count_if('due_ts < created_ts')} AS invalid_due_sequence_count,
    {count_if('closed_ts < created_ts')} AS invalid_closed_sequence_count"""
_RESUM = ", ".join(f"{n(f'sum({c})')} AS {c}" for c in SUMS)
CTES["gold"] = f"""
  SELECT agency, agency_name, complaint_type, date_trunc('month', created_ts)::DATE AS created_month, {_PARTIALS},
    min(created_ts) AS first_created_date, max(created_ts) AS last_created_date
  FROM typed GROUP BY 1, 2, 3, 4"""


def rates(prefix: str = "") -> str:
    t, e, m = f"{prefix}total_records", f"{prefix}eligible_target_count", f"{prefix}missed_target_count"
    return ", ".join([
        f"{raw_ratio(f'{prefix}due_date_present_count', t)} AS due_date_coverage",
        f"{raw_ratio(f'{prefix}closed_date_present_count', t)} AS closed_date_coverage",
        f"{raw_ratio(e, t)} AS eligible_target_rate", f"({e} - {m})::BIGINT AS on_time_count",
        f"{raw_ratio(m, e)} AS missed_target_rate"])


CTES["agencies"] = f"""
  SELECT *, {rates()}, {raw_ratio('created_date_present_count', 'total_records')} AS created_date_coverage
  FROM (SELECT agency, agency_name, {_RESUM}, min(first_created_date) AS first_created_date,
      max(last_created_date) AS last_created_date, count(DISTINCT created_month)::BIGINT AS active_months,
      count(DISTINCT complaint_type)::BIGINT AS complaint_type_count FROM gold GROUP BY 1, 2)
  JOIN (SELECT agency, agency_name, (count(*) - count(DISTINCT unique_key) - max((unique_key IS NULL)::INT))::BIGINT AS duplicate_unique_key_count
    FROM typed GROUP BY 1, 2) USING (agency, agency_name)"""
CTES["types"] = f"""
  SELECT *, {rates()}, invalid_due_sequence_count + invalid_closed_sequence_count AS invalid_timestamp_count
  FROM (SELECT agency, agency_name, complaint_type, {_RESUM}, min(first_created_date) AS first_created_date,
      max(last_created_date) AS last_created_date, count(created_month)::BIGINT AS active_months,
      coalesce(median(total_records) FILTER (WHERE created_month IS NOT NULL), 0) AS median_monthly_volume,
      coalesce(min(total_records) FILTER (WHERE created_month IS NOT NULL), 0)::BIGINT AS minimum_monthly_volume,
      coalesce(max(total_records) FILTER (WHERE created_month IS NOT NULL), 0)::BIGINT AS maximum_monthly_volume,
      {n(f'sum(total_records) FILTER (WHERE created_month >= {RECENT})')} AS recent_period_record_count
    FROM gold GROUP BY 1, 2, 3)"""
L = S.LIMITS


def type_rules(due: str, closed: str, minimum: str) -> dict[str, str]:
    return {
        "passes_eligible_volume": f"eligible_target_count >= {minimum}",
        "passes_due_date_coverage": f"due_date_coverage >= {due}",
        "passes_closed_date_coverage": f"closed_date_coverage >= {closed}",
        "passes_target_balance": "eligible_target_count > 0 AND missed_target_rate BETWEEN 0.05 AND 0.95",
        "passes_temporal_coverage": "active_months >= 12",
        "passes_monthly_volume": f"median_monthly_volume >= {L.minimum_median_monthly_volume}",
        "passes_recent_activity": "recent_period_record_count > 0",
        "passes_data_consistency": f"{raw_ratio('invalid_timestamp_count', 'total_records')} <= 0.05",
    }


_TYPE_RULES = type_rules("0.7", "0.8", str(L.minimum_complaint_type_eligible_records))
_TYPE_LABELS = {
    "passes_eligible_volume": "Insufficient eligible records",
    "passes_due_date_coverage": "Low due-date coverage",
    "passes_closed_date_coverage": "Low closed-date coverage",
    "passes_target_balance": "Target rate outside configured range",
    "passes_temporal_coverage": "Insufficient active months",
    "passes_monthly_volume": "Low median monthly volume",
    "passes_recent_activity": "Inactive in recent period",
    "passes_data_consistency": "Excessive invalid timestamp rate",
}
CTES["decided"] = f"""
  SELECT *, CASE WHEN {" AND ".join(_TYPE_RULES)} THEN 'Include' WHEN eligible_target_count > 0 THEN 'Review'
      ELSE 'Exclude' END AS scope_status, {reasons([(f"NOT {k}", v) for k, v in _TYPE_LABELS.items()])} AS why
  FROM (SELECT *, {", ".join(f"({v}) AS {k}" for k, v in _TYPE_RULES.items())} FROM types)"""
CTES["chosen_gold"] = f"""
  SELECT * FROM gold WHERE agency = {text(S.AGENCY)} AND complaint_type IN
    (SELECT complaint_type FROM decided WHERE scope_status = 'Include' AND agency = {text(S.AGENCY)})"""
CTES["periods"] = union(
    f"SELECT 'C{i}' AS candidate_id, {text(p.name)} AS candidate_name, DATE '{p.start}' AS start_date, "
    f"DATE '{p.end}' AS end_date, {p.months} AS expected_months, {p.complete_years} AS complete_calendar_years"
    for i, p in enumerate(S.PERIODS, 1))


def range_rollup(source: str) -> str:
    """Per candidate, from rows that carry a month and a complaint type."""
    return f"""
  SELECT p.*, {", ".join(f"coalesce({c}, 0)::BIGINT AS {c}" for c in SUMS)},
    coalesce(active_months, 0)::BIGINT AS active_months, coalesce(median_eligible, 0) AS median_monthly_eligible_records,
    coalesce(min_eligible, 0)::BIGINT AS minimum_monthly_eligible_records,
    coalesce(complaint_type_count, 0)::BIGINT AS complaint_type_count,
    greatest(expected_months - coalesce(active_months, 0), 0)::BIGINT AS missing_month_count,
    {raw_ratio('invalid_due_sequence_count + invalid_closed_sequence_count', 'total_records')} AS invalid_timestamp_rate,
    {rates()}
  FROM periods p
  LEFT JOIN (SELECT candidate_name, {_RESUM}, count(*) AS active_months, median(eligible_target_count) AS median_eligible,
      min(eligible_target_count) AS min_eligible
    FROM (SELECT candidate_name, month, {_RESUM} FROM {source} GROUP BY 1, 2) GROUP BY 1) m USING (candidate_name)
  LEFT JOIN (SELECT candidate_name, count(DISTINCT complaint_type) AS complaint_type_count FROM {source} GROUP BY 1) t
    USING (candidate_name)"""


CTES["chosen_ranges"] = """
  SELECT p.candidate_name, g.*, g.created_month AS month FROM periods p JOIN chosen_gold g
    ON g.created_month BETWEEN date_trunc('month', p.start_date) AND p.end_date"""
CTES["general_base"] = range_rollup("chosen_ranges")
_GATES = {
    "passes_eligible_volume": f"eligible_target_count >= {L.minimum_candidate_eligible_records}",
    "passes_due_date_coverage": "due_date_coverage >= 0.7", "passes_closed_date_coverage": "closed_date_coverage >= 0.8",
    "passes_target_balance": "missed_target_rate BETWEEN 0.05 AND 0.95", "passes_temporal_coverage": "active_months >= 12",
    "has_included_complaint_types": "complaint_type_count > 0", "passes_month_continuity": "missing_month_count = 0",
    "passes_data_consistency": "invalid_timestamp_rate <= 0.05",
}
_GATE_LABELS = {
    "passes_eligible_volume": "Insufficient candidate eligible records",
    "passes_due_date_coverage": "Candidate due-date coverage below threshold",
    "passes_closed_date_coverage": "Candidate closed-date coverage below threshold",
    "passes_target_balance": "Candidate target rate outside configured range",
    "passes_temporal_coverage": "Insufficient candidate active months",
    "has_included_complaint_types": "Candidate contains no included complaint types",
    "passes_month_continuity": "Candidate has missing months",
    "passes_data_consistency": "Candidate has an excessive invalid timestamp rate",
}
_SCORES = {
    "due_date_score": clip("due_date_coverage"), "closed_date_score": clip("closed_date_coverage"),
    "eligible_volume_score": clip(f"ln(1 + eligible_target_count) / ln(1 + {L.minimum_candidate_eligible_records * 10})"),
    "target_balance_score": clip("1 - 2 * abs(missed_target_rate - 0.5)"),
    "data_consistency_score": clip(
        f"1 - 0.7 * {clip('invalid_timestamp_rate')} - 0.3 * {raw_ratio('missing_month_count', 'active_months + missing_month_count')}"),
    "operational_relevance_score": "0.5::DOUBLE",
}
CTES["general"] = f"""
  SELECT *, {" AND ".join(_GATES)} AS passes_critical_gates,
    {reasons([(f"NOT {k}", v) for k, v in _GATE_LABELS.items()])} AS gate_rejection_reasons,
    {clip("0.30 * due_date_score + 0.20 * closed_date_score + 0.15 * eligible_volume_score + 0.15 * target_balance_score"
          " + 0.10 * data_consistency_score + 0.10 * operational_relevance_score")} AS scope_score
  FROM (SELECT *, {", ".join(f"({v}) AS {k}" for k, v in _GATES.items())},
      {", ".join(f"{v} AS {k}" for k, v in _SCORES.items())} FROM general_base)"""
CTES["chosen_months"] = f"""
  SELECT *, {rates()} FROM (SELECT created_month, {_RESUM}, count(DISTINCT complaint_type)::BIGINT AS complaint_type_count
    FROM chosen_gold WHERE created_month BETWEEN DATE '{S.SELECTED.start}' AND DATE '{S.SELECTED.end}' GROUP BY 1)"""

# temporal stability
_MATURE = f"coalesce(due_ts <= {AT}, FALSE)"
CTES["daily"] = f"""
  SELECT created_ts::DATE AS day, count(*) AS total_records, count(due_ts) AS due_date_present_count,
    count(closed_ts) AS closed_date_present_count, count(*) FILTER (WHERE {_MATURE}) AS outcome_mature_count,
    count(*) FILTER (WHERE {_MATURE} AND closed_ts IS NULL) AS mature_open_count,
    count(*) FILTER (WHERE due_ts < created_ts) + count(*) FILTER (WHERE closed_ts < created_ts) AS invalid_timestamp_count,
    count(*) FILTER (WHERE {_COMPLETE} AND {_MATURE}) AS eligible_records,
    count(*) FILTER (WHERE {_COMPLETE} AND {_MATURE} AND closed_ts > due_ts) AS missed_count
  FROM mine WHERE created_ts IS NOT NULL GROUP BY 1"""
CTES["all_period"] = (f"SELECT {text(S.ALL_MONTHS.name)} AS candidate_name, DATE '{S.ALL_MONTHS.start}' AS start_date, "
                      f"DATE '{S.ALL_MONTHS.end}' AS end_date, 6 AS complete_calendar_years")


def month_table(periods: str) -> str:
    sums = ", ".join(f"{n(f'sum({c})')} AS {c}" for c in DAY_COUNTS)
    return f"""
  SELECT *, (due_date_present_count - outcome_mature_count)::BIGINT AS outcome_immature_count,
    {raw_ratio('eligible_records', 'total_records')} AS eligible_rate,
    {raw_ratio('due_date_present_count', 'total_records')} AS due_date_coverage,
    {raw_ratio('closed_date_present_count', 'total_records')} AS closed_date_coverage,
    {raw_ratio('outcome_mature_count', 'due_date_present_count')} AS outcome_maturity_rate,
    (eligible_records - missed_count)::BIGINT AS on_time_count,
    missed_count::DOUBLE / nullif(eligible_records, 0) AS missed_target_rate
  FROM (SELECT p.candidate_name, p.start_date, p.end_date, p.complete_calendar_years, s.month, {sums}
    FROM {periods} p
    CROSS JOIN LATERAL (SELECT unnest(generate_series(date_trunc('month', p.start_date), p.end_date, INTERVAL 1 MONTH))::DATE AS month) s
    LEFT JOIN daily d ON date_trunc('month', d.day) = s.month AND d.day BETWEEN p.start_date AND p.end_date
    GROUP BY 1, 2, 3, 4, 5)"""


CTES["months"] = month_table("all_period")
CTES["period_months"] = month_table("periods")
CTES["stability"] = f"""
  SELECT candidate_name, start_date, end_date, complete_calendar_years,
    {", ".join(f"sum({c})::BIGINT AS {c}" for c in DAY_COUNTS)},
    sum(outcome_immature_count)::BIGINT AS outcome_immature_count, sum(on_time_count)::BIGINT AS on_time_count,
    {raw_ratio('sum(eligible_records)', 'sum(total_records)')} AS eligible_rate,
    {raw_ratio('sum(due_date_present_count)', 'sum(total_records)')} AS due_date_coverage,
    {raw_ratio('sum(closed_date_present_count)', 'sum(total_records)')} AS closed_date_coverage,
    {raw_ratio('sum(outcome_mature_count)', 'sum(due_date_present_count)')} AS outcome_maturity_rate,
    {raw_ratio('sum(missed_count)', 'sum(eligible_records)')} AS missed_target_rate,
    {raw_ratio('sum(invalid_timestamp_count)', 'sum(total_records)')} AS invalid_timestamp_rate,
    count(*) FILTER (WHERE eligible_records > 0)::BIGINT AS active_months, count(*)::BIGINT AS expected_months,
    count(*) FILTER (WHERE eligible_records = 0)::BIGINT AS missing_months,
    coalesce(min(v), 0)::BIGINT AS minimum_monthly_eligible_volume, coalesce(max(v), 0)::BIGINT AS maximum_monthly_eligible_volume,
    coalesce(avg(v), 0) AS mean_monthly_eligible_volume, coalesce(stddev_pop(v), 0) AS monthly_volume_standard_deviation,
    {raw_ratio('stddev_pop(v)', 'avg(v)')} AS monthly_volume_coefficient_of_variation,
    coalesce(min(missed_target_rate_m), 0) AS minimum_monthly_missed_target_rate,
    coalesce(max(missed_target_rate_m), 0) AS maximum_monthly_missed_target_rate,
    coalesce(max(missed_target_rate_m) - min(missed_target_rate_m), 0) AS monthly_target_rate_range,
    coalesce(stddev_pop(missed_target_rate_m), 0) AS monthly_target_rate_standard_deviation,
    coalesce(max(step), 0) AS largest_absolute_month_to_month_target_rate_change
  FROM (SELECT * EXCLUDE (missed_target_rate), missed_target_rate AS missed_target_rate_m,
      CASE WHEN eligible_records > 0 THEN eligible_records::DOUBLE END AS v,
      CASE WHEN eligible_records > 0 THEN abs(missed_target_rate - lag(missed_target_rate)
        OVER (PARTITION BY candidate_name, eligible_records > 0 ORDER BY month)) END AS step FROM period_months)
  GROUP BY 1, 2, 3, 4"""
T = S.STABILITY
_TEMPORAL_GATES = {
    "passes_eligible_record_count": f"eligible_records >= {T.minimum_eligible_records}",
    "passes_due_date_coverage": "due_date_coverage >= 0.7", "passes_closed_date_coverage": "closed_date_coverage >= 0.8",
    "passes_target_class_balance": "missed_target_rate BETWEEN 0.05 AND 0.95",
    "passes_month_continuity": "missing_months = 0",
    "passes_monthly_eligible_volume": f"minimum_monthly_eligible_volume >= {T.minimum_monthly_eligible_volume}",
    "passes_active_months": "active_months >= 24", "passes_outcome_maturity": "outcome_maturity_rate >= 0.98",
    "passes_timestamp_consistency": "invalid_timestamp_rate <= 0.05",
    "passes_complete_calendar_years": "complete_calendar_years >= 2",
}
_STEP, _DEV = "largest_absolute_month_to_month_target_rate_change", "monthly_target_rate_standard_deviation"
_SEVERE = (f"monthly_target_rate_range >= 0.5 OR {_DEV} >= 0.15 OR {_STEP} >= {T.severe_month_to_month_change} "
           "OR monthly_volume_coefficient_of_variation >= 0.6")
CTES["evaluated"] = f"""
  SELECT *, CASE WHEN NOT core_data_feasibility THEN 'NOT_FEASIBLE' WHEN temporal_volatility_warning
      THEN 'APPROVED_WITH_LIMITATIONS' ELSE 'APPROVED' END AS decision_status,
    {reasons([(f"NOT {g}", g) for g in _TEMPORAL_GATES])} AS decision_reasons
  FROM (SELECT *, {" AND ".join(_TEMPORAL_GATES)} AS core_data_feasibility, ({_SEVERE}) AS severe_temporal_volatility,
      ({_SEVERE} OR monthly_target_rate_range >= 0.3 OR {_DEV} >= 0.1 OR {_STEP} >= {T.warning_month_to_month_change}) AS temporal_volatility_warning
    FROM (SELECT *, {", ".join(f"({v}) AS {k}" for k, v in _TEMPORAL_GATES.items())} FROM stability))"""
CTES["narrower"] = """
  SELECT candidate_name FROM evaluated wide WHERE severe_temporal_volatility AND EXISTS (
    SELECT 1 FROM evaluated calm WHERE calm.core_data_feasibility AND NOT calm.severe_temporal_volatility
      AND calm.start_date >= wide.start_date AND calm.end_date <= wide.end_date
      AND calm.eligible_records >= wide.eligible_records * 0.5)"""
CTES["latest_end"] = """
  SELECT coalesce(max(end_date) FILTER (WHERE month(end_date) = 12 AND day(end_date) = 31), max(end_date)) AS latest,
    min(start_date) AS first_start, max(start_date) AS last_start, greatest(max(eligible_records), 1)::DOUBLE AS largest FROM evaluated"""
CTES["scored"] = f"""
  SELECT e.* EXCLUDE (decision_status, decision_reasons), n.candidate_name IS NOT NULL AS better_stable_candidate_exists,
    CASE WHEN n.candidate_name IS NOT NULL THEN 'REQUIRES_NARROWER_RANGE' ELSE decision_status END AS decision_status,
    CASE WHEN n.candidate_name IS NOT NULL
      THEN 'Severe temporal volatility and a feasible, more stable contained candidate exists' ELSE decision_reasons END AS decision_reasons,
    (start_date - first_start)::DOUBLE / greatest(last_start - first_start, 1) AS recent_period_relevance_score,
    0.30 * (1 - {clip('monthly_target_rate_range')}) + 0.20 * (1 - {clip(_DEV)})
      + 0.15 * (1 - {clip('monthly_volume_coefficient_of_variation')}) + 0.15 * (eligible_records / largest)
      + 0.15 * (end_date = latest)::INT
      + 0.05 * ((start_date - first_start)::DOUBLE / greatest(last_start - first_start, 1)) AS selection_score,
    core_data_feasibility AND NOT severe_temporal_volatility AND end_date = latest AS preferred
  FROM evaluated e CROSS JOIN latest_end LEFT JOIN narrower n USING (candidate_name)"""
CTES["compared"] = """
  SELECT *, pool AND row_number() OVER (ORDER BY pool DESC, selection_score DESC, eligible_records DESC, start_date, end_date) = 1 AS selected
  FROM (SELECT *, CASE WHEN bool_or(preferred) OVER () THEN preferred ELSE core_data_feasibility END AS pool FROM scored)"""


def temporal_reason(alias: str = "") -> str:
    return (
        "coalesce(nullif(array_to_string(list_filter(list_distinct_ordered, lambda x: x IS NOT NULL), ' | '), ''), "
        "'Rejected by volatility-aware temporal analysis')"
    ).replace("list_distinct_ordered", """[
      CASE WHEN trim(decision_reasons) <> '' THEN decision_reasons END,
      CASE WHEN NOT (month(end_date) = 12 AND day(end_date) = 31) THEN 'Includes an incomplete calendar year' END,
      CASE WHEN outcome_immature_count > 0 THEN 'Contains outcome-immature records' END,
      CASE WHEN temporal_volatility_warning AND NOT severe_temporal_volatility
        THEN 'Passes core feasibility gates but is materially less stable' END]""")


# sensitivity scenarios
# One limit differs from the selection's in each: (name, start, candidate rows, type rows, due coverage, closed coverage).
_SCENARIOS = (
    ("", "1997-01-01", 2000, 500, 0.7, 0.8),
    ("minimum_candidate_eligible_records_1000", "1997-01-01", 1000, 500, 0.7, 0.8),
    ("minimum_candidate_eligible_records_2000", "1997-01-01", 2000, 500, 0.7, 0.8),
    ("minimum_candidate_eligible_records_4000", "1997-01-01", 4000, 500, 0.7, 0.8),
    ("minimum_due_date_coverage_60%", "1997-01-01", 2000, 500, 0.6, 0.8),
    ("minimum_due_date_coverage_70%", "1997-01-01", 2000, 500, 0.7, 0.8),
    ("minimum_due_date_coverage_80%", "1997-01-01", 2000, 500, 0.8, 0.8),
    ("minimum_closed_date_coverage_70%", "1997-01-01", 2000, 500, 0.7, 0.7),
    ("minimum_closed_date_coverage_80%", "1997-01-01", 2000, 500, 0.7, 0.8),
    ("minimum_closed_date_coverage_90%", "1997-01-01", 2000, 500, 0.7, 0.9),
    ("minimum_complaint_type_eligible_records_250", "1997-01-01", 2000, 250, 0.7, 0.8),
    ("minimum_complaint_type_eligible_records_500", "1997-01-01", 2000, 500, 0.7, 0.8),
    ("minimum_complaint_type_eligible_records_1250", "1997-01-01", 2000, 1250, 0.7, 0.8),
    ("start_date_selected_start_date", "1997-01-01", 2000, 500, 0.7, 0.8),
    ("start_date_one_year_earlier", "1996-01-01", 2000, 500, 0.7, 0.8),
    ("start_date_one_year_later", "1998-01-01", 2000, 500, 0.7, 0.8),
)
CTES["scenarios"] = union(
    f"SELECT {text(name)} AS scenario_name, DATE '{start}' AS start_date, DATE '1999-12-31' AS end_date, "
    f"(1999 - year(DATE '{start}') + 1) * 12 AS expected_months, DATE '1999-01-01' AS recent_from, {rows} AS min_candidate, "
    f"{type_rows} AS min_type, {due}::DOUBLE AS min_due, {closed}::DOUBLE AS min_closed"
    for name, start, rows, type_rows, due, closed in _SCENARIOS)
CTES["scenario_rows"] = f"""
  SELECT s.*, g.* FROM scenarios s JOIN gold g ON g.agency = {text(S.AGENCY)}
    AND g.created_month BETWEEN date_trunc('month', s.start_date) AND s.end_date"""
_SCENARIO_RULES = type_rules("min_due", "min_closed", "min_type")
CTES["scenario_types"] = f"""
  SELECT scenario_name, complaint_type FROM (
    SELECT *, {rates()}, invalid_due_sequence_count + invalid_closed_sequence_count AS invalid_timestamp_count
    FROM (SELECT scenario_name, min_type, min_due, min_closed, agency, agency_name, complaint_type, {_RESUM},
      count(DISTINCT created_month) AS active_months, median(total_records) AS median_monthly_volume,
      {n('sum(total_records) FILTER (WHERE created_month >= recent_from)')} AS recent_period_record_count
      FROM scenario_rows GROUP BY 1, 2, 3, 4, 5, 6, 7))
  WHERE {" AND ".join(f"({v})" for v in _SCENARIO_RULES.values())}"""
CTES["scenario_candidates"] = f"""
  SELECT *, {rates()}, greatest(expected_months - active_months, 0) AS missing_month_count,
    {raw_ratio('invalid_due_sequence_count + invalid_closed_sequence_count', 'total_records')} AS invalid_timestamp_rate
  FROM (SELECT s.*, coalesce(t.complaint_type_count, 0)::BIGINT AS complaint_type_count,
      coalesce(t.included, '') AS included_complaint_types, coalesce(m.active_months, 0) AS active_months,
      {", ".join(f"coalesce(m.{c}, 0)::BIGINT AS {c}" for c in SUMS)}
    FROM scenarios s
    LEFT JOIN (SELECT scenario_name, count(*) AS complaint_type_count,
        string_agg(complaint_type, ' | ' ORDER BY complaint_type) AS included FROM scenario_types GROUP BY 1) t USING (scenario_name)
    LEFT JOIN (SELECT r.scenario_name, {", ".join(f"sum(r.{c}) AS {c}" for c in SUMS)}, count(DISTINCT created_month) AS active_months
        FROM scenario_rows r JOIN scenario_types USING (scenario_name, complaint_type) GROUP BY 1) m USING (scenario_name))"""
_SCENARIO_GATES = {**_GATES, "passes_eligible_volume": "eligible_target_count >= min_candidate",
                   "passes_due_date_coverage": "due_date_coverage >= min_due",
                   "passes_closed_date_coverage": "closed_date_coverage >= min_closed"}
CTES["scenario_gated"] = f"""
  SELECT *, {" AND ".join(f"({v})" for v in _SCENARIO_GATES.values())} AS passes_critical_gates FROM scenario_candidates"""

# landing
CTES["first_landing"] = f"""
  SELECT *, row_number() OVER (PARTITION BY page_number ORDER BY
      CASE WHEN page_number % 5 <> 0 THEN coalesce(created_date, '') END NULLS FIRST,
      CASE WHEN page_number % 5 <> 0 THEN unique_key END NULLS FIRST, source_row_index) - 1 AS pos
  FROM (SELECT *, (order_key // {S.ORDERS_PER_PAGE})::BIGINT + 1 AS page_number FROM requests)"""
CTES["landed"] = f"""
  SELECT *, (page_number - 1) * {S.PAGE_LIMIT} AS "offset", {S.PAGE_LIMIT}::BIGINT AS requested_limit
  FROM (SELECT * FROM first_landing UNION ALL SELECT * REPLACE (1000003 AS page_number) FROM first_landing WHERE page_number = 3)"""
CTES["pages"] = 'SELECT page_number, "offset", requested_limit, count(*)::BIGINT AS returned_rows FROM landed GROUP BY 1, 2, 3'
CTES["manifests"] = """
  SELECT run, 'run-' || lpad(run::VARCHAR, 8, '0') AS run_id, run % 7 <> 5 AS required_text_present,
    run % 5 <> 3 AS completion_status_known, run % 3 <> 1 AS page_count_matches, run % 4 <> 2 AS page_rows_match_retrieved,
    n - CASE WHEN run % 4 = 2 THEN 1 ELSE 0 END >= 0 AS counts_not_negative, run % 6 <> 4 AS timestamps_in_utc,
    right(run::VARCHAR, 1) <> '1' AS no_secret_keys, n - CASE WHEN run % 4 = 2 THEN 1 ELSE 0 END AS retrieved_row_count
  FROM (SELECT (page_number - 1) // 4 AS run, sum(returned_rows) AS n FROM pages GROUP BY 1)"""
MANIFEST_RULES = ("required_text_present", "completion_status_known", "page_count_matches", "page_rows_match_retrieved",
                  "counts_not_negative", "timestamps_in_utc", "no_secret_keys")

# validation checks: (id, area, severity, affected, optional rows seen)
# Actions of the report contract.
MISSING_ACTIONS = {
    **{c: "Preserve source nulls unless Step 7 approves a deterministic rule." for c in RAW_COLUMNS},
    **{c: "Preserve nulls until an explicit Step 7 field policy is approved." for c in RAW_COLUMNS
       if ROLES[c] in ("POST_CREATION_FIELD", "CONDITIONAL_FEATURE")},
    **{c: "Preserve complaint; handle the geographic feature as missing." for c in ("latitude", "longitude", "incident_zip")},
    "closed_date": "Preserve rows and mark target-ineligible; do not impute closure time.",
    "due_date": "Preserve rows and mark target-ineligible; do not impute due dates.",
    **{c: "Quarantine affected rows; do not synthesize identifiers or creation time." for c in ("unique_key", "created_date")},
}
NOTHING_MISSING = "No missing-value action required."


def missing_severity(c: str) -> str:
    if c in ("unique_key", "created_date"):
        return "CRITICAL"
    if c == "due_date":
        return "ERROR"
    if c in ("closed_date", "latitude", "longitude", "incident_zip") or ROLES[c] in (
            "POST_CREATION_FIELD", "CONDITIONAL_FEATURE"):
        return "WARNING"
    return "INFO"


_GEO = {
    ("borough", "missing"): "borough IS NULL",
    ("borough", "unspecified_or_null_like"): "lower(trim(borough)) IN ('', 'unknown', 'unspecified', 'n/a', 'na')",
    ("latitude", "missing"): "latitude IS NULL", ("latitude", "parseable"): f"{_LAT} IS NOT NULL",
    ("latitude", "invalid_numeric"): f"latitude IS NOT NULL AND {_LAT} IS NULL",
    ("latitude", "outside_world_range"): f"{_LAT} NOT BETWEEN -90 AND 90",
    ("longitude", "missing"): "longitude IS NULL", ("longitude", "parseable"): f"{_LON} IS NOT NULL",
    ("longitude", "invalid_numeric"): f"longitude IS NOT NULL AND {_LON} IS NULL",
    ("longitude", "outside_world_range"): f"{_LON} NOT BETWEEN -180 AND 180",
    ("coordinate_pair", "outside_nyc_bounding_box"):
        f"{_LAT} BETWEEN -90 AND 90 AND {_LON} BETWEEN -180 AND 180 "
        f"AND NOT ({_LAT} BETWEEN 40.40 AND 41.00 AND {_LON} BETWEEN -74.30 AND -73.60)",
    ("incident_zip", "missing"): "incident_zip IS NULL",
    ("incident_zip", "non_digit"): "NOT regexp_full_match(incident_zip, '[0-9]+')",
    ("incident_zip", "unexpected_length"): "regexp_full_match(incident_zip, '[0-9]+') AND length(incident_zip) <> 5",
    ("incident_zip", "decimal_like"): "regexp_full_match(incident_zip, '[0-9]+\\.0+')",
}
_OUTSIDE = {
    "out_of_scope_agency": f"agency IS DISTINCT FROM {text(S.SCOPE.agency)}",
    "out_of_scope_complaint_type": f"complaint_type IS DISTINCT FROM {text(S.SCOPE.complaint_type)}",
    "before_start": f"created_ts < DATE '{S.SCOPE.start}'", "after_end": f"created_ts >= DATE '{S.SCOPE.end_exclusive}'",
    "unparseable_created_date": "created_ts IS NULL",
}
_CHRONOLOGY = {
    "due_before_created": "due_ts < created_ts", "closed_before_created": "closed_ts < created_ts",
    "resolution_action_before_created": "updated_ts < created_ts",
    "closed_present_created_invalid": "closed_date IS NOT NULL AND created_ts IS NULL",
    "due_present_created_invalid": "due_date IS NOT NULL AND created_ts IS NULL",
}


def _count_check(check_id: str, area: str, severity: str, cond: str) -> str:
    return (f"SELECT {text(check_id)} AS check_id, {text(area)} AS area, {text(severity)} AS severity, "
            f"count(*) FILTER (WHERE {cond}) AS affected, FALSE AS always_passes, NULL AS observed, '0' AS expected FROM typed")


def _fixed(check_id: str, area: str, severity: str, seen: str, wanted: str) -> str:
    return f"SELECT {text(check_id)}, {text(area)}, {text(severity)}, 0, TRUE, {text(seen)}, {text(wanted)}"


def _sentinel(c: str) -> str:
    return f"{c} = '' OR ({c} <> '' AND trim({c}) = '') OR lower(trim({c})) IN {words(NULL_LIKE)}"


_CHECKS = [_count_check(f"scope.{k}", "scope", "CRITICAL", v) for k, v in _OUTSIDE.items()]
_CHECKS += [_count_check(f"missingness.{c}", "missingness", missing_severity(c), f"{c} IS NULL") for c in RAW_COLUMNS]
_CHECKS += [_count_check(f"null_like.{c}", "category", "WARNING", _sentinel(c)) for c in RAW_COLUMNS]
_CHECKS += [_count_check(f"timestamp.{c}", "timestamp", "CRITICAL" if c == "created_date" else "ERROR",
                         f"{c} IS NOT NULL AND {TS[c]} IS NULL") for c in TIMESTAMP_COLUMNS]
_CHECKS += [_count_check(f"geography.{f}.{m}", "geography", sev, _GEO[(f, m)]) for f, m, sev in GEO_METRICS if m != "parseable"]
_CHECKS += [
    f"SELECT {text('chronology.' + k)}, 'chronology', {text(VIOLATIONS[k][0])}, "
    f"count(DISTINCT unique_key) FILTER (WHERE {v}), FALSE, (count(*) FILTER (WHERE {v}))::VARCHAR, '0' FROM typed" for k, v in _CHRONOLOGY.items()]
_CHECKS += [_fixed(f"metadata_scope.{k}", "metadata", "CRITICAL", v, v) for k, v in (
    ("agency", "ASIA"), ("complaint_type", "PROMO"), ("start_date", "1996-01-01"), ("end_date", "1999-12-31"))]
_CHECKS += [_fixed("metadata.dataset_id", "metadata", "CRITICAL", "erm2-nwe9", "erm2-nwe9")]
_LISTED = "|".join(RAW_COLUMNS)
_SCHEMA_CHECKS = [
    "SELECT 'schema.non_empty' AS check_id, 'schema' AS area, 'CRITICAL' AS severity, 0 AS affected, TRUE AS always_passes, "
    "(SELECT count(*) FROM requests)::VARCHAR AS observed, '> 0' AS expected",
    _fixed("schema.unique_column_names", "schema", "CRITICAL", "none", "none"),
    _fixed("schema.required_columns", "schema", "CRITICAL", "none", "none missing"),
    _fixed("schema.metadata_columns", "schema", "CRITICAL", _LISTED, _LISTED), _fixed("schema.column_order", "schema", "ERROR", _LISTED, _LISTED),
    _fixed("schema.unexpected_columns", "schema", "WARNING", "none", "none"),
    "SELECT 'schema.metadata_row_count', 'schema', 'CRITICAL', abs((SELECT count(*) FROM requests) - (SELECT count(*) FROM lineitem)), FALSE, "
    "(SELECT count(*) FROM requests)::VARCHAR, (SELECT count(*) FROM lineitem)::VARCHAR",
    _fixed("schema.identifier_representation", "schema", "ERROR", "string", "string or object preserving source digits"),
]
_CHECKS += _SCHEMA_CHECKS
_CHECKS += [
    "SELECT 'duplicate.missing_unique_key_rows', 'duplicate', 'CRITICAL', count(*) FILTER (WHERE unique_key IS NULL), FALSE, NULL, '0' FROM typed",
    "SELECT 'duplicate.redundant_exact_duplicate_rows', 'duplicate', 'WARNING', coalesce(sum(group_rows - 1) FILTER (WHERE NOT conflicting), 0), FALSE, NULL, '0' FROM material_keys",
    "SELECT 'duplicate.conflicting_duplicate_keys', 'duplicate', 'ERROR', count(*) FILTER (WHERE conflicting), FALSE, NULL, '0' FROM material_keys",
    "SELECT 'category.formatting_variants', 'category', 'WARNING', coalesce(sum(row_count), 0), FALSE, count(*)::VARCHAR, '0' FROM variants",
    _count_check("status.unexpected", "status", "ERROR",
                 "coalesce(lower(trim(status)), '') NOT IN ('closed', 'assigned', 'cancelled', 'duplicate', 'open', 'pending', 'started')"),
]
# Names, messages and actions by check, as the report shows them.
_WORDS = {
    **{f"scope.{k}": (k.replace("_", " ").title(), "Records match the authoritative scope.",
                      "Reject or re-ingest the raw run; do not clean across scope boundaries.") for k in _OUTSIDE},
    **{f"missingness.{c}": (f"Missing {c}", f"Nulls of {c} were measured and kept.", MISSING_ACTIONS[c]) for c in RAW_COLUMNS},
    **{f"null_like.{c}": (f"Blank or null-like {c}", "Text sentinels are kept apart from nulls.",
                          "Review and map only approved null-equivalent values in Step 7.") for c in RAW_COLUMNS},
    **{f"timestamp.{c}": (f"Parseable {c}", "Present timestamps can be read as UTC.",
                          "Quarantine invalid timestamp rows; do not guess or overwrite values.") for c in TIMESTAMP_COLUMNS},
    **{f"geography.{f}.{m}": (f"{f} {m}", "Geographic quality was measured, not corrected.",
                              "Preserve complaint and apply an approved feature-level policy in Step 7.") for f, m, _ in GEO_METRICS},
    **{f"chronology.{k}": (k.replace("_", " ").title(), "Timestamps follow the governed order.", VIOLATIONS[k][1]) for k in _CHRONOLOGY},
    **{f"metadata_scope.{k}": (f"Metadata scope {k}", "The manifest agrees with the scope authority.",
                               "Stop downstream work and create a new governed ingestion run.")
       for k in ("agency", "complaint_type", "start_date", "end_date")},
    "metadata.dataset_id": ("Expected dataset ID", "The run comes from the configured dataset.",
                            "Reject the raw run and re-ingest from the expected dataset."),
    "schema.non_empty": ("Non-empty dataset", "A raw run holds at least one record.", "Re-run or investigate Step 5 extraction."),
    "schema.unique_column_names": ("Unique column names", "Raw column names do not repeat.", "Correct the ingestion schema before cleaning."),
    "schema.required_columns": ("Required source columns", "Every governed source field is stored.",
                                "Reconcile source schema and ingestion selection."),
    "schema.metadata_columns": ("Stored columns match metadata", "Stored fields equal the fields the manifest selected.",
                                "Treat the raw run as inconsistent and re-ingest."),
    "schema.column_order": ("Column order matches metadata", "Stored order equals the configured order.",
                            "Preserve configured order during Step 7 reads."),
    "schema.unexpected_columns": ("Unexpected source columns", "A new source field may mean schema drift.",
                                  "Review new fields before any cleaning or feature use."),
    "schema.metadata_row_count": ("Row count matches metadata", "Stored rows reconcile to the manifest.",
                                  "Reject the inconsistent raw run and re-ingest."),
    "schema.identifier_representation": ("Identifier represented as string", "Identifiers are stored as text, not as numbers.",
                                         "Preserve the source identifier as a string in Step 7."),
    **{f"duplicate.{m}": (m.replace("_", " ").title(), "Duplicates are reported and none is removed.",
                          "Apply a deterministic approved duplicate rule in Step 7.")
       for m in ("missing_unique_key_rows", "redundant_exact_duplicate_rows", "conflicting_duplicate_keys")},
    "category.formatting_variants": ("Formatting variant groups", "Some values differ only in case or whitespace.",
                                     "Normalize only verified equivalent variants in Step 7."),
    "status.unexpected": ("Unexpected statuses", "Statuses belong to the allowed or the excluded policy.",
                          "Obtain a governance decision; do not silently map the status."),
}
CTES["check_words"] = union(f"SELECT {text(k)} AS check_id, {text(a)} AS check_name, {text(b)} AS message, {text(c)} AS action_if_found"
                            for k, (a, b, c) in _WORDS.items())
_OPTIONAL = ("chronology.closed_present_created_invalid", "chronology.due_present_created_invalid")
CTES["check_base"] = union(_CHECKS)
CTES["checks"] = f"""
  SELECT check_id, area, CASE WHEN area = 'missingness' AND affected = 0 THEN 'INFO' ELSE severity END AS severity,
    CASE WHEN always_passes OR affected = 0 THEN 'PASS' WHEN severity IN ('CRITICAL', 'ERROR') THEN 'FAIL'
      WHEN severity = 'WARNING' THEN 'WARN' ELSE 'INFO' END AS status, affected::BIGINT AS affected_rows,
    {raw_ratio('affected', '(SELECT count(*) FROM requests)')} AS affected_rate, check_name, message,
    coalesce(observed, affected::VARCHAR) AS observed_value, expected AS expected_value,
    CASE WHEN affected = 0 AND area = 'missingness' THEN {text(NOTHING_MISSING)}
      WHEN affected = 0 AND area = 'chronology' THEN 'No chronology action required.' ELSE action_if_found END AS recommended_step_7_action
  FROM check_base JOIN check_words USING (check_id) WHERE NOT (affected = 0 AND check_id IN {words(_OPTIONAL)})"""


def _schema_checks() -> tuple[str, str]:
    """The eight checks of the table as it is, and without descriptor_2 but with a new column at the end."""
    names = list(RAW_COLUMNS)
    drifted = [c for c in names if c != "descriptor_2"] + ["new_field"]
    rows, lines = "(SELECT count(*) FROM requests)", "(SELECT count(*) FROM lineitem)"
    stop = "Treat the raw run as inconsistent and re-ingest."

    def table(actual: list[str], full: bool) -> str:
        same, listing = actual == names, "|".join(actual)
        found = [
            ("non_empty", "Non-empty dataset", "CRITICAL", f"CASE WHEN {rows} > 0 THEN 0 ELSE 1 END", f"{rows}::VARCHAR", "'> 0'", "Re-run or investigate Step 5 extraction."),
            ("unique_column_names", "Unique column names", "CRITICAL", "0", "'none'", "'none'", "Correct the ingestion schema before cleaning."),
            ("required_columns", "Required source columns", "CRITICAL", "0" if same else "1", "'none'" if same else "'descriptor_2'", "'none missing'", "Reconcile source schema and ingestion selection."),
            ("metadata_columns", "Stored columns match metadata", "CRITICAL", "0" if same else "2", f"'{listing}'", f"'{'|'.join(names)}'", stop),
            ("column_order", "Column order matches metadata", "ERROR", "0" if same else "1", f"'{listing}'", f"'{'|'.join(names)}'", "Preserve configured order during Step 7 reads."),
            ("unexpected_columns", "Unexpected source columns", "WARNING", "0" if same else "1", "'none'" if same else "'new_field'", "'none'", "Review new fields before any cleaning or feature use."),
            ("metadata_row_count", "Row count matches metadata", "CRITICAL", f"abs({rows} - {lines})", f"{rows}::VARCHAR", f"{lines}::VARCHAR", "Reject the inconsistent raw run and re-ingest."),
            ("identifier_representation", "Identifier represented as string", "ERROR", "0", "'string'", "'string or object preserving source digits'", "Preserve the source identifier as a string in Step 7."),
        ]
        body = union(
            f"SELECT 'schema.{i}' AS check_id, '{sev}' AS severity, ({n})::BIGINT AS affected_rows, {seen} AS observed_value, {wanted} AS expected_value"
            + (f", 'schema' AS area, '{title}' AS check_name, '{action}' AS recommended_step_7_action" if full else "")
            for i, title, sev, n, seen, wanted, action in found)
        return f"""SELECT *, CASE WHEN affected_rows = 0 THEN 'PASS' WHEN severity IN ('CRITICAL', 'ERROR') THEN 'FAIL' ELSE 'WARN' END AS status,
          {ratio('affected_rows', rows)} AS affected_rate FROM ({body})"""

    return table(names, True), table(drifted, False)


# ---- queries ----------------------------------------------------------------

def _with(body: str) -> str:
    """Prefix a query with the shared steps it reaches."""
    needed: list[str] = []

    def visit(sql: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"(?:FROM|JOIN)\s+{name}\b", sql):
                visit(CTES[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    steps = ",\n".join(f"{name} AS ({CTES[name]})" for name in needed)
    return f"WITH {steps}\n{body}" if steps else body


def _distribution(columns) -> str:
    keys = ", ".join(f"coalesce({c}, '<MISSING>') AS {c}" for c in columns)
    return (f"SELECT {keys}, count(*)::BIGINT AS record_count, {pct('count(*)', '(SELECT count(*) FROM requests)')} "
            f"AS record_percentage FROM requests GROUP BY {', '.join(str(i + 1) for i in range(len(columns)))}")


def _coverage(key: str, name: str) -> str:
    return f"""SELECT {key} AS {name}, count(*)::BIGINT AS record_count, count(created_ts)::BIGINT AS created_date_count,
      count(closed_ts)::BIGINT AS closed_date_count, count(due_ts)::BIGINT AS due_date_count, {count_if(_COMPLETE)} AS target_eligible_count,
      {pct('count(created_ts)', 'count(*)')} AS created_date_coverage_pct, {pct('count(closed_ts)', 'count(*)')} AS closed_date_coverage_pct,
      {pct('count(due_ts)', 'count(*)')} AS due_date_coverage_pct, {pct(count_if(_COMPLETE), 'count(*)')} AS target_eligible_pct
      FROM typed GROUP BY 1"""


def _check_rows(group: str) -> str:
    return union(
        f"SELECT '{name}' AS check_name, {group}__{name}::BIGINT AS affected_count, "
        f"{pct_null(f'{group}__{name}', 'all_rows')} AS affected_percentage, '{sev}' AS severity FROM audit_totals"
        for name, sev in SEVERITIES[group].items())


def _level(x: str) -> str:
    return (f"CASE WHEN {x} IS NULL THEN 'not_computable' WHEN {x} = 0 THEN 'none' WHEN {x} < 5 THEN 'low' "
            f"WHEN {x} < 30 THEN 'moderate' WHEN {x} < 100 THEN 'high' ELSE 'complete' END")


def _metric_rows(pairs, source: str, label: str = "metric", value: str = "row_count") -> str:
    return union(f"SELECT '{name}' AS {label}, {expr} AS {value} FROM {source}" for name, expr in pairs)


_ROWS = "(SELECT count(*) FROM requests)"
_SAMPLE = f"""(SELECT *, row_number() OVER (PARTITION BY year(created_ts) ORDER BY created_ts, unique_key, source_row_index) AS sample_rank
    FROM typed WHERE created_ts IS NOT NULL QUALIFY sample_rank <= {S.SAMPLE_PER_YEAR})"""


def _column_profile() -> str:
    parts = []
    for c in RAW_COLUMNS:
        if c in TS:
            ok = f"TRY_CAST({c} AS TIMESTAMP) IS NOT NULL"
        elif c in ("latitude", "longitude"):
            ok = f"TRY_CAST({c} AS DOUBLE) IS NOT NULL"
        else:
            ok = f"{c} IS NOT NULL"
        parts.append(f"""SELECT '{c}' AS column_name, 'string' AS raw_dtype, count({c})::BIGINT AS non_null_count,
          (count(*) - count({c}))::BIGINT AS null_count, count(DISTINCT {c})::BIGINT AS distinct_count,
          coalesce((SELECT string_agg(v, ' | ' ORDER BY i) FROM (SELECT {c} AS v, min(row_place) AS i FROM requests
            WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY i, v LIMIT 3)), '') AS sample_values,
          '{SEMANTIC_TYPES.get(c, DEFAULT_SEMANTIC_TYPE)}' AS expected_semantic_type, {count_if(ok)} AS parseable_count,
          (count({c}) - {count_if(ok)})::BIGINT AS parse_failure_count,
          CASE WHEN count({c}) = {count_if(ok)} THEN 'PASS' ELSE 'WARN' END AS validation_status FROM requests""")
    return union(parts)


def _missingness() -> str:
    return union(f"""SELECT '{c}' AS column_name, '{ROLES[c]}' AS column_role, count(*)::BIGINT AS row_count,
      count({c})::BIGINT AS non_null_count, (count(*) - count({c}))::BIGINT AS null_count,
      {ratio(f'count(*) - count({c})', 'count(*)')} AS null_rate, {count_if(f"{c} = ''")} AS empty_string_count,
      {count_if(f"{c} <> '' AND trim({c}) = ''")} AS whitespace_only_count,
      {count_if(f"lower(trim({c})) IN {words(NULL_LIKE)}")} AS null_like_string_count,
      CASE WHEN count(*) = count({c}) THEN 'INFO' ELSE '{missing_severity(c)}' END AS missingness_severity,
      CASE WHEN count(*) = count({c}) THEN {text(NOTHING_MISSING)} ELSE {text(MISSING_ACTIONS[c])} END AS recommended_step_7_action FROM requests"""
                 for c in RAW_COLUMNS)


def _timestamp_profile() -> str:
    return union(f"""SELECT '{c}' AS column_name, count({c})::BIGINT AS non_null_count, count({t})::BIGINT AS parse_success_count,
      (count({c}) - count({t}))::BIGINT AS parse_failure_count,
      round(CASE WHEN count({c}) = 0 THEN 1.0 ELSE count({t})::DOUBLE / count({c}) END, 6) AS parse_success_rate,
      0::BIGINT AS timezone_aware_count, count({t})::BIGINT AS timezone_naive_count, {iso(f'min({t})')} AS minimum_timestamp,
      {iso(f'max({t})')} AS maximum_timestamp, coalesce((SELECT string_agg({c}, ' | ' ORDER BY source_row_index) FROM
        (SELECT {c}, source_row_index FROM typed WHERE {c} IS NOT NULL AND {t} IS NULL ORDER BY source_row_index LIMIT 5)), '')
        AS invalid_value_examples FROM typed""" for c, t in TS.items())


def _passes(flag: str) -> str:
    return f"NOT {flag}" if flag.startswith("is_") else flag


def _range_query(source: str, extra: str = "") -> str:
    return f"""SELECT {extra}candidate_name, {day('start_date')} AS start_date, {day('end_date')} AS end_date, total_records,
      eligible_target_count, {r('eligible_target_rate')} AS eligible_target_rate, {r('due_date_coverage')} AS due_date_coverage,
      {r('closed_date_coverage')} AS closed_date_coverage, missed_target_count, on_time_count,
      {r('missed_target_rate')} AS missed_target_rate, active_months,
      {r('median_monthly_eligible_records')} AS median_monthly_eligible_records, minimum_monthly_eligible_records,
      complaint_type_count, missing_month_count{', ' + r('invalid_timestamp_rate') + ' AS invalid_timestamp_rate' if extra else ''}
      FROM {source}"""


CTES["day_rows"] = f"""
  SELECT p.candidate_name, date_trunc('month', created_ts)::DATE AS month, complaint_type, {_PARTIALS}
  FROM periods p JOIN mine ON created_ts::DATE BETWEEN p.start_date AND p.end_date GROUP BY 1, 2, 3"""
CTES["day_ranges"] = range_rollup("day_rows")

_MONTH_SELECT = f"""total_records, due_date_present_count, closed_date_present_count, outcome_mature_count,
  outcome_immature_count, mature_open_count, invalid_timestamp_count, eligible_records, {r('eligible_rate')} AS eligible_rate,
  {r('due_date_coverage')} AS due_date_coverage, {r('closed_date_coverage')} AS closed_date_coverage,
  {r('outcome_maturity_rate')} AS outcome_maturity_rate, missed_count, on_time_count, {r('missed_target_rate')} AS missed_target_rate"""
_STABILITY_DOUBLES = (
    "eligible_rate", "due_date_coverage", "closed_date_coverage", "outcome_maturity_rate", "missed_target_rate",
    "mean_monthly_eligible_volume", "monthly_volume_standard_deviation", "monthly_volume_coefficient_of_variation",
    "minimum_monthly_missed_target_rate", "maximum_monthly_missed_target_rate", "monthly_target_rate_range", _DEV, _STEP)
_STABILITY_INTS = (
    "total_records", "eligible_records", "outcome_immature_count", "mature_open_count", "missed_count", "on_time_count",
    "active_months", "expected_months", "missing_months", "minimum_monthly_eligible_volume", "maximum_monthly_eligible_volume")
_FLAG_LIST = (
    "within_selected_scope", "has_created_date", "has_due_date", "has_closed_date", "valid_due_chronology",
    "valid_closed_chronology", "status_normalized", "status_allowed", "is_cancelled", "is_open",
    "status_closed_date_inconsistent", "outcome_mature", "is_exact_duplicate", "is_conflicting_duplicate", "target_eligible")
_AGENCY_RULES = {
    "passes_eligible_volume": f"eligible_target_count >= {L.minimum_candidate_eligible_records}",
    "passes_due_date_coverage": "due_date_coverage >= 0.7", "passes_closed_date_coverage": "closed_date_coverage >= 0.8",
    "passes_temporal_coverage": "active_months >= 12", "passes_data_consistency": "invalid_timestamp_rate <= 0.05",
    "passes_target_balance": "eligible_target_count > 0 AND missed_target_rate BETWEEN 0.05 AND 0.95",
    "passes_recent_activity": f"coalesce(last_created_date >= {RECENT}, FALSE)",
}
CTES["agency_rules"] = f"""
  SELECT *, {", ".join(f"({v}) AS {k}" for k, v in _AGENCY_RULES.items())} FROM (
    SELECT *, {raw_ratio('invalid_due_sequence_count + invalid_closed_sequence_count', 'total_records')} AS invalid_timestamp_rate FROM agencies)"""
_SIG = {"created_date": "created_ts", "due_date": "due_ts", "closed_date": "closed_ts", "agency": "agency",
        "complaint_type": "complaint_type", "status": "status"}
_SIG_FIELDS = ", ".join(
    f"CASE WHEN count(DISTINCT coalesce({c}::VARCHAR, '<NA>')) > 1 THEN '{name}' END" for name, c in _SIG.items())
_DIAG = {**{c: c for c in DIAGNOSTIC_CONFLICT_COLUMNS}, "created_date": "created_ts", "closed_date": "closed_ts", "due_date": "due_ts"}


def _queries() -> dict[str, str]:
    q: dict[str, str] = {}
    # overview
    q["dataset_scope"] = f"SELECT count(*)::BIGINT AS row_count, {iso('min(created_ts)')} AS minimum_created_date, {iso('max(created_ts)')} AS maximum_created_date FROM typed"
    q["column_inventory"] = union(
        f"SELECT {i}::BIGINT AS column_position, '{c}' AS column_name, 'string' AS storage_type, count({c})::BIGINT AS non_null_count, "
        f"(count(*) - count({c}))::BIGINT AS missing_count FROM requests" for i, c in enumerate(RAW_COLUMNS, 1))
    q["column_presence"] = union(
        f"SELECT '{c}' AS column_name, (count(*) - count({c}))::BIGINT AS objects_without_key, 0::BIGINT AS explicit_nulls, "
        f"count({c})::BIGINT AS objects_with_key FROM landed" for c in RAW_COLUMNS)
    q["table_facts"] = "SELECT count(*)::BIGINT AS row_count, 18::BIGINT AS column_count FROM requests"
    for name, columns in {
        "agency": ("agency", "agency_name"), "type": ("complaint_type",), "descriptor": ("descriptor",),
        "type_descriptor": ("complaint_type", "descriptor"), "status": ("status",), "borough": ("borough",),
        "channel": ("open_data_channel_type",), "location": ("location_type",),
    }.items():
        q[f"dist_{name}"] = _distribution(columns)
    q["by_year"] = f"""SELECT year(created_ts)::BIGINT AS created_year, count(*)::BIGINT AS record_count,
      {pct('count(*)', '(SELECT count(created_ts) FROM typed)')} AS record_percentage,
      year(created_ts) = (SELECT max(year(created_ts)) FROM typed) AND max(created_ts) < make_timestamp(year(created_ts), 12, 31, 23, 59, 59.0)
        AS is_partial_year FROM typed WHERE created_ts IS NOT NULL GROUP BY year(created_ts)"""
    q["by_month"] = f"SELECT {day("date_trunc('month', created_ts)")} AS created_month, count(*)::BIGINT AS record_count FROM typed WHERE created_ts IS NOT NULL GROUP BY 1"
    q["date_coverage"] = union(
        f"SELECT '{c}' AS column_name, {iso(f'min({t})')} AS minimum_date, {iso(f'max({t})')} AS maximum_date, "
        f"count({c})::BIGINT AS non_null_count, (count(*) - count({c}))::BIGINT AS missing_count, "
        f"{pct(f'count(*) - count({c})', 'count(*)')} AS missing_percentage FROM typed" for c, t in TS.items())
    q["yearly_sample"] = f"SELECT year(created_ts)::BIGINT AS created_year, sample_rank::BIGINT AS sample_rank, unique_key, source_row_index FROM {_SAMPLE}"
    q["sample_columns"] = union(
        f"SELECT '{c}' AS column_name, count({c})::BIGINT AS non_null_count, (count(*) - count({c}))::BIGINT AS missing_count, "
        f"{pct(f'count(*) - count({c})', 'count(*)')} AS missing_percentage, count(DISTINCT {c})::BIGINT AS unique_count FROM {_SAMPLE}"
        for c in RAW_COLUMNS)
    values = ", ".join(
        f"(count(DISTINCT {c}) + max(({c} IS NULL)::INT))::BIGINT AS {c}_values"
        for c in ("agency", "complaint_type", "descriptor", "status", "borough", "open_data_channel_type"))
    q["overview_facts"] = f"""SELECT count(*)::BIGINT AS row_count, {day('min(created_ts)')} AS first_created_day,
      {day('max(created_ts)')} AS last_created_day, {values},
      max(created_ts) < make_timestamp(year(max(created_ts)), 12, 31, 23, 59, 59.0) AS latest_year_is_partial,
      CASE WHEN count(DISTINCT agency) > 1 AND count(DISTINCT complaint_type) > 1 THEN 'broad' ELSE 'narrow' END AS source_breadth FROM typed"""
    q["extraction_metadata"] = f"""SELECT 'sample tables' AS source, '2001-07-20T00:00:00+00:00' AS extraction_timestamp,
      count(*)::BIGINT AS row_count, {iso('min(created_ts)')} AS minimum_created_date, {iso('max(created_ts)')} AS maximum_created_date,
      'created_date ASC, unique_key ASC' AS ordering, {S.PAGE_LIMIT}::BIGINT AS page_size,
      ceil(count(*) / {S.PAGE_LIMIT}.0)::BIGINT AS page_count FROM typed"""
    q["scope_filter"] = f"SELECT source_row_index, {', '.join(RAW_COLUMNS)} FROM flags WHERE within_selected_scope"
    q["head_preview"] = "SELECT source_row_index, unique_key, agency, status FROM requests ORDER BY created_date NULLS FIRST, unique_key, source_row_index LIMIT 10"
    q["seeded_preview"] = "SELECT source_row_index, unique_key, agency, status FROM requests ORDER BY md5('42:' || source_row_index), source_row_index LIMIT 5"
    # source audit
    q["column_requirements"] = union(
        f"SELECT '{c}' AS column_name, '{group}' AS column_group, TRUE AS is_present, '{sev}' AS severity_if_missing, "
        f"count({c})::BIGINT AS non_null_count FROM requests" for group, columns, sev in COLUMN_GROUPS for c in columns)
    q["missing_values"] = union(
        f"SELECT '{c}' AS column_name, all_rows::BIGINT AS total_rows, (all_rows - missing__{c})::BIGINT AS non_null_count, "
        f"missing__{c}::BIGINT AS missing_count, {pct_null(f'missing__{c}', 'all_rows')} AS missing_percentage, "
        f"{_level(pct_null(f'missing__{c}', 'all_rows'))} AS missingness_level, {text(', '.join(g for g, columns, _ in COLUMN_GROUPS if c in columns) or 'selected_project_field')} AS column_role FROM audit_totals"
        for c in RAW_COLUMNS)
    q["missing_patterns"] = _check_rows("pattern")
    q["timestamp_consistency"] = _check_rows("chronology")
    q["status_timestamp"] = _check_rows("status")
    q["geo_quality"] = _check_rows("geo")
    q["status_categories"] = """SELECT CASE WHEN status = 'Closed' THEN 'closed'
        WHEN status IN ('Assigned', 'In Progress', 'Open', 'Pending', 'Started') THEN 'open_or_active'
        WHEN status IN ('Cancel', 'Cancelled', 'Unspecified') THEN 'excluded_or_special' ELSE 'unclassified' END AS status_category,
      count(*) OVER c AS status_values, (sum(n) OVER c)::BIGINT AS record_count, status AS observed_value, n AS value_count
      FROM (SELECT status, count(*) AS n FROM requests WHERE status IS NOT NULL GROUP BY 1) WINDOW c AS (PARTITION BY status_category)"""
    q["categorical_checks"] = f"SELECT column_name, check_name, 'computed' AS status, affected_count, {pct_null('affected_count', _ROWS)} AS affected_percentage FROM audit_checks"
    q["case_collisions"] = """SELECT column_name, lower(value) AS normalized_value, count(*) OVER f AS raw_variant_count, value AS raw_variant,
      row_count::BIGINT AS variant_rows, (sum(row_count) OVER f)::BIGINT AS affected_count
      FROM audit_counts WHERE value IS NOT NULL WINDOW f AS (PARTITION BY column_name, lower(value)) QUALIFY raw_variant_count > 1"""
    q["agency_name_mapping"] = """SELECT agency, count(*) OVER a AS agency_name_variant_count, agency_name, n AS name_rows,
      (sum(n) OVER a)::BIGINT AS affected_count
      FROM (SELECT agency, agency_name, count(*) AS n FROM requests GROUP BY 1, 2) WINDOW a AS (PARTITION BY agency) QUALIFY agency_name_variant_count > 1"""
    q["duplicate_groups"] = "SELECT unique_key, count(*)::BIGINT AS record_count FROM requests WHERE unique_key IS NOT NULL GROUP BY 1 HAVING count(*) > 1"
    fields = ", ".join(f"CASE WHEN count(DISTINCT {c}) > 1 THEN '{c}' END" for c in OVERVIEW_CONFLICT_COLUMNS)
    q["conflicting_keys"] = f"""SELECT unique_key AS duplicate_unique_key, record_count, len(fields)::BIGINT AS conflicting_field_count,
      array_to_string(fields, ', ') AS conflicting_fields FROM (SELECT unique_key, count(*)::BIGINT AS record_count,
        list_filter([{fields}], lambda x: x IS NOT NULL) AS fields FROM requests WHERE unique_key IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
      WHERE len(fields) > 0"""
    q["duplicate_summary_full"] = f"""SELECT check_name, 'computed' AS status, affected_count,
      CASE WHEN has_share THEN {pct_null('affected_count', _ROWS)} END AS affected_percentage FROM audit_duplicates"""
    q["full_row_duplicates"] = "SELECT count(*)::BIGINT AS duplicate_groups, coalesce(sum(n), 0)::BIGINT AS duplicate_rows, coalesce(sum(n - 1), 0)::BIGINT AS excess_rows FROM whole_rows WHERE n > 1"
    issues = []
    for c in RAW_COLUMNS:
        if c in ("closed_date", "due_date"):
            sev = "'critical_for_target'"
        elif c in ("unique_key", "created_date", "agency", "complaint_type"):
            sev = "'warning'"
        else:
            sev = (f"CASE WHEN {_level(pct_null(f'missing__{c}', 'all_rows'))} IN ('high', 'complete') "
                   "THEN 'review_required' ELSE 'informational' END")
        issues.append(f"SELECT 2 AS place, {sev} AS severity, 'missingness' AS category, 'column_missing_values' AS check_name, "
                      f"'{c}' AS column_name, missing__{c}::BIGINT AS affected_count, TRUE AS has_share FROM audit_totals")
    for group, place, category in (("pattern", 3, "missing_patterns"), ("chronology", 5, "timestamp_consistency"),
                                   ("status", 6, "status_timestamp_consistency"), ("geo", 8, "geographic_quality")):
        issues += [f"SELECT {place}, '{sev}', '{category}', '{name}', '', {group}__{name}::BIGINT, TRUE FROM audit_totals"
                   for name, sev in SEVERITIES[group].items()]
    issues.append("""SELECT 4, CASE WHEN check_name = 'exact_duplicate_rows' THEN 'warning' ELSE 'critical' END, 'duplicates', check_name,
      CASE WHEN contains(check_name, 'unique_key') THEN 'unique_key' ELSE '' END, affected_count, has_share FROM audit_duplicates
      WHERE check_name IN ('null_unique_key', 'duplicated_unique_key_groups', 'excess_duplicate_id_rows', 'conflicting_duplicate_ids', 'exact_duplicate_rows')""")
    issues.append("SELECT 7, 'review_required', 'categorical_quality', check_name, column_name, affected_count, TRUE FROM audit_checks")
    issues.append("""SELECT 7, 'review_required', 'categorical_quality', 'agency_name_mapping', 'agency_name', coalesce(sum(n), 0)::BIGINT, FALSE
      FROM (SELECT count(*) AS n FROM requests WHERE agency IS NOT NULL GROUP BY agency HAVING count(DISTINCT agency_name) > 1)""")
    q["issue_register"] = f"""SELECT 'DQ-' || lpad(row_number() OVER (ORDER BY place, check_name, column_name)::VARCHAR, 4, '0') AS issue_id,
      severity, category, check_name, column_name, affected_count,
      CASE WHEN has_share THEN {pct_null('affected_count', _ROWS)} END AS affected_percentage
      FROM ({union(issues)}) WHERE affected_count > 0"""
    ordered = " + ".join(f"chronology__{k}" for k, v in CHRONOLOGY_SEVERITY.items() if v != "informational")
    findings = " + ".join(
        [f"chronology__{k}" for k, v in CHRONOLOGY_SEVERITY.items() if v == "critical_for_target"]
        + [f"status__{k}" for k, v in STATUS_SEVERITY.items() if v == "critical_for_target"]
        + ["missing__closed_date", "missing__due_date"])
    empty = "(missing__closed_date = all_rows)::INT + (missing__due_date = all_rows)::INT"
    repeated = ("(SELECT sum(affected_count) FROM audit_duplicates WHERE check_name IN "
                "('null_unique_key', 'duplicated_unique_key_groups'))")
    q["readiness"] = union([
        "SELECT 'Core schema readiness' AS readiness_area, 0::BIGINT AS evidence_count, 'Passed' AS status",
        f"SELECT 'Target-input structural availability', ({empty})::BIGINT, CASE WHEN {empty} = 0 THEN 'Passed' ELSE 'Failed' END FROM audit_totals",
        f"SELECT 'Target-quality readiness', ({findings})::BIGINT, CASE WHEN {findings} > 0 THEN 'Provisional review required' "
        "ELSE 'No material issue detected by configured checks' END FROM audit_totals",
        f"SELECT 'Timestamp integrity', ({ordered})::BIGINT, CASE WHEN {ordered} = 0 THEN 'Passed' ELSE 'Review required' END FROM audit_totals",
        "SELECT 'Candidate-feature availability', 0::BIGINT, 'Passed'",
        f"SELECT 'Duplicate integrity', {repeated}::BIGINT, CASE WHEN {repeated} = 0 THEN 'Passed' ELSE 'Review required' END",
    ])
    # feasibility
    q["timestamp_parse_summary"] = union(
        f"SELECT '{c}' AS column_name, count(*)::BIGINT AS total_rows, count({c})::BIGINT AS raw_non_null_count, "
        f"(count(*) - count({c}))::BIGINT AS raw_missing_count, count({TS[c]})::BIGINT AS parsed_non_null_count, "
        f"(count(*) - count({TS[c]}))::BIGINT AS parsed_missing_count, (count({c}) - count({TS[c]}))::BIGINT AS parse_failure_count, "
        f"{pct(f'count({c}) - count({TS[c]})', f'count({c})')} AS parse_failure_pct_of_raw_non_null FROM typed"
        for c in ("created_date", "closed_date", "due_date"))
    q["target_field_coverage"] = union(
        f"SELECT '{c}' AS column_name, count(*)::BIGINT AS total_rows, count({TS.get(c, c)})::BIGINT AS non_null_count, "
        f"(count(*) - count({TS.get(c, c)}))::BIGINT AS missing_count, {pct(f'count({TS.get(c, c)})', 'count(*)')} AS coverage_pct, "
        f"{pct(f'count(*) - count({TS.get(c, c)})', 'count(*)')} AS missing_pct FROM typed"
        for c in ("unique_key", "created_date", "closed_date", "due_date", "agency", "complaint_type", "status"))
    q["eligibility_funnel"] = union(
        f"SELECT '{name}' AS metric, {count_if(cond)} AS record_count, {pct(count_if(cond), 'count(*)')} AS percentage_of_total FROM typed"
        for name, cond in {
            "total_records": "TRUE", "has_created_date": "created_ts IS NOT NULL", "has_closed_date": "closed_ts IS NOT NULL",
            "has_due_date": "due_ts IS NOT NULL", "has_closed_and_due_date": "closed_ts IS NOT NULL AND due_ts IS NOT NULL",
            "fully_target_eligible": _COMPLETE}.items())
    q["basic_eligibility"] = f"""SELECT CASE WHEN created_ts IS NULL THEN 'missing_created_date'
        WHEN closed_ts IS NOT NULL AND due_ts IS NULL THEN 'has_closed_date_missing_due_date'
        WHEN closed_ts IS NULL AND due_ts IS NOT NULL THEN 'missing_closed_date_only'
        WHEN closed_ts IS NULL THEN 'missing_closed_and_due_date' ELSE 'eligible' END AS target_exclusion_reason,
      count(*)::BIGINT AS record_count, {pct('count(*)', _ROWS)} AS percentage_of_total FROM typed GROUP BY 1"""
    q["target_classes"] = union(
        f"SELECT {k}::BIGINT AS target_class, {count_if(cond)} AS record_count, {pct(count_if(cond), count_if(_COMPLETE))} AS percentage_of_eligible FROM typed"
        for k, cond in ((0, f"{_COMPLETE} AND closed_ts <= due_ts"), (1, f"{_COMPLETE} AND closed_ts > due_ts")))
    for key in ("complaint_type", "status", "agency"):
        q[f"coverage_by_{key}"] = _coverage(key, key)
    q["coverage_by_created_year"] = _coverage("year(created_ts)::BIGINT", "created_year")
    for suffix, key, name in (("", "complaint_type", "complaint_type"), ("_status", "status", "status"), ("_year", "year(created_ts)::BIGINT", "created_year")):
        q[f"coverage_headline{suffix}"] = f"""SELECT count(*)::BIGINT AS group_count, {count_if('due_date_count > 0')} AS groups_with_due_dates,
          {count_if('target_eligible_count > 0')} AS groups_with_eligible_records, max(due_date_coverage_pct) AS maximum_due_date_coverage_pct
          FROM ({_coverage(key, name)})"""
    q["timestamp_checks"] = union(
        f"SELECT '{name}' AS check_name, {count_if(pair)} AS evaluable_row_count, {count_if(hit)} AS matching_or_violation_count, "
        f"{pct_null(count_if(hit), count_if(pair))} AS percentage_of_evaluable_rows, "
        f"CASE WHEN {count_if(pair)} > 0 THEN 'evaluated' ELSE 'not_evaluable' END AS evaluation_status FROM typed"
        for name, pair, hit in (
            ("closed_date_before_created_date", "closed_ts IS NOT NULL AND created_ts IS NOT NULL", "closed_ts < created_ts"),
            ("due_date_before_created_date", "due_ts IS NOT NULL AND created_ts IS NOT NULL", "due_ts < created_ts"),
            ("closed_date_after_due_date", "closed_ts IS NOT NULL AND due_ts IS NOT NULL", "closed_ts > due_ts"),
            ("closed_date_equal_to_due_date", "closed_ts IS NOT NULL AND due_ts IS NOT NULL", "closed_ts = due_ts")))
    mine = f"agency = {text(S.AGENCY)}"
    q["violation_rate_ratio"] = f"""SELECT {text(S.AGENCY)} AS agency, a AS agency_violations, b AS agency_evaluable, c AS baseline_violations,
      d AS baseline_rows, {r('100.0 * a / b')} AS agency_pct, {r('100.0 * c / d')} AS baseline_pct,
      {r('(100.0 * a / b) / (100.0 * c / d)')} AS rate_ratio, {r('100.0 * a / c')} AS share_of_violations
      FROM (SELECT {count_if(f'{mine} AND closed_ts < created_ts')} AS a, {count_if(f'{mine} AND closed_ts IS NOT NULL AND created_ts IS NOT NULL')} AS b,
        {count_if('closed_ts < created_ts')} AS c, count(*)::BIGINT AS d FROM typed)"""
    q["feasibility_decision"] = f"""SELECT {text(S.AGENCY)} AS agency, n AS total_record_count, due AS due_date_non_null_count,
      {pct('due', 'n')} AS due_date_coverage_pct, closed AS closed_date_non_null_count, {pct('closed', 'n')} AS closed_date_coverage_pct,
      e AS eligible_record_count, {pct('e', 'n')} AS eligible_record_pct,
      CASE WHEN e > 0 THEN 'created' ELSE 'not_created' END AS target_creation_status,
      CASE WHEN e > 0 THEN 'REQUIRES_FURTHER_REVIEW' ELSE 'NOT_FEASIBLE' END AS feasibility_status,
      CASE WHEN due = 0 THEN 'No usable due_date values' WHEN closed = 0 THEN 'No usable closed_date values'
        WHEN e = 0 THEN 'Required timestamps do not coexist on any record' ELSE 'Further semantic and population review required' END AS primary_blocker
      FROM (SELECT count(*)::BIGINT AS n, count(due_ts)::BIGINT AS due, count(closed_ts)::BIGINT AS closed, {count_if(_COMPLETE)} AS e FROM mine)"""
    # raw validation
    q["schema_checks"], q["schema_checks_drift"] = _schema_checks()
    q["column_profile"] = _column_profile()
    q["scope_validation"] = union(
        f"SELECT '{k}' AS scope_rule, {count_if(v)} AS affected_row_count, {ratio(count_if(v), 'count(*)')} AS affected_row_rate, "
        f"{text(w)} AS expected_value, CASE WHEN {count_if(v)} = 0 THEN 'PASS' ELSE 'FAIL' END AS status, 'CRITICAL' AS severity FROM typed"
        for (k, v), w in zip(_OUTSIDE.items(), (S.SCOPE.agency, S.SCOPE.complaint_type, S.SCOPE.start, S.SCOPE.end, "0")))
    q["missingness"] = _missingness()
    q["timestamp_profile"] = _timestamp_profile()
    q["invalid_timestamps"] = union(
        f"SELECT * FROM (SELECT '{c}' AS column_name, unique_key, {c} AS raw_value, "
        f"row_number() OVER (ORDER BY source_row_index)::BIGINT AS place FROM typed WHERE {c} IS NOT NULL AND {t} IS NULL) WHERE place <= 10"
        for c, t in TS.items())
    q["chronology_violations"] = union(
        f"SELECT unique_key, created_date AS created_date_raw, due_date AS due_date_raw, closed_date AS closed_date_raw, "
        f"resolution_action_updated_date AS resolution_action_updated_date_raw, '{k}' AS violation_type, "
        f"'{VIOLATIONS[k][0]}' AS severity, {text(VIOLATIONS[k][1])} AS recommended_step_7_action FROM typed WHERE {v}" for k, v in _CHRONOLOGY.items())
    q["duplicate_summary"] = _metric_rows([
        ("duplicate_full_rows", "max(coalesce((SELECT sum(n) FROM whole_rows WHERE n > 1), 0))::BIGINT"),
        ("duplicate_unique_key_groups", "count(*)::BIGINT"), ("rows_in_duplicate_key_groups", n("sum(group_rows)")),
        ("redundant_exact_duplicate_rows", n("sum(group_rows - 1) FILTER (WHERE NOT conflicting)")),
        ("conflicting_duplicate_keys", count_if("conflicting")),
        ("rows_in_conflicting_groups", n("sum(group_rows) FILTER (WHERE conflicting)")),
        ("missing_unique_key_rows", "max((SELECT count(*) FROM requests WHERE unique_key IS NULL))::BIGINT")], "material_keys")
    q["exact_duplicates"] = """SELECT unique_key, group_rows::BIGINT AS duplicate_group_size, source_row_index = canonical_id AS canonical_row,
      source_row_index FROM requests JOIN material_keys USING (unique_key) WHERE NOT conflicting"""
    q["conflicting_duplicates"] = f"""SELECT unique_key, group_rows::BIGINT AS duplicate_group_size, conflicting_fields, source_row_index,
      {', '.join(MATERIAL_COLUMNS)} FROM requests JOIN material_keys USING (unique_key) WHERE conflicting"""
    form = "coalesce(lower(regexp_replace(trim(value), '\\s+', ' ', 'g')), '<NULL>')"
    q["category_profile"] = f"""SELECT column_name, coalesce(value, '<NULL>') AS raw_value, {form} AS normalised_comparison_value,
      row_count::BIGINT AS row_count, {ratio('row_count', _ROWS)} AS row_share, coalesce(value <> ltrim(value), FALSE) AS has_leading_whitespace,
      coalesce(value <> rtrim(value), FALSE) AS has_trailing_whitespace, coalesce(value = '', FALSE) AS is_empty,
      coalesce(value <> '' AND trim(value) = '', FALSE) AS is_whitespace_only,
      value IS NOT NULL AND {form} IN {words(list(NULL_LIKE) + [''])} AS is_null_like_string, {form} AS case_variant_group,
      row_count <= 10 AS is_rare_category, column_distinct_count::BIGINT AS column_distinct_count,
      column_distinct_count > 1000 AS is_high_cardinality
      FROM (SELECT *, count(value) OVER (PARTITION BY column_name) AS column_distinct_count FROM profile_counts)"""
    q["category_variants"] = f"""SELECT v.column_name, v.normalised_comparison_value, v.raw_variant_count::BIGINT AS raw_variant_count, p.value AS raw_variant,
      p.row_count::BIGINT AS variant_rows, v.row_count, v.variant_type FROM variants v JOIN profile_counts p ON v.column_name = p.column_name
      AND v.normalised_comparison_value = lower(regexp_replace(trim(p.value), '\\s+', ' ', 'g'))"""
    policy = ("CASE WHEN lower(trim(status)) = 'closed' THEN 'ALLOWED' WHEN lower(trim(status)) IN "
              "('assigned', 'cancelled', 'duplicate', 'open', 'pending', 'started') THEN 'EXCLUDED' ELSE 'UNEXPECTED' END")
    q["status_validation"] = f"""SELECT coalesce(status, '<NULL>') AS status_raw, coalesce(lower(trim(status)), '<MISSING>') AS status_comparison_normalised,
      count(*)::BIGINT AS row_count, {ratio('count(*)', _ROWS)} AS row_share, {ratio('count(due_ts)', 'count(*)')} AS due_date_coverage,
      {ratio('count(closed_ts)', 'count(*)')} AS closed_date_coverage, {ratio('count(created_ts)', 'count(*)')} AS created_date_coverage,
      {count_if('due_ts < created_ts OR closed_ts < created_ts')} AS chronology_violation_count, {policy} AS step_4_policy,
      {policy} <> 'UNEXPECTED' AS is_expected, CASE {policy} WHEN 'ALLOWED' THEN 'Preserve; apply governed status normalization only in Step 7.'
        WHEN 'EXCLUDED' THEN 'Preserve row and keep target-ineligible under Step 4 policy.'
        ELSE 'Obtain governance decision before mapping or target construction.' END AS recommended_step_7_action FROM typed GROUP BY status"""
    q["geo_summary"] = union(
        f"SELECT '{f}' AS field, '{m}' AS metric, {count_if(_GEO[(f, m)])} AS row_count, {ratio(count_if(_GEO[(f, m)]), 'count(*)')} AS row_rate, "
        f"'{sev}' AS severity FROM typed" for f, m, sev in GEO_METRICS)
    q["geo_outliers"] = union(
        f"SELECT unique_key, '{f}' AS field, {f if f != 'coordinate_pair' else chr(39).join(['latitude || ', ',', ' || longitude'])} AS raw_value, "
        f"'{m}' AS issue_type, '{sev}' AS severity FROM typed WHERE {_GEO[(f, m)]}"
        for f, m, sev in GEO_METRICS if m not in ("missing", "parseable"))
    q["target_readiness"] = union(
        f"SELECT '{x}' AS readiness_rule, {count_if(x)} AS true_count, {count_if(f'NOT {x}')} AS false_count, {count_if(_passes(x))} AS pass_count, "
        f"(count(*) - {count_if(_passes(x))})::BIGINT AS fail_count, {ratio(count_if(_passes(x)), 'count(*)')} AS pass_rate, TRUE AS provisional FROM ready"
        for x in READINESS_RULES)
    q["candidate_exclusions"] = f"SELECT candidate_exclusion_reason, count(*)::BIGINT AS row_count, {ratio('count(*)', _ROWS)} AS row_share FROM ready GROUP BY 1"
    q["validation_checks"] = f"SELECT * REPLACE ({r('affected_rate')} AS affected_rate) FROM checks"
    found = {s: f"count(*) FILTER (WHERE status <> 'PASS' AND severity = '{s.upper()}')" for s in ("critical", "error", "warning", "info")}
    q["validation_verdict"] = f"""SELECT count(*)::BIGINT AS check_count, {", ".join(f"{v}::BIGINT AS {k}_findings" for k, v in found.items())},
      CASE WHEN {found['critical']} > 0 THEN 'CRITICAL' WHEN {found['error']} > 0 THEN 'ERROR' WHEN {found['warning']} > 0 THEN 'WARNING'
        WHEN {found['info']} > 0 THEN 'INFO' ELSE 'PASS' END AS overall_status,
      (CASE WHEN {found['critical']} > 0 THEN 2 WHEN {found['error']} > 0 THEN 1 ELSE 0 END)::BIGINT AS gate_code FROM checks"""
    q["proposed_actions"] = """SELECT check_id AS issue_id, area AS validation_area,
      CASE WHEN area IN ('missingness', 'timestamp') OR check_id LIKE 'null!_like.%' ESCAPE '!' THEN split_part(check_id, '.', -1)
        WHEN area = 'geography' THEN split_part(check_id, '.', 2) WHEN area = 'status' THEN 'status' WHEN area = 'duplicate' THEN 'unique_key'
        ELSE '' END AS source_column, affected_rows, severity, message AS issue_description, check_name AS source_rule,
      recommended_step_7_action AS proposed_action,
      CASE WHEN area IN ('category', 'status') THEN 'GOVERNANCE_REVIEW' ELSE 'STEP_7_RULE' END AS action_type,
      area IN ('category', 'status') AS requires_governance_approval FROM checks WHERE status <> 'PASS' AND affected_rows > 0"""
    # governed label
    q["eligibility_flags"] = f"SELECT source_row_index, unique_key, {', '.join(_FLAG_LIST)} FROM governed"
    q["exclusion_reason"] = "SELECT source_row_index, primary_exclusion_reason FROM governed"
    q["missed_target"] = "SELECT source_row_index, target_eligible, missed_resolution_target FROM governed"
    q["eligibility_invariants"] = """SELECT (SELECT count(*) FROM governed WHERE target_eligible <> (primary_exclusion_reason = 'eligible'))::BIGINT AS flag_reason_mismatch,
      (SELECT count(*) FROM governed WHERE target_eligible AND unique_key IS NULL)::BIGINT AS eligible_null_keys,
      (SELECT count(*) FROM (SELECT unique_key FROM governed WHERE target_eligible GROUP BY 1 HAVING count(*) > 1))::BIGINT AS eligible_repeated_keys"""
    e, m = count_if("target_eligible"), count_if("missed_resolution_target = 1")
    q["target_summary"] = f"""SELECT {text(S.SCOPE.agency)} AS selected_agency, {text(S.SCOPE.complaint_type)} AS selected_complaint_type,
      '{S.SCOPE.start}' AS selected_start_date, '{S.SCOPE.end}' AS selected_end_date, '{S.SCOPE.extracted_at.isoformat()}' AS extraction_timestamp,
      count(*)::BIGINT AS total_selected_rows, {e} AS target_eligible_rows, (count(*) - {e})::BIGINT AS target_ineligible_rows,
      {ratio(e, 'count(*)')} AS eligibility_rate, {m} AS missed_count, {count_if('missed_resolution_target = 0')} AS on_time_count,
      {ratio(m, e)} AS missed_target_rate, {count_if('is_open')} AS open_count, {count_if('is_cancelled')} AS cancelled_count,
      {count_if('is_exact_duplicate')} AS exact_duplicate_count, {count_if('is_conflicting_duplicate')} AS conflicting_duplicate_count,
      {count_if('NOT valid_due_chronology')} AS invalid_due_chronology_count, {count_if('NOT valid_closed_chronology')} AS invalid_closed_chronology_count,
      {count_if('has_due_date AND NOT outcome_mature')} AS outcome_immature_count FROM governed"""
    q["target_distribution"] = union(
        f"SELECT {v}::BIGINT AS target_value, '{label}' AS target_label, {count_if(f'missed_resolution_target = {v}')} AS row_count, "
        f"{ratio(count_if(f'missed_resolution_target = {v}'), e)} AS row_share FROM governed" for v, label in ((0, "on_time"), (1, "missed")))
    q["rule_pass_counts"] = union(
        f"SELECT '{x}' AS rule_name, {count_if(_passes(x))} AS pass_count, (count(*) - {count_if(_passes(x))})::BIGINT AS fail_count, "
        f"{ratio(count_if(_passes(x)), 'count(*)')} AS pass_rate FROM governed" for x in RULES)
    q["exclusion_reasons"] = f"SELECT primary_exclusion_reason, count(*)::BIGINT AS row_count, {ratio('count(*)', _ROWS)} AS row_share FROM governed GROUP BY 1"
    treatment = ("CASE WHEN status_normalized = 'closed' THEN 'include when all other rules pass' WHEN status_normalized IN "
                 "('assigned', 'cancelled', 'duplicate', 'open', 'pending', 'started') THEN 'exclude' ELSE 'exclude pending governance review' END")
    q["status_analysis"] = f"""SELECT coalesce(status_normalized, '<MISSING>') AS status, count(*)::BIGINT AS row_count, {ratio('count(*)', _ROWS)} AS row_share,
      {ratio(count_if('has_created_date'), 'count(*)')} AS created_date_coverage, {ratio(count_if('has_due_date'), 'count(*)')} AS due_date_coverage,
      {ratio(count_if('has_closed_date'), 'count(*)')} AS closed_date_coverage, {count_if('outcome_mature')} AS outcome_mature_count,
      {e} AS target_eligible_count, {treatment} AS proposed_treatment, {treatment} AS final_treatment FROM governed GROUP BY status_normalized"""
    q["timestamp_violations"] = _metric_rows([
        ("due_before_created", count_if("NOT valid_due_chronology")), ("closed_before_created", count_if("NOT valid_closed_chronology")),
        ("status_closed_date_inconsistent", count_if("status_closed_date_inconsistent"))], "governed", "violation")
    q["maturity_summary"] = union(
        f"SELECT '{k}' AS outcome_maturity, {count_if(v)} AS row_count, {ratio(count_if(v), 'count(*)')} AS row_share FROM governed"
        for k, v in {"mature": "outcome_mature", "not_mature": "has_due_date AND NOT outcome_mature",
                     "missing_due_date": "NOT has_due_date", "mature_open": "outcome_mature AND is_open"}.items())
    q["open_breakdown"] = "SELECT status_normalized, outcome_mature, primary_exclusion_reason, count(*)::BIGINT AS row_count FROM governed WHERE is_open AND status_normalized IS NOT NULL GROUP BY 1, 2, 3"
    q["cancelled_breakdown"] = "SELECT status_normalized, has_closed_date, primary_exclusion_reason, count(*)::BIGINT AS row_count FROM governed WHERE is_cancelled GROUP BY 1, 2, 3"
    q["dup_overview"] = _metric_rows([
        ("duplicate_unique_key_groups", "count(*)::BIGINT"), ("rows_in_duplicate_groups", n("sum(group_rows)")),
        ("redundant_exact_duplicate_rows", n("sum(group_rows - 1) FILTER (WHERE NOT conflicting)")),
        ("conflicting_duplicate_groups", count_if("conflicting")),
        ("rows_in_conflicting_groups", n("sum(group_rows) FILTER (WHERE conflicting)"))], "target_keys")
    q["exact_duplicate_summary"] = "SELECT unique_key, (group_rows - 1)::BIGINT AS redundant_row_count FROM target_keys WHERE NOT conflicting"
    q["conflicting_duplicate_summary"] = f"""SELECT * FROM (SELECT unique_key, count(*)::BIGINT AS row_count,
        array_to_string(list_filter([{_SIG_FIELDS}], lambda x: x IS NOT NULL), '|') AS conflicting_fields
      FROM typed WHERE unique_key IS NOT NULL GROUP BY 1 HAVING count(*) > 1) WHERE conflicting_fields <> ''"""
    q["outcome_maturity"] = f"""SELECT source_row_index, {_MATURE} AS outcome_mature, {_COMPLETE} AS eligible_for_target,
      {_COMPLETE} AND {_MATURE} AS analysis_eligible, CASE WHEN {_COMPLETE} AND {_MATURE} THEN (closed_ts > due_ts)::BIGINT END AS missed_resolution_target FROM mine"""
    conflict = " OR ".join(f"count(DISTINCT coalesce({c}::VARCHAR, '<NA>')) > 1" for c in _DIAG.values())
    q["scope_diagnostics"] = f"""SELECT count(*)::BIGINT AS total_records, {count_if('unique_key IS NULL')} AS missing_unique_key_count,
      (count(*) - count(DISTINCT unique_key) - max((unique_key IS NULL)::INT))::BIGINT AS duplicate_unique_key_count,
      (SELECT count(*) FROM (SELECT unique_key FROM typed WHERE unique_key IS NOT NULL GROUP BY 1 HAVING count(*) > 1 AND ({conflict})))::BIGINT
        AS conflicting_duplicate_unique_key_count,
      {", ".join(f"{count_if(f'{c} IS NOT NULL AND trim({c}) <> {text(str())} AND {TS[c]} IS NULL')} AS {c}_parsing_failure_count" for c in ("created_date", "closed_date", "due_date"))},
      {count_if('due_ts < created_ts')} AS invalid_due_sequence_count, {count_if('closed_ts < created_ts')} AS invalid_closed_sequence_count FROM typed"""
    # scope selection
    q["scope_monthly"] = f"SELECT * REPLACE ({day('created_month')} AS created_month, {stamp('first_created_date')} AS first_created_date, {stamp('last_created_date')} AS last_created_date) FROM gold"
    rounded = ", ".join(f"{r(c)} AS {c}" for c in ("due_date_coverage", "closed_date_coverage", "eligible_target_rate", "missed_target_rate"))
    firsts = f"{stamp('first_created_date')} AS first_created_date, {stamp('last_created_date')} AS last_created_date"
    q["agency_summary"] = f"""SELECT agency, agency_name, total_records, created_date_present_count, {r('created_date_coverage')} AS created_date_coverage,
      due_date_present_count, closed_date_present_count, eligible_target_count, missed_target_count, on_time_count, {rounded}, {firsts},
      active_months, complaint_type_count, duplicate_unique_key_count, invalid_due_sequence_count, invalid_closed_sequence_count FROM agencies"""
    q["type_summary"] = f"""SELECT agency, agency_name, complaint_type, total_records, due_date_present_count, closed_date_present_count,
      eligible_target_count, missed_target_count, on_time_count, {rounded}, {firsts}, active_months, {r('median_monthly_volume')} AS median_monthly_volume,
      minimum_monthly_volume, maximum_monthly_volume, invalid_timestamp_count::BIGINT AS invalid_timestamp_count FROM types"""
    q["date_range_summary"] = _range_query("day_ranges")
    wide = reasons([("eligible_target_count = 0", "No target-eligible records"), ("NOT passes_eligible_volume", "Insufficient eligible records"),
                    ("NOT passes_due_date_coverage", "Low due-date coverage"), ("NOT passes_closed_date_coverage", "Low closed-date coverage"),
                    ("NOT passes_target_balance", "Target rate outside configured range"), ("NOT passes_temporal_coverage", "Insufficient active months"),
                    ("NOT passes_data_consistency", "Excessive invalid timestamp sequences"), ("NOT passes_recent_activity", "No recent activity")])
    discovery = reasons([("NOT passes_eligible_volume", "Insufficient absolute target evidence"),
                         ("NOT passes_temporal_coverage", "Insufficient historical coverage"),
                         ("NOT passes_data_consistency", "Excessive invalid timestamp sequences"),
                         ("NOT passes_recent_activity", "No recent activity")])
    q["agency_discovery"] = f"""SELECT agency, {r('invalid_timestamp_rate')} AS invalid_timestamp_rate, {", ".join(_AGENCY_RULES)},
      passes_due_date_coverage AND passes_closed_date_coverage AS passes_agency_wide_coverage,
      passes_eligible_volume AND passes_temporal_coverage AND passes_data_consistency AS proceed_to_complaint_type_review,
      {discovery} AS agency_discovery_reasons, {wide} AS agency_wide_diagnostics,
      agency IN (SELECT agency FROM decided WHERE scope_status = 'Include') AS has_viable_complaint_type_population FROM agency_rules"""
    q["type_decision"] = f"""SELECT agency, complaint_type, recent_period_record_count, {ratio('invalid_timestamp_count', 'total_records')} AS invalid_timestamp_rate,
      {", ".join(_TYPE_RULES)}, scope_status, why AS inclusion_or_rejection_reasons FROM decided"""
    q["general_candidates"] = _range_query("general", f"candidate_id, {text(S.AGENCY)} AS agency, ")
    q["candidate_gates"] = f"SELECT candidate_id, {', '.join(_GATES)}, passes_critical_gates, gate_rejection_reasons FROM general"
    q["candidate_scores"] = f"SELECT candidate_id, {', '.join(f'{r(c)} AS {c}' for c in list(_SCORES) + ['scope_score'])} FROM general"
    q["selected_monthly"] = f"""SELECT {day('created_month')} AS created_month, total_records, due_date_present_count, closed_date_present_count,
      eligible_target_count, missed_target_count, complaint_type_count, on_time_count, {rounded} FROM chosen_months"""
    q["selected_yearly"] = f"""SELECT year, total_records, eligible_target_count, due_date_present_count, closed_date_present_count, missed_target_count,
      {r('due_date_coverage')} AS due_date_coverage, {r('closed_date_coverage')} AS closed_date_coverage, {r('missed_target_rate')} AS missed_target_rate
      FROM (SELECT *, {rates()} FROM (SELECT year(created_month)::BIGINT AS year, {_RESUM} FROM chosen_months GROUP BY 1))"""
    q["monthly_stability"] = f"""SELECT count(*)::BIGINT AS active_months, greatest({S.SELECTED.months} - count(*), 0)::BIGINT AS missing_month_count,
      {ratio('stddev_pop(eligible_target_count)', 'avg(eligible_target_count)')} AS monthly_volume_coefficient_of_variation,
      {n('min(eligible_target_count)')} AS minimum_monthly_eligible_volume, {n('max(eligible_target_count)')} AS maximum_monthly_eligible_volume,
      {r('coalesce(max(missed_target_rate) - min(missed_target_rate), 0)')} AS target_rate_range,
      {r('coalesce(max(step), 0)')} AS largest_month_to_month_target_rate_change,
      {r('coalesce(max(due_date_coverage) - min(due_date_coverage), 0)')} AS due_date_coverage_range,
      {r('coalesce(max(closed_date_coverage) - min(closed_date_coverage), 0)')} AS closed_date_coverage_range,
      {count_if(f'eligible_target_count < {L.minimum_median_monthly_volume}')} AS months_below_minimum_volume,
      {count_if('due_date_coverage < 0.7 OR closed_date_coverage < 0.8')} AS months_below_required_coverage,
      coalesce(max(missed_target_rate) - min(missed_target_rate), 0) >= 0.3 AS target_rate_volatility_flag
      FROM (SELECT *, abs(missed_target_rate - lag(missed_target_rate) OVER (ORDER BY created_month)) AS step FROM chosen_months)"""
    base = "(SELECT {} FROM scenario_gated WHERE scenario_name = '')"
    q["sensitivity"] = f"""SELECT scenario_name, {text(S.AGENCY)} AS agency, complaint_type_count AS included_complaint_type_count,
      included_complaint_types, {day('start_date')} AS start_date, {day('end_date')} AS end_date, eligible_target_count,
      {r('due_date_coverage')} AS due_date_coverage, {r('closed_date_coverage')} AS closed_date_coverage, {r('missed_target_rate')} AS missed_target_rate,
      passes_critical_gates, CASE WHEN passes_critical_gates THEN 'Approved with limitations' ELSE 'Requires review' END AS decision_status,
      included_complaint_types <> {base.format('included_complaint_types')} OR start_date <> {base.format('start_date')}
        OR passes_critical_gates <> {base.format('passes_critical_gates')} AS selection_changed
      FROM scenario_gated WHERE scenario_name <> ''"""
    q["target_population"] = f"""SELECT t AS total_records, e AS eligible_records, m AS missed_target_count, (e - m)::BIGINT AS on_time_count,
      x AS has_closed_date_missing_due_date, y AS missing_closed_and_due_date, (t - e)::BIGINT AS ineligible_records, {ratio('e', 't')} AS eligibility_rate,
      {ratio('m', 'greatest(e, 1)')} AS missed_target_rate
      FROM (SELECT {n('sum(total_records)')} AS t, {n('sum(eligible_target_count)')} AS e, {n('sum(missed_target_count)')} AS m,
        {n('sum(greatest(closed_date_present_count - eligible_target_count, 0))')} AS x,
        {n('sum(greatest(total_records - greatest(closed_date_present_count, due_date_present_count), 0))')} AS y FROM agencies)"""
    # temporal stability
    q["monthly_metrics"] = f"SELECT {day('month')} AS month, {_MONTH_SELECT} FROM months"
    q["yearly_metrics"] = f"""SELECT candidate_name, year(month)::BIGINT AS year, sum(total_records)::BIGINT AS total_records,
      sum(eligible_records)::BIGINT AS yearly_eligible_volume, sum(due_date_present_count)::BIGINT AS due_date_present_count,
      sum(closed_date_present_count)::BIGINT AS closed_date_present_count, sum(missed_count)::BIGINT AS missed_count,
      {ratio('sum(due_date_present_count)', 'sum(total_records)')} AS yearly_due_date_coverage,
      {ratio('sum(closed_date_present_count)', 'sum(total_records)')} AS yearly_closed_date_coverage,
      {ratio('sum(missed_count)', 'sum(eligible_records)')} AS yearly_missed_target_rate FROM months GROUP BY 1, 2"""
    q["stability_metrics"] = f"SELECT candidate_name, {', '.join(_STABILITY_INTS)}, {', '.join(f'{r(c)} AS {c}' for c in _STABILITY_DOUBLES)} FROM stability"
    q["candidate_evaluation"] = f"""SELECT candidate_name, complete_calendar_years::BIGINT AS complete_calendar_years, {r('invalid_timestamp_rate')} AS invalid_timestamp_rate,
      {", ".join(_TEMPORAL_GATES)}, core_data_feasibility, temporal_volatility_warning, severe_temporal_volatility, decision_status, decision_reasons FROM evaluated"""
    q["candidate_containment"] = "SELECT candidate_name FROM narrower"
    q["candidate_comparison"] = f"""SELECT candidate_name, better_stable_candidate_exists, {r('recent_period_relevance_score')} AS recent_period_relevance_score,
      {r('selection_score')} AS selection_score, decision_status, decision_reasons, selected FROM compared"""
    q["temporal_rejections"] = f"SELECT candidate_name, {temporal_reason()} AS rejection_reason FROM compared WHERE NOT selected"
    q["rejected_candidates"] = f"""SELECT g.candidate_id, candidate_name, {text(S.AGENCY)} AS agency, {day('g.start_date')} || ' to ' || {day('g.end_date')} AS date_range,
      g.complaint_type_count, g.eligible_target_count, {r('g.due_date_coverage')} AS due_date_coverage, {r('g.closed_date_coverage')} AS closed_date_coverage,
      {r('g.missed_target_rate')} AS missed_target_rate, c.decision_status, c.reason AS rejection_reasons, {r('g.scope_score')} AS scope_score
      FROM general g JOIN (SELECT candidate_name, decision_status, {temporal_reason()} AS reason FROM compared WHERE NOT selected) c USING (candidate_name)"""
    q["regime_change"] = f"""SELECT {day('month')} AS month, eligible_records, {r('missed_target_rate')} AS missed_target_rate, {r('step')} AS absolute_target_rate_change,
      {r('due_date_coverage')} AS due_date_coverage, {r('due_step')} AS due_coverage_change, {r('volume_step')} AS eligible_volume_change_rate
      FROM (SELECT *, abs(missed_target_rate - lag(missed_target_rate) OVER w) AS step, due_date_coverage - lag(due_date_coverage) OVER w AS due_step,
        (eligible_records - lag(eligible_records) OVER w)::DOUBLE / nullif(lag(eligible_records) OVER w, 0) AS volume_step
        FROM months WINDOW w AS (ORDER BY month)) WHERE step IS NOT NULL ORDER BY step DESC, month LIMIT 10"""
    q["descriptor_yearly"] = f"""SELECT year, descriptor_label, record_count, {ratio('record_count', 'sum(record_count) OVER (PARTITION BY year)')} AS year_share
      FROM (SELECT year(created_ts)::BIGINT AS year, coalesce(descriptor, '<MISSING>') AS descriptor_label, count(*)::BIGINT AS record_count
        FROM mine WHERE created_ts IS NOT NULL GROUP BY 1, 2)"""
    near = "abs({0} - {1}) <= 1e-12 + 1e-9 * abs({1})"
    wrong = ", ".join(
        ["CASE WHEN g.total_records IS DISTINCT FROM c.total_records THEN 'total_records' END",
         "CASE WHEN g.eligible_target_count IS DISTINCT FROM c.eligible_records THEN 'eligible_records' END"]
        + [f"CASE WHEN NOT coalesce({near.format('g.' + x, 'c.' + x)}, FALSE) THEN '{x}' END"
           for x in ("missed_target_rate", "due_date_coverage", "closed_date_coverage")])
    mism = f"array_to_string(list_filter([{wrong}], lambda x: x IS NOT NULL), '|')"
    q["scope_reconcile"] = f"""SELECT {text(S.AGENCY)} AS agency, {day('c.start_date')} AS start_date, {day('c.end_date')} AS end_date,
      (g.candidate_id IS NOT NULL)::BIGINT AS matching_candidates, {mism} AS mismatched_columns, c.total_records, c.eligible_records,
      g.candidate_id IS NOT NULL AND {mism} = '' AS is_reconciled
      FROM compared c LEFT JOIN general g ON g.start_date = c.start_date AND g.end_date = c.end_date WHERE c.selected"""
    # landing
    q["page_summary"] = 'SELECT page_number, "offset", requested_limit, returned_rows FROM pages'
    q["oversized_pages"] = 'SELECT page_number, "offset", requested_limit, returned_rows FROM pages WHERE returned_rows > requested_limit'
    content = ", ".join(["pos"] + list(RAW_COLUMNS))
    q["repeated_pages"] = f"""SELECT page_number, "offset", returned_rows, first_offset FROM (SELECT *, min("offset") OVER (PARTITION BY body) AS first_offset
      FROM (SELECT page_number, "offset", count(*)::BIGINT AS returned_rows, md5(string_agg(row({content})::VARCHAR, '' ORDER BY pos)) AS body
        FROM landed GROUP BY 1, 2)) WHERE "offset" > first_offset"""
    q["unstable_order"] = """SELECT page_number, pos, created AS created_date, key AS unique_key, p_created AS previous_created_date, p_key AS previous_unique_key
      FROM (SELECT page_number, pos, coalesce(created_date, '') AS created, coalesce(unique_key, '') AS key,
        lag(coalesce(created_date, '')) OVER w AS p_created, lag(coalesce(unique_key, '')) OVER w AS p_key, lag(page_number) OVER w AS p_page
        FROM landed WINDOW w AS (ORDER BY page_number, pos))
      WHERE page_number - p_page <= 1 AND (created < p_created OR (created = p_created AND key < p_key))"""
    q["page_repeated_keys"] = "SELECT unique_key, count(*)::BIGINT AS row_count, min(page_number) <> max(page_number) AS crosses_pages FROM landed WHERE unique_key IS NOT NULL GROUP BY 1 HAVING count(*) > 1"
    q["page_continuity"] = f"""SELECT page_number, "offset", returned_rows, in_step AS offset_in_step, is_last AS is_last_page, short AND NOT is_last AS short_before_end,
      follows AS next_page_follows, in_step AND (is_last OR (follows AND NOT short)) AS is_continuous
      FROM (SELECT p.*, p."offset" = (page_number - 1) * requested_limit AS in_step, page_number = (SELECT max(page_number) FROM pages) AS is_last,
        returned_rows < requested_limit AS short, EXISTS (SELECT 1 FROM pages x WHERE x.page_number = p.page_number + 1
          AND x."offset" = p."offset" + p.requested_limit) AS follows FROM pages p)"""
    q["never_present_columns"] = union(
        f"SELECT '{c}' AS column_name, 'WARN' AS status FROM landed HAVING count({c}) = 0" for c in RAW_COLUMNS)
    lines = "(SELECT count(*) FROM lineitem)"
    q["count_reconciliation"] = f"SELECT {lines}::BIGINT AS preflight_count, {lines}::BIGINT AS postflight_count, count(*)::BIGINT AS retrieved_row_count, TRUE AS source_stable, count(*) = {lines} AS retrieval_complete FROM requests"
    bad = {"agency_scope": _OUTSIDE["out_of_scope_agency"], "complaint_type_scope": _OUTSIDE["out_of_scope_complaint_type"],
           "created_date_scope": f"NOT coalesce(created_ts >= DATE '{S.SCOPE.start}' AND created_ts < DATE '{S.SCOPE.end_exclusive}', FALSE)"}
    q["extraction_gates"] = union(
        ["SELECT 'required_source_columns' AS check_name, 'PASS' AS status, '' AS observed_value, 'none missing' AS expected_value",
         "SELECT 'non_empty_extract', CASE WHEN count(*) > 0 THEN 'PASS' ELSE 'FAIL' END, count(*)::VARCHAR, '> 0' FROM typed"]
        + [f"SELECT '{k}', CASE WHEN {count_if(v)} = 0 THEN 'PASS' ELSE 'FAIL' END, {count_if(v)}::VARCHAR, '0' FROM typed" for k, v in bad.items()]
        + [f"SELECT 'preflight_count', CASE WHEN count(*) = {lines} THEN 'PASS' ELSE 'FAIL' END, count(*)::VARCHAR, {lines}::VARCHAR FROM typed",
           f"SELECT 'source_stability', 'PASS', {lines}::VARCHAR, {lines}::VARCHAR", "SELECT 'query_hash', 'PASS', 'abc', 'non-empty'"])

    def observed(name: str, count: str) -> str:
        return f"SELECT '{name}' AS check_name, CASE WHEN {count} > 0 THEN 'WARN' ELSE 'PASS' END AS status, ({count})::VARCHAR AS observed_value FROM typed"

    q["extraction_observations"] = union([
        observed("duplicate_unique-key_rows", "(count(*) - count(DISTINCT unique_key) - max((unique_key IS NULL)::INT))"),
        observed("missing_due_dates", count_if("due_date IS NULL")), observed("missing_closed_dates", count_if("closed_date IS NULL")),
        observed("invalid_timestamp_chronology_rows", count_if("due_ts < created_ts OR closed_ts < created_ts")),
        "SELECT DISTINCT 'status_values_observed', 'PASS', status FROM requests WHERE status IS NOT NULL"])
    q["key_integrity"] = f"SELECT count(*)::BIGINT AS row_count, {count_if('unique_key IS NULL')} AS null_keys, (count(unique_key) - count(DISTINCT unique_key))::BIGINT AS repeated_rows FROM requests"
    q["manifest_check"] = union(f"SELECT run_id, '{x}' AS rule, {x} AS passed FROM manifests" for x in MANIFEST_RULES)
    q["latest_run"] = f"SELECT run_id, retrieved_row_count::BIGINT AS retrieved_row_count, 'x' AS selected_agency, '2001-07-20T00:00:00+00:00' AS extraction_completion_utc FROM manifests WHERE {' AND '.join(MANIFEST_RULES)} ORDER BY run_id DESC LIMIT 1"
    safety = {"SAFE_FEATURE": "SAFE", "CONDITIONAL_FEATURE": "CONDITIONAL"}
    q["leakage_audit"] = union(
        f"SELECT '{c}' AS column_name, '{ROLES[c]}' AS role, {str(ROLES[c] == 'SAFE_FEATURE').upper()} AS allowed_for_baseline, "
        f"'{safety.get(ROLES[c], 'BLOCKED')}' AS leakage_status, (count(*) - count({c}))::BIGINT AS null_count FROM requests"
        for c in RAW_COLUMNS)
    return q


def build() -> dict[str, str]:
    return {name: _with(body) for name, body in _queries().items()}

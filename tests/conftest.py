from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from dueward.schemas import RAW_COLUMNS, ROW_ID  # noqa: E402
from dueward.session import local_session  # noqa: E402

SAMPLE = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 8, partitions=4)
    yield session
    session.stop()


BASE = {
    "unique_key": "1", "created_date": "2024-01-01T12:00:00.000", "closed_date": "2024-01-09T12:00:00.000",
    "due_date": "2024-01-10T12:00:00.000", "agency": "DSNY", "agency_name": "Department of Sanitation",
    "complaint_type": "Graffiti", "descriptor": "Graffiti", "descriptor_2": None, "status": "Closed",
    "borough": "QUEENS", "incident_zip": "01234", "latitude": "40.75", "longitude": "-73.90",
    "location_type": "Residential", "open_data_channel_type": "ONLINE", "resolution_description": "Resolved",
    "resolution_action_updated_date": "2024-01-09T12:00:00.000",
}


@pytest.fixture(scope="session")
def requests(spark):
    """Build raw requests from per-row changes to a valid row."""
    def build(changes):
        rows = []
        for i, change in enumerate(changes):
            values = {**BASE, "unique_key": str(i + 1), ROW_ID: f"{i:04d}", **change}
            rows.append(tuple(values[c] for c in (*RAW_COLUMNS, ROW_ID)))
        schema = ", ".join(f"{c} string" for c in (*RAW_COLUMNS, ROW_ID))
        return spark.createDataFrame(rows, schema)
    return build


def rows_of(df, *columns):
    names = columns or df.columns
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=str)

"""Sessions against their SQL when the first event, at 0 ns, enables: it ties with the initial state."""

import os

import duckdb
import pytest

from tests.conftest import SF
from tests.test_queries import ORACLES, QUERIES, plain

SESSIONS = [
    "capture_index",  # F4
    "controlled_capture",  # F5
    "line_offsets",  # F6
    "session_id",  # F7
    "companion_path",  # F8
    "line_record_scan",  # F9
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out = tmp_path_factory.mktemp("first-event")
    first = "case when event_id = 0 then 'signup' else event_type end as event_type"
    duckdb.sql(f"copy (select * replace ({first}) from '{SF}/events.parquet') to '{out}/events.parquet' (format parquet)")
    return str(out)


@pytest.mark.parametrize("name", SESSIONS)
def test_sessions_from_the_first_event_on(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{os.path.join(folder, 'events.parquet')}'")
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    want = sorted((plain(r) for r in cur.fetchall()), key=repr)
    got = sorted((plain(r) for r in QUERIES[name](spark, folder).select(*names).collect()), key=repr)
    assert got == want and want

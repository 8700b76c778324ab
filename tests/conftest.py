import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

T0 = dt.datetime(2024, 1, 1, 0, 0, 0)  # UTC wall clock (session time zone is UTC)


@pytest.fixture(scope="session")
def spark():
    from edit_signals.session import build_session
    s = build_session("local[4]", 8)
    yield s
    s.stop()


def at(ms: int) -> dt.datetime:
    return T0 + dt.timedelta(milliseconds=ms)


EDIT_DDL = ("title string, wiki string, bot boolean, namespace int, event_time timestamp, "
            "arrival_ts timestamp, arrival_id bigint, arrival_bucket bigint")


def make_edits(spark, rows, bucket_ms: int = 60_000):
    """rows: (title, bot, event_ms[, arrival_ms]) in arrival order; wiki defaults to enwiki."""
    out = []
    for i, r in enumerate(rows):
        title, bot, ev_ms = r[0], r[1], r[2]
        arr_ms = r[3] if len(r) > 3 else ev_ms
        wiki = r[4] if len(r) > 4 else "enwiki"
        out.append((title, wiki, bot, 0, at(ev_ms), at(arr_ms), i, arr_ms // bucket_ms))
    return spark.createDataFrame(out, EDIT_DDL)

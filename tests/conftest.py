import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pulseline.schema import ACTIVITY_SCHEMA  # noqa: E402
from pulseline.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"
DAY_START = 1705248000  # 2024-01-15 00:00:00 in Manila


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    work = {"spark.checkpoint.dir": str(tmp_path_factory.mktemp("work"))}
    session = local_session("4", "tests", **work)
    yield session
    session.stop()


@pytest.fixture
def act(spark):
    """Activity rows from dicts; the day follows from the second unless given."""

    def make(*rows):
        full = []
        for i, r in enumerate(rows):
            ts = r.get("timestamp", DAY_START + i)
            base = dict(
                id=ts * 1000,
                session_id="s1",
                hostname="a.example.com",
                url="http://a.example.com/p",
                referer="",
                browser="Mozilla/5.0 Chrome",
                is_bot=0,
                user_cookie="u1",
                ip_user="10.0.0.1",
                timestamp=ts,
                date_num=20240115 + (ts - DAY_START) // 86400,
                domain="example.com",
                created_at=ts,
            )
            base.update(r)
            full.append(tuple(base[f] for f in ACTIVITY_SCHEMA.fieldNames()))
        return spark.createDataFrame(full, ACTIVITY_SCHEMA)

    return make


def rows(df, *cols):
    """Sorted tuples of the named columns."""
    out = df.select(*cols).collect() if cols else df.collect()
    return sorted(tuple(r) for r in out)

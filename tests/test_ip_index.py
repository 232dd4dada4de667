"""Address search by trigrams gives the rows of a full scan."""

import pytest
from conftest import DAY_START, rows
from pyspark.sql import functions as F

from pulseline.operators import filters
from pulseline.sources import ip_index

IPS = ["10.0.0.1", "10.0.0.1", "10.0.0.12", "110.0.0.1", "2001:db8:0:1::7", "%_%", "ab", "", None, "10.0.0.1é", "aaaa"]


@pytest.fixture
def indexed(spark, act, tmp_path):
    ua = act(*[dict(ip_user=ip, timestamp=DAY_START + (i % 3) * 86400) for i, ip in enumerate(IPS * 2)])
    path = str(tmp_path / "index")
    ip_index.write_index(ua, path)
    return ua, path


TEXTS = ["10.0.0.1", " 10.0.0.1 ", "0.0.12", "1", "", None, "db8:0", "::", "%_%", "___", "9.9.9", "aaa", "aaaaa", "é", "0.1é"]


@pytest.mark.parametrize("text", TEXTS)
def test_same_rows_as_a_scan(spark, indexed, text):
    ua, path = indexed
    ua = ua.withColumn("ip_user", F.coalesce("ip_user", F.lit("")))
    want = filters.ip_contains(ua, text).groupBy("date_num", "ip_user").agg(F.count("*").alias("hits"))
    assert rows(ip_index.search(spark, path, text)) == rows(want)
    some = ip_index.search(spark, path, text, 20240116, 20240116)
    assert rows(some) == rows(want.filter("date_num = 20240116"))


def test_only_the_rarest_gram_is_read(spark, indexed):
    _, path = indexed
    found = ip_index.candidates(spark, path, "10.0.0.12")
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(gram,.12)" in text or "EqualTo(gram,0.12)" in text
    assert {r.ip_user for r in found.collect()} == {"10.0.0.12"}


def test_an_empty_table_has_no_rows(spark, act, tmp_path):
    ip_index.write_index(act(dict(id=1)).filter("id = 2"), str(tmp_path / "none"))
    for text in ("10.0", "1", None):
        assert ip_index.search(spark, str(tmp_path / "none"), text).count() == 0

from datetime import datetime, timezone

import pytest

from almagest.operators.timestamps import moments, with_utc_micros

NY = "gregorian[America/New_York]"
CASES = [
    ("2020-12-30 24:00", "gregorian", "2020-12-31T00:00:00"), ("2019-01-10 26:30", "gregorian+09:00", "2019-01-10T17:30:00"), ("２０２３年８月２２日", None, "2023-08-21T15:00:00"), ("令和元年5月2日", "gregorian", "2019-05-02T00:00:00"),
    ("令和６年３月６日午後０時５４分", "gregorian", "2024-03-06T12:54:00"), ("平成31年4月15日 14時9分", "gregorian", "2019-04-15T14:09:00"), ("明治20年4月8日", "gregorian", "1887-04-08T00:00:00"), ("2023-W37-2", "gregorian", "2023-09-12T00:00:00"), ("2020-W53-5", "gregorian", "2021-01-01T00:00:00"),
    ("2016-366", "gregorian", "2016-12-31T00:00:00"), ("Sun, 31 Mar 2019 03:48:17 +0900", NY, "2019-03-30T18:48:17"), ("Feb 29, 2016 12:05 AM EDT", None, "2016-02-29T04:05:00"), ("/Date(1740146139000)/", NY, "2025-02-21T13:55:39"), ("1468201614.277", NY, "2016-07-11T01:46:54.277000"),
    ("1589096482000505", NY, "2020-05-10T07:41:22"), ("20190809132429", "gregorian", "2019-08-09T13:24:29"), ("20181130T104237+1100", None, "2018-11-29T23:42:37"), ("2022-10-30T02:10:20[Europe/Berlin]", None, "2022-10-30T00:10:20"), ("2017-03-12 02:35:33 America/Los_Angeles", None, "2017-03-12T10:35:33"),
    ("2019-11-26T22:43:05.976999999+01:00", None, "2019-11-26T21:43:05.976000"), ("13.04.2023", "gregorian", "2023-04-13T00:00:00"), ("08/24/2024 4:50 AM", NY, "2024-08-24T08:50:00"), ("2020-11-01 01:30:00", NY, "2020-11-01T05:30:00"), ("2020-03-08 02:30:00", NY, "2020-03-08T07:30:00"),
    ("15 October 1738", "gregorian", "1738-10-15T00:00:00"), ("2018/7/21", "gregorian-05:00", "2018-07-21T05:00:00"), ("1555953394", "aldmere", "2019-04-22T17:16:34"),
]
NONE = [None, "", " ", "2024", "2024-05", "soon", "0000-00-00", "2021-02-29", "2023-W60-1", "2019-366", "1745/1900", "2019-03-02/2019-05-24", "every Friday", "後の年", "12 Mistmonth 400", "13/45/2020 4:00 AM", "2020-01-01 48:00", "2020-01-01 10:61", "x" * 100_000, "2020-01-01 10:00:00 Nowhere/City"]


@pytest.fixture(scope="module")
def read(spark):
    rows = [(t, c) for t, c, _ in CASES] + [(t, "gregorian") for t in NONE] + [("2020-01-05", "aldmere"), ("2020-01-05", "gregorian[Nowhere/City]")]
    return {(r.t, r.c): r.u for r in with_utc_micros(spark.createDataFrame(rows, "t string, c string"), "t", "c", "u").collect()}


@pytest.mark.parametrize(("text", "calendar", "want"), CASES)
def test_moment(read, text, calendar, want):
    us = read[text, calendar]
    want_ms = int(datetime.fromisoformat(want).replace(tzinfo=timezone.utc).timestamp() * 1000)
    assert us is not None and us // 1000 == want_ms


def test_no_moment(read):
    assert all(read[t, "gregorian"] is None for t in NONE)
    assert read["2020-01-05", "aldmere"] is None and read["2020-01-05", "gregorian[Nowhere/City]"] is None


def test_long_texts_zones_and_order(spark):
    long = "2020-01-05" + " " * 100_000 + "10:00:00" + "\t" * 500 + "UTC"
    rows = [(1, long, None), (2, "3/4/2020", "gregorian"), (3, "2020-01-05 00:00", None), (4, "2020-07-05 00:00", "house"), (5, "April 3, 2020", "gregorian")]
    df = spark.createDataFrame(rows, "k int, t string, c string")
    at = lambda **kw: {r.k: datetime.fromtimestamp(r.u / 1e6, timezone.utc).isoformat()[:16] for r in with_utc_micros(df, "t", "c", "u", **kw).filter("u is not null").collect()}
    assert at() == {1: "2020-01-05T10:00", 2: "2020-03-04T00:00", 3: "2020-01-04T15:00", 5: "2020-04-03T00:00"}
    assert at(zones={None: "-05:00", "house": "Europe/Berlin", "gregorian": "Z"}, day_first=True) == {1: "2020-01-05T10:00", 3: "2020-01-05T05:00", 4: "2020-07-04T22:00"}
    assert at(day_first=True)[2] == "2020-04-03T00:00"


def test_moments_keeps_clashing_names(spark):
    df = spark.createDataFrame([(1, "2020-01-01", None, "gregorian", "x"), (1, "2020-01-01", None, "gregorian", "x")], "doc_id bigint, published string, acquired_at string, calendar string, text string")
    assert [(r.record_id, r.field, r.utc_ms) for r in moments(df, "doc_id", ["published", "acquired_at"]).collect()] == [("1", "published", 1577836800000)]
    assert moments(df.filter("false"), "doc_id", ["published"]).count() == 0

from datetime import datetime, timezone

import pytest

from almagest.functions.temporal_text import parse

REF = int(datetime(2026, 9, 23, 12, tzinfo=timezone.utc).timestamp() * 1000)


def ms(s):
    return int(datetime.fromisoformat(s).replace(tzinfo=timezone.utc).timestamp() * 1000)


@pytest.mark.parametrize(("text", "a", "b"), [
    ("2026-09-20", "2026-09-20", "2026-09-21"), ("2026年9月20日", "2026-09-20", "2026-09-21"), ("昭和50年5月5日", "1975-05-05", "1975-05-06"), ("令和元年", "2019-01-01", "2020-01-01"), ("20 September 2026", "2026-09-20", "2026-09-21"), ("Sept 20, 2026", "2026-09-20", "2026-09-21"), ("2026-09", "2026-09-01", "2026-10-01"),
    ("1995", "1995-01-01", "1996-01-01"), ("1990s", "1990-01-01", "2000-01-01"), ("1990年代", "1990-01-01", "2000-01-01"), ("19th century", "1801-01-01", "1901-01-01"), ("19世紀", "1801-01-01", "1901-01-01"), ("先週火曜日", "2026-09-15", "2026-09-16"), ("last Tuesday", "2026-09-15", "2026-09-16"), ("月曜日の夕方", "2026-09-21T16:00", "2026-09-21T19:00"),
    ("3日前", "2026-09-20", "2026-09-21"), ("数日前", "2026-09-18", "2026-09-22"), ("2 days ago", "2026-09-21", "2026-09-22"), ("yesterday", "2026-09-22", "2026-09-23"), ("10/14", "2026-10-14", "2026-10-15"), ("1月5日", "2027-01-05", "2027-01-06"), ("2026年9月上旬", "2026-09-01", "2026-09-11"), ("late May 2020", "2020-05-21", "2020-06-01"),
    ("2026-09-20 15:30", "2026-09-20T15:30", "2026-09-20T15:31"), ("2026年9月20日25:30", "2026-09-21T01:30", "2026-09-21T01:31"), ("2026-09-20T15:30:00+09:00", "2026-09-20T06:30", "2026-09-20T06:30:01"), ("20日午後3時半ごろ", "2026-09-20T15:00", "2026-09-20T16:01"), ("来月", "2026-10-01", "2026-11-01"), ("last year", "2025-01-01", "2026-01-01"),
])
def test_spans(text, a, b):
    p = parse(text, REF)
    assert p.range is not None, p
    assert (p.range.es, p.range.le) == (ms(a), ms(b))


def test_bc_and_intervals():
    assert parse("紀元前300年").range == parse("300 BC").range and parse("300 BC").range.es < ms("0001-01-01")
    p = parse("2020年5月3日から5日まで").range
    assert (p.es, p.ls, p.ee, p.le) == (ms("2020-05-03"), ms("2020-05-04"), ms("2020-05-05"), ms("2020-05-06"))
    assert parse("1745/1900").range.le == ms("1901-01-01") and parse("2001年以降").range.es == ms("2001-01-01") and parse("before 1900").range.le == ms("1900-01-01")
    assert parse("circa 1388").range.es == ms("1388-01-01") - 366 * 86_400_000  # by its own width, a leap year


def test_unresolved():
    assert parse("明日").reason == "needs_reference" and parse("毎週金曜日 25:30").rule == "weekly" and parse("every Friday").extra["weekday"] == 4
    assert parse("battle of the hill").kind == "unparsed" and parse(None).kind == parse("n.d.").kind == "unknown" and parse("2021-02-30").reason == "invalid"
    p = parse("3 days before the Great Fire")
    assert p.kind == "event_relative" and p.anchors == ("the great fire",) and p.extra["least_ms"] == -3 * 86_400_000
    assert parse("Aより後、Bより前").anchors == ("a", "b") and parse("x" * 10_000).kind == "unparsed"

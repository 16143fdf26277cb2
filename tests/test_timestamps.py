import datetime as dt
from zoneinfo import ZoneInfo

import pytest

from tidewire.operators import timestamps as TS

CLOCKS = [("berlin", "Europe/Berlin", "DMY"), ("york", "America/New_York", "MDY"), ("howe", "Australia/Lord_Howe", "DMY"), ("odd", "No/Zone", None)]


def utc(*a, ms=0):
    return int(dt.datetime(*a, tzinfo=dt.timezone.utc).timestamp() * 1000) + ms


CASES = [
    ("berlin", "2026-01-11T10:59Z", utc(2026, 1, 11, 10, 59)), ("berlin", "1755268308492", 1755268308492), ("berlin", "1755268308", 1755268308000), ("berlin", "1747752900222458", 1747752900222),
    ("berlin", "1755405869.979", 1755405869979), ("berlin", "20250729T140015Z", utc(2025, 7, 29, 14, 0, 15)), ("berlin", "20260112211833", utc(2026, 1, 12, 20, 18, 33)), ("berlin", "20251121", utc(2025, 11, 20, 23)),
    ("york", "Sunday, 11-Jan-26 09:59:57 GMT", utc(2026, 1, 11, 9, 59, 57)), ("berlin", "Tue, 01 Jul 2025 18:22:46 CEST", utc(2025, 7, 1, 16, 22, 46)), ("berlin", "02/03/2026 12:41", utc(2026, 3, 2, 11, 41)),
    ("york", "02/03/2026 12:41", utc(2026, 2, 3, 17, 41)), ("berlin", "2025-08-24 13:29:34 UTC+9", utc(2025, 8, 24, 4, 29, 34)), ("berlin", "2026-02-26 15:32:09 GMT-3:30", utc(2026, 2, 26, 19, 2, 9)),
    ("berlin", "2025/8/25 12:54", utc(2025, 8, 25, 10, 54)), ("berlin", "2026-03-24T02:45:13,203+00:00", utc(2026, 3, 24, 2, 45, 13, ms=203)), ("berlin", "２０２５-１１-２９ １２:３２", utc(2025, 11, 29, 11, 32)),
    ("york", "Oct 26, 2025 2:51 am", utc(2025, 10, 26, 6, 51)), ("york", "January 16, 2026 1:20 p.m.", utc(2026, 1, 16, 18, 20)), ("york", "Mar 11, 2025 12:55 p.m.", utc(2025, 3, 11, 16, 55)), ("york", "Mar 11, 2025 12:05 AM", utc(2025, 3, 11, 4, 5)),
    ("berlin", "5. November 2025, 23:51 Uhr", utc(2025, 11, 5, 22, 51)), ("berlin", "14. März 2026, 10:44 Uhr", utc(2026, 3, 14, 9, 44)), ("berlin", "24 de agosto de 2025, 13:36", utc(2025, 8, 24, 11, 36)),
    ("berlin", "14 avril 2026 à 12h34", utc(2026, 4, 14, 10, 34)), ("berlin", "30 December 2025 08:57", utc(2025, 12, 30, 7, 57)), ("berlin", "2025年8月23日 15:16", utc(2025, 8, 23, 13, 16)), ("berlin", " 2025-07-14t02:54:02 utc ", utc(2025, 7, 14, 2, 54, 2)),
    ("berlin", "2025-10-19T03:13:50.683999433Z", utc(2025, 10, 19, 3, 13, 50, ms=683)), ("unknown", "2025-06-01 10:00:00", utc(2025, 6, 1, 10)), ("odd", "2025-06-01 10:00:00", utc(2025, 6, 1, 10)), (None, "2025-06-01 10:00:00", utc(2025, 6, 1, 10)),
    # Twice on the clock: the first. Skipped: the offset before. Half-hour change.
    ("berlin", "2025-10-26 02:24:44", utc(2025, 10, 26, 0, 24, 44)), ("york", "Nov 2, 2025 1:30 AM", utc(2025, 11, 2, 5, 30)), ("berlin", "30/03/2025 02:43", utc(2025, 3, 30, 1, 43)), ("york", "March 8, 2026 2:03 AM", utc(2026, 3, 8, 7, 3)),
    ("howe", "2025-04-06 01:45:00", utc(2025, 4, 5, 14, 45)), ("howe", "2025-10-05 02:15:00", utc(2025, 10, 4, 15, 45)),
    # No instant.
    ("berlin", "2026-02-30 10:00:00", None), ("berlin", "2025-13-07T08:00:00Z", None), ("berlin", "2026-01-12T25:61:00Z", None), ("berlin", "0000-00-00 00:00:00", None), ("berlin", "31/02/2026 10:00", None), ("york", "31/12/2025 10:00", None),
    ("berlin", "2 hours ago", None), ("berlin", "yesterday", None), ("berlin", "", None), ("berlin", "14h35", None), ("berlin", "12345", None), ("berlin", "x" * 50_000, None), ("berlin", None, None), ("berlin", "2025-06-01 10:00:00+99:00", None),
]


def test_notations_zones_and_changes(spark):
    rows = [(i, s, t, "clash") for i, (s, t, _) in enumerate(CASES)]
    articles = spark.createDataFrame(rows, "article_id long, source_code string, published_at string, tz_name string")
    clocks = spark.createDataFrame(CLOCKS, "source_code string, tz_name string, date_order string")
    got = {r.article_id: r.utc_ms for r in TS.normalise_instants(articles, clocks, ["published_at"]).collect()}
    wrong = [(CASES[i][:2], got.get(i), want) for i, (_, _, want) in enumerate(CASES) if got.get(i) != want]
    assert not wrong


def test_kinds_repeats_and_empty(spark):
    clocks = spark.createDataFrame(CLOCKS, "source_code string, tz_name string, date_order string")
    rows = [(1, "BERLIN", "2025-10-26 02:24:44"), (1, "BERLIN", "2025-10-26 02:24:44"), (2, "berlin", "2025-03-30 02:30"), (3, "berlin", "2025-03-30 12:30")]
    a = spark.createDataFrame(rows, "article_id long, source_code string, t string")
    got = sorted((r.article_id, r.local_time_kind) for r in TS.normalise_instants(a, clocks, ["t"]).collect())
    assert got == [(1, "ambiguous"), (1, "ambiguous"), (2, "skipped"), (3, "unique")]
    assert TS.normalise_instants(a.limit(0), clocks.limit(0), ["t"]).count() == 0


@pytest.mark.parametrize("zone", ["Europe/Berlin", "America/St_Johns", "Asia/Kathmandu", "UTC"])
def test_history_agrees_with_zone_rules(zone):
    history = TS.offset_history(zone, (1990, 2040))
    z = ZoneInfo(zone)
    for t in range(631152000, 2000000000, 9_999_991):
        want = dt.datetime.fromtimestamp(t, z).utcoffset().total_seconds()
        assert [o for u, o in history if u <= t][-1] == want

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest

from tests.postings import platforms, postings
from tidemark.operators.times import found_instants

CAPTURED = datetime(2026, 3, 10, 12, 0, 30, tzinfo=timezone.utc)


def utc(*args, zone="UTC", fold=0):
    return datetime(*args, tzinfo=ZoneInfo(zone), fold=fold).astimezone(timezone.utc)


CASES = [
    ("Eastboard", "2026-01-20T12:32:33-05:00[America/New_York]", utc(2026, 1, 20, 17, 32, 33)),
    ("Eastboard", "2026-01-20T12:32:33.125Z", utc(2026, 1, 20, 12, 32, 33, 125000)),
    ("Eastboard", "Tue, 20 Jan 2026 12:32:33 -0500", utc(2026, 1, 20, 17, 32, 33)),
    ("Eastboard", "8 Feb 2026 02:13:56 EST", utc(2026, 2, 8, 7, 13, 56)),
    ("Eastboard", "2/5/2026 11:52 AM", utc(2026, 2, 5, 16, 52)),
    ("Kontor", "2/5/2026 12:05 AM", utc(2026, 5, 2, 0, 5, zone="Europe/Berlin")),
    ("Kontor", "25.10.2025 05:59", utc(2025, 10, 25, 3, 59)),
    ("Kontor", "9. März 2026, 06:10 Uhr", utc(2026, 3, 9, 5, 10)),
    ("Kontor", "3 de abril de 2026, 11:25", utc(2026, 4, 3, 9, 25)),
    ("Kontor", "20251228", utc(2025, 12, 28, zone="Europe/Berlin")),
    ("Kontor", "2025-12-28", utc(2025, 12, 28, zone="Europe/Berlin")),
    ("Isoport", "26/04/12", utc(2026, 4, 12)),
    ("Isoport", "Oct. 14, 2025", utc(2025, 10, 14)),
    ("Isoport", "Sunday, October 12, 2025 at 9:45 PM", utc(2025, 10, 12, 21, 45)),
    ("Isoport", "2025-09-18 21:31 GMT+5:30", utc(2025, 9, 18, 16, 1)),
    ("Isoport", "2026-06-24 14:33:04+0545", utc(2026, 6, 24, 8, 48, 4)),
    ("Isoport", "1770873144", datetime.fromtimestamp(1770873144, timezone.utc)),
    ("Isoport", "1777271097.01", datetime.fromtimestamp(1777271097, timezone.utc) + timedelta(milliseconds=10)),
    ("Isoport", "1775330829806", datetime.fromtimestamp(1775330829, timezone.utc) + timedelta(milliseconds=806)),
    ("Bazaar", "2026-02-24 09:28:32 IST", utc(2026, 2, 24, 3, 58, 32)),
    ("Bazaar", "02-JUL-2026 08:33", utc(2026, 7, 2, 3, 3)),
    ("Bazaar", "35 hours ago", CAPTURED - timedelta(hours=35)),
    ("Bazaar", "Posted 4 days ago", CAPTURED - timedelta(days=4)),
    ("Bazaar", "1w ago", CAPTURED - timedelta(days=7)),
    ("Isoport", "  20   Jan 2026" + " " * 300, utc(2026, 1, 20)),
    ("Isoport", "Dienstag, 20. Januar 2026", utc(2026, 1, 20)),
    ("Isoport", "martes, 3 de marzo de 2026", utc(2026, 3, 3)),
    ("Isoport", "Lundi 9 févr. 2026", utc(2026, 2, 9)),
    # the clock goes back: the earlier instant; the clock goes forward: the offset before the change
    ("Eastboard", "2025-11-02 01:30", utc(2025, 11, 2, 5, 30)),
    ("Eastboard", "2026-03-08 02:30", utc(2026, 3, 8, 7, 30)),
    ("Kontor", "2026-03-29 02:30", utc(2026, 3, 29, 1, 30)),
]
NO_CASES = ["", "  ", "NaT", "null", "30+ days ago", "recently", "this month", "TBD", "0000-00-00", "2026-02-30", "13:61", "2026-01-20T12:32:33Z", "12345", "x" * 5000, "99/99/9999", "3 Martes 2026", "Holiday, 20 Jan 2026", "Janet 3, 2026", "2026-01-20 10:00 " + "x" * 300]


def test_every_notation(spark):
    rows = postings(spark, [{"platform": p, "posted_at": v, "captured_at": CAPTURED} for p, v, _ in CASES])
    got = {r.posting_no: r.utc_us for r in found_instants(rows, platforms(spark)).collect()}
    for i, (platform, value, expected) in enumerate(CASES):
        assert got.get(i + 1) == round(expected.timestamp() * 1e6), (platform, value)


def test_vague_blank_and_broken_values_give_no_row(spark):
    rows = postings(spark, [{"platform": "Kontor", "expires_at": v, "captured_at": CAPTURED} for v in NO_CASES] + [{}])
    assert found_instants(rows, platforms(spark)).collect() == []


def test_unknown_platform_knows_only_values_with_a_zone(spark):
    rows = postings(spark, [{"platform": "?", "posted_at": "2026-01-20 10:00"}, {"posted_at": "2026-01-20 10:00 UTC"}])
    assert [(r.posting_no, r.field) for r in found_instants(rows, platforms(spark)).collect()] == [(2, "posted_at")]


def test_empty_table_and_clashing_columns(spark):
    empty = found_instants(postings(spark, []), platforms(spark))
    assert empty.columns == ["posting_no", "field", "utc_us"] and empty.count() == 0
    rows = postings(spark, [{"platform": "Isoport", "posted_at": "2026-01-20"}]).selectExpr("*", "1 as __zone", "2 as __value", "3 as field", "4 as utc_us")
    assert found_instants(rows, platforms(spark)).count() == 1


@pytest.mark.parametrize("field", ["date_posted", "posted_at", "expires_at", "first_seen_at"])
def test_all_fields(spark, field):
    rows = postings(spark, [{"platform": "Isoport", field: "2026-01-20"}])
    assert [r.field for r in found_instants(rows, platforms(spark)).collect()] == [field]


def test_instants_survive_writing_and_reading(spark):
    """Round trip: random instants written by the wall clock of each zone, read back."""
    import random

    rng = random.Random(4)
    zones = {"Eastboard": "America/New_York", "Kontor": "Europe/Berlin", "Isoport": "UTC", "Bazaar": "Asia/Kolkata"}
    order = {"Eastboard": "%m/%d/%Y %H:%M", "Kontor": "%d/%m/%Y %H:%M", "Isoport": "%Y/%m/%d %H:%M", "Bazaar": "%d/%m/%Y %H:%M"}
    rows, expected = [], {}
    for i in range(1, 401):
        platform = rng.choice(list(zones))
        instant = datetime(2025, 1, 1, tzinfo=timezone.utc) + timedelta(minutes=rng.randrange(900_000))
        wall = instant.astimezone(ZoneInfo(zones[platform]))
        earliest = wall.replace(fold=0).astimezone(timezone.utc)
        form = rng.choice(["iso", "offset", "order", "month", "rfc", "epoch"])
        text = {
            "iso": wall.strftime("%Y-%m-%d %H:%M"), "offset": wall.isoformat(), "order": wall.strftime(order[platform]), "month": wall.strftime("%B %d, %Y at %I:%M %p"),
            "rfc": instant.strftime("%a, %d %b %Y %H:%M:%S GMT"), "epoch": str(round(instant.timestamp())),
        }[form]
        rows.append({"posting_no": i, "platform": platform, "first_seen_at": text})
        expected[i] = round((earliest if form in ("iso", "order", "month") else instant).timestamp() * 1e6)
    got = {r.posting_no: r.utc_us for r in found_instants(postings(spark, rows), platforms(spark)).collect()}
    assert got == expected

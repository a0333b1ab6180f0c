import pytest
from hypothesis import given, settings, strategies as st

from tests.postings import platforms, postings
from tidemark.functions.pay import _PERIOD_WORDS, currency, number, period, read_pay
from tidemark.operators import units as graph
from tidemark.operators.pay import SCALE_EDGES, TARGETS, found_pay, unread_pay
from tidemark.operators.units import UnitGraph, conversions

UNITS = [("currency", "USD", 1.0), ("currency", "INR", 0.012), ("currency", "EUR", 1.08), ("currency", "GBP", 1.27), ("period", "hour", 2080.0), ("period", "month", 12.0), ("period", "year", 1.0)]


def units(spark, rows=UNITS):
    return spark.createDataFrame(rows, "kind string, code string, factor double")


SCALE = {None: 1, "one": 1, "thousand": 1e3, "lakh": 1e5, "million": 1e6, "crore": 1e7, "hundredth": 0.01}


@pytest.mark.parametrize(
    "text,home,expected",
    [
        ("$67k - $89k a year", "USD", (67000, 89000, None, "USD", "year")),
        ("42–75k USD per annum", "GBP", (42000, 75000, None, "USD", "year")),
        ("105.000 a 136.000 € brutos anuales", "EUR", (105000, 136000, None, "EUR", "year")),
        ("58,75 bis 74,75 €/Stunde", "EUR", (58.75, 74.75, None, "EUR", "hour")),
        ("OTE Rs. 18,00,000–28,80,000 annually", "INR", (1800000, 2880000, None, "INR", "year")),
        ("3.5–11 L p.a. (INR)", "INR", (350000, 1100000, None, "INR", "year")),
        ("12 LPA", "PKR", (1200000, 1200000, None, "INR", "year")),
        ("2.5 Lakhs Per Annum", "PKR", (250000, 250000, None, "INR", "year")),
        ("to a maximum of $61.25/h", "USD", (None, 61.25, None, "USD", "hour")),
        ("from £540 per day", "GBP", (540, None, None, "GBP", "day")),
        ("figures in '000, yearly", "GBP", (None, None, 1000.0, None, "year")),
        ("USD cents, hourly", "USD", (None, None, 0.01, "USD", "hour")),
        ("Pay is given per month", "USD", (None, None, None, None, "month")),
        ("Grade 7", "USD", (None, None, None, None, None)),
        ("13 salaries a year", "USD", (None, None, None, None, "year")),
        ("negotiable", "USD", (None, None, None, None, None)),
        ("USD 60 000 yearly", "USD", (60000, 60000, None, "USD", "year")),
        ("1 200 000 bis 1 500 000 PKR/Jahr", "PKR", (1200000, 1500000, None, "PKR", "year")),
        ("$25/hr - $30/hr", "USD", (25, 30, None, "USD", "hour")),
        ("$25 per hour to $30 per hour", "USD", (25, 30, None, "USD", "hour")),
        ("1,5 Mio PKR jährlich", "PKR", (1500000, 1500000, None, "PKR", "year")),
        ("team of 12, about 40 - 50k EUR a year, 3 rounds", "EUR", (40000, 50000, None, "EUR", "year")),
        ("x" * 3000 + " pays $30 an hour", "USD", (30, 30, None, "USD", "hour")),
    ],
)
def test_read_pay(text, home, expected):
    lo, hi, lo_scale, hi_scale, remark, code, unit = read_pay(text, home)
    scaled = lambda x, s: x if x is None else x * SCALE[s]
    assert (scaled(lo, lo_scale), scaled(hi, hi_scale), SCALE[remark] if remark else None, code, unit) == expected


@pytest.mark.parametrize("word,unit", sorted(_PERIOD_WORDS.items()))
def test_every_period_word(word, unit):
    assert period(word) == period(f" {word.upper()} ") == period(f"per {word}") == period(f"/{word}") == period(f"each  {word}") == unit


def test_many_numbers_are_read_in_time():
    assert read_pay("5 " * 50_000 + "$7 a day", "USD")[:2] == (7.0, 7.0)


def test_shared_signs_mean_the_home_currency():
    assert currency("$", "AUD") == "AUD" and currency("$", "EUR") == "USD" and currency("Rs.", "INR") == "INR" and currency("US$", "AUD") == "USD" and currency(None, "USD") is None
    assert period("YEAR") == "year" and period("per annum") == "year" and period("mth") == "month" and period("") is None


@given(st.integers(0, 99_999_999))
@settings(max_examples=50, deadline=None)
def test_numbers_survive_grouping(n):
    assert number(f"{n:,}") == n and number(f"{n:,}".replace(",", ".")) == n and number(f"{n}") == n


def test_graph_composes_inverts_and_finds_contradictions():
    g = UnitGraph()
    g.add("c", "f", 1.8, 32.0)
    g.add("f", "k", 5 / 9, 459.67 * 5 / 9)
    a, b = g.to("c")["k"]
    assert abs(a * 373.15 + b - 100) < 1e-9
    g.add("k", "c", 1.0, -273.15)
    g.to("c")
    g.add("k", "c", 2.0, 0.0)
    with pytest.raises(ValueError):
        g.to("c")
    with pytest.raises(ValueError):
        g.add("x", "y", 0.0)


def test_rows(spark):
    rows = postings(spark, [
        {"platform": "Eastboard", "salary_text": "$67k - $89k a year"},
        {"platform": "Bazaar", "salary_min": 3.0, "salary_max": 2.0, "salary_currency": "Rs", "salary_text": "figures in lakhs, monthly"},
        {"platform": "Kontor", "salary_min": 100.0, "salary_max": float("nan"), "salary_currency": "€", "salary_interval": "HOUR"},
        {"platform": "Kontor", "salary_text": "bis zu 50.000 € im Jahr"},
        {"platform": "Kontor", "salary_min": 100.0}, {"salary_text": ""}, {"salary_text": "13 salaries a year"}, {"salary_text": "5 " * 9000}, {},
    ])
    got = {r.posting_no: (r.usd_year_min, r.usd_year_max) for r in found_pay(rows, platforms(spark), units(spark)).collect()}
    assert got == {1: (67000, 89000), 2: (28800, 43200), 3: (round(100 * 2080 * 1.08), -1), 4: (-1, 54000)}


def test_empty_tables(spark):
    assert found_pay(postings(spark, []), platforms(spark), units(spark)).count() == 0
    assert found_pay(postings(spark, [{"platform": "Eastboard", "salary_text": "$1 a year"}]), platforms(spark), units(spark, [])).count() == 1
    assert {(r.unit, r.a) for r in conversions(spark, units(spark, []), {"currency": "USD"}).collect()} == {("USD", 1.0)}


def test_a_large_unit_table_is_closed_by_joins(spark, monkeypatch):
    small = sorted(map(tuple, conversions(spark, units(spark), TARGETS, SCALE_EDGES).collect()))
    monkeypatch.setattr(graph, "MAX_EDGES", 2)
    large = sorted(map(tuple, conversions(spark, units(spark), TARGETS, SCALE_EDGES).collect()))
    assert [r[:3] for r in large] == [r[:3] for r in small] and [r[3] for r in large] == pytest.approx([r[3] for r in small])
    chain = [("t", "f", "c", 5 / 9, -160 / 9), ("t", "k", "c", 1.0, -273.15), ("t", "r", "f", 1.0, -459.67)]
    got = {r.unit: (r.a, r.b) for r in conversions(spark, units(spark), {"t": "c"}, chain).collect()}
    assert got["r"][0] * 671.67 + got["r"][1] == pytest.approx(100) and got["k"] == (1.0, -273.15)
    with pytest.raises(ValueError):
        conversions(spark, units(spark), {"t": "c"}, [*chain, ("t", "k", "r", 2.0, 0.0)])


def test_scales_compose_and_what_is_unread_is_counted(spark):
    table = {r.unit: r.a for r in conversions(spark, units(spark), {"scale": "one"}, SCALE_EDGES).collect()}
    assert table == pytest.approx({k: v for k, v in SCALE.items() if k})
    rows = postings(spark, [
        {"platform": "Eastboard", "salary_text": "2 crore INR yearly"}, {"platform": "Eastboard", "salary_text": "9 yearly"}, {"platform": "Eastboard", "salary_text": "$9"},
        {"platform": "Eastboard", "salary_text": "$9 weekly"}, {"salary_min": 3.0, "salary_currency": "AED", "salary_interval": "annual"}, {"salary_text": "none"},
    ])
    assert [tuple(r) for r in found_pay(rows, platforms(spark), units(spark)).collect()] == [(1, 240000, 240000)]
    got = {(r.reason, r.unit): r.n for r in unread_pay(rows, platforms(spark), units(spark)).collect()}
    assert got == {("no currency", None): 1, ("no period", None): 1, ("unknown period", "week"): 1, ("unknown currency", "AED"): 1}

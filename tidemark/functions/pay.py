"""Reading pay as people type it: amounts with their scale, currency, period and limiting words.

Pure functions of one text, of any length, for use inside Arrow batches. Nothing is converted
here: scales, currencies and periods come out as names of units.
"""

from __future__ import annotations

import re
from functools import lru_cache

# How a currency is written. A tuple of several codes is a sign they share.
CURRENCIES: dict[str, tuple[str, ...]] = {
    "us$": ("USD",), "usd": ("USD",), "us dollars": ("USD",), "us dollar": ("USD",), "a$": ("AUD",), "au$": ("AUD",), "aud": ("AUD",),
    "c$": ("CAD",), "ca$": ("CAD",), "cad": ("CAD",), "$": ("USD", "AUD", "CAD"), "dollars": ("USD", "AUD", "CAD"), "dollar": ("USD", "AUD", "CAD"),
    "£": ("GBP",), "gbp": ("GBP",), "pounds": ("GBP",), "pound": ("GBP",), "quid": ("GBP",), "€": ("EUR",), "eur": ("EUR",), "euro": ("EUR",), "euros": ("EUR",),
    "₹": ("INR",), "inr": ("INR",), "pkr": ("PKR",), "rs.": ("PKR", "INR"), "rs": ("PKR", "INR"), "rupees": ("PKR", "INR"), "rupee": ("PKR", "INR"),
    "aed": ("AED",), "dhs": ("AED",), "dh": ("AED",), "dirham": ("AED",), "dirhams": ("AED",),
}

# How a period is written, in English, German and Spanish.
PERIODS: dict[str, str] = {
    "hour": "h|hr|hrs|hour|hours|hourly|ph|p.h.|stunde|std|stündlich|hora|horas",
    "day": "d|day|days|daily|tag|täglich|dia|día|diario|diarios|diarias",
    "week": "wk|week|weeks|weekly|pw|p.w.|woche|wöchentlich|semana|semanal|semanales",
    "fortnight": "fortnight|fortnightly|biweekly|bi-weekly|two weeks|2 weeks|quincena|quincenal|quincenales",
    "month": "m|mo|mth|month|months|monthly|pm|p.m.|pcm|monat|monatlich|mes|mensual|mensuales|mtl",
    "year": "y|yr|year|years|yearly|annual|annually|annum|pa|p.a.|jahr|jährlich|año|ano|anual|anuales|ctc",
}

# How a scale is written after a number, and in a remark about other fields.
SCALES: dict[str, str] = {
    "thousand": "k|thousand|thousands|tsd|tausend|mil", "lakh": "lakh|lakhs|lac|lacs|l|lpa", "crore": "cr|crore|crores",
    "million": "m|mn|mio|million|millions|millionen|millones", "hundredth": "", "one": "",
}
REMARKS: dict[str, str] = {"one": "full units", "thousand": "thousands?|'000|’000|000s|k|tsd", "lakh": "lakhs?|lacs?", "crore": "crores?", "hundredth": "cents?|¢"}
# Scales whose mention beside an annual amount means rupees where no currency is written.
INDIAN = ("lakh", "crore")

# Words that leave one bound open.
UPPER_ONLY = r"up to|upto|max\.?|maximum|to a maximum of|at most|not more than|no more than|capped at|bis zu|höchstens|maximal|hasta|máximo|como máximo"
LOWER_ONLY = r"from|starting at|starting from|starts at|min\.?|minimum|at least|not less than|no less than|over|above|more than|ab|mindestens|desde|a partir de|mínimo"

_words = lambda groups: {w: unit for unit, words in groups.items() for w in words.split("|") if w}
_either = lambda words: "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True))
_PERIOD_WORDS, _SCALE_WORDS = _words(PERIODS), _words(SCALES)
_CUR_WORD = rf"(?:(?<![^\W\d_])(?:{_either(CURRENCIES)})(?![^\W\d_]))"
_PERIOD = _either(_PERIOD_WORDS)
_LONG = _either(w for w in _PERIOD_WORDS if len(w) > 2 or w in ("pa", "pm", "ph", "pw"))
_PER = r"(?:/\s*|\b(?:per|an?|each|every|pro|im|am|die|je|por|al|a la|la)\s+)"
PERIOD = re.compile(rf"(?:{_PER}(?P<a>{_PERIOD})|(?<![\w.])(?P<b>{_LONG}))(?![\w])", re.I)
_NUM = r"(?:\d{1,3}(?: \d{3})+(?![\d])(?:[.,]\d{1,2}(?!\d))?|\d+(?:[.,'’]\d+)*)"
AMOUNT = re.compile(rf"(?P<num>{_NUM})(?:\s?(?P<scale>{_either(_SCALE_WORDS)})(?![^\W_]|\.?\w))?(?P<plus>\s?\+)?", re.I)
# Words around a number that make it a count or a grade, not an amount.
_NOT_PAY_AFTER = re.compile(r"\s?(?:salaries|months? salar|days?\b|hours?\b(?! )|weeks? of|years? of|positions?|vacanc|openings?|%|percent)")
_NOT_PAY_BEFORE = re.compile(r"(?:grade|level|band|step|tier|class)\s?$")
_REMARK = re.compile("|".join(rf"(?P<{unit}>(?<![\w'’])(?:in |\()?(?:{words})(?![\w]))" for unit, words in REMARKS.items()), re.I)
_JOINED = re.compile(rf"\s*(?:{_CUR_WORD})?\s*(?:(?:{_PER}(?:{_PERIOD})|{_LONG})(?![\w])\s*)?(?:-|–|—|to|bis|a|and|und|y|hasta|\.\.)\s*(?:{_CUR_WORD})?\s*", re.I)
_MONEY_BEFORE, _MONEY_AFTER = re.compile(rf"{_CUR_WORD}\s?$", re.I), re.compile(rf"\s?{_CUR_WORD}(?!\s?\d)", re.I)
#: Characters of the longest words that are looked for right before a number, with a blank and what stands before.
_REACH = 2 + max(map(len, CURRENCIES))
_ANNUAL_RUPEES = re.compile(r"(?<![^\W\d_])(?:lpa|l\s?p\.?a\.?|(?:lakhs?|lacs?) p\.?a\.?|ctc)(?![^\W_])")

#: What a text says: lower and upper bound with their scales, the scale of a remark, currency and period; None where it says nothing.
Said = tuple[float | None, float | None, str | None, str | None, str | None, str | None, str | None]
NOTHING: Said = (None,) * 7


def number(text: str, scaled: bool = False) -> float | None:
    """A number with any of the usual separators; None if it cannot be read one way only."""
    t = re.sub(r"['’ ]", "", text)
    if "," in t and "." in t:
        dot = t.rfind(".") > t.rfind(",")
        t = t.replace(",", "") if dot else t.replace(".", "").replace(",", ".")
    elif re.fullmatch(r"\d{1,3}(?:,\d{2,3})*,\d{3}", t) or re.fullmatch(r"\d{1,3}(?:\.\d{3})+", t) and not (scaled and t.count(".") == 1):
        t = t.replace(",", "").replace(".", "")
    else:
        t = t.replace(",", ".")
    try:
        return float(t)
    except ValueError:
        return None


def currency(text: str | None, home: str | None) -> str | None:
    """The code that a currency as written means; shared signs mean the home currency."""
    codes = CURRENCIES.get((text or "").strip().lower())
    if not codes:
        return None
    return codes[0] if len(codes) == 1 else home if home in codes or home is None else codes[0]


def period(text: str | None) -> str | None:
    """The unit of a period field such as ``YEAR``, ``per annum`` or ``mth``."""
    t = " ".join((text or "").lower().split())
    return _PERIOD_WORDS.get(t) or _PERIOD_WORDS.get(re.sub(r"^(?:(?:per|an?|each|every) |/ ?)", "", t))


def _amounts(t: str, low: str) -> list[re.Match]:
    """The numbers of a text that are no counts or grades."""
    # '000 is a scale, not a number
    found = AMOUNT.finditer(re.sub(r"['’]000", "    ", t))
    return [m for m in found if not _NOT_PAY_AFTER.match(low, m.end()) and not _NOT_PAY_BEFORE.search(low[max(0, m.start() - 8) : m.start()])]


def _marked(m: re.Match, low: str) -> bool:
    """Whether an amount has a scale or touches a currency."""
    return bool(m["scale"] or _MONEY_AFTER.match(low, m.end()) or _MONEY_BEFORE.search(low[max(0, m.start() - _REACH) : m.start()]))


def _read(text: str, home: str | None) -> Said:
    t = " ".join(text.split())
    low = t.lower()
    if len(low) != len(t):  # a letter whose lower case is longer: positions must agree
        t = low
    unit = None
    if m := PERIOD.search(low):
        unit = _PERIOD_WORDS[(m["a"] or m["b"]).lower()]
    money = re.search(_CUR_WORD, low)
    code = currency(money[0], home) if money else None
    if _ANNUAL_RUPEES.search(low):
        unit, code = "year", code or "INR"
    if not re.search(r"\d", re.sub(r"['’]000", "", low)):
        remark = _REMARK.search(low)
        return None, None, None, None, remark.lastgroup if remark else None, code, unit
    spans = _amounts(t, low)
    if not spans:
        return None, None, None, None, None, code, unit
    joined = lambda i: 0 <= i < len(spans) - 1 and _JOINED.fullmatch(low, spans[i].end(), spans[i + 1].start()) is not None
    # the amount that money words touch first, else the first number; with its partner if it is half of a range
    at = next((i for i, m in enumerate(spans) if _marked(m, low)), 0)
    if joined(at):
        spans = spans[at : at + 2]
    else:
        spans = spans[at - 1 : at + 1] if at and joined(at - 1) else spans[at : at + 1]
    scales = [_SCALE_WORDS.get((m["scale"] or "").lower()) for m in spans]
    values = [number(m["num"], s is not None) for m, s in zip(spans, scales)]
    if None in values:
        return None, None, None, None, None, code, unit
    if len(values) == 2 and scales[0] is None and scales[1] is not None and values[0] <= values[1]:
        scales[0] = scales[1]
    if unit == "year" and code is None and any(s in INDIAN for s in scales):
        code = "INR"
    if len(values) == 2:
        return values[0], values[1], scales[0], scales[1], None, code, unit
    before = low[: spans[0].start()]
    edge = rf"(?:^|[^\w])(?:{{}})\s*(?:{_CUR_WORD})?\s*$"
    if re.search(edge.format(UPPER_ONLY), before):
        return None, values[0], None, scales[0], None, code, unit
    if spans[0]["plus"] or re.search(edge.format(LOWER_ONLY), before):
        return values[0], None, scales[0], None, None, code, unit
    return values[0], values[0], scales[0], scales[0], None, code, unit


_remembered = lru_cache(maxsize=200_000)(_read)


def read_pay(text: str, home: str | None) -> Said:
    """What a text says about pay, of any length (short texts, which repeat, are remembered).

    Without amounts the scale is a remark about other fields. The amount is the first that touches a
    currency or has a scale, else the first number; one half of a range brings the other. A single
    amount is both bounds unless a limiting word leaves one open (None).
    """
    return _remembered(text, home) if len(text) <= 200 else _read(text, home)

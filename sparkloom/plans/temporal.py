"""Periods named in questions, as date ranges. Every function takes today's date; none asks the clock."""

from __future__ import annotations

import calendar
import re
from datetime import date, timedelta

MONTHS = {m.lower(): i for i, m in enumerate(calendar.month_name) if m} | {m.lower(): i for i, m in enumerate(calendar.month_abbr) if m}
FISCAL_START = 4  # the fiscal year begins in April and is named by the year it ends in


def add_months(d: date, n: int) -> date:
    """The same day n months on, or the month's last day."""
    y, m = divmod(d.year * 12 + d.month - 1 + n, 12)
    return date(y, m + 1, min(d.day, calendar.monthrange(y, m + 1)[1]))


def month_range(y: int, m: int) -> tuple[date, date]:
    return date(y, m, 1), date(y, m, calendar.monthrange(y, m)[1])


def quarter_range(y: int, q: int) -> tuple[date, date]:
    return date(y, 3 * q - 2, 1), month_range(y, 3 * q)[1]


def fiscal_quarter_range(y: int, q: int) -> tuple[date, date]:
    first = add_months(date(y - 1, FISCAL_START, 1), 3 * (q - 1))
    return first, add_months(first, 3) - timedelta(days=1)


def fiscal_year_range(y: int) -> tuple[date, date]:
    return date(y - 1, FISCAL_START, 1), date(y, FISCAL_START, 1) - timedelta(days=1)


def _unit(word: str, today: date, shift: int) -> tuple[date, date]:
    """The whole week, month, quarter or year that lies ``shift`` from today's."""
    if word == "week":
        monday = today - timedelta(days=today.weekday() - 7 * shift)
        return monday, monday + timedelta(days=6)
    if word == "month":
        m = add_months(today.replace(day=1), shift)
        return month_range(m.year, m.month)
    if word == "quarter":
        m = add_months(today.replace(day=1), 3 * shift)
        return quarter_range(m.year, (m.month + 2) // 3)
    return date(today.year + shift, 1, 1), date(today.year + shift, 12, 31)


def _back(n: int, word: str, today: date, whole_months: bool) -> tuple[date, date]:
    if word == "day":
        return today - timedelta(days=n), today
    if word == "week":
        return today - timedelta(weeks=n), today
    start = add_months(today, -n * {"month": 1, "quarter": 3, "year": 12}[word])
    return (start.replace(day=1) if whole_months and word == "month" else start), today


def parse_period(text: str, today: date) -> tuple[date | None, date | None]:
    """The first period the text names, most specific forms first; (None, None) without one. A current week, month or year goes to its end."""
    t = text.lower()
    number = r"(\d{1,3}|a|one|two|three|six|twelve)"
    count = {"a": 1, "one": 1, "two": 2, "three": 3, "six": 6, "twelve": 12}
    if m := re.search(r"(?:between|from)\s+(\d{4}-\d{2}-\d{2})\s+(?:and|to)\s+(\d{4}-\d{2}-\d{2})", t):
        a, b = date.fromisoformat(m[1]), date.fromisoformat(m[2])
        return min(a, b), max(a, b)
    if m := re.search(r"(?:between|from)\s+((?:19|20)\d{2})\s+(?:and|to)\s+((?:19|20)\d{2})", t):
        a, b = sorted((int(m[1]), int(m[2])))
        return date(a, 1, 1), date(b, 12, 31)
    if m := re.search(r"\b(?:last|past|previous)\s+" + number + r"\s+(day|week|month|quarter|year)s?\b", t):
        return _back(count.get(m[1]) or int(m[1]), m[2], today, True)
    if m := re.search(r"\bfy\s*((?:19|20)?\d{2})\s*[- ]?q([1-4])\b|\bq([1-4])\s*fy\s*((?:19|20)?\d{2})\b", t):
        y = int(m[1] or m[4])
        return fiscal_quarter_range(y if y > 99 else 2000 + y, int(m[2] or m[3]))
    if m := re.search(r"\bq([1-4])[\s-]*((?:19|20)\d{2})\b|\b((?:19|20)\d{2})[\s-]*q([1-4])\b", t):
        return quarter_range(int(m[2] or m[3]), int(m[1] or m[4]))
    if m := re.search(r"\b(?:fy|fiscal\s+year)\s*((?:19|20)?\d{2})\b", t):
        y = int(m[1])
        return fiscal_year_range(y if y > 99 else 2000 + y)
    if m := re.search(r"\b(" + "|".join(sorted(MONTHS, key=len, reverse=True)) + r")\.?,?\s+((?:19|20)\d{2})\b", t):
        return month_range(int(m[2]), MONTHS[m[1]])
    if m := re.search(r"\b((?:19|20)\d{2})-(0[1-9]|1[0-2])\b(?!-)", t):
        return month_range(int(m[1]), int(m[2]))
    if re.search(r"\byesterday\b", t):
        return today - timedelta(days=1), today - timedelta(days=1)
    if re.search(r"\btoday\b", t):
        return today, today
    if m := re.search(r"\b(this|current|last|previous)\s+(week|month|quarter|year)\b", t):
        return _unit(m[2], today, 0 if m[1] in ("this", "current") else -1)
    if m := re.search(r"\b(ytd|mtd|qtd|(year|month|quarter)[\s-]to[\s-]date)\b", t):
        word = m[2] or {"y": "year", "m": "month", "q": "quarter"}[m[1][0]]
        return _unit(word, today, 0)[0], today
    if m := re.search(r"\bsince\s+((?:19|20)\d{2})\b", t):
        return date(int(m[1]), 1, 1), today
    if m := re.search(r"\bbefore\s+((?:19|20)\d{2})\b", t):
        return date(1970, 1, 1), date(int(m[1]) - 1, 12, 31)
    if m := re.search(r"\b(?:in|for|during|of|year)\s+((?:19|20)\d{2})\b", t):
        return date(int(m[1]), 1, 1), date(int(m[1]), 12, 31)
    return None, None


def parse_window(text: str, today: date, as_of: date | None = None) -> tuple[date | None, date | None]:
    """As parse_period, but anchored to the data's last date and never beyond it; ``last n months`` goes back from the day itself."""
    anchor = as_of or today
    t = text.lower()
    if m := re.search(r"\b(?:last|past|previous)\s+(\d{1,3})\s+(day|week|month|quarter|year)s?\b", t):
        return _back(int(m[1]), m[2], anchor, False)
    a, b = parse_period(text, anchor)
    return a, (min(b, anchor) if b and re.search(r"\b(this|current)\b", t) else b)


def overlaps(a: tuple, b: tuple) -> bool:
    return (a[1] is None or b[0] is None or a[1] >= b[0]) and (a[0] is None or b[1] is None or a[0] <= b[1])

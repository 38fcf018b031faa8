"""Simple questions planned into DataFrames without a language model: intent by patterns, columns by role labels, joins by approved edges."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame, functions as F

from sparkloom import policy
from sparkloom.plans.temporal import parse_period

# The phrases that ask for an aggregation, the first that occurs deciding.
AGGREGATIONS = {"COUNT": ("how many", "count", "number of"), "AVG": ("average", "avg", "mean"), "MAX": ("max", "maximum", "highest", "largest"), "MIN": ("min", "minimum", "lowest", "smallest"), "SUM": ("total", "sum", "overall")}
PERIODS = (("month", r"\bmonthly\b|\bby month\b|\bper month\b|\bmonth[- ]wise\b"), ("quarter", r"\bquarterly\b|\bby quarter\b|\bper quarter\b"), ("year", r"\byearly\b|\bannual(?:ly)?\b|\bby year\b|\bper year\b"))
HARD = r"\bwhy\b|\bcorrelat|\bforecast|\bpredict|\bcompare\b|\bversus\b|\bvs\b|\bexplain\b"


@dataclass
class Intent:
    aggregations: list[str]
    labels: list[str] = field(default_factory=list)
    period: str | None = None
    window: tuple[date | None, date | None] = (None, None)
    top_n: int | None = None
    hard: bool = False


def parse_intent(question: str, today: date) -> Intent:
    q = question.lower()
    aggs = [a for a, phrases in AGGREGATIONS.items() if any(re.search(rf"\b{p}\b", q) for p in phrases)]
    top = re.search(r"\btop\s+(\d+)\b", q)
    if top and not aggs:
        aggs = ["SUM"]
    if not aggs:
        aggs = ["RAW"] if re.search(r"\b(?:show|list|get|fetch|display|all)\b", q) else ["SUM"]
    period = next((p for p, rx in PERIODS if re.search(rx, q)), None)
    labels = [m.strip() for m in re.findall(r"\b(?:by|per)\s+([a-z][a-z _]*?)(?=\s+(?:in|for|during|since|before|last|this|between|from|monthly|quarterly|yearly|by|per|and)\b|[?.,]|$)", q)]
    labels = [x for x in dict.fromkeys(labels) if x not in ("month", "quarter", "year")]
    return Intent(aggs, labels, period, parse_period(q, today), int(top[1]) if top else None, bool(re.search(HARD, q)))


@dataclass
class Column:
    """A table's column with its role: entity_key, reference_key, additive_measure, non_additive_measure, date or attribute; and its label."""

    table: str
    name: str
    kind: str
    label: str


def _likeness(words: set[str], label: str) -> float:
    own = set(label.lower().replace("_", " ").split())
    return len(words & own) / len(own) if own else 0.0


def _hits(words: set[str], label: str) -> int:
    return len(words & set(label.lower().replace("_", " ").split()))


def plan(question: str, tables: dict[str, DataFrame], roles: list[Column], edges: list[tuple[str, str, str, str, float]], today: date) -> DataFrame:
    """The question's rows. edges: (table_a, column_a, table_b, column_b, confidence) of approved joins.

    The measure is the column whose label the question names best; only additive measures are summed. Needed tables are reached along edges of
    at least the planning confidence, the best edge of a pair first, four tables at most. Raises ValueError where it cannot plan.
    """
    intent = parse_intent(question, today)
    if intent.hard:
        raise ValueError("too complex to plan")
    words = set(re.findall(r"[a-z]+", question.lower()))
    agg = intent.aggregations[0]
    measures = [c for c in roles if c.kind == "additive_measure" or (c.kind == "non_additive_measure" and agg != "SUM")]
    named = words - {w for p in AGGREGATIONS.get(agg, ()) for w in p.split()}  # the word that asks for the aggregation names no column
    # a label that repeats the aggregation's word ("total price") is as likely by its other words; then the label with more words in the question, then the shorter
    asks = lambda c: (_likeness(named, c.label), _hits(named, c.label), _likeness(words, c.label), -len(c.label), c.table, c.name)
    measure = max(measures, key=asks, default=None) if agg not in ("RAW", "COUNT") else None
    if agg not in ("RAW", "COUNT") and (measure is None or (_likeness(named, measure.label) == 0 and _likeness(words, measure.label) < 1)):
        raise ValueError("no measure the question names")
    dims = []
    for label in intent.labels:
        want = set(label.split())
        best = max((c for c in roles if c.kind in ("attribute", "reference_key", "entity_key")), key=lambda c: _likeness(want, c.label), default=None)
        if best is None or _likeness(want, best.label) == 0:
            raise ValueError(f"no column for {label}")
        dims.append(best)
    base = measure.table if measure else dims[0].table if dims else max({c.table for c in roles}, key=lambda t: (_likeness(words, t), t))
    dates = [c for c in roles if c.kind == "date"]
    when = None
    if intent.period or intent.window != (None, None):
        when = next((c for c in dates if c.table == base), None) or next((c for c in dates if any(c.table == x.table for x in dims)), None) or next(iter(dates), None)
        if when is None:
            raise ValueError("no date")
    need = [base, *dict.fromkeys(c.table for c in [*dims, *([when] if when else [])] if c.table != base)]
    df, reached = tables[base], {base}
    usable = sorted((e for e in edges if e[4] >= policy.PLAN_JOIN_CONFIDENCE), key=lambda e: -e[4])
    for target in need[1:]:
        if target in reached:
            continue
        edge = next(((a, x, b, y) for a, x, b, y, _ in [*usable, *[(b, y, a, x, c) for a, x, b, y, c in usable]] if a in reached and b == target), None)
        if edge is None or len(reached) >= 4:
            raise ValueError(f"no approved join to {target}")
        other = tables[target]
        df = df.join(other, F.col(edge[1]) == F.col(edge[3]), "left")
        reached.add(target)
    if intent.window != (None, None):
        a, b = intent.window
        day = F.col(when.name).cast("date")
        df = df.where((day >= F.lit(a)) if a else F.lit(True)).where((day <= F.lit(b)) if b else F.lit(True))
    if agg == "RAW":
        return df.limit(intent.top_n or 100)
    keys = [F.col(c.name).alias(c.label.replace(" ", "_")) for c in dims]
    if intent.period:
        d = F.col(when.name)
        keys.append({"month": F.date_format(d, "yyyy-MM"), "quarter": F.concat(F.year(d), F.lit("-Q"), F.quarter(d)), "year": F.year(d).cast("string")}[intent.period].alias("period"))
    value = F.expr(f"try_cast(`{measure.name}` as double)") if measure else F.lit(1)
    made = {"SUM": F.sum, "AVG": F.avg, "MAX": F.max, "MIN": F.min}
    out = df.groupBy(*keys).agg((F.count(F.lit(1)) if agg == "COUNT" else made[agg](value)).alias("value"))
    names = [c for c in out.columns if c != "value"]
    return out.orderBy(F.desc("value"), *names).limit(intent.top_n or 50) if keys else out

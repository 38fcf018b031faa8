"""Cleaning of untyped tables: cells, rows, and types chosen from match ratios. One pass over the data each, all JVM-side."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from sparkloom import policy
from sparkloom.functions import scalars

RowRule = Callable[[list[str]], Column]


def unique_names(names: list[str]) -> list[str]:
    """Names made different from each other without regard to case: x, x_1, x_2; blank ones become column_<place>."""
    seen: dict[str, int] = {}
    out = []
    for i, n in enumerate(names):
        n = " ".join(str(n).split()) or f"column_{i + 1}"
        k = n.lower()
        while k in seen:
            seen[k] += 1
            n2 = f"{n}_{seen[k]}"
            if n2.lower() not in seen:
                n, k = n2, n2.lower()
        seen.setdefault(k, 0)
        out.append(n)
    return out


def clean_cell(c: Column) -> Column:
    """Text without invisible characters, line breaks and tabs as blanks, blanks collapsed, trimmed, empty as null."""
    t = F.regexp_replace(c, "[\u0000-\u0008\u000b\u000c\u000e-\u001f\u007f​-‏⁠﻿­]", "")
    return F.nullif(F.trim(F.regexp_replace(t, "[\\s ]+", " ")), F.lit(""))


def nullify(c: Column, extra: tuple[str, ...] = ()) -> Column:
    return F.when(~F.lower(F.trim(c)).isin(*policy.NULL_TOKENS, *extra), c)


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]


def clean_strings(df: DataFrame, null_tokens: bool = True, extra: tuple[str, ...] = ()) -> DataFrame:
    """Every text column cleaned; null words as null."""
    out = {}
    for n in text_columns(df):
        c = clean_cell(F.col(f"`{n}`"))
        out[n] = nullify(c, extra) if null_tokens else c
    return df.withColumns(out)


def all_empty(cols: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.coalesce(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")) == "" for c in cols])


def garbage_keyword(cols: list[str], extra: tuple[str, ...] = ()) -> Column:
    """The first column begins with a word of report totals."""
    rx = r"(?i)^\s*(" + "|".join([*policy.GARBAGE_PATTERNS, *extra]) + r")(?:\b|$)"
    return F.coalesce(F.col(f"`{cols[0]}`").cast("string").rlike(rx), F.lit(False))


def separator(cols: list[str]) -> Column:
    """At least one filled cell, and all filled cells are made of rule characters."""
    cells = [F.coalesce(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")) for c in cols]
    return reduce(lambda a, b: a | b, [c != "" for c in cells]) & reduce(lambda a, b: a & b, [(c == "") | c.rlike(r"^[-=*_~\s|+]+$") for c in cells])


RULES: dict[str, RowRule] = {"all_empty": all_empty, "garbage_keyword": garbage_keyword, "separator": separator}


def judge_rows(df: DataFrame, rules: dict[str, RowRule] | None = None) -> DataFrame:
    """df with ``_reason``: the first rule that fires for a row, else null."""
    cols = df.columns
    return df.withColumn("_reason", F.coalesce(*[F.when(r(cols), n) for n, r in (rules or RULES).items()]))


def kept_rows(judged: DataFrame) -> DataFrame:
    return judged.where("_reason is null").drop("_reason")


def quarantine_summary(judged: DataFrame) -> DataFrame:
    """Exact number of quarantined rows for each reason."""
    return judged.where("_reason is not null").groupBy(F.col("_reason").alias("reason")).agg(F.count(F.lit(1)).alias("n_rows"))


def already_clean(encoding: Column, delimiter: Column, header_row: Column, has_rows: Column, broken: Column, allowed: tuple[str, ...] = (",",)) -> Column:
    """Whether a probe shows a file that needs no rewriting: UTF-8, a usual delimiter, the header first, rows, and none of them broken."""
    return F.coalesce((encoding == "UTF-8") & delimiter.isin(*allowed) & (header_row == 0) & has_rows & (broken == 0), F.lit(False))


def is_identifier(name: str) -> bool:
    n = name.strip().lower()
    return n in policy.IDENTIFIER_EXACT or n.endswith(policy.IDENTIFIER_SUFFIXES) or n.startswith(policy.IDENTIFIER_PREFIXES)


def detect_types(df: DataFrame) -> list[tuple[str, str, float]]:
    """(column, identifier | boolean | date | numeric | text, share of values that match). One aggregation over all rows.

    An identifier's name decides alone; a boolean column holds nothing but truth words; dates and numbers need a share that a telling name lowers.
    A column without values is text.
    """
    cols = text_columns(df)
    if not cols:
        return []
    aggs = []
    for i, n in enumerate(cols):
        c = F.trim(F.col(f"`{n}`"))
        aggs += [
            F.count(F.nullif(c, F.lit(""))).alias(f"n{i}"),
            F.sum(F.when(F.lower(c).isin(*policy.TRUE_VALUES, *policy.FALSE_VALUES), 1).otherwise(0)).alias(f"b{i}"),
            F.count(scalars.date_of(c)).alias(f"d{i}"),
            F.count(scalars.number_of(c)).alias(f"m{i}"),
        ]
    row = df.agg(*aggs).first()
    out = []
    for i, name in enumerate(cols):
        n = row[f"n{i}"] or 0
        share = lambda k, i=i, n=n: (row[f"{k}{i}"] or 0) / n if n else 0.0
        low = name.lower()
        if is_identifier(name):
            out.append((name, "identifier", 1.0))
        elif n and share("b") == 1:
            out.append((name, "boolean", 1.0))
        elif n and share("d") >= (policy.DATE_HINT_SHARE if any(h in low for h in policy.DATE_HINTS) else policy.DATE_SHARE):
            out.append((name, "date", share("d")))
        elif n and share("m") >= (policy.NUMBER_HINT_SHARE if any(h in low for h in policy.NUMBER_HINTS) else policy.NUMBER_SHARE):
            out.append((name, "numeric", share("m")))
        else:
            out.append((name, "text", 1.0))
    return out


def convert(df: DataFrame, types: list[tuple[str, str, float]]) -> DataFrame:
    """Columns in their detected types; a value that does not fit becomes null."""
    out = {}
    for name, kind, _ in types:
        c = F.col(f"`{name}`")
        low = F.lower(F.trim(c))
        if kind == "boolean":
            out[name] = F.when(low.isin(*policy.TRUE_VALUES), True).when(low.isin(*policy.FALSE_VALUES), False)
        elif kind == "date":
            out[name] = scalars.date_of(c)
        elif kind == "numeric":
            out[name] = scalars.number_of(c)
    return df.withColumns(out) if out else df


def clean_table(df: DataFrame, dedup: bool = True, rules: dict[str, RowRule] | None = None) -> DataFrame:
    """Names, cells, rows, exact repeats and types in one pipeline."""
    named = df.toDF(*unique_names(df.columns))
    rows = kept_rows(judge_rows(clean_strings(named).na.drop("all"), rules))
    rows = rows.dropDuplicates() if dedup else rows
    return convert(rows, detect_types(rows))

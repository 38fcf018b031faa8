"""Scalar functions as column expressions; each stays inside whole-stage code generation."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from sparkloom import policy


def normal_key(c: Column) -> Column:
    """A key value as it is compared: lower case, trimmed, blanks collapsed, leading zeros of whole numbers dropped, null words null."""
    low = F.lower(F.trim(c.cast("string")))
    tight = F.regexp_replace(F.regexp_replace(low, r"\s+", " "), r"^0+(\d+)$", "$1")
    return F.when(~low.isin(*policy.NULL_TOKENS) & (low != ""), tight)


def fingerprint(c: Column) -> Column:
    """The first 16 hexadecimal figures of the SHA-256 of the normal key."""
    return F.substring(F.sha2(normal_key(c), 256), 1, 16)


def slug(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), F.lit("_"))


def tokens(c: Column, least: int = 2) -> Column:
    """Distinct lower-case words of letters and figures, in order, of at least ``least`` characters."""
    return F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda x: F.length(x) >= least))


def token_overlap(a: Column, b: Column) -> Column:
    """Share of a's tokens that b has; 0 without tokens."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(a)), F.lit(0.0))


def acronym(c: Column) -> Column:
    return F.array_join(F.transform(tokens(c, 1), lambda x: F.substring(x, 1, 1)), "")


def sentences(c: Column) -> Column:
    """The text split after sentence marks that a blank follows."""
    return F.filter(F.split(F.trim(c), r"(?<=[.!?])\s+"), lambda x: x != "")


def token_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"\s+"), lambda x: x != "")).cast("long")


def table_rows(c: Column) -> Column:
    """The rows of a markdown table without its separator lines."""
    return F.filter(F.split(c, "\n"), lambda x: x.rlike(r"^\s*\|") & ~x.rlike(r"^[\s|:\-]+$"))


def role_kind(c: Column) -> Column:
    """kind and label of a role ``custom:<kind>:<label>``."""
    parts = F.split(c, ":")
    ok = (F.size(parts) == 3) & (parts[0] == "custom")
    return F.when(ok, F.struct(parts[1].alias("kind"), parts[2].alias("label")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine clamped to 0..1; 0 for vectors of different lengths or of length zero."""
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    dot = F.aggregate(product, F.lit(0.0), lambda s, x: s + x)
    square = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    norm = F.sqrt(square(a) * square(b))
    return F.when((F.size(a) != F.size(b)) | (norm == 0) | a.isNull() | b.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot / norm)))


def trigrams(c: Column) -> Column:
    """The set of three-letter runs of the words, each with two blanks before and one behind."""
    words = F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda x: x != "")
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def quarter_label(c: Column) -> Column:
    return F.concat(F.year(c), F.lit("-Q"), F.quarter(c))


def windows_overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Whether two closed ranges meet; an open end is null."""
    return (a1.isNull() | b0.isNull() | (a1 >= b0)) & (a0.isNull() | b1.isNull() | (a0 <= b1))


def date_of(c: Column) -> Column:
    """A date written in one of the known formats or as a spreadsheet serial; years outside 1901..2100, bare years and period labels are none."""
    t = F.trim(c)
    # a shape test comes before each parse: a failed parse is many times dearer than a failed match
    shape = lambda f: "(?i)^" + f.replace(".", r"\.").replace("MMMM", "[a-z]{3,9}").replace("MMM", "[a-z]{3}").replace("yyyy", r"\d{4}").replace("MM", r"\d{2}").replace("dd", r"\d{2}") + "$"
    parsed = F.coalesce(*[F.when(t.rlike(shape(f)), F.to_date(F.try_to_timestamp(F.initcap(t) if "MMM" in f else t, F.lit(f)))) for f in sorted(policy.DATE_FORMATS, key=lambda f: "MMM" in f)])
    serial = F.when(t.rlike(r"^\d{4,5}$"), t.cast("int"))
    from_serial = F.when(serial.between(policy.SERIAL_MIN, policy.SERIAL_MAX) & ~t.rlike(r"^\d{4}$"), F.date_add(F.lit(policy.SERIAL_EPOCH).cast("date"), serial))
    d = F.when(~t.rlike(r"^[A-Za-z]{3}-\d{2,4}$") & ~t.rlike(r"^\d{4}$"), F.coalesce(parsed, from_serial))
    return F.when(F.year(d).between(policy.YEAR_MIN, policy.YEAR_MAX), d)


def number_of(c: Column) -> Column:
    """A number without currency signs, thousands marks and blanks between figures; a percentage is divided by 100."""
    t = F.regexp_replace(F.trim(c), "[$₹€£¥₩₦₱₺₴₽¢฿​‌‍‎‏﻿­⁠　]", "")
    t = F.regexp_replace(F.trim(t), r"(?<=\d)\s(?=\d)", "")
    t = F.when(t.rlike(r"^[+-]?[\d,]+\.?\d*\s*%?$"), F.regexp_replace(t, ",", "")).otherwise(t)
    percent = t.rlike(r"^[+-]?\d+\.?\d*\s*%$")
    n = F.regexp_replace(t, r"\s*%$", "").try_cast("double")
    return F.when(percent, F.round(n / 100, 12)).when(~t.rlike("%"), n)


def prose_number(c: Column) -> Column:
    """The first number in a sentence, with K, M or B written out."""
    m = F.regexp_extract(c, r"(-?\d[\d,]*\.?\d*)\s*([KMBkmb])?\b", 1)
    unit = F.upper(F.regexp_extract(c, r"(-?\d[\d,]*\.?\d*)\s*([KMBkmb])?\b", 2))
    scale = F.when(unit == "K", 1e3).when(unit == "M", 1e6).when(unit == "B", 1e9).otherwise(1.0)
    return F.regexp_replace(m, ",", "").try_cast("double") * scale


def logical_table(path: Column) -> Column:
    """The table a file is a part of: name without folder, key, extension, date and format mark, in upper case."""
    name = F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"^[0-9a-fA-F]{8}_", "")
    name = F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), r"(?i)(?:[_\- ](?:tab|pipe|csv|xlsx|xls|txt|tsv|parquet))+$", "")
    name = F.regexp_replace(name, r"[_\- ](?:19|20)\d{2}(?:[_\-]?\d{2}){0,2}$", "")
    name = F.trim(F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9_]", "_"), "_+", "_"), F.lit("_"))
    name = F.when(name == "", "TABLE").when(name.rlike("^[A-Za-z]"), name).otherwise(F.concat(F.lit("T_"), name))
    return F.upper(name)


def file_period(path: Column) -> Column:
    """The period ``YYYY_MM`` (or ``YYYY``) at the end of a file name, before a format mark."""
    base = F.regexp_replace(F.regexp_replace(path, r"\.[^./]*$", ""), r"(?i)(?:[_\- ](?:tab|pipe|csv|xlsx|xls|txt|tsv|parquet))+$", "")
    m = F.regexp_extract(base, r"[_\- ]((?:19|20)\d{2})[_\-]?(\d{2})?(?:[_\-]?\d{2})?$", 1)
    n = F.regexp_extract(base, r"[_\- ]((?:19|20)\d{2})[_\-]?(\d{2})?(?:[_\-]?\d{2})?$", 2)
    return F.when(m != "", F.when(n != "", F.concat_ws("_", m, n)).otherwise(m))


def plain_words(text: str) -> list[str]:
    """Words of a name on the driver, in lower case."""
    return [w for w in re.split(r"[\s\-_/,]+", text.lower()) if w]

"""Schemas that drift between the files of one logical table.

Method: rows are loaded as path-value maps with their raw JSON types; path-type statistics are aggregated by file; a table's
months are compared in order, columns are followed through renames, and the rows are projected to the table's final columns
and types with failed casts reported.

A column is followed by its values and its name. What the values of few rows leave open is decided by what the other tables say:
a first pass counts how often each name that went met each name that came, and how often its values proved it the same; the
second takes pairs proven in several tables and in most of their meetings as the same also where the values alone do not.

The change of a type is one of the declared types, which hold until another is declared; what the raw types say of the same
column is reported beside it by ``observed_types``.

Defined results. A file's newest metadata row that names columns counts; a month with several files takes the one read last. Column
names are compared in lower case without outer blanks; of equal names in one file the first counts. A column without a type
keeps its last known type; a first known type is no change. A file whose name has no date, a null record or broken JSON gives
no row. Repeated rows count once. Empty tables give empty results. Extra columns are ignored. Objects are opened at any depth,
arrays are values.
"""

from __future__ import annotations

import datetime as dt
import json
import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sparkloom import policy
from sparkloom.session import durable

NAME = r"^(.*?)[_\- ]?((?:19|20)\d{2})[_\-]?(0[1-9]|1[0-2])(?:[_\-][A-Za-z]+)?(?:\.[A-Za-z0-9]+)?$"
FAMILIES = ("text", "whole", "fraction", "date", "boolean")
# Words that say how a value is kept, not what it means; and letters of one name that stand for another word.
FILLER = {"is", "flag", "no", "num", "nr", "id", "code", "cd", "nm", "name", "date", "dt", "on", "by", "of", "per", "the", "amt", "amount", "value", "pct", "rate", "ref", "text", "txt"}
OUT = "row_kind string, period_key string, change_kind string, column_before string, column_after string, logical_column string, family string"


def table_of(name: Column) -> tuple[Column, Column]:
    """table_name and period_key read from a file name; null where it has no date."""
    base = F.regexp_replace(F.trim(name), r"^[0-9a-f]{8}_", "")
    hit = base.rlike(NAME)
    return F.when(hit, F.upper(F.regexp_extract(base, NAME, 1))), F.when(hit, F.concat_ws("_", F.regexp_extract(base, NAME, 2), F.regexp_extract(base, NAME, 3)))


def family_of(t: Column) -> Column:
    """The family of an engine's type name; null where there is none."""
    t = F.lower(F.trim(t))
    return (
        F.when(t.rlike("string|char|text|utf8|object|categor|dictionary"), "text").when(t.rlike("bool"), "boolean").when(t.rlike("date|time"), "date")
        .when(t.rlike("float|double|decimal|numeric|real"), "fraction").when(t.rlike("int|long|short|serial"), "whole").when(F.length(t) > 0, "text")
    )


def declared_columns(columns_info: Column) -> Column:
    """ARRAY<STRUCT<name, type>> from any of the JSON shapes: objects with name/type or column/dtype, plain names, a map of name to type, or any of these under ``columns``."""
    inner = F.coalesce(F.get_json_object(columns_info, "$.columns"), columns_info)
    objects = F.from_json(inner, "array<struct<name:string,column:string,type:string,dtype:string>>")
    names = F.from_json(inner, "array<string>")
    mapped = F.from_json(inner, "map<string,string>")
    as_objects = F.transform(F.filter(objects, lambda x: F.coalesce(x["name"], x["column"]).isNotNull()), lambda x: F.struct(F.coalesce(x["name"], x["column"]).alias("name"), F.coalesce(x["type"], x["dtype"]).alias("type")))
    as_names = F.transform(F.filter(names, lambda x: x.isNotNull() & ~x.startswith("{")), lambda x: F.struct(x.alias("name"), F.lit(None).cast("string").alias("type")))
    as_map = F.transform(F.map_entries(mapped), lambda x: F.struct(x["key"].alias("name"), x["value"].alias("type")))
    return F.when(F.ltrim(inner).startswith("{"), as_map).when(F.size(as_objects) > 0, as_objects).otherwise(as_names)


def monthly_columns(files: DataFrame, metadata: DataFrame) -> DataFrame:
    """container_id, table_name, period_key, file_id, position, column_name, family: the columns of each month of each table."""
    table, period = table_of(F.col("name"))
    named = files.where("id is not null").groupBy("id").agg(F.max(F.struct("created_at", "name", "container_id")).alias("f")).select(F.col("id").alias("file_id"), "f.container_id", "f.name")
    named = named.select("file_id", "container_id", table.alias("table_name"), period.alias("period_key")).where("table_name is not null")
    cols = metadata.where("file_id is not null").select("file_id", "ingested_at", "columns_info", declared_columns(F.col("columns_info")).alias("cols")).where(F.size("cols") > 0)
    newest = cols.groupBy("file_id").agg(F.max(F.struct("ingested_at", "columns_info", "cols")).alias("m")).select("file_id", "m.ingested_at", "m.cols")
    month = named.join(newest, "file_id").groupBy("container_id", "table_name", "period_key").agg(F.max(F.struct("ingested_at", "file_id", "cols")).alias("m")).select("container_id", "table_name", "period_key", "m.file_id", F.posexplode("m.cols").alias("position", "c"))
    name = F.lower(F.trim(F.col("c.name")))
    return month.select("container_id", "table_name", "period_key", "file_id", "position", name.alias("column_name"), family_of(F.col("c.type")).alias("family")).where("column_name <> ''").groupBy("container_id", "table_name", "period_key", "file_id", "column_name").agg(F.min(F.struct("position", "family")).alias("x")).select("container_id", "table_name", "period_key", "file_id", "column_name", "x.position", "x.family")


class _Number(str):
    """A JSON number as it is written."""


class _Whole(_Number):
    pass


def _no_number(s: str):
    raise ValueError(s)


def leaves_of(record: str | None) -> list[tuple[str, str, str | None]] | None:
    """(path, raw JSON type, value as text) of each leaf of an object, objects opened at any depth; None where there is no object."""
    try:
        top = json.loads(record, parse_float=_Number, parse_int=_Whole, parse_constant=_no_number) if record else None
    except (ValueError, RecursionError):
        return None
    if not isinstance(top, dict):
        return None
    out, todo = [], [("", top)]
    while todo:
        before, obj = todo.pop()
        for k, v in obj.items():
            path = before + k.strip().lower()
            if isinstance(v, _Number):
                out.append((path, "whole" if isinstance(v, _Whole) else "fraction", str(v)))
            elif isinstance(v, str):
                out.append((path, "text", v))
            elif v is None:
                out.append((path, "null", None))
            elif isinstance(v, bool):
                out.append((path, "boolean", "true" if v else "false"))
            elif isinstance(v, dict):
                todo.append((path + ".", v))
            else:
                out.append((path, "nested", json.dumps(v, ensure_ascii=False)))
    return out


def date_value(c: Column) -> Column:
    """A date from the usual written forms; null otherwise."""
    forms = (("^\\d{4}-\\d{2}-\\d{2}", "yyyy-MM-dd", 10), ("^\\d{2}\\.\\d{2}\\.\\d{4}", "dd.MM.yyyy", 10), ("^\\d{2}/\\d{2}/\\d{4}", "dd/MM/yyyy", 10), ("^\\d{2}-[A-Za-z]{3}-\\d{4}", "dd-MMM-yyyy", 11), ("^\\d{4}/\\d{2}/\\d{2}", "yyyy/MM/dd", 10), ("^(?:19|20)\\d{2}[01]\\d[0-3]\\d$", "yyyyMMdd", 8))
    return F.coalesce(*[F.when(c.rlike(rx), F.try_to_timestamp(F.initcap(F.substring(c, 1, n)) if "MMM" in f else F.substring(c, 1, n), F.lit(f)).cast("date")) for rx, f, n in forms])


def number_value(c: Column) -> Column:
    """A number from text with currency signs, blanks, points or commas; a sole comma before one or two last figures is the decimal sign."""
    plain = F.regexp_replace(F.trim(c), "[\\s '$€£%]", "")
    comma = plain.rlike(r"^[+-]?[\d.]*,\d{1,2}$")
    return F.when(comma, F.regexp_replace(F.regexp_replace(plain, r"\.", ""), ",", ".")).otherwise(F.regexp_replace(plain, ",", "")).try_cast("double")


def named_files(files: DataFrame) -> DataFrame:
    """file_id, container_id, table_name, period_key of the files whose name has a date."""
    table, period = table_of(F.col("name"))
    return files.where("id is not null").select(F.col("id").alias("file_id"), "container_id", table.alias("table_name"), period.alias("period_key")).where("table_name is not null").distinct()


COUNTS = ("text", "whole", "fraction", "boolean")
STATS = [(f"n_{k}", "bigint") for k in COUNTS] + [("n", "bigint"), ("mask", "string"), ("lead", "string"), *[(k, "double") for k in ("number", "lo", "hi", "day")], *[(f"{k}{i}", "double") for k in ("size", "day", "num") for i in range(3)]]
_CLASSES = str.maketrans({**dict.fromkeys("bcdefghijklmnopqrstuvwxyz", "a"), **dict.fromkeys("BCDEFGHIJKLMNOPQRSTUVWXYZ", "A"), **dict.fromkeys("012345678", "9")})
_RUNS = re.compile(r"([aA9])\1+")
_LEAD = re.compile(r"\D{1,6}")


def _shape(value: str) -> str:
    """The value with runs of small letters, capitals and figures as one of each."""
    return _RUNS.sub(r"\1", value.translate(_CLASSES))


def statistics(leaves: list[tuple[str, str | None]]) -> tuple:
    """STATS of one column's leaves (raw type, value): counts of raw types, commonest shape and beginning, middle, least and greatest number, middle day, and the count, sum and sum of squares of sizes (logarithms), days and numbers."""
    n = dict.fromkeys(COUNTS, 0)
    masks: dict[str, int] = {}
    leads: dict[str, int] = {}
    numbers, days = [], []
    for kind, value in leaves:
        if kind in n:
            n[kind] += 1
        if value is None:
            continue
        m = _shape(value)
        masks[m] = masks.get(m, 0) + 1
        if kind == "text":
            lead = _LEAD.match(value)
            lead = lead[0] if lead else ""
            leads[lead] = leads.get(lead, 0) + 1
        if kind == "text" or kind == "whole":
            day = read_date(value, serial=False) if value[:2].isdigit() else None
            if day is not None:
                days.append(float((day - EPOCH).days))
        x = float(value) if kind in ("whole", "fraction") else read_number(value) if kind == "text" and any(c.isdigit() for c in value) else None
        if x is not None and math.isfinite(x):
            numbers.append(x)
    most = lambda d: min(d, key=lambda k: (-d[k], k)) if d else None
    middle = lambda v: sorted(v)[(len(v) - 1) // 2] if v else None
    sums = lambda v: (float(len(v)), sum(v), sum([x * x for x in v])) if v else (0.0, 0.0, 0.0)
    sizes = [math.log10(abs(x)) for x in numbers if x]
    return (*n.values(), len(leaves), most(masks), most(leads), middle(numbers), min(numbers, default=None), max(numbers, default=None), middle(days), *sums(sizes), *sums(days), *sums(numbers))


def path_statistics(rows: DataFrame, block_rows: int = 65_536) -> DataFrame:
    """Per file and path its STATS. A file's records are co-located in blocks of ``block_rows`` row numbers, each block gives one row a path, and blocks are merged: of shapes, beginnings and middle values that of the block with the most rows counts.

    So records are shuffled once, for their repeats and their statistics together, and a file of any size is no hot group.
    """
    block = F.floor(F.col("row_no") / block_rows).alias("block")
    distinct = rows.where("file_id is not null and record is not null").select("file_id", block, "row_no", "record").repartition("file_id", "block").distinct().sortWithinPartitions("file_id", "block")
    schema = pa.schema([("file_id", pa.string()), ("path", pa.string()), *[(c, {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64()}[t]) for c, t in STATS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}
        out: list[tuple] = []

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

        for batch in batches:
            for file, blk, record in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (file, blk) != now:
                    out += [(now[0], p, *statistics(v)) for p, v in held.items()]
                    now, held = (file, blk), {}
                    if len(out) > 5000:
                        yield batch_of()
                        out.clear()
                for p, k, v in leaves_of(record) or ():
                    held.setdefault(p, []).append((k, v))
        out += [(now[0], p, *statistics(v)) for p, v in held.items()]
        if out:
            yield batch_of()

    one = distinct.select("file_id", "block", "record").mapInArrow(run, "file_id string, path string, " + ", ".join(f"{c} {t}" for c, t in STATS))
    largest = {"mask", "lead", "number", "day"}
    merged = [F.max_by(c, F.struct("n", "mask")) if c in largest else F.min(c) if c == "lo" else F.max(c) if c == "hi" else F.sum(c) for c, _ in STATS]
    return one.groupBy("file_id", "path").agg(*[m.alias(c) for m, (c, _) in zip(merged, STATS)])


def words(name: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9]+|(?<=[a-z])(?=\d)", name.lower()) if w]


def name_likeness(a: str, b: str) -> float:
    """How alike two column names are: meaning words that begin alike, one name the other's letters in order, or initials."""
    wa, wb = words(a), words(b)
    ja, jb = "".join(wa), "".join(wb)
    if ja == jb or sorted(wa) == sorted(wb):
        return 1.0
    ma, mb = [w for w in wa if w not in FILLER] or wa, [w for w in wb if w not in FILLER] or wb
    if any(x[:1] == y[:1] and (x.startswith(y[:4]) or y.startswith(x[:4])) and min(len(x), len(y)) >= 3 for x in ma for y in mb):
        return 0.8
    if any(len(x) >= 4 and x in other for x, other in [*((x, jb) for x in ma), *((y, ja) for y in mb)]):
        return 0.8
    short, long = sorted((ja, jb), key=len)
    it = iter(long)
    if short[0] == long[0] and all(ch in it for ch in short) and len(short) >= 2:
        return 0.7 if len(short) >= 4 else 0.6
    if "".join(w[0] for w in wa) == jb or "".join(w[0] for w in wb) == ja:
        return 0.7
    sa, sb = "".join(ma), "".join(mb)
    short, long = sorted((sa, sb), key=len)
    it = iter(long)
    if short[0] == long[0] and len(short) >= 3 and all(ch in it for ch in short):
        return 0.6
    ga, gb = {ja[i : i + 3] for i in range(len(ja) - 2)}, {jb[i : i + 3] for i in range(len(jb) - 2)}
    return 0.5 * len(ga & gb) / max(1, len(ga | gb))


EPOCH = dt.date(1970, 1, 1)
SERIAL_ZERO = (dt.date.fromisoformat(policy.SERIAL_EPOCH) - EPOCH).days


def _moments(s: list[tuple[float, float, float]]) -> tuple[float, float, float]:
    """Count, mean and variance of merged (count, sum, sum of squares)."""
    n, t, q = (sum(x[i] for x in s) for i in range(3))
    return (n, t / n, max(0.0, q / n - (t / n) ** 2)) if n else (0.0, 0.0, 0.0)


def _apart(x: tuple, y: tuple, least: float) -> float:
    """How many standard errors two means are apart; least: the least deviation one value has."""
    spread = (x[0] * x[2] + y[0] * y[2]) / (x[0] + y[0])
    return abs(x[1] - y[1]) / math.sqrt(max(spread, least**2) * (1 / x[0] + 1 / y[0]))


def in_month(stat: dict, period: str) -> dict:
    """A file's statistics of a column with its days counted from the month's beginning; whole numbers that are a date's serial near the month are days too."""
    start = (dt.date(int(period[:4]), int(period[5:7]), 1) - EPOCH).days
    n, t, q = stat["day0"], stat["day1"] or 0.0, stat["day2"] or 0.0
    day = stat["day"]
    if not n and stat["n_whole"] and policy.SERIAL_MIN <= (stat["lo"] or 0) and (stat["hi"] or 0) <= policy.SERIAL_MAX and abs(stat["number"] + SERIAL_ZERO - start) <= 400:
        n, t, q, day = stat["num0"], stat["num1"] + stat["num0"] * SERIAL_ZERO, stat["num2"] + 2 * SERIAL_ZERO * stat["num1"] + stat["num0"] * SERIAL_ZERO**2, stat["number"] + SERIAL_ZERO
    gone = lambda v: v is None or v != v
    return stat | {"day": None if not n or gone(day) else day - start, "days": (n, t - n * start, q - 2 * start * t + n * start**2), "sizes": (stat["size0"], stat["size1"] or 0.0, stat["size2"] or 0.0), **{k: None if gone(stat[k]) else stat[k] for k in ("number", "lo", "hi")}}


def data_likeness(a: list[dict], b: list[dict]) -> float | None:
    """How alike the values of two columns are over the files of each; None without values.

    Middle values near each other are alike; so are means few standard errors apart, which few rows allow to be far.
    """
    if not a or not b:
        return None

    def total(s: list[dict]) -> dict:
        k = {f: sum(x[f"n_{f}"] for x in s) for f in ("text", "whole", "fraction", "boolean")}
        nums = sorted(x["number"] for x in s if x["number"] is not None)
        days = sorted(x["day"] for x in s if x["day"] is not None)
        lows, highs = [x["lo"] for x in s if x["lo"] is not None], [x["hi"] for x in s if x["hi"] is not None]
        masks, leads = [x["mask"] for x in s if isinstance(x["mask"], str)], [x["lead"] for x in s if isinstance(x["lead"], str)]
        return k | {"number": nums[len(nums) // 2] if nums else None, "day": days[len(days) // 2] if days else None, "mask": max(set(masks), key=masks.count) if masks else "", "lead": max(set(leads), key=leads.count) if leads else "", "lo": min(lows, default=None), "hi": max(highs, default=None), "days": _moments([x["days"] for x in s]), "sizes": _moments([x["sizes"] for x in s])}

    alike = lambda z: max(0.0, 1 - z / 4)
    x, y = total(a), total(b)
    if x["day"] is not None and y["day"] is not None:
        return max(0.0, 1 - abs(x["day"] - y["day"]) / 30, alike(_apart(x["days"], y["days"], 3.0)) if min(x["days"][0], y["days"][0]) > 2 else 0.0)
    if (x["day"] is None) != (y["day"] is None):
        return 0.1
    main = lambda t: "boolean" if t["boolean"] else "number" if t["number"] is not None and t["whole"] + t["fraction"] + t["text"] and not re.search("[A-Za-z]", t["mask"]) else "text"
    if main(x) != main(y):
        return 0.1
    if main(x) == "boolean":
        return 0.6
    if main(x) == "number":
        p, q = x["number"], y["number"]
        whole = (x["fraction"] == 0) == (y["fraction"] == 0)
        near = 1.0 if p == q else 0.0 if p * q <= 0 else max(0.0, 1 - abs(math.log10(p / q)) / 0.7)
        spread = lambda t: math.log10(t["hi"] / t["lo"]) if t["lo"] > 0 else 9.0
        wide, narrow = sorted((x, y), key=spread, reverse=True)
        if wide["lo"] * 0.7 <= narrow["lo"] and narrow["hi"] <= wide["hi"] * 1.4 and p * q > 0:
            near = max(near, 0.75)
        if min(x["sizes"][0], y["sizes"][0]) > 2 and p * q > 0:
            near = max(near, min(0.65, alike(_apart(x["sizes"], y["sizes"], 0.15))))
        if spread(narrow) < 0.01 < 0.2 < spread(wide) and sum(k["n_whole"] for k in (*a, *b)) > 4:
            near = 0.0  # a year beside a quantity
        return near * (1 if whole else 0.8)
    if x["mask"] == y["mask"] or x["lead"] == y["lead"] != "" and len(x["lead"]) >= 2:
        fixed = bool(re.search(r"\d", x["mask"]))
        same_lead = x["lead"] == y["lead"]
        return 1.0 if fixed and same_lead and x["lead"] else 0.85 if x["mask"] == y["mask"] and fixed else 0.7
    return 0.2


def follow_table(months: dict[str, dict[str, str | None]], history: Callable[[str], list[dict]], proven: frozenset = frozenset()) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """Changes (period, kind, before, after), columns (period, name, logical column, known family) of one table's months in order, and the meetings (name that went, name that came, whether taken as one).

    months: period to column to declared family; history: the statistics of a column's files, each seen from its month. Removed and added columns
    of one month are matched best first; a pair of names in ``proven`` needs no further proof.
    """
    changes, placed, met = [], [], []
    before: dict[str, int] = {}
    family: dict[int, str | None] = {}
    last_name: dict[int, str] = {}
    by_name: dict[str, int] = {}
    n = 0
    for k, p in enumerate(sorted(months)):
        now = months[p]
        ids: dict[str, int] = {c: before[c] for c in now if c in before}
        if k:
            gone, come = [c for c in before if c not in now], [c for c in now if c not in before]
            scored = []
            for a in gone:
                for b in come:
                    fa, fb = family[before[a]], now[b]
                    d = data_likeness(history(a), history(b))
                    m = name_likeness(a, b)
                    same = fa is None or fb is None or fa == fb
                    if d is None:
                        score = m if same else 0.6 * m
                        ok = m >= 0.6 and same
                    else:
                        score = d + m + (0.15 if same else 0)
                        ok = (d >= 0.5 and m >= 0.3) or d >= (0.7 if same else 0.85) or (m >= 0.7 and d >= 0.1 and same)
                        if d == 0.6 and m < 0.3:  # truth values say nothing by themselves
                            ok = False
                    if (a, b) in proven and (same or d is not None and d > 0.1):
                        ok, score = True, score + 0.5
                    if ok:
                        scored.append((-score, a, b))
            pair: dict[str, str] = {}
            for _, a, b in sorted(scored):
                if a not in pair and b not in pair.values():
                    pair[a] = b
            met += [(a, b, pair.get(a) == b) for a in gone for b in come]
            for a, b in pair.items():
                ids[b] = before[a]
                changes.append((p, "renamed", a, b))
                if family[before[a]] and now[b] and family[before[a]] != now[b]:
                    changes.append((p, "retyped", a, b))
            changes += [(p, "removed", a, "") for a in gone if a not in pair]
            changes += [(p, "added", "", b) for b in come if b not in pair.values()]
            changes += [(p, "retyped", c, c) for c in now if c in before and now[c] and family[before[c]] and now[c] != family[before[c]]]
        for c in now:
            if c not in ids:
                if c in by_name and by_name[c] not in ids.values():
                    ids[c] = by_name[c]  # a column that comes back
                else:
                    ids[c], n = n, n + 1
            i = ids[c]
            family[i] = now[c] or family.get(i)
            last_name[i] = c
            by_name[c] = i
            placed.append((p, c, i))
        before = {c: ids[c] for c in now}
    return changes, [(p, c, last_name[i], family[i]) for p, c, i in placed], met


def _follow(cols: pd.DataFrame, stats: pd.DataFrame) -> pd.DataFrame:
    """follow_table for each table of a bucket; rows without a container are proven pairs of names."""
    tables: dict[tuple, dict[str, dict[str, str | None]]] = {}
    given = cols["container_id"].isna()
    proven = frozenset(zip(cols["column_name"][given], cols["family"][given]))
    cols = cols[~given].sort_values(["container_id", "table_name", "period_key", "position"], kind="stable")
    for c, t, p, name, f in zip(cols["container_id"], cols["table_name"], cols["period_key"], cols["column_name"], cols["family"]):
        tables.setdefault((c, t), {}).setdefault(p, {})[name] = f if isinstance(f, str) else None
    where: dict[tuple, list[int]] = {}
    for i, key in enumerate(zip(stats["container_id"], stats["table_name"], stats["path"])):
        where.setdefault(key, []).append(i)
    period, file = stats["period_key"].to_numpy(), stats["file_id"].to_numpy()
    values = {c: stats[c].to_numpy() for c, _ in STATS}
    rows = []
    for key, months in tables.items():

        @lru_cache(maxsize=None)  # of the few columns that went or came
        def history(column: str, key=key) -> list[dict]:
            at = sorted(where.get((*key, column), ()), key=lambda i: (period[i], file[i]))
            return [in_month({c: v[i] for c, v in values.items()}, period[i]) for i in at]

        changes, placed, met = follow_table(months, history, proven)
        rows += [(*key, "met", None, "same" if same else "other", a, b, None, None) for a, b, same in met]
        rows += [(*key, "change", *c, None, None) for c in changes] + [(*key, "column", p, None, None, c, logical, f) for p, c, logical, f in placed]
    return pd.DataFrame(rows, columns=["container_id", "table_name", "row_kind", "period_key", "change_kind", "column_before", "column_after", "logical_column", "family"])


def proven_pairs(met: DataFrame, min_tables: int = 3, min_share: float = 0.6) -> DataFrame:
    """a, b: names of which the one's values went on under the other in at least min_tables tables and min_share of the tables where the one went as the other came. Both ways of a pair count together."""
    pair = met.select("container_id", "table_name", F.least("column_before", "column_after").alias("a"), F.greatest("column_before", "column_after").alias("b"), (F.col("change_kind") == "same").cast("int").alias("same"))
    per_table = pair.groupBy("a", "b", "container_id", "table_name").agg(F.max("same").alias("same"))
    kept = per_table.groupBy("a", "b").agg(F.sum("same").alias("n"), F.count(F.lit(1)).alias("of")).where((F.col("n") >= min_tables) & (F.col("n") >= min_share * F.col("of")))
    return kept.select("a", "b").unionByName(kept.select(F.col("b").alias("a"), F.col("a").alias("b")))


def follow(files: DataFrame, metadata: DataFrame, rows: DataFrame, bucket_files: int = 2000) -> DataFrame:
    """Changes and column places of all tables. Tables are hashed into buckets of about ``bucket_files`` files; a table has one row per month and column and one per file and path there, whatever its rows.

    The second pass goes over the tables only in which a proven pair of names met without being taken as one.
    """
    n = max(files.sparkSession.sparkContext.defaultParallelism, -(-files.count() // bucket_files))
    bucket = F.pmod(F.xxhash64("container_id", "table_name"), F.lit(n)).alias("bucket")
    table = ["container_id", "table_name"]
    cols = durable(monthly_columns(files, metadata).where("container_id is not null").select(bucket, *table, "period_key", "column_name", "position", "family"))
    stats = durable(path_statistics(rows).join(named_files(files).where("container_id is not null"), "file_id").select(bucket, *table, "period_key", "file_id", "path", *[c for c, _ in STATS]))
    schema = "container_id string, table_name string, " + OUT
    first = durable(cols.groupBy("bucket").cogroup(stats.groupBy("bucket")).applyInPandas(_follow, schema))
    met = first.where("row_kind = 'met'")
    pairs = proven_pairs(met)
    open_ = durable(met.where("change_kind = 'other'").join(pairs, (F.col("column_before") == F.col("a")) & (F.col("column_after") == F.col("b")), "left_semi").select(*table, "column_before", "column_after").distinct())
    tables = open_.select(*table).distinct()
    given = open_.select(bucket, F.col("column_before").alias("column_name"), F.col("column_after").alias("family")).distinct()
    none = {c: F.lit(None).cast(dict(cols.dtypes)[c]) for c in (*table, "period_key", "position")}
    again = cols.join(tables, table, "left_semi").unionByName(given.withColumns(none)).groupBy("bucket").cogroup(stats.join(tables, table, "left_semi").groupBy("bucket")).applyInPandas(_follow, schema)
    return first.join(tables, table, "left_anti").unionByName(again).where("row_kind <> 'met'")


def changes_of(followed: DataFrame) -> DataFrame:
    return followed.where("row_kind = 'change'").select("container_id", "table_name", "period_key", "change_kind", "column_before", "column_after").distinct()


def columns_of(followed: DataFrame) -> DataFrame:
    """container_id, table_name, period_key, column_name, logical_column, family: where each month's column goes."""
    return followed.where("row_kind = 'column'").select("container_id", "table_name", "period_key", F.col("column_after").alias("column_name"), "logical_column", "family")


TYPED = "family string, text string, whole bigint, fraction double, date date, truth boolean"
TRUE_WORDS, FALSE_WORDS = ("true", "t", "yes", "y", "1", "x"), ("false", "f", "no", "n", "0")
_DATES = ((re.compile(r"(\d{4})[-/](\d{2})[-/](\d{2})"), "ymd"), (re.compile(r"(\d{2})[./](\d{2})[./](\d{4})"), "dmy"), (re.compile(r"((?:19|20)\d{2})([01]\d)([0-3]\d)\Z"), "ymd"))
_MONTH_NAME = re.compile(r"(\d{2})-([A-Za-z]{3})-(\d{4})")
_MONTHS = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}


def read_number(value: str) -> float | None:
    """As ``number_value``."""
    plain = re.sub(r"[\s\u00a0'$€£%]", "", value)
    plain = plain.replace(".", "").replace(",", ".") if re.fullmatch(r"[+-]?[\d.]*,\d{1,2}", plain) else plain.replace(",", "")
    return float(plain) if re.fullmatch(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?", plain) else None


def read_date(value: str, serial: bool = True) -> dt.date | None:
    """As ``date_value``; and, where asked for, a spreadsheet's serial."""
    value = value.strip()
    try:
        for rx, order in _DATES:
            if m := rx.match(value):
                y, mo, d = m.groups() if order == "ymd" else m.groups()[::-1]
                return dt.date(int(y), int(mo), int(d))
        if (m := _MONTH_NAME.match(value)) and m[2].lower() in _MONTHS:
            return dt.date(int(m[3]), _MONTHS[m[2].lower()], int(m[1]))
    except ValueError:
        return None
    if serial and re.fullmatch(r"\d{4,5}(?:\.0+)?", value) and policy.SERIAL_MIN <= float(value) <= policy.SERIAL_MAX:
        return EPOCH + dt.timedelta(days=SERIAL_ZERO + int(float(value)))
    return None


@lru_cache(maxsize=100_000)
def typed_value(value: str | None, family: str | None) -> tuple[object, bool]:
    """The value in a family's type, and whether it could not be cast; a blank text is no value of any type but text."""
    if value is None or family in (None, "text"):
        return value, False
    if not value.strip():
        return None, False
    if family == "date":
        out: object = read_date(value)
    elif family == "boolean":
        low = value.strip().lower()
        out = True if low in TRUE_WORDS else False if low in FALSE_WORDS else None
    else:
        number = read_number(value)
        out = number if family == "fraction" or number is None else int(number) if number == int(number) and abs(number) < 2**63 else None
    return out, out is None


SLOTS = {"text": 1, "whole": 2, "fraction": 3, "date": 4, "boolean": 5}


@lru_cache(maxsize=10_000)
def _places(text: str | None) -> dict[str, tuple[str, str | None]]:
    return {x["column_name"]: (x["logical_column"], x.get("family")) for x in json.loads(text or "[]")}


def project_record(record: str | None, places: str | None) -> tuple[dict[str, tuple], list[str]] | None:
    """Logical column to its typed value (family, text, whole, fraction, date, truth), and the columns whose value could not be cast. Of two paths that go to one column the lesser value with a type counts."""
    leaves = leaves_of(record)
    if leaves is None:
        return None
    where = _places(places)
    fields: dict[str, tuple] = {}
    failed: set[str] = set()
    for path, kind, value in sorted(leaves, key=lambda x: (x[0], x[2] or "")):
        name, family = where.get(path, (path, None))
        out, bad = typed_value(value, family) if kind != "null" else (None, False)
        if bad:
            failed.add(name)
        if out is None and name in fields:
            continue
        if name not in fields or all(v is None for v in fields[name][1:]):
            cell: list = [family or "text", None, None, None, None, None]
            cell[SLOTS[family or "text"]] = out
            fields[name] = tuple(cell)
    return dict(sorted(fields.items())), sorted(failed)


def unify(files: DataFrame, rows: DataFrame, followed: DataFrame) -> DataFrame:
    """One row per record: container_id, table_name, period_key, file_id, row_no, fields (logical column to its value in the column's final type), failed (logical columns whose value could not be cast).

    A month's places are one text a file, joined to the records, which are then projected each by itself: they are shuffled for their repeats and for this join only.
    """
    list_ = F.to_json(F.array_sort(F.collect_list(F.struct("column_name", "logical_column", "family"))))
    places = columns_of(followed).groupBy("container_id", "table_name", "period_key").agg(list_.alias("places"))  # a month's columns
    of_file = named_files(files).join(places, ["container_id", "table_name", "period_key"], "left")
    joined = rows.where("file_id is not null and record is not null").select("file_id", "row_no", "record").distinct().join(of_file, "file_id")
    fields = pa.map_(pa.string(), pa.struct([("family", pa.string()), ("text", pa.string()), ("whole", pa.int64()), ("fraction", pa.float64()), ("date", pa.date32()), ("truth", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            back, cells, sizes, failed = [], [], [0], []
            for i, (record, where) in enumerate(zip(batch.column(5).to_pylist(), batch.column(6).to_pylist())):
                got = project_record(record, where)
                if got is not None:
                    back.append(i)
                    cells += got[0].items()
                    sizes.append(len(cells))
                    failed.append(got[1])
            kept = pa.array(back, pa.int64())
            parts = pa.StructArray.from_arrays([pa.array([c[1][k] for c in cells], f.type) for k, f in enumerate(fields.item_type)], fields=list(fields.item_type))
            maps = pa.MapArray.from_arrays(pa.array(sizes, pa.int32()), pa.array([c[0] for c in cells], pa.string()), parts)
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(kept) for k in range(5)), maps, pa.array(failed, pa.list_(pa.string()))], names=["container_id", "table_name", "period_key", "file_id", "row_no", "fields", "failed"])

    kind = dict(rows.dtypes)["row_no"]
    return joined.select("container_id", "table_name", "period_key", "file_id", "row_no", "record", "places").mapInArrow(run, f"container_id string, table_name string, period_key string, file_id string, row_no {kind}, fields map<string,struct<{', '.join(x.replace(' ', ':') for x in TYPED.split(', '))}>>, failed array<string>")


def observed_types(files: DataFrame, metadata: DataFrame, rows: DataFrame) -> DataFrame:
    """container_id, table_name, period_key, column_name, declared, observed, n_values: what a month's files say of a column's type and what the raw types of their values are.

    observed is the family of all values; whole and fractional numbers together are fraction, other mixtures are mixed. Text that reads as a date throughout is date.
    """
    count = lambda k: F.col(f"n_{k}")
    stats = path_statistics(rows).join(named_files(files), "file_id").groupBy("container_id", "table_name", "period_key", F.col("path").alias("column_name")).agg(*[F.sum(f"n_{k}").alias(f"n_{k}") for k in ("text", "whole", "fraction", "boolean")], F.sum("day0").alias("days"))
    n = count("text") + count("whole") + count("fraction") + count("boolean")
    observed = (
        F.when(n == 0, None).when((count("text") == n) & (F.col("days") == n), "date").when(count("text") == n, "text").when(count("boolean") == n, "boolean")
        .when(count("whole") == n, "whole").when(count("whole") + count("fraction") == n, "fraction").otherwise("mixed")
    )
    declared = monthly_columns(files, metadata).select("container_id", "table_name", "period_key", "column_name", F.col("family").alias("declared"))
    return stats.select("container_id", "table_name", "period_key", "column_name", observed.alias("observed"), n.alias("n_values")).join(declared, ["container_id", "table_name", "period_key", "column_name"], "left").select("container_id", "table_name", "period_key", "column_name", "declared", "observed", "n_values")


def table_columns(followed: DataFrame) -> DataFrame:
    """The final columns of each table: container_id, table_name, logical_column, family, first and last month."""
    return columns_of(followed).groupBy("container_id", "table_name", "logical_column").agg(F.max_by("family", "period_key").alias("family"), F.min("period_key").alias("first_period"), F.max("period_key").alias("last_period"))


def project_table(unified: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    """One logical table with typed columns, from its rows of ``unify`` and its (column, family) of ``table_columns``."""
    slots = {"whole": "whole", "fraction": "fraction", "date": "date", "boolean": "truth"}
    return unified.select("period_key", "file_id", "row_no", *[F.col("fields")[c][slots.get(f, "text")].alias(c) for c, f in columns], "failed")

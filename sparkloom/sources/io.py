"""Sources and sinks: text tables of unknown layout, logical tables of many files, parquet, CSV, JDBC, binary files, keyed upserts."""

from __future__ import annotations

import codecs
import csv
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sparkloom.operators.cleaning import clean_table, unique_names
from sparkloom.plans.guards import statement_class

DELIMITERS = (",", ";", "\t", "|", " ")
LINE_END = re.compile(r"\r\n|\r|\n")


def detect_encoding(head: bytes) -> str:
    """By byte-order mark, else the first of UTF-8 and Windows-1252 that reads the bytes."""
    for mark, name in ((b"\xef\xbb\xbf", "UTF-8"), (b"\xff\xfe", "UTF-16LE"), (b"\xfe\xff", "UTF-16BE")):
        if head.startswith(mark):
            return name
    try:
        codecs.getincrementaldecoder("utf-8")().decode(head)  # the last character may be cut
        return "UTF-8"
    except UnicodeDecodeError:
        return "windows-1252"


def detect_delimiter(text: str) -> str:
    """The mark whose count agrees over the most lines and is highest; blanks count little."""
    lines = [x for x in text.splitlines() if x.strip()][:60]
    best, score = ",", 0.0
    for d in DELIMITERS:
        counts = [len(next(csv.reader([x], delimiter=d), [])) - 1 for x in lines]
        counts = [c for c in counts if c > 0]
        if counts:
            mode = max(set(counts), key=lambda c: (counts.count(c), c))
            s = mode * counts.count(mode) / len(lines) * (0.4 if d == " " else 1.0)
            if s > score:
                best, score = d, s
    return best


def find_header(rows: list[list[str]]) -> int:
    """The row, of the first 15, that best looks like names: full, textual, not numeric, not long."""
    width = max((len(r) for r in rows), default=1)

    def score(r: list[str]) -> float:
        cells = [c.strip() for c in r if c.strip()]
        if not cells:
            return -9.0
        number = sum(bool(re.fullmatch(r"[-+$€]?[\d.,\s]+%?", c)) for c in cells) / len(cells)
        long = max(0.0, sum(map(len, cells)) / len(cells) - 30) / 50
        return len(cells) / width * (1 - number) - 0.5 * number - long

    return max(range(min(15, len(rows))), key=lambda i: (score(rows[i]), -i)) if rows else 0


def read_head(spark: SparkSession, path: str, n_bytes: int = 256 * 1024) -> bytes:
    """The first bytes of a file; of a folder or pattern those of its largest file. Only these bytes are read."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    found = list(fs.globStatus(at) or [])
    files = [f for s in found for f in ([s] if s.isFile() else list(fs.listStatus(s.getPath()))) if f.isFile() and not f.getPath().getName().startswith(("_", "."))]
    if not files:
        raise FileNotFoundError(path)
    largest = max(files, key=lambda f: (f.getLen(), f.getPath().toString()))
    stream = fs.open(largest.getPath())
    try:
        return bytes(stream.readNBytes(n_bytes))
    finally:
        stream.close()


def probe(spark: SparkSession, path: str, n_bytes: int = 256 * 1024) -> dict:
    """Encoding, delimiter, header line (counted from 0 over all lines, blank ones too) and names, from the head of the file."""
    head = read_head(spark, path, n_bytes)
    encoding = detect_encoding(head)
    text = head.decode(encoding, "replace").lstrip("\ufeff")
    d = detect_delimiter(text)
    rows = [next(csv.reader([x], delimiter=d), []) for x in LINE_END.split(text)[:40]]  # as the reader cuts them
    at = find_header(rows)
    return {"encoding": encoding, "delimiter": d, "header_row": at, "names": unique_names(rows[at]) if rows else []}


def _decoded(encoding: str) -> Column:
    """The text of a line read as raw bytes."""
    raw = F.col("value").cast("binary")
    if encoding == "UTF-8":
        return F.col("value")
    if encoding == "windows-1252":  # ISO 8859-1 but for the places 80 to 9F
        places = bytes(range(0x80, 0xA0))
        return F.translate(F.decode(raw, "ISO-8859-1"), places.decode("latin-1"), places.decode("cp1252", "replace"))
    return F.regexp_replace(F.decode(raw, encoding), "\r$", "")


def read_text_table(spark: SparkSession, path: str) -> DataFrame:
    """One delimited file as text columns: layout probed, the lines up to the header left out, broken rows kept in the columns they have.

    Lines go by their place in the file, never by what they hold: a row equal to a title or with empty cells stays. Blank lines are no rows.
    """
    p = probe(spark, path)
    schema = ", ".join(f"`{n}` string" for n in p["names"])
    reader = spark.read.option("encoding", p["encoding"])
    if p["encoding"].startswith("UTF-16"):
        reader = reader.option("lineSep", "\n")
    # a file's first block is the first of its partition, so there the row's number in the partition is its line
    lines = reader.text(path).select("value", F.col("_metadata.file_block_start").alias("_from"), F.expr("monotonically_increasing_id() & 8589934591").alias("_line"))
    line = _decoded(p["encoding"])
    rows = lines.where((F.col("_from") > 0) | (F.col("_line") > p["header_row"])).select(line.alias("value")).where("trim(value) <> ''")
    return rows.select(F.from_csv("value", F.lit(schema), {"sep": p["delimiter"], "mode": "PERMISSIVE"}).alias("r")).select("r.*")


def ingest_text(spark: SparkSession, path: str, target: str, dedup: bool = True) -> DataFrame:
    """A delimited file cleaned, typed and written as parquet; returns the written table."""
    return write_parquet(clean_table(read_text_table(spark, path), dedup), target)


def read_logical_table(spark: SparkSession, paths: list[str], required: set[str] | None = None) -> DataFrame:
    """Parquet files of one logical table as one table by column name; missing columns are null, ``source_file`` says where a row is from."""
    parts = [spark.read.parquet(p).withColumn("source_file", F.lit(p)) for p in paths]
    if required is not None:
        parts = [p for p in parts if {c.lower() for c in p.columns} >= {c.lower() for c in required}]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def schema_groups(columns: dict[str, list[str]]) -> dict[frozenset[str], list[str]]:
    """Files by their set of column names without regard to case; the largest group first."""
    out: dict[frozenset[str], list[str]] = {}
    for path, names in columns.items():
        out.setdefault(frozenset(n.lower() for n in names), []).append(path)
    return dict(sorted(out.items(), key=lambda kv: (-len(kv[1]), sorted(kv[1]))))


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    w = df.write.mode("overwrite").option("compression", "zstd")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    return df.sparkSession.read.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header and quoted text, as many files as the table has partitions."""
    df.write.mode("overwrite").option("header", "true").option("quoteAll", "true").csv(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new, and of old whose key new does not have. Of rows of new with one key one stays."""
    one = new.dropDuplicates(keys)
    return old.join(one.select(*keys), keys, "left_anti").unionByName(one, allowMissingColumns=True)


def sync_listing(listed: DataFrame, known: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows to add, rows to drop) between a listing and what is known."""
    return listed.join(known.select(key), key, "left_anti"), known.join(listed.select(key), key, "left_anti")


def read_jdbc(spark: SparkSession, url: str, sql: str, cap: int | None = None, **options: str) -> DataFrame:
    """A single read-only SELECT sent to a database."""
    if statement_class(spark, sql) != "query":
        raise ValueError("only a single SELECT may be sent")
    df = spark.read.format("jdbc").options(url=url, query=sql, **options).load()
    return df.limit(cap) if cap else df


def describe_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, column_name, kind of each column of the tables; a database's are read by ``read_jdbc`` from its information schema."""
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame([(t, f.name, f.dataType.simpleString()) for t, df in tables.items() for f in df.schema.fields], "table_name string, column_name string, kind string")


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """path, content, sha256 of each file: the source of document parsers."""
    return spark.read.format("binaryFile").load(path).select("path", "content", F.sha2("content", 256).alias("sha256"))


def parse_analysis(results: DataFrame, column: str = "result") -> DataFrame:
    """doc_id, page_num, element_no, element_type, content, confidence from JSON page analyses: a paragraph has its words' mean, a table its cells' least confidence."""
    schema = "struct<pages:array<struct<pageNumber:int,words:array<struct<content:string,confidence:double>>>>,paragraphs:array<struct<content:string,pageNumber:int>>,tables:array<struct<pageNumber:int,cells:array<struct<rowIndex:int,columnIndex:int,content:string,confidence:double>>>>>"
    r = results.select("doc_id", F.from_json(column, schema).alias("r"))
    words = r.select("doc_id", F.explode("r.pages").alias("p")).select("doc_id", F.col("p.pageNumber").alias("page_num"), F.aggregate("p.words", F.lit(0.0), lambda s, x: s + F.coalesce(x["confidence"], F.lit(1.0))).alias("s"), F.size("p.words").alias("n")).groupBy("doc_id", "page_num").agg(F.try_divide(F.sum("s"), F.sum("n")).alias("confidence"))
    paragraphs = r.select("doc_id", F.posexplode("r.paragraphs").alias("element_no", "p")).select("doc_id", F.col("p.pageNumber").alias("page_num"), F.col("element_no").cast("long").alias("element_no"), F.lit("text").alias("element_type"), F.col("p.content").alias("content")).join(words, ["doc_id", "page_num"], "left")
    tables = r.select("doc_id", F.posexplode("r.tables").alias("element_no", "t"))
    lines = F.array_join(F.transform(F.array_distinct(F.transform("t.cells", lambda c: c["rowIndex"])), lambda i: F.concat(F.lit("| "), F.array_join(F.transform(F.array_sort(F.transform(F.filter("t.cells", lambda c: c["rowIndex"] == i), lambda c: F.struct(c["columnIndex"].alias("k"), F.coalesce(c["content"], F.lit("")).alias("v")))), lambda c: c["v"]), " | "), F.lit(" |"))), "\n")
    cells = tables.select("doc_id", F.col("t.pageNumber").alias("page_num"), F.col("element_no").cast("long").alias("element_no"), F.lit("table").alias("element_type"), lines.alias("content"), F.array_min(F.transform("t.cells", lambda c: F.coalesce(c["confidence"], F.lit(1.0)))).alias("confidence"))
    return paragraphs.select(*cells.columns).unionByName(cells)

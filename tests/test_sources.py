import pytest

from sparkloom.operators import cleaning
from sparkloom.sources import io


def test_delimiter_and_header():
    assert io.detect_delimiter("a,b,c\n1,2,3\n4,5,6") == "," and io.detect_delimiter("a|b\n1|2\n3|4") == "|" and io.detect_delimiter('a;b\n"x;y";2\n1;3') == ";"
    assert io.find_header([["Stock list", "", ""], ["", "", ""], ["depot", "pallets", "weight"], ["a", "1", "2.0"]]) == 2
    assert io.detect_encoding("äöü,1".encode("cp1252") * 10) == "windows-1252" and io.detect_encoding("äöü".encode() * 10) == "UTF-8"
    assert cleaning.unique_names(["amount", "amount", "Amount", "", "x"]) == ["amount", "amount_1", "Amount_2", "column_4", "x"]


def test_ingest(spark, tmp_path):
    f = tmp_path / "r_2024_01.csv"
    f.write_text('Sales report,,\nproduct,amount,active,posting date\n"A ,1","$1,234.50",yes,2024-01-05\nB,N/A,no,2024-02-06\nB,N/A,no,2024-02-06\nTotal,99,,\n---,---,,\n,,,\n')
    out = io.ingest_text(spark, str(f), str(tmp_path / "out"))
    assert dict(out.dtypes) == {"product": "string", "amount": "double", "active": "boolean", "posting date": "date"}
    assert sorted((r.product, r.amount, r.active) for r in out.collect()) == [("A ,1", 1234.5, True), ("B", None, False)]


def test_logical_table_upsert_and_sync(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "x")], "id int, v string"), spark.createDataFrame([(2, 5.0)], "id int, w double")
    io.write_parquet(a, str(tmp_path / "a"))
    io.write_parquet(b, str(tmp_path / "b"))
    got = io.read_logical_table(spark, [str(tmp_path / "a"), str(tmp_path / "b")])
    assert sorted((r.id, r.v, r.w) for r in got.collect()) == [(1, "x", None), (2, None, 5.0)]
    new = spark.createDataFrame([(1, "y"), (3, "z")], "id int, v string")
    assert sorted(map(tuple, io.upsert(a, new, ["id"]).collect())) == [(1, "y"), (3, "z")]
    add, drop = io.sync_listing(new, a, "id")
    assert [r.id for r in add.collect()] == [3] and drop.count() == 0
    assert io.schema_groups({"p": ["A", "b"], "q": ["B", "a"], "r": ["x"]})[frozenset({"a", "b"})] == ["p", "q"]
    io.write_csv(new, str(tmp_path / "csv"))
    assert io.read_binary(spark, str(tmp_path / "csv" / "*.csv")).count() >= 1
    with pytest.raises(ValueError):
        io.read_jdbc(spark, "jdbc:x", "DELETE FROM t")


def test_page_analysis(spark):
    j = '{"pages":[{"pageNumber":1,"words":[{"content":"a","confidence":0.8},{"content":"b","confidence":0.6}]}],"paragraphs":[{"content":"a b","pageNumber":1}],"tables":[{"pageNumber":1,"cells":[{"rowIndex":0,"columnIndex":1,"content":"y","confidence":0.5},{"rowIndex":0,"columnIndex":0,"content":"x","confidence":0.9},{"rowIndex":1,"columnIndex":0,"content":"1","confidence":0.9}]}]}'
    got = {r.element_type: (r.content, round(r.confidence, 3)) for r in io.parse_analysis(spark.createDataFrame([("d", j), ("e", None), ("f", "{bad")], "doc_id string, result string")).collect()}
    assert got == {"text": ("a b", 0.7), "table": ("| x | y |\n| 1 |", 0.5)}


def test_lines_above_the_header_go_by_place(spark, tmp_path):
    f = tmp_path / "stock.csv"
    f.write_text("Stock list;;\n\ndepot;pallets;weight\n;4;1.5\nStock list;;\n;;\ndepot;pallets;weight\n\nnorth;7;2,5\n")
    p = io.probe(spark, str(f))
    assert (p["header_row"], p["delimiter"], p["names"]) == (2, ";", ["depot", "pallets", "weight"])
    got = [tuple(r) for r in io.read_text_table(spark, str(f)).collect()]
    assert got == [(None, "4", "1.5"), ("Stock list", None, None), (None, None, None), ("depot", "pallets", "weight"), ("north", "7", "2,5")]


def test_many_blocks_and_encodings(spark, tmp_path):
    body = [f"d{i};{i};Gr\u00f6\u00dfe \u20ac {i}" for i in range(4000)]
    for name, encoding in (("w.csv", "cp1252"), ("u.csv", "utf-8-sig"), ("v.csv", "utf-16")):
        (tmp_path / name).write_bytes(("title\r\n\r\ndepot;pallets;note\r\n" + "\r\n".join(body)).encode(encoding))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        for name in ("w.csv", "u.csv", "v.csv"):
            df = io.read_text_table(spark, str(tmp_path / name))
            got = sorted((int(r.pallets), r.depot, r.note) for r in df.collect())
            assert df.columns == ["depot", "pallets", "note"] and got == [(i, f"d{i}", f"Gr\u00f6\u00dfe \u20ac {i}") for i in range(4000)], name
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_the_head_alone_is_read(spark, tmp_path):
    f = tmp_path / "long.csv"
    f.write_text("a,b\n" + "1,2\n" * 50_000)
    assert io.read_head(spark, str(f), 7) == b"a,b\n1,2"

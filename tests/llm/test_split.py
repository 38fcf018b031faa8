import datetime as dt

from hypothesis import given, settings, strategies as st

from sparkloom.llm import split

T = dt.datetime(2024, 1, 1)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["Word ", "A sentence ends. ", "\n", "\n\n", "1. Head\n", "1.2 Sub\n", "## Mark\n", "- item\n", "  - inner item\n", "| a | b |\n", "x" * 70, "é", ", "]), max_size=120), st.sampled_from([(60, 15), (100, 20), (40, 0)]))
def test_round_trip(parts, sizes):
    text, (limit, overlap) = "".join(parts), sizes
    pieces = split.split_text(text, limit, overlap)
    assert "".join(text[a + o : b] for a, b, o in pieces) == text
    assert all(b - a <= limit and 0 <= o <= overlap for a, b, o in pieces)
    if len(text) <= limit:
        assert len(pieces) == 1


def test_natural_ends():
    text = "1. First part\n" + "One sentence of some length is here. " * 30 + "\n\n2. Second part\n" + "Another sentence follows after it. " * 30
    pieces = split.split_text(text, 500, 80)
    assert all(text[:b].rstrip()[-1] in ".\n" or b == len(text) for _, b, _ in pieces)
    assert any(text[a + o :].startswith("2. Second part") for a, b, o in pieces)
    assert all(o > 0 for a, b, o in pieces[1:])


def test_spark(spark):
    a, b = "A sentence here. " * 20, "B sentence there. " * 20
    text = a + "\n" + b
    rows = [("s1", text, ["c1", "c2"], (1, 2), T, "clash"), ("s1", text, ["c1", "c2"], (1, 2), T, "clash"), ("s2", "short", ["c9"], (4, 4), T, ""), ("s3", None, None, None, T, ""), ("s4", text, ["c1", "gone"], (3, 9), T, ""), ("s5", "", [], None, T, ""), ("s6", text, None, None, T, None)]
    sections = spark.createDataFrame(rows, "section_id string, text string, chunk_ids array<string>, page_span struct<page_start:int,page_end:int>, ingested_at timestamp, key string")
    chunks = spark.createDataFrame([("c1", len(a), 1, "x"), ("c1", len(a), 1, "x"), ("c2", len(b), 2, "x"), (None, 1, 1, "x")], "chunk_id string, n_chars long, page_num int, section_id string")
    out = split.split_sections(sections, chunks, limit=400, overlap=50)
    got = out.collect()
    by = {k: sorted((r for r in got if r.section_id == k), key=lambda r: r.piece_no) for k in {r.section_id for r in got}}
    assert set(by) == {"s1", "s2", "s4", "s5", "s6"} and len(by["s2"]) == 1 == len(by["s5"])
    assert "".join(r.piece_text[r.overlap :] for r in by["s1"]) == text
    assert by["s1"][0].chunk_ids == ["c1"] and by["s1"][0].page_span == (1, 1) and by["s1"][-1].chunk_ids == ["c2"] and by["s1"][-1].page_span == (2, 2)
    assert all(r.chunk_ids == ["c1", "gone"] and r.page_span == (3, 9) for r in by["s4"])
    assert {r.section_id for r in split.found(out).collect()} == {"s1", "s4", "s6"}
    assert split.split_sections(sections.where("false"), chunks).count() == 0


def test_ranks_of_headings_and_lists():
    body = "One sentence of some length is here. " * 6
    text = "".join(f"{h} Part\n{body}\n\n" for h in ("1.", "1.1", "1.2", "2.", "2.1", "2.2"))
    pieces = split.split_text(text, 800, 0)
    assert [text[a:].split(" ")[0] for a, _, _ in pieces] == ["1.", "2."]  # whole top sections, though four parts would fit
    marks = "".join(f"{h} Part\n{body}\n\n" for h in ("#", "##", "##", "#", "##"))
    assert [text_[:3] for text_ in (marks[a:] for a, _, _ in split.split_text(marks, 800, 0))] == ["# P", "# P"]
    items = "".join(f"- outer {i} {'word ' * 8}\n" + "".join(f"  - inner {j} {'word ' * 8}\n" for j in range(3)) for i in range(4))
    assert all(items[a:].startswith("- outer") for a, _, _ in split.split_text(items, 500, 0))

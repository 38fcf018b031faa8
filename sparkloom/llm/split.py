"""Splitting oversized texts at natural boundaries.

Method: structure-tree packing. The text is read as a tree: headings of six ranks (by their marks or the parts of their numbers,
plain ones below those) over blocks (blank lines), over lines that end a thought (table rows, list items, ended sentences; items of
inner lists below those of outer ones), over sentences, over wrapped lines and clauses, over words. Sibling subtrees are
merged bottom-up to the limit; only an oversized node is descended into. A word longer than the limit is cut where it must be,
never before a combining mark. The next piece begins up to ``overlap`` characters earlier, at a sentence if one starts there,
else at a word. Pieces, without their overlaps, give back the text exactly.

Defined results. A text at most ``limit`` long, empty or not, is one piece; a null text is none. Of repeated rows of a key the
newest counts. Lengths are code points. Where the chunks' lengths do not add up to the text, or a chunk is missing, each
piece carries all chunk ids and the whole page span. Extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

HEADING = re.compile(r"(?:#{1,6} .*|(?:\d+(?:\.\d+)*[.)]\s+)?[^\W\d_][^.!?;:|\n]{0,78})\Z")
LIST = re.compile(r"\s*(?:[-*•–]\s|\d+[.)]\s|[a-z]\)\s|\|)")
ENDED = re.compile(r"[.!?…:;|][\"'»”’)\]]*\s*\Z")
SENTENCE = re.compile(r"[.!?…]+[\"'»”’)\]]*\s+(?=[^\W_])")
CLAUSE = re.compile(r"[,;:–—]\s+")
SPACE = re.compile(r"\s+")
TOP, HEAD, BLOCK, LINE, SENT, WRAP, WORD_END = 13, 8, 7, 6, 3, 2, 1  # headings take HEAD to TOP, items of inner lists the two below LINE
RANK = re.compile(r"(#{1,6}) |(\d+(?:\.\d+)*)[.)]?\s")
SCHEMA = "key string, piece_no long, piece_start long, piece_end long, overlap long, piece_text string, chunk_ids array<string>, page_span struct<page_start:int,page_end:int>"


def boundaries(text: str) -> tuple[list[int], list[int]]:
    """Positions where a piece may begin, and how strong a boundary each is."""
    strength: dict[int, int] = {}
    for rx, level in ((SPACE, WORD_END), (CLAUSE, WRAP), (SENTENCE, SENT)):
        for m in rx.finditer(text):
            strength[m.end()] = level
    lines = text.split("\n")
    at, before, blank = 0, "", False
    glued: list[tuple[int, int]] = []
    marked = any(RANK.match(x.strip()) and HEADING.match(x.strip()) for x in lines)

    def rank(head: str) -> int:
        m = RANK.match(head)
        return TOP - min(5, (len(m[1]) - 1 if m[1] else m[2].count(".")) if m else 5 if marked else 0)

    indents = sorted({len(x) - len(x.lstrip()) for x in lines if LIST.match(x) and not x.lstrip().startswith("|")})
    inner = lambda x: min(2, bisect_left(indents, len(x) - len(x.lstrip()))) if LIST.match(x) and not x.lstrip().startswith("|") else 0
    for i, line in enumerate(lines):
        if i and line.strip():
            heading = len(line) <= 80 and len(line.split()) <= 9 and HEADING.match(line.strip()) and (blank or ENDED.search(before) or not before) and line.strip()[:1].upper() == line.strip()[:1]
            level = rank(line.strip()) if heading else BLOCK if blank else WRAP if line.lstrip()[:1].islower() and not LIST.match(line) else LINE - inner(line) if ENDED.search(before) or LIST.match(line) or LIST.match(before) or len(before.split()) <= 3 else WRAP
            strength[at] = max(level, strength.get(at, 0))
            if heading and i + 1 < len(lines):
                glued.append((at, at + len(line) + 1))
        elif not i and re.match(r"(?:#|\d+[.)]\s)", line) and HEADING.match(line.strip()) and len(lines) > 1:
            glued.append((-1, len(line) + 1))
        elif i:
            strength.pop(at, None)
        blank = not line.strip()
        if not blank:
            before = line
        at += len(line) + 1
    for a, b in glued:  # a heading stays with what it heads
        for k in [k for k in range(a + 1, b + 1) if k in strength]:
            strength[k] = WORD_END
    strength.pop(len(text), None)
    strength.pop(0, None)
    keys = sorted(strength)
    return keys, [strength[k] for k in keys]


def hard_cuts(text: str, a: int, b: int, room: int) -> list[tuple[int, int]]:
    out = []
    while b - a > room:
        cut = a + room
        # separators and changes from figures to letters are the last natural places inside a word
        cut = next((k for k in range(cut, a + room // 2, -1) if text[k - 1] in ";|,/_" or (text[k - 1].isdigit() and text[k].isalpha())), cut)
        while cut > a + 1 and (unicodedata.combining(text[cut]) or text[cut] in "‍️"):
            cut -= 1
        if cut <= a + 1:
            cut = a + room
        out.append((a, cut))
        a = cut
    return [*out, (a, b)]


def pack(text: str, room: int) -> list[tuple[int, int]]:
    """Spans that tile the text, each at most room long."""
    keys, levels = boundaries(text)
    by_level = {lv: [k for k, s in zip(keys, levels) if s >= lv] for lv in range(WORD_END, TOP + 1)}

    def merge(parts: list[list[tuple[int, int]]], level: int) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        open_ = False  # whether the last span may take up its next sibling
        for spans in parts:
            whole = len(spans) == 1 or level < HEAD  # the pieces of an oversized section keep to themselves
            for j, (a, b) in enumerate(spans):
                if whole and open_ and b - out[-1][0] <= room:
                    out[-1] = (out[-1][0], b)
                else:
                    out.append((a, b))
                open_ = whole
        return out

    def node(a: int, b: int, level: int) -> list[tuple[int, int]]:
        if b - a <= room:
            return [(a, b)]
        if level < WORD_END:
            return hard_cuts(text, a, b, room)
        ks = by_level[level]
        cuts = [a, *ks[bisect_left(ks, a + 1) : bisect_left(ks, b)], b]
        return merge([node(x, y, level - 1) for x, y in zip(cuts, cuts[1:])], level)

    return node(0, len(text), TOP)


def overlap_start(text: str, keys: list[int], levels: list[int], start: int, floor: int, overlap: int) -> int:
    """Where a piece that begins at start takes up the piece before: the earliest sentence, else word, within overlap."""
    low = max(floor, start - overlap)
    i, j = bisect_left(keys, low), bisect_left(keys, start)
    for level in (SENT, WORD_END):
        for k in range(i, j):
            if levels[k] >= level:
                return keys[k]
    return start if start in keys[j : j + 1] else low


def split_text(text: str, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, end, overlap) of each piece; text[start:end] is at most limit long and starts with overlap characters of the piece before."""
    if len(text) <= limit:
        return [(0, len(text), 0)]
    keys, levels = boundaries(text)
    out, before = [], 0
    for a, b in pack(text, limit - overlap):
        s = overlap_start(text, keys, levels, a, before, overlap) if a else 0
        out.append((s, b, a - s))
        before = a
    return out


def pieces_of(text: str, ids: list[str], sizes: list[int | None], pages: list[int | None], whole: tuple, limit: int, overlap: int) -> list[tuple]:
    known = len(ids) > 0 and all(n is not None for n in sizes) and sum(sizes) + len(sizes) - 1 == len(text)
    starts, at = [], 0
    for n in sizes if known else ():
        starts.append(at)
        at += n + 1
    out = []
    for no, (a, b, o) in enumerate(split_text(text, limit, overlap)):
        if known:
            held = [i for i, (s, n) in enumerate(zip(starts, sizes)) if s < b and s + max(n, 1) > a]
            own = [pages[i] for i in held if pages[i] is not None]
            span = (min(own), max(own)) if own else whole
            out.append((no, a, b, o, text[a:b], [ids[i] for i in held], span))
        else:
            out.append((no, a, b, o, text[a:b], list(ids), whole))
    return out


def split_sections(sections: DataFrame, chunks: DataFrame, limit: int = 3000, overlap: int = 200) -> DataFrame:
    """One row per piece of each section: section_id, piece_no, piece_start, piece_end, overlap, piece_text, chunk_ids, page_span."""
    if not 0 <= 2 * overlap < limit:
        raise ValueError("overlap must be under half of limit")
    newest = sections.where("section_id is not null").groupBy("section_id").agg(F.max(F.struct("ingested_at", "text", "chunk_ids", F.struct(F.col("page_span.page_start").alias("page_start"), F.col("page_span.page_end").alias("page_end")).alias("page_span"))).alias("r")).select(F.col("section_id").alias("key"), "r.text", F.coalesce("r.chunk_ids", F.array().cast("array<string>")).alias("chunk_ids"), "r.page_span").where("text is not null")
    size = F.length("text")
    short = newest.where(size <= limit).select("key", F.lit(0).cast("long").alias("piece_no"), F.lit(0).cast("long").alias("piece_start"), size.cast("long").alias("piece_end"), F.lit(0).cast("long").alias("overlap"), F.col("text").alias("piece_text"), "chunk_ids", "page_span")
    long = newest.where(size > limit)
    place = long.select("key", F.posexplode("chunk_ids").alias("pos", "chunk_id"))
    lengths = chunks.where("chunk_id is not null").groupBy("chunk_id").agg(F.max(F.struct("n_chars", "page_num")).alias("c"))
    # a section's chunks are bounded by its own row
    listed = place.join(lengths, "chunk_id", "left").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("c.n_chars").alias("n"), F.col("c.page_num").alias("p")))).alias("c"))
    ready = long.join(listed, "key", "left").select("key", "text", "chunk_ids", F.col("page_span.page_start").alias("p0"), F.col("page_span.page_end").alias("p1"), F.col("c.n").alias("sizes"), F.col("c.p").alias("pages"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def whole(x: float) -> int | None:
            return None if x is None or x != x else int(x)

        for df in batches:
            rows = []
            for r in df.itertuples(index=False):
                sizes = [] if r.sizes is None else [whole(x) for x in r.sizes]
                pages = [] if r.pages is None else [whole(x) for x in r.pages]
                for no, a, b, o, t, ids, span in pieces_of(r.text, list(r.chunk_ids), sizes, pages, (whole(r.p0), whole(r.p1)), limit, overlap):
                    rows.append((r.key, no, a, b, o, t, ids, {"page_start": span[0], "page_end": span[1]}))
            yield pd.DataFrame(rows, columns=["key", "piece_no", "piece_start", "piece_end", "overlap", "piece_text", "chunk_ids", "page_span"])

    return short.unionByName(ready.mapInPandas(run, SCHEMA)).withColumnRenamed("key", "section_id")


def found(pieces: DataFrame) -> DataFrame:
    """The sections that had to be split."""
    return pieces.where("piece_no = 1").select("section_id")

"""Evaluation passages inside training text.

Method: an FM-index per shard of documents. Words are numbered by the passages' vocabulary; the shard's word string is sorted
into a suffix array, its BWT kept in a wavelet matrix; all phrases of the passages are searched backward through its ranks,
their occurrences located by sampled suffix positions, and the occurrences of one item in one document merged into spans: the
longest chain of words in the order of both sides, however far apart its parts lie, with the words of short gaps matched exactly.

A document holds an item when the parts of the chain that are the passage's own have at least ``min_share`` of its words. A part is
its own when the phrases in it are about as rare as the passage's are: their mean rarity is at least ``min_rarity`` of that of all
its phrases. Phrases many documents have, as forms of speech and headings, are found everywhere and say nothing of the passage
where they stand alone. How often each phrase occurs is counted by the same indexes over all documents.

The passages are a bounded table (``max_items`` rows, checked); the documents never leave their tasks.

Defined results. Null, empty and blank texts and passages match nothing. Words are compared in lower case after NFKD, without accents,
markup, soft hyphens, and line-end hyphens. Words no passage has are breaks no phrase crosses. A passage of fewer than
``phrase`` words is searched as one phrase. Repeated rows give one result row. Extra columns are ignored. A passage that stands in
a document several times has a row for each place.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from sparkloom.session import durable

WORD = re.compile(r"[^\W_]+")
MARKS = re.compile("[\u0300-\u036f]+")
MARKUP = re.compile(r"<[^<>\n]{1,60}>|&(?:nbsp|amp|quot|lt|gt|#\d+);|[­​-‍⁠﻿]|(?<=[^\W\d_])-[ \t]*\n[ \t]*(?=[a-zà-ÿ])")


def words_of(text: str) -> list[str]:
    """The text's words as they are compared."""
    if not text.isascii():
        text = MARKS.sub("", unicodedata.normalize("NFKD", text)).replace("ß", "ss")
    if "<" in text or "&" in text or "-\n" in text or "- \n" in text or not text.isascii():
        text = MARKUP.sub(lambda m: " " if m[0][0] in "&" else "", text)
    return WORD.findall(text.lower())


class WaveletMatrix:
    """Ranks over a string of small numbers, one bit plane a level, all queries of a step at once."""

    def __init__(self, s: np.ndarray, bits: int):
        self.levels, self.zeros = [], []
        for b in range(bits - 1, -1, -1):
            bit = (s >> b) & 1
            ones = np.zeros(len(s) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.levels.append((b, ones))
            self.zeros.append(len(s) - int(ones[-1]))
            s = np.concatenate([s[bit == 0], s[bit == 1]])
        self.bits = bits

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c occurs before position i."""
        lo, hi = np.zeros(len(i), np.int64), i.astype(np.int64)
        for (b, ones), z in zip(self.levels, self.zeros):
            one = ((c >> b) & 1).astype(bool)
            a, e = ones[lo].astype(np.int64), ones[hi].astype(np.int64)
            lo, hi = np.where(one, z + a, lo - a), np.where(one, z + e, hi - e)
        return hi - lo

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers at positions i and their ranks there."""
        c, lo, hi = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64), i.astype(np.int64)
        for (b, ones), z in zip(self.levels, self.zeros):
            one = (ones[hi + 1] - ones[hi]).astype(bool)
            c |= one.astype(np.int64) << b
            a, e = ones[lo].astype(np.int64), ones[hi].astype(np.int64)
            lo, hi = np.where(one, z + a, lo - a), np.where(one, z + e, hi - e)
        return c, hi - lo


def suffix_array(s: np.ndarray, bits: int) -> np.ndarray:
    """Sorted suffixes of a string in which 0 is a break: each 0 counts as a letter of its own, in order of position, below all others."""
    n = len(s)
    k = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    alive = np.ones(n, bool)
    for j in range(k):
        col = np.zeros(n, np.int64)
        if j < n:
            col[: n - j] = s[j:]
        alive &= col > 0
        key = (key << bits) | np.where(alive, col, 0)
    open_end = alive  # no break within k words: order beyond them is still open
    sa = np.argsort(key, kind="stable")
    sorted_key = key[sa]
    new = np.ones(n, bool)
    new[1:] = (sorted_key[1:] != sorted_key[:-1]) | ~open_end[sa[1:]]
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[sa] = group
    while True:
        tied = np.zeros(n, bool)
        tied[1:] = group[1:] == group[:-1]
        tied[:-1] |= tied[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            return sa
        pos = sa[at]
        ahead = pos + k
        nxt = np.where(ahead < n, rank[np.minimum(ahead, n - 1)], -1)
        order = np.lexsort((pos, nxt, group[at]))
        pos, nxt, g = pos[order], nxt[order], group[at]
        sa[at] = pos
        fresh = np.ones(len(at), bool)
        fresh[1:] = (g[1:] != g[:-1]) | (nxt[1:] != nxt[:-1])
        group[at] = np.maximum.accumulate(np.where(fresh, at, 0))
        rank[pos] = group[at]
        k *= 2


class FMIndex:
    """Backward search and location of phrases in a string of word numbers (0 is a break)."""

    def __init__(self, s: np.ndarray, vocab: int, sample: int = 8):
        bits = max(1, int(vocab).bit_length())
        sa = suffix_array(s, bits)
        self.bwt = WaveletMatrix(np.where(sa > 0, s[sa - 1], 0).astype(np.int64), bits)
        self.start = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=vocab + 1))])
        kept = (sa % sample == 0) | (s[sa - 1] == 0) | (sa == 0)  # also at each break, so no walk crosses one
        self.kept = np.concatenate([[0], np.cumsum(kept)])
        self.positions = sa[kept].astype(np.int32)
        self.n = len(s)

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the phrases (rows of word numbers, padded at the end)."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for j in range(phrases.shape[1] - 1, -1, -1):
            use = np.flatnonzero((j < lengths) & (hi > lo))
            c = phrases[use, j]
            lo[use] = self.start[c] + self.bwt.rank(c, lo[use])
            hi[use] = self.start[c] + self.bwt.rank(c, hi[use])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: step back to the nearest sampled row."""
        out = np.zeros(len(rows), np.int64)
        todo, at, steps = np.arange(len(rows)), rows.copy(), 0
        while len(todo):
            hit = self.kept[at + 1] > self.kept[at]
            out[todo[hit]] = self.positions[self.kept[at[hit]]] + steps
            todo, at = todo[~hit], at[~hit]
            c, r = self.bwt.access(at)
            at = self.start[c] + r
            steps += 1
        return out


class Passages:
    """The passages' words, and their phrases each once with the passages and places that have it."""

    def __init__(self, items: list[tuple[int, str]], phrase: int):
        self.ids = [i for i, _ in items]
        texts = [words_of(t) for _, t in items]
        self.vocab = {w: i + 1 for i, w in enumerate(sorted({w for t in texts for w in t}))}
        self.words = [[self.vocab[w] for w in t] for t in texts]
        where: dict[tuple, list[tuple[int, int]]] = {}
        for x, t in enumerate(self.words):
            for k in range(max(1, len(t) - phrase + 1) if t else 0):
                where.setdefault(tuple(t[k : k + phrase]), []).append((x, k))
        self.phrases = np.array([[*p, *[0] * (phrase - len(p))] for p in where], np.int64).reshape(-1, phrase)
        self.lengths = np.array([len(p) for p in where], np.int64)
        self.number = [[0] * max(1, len(t) - phrase + 1) if t else [] for t in self.words]  # of each item's phrases
        for i, places in enumerate(where.values()):
            for x, k in places:
                self.number[x][k] = i
        self.first = np.concatenate([[0], np.cumsum([len(v) for v in where.values()])]).astype(np.int64)
        flat = [u for v in where.values() for u in v]
        self.item = np.array([u[0] for u in flat], np.int64)
        self.place = np.array([u[1] for u in flat], np.int64)


def matched_words(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by bit rows."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        u = v & masks.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def longest_chain(points: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of (place in the document, place in the item) that rises in both, in n log n steps."""
    ends: list[int] = []  # for each length the least place in the item a chain of it ends at
    last: list[int] = []
    back = [-1] * len(points)
    points = sorted(points, key=lambda x: (x[0], -x[1]))
    for i, (_, p) in enumerate(points):
        k = bisect_left(ends, p)
        back[i] = last[k - 1] if k else -1
        if k == len(ends):
            ends.append(p)
            last.append(i)
        else:
            ends[k], last[k] = p, i
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(points[i])
        i = back[i]
    return out[::-1]


def chain_parts(item: list[int], doc: list[int], hits: list[tuple[int, int]], phrase: int) -> list[tuple[int, int, int, list[int]]]:
    """The parts of the longest chain: words of the passage matched in order, first and last word in the document, and the item's places of the phrases found. Words in short gaps are matched exactly and join two parts; so are those just beyond the chain's ends."""
    chain = longest_chain(list({(d + i, p + i) for d, p in hits for i in range(phrase)}))
    if not chain:
        return []
    ends = {(d + phrase - 1, p + phrase - 1): p for d, p in hits}
    starts = {(d, p) for d, p in hits}
    parts: list[list] = []
    before = None
    for d, p in chain:
        if before is None or p - before[1] > phrase + 1 or d - before[0] > 2 * (p - before[1]) + 8:
            parts.append([0, d, d + 1, set()])
        elif p - before[1] > 1 and d - before[0] > 1:
            parts[-1][0] += matched_words(item[before[1] + 1 : p], doc[before[0] + 1 : d])
        parts[-1][0] += 1
        parts[-1][2] = d + 1
        if (d, p) in starts:
            parts[-1][3].add(p)
        if (d, p) in ends:
            parts[-1][3].add(ends[d, p])
        before = (d, p)
    edge = phrase + 4
    (d0, p0), (d1, p1) = chain[0], chain[-1]
    for part, a, b in ((parts[0], item[max(0, p0 - edge) : p0], doc[max(0, d0 - edge) : d0]), (parts[-1], item[p1 + 1 : p1 + 1 + edge], doc[d1 + 1 : d1 + 1 + edge])):
        more = matched_words(a, b) if a else 0
        part[0] += more if 2 * more >= len(a) else 0  # fewer are there by chance
    return [(n, first, last, sorted(places)) for n, first, last, places in parts if places]


def merge_spans(item: list[int], doc: list[int], hits: list[tuple[int, int]], phrase: int, least: float) -> list[tuple[int, list[tuple[int, int, int, list[int]]]]]:
    """(whether over all hits, parts) of the chains of at least ``least`` words: those of hits near each other, and, where there are several such, that of all hits together."""
    hits = sorted(hits)
    groups: list[list[tuple[int, int]]] = []
    for h in hits:
        if groups and h[0] - groups[-1][-1][0] <= 2 * len(item):
            groups[-1].append(h)
        else:
            groups.append([h])
    out = []
    for level, g in [*((0, g) for g in groups), *([(1, hits)] if len(groups) > 1 else [])]:
        if len({p + i for _, p in g for i in range(phrase)}) >= 0.6 * least:
            parts = chain_parts(item, doc, g, phrase)
            if sum(x[0] for x in parts) >= least:
                out.append((level, parts))
    return out


def search_shard(texts: list[str | None], passages: Passages, phrase: int, min_share: float, counts: np.ndarray | None = None) -> list[tuple[int, int, int, int, int, int, int, list[int]]]:
    """(document's place in the shard, item's place, whether over all hits, number of the span, words, first word, last word, phrases found) of each part of the spans that hold enough of an item. The phrases' occurrences are added to ``counts``."""
    get = passages.vocab.get
    docs = [[get(w, 0) for w in words_of(t)] if t else [] for t in texts]
    sizes = np.array([len(d) + 1 for d in docs], np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    s = np.zeros(int(begin[-1]), np.int64)
    for d, at in zip(docs, begin):
        s[at : at + len(d)] = d
    if not len(s) or not len(passages.phrases):
        return []
    fm = FMIndex(s, len(passages.vocab))
    lo, hi = fm.search(passages.phrases, passages.lengths)
    n = hi - lo
    if counts is not None:
        counts += n
    which = np.repeat(np.arange(len(n)), n)
    rows = np.repeat(lo, n) + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    pos = fm.locate(rows)
    doc = np.searchsorted(begin, pos, side="right") - 1
    # one row per occurrence and place of the phrase in an item
    times = passages.first[which + 1] - passages.first[which]
    occ = np.repeat(np.arange(len(which)), times)
    use = np.repeat(passages.first[which], times) + np.arange(len(occ)) - np.repeat(np.cumsum(times) - times, times)
    doc, item, place, at = doc[occ], passages.item[use], passages.place[use], (pos - begin[doc])[occ]
    # most of the words asked for must be in phrases found, so so many different places of the item must be
    size = np.array([max(1, len(w)) for w in passages.words])
    pair = doc * len(size) + item
    distinct = np.unique(pair * (1 << 20) + place)
    holders, found = np.unique(distinct >> 20, return_counts=True)
    length = size[holders % len(size)]
    chosen = holders[found >= np.maximum(1, np.minimum(0.6 * min_share * length / phrase, length - phrase + 1))]
    kept = np.flatnonzero(np.isin(pair, chosen))
    order = kept[np.argsort(pair[kept], kind="stable")]
    out = []
    edges = np.flatnonzero(np.diff(pair[order], prepend=-1, append=-2)) if len(order) else []
    for a, b in zip(edges[:-1], edges[1:]) if len(order) else ():
        g = order[a:b]
        x, y = int(doc[g[0]]), int(item[g[0]])
        words = passages.words[y]
        for no, (level, parts) in enumerate(merge_spans(words, docs[x], list(zip(at[g].tolist(), place[g].tolist())), min(phrase, len(words)), min_share * len(words))):
            out += [(x, y, level, no, n, first, last, [int(passages.number[y][p]) for p in places]) for n, first, last, places in parts]
    return out


def find_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", passage: str = "passage", phrase: int = 4, min_share: float = 0.5, min_rarity: float = 0.75, shard_words: int = 400_000, max_items: int = 100_000) -> DataFrame:
    """One row per document, item it holds and place: key, item_key, share (of the passage's words), first_word, last_word (the span to remove, in words of the text)."""
    rows = items.where(f"{passage} is not null").select(item_key, passage).distinct().orderBy(item_key, passage).limit(max_items + 1).collect()
    if len(rows) > max_items:
        raise ValueError(f"more than {max_items} passages: search them in several runs")
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast([(r[0], r[1]) for r in rows])  # at most max_items passages
    key_type = docs.schema[key].dataType.simpleString()
    item_type = items.schema[item_key].dataType.simpleString()
    longs = pa.list_(pa.int64())
    columns = ["key", "item", "level", "span", "words", "first_word", "last_word", "phrases", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passages = Passages(shared.value, phrase)
        counts = np.zeros(len(passages.phrases), np.int64)
        n_docs, key_arrow = 0, None

        def done(keys: list, texts: list) -> pa.RecordBatch | None:
            hits = search_shard(texts, passages, phrase, min_share, counts)
            if not hits:
                return None
            whole = [pa.array([h[i] for h in hits], pa.int64()) for i in range(1, 7)]
            whole[2] = pa.array([(zlib.crc32(texts[h[0]].encode("utf-8", "replace")) << 20) + h[3] for h in hits], pa.int64())  # rows of one key with different texts stay apart
            return pa.RecordBatch.from_arrays([pa.array([keys[h[0]] for h in hits], key_arrow), *whole, pa.array([h[7] for h in hits], longs), pa.nulls(len(hits), longs)], names=columns)

        keys, texts, size = [], [], 0
        for batch in batches:
            key_arrow = batch.schema.field(0).type
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not t:
                    continue
                n_docs += 1
                keys.append(k)
                texts.append(t)
                size += len(t)
                if size > 6 * shard_words:
                    if (out := done(keys, texts)) is not None:
                        yield out
                    keys, texts, size = [], [], 0
        if keys and (out := done(keys, texts)) is not None:
            yield out
        if n_docs:  # one row a task: its documents and how often each phrase occurs in them
            seen = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.nulls(1, key_arrow), pa.array([n_docs], pa.int64()), *[pa.nulls(1, pa.int64())] * 5, pa.array([seen.tolist()], longs), pa.array([counts[seen].tolist()], longs)], names=columns)

    out = durable(docs.where(F.col(key).isNotNull()).select(key, text).mapInArrow(run, f"key {key_type}, item long, level long, span long, words long, first_word long, last_word long, phrases array<long>, times array<long>"))
    spans, tasks = out.where("times is null"), out.where("times is not null")
    counted = tasks.select(F.explode(F.arrays_zip("phrases", "times")).alias("x")).groupBy("x.phrases").agg(F.sum("x.times").alias("n")).select(F.col("phrases").alias("phrase"), "n")
    total = tasks.agg(F.sum("item").alias("n_docs"))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            passages = Passages(shared.value, phrase)
            for i, numbers in enumerate(passages.number):
                yield pa.RecordBatch.from_pydict({"item": pa.array([i] * len(numbers), pa.int64()), "phrase": pa.array(numbers, pa.int64())})

    # a phrase's rarity: the logarithm of the documents over its occurrences
    asked = spark.range(1, numPartitions=1).mapInArrow(parts, "item long, phrase long")
    rarity = F.log1p(F.col("n_docs") / F.greatest(F.coalesce("n", F.lit(0)), F.lit(1)))
    rare = durable(asked.join(counted, "phrase", "left").join(F.broadcast(total)).select("item", "phrase", rarity.alias("rarity")))  # one row is broadcast
    usual = rare.groupBy("item").agg(F.avg("rarity").alias("usual"))
    part = ["key", "item", "level", "span", "words", "first_word", "last_word"]
    found = spans.select(*part, F.explode("phrases").alias("phrase")).join(rare.distinct(), ["item", "phrase"]).groupBy(*part).agg(F.avg("rarity").alias("rarity"))
    own = found.join(usual, "item").where(F.col("rarity") >= min_rarity * F.col("usual"))
    names = spark.createDataFrame([(i, r[0], max(1, len(words_of(r[1])))) for i, r in enumerate(rows)], f"item long, {item_key} {item_type}, n_words long")
    span = own.groupBy("key", "item", "level", "span").agg(F.sum("words").alias("words"), F.min("first_word").alias("first_word"), F.max("last_word").alias("last_word")).join(names, "item").where(F.col("words") >= min_share * F.col("n_words"))
    # a span over all parts of a document counts only where none of its own has enough
    best = span.withColumn("best", F.min("level").over(Window.partitionBy("key", "item"))).where("level = best")  # a document's spans of an item
    return best.select(F.col("key").alias(key), item_key, F.least(F.lit(1.0), F.col("words") / F.col("n_words")).alias("share"), "first_word", "last_word").distinct()

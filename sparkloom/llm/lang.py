"""Language of documents and of their mixed-language stretches.

Method: script ranges narrow a word's candidates, then Viterbi over per-word scores with a switching penalty labels the text. A word
in the Latin script can be of the languages whose alphabet has all its letters; a word in another script is of none known here and
only ``und``, the label of what no known language fits. The word and letter-group statistics are learned from a bounded sample of
labelled rows (``sample_per_lang`` per language, the smallest hashes of the key); wrong labels in it are outvoted by a second fit on
the labels the first fit gives. Counts by language say which hashes are small enough, so the texts are read once for the sample. The
model (a few MB, bounded by the sample) goes to the workers with the function.

``confidence`` is the share of the sample's sentences with so clear a lead of the best language over the second that were of the
best, read off a logistic curve fitted there.

Sentences end at their marks, at blank lines, and at a line's end unless the next line goes on: in small letters, or after a line
filled to the width of the text. The end of the text ends a sentence without a mark where it is long and plainly of one language.

Defined results. Null and blank texts have no segment. A stretch in another script, or a sentence of six words or more of which
hardly one is known, is ``und``. Very long texts are labelled whole. Repeated rows give repeated segments; ``found`` is distinct and
never ``und``. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

LANGS = ("de", "en", "es", "fr", "nl", "pt")
# The ISO 639 codes and the names of the languages.
NAMES = {
    "de": ("de", "deu", "ger", "german", "deutsch"),
    "en": ("en", "eng", "english", "anglais", "englisch"),
    "es": ("es", "spa", "spanish", "castilian", "español", "espanol"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais"),
    "nl": ("nl", "nld", "dut", "dutch", "nederlands"),
    "pt": ("pt", "por", "portuguese", "português", "portugues"),
}
# The letters each alphabet has beside a to z; a language has those of its usual loan words too.
LETTERS = {
    "de": "äöüßéèà",
    "en": "éèêëïçñ",
    "es": "áéíóúüñ",
    "fr": "àâæçéèêëîïôœùûüÿ",
    "nl": "áàäéèêëíïóöúüç",
    "pt": "áâãàçéêíóôõúü",
}
# Script ranges (first and last code point) and the languages written in them by the alphabets above; letters outside have no candidate here.
SCRIPTS = ((0x41, 0x24F), (0x1E00, 0x1EFF), (0xFB00, 0xFB06))
UND = "und"
WORD = re.compile(r"[^\W\d_]+")
BREAK = re.compile(r"[.!?…]+[\"'»”’)\]]*(?=\s|$)|\n")
GOES_ON = re.compile(r"[ \t]*[^\W\d_A-ZÀ-ÖØ-Þ]")  # a line that begins with a small letter
FILLED = re.compile(r"[^\W\d_][ \t,]*\Z")
GRAMS = 1 << 16
SEGMENTS = pa.schema([("segment_no", pa.int64()), ("seg_start", pa.int64()), ("seg_end", pa.int64()), ("seg_lang", pa.string()), ("confidence", pa.float64()), ("n_words", pa.int64()), ("n_sentences", pa.int64())])


def named_langs(label: Column) -> Column:
    """The languages a label names in any form: codes, regional codes and names, alone or in a list."""
    parts = F.split(F.lower(F.coalesce(label, F.lit(""))), r"[^\p{L}]+")
    return F.filter(F.array(*[F.when(F.arrays_overlap(parts, F.array(*[F.lit(n) for n in names])), F.lit(k)) for k, names in NAMES.items()]), lambda x: x.isNotNull())


def _grams(word: str) -> list[int]:
    w = f"^{word}$"
    return [hash_gram(w[i : i + n]) for n in (2, 3, 4) for i in range(len(w) - n + 1)]


def hash_gram(s: str) -> int:
    h = 2166136261
    for ch in s:
        h = ((h ^ ord(ch)) * 16777619) & 0xFFFFFFFF
    return h & (GRAMS - 1)


def candidates(word: str) -> tuple[bool, ...]:
    """Whether the word can be of each of LANGS, by its script and, within it, its letters."""
    low = word.lower()
    if low.isascii():
        return (True,) * len(LANGS)
    if not any(a <= ord(low[0]) <= b for a, b in SCRIPTS):
        return (False,) * len(LANGS)
    special = {c for c in low if not c.isascii()}
    fits = tuple(special <= set(LETTERS[x]) for x in LANGS)
    return fits if any(fits) else (True,) * len(LANGS)  # a name from elsewhere says nothing


def fit(counts: list[Counter]) -> dict:
    """Per-word scores from word counts per language: the log of the word's rate in the language over its mean rate, shrunk for rare words towards the letter groups' score."""
    n = len(LANGS)
    vocab = {w: i for i, w in enumerate(sorted(set().union(*counts)))}
    c = np.zeros((len(vocab), n))
    for j, k in enumerate(counts):
        for w, x in k.items():
            c[vocab[w], j] = x
    total = np.maximum(c.sum(0), 1)
    grams = np.full((GRAMS, n), 0.0)
    for w, i in vocab.items():
        grams[_grams(w)] += np.log1p(c[i])
    rate = (grams + 0.1) / (grams.sum(0) + 0.1 * GRAMS)
    gram_score = np.log(rate / rate.mean(1, keepdims=True)).astype(np.float32)
    gram_score[grams.sum(1) == 0] = 0
    rate = (c + 0.05) / (total + 0.05 * len(vocab))
    share = rate / rate.sum(1, keepdims=True)
    seen = c.sum(1, keepdims=True)
    scores = np.log(share * n + 1e-3) * (seen / (seen + 2))
    scores = np.clip(scores, -4, 2).astype(np.float32)
    return {"words": {w: scores[i] for w, i in vocab.items()}, "grams": gram_score}


LEAST = -4.0  # the score of a language a word cannot be of


def word_score(model: dict, word: str) -> np.ndarray:
    """The word's score for each of LANGS and, last, for und."""
    fits = candidates(word)
    if not any(fits):
        return np.array([LEAST] * len(LANGS) + [1.0], np.float32)
    s = model["words"].get(word)
    if s is None:
        s = np.clip(model["grams"][_grams(word)].sum(0) * 0.5, -2, 1)
    return np.append(np.where(fits, s, LEAST), -2.0).astype(np.float32)


def known_rows(docs: DataFrame, key: str, sample_per_lang: int) -> list[tuple[str, str]]:
    """(language, text) of the sample_per_lang labelled rows of each language with the smallest hashes of the key."""
    named = docs.where("text is not null").select(named_langs(F.col("lang")).alias("named"), "text", F.xxhash64(F.col(key).cast("string")).alias("h")).where(F.size("named") == 1).select(F.get("named", F.lit(0)).alias("l"), "text", "h")
    counts = {r.l: r.n for r in named.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a language, from the label alone
    # hashes are even, so a bound somewhat above the wanted share holds the smallest ones; the few beyond are cut here
    share = {x: min(1.0, (sample_per_lang + 6 * sample_per_lang**0.5 + 6) / n) for x, n in counts.items()}
    below = {x: min((1 << 63) - 1, int(-(1 << 63) + v * (1 << 64))) for x, v in share.items()}
    small = [(F.col("l") == x) & (F.col("h") <= b) for x, b in below.items()]
    rows: dict[str, list] = {}
    for r in named.where(reduce(lambda a, b: a | b, small)).collect() if small else ():
        rows.setdefault(r.l, []).append((r.h, r.text))
    return [(x, t) for x in sorted(rows) for _, t in sorted(rows[x])[:sample_per_lang]]


def sentences(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, whether a mark or the text's end closes it) of each sentence."""
    longest = max(map(len, text.split("\n")))
    out, at, line = [], 0, 0
    for m in BREAK.finditer(text):
        end = m.end()
        if text[m.start()] == "\n":
            before = text[line : m.start()]
            line = end
            mark = text[at : m.start()].rstrip()[-1:] in ".!?…"
            filled = len(before) >= 0.8 * longest and len(before) > 40 and FILLED.search(before) is not None and "|" not in before and "\t" not in before
            if not mark and before.strip() and text[end : end + 1] not in ("", "\n") and (GOES_ON.match(text, end) or (filled and text[end].isalpha())):
                continue
            out.append((at, end, False))
        else:
            out.append((at, end, True))
        at = end
    if at < len(text):
        out.append((at, len(text), False))
    return out


def train(docs: DataFrame, key: str = "doc_id", sample_per_lang: int = 800, rounds: int = 2) -> dict:
    """Fit on at most sample_per_lang labelled rows of each language."""
    sample = known_rows(docs, key, sample_per_lang)
    rows = [(LANGS.index(x), [w.lower() for w in WORD.findall(t)]) for x, t in sample]
    labels = [x for x, _ in rows]
    model: dict = {}
    for r in range(rounds):
        counts = [Counter() for _ in LANGS]
        for j, (_, words) in zip(labels, rows):
            counts[j].update(words)
        model = fit(counts)
        scores = {w: word_score(model, w) for c in counts for w in c}
        total = [sum((scores[w] for w in words), np.zeros(len(LANGS) + 1))[: len(LANGS)] if words else None for _, words in rows]
        labels = [j if t is None else int(np.argmax(t)) for j, t in zip(labels, total)]
    leads, right = [], []
    for j, (_, text) in zip(labels, sample):
        for a, b, _ in sentences(text):
            t = sum((scores[w.lower()] for w in WORD.findall(text[a:b]) if w.lower() in scores), np.zeros(len(LANGS) + 1))[: len(LANGS)]
            order = np.sort(t)
            leads.append(order[-1] - order[-2])
            right.append(int(np.argmax(t)) == j and order[-1] > order[-2])
    model["curve"] = curve(np.array(leads), np.array(right, float))
    return model


def curve(leads: np.ndarray, right: np.ndarray) -> tuple[float, float]:
    """The logistic curve of being right over log(1 + lead), by Newton steps with a slight pull to (0, 1)."""
    x = np.stack([np.ones(len(leads)), np.log1p(leads)], 1)
    w, prior = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    for _ in range(20):
        p = 1 / (1 + np.exp(-x @ w))
        grad = x.T @ (right - p) - (w - prior)
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(2), grad)
    return float(w[0]), float(max(0.0, w[1]))


def viterbi(scores: np.ndarray, lengths: np.ndarray, starts_sentence: np.ndarray, switch: float, switch_inside: float) -> np.ndarray:
    """Best label of each word. scores: all texts' words one after another; a step goes over all texts at once.

    Changing the language costs ``switch`` where a sentence starts and ``switch_inside`` within one.
    """
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    order = np.argsort(-lengths, kind="stable")
    first, size = first[order], lengths[order]
    longest = int(size[0]) if len(size) else 0
    labels = np.zeros(len(scores), np.int8)
    if not longest:
        return labels
    active = np.searchsorted(-size, -np.arange(1, longest + 1), side="right")  # texts that have a word t
    best = scores[first[: active[0]]].astype(np.float32)
    stay, came = [None], [None]
    for t in range(1, longest):
        k = active[t]
        at = first[:k] + t
        prev = best[:k]
        top = prev.argmax(1)
        jump = prev[np.arange(k), top] - np.where(starts_sentence[at], switch, switch_inside).astype(np.float32)
        keep = prev >= jump[:, None]
        stay.append(keep)
        came.append(top.astype(np.int8))
        new = np.where(keep, prev, jump[:, None]) + scores[at]
        best[:k] = new
    # texts end at different steps: begin each one's way back at its own last word
    state = np.zeros(len(size), np.int8)
    for t in range(longest - 1, -1, -1):
        k = active[t]
        ends = size[:k] == t + 1
        if ends.any():
            state[:k][ends] = best[:k][ends].argmax(1)
        labels[first[:k] + t] = state[:k]
        if t:
            keep = stay[t][np.arange(k), state[:k]]
            state[:k] = np.where(keep, state[:k], came[t])
    return labels


def label_texts(texts: list[str | None], model: dict, switch: float, switch_inside: float, min_words: int) -> list[list[tuple]]:
    """Segments of each text: (no, start, end, lang, confidence, words, whole sentences)."""
    ids: dict[str, int] = {}
    word_ids: list[int] = []
    lengths = np.zeros(len(texts), np.int64)
    sent_text: list[int] = []
    sent_span: list[tuple[int, int]] = []
    sent_words: list[int] = []
    sent_ended: list[bool] = []
    for i, text in enumerate(texts):
        if not text:
            continue
        n = 0
        for at, end, ended in sentences(text):
            words = WORD.findall(text[at:end])
            if words:
                word_ids += [ids.setdefault(w, len(ids)) for w in words]
                sent_text.append(i)
                sent_span.append((at, end))
                sent_words.append(len(words))
                sent_ended.append(ended)
                n += len(words)
        lengths[i] = n
    last_of_text = [k + 1 == len(sent_text) or sent_text[k + 1] != x for k, x in enumerate(sent_text)]
    out: list[list[tuple]] = [[] for _ in texts]
    if not word_ids:
        return out
    cache = model.setdefault("cache", {})
    if len(cache) > 500_000:
        cache.clear()
    for w in ids:
        if w not in cache:
            cache[w] = word_score(model, w.lower())
    table = np.stack([cache[w] for w in ids])
    scores = table[np.array(word_ids)]
    counts = np.array(sent_words)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    starts = np.zeros(len(scores), bool)
    starts[first] = True
    labels = viterbi(scores, lengths, starts, switch, switch_inside)
    n_langs = len(LANGS)
    per = np.stack([np.add.reduceat(labels == j, first) for j in range(n_langs + 1)], 1)
    main = per.argmax(1)
    sums = np.add.reduceat(scores, first, axis=0)
    seen = np.array([w.lower() in model["words"] for w in ids])[np.array(word_ids)]
    n_seen = np.add.reduceat(seen, first)
    strange = (counts >= 6) & (n_seen < 0.15 * counts)
    main = np.where(strange, n_langs, main)
    known = np.array([any(candidates(w)) for w in ids])[np.array(word_ids)]
    n_known = np.add.reduceat(known, first)
    clear = (per.max(1) >= 0.75 * counts) & (n_known >= min_words) & (main < n_langs)
    full = np.add.reduceat(seen & np.array([len(w) >= 3 for w in ids])[np.array(word_ids)], first)  # known words that are no scraps of codes
    open_end = np.array(last_of_text) & (counts >= 8) & (per.max(1) >= 0.9 * counts) & (full >= 0.6 * counts)
    whole = ((np.array(sent_ended) & (counts >= min_words)) | open_end) & clear
    flat, steep = model.get("curve", (0.0, 1.0))
    run: list = []

    def flush() -> None:
        if run:
            i, j = sent_text[run[0]], int(main[run[0]])
            s = sums[run[0] : run[-1] + 1].sum(0)
            n = int(counts[run[0] : run[-1] + 1].sum())
            if j == n_langs:  # the share of its words no known language has
                sure = 1 - float(n_seen[run[0] : run[-1] + 1].sum()) / n
            else:
                sure = 1 / (1 + float(np.exp(-(flat + steep * np.log1p(max(0.0, float(s[j] - np.delete(s[:n_langs], j).max())))))))
            out[i].append((len(out[i]), sent_span[run[0]][0], sent_span[run[-1]][1], UND if j == n_langs else LANGS[j], sure, n, int(whole[run[0] : run[-1] + 1].sum())))

    for k in range(len(counts)):
        if run and (sent_text[k] != sent_text[run[0]] or main[k] != main[run[0]]):
            flush()
            run = []
        run.append(k)
    flush()
    return out


def label_segments(docs: DataFrame, model: dict, key: str = "doc_id", switch: float = 3.0, switch_inside: float = 8.0, min_words: int = 4) -> DataFrame:
    """One row per document and stretch of one language: key, lang (as labelled), segment_no, seg_start, seg_end (code points), seg_lang, confidence, n_words, n_sentences (whole sentences)."""
    rows = docs.select(key, "lang", "text")
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # bounded by the training sample
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 2000):
                batch = whole.slice(k, 2000)
                segments = label_texts(batch.column(2).to_pylist(), shared.value, switch, switch_inside, min_words)
                back = pa.array([i for i, s in enumerate(segments) for _ in s], pa.int64())
                flat = [x for s in segments for x in s]
                cols = [pa.array([x[j] for x in flat], f.type) for j, f in enumerate(SEGMENTS)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(back), batch.column(1).take(back), *cols], names=[key, "lang", *SEGMENTS.names])

    return rows.mapInArrow(run, f"{key} {key_type}, lang string, segment_no long, seg_start long, seg_end long, seg_lang string, confidence double, n_words long, n_sentences long")


def label_documents(segments: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per document: its main language by words (ties by the language's name), its share as confidence, and all languages with a whole sentence."""
    per = segments.groupBy(key, "seg_lang").agg(F.sum("n_words").alias("n"), F.sum(F.col("n_words") * F.col("confidence")).alias("sure"), F.sum("n_sentences").alias("s"))
    return per.groupBy(key).agg(
        F.min_by("seg_lang", F.struct((-F.col("n")).alias("n"), "seg_lang")).alias("main_lang"),
        (F.max("sure") / F.sum("n")).alias("confidence"),
        F.array_sort(F.collect_set(F.when(F.col("s") > 0, F.col("seg_lang")))).alias("langs"),
    )


def found(segments: DataFrame, key: str = "doc_id") -> DataFrame:
    """The languages with at least one whole sentence that the label does not name."""
    named = named_langs(F.col("lang"))
    return segments.where((F.col("n_sentences") > 0) & (F.col("seg_lang") != UND) & ~F.array_contains(named, F.col("seg_lang"))).select(key, F.col("seg_lang").alias("lang")).distinct()

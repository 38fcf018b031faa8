import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from sparkloom.llm import leak


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.integers(1, 3))
def test_fm_index_against_scanning(s, k):
    a = np.array(s + [0], np.int64)
    fm = leak.FMIndex(a, 3, sample=4)
    phrases = np.array([[(i // 3**j) % 3 + 1 for j in range(k)] for i in range(3**k)], np.int64)
    lo, hi = fm.search(phrases, np.full(len(phrases), k))
    for p, x, y in zip(phrases.tolist(), lo, hi):
        want = [i for i in range(len(s) - k + 1) if s[i : i + k] == p]
        assert sorted(fm.locate(np.arange(x, y)).tolist()) == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=25), st.lists(st.integers(0, 4), max_size=25))
def test_matched_words(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    assert leak.matched_words(a, b) == t[-1][-1]


PASSAGE = " ".join(f"word{i}" for i in range(60))
OTHER = " ".join(f"other{i % 70}" for i in range(400))


def altered(every):
    return " ".join("changed" if i % every == 4 else f"word{i}" for i in range(60))


def cases():
    yield 1, OTHER + " " + PASSAGE + " " + OTHER, True
    yield 2, OTHER + " " + " ".join(PASSAGE.split()[:31]) + " " + OTHER, True
    yield 3, OTHER + " " + " ".join(PASSAGE.split()[:24]) + " " + OTHER, False
    yield 4, altered(9).upper().replace(" ", "\n"), True
    yield 5, " ".join(f"<b>{w}</b>" for w in PASSAGE.split()), True
    yield 6, " ".join(PASSAGE.split()[:20]) + " " + OTHER[:900] + " " + " ".join(PASSAGE.split()[20:42]), True
    yield 7, " ".join(reversed(PASSAGE.split())), False
    yield 8, None, False
    yield 9, "", False
    yield 10, (OTHER + " ") * 300 + PASSAGE, True
    yield 1, OTHER + " " + PASSAGE + " " + OTHER, True
    w = PASSAGE.split()
    yield 11, " ".join(" ".join(w[i : i + 5]) + " a1 b2 c3 d4" for i in range(0, 60, 5)), True  # strange words between
    yield 12, " ".join("changed" if i % 5 == 4 else x for i, x in enumerate(w)), True  # every fifth word changed
    yield 13, " ".join(" ".join(w[i : i + 8]) + " " + " ".join(f"col{j}" for j in range(8)) for i in range(0, 60, 8)), True  # two columns
    yield 14, " ".join(" ".join(w[i : i + 12]) + " " + " ".join(f"far{j}" for j in range(700)) for i in range(0, 60, 12)), True  # parts far apart
    yield 15, " ".join(w[:10]) + " " + OTHER + " " + " ".join(w[30:42]), False


def test_chain_is_the_longest():
    import itertools
    import random

    rnd = random.Random(1)
    for _ in range(300):
        points = [(rnd.randrange(6), rnd.randrange(6)) for _ in range(rnd.randrange(1, 9))]
        got = leak.longest_chain(list(set(points)))
        rises = lambda c: all(a[0] < b[0] and a[1] < b[1] for a, b in zip(c, c[1:]))
        best = max(n for n in range(1, 9) for c in itertools.combinations(sorted(set(points)), n) if rises(c))
        assert rises(got) and len(got) == best


def test_forms_of_speech_are_no_passage(spark):
    stock = [" ".join(f"form{k}w{i}" for i in range(6)) for k in range(10)]
    own = " ".join(f"own{i}" for i in range(40))
    passage = " ".join(stock[:5]) + " " + own[:150] + " " + " ".join(stock[5:])
    docs = [(i, " ".join(f"{s} d{i}x{j} e{i}x{j}" for j, s in enumerate(stock))) for i in range(60)] + [(99, passage), (98, own)]
    got = {r.doc_id for r in leak.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, passage)], "item_id long, passage string")).collect()}
    assert got == {99}


def test_each_place_has_a_span_and_many_hits_are_quick(spark):
    doc = PASSAGE + " " + OTHER + " " + PASSAGE + " " + OTHER
    docs = spark.createDataFrame([(1, doc)], "doc_id long, text string")
    got = [(r.first_word, r.last_word) for r in leak.find_leaks(docs, spark.createDataFrame([(5, PASSAGE)], "item_id long, passage string")).collect()]
    assert sorted(got) == [(0, 60), (460, 520)]
    import time

    t = time.time()
    passages = leak.Passages([(1, "in view of the above " + PASSAGE)], 4)
    assert leak.search_shard([("in view of the above " * 20_000) + PASSAGE], passages, 4, 0.5)[0][4] > 60
    assert time.time() - t < 20


def test_find_leaks(spark):
    docs = spark.createDataFrame([(i, t, "clash") for i, t, _ in cases()], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(5, PASSAGE), (6, None), (7, ""), (8, "two words"), (5, PASSAGE)], "item_id long, passage string")
    got = [(r.doc_id, r.item_id) for r in leak.find_leaks(docs, items).collect()]
    assert sorted(got) == sorted({(i, 5) for i, _, y in cases() if y})
    assert leak.find_leaks(docs.where("false"), items).count() == 0 == leak.find_leaks(docs, items.where("false")).count()
    with pytest.raises(ValueError):
        leak.find_leaks(docs, items, max_items=1)

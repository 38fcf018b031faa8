import os

import pytest
from hypothesis import given, settings, strategies as st

from sparkloom.llm import mix


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 30)), min_size=1, max_size=6), st.integers(0, 60))
def test_apportion_against_seat_by_seat(sources, blocks):
    weights, caps = [float(w) for w, _ in sources], [c for _, c in sources]
    seats = [0] * len(weights)
    for _ in range(blocks):
        open_ = [i for i in range(len(weights)) if weights[i] > 0 and seats[i] < caps[i]]
        if not open_:
            break
        i = max(open_, key=lambda i: (weights[i] / (2 * seats[i] + 1), -i))
        seats[i] += 1
    assert mix.apportion(weights, caps, blocks) == seats


@pytest.mark.skipif(not os.path.exists(mix.RANKS), reason="no vocabulary file")
def test_mix(spark):
    docs = [(i, "a word " * 100, ["big", "Big ", "BIG"][i % 3], "x") for i in range(300)] + [(1000 + i, "a word " * 100, "small", "x") for i in range(10)] + [(2000, None, "small", "x"), (2001, "", "small", "x"), (2002, "word", None, "x"), (0, "a word " * 100, "big", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, tokens string")
    targets = spark.createDataFrame([("m", 0.5, "big", 0.8, 1), ("m", 0.5, "small", 0.1, 4), ("m", 0.5, "none", 0.1, 4), ("n", 0.5, "small", 1.0, 2)], "mix_name string, total_ratio double, source string, target_share double, max_repeats int")
    out = mix.mix(df, targets, block_tokens=200, shard_tokens=8000)
    rows = out.collect()
    assert len({(r.mix_name, r.doc_id) for r in rows}) == len(rows)
    assert max(r.repeats for r in rows if r.source == "small" and r.mix_name == "m") <= 4 and all(r.repeats == 2 for r in rows if r.mix_name == "n") and sum(r.mix_name == "n" for r in rows) == 10
    got = {(r.mix_name, r.source): r.actual_share for r in mix.shares(out, targets).collect()}
    assert abs(got["m", "big"] - 8 / 9) < 0.02 and abs(got["m", "small"] - 1 / 9) < 0.02 and got["m", "none"] == 0 and got["n", "small"] == 1
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mix.mix(df, targets, block_tokens=200, shard_tokens=8000).collect()))
    assert mix.mix(df.where("false"), targets).count() == 0

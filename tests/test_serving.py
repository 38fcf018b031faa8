import time

import pytest
from pyspark.sql import functions as F

from sparkloom.plans import serving


def test_tools_answers_and_order():
    t = serving.Tools()
    t.register("a", lambda x: x + 1)
    assert t.run("a", 2) == 3
    with pytest.raises(ValueError):
        t.register("a", None)
    with pytest.raises(KeyError):
        t.run("b")
    now = [0.0]
    kept = serving.Answers(seconds=10, most=2, clock=lambda: now[0])
    kept.put("x", 1), kept.put("y", 2)
    assert kept.get("x") == 1
    kept.put("z", 3)
    assert kept.get("y") is None and kept.get("x") == 1
    now[0] = 11
    assert kept.get("x") is None
    slow = lambda i: lambda: (time.sleep(0.05 * (3 - i)), i)[1]
    out = serving.run_all([slow(0), slow(1), lambda: 1 / 0, slow(3 - 1)], 2)
    assert out[:2] == [0, 1] and isinstance(out[2], ZeroDivisionError) and out[3] == 2 and serving.run_all([]) == []


def test_time_is_bounded(spark):
    assert serving.run_within(spark, 60, lambda: spark.range(5).count()) == 5
    with pytest.raises(TimeoutError):
        serving.run_within(spark, 1, lambda: spark.range(4, numPartitions=2).mapInPandas(lambda it: (time.sleep(8) or b for b in it), "id long").count())
    with pytest.raises(ZeroDivisionError):
        serving.run_within(spark, 5, lambda: 1 / 0)


def test_contract_and_negative_claims(spark):
    a = spark.createDataFrame([("f", "k"), ("g", None)], "file_id string, primary_key string")
    b = spark.createDataFrame([("f", "g")], "file_a string, file_b string")
    one = serving.contract(a, b)
    assert one["hash"] == serving.contract(a.orderBy(F.desc("file_id")), b)["hash"] != serving.contract(a, b.where("false"))["hash"] and len(one["models"]) == 2
    ok = serving.negative_claim
    assert ok("There are 5.", [], {"p"}) == {"negative": False, "proven": True} and not ok("No rows.", [("SELECT max(d) FROM t", {"p"})], {"p", "q"})["proven"]
    assert ok("No rows.", [("SELECT 1", {"p"}), ("SELECT DISTINCT d FROM t", {"q"})], {"p", "q"})["proven"] and not ok("No rows.", [("SELECT 1", {"p"})], {"p"})["diagnosed"]

"""Calls of served models, and stores that stay in place."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from qaforge.plans import models
from qaforge.sources import buckets


def test_checked_pairs():
    good = {"question": "q?", "answer": "a", "context": None, "confidence": 1, "more": 2}
    assert models.checked_pairs([good]) == [{"question": "q?", "answer": "a", "context": None, "confidence": 1.0}] and models.checked_pairs([]) == []
    for bad in (None, {}, ["x"], [good, {"question": "q"}], [{**good, "answer": " "}], [{**good, "confidence": 2}], [{**good, "confidence": True}], [{**good, "context": 3}]):
        with pytest.raises(models.InvalidAnswer):
            models.checked_pairs(bad)


def test_an_invalid_answer_is_asked_for_again():
    asked = []

    def ask(text, reason):
        asked.append(reason)
        return [{"question": text, "answer": "a"}] if len(asked) == 3 else [{"question": ""}] if reason else "no list"

    assert models.asked_again(ask, "t", 3)[0]["question"] == "t"
    assert asked[0] is None and "not str" in asked[1] and "pair 0" in asked[2]
    with pytest.raises(models.InvalidAnswer):
        models.asked_again(lambda *_: None, "t", 2)


def test_called_pairs(spark):
    def call():
        def ask(text, reason):
            if text == "late":
                time.sleep(3)
            if text == "bad" and reason is None:
                return [{"question": "no answer"}]
            if text == "worse":
                return "never a list"
            if text == "broken":
                raise OSError("service is down")
            return [{"question": f"{w}?", "answer": text, "context": text, "confidence": 0.5} for w in text.split()]

        return ask

    rows = [(i, f"w{i} x") for i in range(40)] + [(100, "late"), (101, "bad"), (102, "worse"), (103, "broken"), (104, ""), (105, None), (106, "  "), (1, "w1 x"), (None, "no key")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, text string, key string")
    got = models.called_pairs(df, "page_id", call, concurrency=4, timeout=1.0, tasks=3).collect()
    want = [(i, k, f"{w}?", t, t, 0.5, None) for i, t in rows if t and t not in ("late", "worse", "broken") for k, w in enumerate(t.split())]
    assert sorted((tuple(r) for r in got if r["index"] >= 0), key=repr) == sorted(want, key=repr)
    errors = {r["page_id"]: r["error"] for r in got if r["index"] < 0}
    assert set(errors) == {100, 102, 103} and "within" in errors[100] and "not str" in errors[102] and "down" in errors[103]
    assert models.called_pairs(df.limit(0), "page_id", call).count() == 0


def test_calls_overlap(spark):
    """Forty calls of a fifth of a second in one task: eight seconds one by one."""

    def call():
        lock, state = threading.Lock(), {"now": 0, "most": 0}

        def ask(text, reason):
            with lock:
                state["now"] += 1
                state["most"] = max(state["most"], state["now"])
            time.sleep(0.2)
            with lock:
                state["now"] -= 1
                return [{"question": f"{text}?", "answer": str(state["most"])}]

        return ask

    df = spark.range(40).select(F.col("id").alias("k"), F.concat(F.lit("t"), "id").alias("text"))
    models.called_pairs(df.limit(1), "k", call, tasks=1).collect()
    began = time.time()
    got = models.called_pairs(df, "k", call, concurrency=10, tasks=1).collect()
    assert len(got) == 40 and time.time() - began < 6
    assert 5 <= max(int(r["answer"]) for r in got) <= 10


def between(plan: str, path: str) -> list[str]:
    """The operators of a plan's text between the scan of a path and the join above it."""
    above = []
    for line in plan.split("\n"):
        depth = len(line) - len(line.lstrip(" :+-"))
        above = [(d, x) for d, x in above if d < depth]
        if path in line:
            out = []
            for _, x in reversed(above):
                if "Join" in x:
                    return out
                out.append(x.strip(" :+-"))
        above.append((depth, line))
    raise AssertionError(plan)


def test_a_store_stays_in_place(spark, tmp_path):
    rows = [(f"k{i % 700}", i) for i in range(1000)] + [("hot", i) for i in range(500)] + [(None, 0)]
    store = buckets.write_bucketed(spark.createDataFrame(rows, "id string, n long"), "probe_store", str(tmp_path / "probe_store"), buckets=8)
    assert store.count() == len(rows)
    batch = spark.createDataFrame([(f"k{i}", i) for i in range(600, 800)] + [("hot", 1)] * 300 + [(None, 2), ("k1", 3)], "id string, _key long")
    found = buckets.probed(batch, store)
    passed = between(found._jdf.queryExecution().executedPlan().toString(), "probe_store")
    assert passed and not any("Exchange" in x or "Sort" in x for x in passed)
    have = {k for k, _ in rows if k is not None}
    assert sorted((tuple(r) for r in found.collect()), key=repr) == sorted(((k, n, k in have) for k, n in [(f"k{i}", i) for i in range(600, 800)] + [("hot", 1)] * 300 + [(None, 2), ("k1", 3)]), key=repr)
    fresh = buckets.new_rows(batch, store)
    assert fresh.count() == 101 and fresh.columns == batch.columns
    buckets.append_bucketed(fresh.withColumnRenamed("_key", "n"), "probe_store")
    assert buckets.new_rows(batch, spark.table("probe_store")).select("id").collect() == [(None,)]
    assert not any("Exchange" in x for x in between(buckets.probed(batch, spark.table("probe_store"))._jdf.queryExecution().executedPlan().toString(), "probe_store"))
    spark.createDataFrame([("a",)], "id string").write.option("path", str(tmp_path / "plain")).saveAsTable("plain_store")
    with pytest.raises(ValueError):
        buckets.append_bucketed(fresh, "plain_store")

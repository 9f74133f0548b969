import random
from datetime import datetime, timedelta
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from qaforge.operators import catalog, dedup, export, qa, sequences, similarity, validate


def clock():
    return F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")


QA = "dataset_id string, seq long, id string, question string, confidence double, created_at timestamp_ntz"


def rows_of(spark, questions, confidence=None, dataset="d", minutes=None):
    start = datetime(2024, 1, 1)
    data = [(dataset, i, f"{i:08d}-{dataset}", q, (confidence or {}).get(i, 0.5), start + timedelta(minutes=(minutes or {}).get(i, i))) for i, q in enumerate(questions)]
    return spark.createDataFrame(data, QA)


GOLDEN = [
    ("What is Python programming language?", "What is Python programming?", 0.8571428571428571),
    ("What exactly is Python?", "What is Python?", 0.7894736842105263),
    ("New question 2?", "New question 1?", 0.9333333333333333),
    ("cad ab dcdadac", "   dbb bab  bd", 0.42857142857142855),
    ("   dbb bab  bd", "cad ab dcdadac", 0.35714285714285715),
    ("", "", 1.0),
    ("a", "", 0.0),
]
FOX = ("the quick brown fox jumps over the lazy dog. " * 10)


def test_golden_ratios(spark):
    cases = [*GOLDEN, (FOX[:198], "X" + FOX[:198], 0.9974811083123426), (FOX[:199], "X" + FOX[:199], 0.0)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a string, b string")
    got = {r["i"]: r["r"]["ratio"] for r in df.select("i", similarity.ratio_udf(-1.0)("a", "b").alias("r")).collect()}
    assert [got[i] for i in range(len(cases))] == [c[2] for c in cases]


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        now = [0]
        for j, y in enumerate(b):
            now.append(row[j] + 1 if x == y else max(row[j + 1], now[j]))
        row = now
    return row[-1]


@pytest.mark.parametrize("together", [1, 128, 10**9])
def test_common_subsequences(monkeypatch, together):
    """Steps taken together and one by one give what the plain table gives; a pair is given up only under its least length."""
    monkeypatch.setattr(sequences, "TOGETHER", together)
    monkeypatch.setattr(sequences, "TABLE", 300)
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcdé 😀") for _ in range(rng.choice([0, 1, 5, 63, 64, 65, 130, 200]))) for _ in range(50)]
    left, right = ([rng.choice([*texts, "\ud800x", "zzzz"]) for _ in range(400)] for _ in range(2))
    want = np.array([longest_common(a, b) for a, b in zip(left, right)])
    assert (sequences.common_subsequences(left, right, np.zeros(400)) == want).all()
    least = np.array([rng.randint(0, 130) for _ in left])
    got = sequences.common_subsequences(left, right, least)
    assert ((got == want) | (got == -1) & (want < least)).all() and (got == -1).any()
    assert len(sequences.common_subsequences([], [], np.zeros(0))) == 0
    long = "ab c" * 3000
    assert sequences.common_subsequences([long, long], [long[:-5], "x" * 9000], np.zeros(2)).tolist() == [len(long) - 5, 0]


def test_the_common_subsequence_bound_loses_nothing():
    rng = random.Random(3)
    texts = ["", "a", "ab", "aaaaaaaa"] + ["".join(rng.choice("abc de") for _ in range(rng.randint(0, 30))) for _ in range(60)]
    for t in list(texts[:40]):
        w = list(t)
        for _ in range(rng.randint(1, 4)):
            at = rng.randint(0, len(w))
            w[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "a", "é"])
        texts.append("".join(w))
    left, right = zip(*((a, b) for a in texts for b in texts))
    ratios = [SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right)]
    for threshold in (-1.0, 0.0, 0.3, 0.7, 0.8, 0.9, 1.0):
        may = similarity.may_reach(list(left), list(right), threshold)
        assert all(m for m, r in zip(may, ratios) if r >= threshold)
        assert threshold < 0.8 or sum(may) < 1.2 * sum(r >= threshold for r in ratios)


def test_candidates_lose_nothing():
    """Whatever the lengths, with and without popular characters, of both methods; and few pairs are left."""
    rng = random.Random(5)
    for letters in ("ab", "the on and tion re ÉXQZ12345,.日本🎉\ud800"):
        for size in (0, 1, 3, 40, 199, 215, 700):
            texts = ["", *("".join(rng.choice(letters) for _ in range(int(size * rng.uniform(0.8, 1.2)))) for _ in range(5))]
            for t in texts[1:]:
                texts += ["".join(rng.choice(["", c, c + rng.choice(letters)]) if rng.random() < share else c for c in t) for share in (0.05, 0.2, 0.4)]
            ratios = {(i, j): SequenceMatcher(None, a, b).ratio() for i, a in enumerate(texts) for j, b in enumerate(texts)}
            for threshold in (0.3, 0.8, 0.9):
                found = set(zip(*(x.tolist() for x in sequences.candidates(texts, texts, threshold))))
                assert {p for p, r in ratios.items() if r >= threshold} <= found
    prose = ["".join(rng.choice(["the ", "on ", "tion ", "re", "and ", "in", "of ", "es ", "qu", "Ver ", "k"]) for _ in range(120)) for _ in range(300)]
    assert len(sequences.candidates(prose, [*prose, prose[0] + "x"], 0.8)[0]) == 301
    # Many short texts take their steps together.
    short = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(60, 90))) for _ in range(200)]
    short += [t[:5] + "zz" + t[9:] for t in short[:50]]
    want = {(i, j) for i, a in enumerate(short) for j, b in enumerate(short) if (m := SequenceMatcher(None, a, b)).quick_ratio() >= 0.8 and m.ratio() >= 0.8}
    assert want <= set(zip(*(x.tolist() for x in sequences.candidates(short, short, 0.8))))


def test_texts_of_one_key_are_dealt_into_cells_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(similarity, "CELL_TEXTS", 8)
    rng = random.Random(8)
    texts = sorted({"".join(rng.choice("abcd ") for _ in range(rng.randint(8, 30))) for _ in range(60)})
    df = spark.createDataFrame([(t,) for t in texts], "a string").withColumn("k", F.lit(None).cast("string"))
    ours, theirs = similarity._dealt(df, df.withColumnRenamed("a", "b"), ["k"], 0.6)
    assert ours.groupBy("_cell").count().agg(F.max("count")).first()[0] < 24 and ours.select("_cell").distinct().count() > 20
    got = similarity.similar_texts(df, df.withColumnRenamed("a", "b"), ["k"], 0.6).collect()
    want = {(a, b): r for a in texts for b in texts if (r := SequenceMatcher(None, a, b).ratio()) >= 0.6}
    assert {(r["a"], r["b"]): r["ratio"] for r in got} == want and len(got) == len(want)


def test_totals(spark):
    rows = rows_of(spark, ["a question of mine", "a question of mine?", "other"]).unionByName(rows_of(spark, ["alone"], dataset="e"))
    found = similarity.totals(rows, similarity.analyze(rows, 0.8))
    assert {tuple(r) for r in found.collect()} == {("d", 3, 1), ("e", 1, 0)}
    gone = similarity.totals(rows, similarity.clean_report(rows, 0.8), "removed_records")
    assert {tuple(r) for r in gone.collect()} == {("d", 3, 1), ("e", 1, 0)}


@pytest.mark.parametrize("threshold", [1.0, 0.9, 0.8, 0.5, 0.0])
def test_pairs_match_the_loop(spark, threshold):
    rng = random.Random(5)
    base = ["What is the capital of France?", "How do airplanes fly so high?", "Why is the sky blue at noon?", ""]
    questions = []
    for _ in range(40):
        q = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            if q:
                q[rng.randrange(len(q))] = rng.choice("abc éß")
        questions.append("".join(q) if rng.random() < 0.7 else rng.choice(base))
    got = {(r["seq1"], r["seq2"]): r["similarity"] for r in similarity.similar_pairs(rows_of(spark, questions), threshold).collect()}
    want = {(i, j): r for i in range(40) for j in range(i + 1, 40) if (r := SequenceMatcher(None, questions[i], questions[j]).ratio()) >= threshold}
    assert got == want


def clean_loop(data, threshold):
    """One pair after the other; removed rows stay in play."""
    removed, details = [], {}
    for i in range(len(data)):
        for j in range(i + 1, len(data)):
            (_, qa_, ca, ta), (_, qb, cb, tb) = data[i], data[j]
            if SequenceMatcher(None, qa_, qb).ratio() < threshold:
                continue
            keep, gone = (i, j) if ca > cb or ca == cb and ta < tb else (j, i)
            if gone not in removed:
                removed.append(gone)
                details[gone] = keep
    return details


@pytest.mark.parametrize("threshold", [1.0, 0.85])
def test_clean_matches_the_loop(spark, threshold):
    rng = random.Random(6)
    base = ["What is the capital?", "What is the capitol?", "Who was it?", "Who was that?"]
    questions = [rng.choice(base) for _ in range(25)]
    confidence = {i: rng.choice([0.1, 0.5, 0.9]) for i in range(25)}
    minutes = {i: rng.randint(0, 3) for i in range(25)}
    df = rows_of(spark, questions, confidence, minutes=minutes)
    got = {r["remove_seq"]: r["keep_seq"] for r in similarity.losers(df, threshold).collect()}
    assert got == clean_loop([(i, q, confidence[i], minutes[i]) for i, q in enumerate(questions)], threshold)
    assert {r["seq"] for r in similarity.clean(df, threshold).collect()} == set(range(25)) - set(got)


def test_clean_keeps_confidence(spark):
    df = rows_of(spark, ["Same question here?"] * 2, {0: 0.3, 1: 0.95})
    assert [r["seq"] for r in similarity.clean(df, 0.99).collect()] == [1]
    assert similarity.clean(rows_of(spark, ["How do airplanes fly?", "What is Python?"]), 0.99).count() == 2


def test_report(spark):
    questions = ["What is Python programming language?", "What is Python programming?", "x" * 120, "x" * 120]
    rows = sorted(similarity.analyze(rows_of(spark, questions), 0.8).collect(), key=lambda r: r["place"])
    assert [(r["similarity"], r["record1_id"]) for r in rows] == [(1.0, "00000002"), (0.857, "00000000")]
    assert rows[0]["question1"] == "x" * 100 + "..."
    assert similarity.analyze(rows_of(spark, []).where("false"), 0.8).count() == 0


def test_a_report_is_numbered_in_slices(spark):
    """No task sorts all pairs of a dataset, and the places are those of one sort."""
    rng = random.Random(4)
    rows = rows_of(spark, [rng.choice(["What is Python?", "What was Python?", "Who is it then?", "Who was it then?"]) for _ in range(60)])
    report = similarity.analyze(rows, 0.8)
    got = [(r["similarity"], r["record1_id"], r["record2_id"]) for r in sorted(report.collect(), key=lambda r: r["place"])]
    pairs = similarity.similar_pairs(rows, 0.8).collect()
    assert got == [(r["rounded"], r["id1"][:8], r["id2"][:8]) for r in sorted(pairs, key=lambda r: (-r["rounded"], r["seq1"], r["seq2"]))]
    windows = [x for x in report._jdf.queryExecution().optimizedPlan().toString().split("\n") if "row_number()" in x]
    assert windows and all("_slice" in x.split("row_number()")[1] for x in windows)


def test_fuzzy_join_is_a_hash_join(spark):
    plan = similarity.similar_pairs(rows_of(spark, ["a", "b"]), 0.9)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert plan.split("== Physical Plan ==")[-1].count("ArrowEvalPython") <= 2  # one in the initial and the final plan


ITEM = "id string, seq long, question string, context string, source_url string"


def items(spark, values):
    df = spark.createDataFrame(values, "seq long, question string, context string, source_url string")
    from qaforge.functions.text import content_id

    return df.withColumn("id", content_id(F.col("question"), F.col("context"), F.col("source_url")))


def test_classes(spark):
    long = "A context that is long enough to be compared with others in this test. " * 2
    store = items(spark, [(0, "What is Python programming language?", long, "u"), (1, "New question 1?", long, "u"), (2, "New question 3?", long, "u")])
    batch = items(spark, [(10, "What is  Python programming language? ", long, "u"), (11, "New question 2?", long, "u"), (12, "New question 2?", long, "other"), (13, "Something else entirely?", long, "u"), (14, "New question 2?", "Other context", "u")])
    got = {r["seq"]: r for r in dedup.classify(batch, store, 0.9).collect()}
    assert {k: r["type"] for k, r in got.items()} == {10: "exact", 11: "similar", 12: "new", 13: "new", 14: "new"}
    ids = {r["seq"]: r["id"] for r in store.collect()}
    assert got[11]["duplicate_id"] == ids[1] and got[11]["similarity_score"] == pytest.approx(14 / 15)
    assert (got[10]["duplicate_id"], got[10]["similarity_score"], got[13]["duplicate_id"], got[13]["similarity_score"]) == (ids[0], 1.0, None, 0.0)


def test_contexts_are_compared_once_for_all_copies(spark, monkeypatch):
    """Copies make no pairs of their own, and no context goes along with a pair of questions."""
    kept = []
    monkeypatch.setattr(dedup, "staged", lambda df, label: kept.append((label, df)) or df)
    long = "A context that is long enough to be compared with others in this test. " * 3
    store = items(spark, [(i, "What is this question?", long + "x" * (i // 10), "u") for i in range(20)] + [(99, "What is this question?", "else", "u")])
    batch = items(spark, [(100 + i, "What is that question?", long, "u") for i in range(10)] + [(200, "What is that question?", "els", "u")])
    found = {r["seq"]: (r["type"], r["duplicate_id"]) for r in dedup.classify(batch, store, 0.8).collect()}
    first = store.where("seq = 0").first()["id"]
    assert found == {**{100 + i: ("similar", first) for i in range(10)}, 200: ("new", None)}
    (pairs,) = [df for label, df in kept if label == "pairs-of-classes"]
    assert pairs.count() == 2 and not {"ca", "cb"} & set(pairs.columns)


def test_a_batch_is_not_compared_with_itself(spark):
    store = items(spark, [(0, "Nothing alike at all", "c", "u")])
    batch = items(spark, [(1, "New question 1?", "ctx", "u"), (2, "New question 2?", "ctx", "u"), (3, "New question 2?", "ctx", "u")])
    found = dedup.ingest(batch, store, 0.9)
    assert {r["seq"]: r["type"] for r in found.collect()} == {1: "new", 2: "new", 3: "exact"}
    assert tuple(dedup.counters(found).first()) == (2, 1, 0)
    assert tuple(dedup.counters(dedup.ingest(batch.where("false"), store)).first()) == (0, 0, 0)


def test_build_rows(spark):
    df = spark.createDataFrame([("What?", "An answer", None, None, None, 3)], "question string, answer string, context string, confidence double, source_url string, index int")
    r = dedup.build_rows(df, clock()).first()
    assert (r["input"]["context"], r["input"]["index"], r["expected_output"]["confidence"]) == ("", 3, 1.0)
    assert (r["qa_metadata"]["question_length"], r["qa_metadata"]["context_length"], r["qa_metadata"]["content_hash"]) == (5, 0, r["id"])
    for q, a in (("", "x"), ("x", None)):
        with pytest.raises(Exception, match="required"):
            dedup.build_rows(spark.createDataFrame([(q, a, "c", 1.0, "u", 0)], df.schema), clock()).collect()


def test_validation(spark):
    good = ("g", " Is this right", "It is right, and long enough.", "c" * 50, None)
    cases = [good, ("a", "short", "x" * 20, "c" * 50, 0.5), ("b", "q" * 501, "x" * 20, "c" * 50, 0.5), ("c", "Is this right?", "x" * 19, "c" * 50, 0.5), ("d", "Is this right?", "x" * 20, "c" * 49, 0.5), ("e", "Is this right?", "x" * 20, "c" * 50, 1.1), ("f", None, "x" * 20, "c" * 50, 1.0), ("g", "Is this right?", "x" * 20, "c" * 50, 1.0)]
    df = spark.createDataFrame(cases, "page string, question string, answer string, context string, confidence double")
    kept = validate.valid_rows(df).collect()
    assert sorted((r["page"], r["question"]) for r in kept) == [("g", "Is this right?"), ("g", "Is this right?")]
    assert validate.valid_rows(df.withColumn("page", F.lit("one")), batch="page").count() == 0
    assert validate.required(df, "question", "answer", strict=False).count() == 7


def test_coercions(spark):
    df = spark.createDataFrame([("0.5",), ("x",), (None,), ("7",), ("-1",)], "t string")
    got = df.select(validate.confidence_or_one(F.col("t")), validate.threshold(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [(0.5, 0.5), (1.0, 0.9), (1.0, 0.9), (7.0, 1.0), (-1.0, 0.0)]


SETS = "id string, name string, description string, created_at timestamp_ntz"


def test_catalogue(spark):
    none = spark.createDataFrame([], SETS)
    first = catalog.create(none, spark.createDataFrame([("a", "old")], "name string, description string"), clock())
    both = catalog.get_or_create(first, spark.createDataFrame([("a", "new"), ("b", None)], "name string, description string"), clock())
    assert {r["name"]: r["description"] for r in both.collect()} == {"a": "old", "b": "Questions and answers: b"}
    with pytest.raises(ValueError):
        catalog.create(both, spark.createDataFrame([("b", "x")], "name string, description string"), clock())
    with pytest.raises(LookupError):
        catalog.found(both, "nowhere")
    id_a = catalog.found(both, "a", "name").first()["id"]
    assert catalog.described(both, id_a, "changed").where(F.col("id") == id_a).first()["description"] == "changed"
    assert [r["name"] for r in catalog.listed(both).collect()] == [r["name"] for r in both.orderBy("id").collect()]


def stored(spark, n):
    df = spark.createDataFrame([(i, f"Question {i}?", "An answer", "c", 0.5, "u", 0) for i in range(n)], "seq long, question string, answer string, context string, confidence double, source_url string, index int")
    df = df.withColumns({"dataset_id": catalog.dataset_id(F.lit("a")), "created_at": F.timestamp_add("MINUTE", F.col("seq").cast("int"), clock())})
    return dedup.build_rows(df, clock())


def test_pages_changes_and_deletion(spark):
    sets = catalog.create(spark.createDataFrame([], SETS), spark.createDataFrame([("a", "x")], "name string, description string"), clock())
    rows, id_a = stored(spark, 15), sets.first()["id"]
    seen = [qa.page(rows, sets, id_a, 5, at).collect() for at in (0, 5, 10)]
    assert [len(p) for p in seen] == [5, 5, 5] and seen[0][0]["question"] == "Question 14?" and seen[0][0]["total_count"] == 15
    assert catalog.headers(sets, rows).first()["qa_sources_count"] == 15
    one = rows.where("seq = 3").first()["id"]
    assert qa.detail(rows, sets).where(F.col("id") == one).first()["dataset"]["name"] == "a"
    assert qa.updated(rows, one, seq=F.lit(99)).where("seq = 99").count() == 1
    with pytest.raises(LookupError):
        qa.updated(rows, "nothing", seq=F.lit(1))
    assert qa.without(rows, rows.where("seq < 3").select("id")).count() == 12
    with pytest.raises(ValueError):
        qa.inserted(rows, rows.limit(1))
    pages = spark.createDataFrame([("p", id_a), ("q", "other")], "id string, dataset_id string")
    cleaned = spark.createDataFrame([("1", "p"), ("2", "q")], "id string, page_snapshot_id string")
    left = catalog.deleted(sets.select("id"), sets, rows, pages, cleaned)
    assert [left[k].count() for k in ("datasets", "qa", "snapshots", "cleaned")] == [0, 0, 1, 1]
    assert left["counts"].first()["records_deleted"] == 15
    assert catalog.orphans(rows, left["datasets"]).count() == 15


def test_a_page_is_taken_by_a_heap(spark):
    sets = catalog.create(spark.createDataFrame([], SETS), spark.createDataFrame([("a", "x")], "name string, description string"), clock())
    plan = qa.page(stored(spark, 3), sets, sets.first()["id"], 5, 0)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan


def test_export(spark, tmp_path):
    rows = stored(spark, 5)
    shown = export.preview(rows).collect()
    assert len(shown) == 3 and shown[0]["total_items"] == 5 and shown[0]["preview_note"] == "Showing 3 items out of 5 total"

    twice = export.preview(rows.unionByName(rows.withColumn("dataset_id", F.lit("other")))).groupBy("dataset_id").count().collect()
    assert {r["count"] for r in twice} == {3}
    again = export.preview(rows.where("seq = 0").unionByName(rows.where("seq = 0")), 5)
    assert [(r["place"], r["total_items"]) for r in again.orderBy("place").collect()] == [(1, 2), (2, 2)]

    def sink():
        def put(row):
            if row["n"] == 1:
                raise RuntimeError("no")

        return put

    sent = export.send(spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "id string, n int"), sink)
    assert tuple(export.outcome(sent).first()) == (2, 1)
    assert sent.where("status = 'failed'").first()["error"] == "no"
    files = spark.createDataFrame([("/x/my_file.json", [(None, "q", "a", None, None), ("k", "q2", "a2", 0.5, "c")])], "name string, items array<struct<id:string,question:string,answer:string,confidence:double,context:string>>")
    got = export.file_items(files, F.col("name")).collect()
    assert [(r["dataset"], r["id"], r["confidence"], r["context"], r["total_items"]) for r in got] == [("my-file", "item_0", 1.0, "", 2), ("my-file", "k", 0.5, "c", 2)]
    bad = spark.createDataFrame([("/x/f.json", [("k", None, "a", 0.5, "c")])], files.schema)
    with pytest.raises(Exception, match="question and answer are required"):
        export.file_items(bad, F.col("name")).collect()
    for kind in ("jsonl", "csv", "json"):
        export.write(rows.coalesce(1), str(tmp_path / kind), kind)
    assert spark.read.json(str(tmp_path / "jsonl")).count() == 5
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 5
    assert spark.read.option("multiLine", True).json(str(tmp_path / "json")).count() == 5
    with pytest.raises(ValueError):
        export.write(rows, str(tmp_path / "x"), "xml")


def _many_copies(spark, n: int):
    """Questions with copies, near copies and empty ones, in two datasets, of mixed confidence and age."""
    import random

    of, words = random.Random(5), "what is the old red house on a hill by our small lake called now".split()
    texts = [" ".join(of.choice(words) for _ in range(of.choice([3, 8, 60]))) + "?" for _ in range(n // 6)]
    texts += [t[:-1] + of.choice(["!", " x?", "??"]) for t in texts[: n // 12]] + ["", None]
    rows = [(of.choice("de"), i, f"{i:09d}", of.choice(texts), of.choice([0.0, 0.5, 1.0, None]), of.choice([None, "2024-01-01 00:00:00", "2024-01-02 00:00:00"])) for i in of.sample(range(3 * n), n)]
    qa_ = spark.createDataFrame(rows, "dataset_id string, seq long, id string, question string, confidence double, created_at string")
    return qa_.withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


def test_pairs_are_numbered_and_cleaned_without_being_made(spark, monkeypatch):
    """What lists and steps of rows give equals what all pairs give, in cells of any size."""
    monkeypatch.setattr(similarity, "CELL_TEXTS", 7)
    monkeypatch.setattr(similarity, "SLICES", 5)
    rows, sort = _many_copies(spark, 150).cache(), lambda df: sorted(map(tuple, df.collect()))
    for threshold in (1.0, 0.8):
        report = sort(similarity.analyze(rows, threshold))
        assert len(report) > 100 and report == sort(similarity._analyzed_pairs(rows, threshold))
    lost = sort(similarity.losers(rows, 0.8))
    assert len(lost) > 20 and lost == sort(similarity._lost_pairs(rows, 0.8).select("dataset_id", "remove_seq", "keep_seq", "similarity"))
    twice = rows.unionByName(rows.limit(9))
    assert similarity.analyze(twice, 1.0).count() == similarity.similar_pairs(twice, 1.0).count()
    rows.unpersist()


def test_shuffled_bytes_follow_rows_not_pairs(spark):
    """600 equal questions are 179,700 pairs, which are made by the last join."""
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    rows = spark.range(600).select(F.lit("d").alias("dataset_id"), F.col("id").alias("seq"), F.sha2(F.col("id").cast("string"), 256).alias("id"), F.lit("What is it?").alias("question"), F.lit(1.0).alias("confidence"), F.timestamp_add("MINUTE", F.col("id").cast("int"), clock()).alias("created_at"))
    for step, n in ((lambda: similarity.analyze(rows, 1.0), 179_700), (lambda: similarity.losers(rows, 0.8), 599)):
        before = written()
        got = step().agg(F.count("*"), *([F.min("place"), F.max("place")] if n > 600 else [F.max("keep_seq")])).first()
        assert tuple(got) == ((n, 1, n) if n > 600 else (n, 0))
        assert written() - before < 300_000


def test_contexts_are_shuffled_by_row_not_by_pair(spark):
    """One question with many contexts of the same letters: 6400 pairs of contexts, of which one is similar."""
    of, words = random.Random(9), [f"{x}{y}" for x in "abcdefghij" for y in ("lo", "men", "ta", "rudi", "ses", "ki")] * 5
    texts = [" ".join(of.sample(words, len(words))) for _ in range(160)]
    texts[100] = texts[7][:-3] + "end"
    rows = [(f"i{n}", n, "What is it?" if n % 2 else "What is it then?", t, "u") for n, t in enumerate(texts)]
    both = spark.createDataFrame(rows, "id string, seq long, question string, context string, source_url string")
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    before, key = written(), "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(key, -1)
    got = dedup.classify(both.where("seq < 80"), both.where("seq >= 80"), 0.8, 0.95).collect()
    spark.conf.unset(key)
    assert written() - before < 1_000_000
    assert [(r["seq"], r["duplicate_id"]) for r in got if r["type"] != "new"] == [(7, "i100")] and len(got) == 80


def test_candidates_in_both_orders(spark):
    """A text pair that is similar in one order only is found, whichever comes first; difflib's ratio depends on the order."""
    import random
    from difflib import SequenceMatcher

    of = random.Random(3)
    texts = ["".join(of.choice("abcdefgh" * 4 + "xyzuvwqjk") for _ in range(of.randint(150, 260))) for _ in range(12)]
    texts += ["".join(x for x in t if of.random() > 0.06) for t in texts] + ["".join(of.choice("ab") if of.random() < 0.1 else x for x in t) for t in texts]
    for threshold in (0.6, 0.8, 0.9):
        reached = {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if SequenceMatcher(None, a, b).ratio() >= threshold}
        once = {tuple(sorted(x)) for x in zip(*(x.tolist() for x in sequences.candidates(texts, texts, threshold, both=True, once=True)))}
        half = set(zip(*(x.tolist() for x in sequences.candidates(texts[:18], texts[18:], threshold, both=True))))
        assert reached and {tuple(sorted(x)) for x in reached} <= once
        assert {(min(x), max(x) - 18) for x in reached if min(x) < 18 <= max(x)} <= half


def test_json_arrays_are_bounded(spark, tmp_path, monkeypatch):
    """A reader holds a file's array as a whole, so a partition of any size is cut into several files."""
    import json

    monkeypatch.setattr(export, "ARRAY_CHARS", 1000, raising=False)
    rows = stored(spark, 40).coalesce(1)
    export.write(rows, str(tmp_path / "many"), "json")
    files = sorted((tmp_path / "many").glob("part-*"))
    arrays = [json.loads(f.read_text()) for f in files]
    assert len(files) > 5 and all(arrays) and max(f.stat().st_size for f in files) < 1200
    assert sorted(x["question"] for a in arrays for x in a) == sorted(r["question"] for r in qa.flat(rows).collect())
    export.write(rows.limit(0).coalesce(1), str(tmp_path / "none"), "json")
    assert spark.read.schema("id string").option("multiLine", True).json(str(tmp_path / "none")).count() == 0


def test_the_bytes_of_a_batch_are_bounded(spark, tmp_path):
    """Rows are long texts: a batch of them by number alone takes the memory of an executor's Python."""
    from qaforge.llm import decontamination, packing

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    rows = dedup.build_rows(spark.createDataFrame([("What?", "An answer", "c", 1.0, "u", 0, "d")], "question string, answer string, context string, confidence double, source_url string, index int, dataset_id string"), clock()).withColumn("created_at", clock())
    before = spark.conf.get(key, None)
    for step in (lambda: export.write(rows, str(tmp_path / "out"), "json"), lambda: decontamination.proximity_matches(docs, docs.select(F.col("doc_id").alias("item_id"), "text")), lambda: packing.document_pieces(docs, "none")):
        spark.conf.unset(key)
        step()
        assert spark.conf.get(key, None) == "4m"
    spark.conf.set(key, before) if before else spark.conf.unset(key)

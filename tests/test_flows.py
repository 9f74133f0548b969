import io
import json
import urllib.error

import pytest
from pyspark.sql import functions as F

from qaforge.plans import flows, models
from qaforge.schema import EngineConfig
from qaforge.sources import files, rest
from qaforge.streaming import ingest

LINE = "The tower of the old town was built a long time ago by people whose names nobody knows."
HTML = f"<html><body><p>{LINE}</p></body></html>"
EMPTY = "id string, seq long, question string, context string, source_url string"


def pages(spark, n, start=0):
    return spark.createDataFrame([(i, f"https://e.org/{i}", HTML.replace("old", f"old{i}")) for i in range(start, start + n)], "page_id long, url string, html string")


def test_generate_and_repeat(spark):
    first = flows.generate(pages(spark, 3), spark.createDataFrame([], EMPTY))
    assert [r["type"] for r in first.collect()] == ["new"] * 3
    again = flows.generate(pages(spark, 3), first.select("id", "seq", "question", "context", "source_url"))
    assert [r["type"] for r in again.collect()] == ["exact"] * 3


def test_generated_pairs_hold_their_rules(spark):
    text = "\n".join([LINE, "short", LINE.upper()])
    got = spark.createDataFrame([(text,)], "t string").select(models.offline_generator(F.col("t")).alias("p")).first()["p"]
    assert len(got) == 2
    assert all(p["context"] in text and p["question"].endswith("?") and 0 <= p["confidence"] <= 1 for p in got)


def test_served_models(spark):
    df = spark.createDataFrame([(" Text [1] ",), (None,), ("bad",)], "t string")

    def cleaner():
        def clean(t):
            if t == "bad":
                raise RuntimeError
            return "" if t.startswith(" ") else t

        return clean

    assert [r[0] for r in df.select(models.served_cleaner(cleaner)(F.col("t"))).collect()] == ["Text [1]", None, "bad"]

    def generator():
        def run(t):
            if t == "bad":
                raise RuntimeError
            return [{"question": "q", "answer": t}]

        return run

    got = [r[0] for r in df.select(models.served_generator(generator)(F.col("t"))).collect()]
    assert [len(x) for x in got] == [1, 1, 0] and got[0][0]["confidence"] is None
    assert models.catalogue(spark, lambda: [{"id": "m"}]).count() == 1
    assert models.catalogue(spark, lambda: 1 / 0).count() == 0
    cleaned = [r[0] for r in spark.createDataFrame([(" a[12] b [edit]\nMenu\n",), ("[1]",), ("x" * 10_001,)], "t string").select(models.offline_cleaner(F.col("t"))).collect()]
    assert cleaned[:2] == ["a b", "[1]"] and len(cleaned[2]) == 10_000


def test_a_served_model_is_called_once_for_each_page(spark):
    calls = spark.sparkContext.accumulator(0)

    def generator():
        def run(t):
            calls.add(1)
            return [{"question": f"What is said about {t[:20]}?", "answer": t, "context": t, "confidence": 0.5}]

        return run

    store = spark.createDataFrame([("x", 1, "What is said about nothing?", "none", "https://e.org/1")], EMPTY)
    found = flows.generate(pages(spark, 4), store, generator=models.served_generator(generator))
    assert found.count() == 4 and found.where("type = 'new'").count() == 4 and calls.value == 4
    with pytest.raises(ValueError, match="is not among"):
        flows.generate(pages(spark, 1), store, EngineConfig(models=("one",)), models=("one", "two"))


def test_enrich(spark):
    df = spark.createDataFrame([("f", "d", "\n".join([LINE] * 3)), ("e", "d", "")], "file_id string, dataset_id string, content string")
    rows = flows.enrich(df, EngineConfig(chunk_size=200, overlap=20), clock=F.lit("t")).collect()
    assert {r["file_id"] for r in rows} == {"f"} and {r["input"]["source_url"] for r in rows} == {"f"}
    assert max(r["chunk"] for r in rows) >= 1 and min(r["input"]["index"] for r in rows) == 0


def test_json_sources(spark, tmp_path):
    (tmp_path / "b.json").write_text('[{"question": "q", "answer": "a"}, {"id": "x", "question": "r", "answer": "b", "confidence": 0.5}]')
    (tmp_path / "a.json").write_text("[1, ")
    (tmp_path / "c.txt").write_text("")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "d.json").write_text("[]")
    assert files.json_items(spark, str(tmp_path / "b.json")).count() == 2
    for bad in (tmp_path / "none.json", tmp_path):
        with pytest.raises(FileNotFoundError):
            files.json_items(spark, str(bad))
    with pytest.raises(Exception):
        files.json_items(spark, str(tmp_path / "a.json")).collect()
    assert [r["name"] for r in files.json_files(spark, str(tmp_path)).collect()] == ["a.json", "b.json"]
    assert files.json_files(spark, str(tmp_path / "none")).count() == 0
    known = spark.createDataFrame([("k", [("f1",), ("f2",)]), ("l", [])], "knowledge_id string, files array<struct<id:string>>")
    assert [r["file_id"] for r in files.exploded_files(known.where("knowledge_id = 'k'")).collect()] == ["f1", "f2"]
    with pytest.raises(Exception, match="No files"):
        files.exploded_files(known).collect()


class Answer(io.BytesIO):
    class headers:  # noqa: N801
        @staticmethod
        def get_content_charset():
            return "utf-8"


def test_session_retries():
    tries, pauses = [], []

    def opened(request, timeout):
        tries.append(request.full_url)
        if len(tries) < 3:
            raise urllib.error.HTTPError(request.full_url, 503, "busy", {}, None)
        return Answer("é".encode())

    assert rest.Session(EngineConfig(), opened, pauses.append).get("http://x") == "é"
    assert len(tries) == 3 and pauses == [0.3, 0.6]

    def missing(request, timeout):
        raise urllib.error.HTTPError(request.full_url, 404, "no", {}, None)

    with pytest.raises(urllib.error.HTTPError):
        rest.Session(EngineConfig(), missing, pauses.append).get("http://x")
    assert len(pauses) == 2


def fake_session():
    def opened(request, timeout):
        url = request.full_url
        if url.endswith("bad"):
            raise urllib.error.HTTPError(url, 404, "no", {}, None)
        return Answer(json.dumps({"url": url}).encode())

    return rest.Session(EngineConfig(delay=0), opened, lambda s: None)


def test_fetch_and_details(spark):
    got = {r["url"]: r for r in rest.fetch(spark.createDataFrame([("http://a/1",), ("http://a/bad",)], "url string"), EngineConfig(delay=0), ["x"], fake_session, 2).collect()}
    assert got["http://a/1"]["error"] is None and got["http://a/bad"]["html"] is None and got["http://a/1"]["user_agent"] == "x"
    listing = spark.createDataFrame([(0, "one"), (1, ""), (2, None), (3, "bad"), (4, "two")], "place int, id string")
    found = rest.details(listing, "http://a/{id}", config=EngineConfig(delay=0), session=fake_session)
    assert set(rest.by_key(found).first()["details"]) == {"one", "two"}
    assert rest.details(listing, "http://a/{id}", n=1, config=EngineConfig(delay=0), session=fake_session).count() == 1


def test_knowledge_base(spark):
    asked = spark.sparkContext.accumulator(0)

    def session():
        class Service:
            def get(self, url, headers=None):
                path = url.removeprefix("http://k/")
                if path == "health":
                    return '{"status": true}'
                assert headers["Authorization"] == "Bearer secret"
                asked.add(1)
                if path.endswith("/gone"):
                    raise urllib.error.HTTPError(url, 404, "not found", {}, None)
                if path == "api/v1/knowledge/":
                    return '[{"id": "k1", "name": "é"}]'
                return '{"content": "text of a file"}' if "/files/" in path else '{"id": "k1", "files": [{"id": "f"}]}'

            def sleep(self, seconds):
                pass

        return Service()

    base = rest.KnowledgeBase("http://k/", "secret", session=session)
    assert base.health() == {"status": True}
    listed = base.collections(spark)
    assert listed.first()["id"] == "k1" and "é" in listed.first()["detail"]
    ids = listed.select("id").unionByName(spark.createDataFrame([("gone",), ("",), (None,)], "id string"))
    got = {r["id"]: r for r in base.knowledge(ids).collect()}
    assert set(got) == {"k1", "gone"} and got["gone"]["status"] == 404 and got["gone"]["detail"] is None and '"files"' in got["k1"]["detail"]
    assert [r["content"] for r in base.contents(spark.createDataFrame([("f/1",)], "id string")).collect()] == ["text of a file"]
    with pytest.raises(ConnectionError):
        rest.KnowledgeBase("http://k", "x", session=lambda: 1 / 0 if False else type("S", (), {"get": lambda self, *a: (_ for _ in ()).throw(OSError("down"))})()).health()


def test_streaming_ingest(spark, tmp_path):
    source, store, mark = (str(tmp_path / x) for x in ("in", "store", "mark"))
    pages(spark, 2).coalesce(1).write.mode("append").parquet(source)
    ingest.ingest(ingest.page_stream(spark, source), store, mark).awaitTermination()
    assert spark.read.parquet(store).count() == 2
    pages(spark, 3).coalesce(1).write.mode("append").parquet(source)
    ingest.ingest(ingest.page_stream(spark, source), store, mark).awaitTermination()
    got = spark.read.parquet(store)
    assert got.count() == 3 and got.select("id").distinct().count() == 3

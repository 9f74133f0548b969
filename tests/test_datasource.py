"""Data sources and the sink against a local server."""

import json
import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import Row

from qaforge.sources import datasource


class Server:
    """Pages, a listing, and a service that takes rows; it remembers what it was asked."""

    def __init__(self):
        own = self
        self.asked, self.taken, self.agents, self.refuse, self.down = Counter(), [], {}, set(), 0

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                own.asked[self.path] += 1
                own.agents[self.path] = self.headers.get("User-Agent")
                if self.path.startswith("/page/"):
                    return self.answer(200, f"<body>{self.path} {own.asked[self.path]} é</body>")
                if self.path == "/flaky" and own.asked[self.path] < 3:
                    return self.answer(503, "later")
                if self.path == "/flaky":
                    return self.answer(200, "at last")
                if self.path == "/list":
                    ok = self.headers.get("Authorization") == "Bearer secret"
                    return self.answer(200 if ok else 401, json.dumps([{"id": "a"}, {"id": None}, "b", {"id": "gone"}, {"id": ""}, {"id": "d"}]))
                if self.path.startswith("/item/") and not self.path.endswith("gone"):
                    return self.answer(200, json.dumps({"item": self.path, "é": 1}, ensure_ascii=False))
                return self.answer(404, "")

            def do_POST(self):
                row = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
                if row["id"] in own.refuse:
                    return self.answer(400, "")
                own.taken.append((row, self.headers.get("Idempotency-Key")))
                return self.answer(201, "{}")

            def answer(self, code, text):
                body = text.encode()
                self.send_response(code)
                self.send_header("Content-Type", "text/html; charset=utf-8")
                self.send_header("Content-Length", str(len(body)))
                self.end_headers()
                self.wfile.write(body)

            def log_message(self, *_):
                pass

        self.http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.url = f"http://127.0.0.1:{self.http.server_address[1]}"
        threading.Thread(target=self.http.serve_forever, daemon=True).start()


@pytest.fixture
def server():
    s = Server()
    yield s
    s.http.shutdown()


@pytest.fixture
def known(spark):
    datasource.register(spark)
    return spark


FAST = {"delay": "0", "backoff": "0"}


def test_pages(known, server, tmp_path):
    urls = [f"{server.url}/page/{i}" for i in range(5)]
    (tmp_path / "urls").write_text("\n".join([*urls, "", urls[0], f"{server.url}/flaky", f"{server.url}/none"]))
    df = known.read.format("qaforge_pages").options(**FAST, list=str(tmp_path / "urls"), parallelism="3", agents="x/1\nx/2").load()
    assert df.rdd.getNumPartitions() == 3
    got = {r["url"]: r for r in df.collect()}
    assert len(got) == 7 and got[urls[2]]["html"] == "<body>/page/2 1 é</body>" and got[urls[2]]["error"] is None
    assert got[f"{server.url}/flaky"]["html"] == "at last" and got[f"{server.url}/none"]["html"] is None and "404" in got[f"{server.url}/none"]["error"]
    assert all(server.agents[f"/page/{i}"] == got[urls[i]]["user_agent"] in ("x/1", "x/2") for i in range(5))
    assert known.read.format("qaforge_pages").options(**FAST, urls="").load().count() == 0
    with pytest.raises(Exception, match="urls or list"):
        known.read.format("qaforge_pages").load().count()


def test_a_stream_of_pages_goes_on_where_it_stopped(known, server, tmp_path):
    listed, out, checkpoint = tmp_path / "urls", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    since = str(time.time() - 1)

    def run(every):
        stream = known.readStream.format("qaforge_pages").options(**FAST, list=str(listed), since=since, every=every).load()
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert not query.isActive and query.exception() is None
        return Counter(r["url"].rsplit("/", 1)[1] for r in known.read.parquet(out).collect())

    page = lambda i: f"{server.url}/page/{i}"
    listed.write_text("\n".join(page(i) for i in range(3)))
    assert run("1000000") == Counter("012")
    assert run("1000000") == Counter("012")  # nothing is due
    listed.write_text("\n".join(page(i) for i in range(5)))
    assert run("1000000") == Counter("01234")  # only the new URLs
    assert all(server.asked[f"/page/{i}"] == 1 for i in range(5))
    time.sleep(0.1)
    assert run("0.5") == Counter("0011223344")  # a new round, however many were missed
    assert all(server.asked[f"/page/{i}"] == 2 for i in range(5))


def test_offsets_of_a_stream(tmp_path):
    stream = datasource.PagesStream({"urls": "\n".join(f"u{i}" for i in range(10)), "parallelism": "4", "since": str(time.time() - 25), "every": "10"})
    assert stream.initialOffset() == {"round": 0, "n": 0} and stream.latestOffset() == {"round": 2, "n": 10}
    due = lambda a, b: sorted(u for p in stream.partitions({"round": a[0], "n": a[1]}, {"round": b[0], "n": b[1]}) for u in p.urls)
    everything = sorted(f"u{i}" for i in range(10))
    assert due((0, 0), (0, 10)) == everything == due((0, 10), (2, 10)) and due((1, 4), (1, 6)) == ["u4", "u5"] and due((1, 10), (1, 10)) == []


def test_listing_and_details(known, server):
    read = lambda **o: known.read.format("qaforge_rest").options(**FAST, **{"listing": f"{server.url}/list", "detail": f"{server.url}/item/{{id}}", "token": "secret", **o}).load()
    got = {r["id"]: r for r in read().collect()}
    assert sorted(got) == ["a", "b", "d"] and json.loads(got["b"]["detail"]) == {"item": "/item/b", "é": 1}
    kept = {r["id"]: r for r in read(failures="keep").collect()}
    assert kept["gone"]["status"] == 404 and kept["gone"]["detail"] is None and len(kept) == 4
    assert sorted(r["id"] for r in read(limit="3").collect()) == ["a", "b"]
    with pytest.raises(Exception, match="401"):
        read(token="wrong").count()
    with pytest.raises(Exception, match="listing"):
        known.read.format("qaforge_rest").load().count()


def test_the_sink(known, server, tmp_path):
    ledger = str(tmp_path / "ledger")
    rows = known.createDataFrame([(f"r{i}", i, [f"é{i}"]) for i in range(20)], "id string, n int, tags array<string>").repartition(3)
    assert datasource.undelivered(rows, ledger).count() == 20
    server.refuse = {"r3", "r7"}
    write = lambda df: df.write.format("qaforge_sink").mode("append").options(**FAST, url=server.url, ledger=ledger, retries="1").save()
    write(rows)
    assert len(server.taken) == 18 and all(row["id"] == key and row["tags"] == [f"é{row['n']}"] for row, key in server.taken)
    assert [(r["status"], r["created"], r["failed"], r["skipped"]) for r in datasource.runs(ledger)] == [("committed", 18, 2, 0)]
    left = datasource.undelivered(rows, ledger)
    assert sorted(r["id"] for r in left.collect()) == ["r3", "r7"]
    assert {(r["id"], r["status"]) for r in datasource.ledger(known, ledger).where("status = 'failed'").collect()} == {("r3", "failed"), ("r7", "failed")}
    server.refuse = set()
    write(left)
    assert len(server.taken) == 20 and datasource.undelivered(rows, ledger).count() == 0
    with pytest.raises(Exception, match="no column id"):
        write(rows.drop("id"))
    with pytest.raises(Exception):
        rows.write.format("qaforge_sink").mode("overwrite").options(url=server.url, ledger=ledger).save()


def test_a_task_that_runs_twice_delivers_once(server, tmp_path):
    writer = datasource.SinkWriter({**FAST, "url": server.url, "ledger": str(tmp_path / "ledger"), "run": "x"})
    rows = [Row(id=f"r{i}", n=i) for i in range(10)]

    def dying():
        yield from rows[:4]
        raise RuntimeError("executor lost")

    with pytest.raises(RuntimeError):
        writer.deliver(dying(), partition=2, attempt=11)
    with open(tmp_path / "ledger" / "run=x" / "000002-11.jsonl", "a") as f:
        f.write('{"id": "r4", "sta')  # it died while it wrote a line
    writer.deliver(iter([Row(id="r9", n=9)]), partition=3, attempt=12)  # another partition's ledger is not this one's
    again = writer.deliver(iter(rows[:9]), partition=2, attempt=13)
    assert (again.created, again.skipped, again.failed) == (5, 4, 0)
    assert Counter(row["id"] for row, _ in server.taken) == Counter(f"r{i}" for i in range(10))
    writer.abort([again, None])
    assert datasource.runs(str(tmp_path / "ledger"))[0]["status"] == "aborted"

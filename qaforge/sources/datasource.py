"""Pages and REST collections as Spark data sources, and a sink that delivers each row once.

`register(spark)` makes them known by name:

* `spark.read.format("qaforge_pages")` and `spark.readStream.format("qaforge_pages")`: pages of a list of URLs; the stream
  fetches them again from time to time and goes on where it stopped.
* `spark.read.format("qaforge_rest")`: a listing and the details of its items.
* `df.write.format("qaforge_sink")`: rows posted to a service, with a ledger of what was delivered.

Options are text. Lists of URLs and listings pass through the planner, so they are small (a line each); tables of URLs go
through `rest.fetch` instead.
"""

from __future__ import annotations

import hashlib
import json
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..schema import EngineConfig
from .rest import Session, bearer


def _files(uri: str):
    """A file system and a path in it; a path without a scheme is a local one."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:/", "file:///", 1))


def _session(options: dict[str, str]) -> Session:
    config = EngineConfig(max_retries=int(options.get("retries", 3)), timeout=float(options.get("timeout", 10)), delay=float(options.get("delay", 0.2)), backoff=float(options.get("backoff", 0.3)))
    return Session(config)


def _dealt(items: list, parts: int) -> list[list]:
    """Items dealt into parts of like size, empty ones left out."""
    return [items[i::parts] for i in range(min(parts, len(items)))]


# pages


@dataclass
class Urls(InputPartition):
    urls: list
    round: int


def url_list(options: dict[str, str]) -> list[str]:
    """URLs of the option `urls`, or of the file `list`, one a line; empty lines and repeated ones are left out."""
    if "urls" in options:
        text = options["urls"]
    elif "list" in options:
        files, path = _files(options["list"])
        with files.open_input_stream(path) as stream:
            text = stream.read().decode()
    else:
        raise ValueError("give the option urls or list")
    return list(dict.fromkeys(line.strip() for line in text.splitlines() if line.strip()))


def _pages(options: dict[str, str], part: Urls) -> Iterator[tuple]:
    session, agents = _session(options), [a for a in options.get("agents", "").splitlines() if a]
    for url in part.urls:
        digest = hashlib.sha256(url.encode()).hexdigest()
        agent = agents[int(digest[:8], 16) % len(agents)] if agents else None
        try:
            html, error = session.get(url, {"User-Agent": agent} if agent else None), None
        except Exception as failure:  # reported with its URL
            html, error = None, str(failure)
        yield url, digest, agent, html, error, part.round
        session.sleep(session.config.delay)


class PagesSource(DataSource):
    """url, url_hash, user_agent, html, error (one of the last two is null) and round of each page.

    Options: urls or list (of `url_list`), parallelism (8: tasks at once), agents (one a line; a URL's is picked by its hash),
    retries, timeout, delay (after each page) and backoff, all in seconds. For streams also since (seconds of the epoch at which
    round 0 began) and every (seconds from a round to the next; without it there is one round).
    """

    @classmethod
    def name(cls) -> str:
        return "qaforge_pages"

    def schema(self) -> str:
        return "url string, url_hash string, user_agent string, html string, error string, round int"

    def reader(self, schema) -> DataSourceReader:
        return PagesReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return PagesStream(dict(self.options))


class PagesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[Urls]:
        return [Urls(x, 0) for x in _dealt(url_list(self.options), int(self.options.get("parallelism", 8)))] or [Urls([], 0)]

    def read(self, partition: Urls) -> Iterator[tuple]:
        return _pages(self.options, partition)


class PagesStream(DataSourceStreamReader):
    """Offsets are a round and how many URLs of the list were asked for in it. They follow from the clock and the list alone, so a
    stream that stops goes on after its checkpoint: with URLs that joined the list since, and with all URLs once a new round
    is due. Rounds that were missed while it stood still are fetched once, as the last of them."""

    def __init__(self, options: dict[str, str]):
        self.options = options

    def initialOffset(self) -> dict:
        return {"round": 0, "n": 0}

    def latestOffset(self) -> dict:
        every = float(self.options.get("every", 0))
        due = int((time.time() - float(self.options.get("since", 0))) // every) if every > 0 else 0
        return {"round": max(0, due), "n": len(url_list(self.options))}

    def partitions(self, start: dict, end: dict) -> list[Urls]:
        urls = url_list(self.options)[: end["n"]]
        due = urls if end["round"] > start["round"] else urls[start["n"] :]
        return [Urls(x, end["round"]) for x in _dealt(due, int(self.options.get("parallelism", 8)))] or [Urls([], end["round"])]

    def read(self, partition: Urls) -> Iterator[tuple]:
        return _pages(self.options, partition)

    def commit(self, end: dict) -> None:
        """Nothing to do: offsets say all."""


# REST collections


@dataclass
class Ids(InputPartition):
    ids: list


class RestSource(DataSource):
    """id, detail (JSON text), status (of an HTTP error) and error of each item of a listing.

    Options: listing (a URL that answers with a JSON list of ids or of objects with an id), detail (a URL with {id}), limit (only
    the first so many of the list), failures (keep or drop, the default), token (a bearer's), parallelism and those of pages.
    Items without an id are skipped.
    """

    @classmethod
    def name(cls) -> str:
        return "qaforge_rest"

    def schema(self) -> str:
        return "id string, detail string, status int, error string"

    def reader(self, schema) -> DataSourceReader:
        return RestReader(dict(self.options))


class RestReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        for key in ("listing", "detail"):
            if key not in options:
                raise ValueError(f"give the option {key}")
        if options.get("failures", "drop") not in ("keep", "drop"):
            raise ValueError("failures must be keep or drop")
        self.options = options
        self.headers = bearer(options["token"]) if "token" in options else None

    def partitions(self) -> list[Ids]:
        found = json.loads(_session(self.options).get(self.options["listing"], self.headers))
        if "limit" in self.options:
            found = found[: int(self.options["limit"])]
        ids = [x.get("id") if isinstance(x, dict) else x for x in found]
        return [Ids(x) for x in _dealt([str(i) for i in ids if i is not None and i != ""], int(self.options.get("parallelism", 8)))] or [Ids([])]

    def read(self, partition: Ids) -> Iterator[tuple]:
        session, keep = _session(self.options), self.options.get("failures", "drop") == "keep"
        for key in partition.ids:
            try:
                yield key, json.dumps(json.loads(session.get(self.options["detail"].format(id=key), self.headers)), ensure_ascii=False), None, None
            except (ValueError, OSError) as error:
                if keep:
                    yield key, None, getattr(error, "code", None), str(error)
            session.sleep(session.config.delay)


# the sink


@dataclass
class Delivered(WriterCommitMessage):
    partition: int
    created: int
    failed: int
    skipped: int


class SinkSource(DataSource):
    """Posts each row (id and any columns, as JSON) to the option `url`, and keeps a ledger under the option `ledger`.

    Other options: token, retries, timeout, backoff. The id goes along as the header Idempotency-Key.
    """

    @classmethod
    def name(cls) -> str:
        return "qaforge_sink"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("a sink takes mode append only")
        if "id" not in schema.names:
            raise ValueError("rows have no column id")
        return SinkWriter(dict(self.options))


class SinkWriter(DataSourceWriter):
    """Tasks write down each delivery as it is made (one line a row, in a file of the partition and the attempt), and an attempt
    first reads what earlier ones of its partition wrote. So a task that runs again delivers what is left. Between a delivery
    and its line lies an instant in which a task may die; for that the service gets the id as an idempotency key.

    A row's failure is written down with its error and leaves the others alone. The driver's commit sums up the tasks' messages;
    after an abort the ledger stays, and `undelivered` says what the next run has to send.
    """

    def __init__(self, options: dict[str, str]):
        for key in ("url", "ledger"):
            if key not in options:
                raise ValueError(f"give the option {key}")
        self.options, self.run = options, options.get("run") or uuid.uuid4().hex

    def write(self, rows: Iterator) -> Delivered:
        from pyspark import TaskContext

        context = TaskContext.get()
        return self.deliver(rows, context.partitionId() if context else 0, context.taskAttemptId() if context else 0)

    def deliver(self, rows: Iterator, partition: int, attempt: int) -> Delivered:
        files, root = _files(self.options["ledger"])
        folder = f"{root.rstrip('/')}/run={self.run}"
        files.create_dir(folder, recursive=True)
        done, session = self._delivered(files, folder, partition), _session(self.options)
        headers = bearer(self.options["token"]) if "token" in self.options else {"Content-Type": "application/json"}
        created = failed = skipped = 0
        with files.open_append_stream(f"{folder}/{partition:06d}-{attempt}.jsonl") as ledger:
            for row in rows:
                value = row.asDict(recursive=True)
                key = str(value["id"])
                if key in done:
                    skipped += 1
                    continue
                error = self._post(session, json.dumps(value, ensure_ascii=False, default=str).encode(), {**headers, "Idempotency-Key": key})
                ledger.write((json.dumps({"id": key, "status": "failed" if error else "created", "error": error}, ensure_ascii=False) + "\n").encode())
                ledger.flush()
                if error:
                    failed += 1
                else:
                    created += 1
                    done.add(key)
        return Delivered(partition, created, failed, skipped)

    def _delivered(self, files, folder: str, partition: int) -> set[str]:
        """What earlier attempts of a partition have delivered: ids of this partition only."""
        from pyarrow import fs

        done: set[str] = set()
        for info in files.get_file_info(fs.FileSelector(folder)):
            if info.base_name.startswith(f"{partition:06d}-"):
                with files.open_input_stream(info.path) as stream:
                    for line in stream.read().decode().splitlines():
                        try:
                            entry = json.loads(line)
                        except ValueError:  # the line that a dying task was writing
                            continue
                        if entry["status"] == "created":
                            done.add(entry["id"])
        return done

    def _post(self, session: Session, body: bytes, headers: dict[str, str]) -> str | None:
        """The error of a row that was not delivered."""
        for attempt in range(session.config.max_retries + 1):
            try:
                with session.open(urllib.request.Request(self.options["url"], data=body, headers=headers, method="POST"), timeout=session.config.timeout) as answer:
                    answer.read()
                    return None
            except urllib.error.HTTPError as error:
                if error.code not in session.config.retry_on or attempt == session.config.max_retries:
                    return str(error)
            except OSError as error:
                if attempt == session.config.max_retries:
                    return str(error)
            session.sleep(session.config.backoff * 2**attempt)
        return "no try was made"

    def commit(self, messages: list[Delivered | None]) -> None:
        self._finish("committed", messages)

    def abort(self, messages: list[Delivered | None]) -> None:
        self._finish("aborted", messages)

    def _finish(self, status: str, messages: list[Delivered | None]) -> None:
        known = [m for m in messages if m is not None]
        total = {"run": self.run, "status": status, "tasks": len(known), **{k: sum(getattr(m, k) for m in known) for k in ("created", "failed", "skipped")}}
        files, root = _files(self.options["ledger"])
        files.create_dir(f"{root.rstrip('/')}/_runs", recursive=True)
        with files.open_output_stream(f"{root.rstrip('/')}/_runs/{self.run}.json") as stream:
            stream.write(json.dumps(total).encode())


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """run, id, status and error of each try at a delivery."""
    return spark.read.schema("id string, status string, error string, run string").option("recursiveFileLookup", "false").json(path)


def undelivered(rows: DataFrame, path: str) -> DataFrame:
    """The rows whose ids no run has delivered yet; all rows before the first one."""
    files, root = _files(path)
    from pyarrow import fs

    if files.get_file_info(root).type == fs.FileType.NotFound or not any(i.base_name.startswith("run=") for i in files.get_file_info(fs.FileSelector(root))):
        return rows
    done = ledger(rows.sparkSession, path).where("status = 'created'").select("id").distinct()
    return rows.join(done, rows["id"].cast("string") == done["id"], "left_anti")


def runs(path: str) -> list[dict]:
    """What each run came to: status, tasks, created, failed and skipped rows."""
    files, root = _files(path)
    from pyarrow import fs

    out = []
    for info in files.get_file_info(fs.FileSelector(f"{root.rstrip('/')}/_runs", allow_not_found=True)):
        with files.open_input_stream(info.path) as stream:
            out.append(json.loads(stream.read()))
    return sorted(out, key=lambda x: x["run"])


def register(spark: SparkSession) -> None:
    for source in (PagesSource, RestSource, SinkSource):
        spark.dataSource.register(source)

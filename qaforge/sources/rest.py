"""REST and page sources: fetches that run inside tasks, one session for each task, with retries."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import sha256
from ..functions.urls import picked_agent
from ..schema import EngineConfig


class Session:
    """GET with retries on the statuses of the configuration, and growing pauses between tries."""

    def __init__(self, config: EngineConfig, open_url: Callable | None = None, sleep: Callable = time.sleep):
        self.config, self.open, self.sleep = config, open_url or urllib.request.urlopen, sleep

    def get(self, url: str, headers: dict[str, str] | None = None) -> str:
        for attempt in range(self.config.max_retries + 1):
            try:
                with self.open(urllib.request.Request(url, headers=headers or {}), timeout=self.config.timeout) as answer:
                    return answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace")
            except urllib.error.HTTPError as error:
                if error.code not in self.config.retry_on or attempt == self.config.max_retries:
                    raise
            except urllib.error.URLError:
                if attempt == self.config.max_retries:
                    raise
            self.sleep(self.config.backoff * 2**attempt)
        raise AssertionError


def fetch(urls: DataFrame, config: EngineConfig = EngineConfig(), agents: list[str] | None = None, session: Callable[[], Session] | None = None, parallelism: int = 8) -> DataFrame:
    """url, url_hash, user_agent, html and error of each url: one of the last two is null.

    At most `parallelism` tasks fetch at once, each with a pause after every page.
    """
    opened = session or (lambda: Session(config))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = opened()
        for batch in batches:
            html, errors = [], []
            for url, agent in zip(batch.column("url").to_pylist(), batch.column("user_agent").to_pylist()):
                try:
                    html.append(own.get(url, {"User-Agent": agent}))
                    errors.append(None)
                except Exception as error:  # reported with its URL
                    html.append(None)
                    errors.append(str(error))
                own.sleep(config.delay)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(html, pa.string()), pa.array(errors, pa.string())], ["url", "url_hash", "user_agent", "html", "error"])

    asked = urls.select("url", sha256(F.col("url")).alias("url_hash"), picked_agent(F.col("url"), agents or []).alias("user_agent")).repartition(parallelism, "url")
    return asked.mapInArrow(run, "url string, url_hash string, user_agent string, html string, error string")


def bearer(token: str) -> dict[str, str]:
    """The headers of a service that asks for a token."""
    return {"Authorization": f"Bearer {token}", "Content-Type": "application/json"}


def details(listing: DataFrame, url_of: str, n: int | None = None, config: EngineConfig = EngineConfig(), session: Callable[[], Session] | None = None) -> DataFrame:
    """id and detail (JSON text) for each id of a listing, fetched from url_of.format(id=...).

    Null and empty ids are skipped and failed details are dropped; n takes only the first n by `place`.
    """
    rows = listing.orderBy("place").limit(n) if n is not None else listing
    return answers(rows, url_of, config, session).where("error IS NULL").drop("status", "error")


def answers(listing: DataFrame, url_of: str, config: EngineConfig = EngineConfig(), session: Callable[[], Session] | None = None, headers: dict[str, str] | None = None) -> DataFrame:
    """id, detail (JSON text), status (of an HTTP error) and error for each id of a listing; null and empty ids are skipped."""
    opened = session or (lambda: Session(config))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = opened()
        for batch in batches:
            out = []
            for key in batch.column("id").to_pylist():
                try:
                    out.append((key, json.dumps(json.loads(own.get(url_of.format(id=key), headers)), ensure_ascii=False), None, None))
                except (ValueError, OSError) as error:
                    out.append((key, None, getattr(error, "code", None), str(error)))
                finally:
                    own.sleep(config.delay)
            kinds = (pa.string(), pa.string(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 4, kinds)], ["id", "detail", "status", "error"])

    return listing.where("id IS NOT NULL AND id <> ''").select("id").mapInArrow(run, "id string, detail string, status int, error string")


class KnowledgeBase:
    """A knowledge service: its health, its collections, one collection, and the content of its files.

    The collections' list is one answer of the service and small; collections and files are fetched in tasks.
    """

    def __init__(self, url: str, token: str, config: EngineConfig = EngineConfig(), session: Callable[[], Session] | None = None):
        self.url, self.headers, self.config, self.session = url.rstrip("/"), bearer(token), config, session or (lambda: Session(config))

    def health(self) -> dict:
        """The service's own answer; an error if it can't be reached."""
        try:
            return json.loads(self.session().get(f"{self.url}/health"))
        except (ValueError, OSError) as error:
            raise ConnectionError("the knowledge service is unreachable") from error

    def collections(self, spark: SparkSession) -> DataFrame:
        """id and detail (JSON text) of each collection."""
        found = json.loads(self.session().get(f"{self.url}/api/v1/knowledge/", self.headers))
        return spark.createDataFrame([(x.get("id"), json.dumps(x, ensure_ascii=False)) for x in found], "id string, detail string")

    def knowledge(self, ids: DataFrame) -> DataFrame:
        """id, detail, status and error of each collection."""
        return answers(ids, f"{self.url}/api/v1/knowledge/{{id}}", self.config, self.session, self.headers)

    def contents(self, ids: DataFrame) -> DataFrame:
        """id, content, status and error of each file."""
        found = answers(ids, f"{self.url}/api/v1/files/{{id}}/data/content", self.config, self.session, self.headers)
        return found.select("id", F.get_json_object("detail", "$.content").alias("content"), "status", "error")


def by_key(found: DataFrame) -> DataFrame:
    """One map of all details by id: the result of a small listing."""
    return found.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("id", "detail")))).alias("details"))

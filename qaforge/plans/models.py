"""The model stages: cleaning a text and generating question/answer pairs from it.

Each is a protocol with a deterministic offline form in native expressions; a model behind a service goes in as a function
that runs in tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WS, strip


class Cleaner(Protocol):
    def __call__(self, text: Column) -> Column: ...


class Generator(Protocol):
    def __call__(self, text: Column) -> Column: ...


PAIRS = "array<struct<question:string,answer:string,context:string,confidence:double>>"


def offline_cleaner(text: Column, limit: int = 10_000) -> Column:
    """The first `limit` characters without bracketed reference marks and edit mentions, stripped; if nothing is left, the
    text itself, stripped."""
    out = F.regexp_replace(F.substring(text, 1, limit), r"\[(?:[0-9]+|[a-z]|edit|citation needed)\]", "")
    out = strip(F.regexp_replace(out, r"(?m)^[ \t]*(?:Menu|Navigation|Share|Log in|Sign up|Advertisement)[ \t]*$", ""))
    return F.when(out == "", strip(text)).otherwise(out)


def offline_generator(text: Column, words: int = 6) -> Column:
    """A pair for each line of at least 50 characters and `words` words: asked by its first words, answered by the line,
    which is also the context. Confidence is the line's share of letters, in steps of 1/4."""
    # Each line is stripped once, and cut no further than its first words.
    bodies = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: F.length(x) >= 50)
    lines = F.transform(bodies, lambda x: F.struct(x.alias("body"), F.split(x, f"{WS}+", words + 1).alias("start")))

    def pair(line: Column) -> Column:
        body, start = line["body"], F.array_join(F.slice(line["start"], 1, words), " ")
        letters = F.length(F.regexp_replace(body, r"[^\p{L}]+", ""))
        share = F.floor(4 * letters / F.length(body)) / 4
        return F.struct(F.concat(F.lit("What is said about: "), F.substring(start, 1, 400), F.lit("?")).alias("question"), body.alias("answer"), body.alias("context"), share.cast("double").alias("confidence"))

    return F.transform(F.filter(lines, lambda x: F.size(x["start"]) >= words), pair)


def served_cleaner(call: Callable[[], Callable[[str], str]], limit: int = 10_000) -> Cleaner:
    """A cleaner by a function that call() opens once in each task. An empty answer gives the stripped text, a failure the
    text as it is."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        clean = call()
        for batch in batches:
            out = []
            for text in batch.to_pylist():
                try:
                    out.append(None if text is None else (clean(text[:limit]) or "").strip() or text.strip())
                except Exception:  # the text stands for itself
                    out.append(text)
            yield pa.array(out, pa.string())

    return lambda text: run(text)


def served_generator(call: Callable[[], Callable[[str], list[dict]]]) -> Generator:
    """A generator by a function that call() opens once in each task; a failure gives no pairs."""

    @F.arrow_udf(PAIRS)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        generate, kind = call(), pa.list_(pa.struct([("question", pa.string()), ("answer", pa.string()), ("context", pa.string()), ("confidence", pa.float64())]))
        for batch in batches:
            out = []
            for text in batch.to_pylist():
                try:
                    out.append([{k: p.get(k) for k in ("question", "answer", "context", "confidence")} for p in generate(text or "")])
                except Exception:  # no pairs from this text
                    out.append([])
            yield pa.array(out, kind)

    return lambda text: run(text)


class InvalidAnswer(ValueError):
    """A model's answer that isn't a list of whole pairs; asked again, the model is told why."""


def checked_pairs(answer) -> list[dict]:
    """The pairs of an answer: each with a question and an answer that aren't empty, a context, and a confidence from 0 to 1 or
    none. One pair that isn't makes all of the answer invalid."""
    if not isinstance(answer, list):
        raise InvalidAnswer(f"a list of pairs was asked for, not {type(answer).__name__}")
    out = []
    for i, pair in enumerate(answer):
        if not isinstance(pair, dict):
            raise InvalidAnswer(f"pair {i} is not an object")
        for key in ("question", "answer"):
            if not isinstance(pair.get(key), str) or not pair[key].strip():
                raise InvalidAnswer(f"pair {i} has no {key}")
        context, confidence = pair.get("context"), pair.get("confidence")
        if context is not None and not isinstance(context, str):
            raise InvalidAnswer(f"the context of pair {i} is not a text")
        if confidence is not None and (isinstance(confidence, bool) or not isinstance(confidence, int | float) or not 0 <= confidence <= 1):
            raise InvalidAnswer(f"the confidence of pair {i} is not from 0 to 1")
        out.append({"question": pair["question"], "answer": pair["answer"], "context": context, "confidence": None if confidence is None else float(confidence)})
    return out


def asked_again(ask: Callable[[str, str | None], list[dict]], text: str, tries: int) -> list[dict]:
    """The model's pairs. After an invalid answer it is asked again with the reason, `tries` times in all; the last one's error is
    raised."""
    reason = None
    for left in range(max(1, tries), 0, -1):
        try:
            return checked_pairs(ask(text, reason))
        except InvalidAnswer as error:
            if left == 1:
                raise
            reason = str(error)
    raise AssertionError


def called_pairs(texts: DataFrame, key: str, call: Callable[[], Callable[[str, str | None], list[dict]]], concurrency: int = 8, timeout: float = 60.0, tries: int = 3, tasks: int = 8) -> DataFrame:
    """key, index, question, answer, context, confidence and error for each pair that a served model gives for `text`.

    A table function: call() opens the model once in each partition, and up to `concurrency` calls of it run at once, so a slow
    service is waited for together. ask(text, reason) returns pairs; an invalid answer is asked for again with the reason, and
    so up to `tries` times. A call that fails, or takes over `timeout` seconds from when it is waited for, gives one row with an
    error and an index of -1; the other texts go on. Null and empty texts are not sent and give no rows; repeated rows are sent
    once each. Keys are dealt to `tasks` tasks by the text, so a key that many rows have is split.
    """
    from concurrent.futures import ThreadPoolExecutor
    from concurrent.futures import TimeoutError as Late

    kind = texts.schema[key].dataType.simpleString()

    class Pairs:
        def __init__(self):
            self.waiting, self.pool, self.ask = [], None, None

        def eval(self, row):
            if self.pool is None:
                self.pool, self.ask = ThreadPoolExecutor(concurrency), call()
            self.waiting.append((row["key"], self.pool.submit(asked_again, self.ask, row["text"], tries)))
            if len(self.waiting) >= 2 * concurrency:
                yield from self.first()

        def first(self):
            own, future = self.waiting.pop(0)
            try:
                for i, p in enumerate(future.result(timeout)):
                    yield own, i, p["question"], p["answer"], p["context"], p["confidence"], None
            except Late:
                future.cancel()
                yield own, -1, None, None, None, None, f"no answer within {timeout} seconds"
            except Exception as error:  # reported with its text
                yield own, -1, None, None, None, None, str(error)

        def terminate(self):
            while self.waiting:
                yield from self.first()
            if self.pool is not None:
                self.pool.shutdown(wait=False, cancel_futures=True)

    function = F.udtf(Pairs, returnType=f"key {kind}, index int, question string, answer string, context string, confidence double, error string")
    sent = texts.where("text IS NOT NULL AND text <> ''").select(F.col(key).alias("key"), "text", F.pmod(F.xxhash64("text", key), F.lit(tasks)).alias("task"))
    return function(sent.asTable().partitionBy("task")).withColumnRenamed("key", key)


def catalogue(spark, list_models: Callable[[], list[dict]]) -> DataFrame:
    """id and object of each model; a failing service has none."""
    try:
        rows = [(m["id"], m.get("object", "model")) for m in list_models()]
    except Exception:  # no catalogue
        rows = []
    return spark.createDataFrame(rows, "id string, object string")

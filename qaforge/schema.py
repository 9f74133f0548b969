"""Declared schemas, configuration, and checks of arguments."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import types as T

_S, _I, _L, _D, _B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


INPUT = _struct(question=_S, context=_S, source_url=_S, index=_I)
EXPECTED = _struct(answer=_S, confidence=_D)
METADATA = _struct(generation_timestamp=_S, context_length=_I, question_length=_I, answer_length=_I, content_hash=_S)
DATASETS = _struct(id=_S, name=_S, description=_S, created_at=T.TimestampNTZType())
SNAPSHOTS = _struct(id=_S, url=_S, user_agent=_S, retrieved_at=T.TimestampNTZType(), content=_S, url_hash=_S, dataset_id=_S)
CLEANED = _struct(id=_S, page_snapshot_id=_S, content=_S, language=_S, model=_S)
#: seq is the order of insertion, which the operators need where a store has no order of its own.
QA_SOURCES = _struct(
    id=_S, dataset_name=_S, dataset_id=_S, source_trace_id=_S, page_snapshot_id=_S, input=INPUT, expected_output=EXPECTED, qa_metadata=METADATA,
    status=_S, model=_S, created_at=T.TimestampNTZType(), updated_at=T.TimestampNTZType(), human_reviewed=_B, seq=_L,
)
#: Rows of a JSON file that is to be exported.
FILE_ITEM = _struct(id=_S, question=_S, answer=_S, confidence=_D, context=_S)

LANGUAGES = ("fr", "en", "es", "de")
#: Sizes of the questions, answers and contexts that validation lets pass.
QUESTION_LENGTH, ANSWER_LENGTH, CONTEXT_LENGTH = (10, 500), 20, 50
#: The least similarity of contexts of a fuzzy duplicate.
CONTEXT_SIMILARITY = 0.95


def normalise_threshold(value, default: float = 0.9) -> float:
    """A threshold from a number, a numeric string or nothing: clamped to 0..1, NaN to 1, anything else to the default."""
    try:
        value = float(value)
    except (TypeError, ValueError):
        return default
    return 1.0 if math.isnan(value) else max(0.0, min(1.0, value))


def offered_threshold(value: float) -> float:
    """The nearest of the thresholds that are offered for a choice: from 0.1 to 1 in steps of 0.05."""
    return min(20, max(2, math.floor(20 * normalise_threshold(value) + 0.5))) / 20


def checked_page(limit: int, offset: int) -> tuple[int, int]:
    """A page's limit (1 to 1000) and offset (0 or more); others are an error."""
    if not 1 <= limit <= 1000:
        raise ValueError(f"limit must be from 1 to 1000, not {limit}")
    if offset < 0:
        raise ValueError(f"offset must not be negative, not {offset}")
    return limit, offset


@dataclass(frozen=True)
class EngineConfig:
    """Settings of fetching and of the model stages."""

    max_retries: int = 3
    timeout: float = 10.0
    delay: float = 0.2
    backoff: float = 0.3
    retry_on: tuple[int, ...] = (429, 500, 502, 503, 504)
    clean_limit: int = 10_000
    chunk_size: int = 5000
    overlap: int = 200
    similarity: float = 0.9
    models: tuple[str, ...] = field(default=("offline",))

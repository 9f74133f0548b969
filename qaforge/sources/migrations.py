"""Schema versions of a versioned table: ordered steps up and down, and reading of tables that older code wrote.

The schema's number stays with the table (in the note of its versions). A step up or down is a function of the rows, so a
migration is one Spark job that writes the table anew and one commit; a reader of newer code can also take an older table's
rows through the steps as it reads them, without a rewrite.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CLEANED, DATASETS, QA_SOURCES, SNAPSHOTS
from .versions import Conflict, VersionedTable

Rows = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Step:
    """From schema number - 1 to number, and back. `down` may lose what the older schema has no place for."""

    number: int
    name: str
    up: Rows
    down: Rows


def _adds(number: int, name: str, column: str, kind: str, default) -> Step:
    """A step that adds a column with a default."""
    return Step(number, name, lambda rows: rows.withColumn(column, F.lit(default).cast(kind)), lambda rows: rows.drop(column))


#: Rows of questions and answers: the first table had neither a review mark nor an order of insertion.
QA_STEPS = (_adds(2, "add human_reviewed", "human_reviewed", "boolean", False), _adds(3, "add seq", "seq", "long", None))


class Migrations:
    """Steps of one kind of table; schema 1 is the one before the first step, 0 is a table that doesn't exist."""

    def __init__(self, steps: Sequence[Step]):
        self.steps = tuple(sorted(steps, key=lambda s: s.number))
        if [s.number for s in self.steps] != list(range(2, len(self.steps) + 2)):
            raise ValueError("steps must be numbered from 2 on without gaps")

    @property
    def head(self) -> int:
        return len(self.steps) + 1

    def number(self, table: VersionedTable) -> int:
        """The schema's number of a table, 0 for one that doesn't exist; a table without a note is of schema 1."""
        now = table.latest()
        return 0 if now is None else now.note.get("schema_version", 1)

    def needed(self, table: VersionedTable) -> bool:
        """Whether a table is older than this code, or doesn't exist. One that is newer is an error: older code can't read it."""
        number = self.number(table)
        if number > self.head:
            raise ValueError(f"{table.path} has schema {number}, this code knows {self.head}")
        return number < self.head

    def taken(self, rows: DataFrame, number: int, to: int | None = None) -> DataFrame:
        """rows of one schema as rows of another."""
        to = self.head if to is None else to
        for which in (number, to):
            if not 1 <= which <= self.head:
                raise ValueError(f"there is no schema {which}, only 1 to {self.head}")
        for step in self.steps:
            if number < step.number <= to:
                rows = step.up(rows)
        for step in reversed(self.steps):
            if to < step.number <= number:
                rows = step.down(rows)
        return rows

    def read(self, table: VersionedTable) -> DataFrame:
        """The rows of a table in the newest schema, whatever schema it has; the table stays as it is."""
        self.needed(table)
        return self.taken(table.read(), self.number(table))

    def create(self, table: VersionedTable, rows: DataFrame) -> int:
        """A new table of rows in the newest schema. The number of its version."""
        if table.latest() is not None:
            raise ValueError(f"{table.path} exists")
        return table.replace(rows, since=0, note={"schema_version": self.head})

    def migrate(self, table: VersionedTable, to: int | None = None) -> int:
        """Take a table up or down to a schema (the newest one). The number of its version, which stays if nothing is to do.

        If another writer commits meanwhile, that is a Conflict: the rows that it brought would be of the old schema.
        """
        to, now, number = self.head if to is None else to, table.latest(), self.number(table)
        if now is None:
            raise ValueError(f"{table.path} has no version yet")
        if number == to:
            return now.number
        return table.replace(self.taken(table.read(now.number), number, to), since=now.number, note={"schema_version": to})

    def reset(self, table: VersionedTable) -> int:
        """Down to the first schema and up again: columns that steps add have their defaults."""
        self.migrate(table, 1)
        return self.migrate(table)


#: The engine's tables: schema, key and steps.
TABLES = {"datasets": (DATASETS, None, ()), "page_snapshots": (SNAPSHOTS, "dataset_id", ()), "cleaned_texts": (CLEANED, None, ()), "qa_sources": (QA_SOURCES, "dataset_id", QA_STEPS)}


def open_tables(spark: SparkSession, root: str) -> dict[str, VersionedTable]:
    """The engine's tables under a folder. Those that don't exist are created empty, in the newest schema; those of an older one
    are taken up. Any number of processes may do so at once: one of them creates or migrates, the others find it done."""
    out = {}
    for name, (schema, by, steps) in TABLES.items():
        table, known = VersionedTable(spark, f"{root.rstrip('/')}/{name}", by), Migrations(steps)
        try:
            if table.latest() is None:
                known.create(table, spark.createDataFrame([], schema))
            elif known.needed(table):
                known.migrate(table)
        except (Conflict, ValueError):
            if known.needed(table):  # nobody else did it
                raise
        out[name] = table
    return out

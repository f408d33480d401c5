"""Where queries and the SQL that gives the same rows are registered, and stand-ins that both read alike."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, joined: tuple[str, ...] = ()) -> Callable:
    """Register a query under its function's name; lists in the `joined` columns become texts with bars between."""

    def register(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        @wraps(run)
        def told(spark: SparkSession, sf_dir: str) -> DataFrame:
            return run(spark, sf_dir).withColumns({c: F.array_join(c, "|") for c in joined})

        QUERIES[run.__name__] = told if joined else run
        if sql:
            ORACLES[run.__name__] = f"SELECT * REPLACE ({', '.join(f"array_to_string({c}, '|') AS {c}" for c in joined)}) FROM ({sql})" if joined else sql
        return run

    return register


@dataclass(frozen=True)
class StandIn:
    """A supplied table in the place of a domain table: its columns as expressions that both engines read."""

    name: str
    columns: dict[str, str]

    def rows(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.of(table(spark, sf_dir, self.name))

    def of(self, rows: DataFrame) -> DataFrame:
        """The columns of rows that have the table's."""
        return rows.selectExpr(*[f"{e} AS {c}" for c, e in self.columns.items()])

    @property
    def sql(self) -> str:
        return f"(SELECT {', '.join(f'{e} AS {c}' for c, e in self.columns.items())} FROM {self.name})"


def choice(key: str, *values: str) -> str:
    """An expression that gives rows the texts in turn, and null after the last."""
    cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {key} % {len(values) + 1} {cases} END"

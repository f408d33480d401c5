"""Tables that are replaced as a whole: written beside the old one, checked, then published; or rolled back."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class StagedTable:
    """Versions of a table under one path, and a log of which of them holds.

    A version is written in full before a row of the log names it, so readers see the old table or the new
    one, whatever is lost in between.  Versions stay for a roll-back.  One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def log(self) -> DataFrame | None:
        """(step, version) of each publication; None before the first."""
        self.spark.catalog.refreshByPath(f"{self.path}/log")
        try:
            return self.spark.read.schema("step long, version string").parquet(f"{self.path}/log")
        except Exception as error:  # nothing published yet
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return None

    def version(self, back: int = 0) -> str | None:
        """The version that holds, or `back` publications before it."""
        log = self.log()
        rows = log.orderBy(F.desc("step")).limit(back + 1).collect() if log is not None else []
        return rows[back]["version"] if len(rows) > back else None

    def rows(self, version: str | None = None) -> DataFrame | None:
        """The table that holds, or a staged version; None before the first publication."""
        held = version or self.version()
        return self.spark.read.parquet(f"{self.path}/versions/{held}") if held else None

    def stage(self, rows: DataFrame) -> str:
        """Write rows as a version that doesn't hold yet."""
        version = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/versions/{version}")
        return version

    def publish(self, version: str, check: Callable[[DataFrame | None, DataFrame], list[str]] = lambda old, new: []) -> None:
        """Let a staged version hold; what `check` finds wrong with old and new table stops it, and the old one stays."""
        if wrong := check(self.rows(), self.rows(version)):
            raise ValueError(f"not published: {'; '.join(wrong)}")
        self._name(version)

    def roll_back(self) -> None:
        """Let the version before hold again."""
        before = self.version(1)
        if before is None:
            raise ValueError("no version to go back to")
        self._name(before)

    def _name(self, version: str) -> None:
        log = self.log()
        step = (log.agg(F.max("step")).first()[0] if log is not None else 0) + 1
        self.spark.createDataFrame([(step, version)], "step long, version string").coalesce(1).write.mode("append").parquet(f"{self.path}/log")

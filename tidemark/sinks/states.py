"""Carried state: one table of small rows per refresh, each made from the one before."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators import policy
from tidemark.session import list_names, path_exists


@dataclass(frozen=True)
class BufferStates:
    """The two-refresh buffer of a policy, kept up to date without its history.

    A refresh is a folder.  Taking in a refresh reads the newest folder before it and
    replaces its own, so a run that failed, or is done again, ends in the same state.
    """

    spark: SparkSession
    path: str
    policy: str

    def names(self) -> list[str]:
        """The refreshes taken in, oldest first; as many as months."""
        if not path_exists(self.spark, self.path):
            return []
        return sorted(name.removeprefix("refresh=") for name in list_names(self.spark, self.path) if name.startswith("refresh="))

    def at(self, refresh: str) -> DataFrame:
        return self.spark.read.schema(policy.BUFFER_STATE).parquet(f"{self.path}/refresh={refresh}")

    def begin(self, refresh: str, history: DataFrame) -> None:
        """Start from a ``buffered`` history up to ``refresh``."""
        policy.buffer_state(history).write.mode("overwrite").parquet(f"{self.path}/refresh={refresh}")

    def take(self, refresh: str, verdicts: DataFrame) -> DataFrame:
        """The state after ``refresh``; names of refreshes sort by time (2001-09-01)."""
        earlier = [name for name in self.names() if name < refresh]
        state = self.at(earlier[-1]) if earlier else self.spark.createDataFrame([], policy.BUFFER_STATE)
        policy.advance_buffer(state, verdicts, self.policy).write.mode("overwrite").parquet(f"{self.path}/refresh={refresh}")
        return self.at(refresh)

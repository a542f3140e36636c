"""Interactive searches: one at a time, and a newer one ends those before it."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession


class Searches:
    """Searches of one window. ask() gives the rows of a page, or None for a search that a newer one has replaced:
    one that waits never starts, and one that runs has its jobs cancelled by their tag."""

    def __init__(self, spark: SparkSession):
        self.spark, self.name = spark, uuid.uuid4().hex
        self._running, self._counting, self._latest = threading.Lock(), threading.Lock(), 0

    def _tag(self, generation: int) -> str:
        return f"search-{self.name}-{generation}"

    def _stale(self, generation: int) -> bool:
        with self._counting:
            return generation < self._latest

    def begin(self) -> int:
        """A new search's number; whatever runs for an older one is cancelled."""
        with self._counting:
            self._latest += 1
            new = self._latest
        self.spark.sparkContext.cancelJobsWithTag(self._tag(new - 1))
        return new

    def ask(self, page: Callable[[], DataFrame], generation: int | None = None) -> list[Row] | None:
        generation = self.begin() if generation is None else generation
        with self._running:
            if self._stale(generation):
                return None
            context = self.spark.sparkContext
            context.addJobTag(self._tag(generation))
            try:
                rows = page().collect()
            except Exception:
                if self._stale(generation):
                    return None
                raise
            finally:
                context.removeJobTag(self._tag(generation))
        return None if self._stale(generation) else rows

"""Stopping the jobs of one reader while others go on."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import SparkSession

from siltstone.errors import Cancelled

T = TypeVar("T")


class Cancellation:
    """Runs actions whose jobs another thread can stop; after that no action starts."""

    def __init__(self, spark: SparkSession):
        self._context, self._tag, self._asked = spark.sparkContext, f"siltstone-{uuid.uuid4().hex}", False

    def run(self, action: Callable[[], T]) -> T:
        """The action's result; Cancelled if cancel() came before or in between."""
        if self._asked:
            raise Cancelled("cancelled")
        self._context.addJobTag(self._tag)
        try:
            return action()
        except Exception as error:
            if self._asked:
                raise Cancelled("cancelled") from error
            raise
        finally:
            self._context.removeJobTag(self._tag)

    def cancel(self) -> None:
        self._asked = True
        self._context.cancelJobsWithTag(self._tag)

"""Timers of runs, and their table."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


class Stopwatch:
    """Wall and driver CPU seconds by name; names that run again add up."""

    def __init__(self) -> None:
        self.times: dict[str, tuple[float, float]] = {}

    @contextmanager
    def measured(self, name: str) -> Iterator[None]:
        wall, cpu = time.perf_counter(), time.process_time()
        try:
            yield
        finally:
            a, b = self.times.get(name, (0.0, 0.0))
            self.times[name] = (a + time.perf_counter() - wall, b + time.process_time() - cpu)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, *v) for k, v in sorted(self.times.items(), key=lambda x: x[1])], "name string, seconds double, cpu double")

    def csv(self) -> str:
        """A line of names and one of seconds."""
        own = sorted(self.times.items(), key=lambda x: x[1])
        return ",".join(k for k, _ in own) + "\n" + ",".join(f"{v[0]:.3f}" for _, v in own) + "\n"


def warmed_up(run, times: int = 1):
    """Run it ``times`` times before the run that counts."""
    for _ in range(times):
        run()
    return run()

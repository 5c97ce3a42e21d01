"""Timing of queries: warm-up runs, then the mean, deviation, least and most of some."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from statistics import mean, pstdev

from pyspark.sql import DataFrame


@dataclass
class Timing:
    name: str
    times: list[float] = field(default_factory=list)

    @property
    def mean(self) -> float:
        return mean(self.times)

    @property
    def std(self) -> float:
        return pstdev(self.times)

    def speedup_over(self, other: Timing) -> float:
        return other.mean / self.mean


def benchmark(make: Callable[..., DataFrame], *args, n_runs: int = 5, warmup: int = 1, name: str | None = None, **kw) -> Timing:
    """Times ``make(*args)`` with all its rows computed and dropped."""
    out = Timing(name or getattr(make, "__name__", "query"))
    for i in range(warmup + n_runs):
        start = time.perf_counter()
        make(*args, **kw).write.format("noop").mode("overwrite").save()
        if i >= warmup:
            out.times.append(time.perf_counter() - start)
    return out


def suite(makers: dict[str, Callable[[], DataFrame]], n_runs: int = 5) -> dict[str, Timing]:
    return {name: benchmark(f, n_runs=n_runs, name=name) for name, f in makers.items()}


def table(results: dict[str, Timing]) -> str:
    """A Markdown table."""
    rows = [f"| {t.name} | {t.mean:.3f} | {t.std:.3f} | {min(t.times):.3f} | {max(t.times):.3f} |" for t in results.values()]
    return "\n".join(["| query | mean s | std s | min s | max s |", "| --- | --- | --- | --- | --- |", *rows])

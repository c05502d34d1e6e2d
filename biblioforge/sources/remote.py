"""Lookups at a service that can be exchanged: bounded rate, retries with growing pauses, errors as rows.

``fetch`` gets one key and returns its rows; it may raise ``Busy`` (too many requests, or a failing server) to be
asked again. Each task keeps its own share of the rate, so the whole never exceeds it.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


class Busy(Exception):
    """The service asks to come back later, after ``pause`` seconds if it says so."""

    def __init__(self, status: int, pause: float | None = None) -> None:
        super().__init__(f"status {status}")
        self.status, self.pause = status, pause


class Unavailable(Exception):
    """Retries are used up."""


class TokenBucket:
    """At most ``burst`` calls at once and ``rate`` a second in the long run."""

    def __init__(self, rate: float, burst: int, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.rate, self.burst, self.clock, self.sleep = rate, burst, clock, sleep
        self.tokens, self.at = float(burst), clock()

    def take(self) -> None:
        now = self.clock()
        self.tokens = min(self.burst, self.tokens + (now - self.at) * self.rate)
        self.at = now
        if self.tokens < 1:
            wait = (1 - self.tokens) / self.rate
            self.sleep(wait)
            self.tokens, self.at = 1.0, now + wait
        self.tokens -= 1


def patiently(call: Callable[[], list], retries: int = 3, first: float = 5.0, most: float = 120.0, sleep: Callable[[float], None] = time.sleep) -> list:
    """The call's result; ``Busy`` and broken connections are retried after pauses that double, with some chance in them."""
    for n in range(retries + 1):
        try:
            return call()
        except (Busy, ConnectionError, TimeoutError) as e:
            if n == retries:
                raise Unavailable(f"{e} after {retries + 1} attempts") from e
            pause = getattr(e, "pause", None) or min(most, first * 2**n)
            sleep(pause * (0.8 + 0.4 * random.random()))
    raise AssertionError


def looked_up(keys: DataFrame, key: str, fetch: Callable[[str], list[tuple]], schema: str, rate: float = 2.5, burst: int = 10, retries: int = 3, tasks: int = 4, stop_after: int = 10, first: float = 5.0) -> DataFrame:
    """(key, columns of ``schema``..., error) of each different key: a row a result, or one row with an error.

    ``tasks`` run at a time, each with its part of ``rate`` and ``burst``. A task that met ``stop_after`` failures
    in a row asks no more and gives the rest as errors, so that they can be asked another time.
    """
    names = [c.strip().split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket, failed = TokenBucket(rate / tasks, max(1, burst // tasks)), 0
        for p in batches:
            rows = []
            for k in p[key]:
                if failed >= stop_after:
                    rows.append((k, *[None] * len(names), "not asked: the service fails"))
                    continue

                def once(k: str = k) -> list:
                    bucket.take()
                    return fetch(k)

                try:
                    rows += [(k, *r, None) for r in patiently(once, retries, first)]
                    failed = 0
                except Exception as e:  # noqa: BLE001  an error belongs to its key, not to the job
                    failed += 1
                    rows.append((k, *[None] * len(names), str(e)))
            yield pd.DataFrame(rows, columns=[key, *names, "error"])

    one = keys.select(key).where(f"`{key}` is not null").distinct().repartition(tasks)
    return one.mapInPandas(run, f"`{key}` string, {schema}, error string")

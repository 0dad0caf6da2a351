"""Usage: totals of events, rolling windows against a quota, gaps between calls; and the pacing itself."""

from __future__ import annotations

import random
import time
from collections import deque
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

# Statuses worth a retry, tries, and the waits between them in milliseconds.
RETRY_STATUSES = (429, 500, 502, 503, 504)
MAX_TRIES, FIRST_WAIT_MS, LONGEST_WAIT_MS = 6, 1000, 32_000
WINDOW_MS = 60_000


def totals(events: DataFrame) -> DataFrame:
    """One row over all events; zeros where there are none."""
    return events.agg(*_sums())


def totals_by_kind(events: DataFrame) -> DataFrame:
    """Totals by kind and overall (kind null) in one pass."""
    return events.rollup("kind").agg(*_sums())


def _sums():
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("items", "input_tokens", "output_tokens", "bytes")]
    return [F.count(F.lit(1)).alias("calls"), *sums, F.coalesce(F.sum("duration_ms"), F.lit(0.0)).alias("duration_ms"), F.count_if(~F.col("ok")).alias("failures")]


def rolling_items(events: DataFrame, key: str, window_ms: int = WINDOW_MS, at: str = "at", items: str = "items") -> DataFrame:
    """events with the items of the window that ends with them; an event exactly the window old still counts.

    Time is cut into buckets as long as the window, and each bucket also gets the events of the one
    before it, so that a key's events are dealt over as many tasks as it has buckets.
    """
    own = [F.col(c) for c in events.columns]
    width = window_ms * 1000
    timed = events.withColumn("_t", F.unix_micros(F.col(at).cast("timestamp")))
    each = timed.withColumn("_b", F.explode(F.array((F.floor(F.col("_t") / width)).cast("long"), (F.floor(F.col("_t") / width) + 1).cast("long"))))
    over = f"over (partition by {key}, _b order by _t range between {width} preceding and current row)"
    summed = each.withColumn("items_in_window", F.expr(f"sum({items}) {over}"))
    # an event without a time is in the window of the others without one, as the sort puts them
    return summed.filter(F.col("_b") == F.floor(F.col("_t") / width)).select(*own, "items_in_window").unionByName(
        events.filter(F.col(at).isNull()).withColumn("items_in_window", F.expr(f"sum({items}) over (partition by {key})"))
    )


def gaps(events: DataFrame, key: str, min_interval_ms: int, at: str = "at") -> DataFrame:
    """events with the gap to the one before (null for the first) and whether it is too short.

    Ranges of (key, time) find the gaps inside; a range's first event looks up the last one before it in a table of a
    row per range and key, so no task sees all events of a key.
    """
    own = [F.col(c) for c in events.columns]
    timed = events.withColumn("_t", F.unix_micros(F.col(at).cast("timestamp")))
    ranged = written(timed.repartitionByRange(F.col(key), F.col("_t")).withColumn("_range", F.spark_partition_id()), "gaps")
    inside = ranged.withColumn("_last", F.expr(f"lag(_t) over (partition by _range, {key} order by _t)"))
    ends = ranged.groupBy(key, "_range").agg(F.max("_t").alias("_max"))
    before = ends.select(F.col(key).alias("_key"), F.col("_range").alias("_of"), F.expr(f"lag(_max) over (partition by {key} order by _range)").alias("_before"))
    joined = inside.join(before, (F.col("_range") == F.col("_of")) & F.col(key).eqNullSafe(F.col("_key")))
    first = F.expr(f"row_number() over (partition by _range, {key} order by _t) = 1")
    out = joined.withColumn("_first", first).withColumn("gap_ms", (F.col("_t") - F.when(F.col("_first"), F.col("_before")).otherwise(F.col("_last"))) / 1000)
    return out.withColumn("too_soon", F.coalesce(F.col("gap_ms") < min_interval_ms, F.lit(False))).select(*own, "gap_ms", "too_soon")


class RateLimiter:
    """At most one start per interval."""

    def __init__(self, interval_ms: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.interval, self.clock, self.sleep, self.next = interval_ms / 1000, clock, sleep, 0.0

    def back_off(self, ms: float) -> None:
        self.next = max(self.next, self.clock() + ms / 1000)

    def __call__(self, work: Callable):
        if (wait := self.next - self.clock()) > 0:
            self.sleep(wait)
        self.next = self.clock() + self.interval
        return work()


class ItemRateLimiter:
    """At most so many items per rolling window; more than that in one batch passes an empty window."""

    def __init__(self, most: int, window_ms: float = WINDOW_MS, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.most, self.window, self.clock, self.sleep, self.events = most, window_ms / 1000, clock, sleep, deque()

    def __call__(self, items: int, work: Callable):
        while True:
            now = self.clock()
            while self.events and now - self.events[0][0] > self.window:
                self.events.popleft()
            if not self.events or sum(n for _, n in self.events) + items <= self.most:
                break
            self.sleep(max(0.25, self.events[0][0] + self.window - now))
        self.events.append((self.clock(), items))
        return work()


def with_retry(work: Callable, status_of: Callable[[Exception], int | None], hint_ms: Callable[[Exception], float | None] = lambda e: None, sleep: Callable[[float], None] = time.sleep, record: Callable[[int, bool], None] = lambda n, ok: None):
    """work(), again after errors worth it; every attempt is recorded."""
    for n in range(MAX_TRIES):
        try:
            out = work()
            record(n, True)
            return out
        except Exception as e:
            record(n, False)
            if status_of(e) not in RETRY_STATUSES or n == MAX_TRIES - 1:
                raise
            sleep((hint_ms(e) or min(2 ** (n + 1) * FIRST_WAIT_MS, LONGEST_WAIT_MS) * random.uniform(0.5, 1)) / 1000)
